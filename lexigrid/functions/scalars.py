"""Scalar column functions over laws, provisions and their labels; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Codes and the labels shown for them.
LAW_STATUS = {
    "in_force": "In Force",
    "not_yet_in_force": "Not Yet In Force",
    "repealed": "Repealed",
    "revoked": "Revoked",
    "draft": "Draft",
}
EDGE_TYPES = {
    "amends": "Amends",
    "amended_by": "Amended By",
    "enacted_by": "Enacted By",
    "rescinds": "Rescinds",
    "rescinded_by": "Rescinded By",
    "linked_amends": "Amends (Linked)",
    "linked_amended_by": "Amended By (Linked)",
    "linked_enacted_by": "Enacted By (Linked)",
    "linked_rescinds": "Rescinds (Linked)",
    "linked_rescinded_by": "Rescinded By (Linked)",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def mapped(c: str | Column, labels: dict[str, str]) -> Column:
    """The label of a code; other values pass through, null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    out = c
    for code, label in labels.items():
        out = F.when(c == code, label).otherwise(out)
    return out


def law_status(c: str | Column) -> Column:
    return mapped(c, LAW_STATUS)


def edge_type_label(c: str | Column) -> Column:
    return mapped(c, EDGE_TYPES)


def register(spark: SparkSession) -> None:
    """Make the two label functions callable from SQL; Catalyst inlines their bodies."""
    for name, labels in (("law_status", LAW_STATUS), ("edge_type_label", EDGE_TYPES)):
        cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(code STRING) RETURNS STRING RETURN CASE code {cases} ELSE code END")


def sort_key(c: str | Column) -> Column:
    """A provision number as ``ddd.ddd.ddd``, so that strings sort in document order: ZA..ZZ before A..Z, both after the bare number."""
    s = F.upper(F.trim(c))
    base = F.regexp_extract(s, r"^(\d*)", 1)
    first = F.regexp_extract(s, r"^\d*(Z[A-Z]|[A-Z])?", 1)
    second = F.regexp_extract(s, r"^\d*(?:Z[A-Z]|[A-Z])(Z[A-Z]|[A-Z])?", 1)

    def segment(group: Column) -> Column:
        letter = F.ascii(F.substring(group, -1, 1)) - 64
        return F.when(group == "", 0).when(F.length(group) == 2, letter).otherwise(letter * 10)

    number = F.when(F.length(base) > 9, 0).otherwise(F.expr("0") + F.coalesce(base.try_cast("int"), F.lit(0)))
    padded = [F.when(F.length(x.cast("string")) >= 3, x.cast("string")).otherwise(F.lpad(x.cast("string"), 3, "0")) for x in (number, segment(first), segment(second))]
    return F.concat_ws(".", *padded)


def with_extent(key: str | Column, extent: str | Column) -> Column:
    """A sort key and a territorial extent, parted by ``~``."""
    key, extent = (F.col(x) if isinstance(x, str) else x for x in (key, extent))
    return F.concat(key, F.lit("~"), extent)


def clean(c: str | Column) -> Column:
    """Text without markup, entities, doubled white space, typographic quotes and dashes, and leading paragraph numbers."""
    s = F.regexp_replace(c, r"<[^>]+>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"&[a-z]+;", " "), r"&#\d+;", " ")
    s = F.regexp_replace(F.translate(s, "   ", "   "), r"(?U)\s+", " ")
    s = F.translate(s, "‘’“”–—", "''\"\"--")
    # Fixed value: the numbering that may stand before a provision's words.
    s = F.regexp_replace(s, r"^\s*(?:\d+[a-z]?\s*\.?\s*)?-?\s*(?:\[F\d+\s*]?\s*)?-?\s*(?:\d+[a-z]?\s*\.?\s*)?(?:\(\d+[a-z]?\)\s*\.?\s*)?", "")
    return F.trim(s)


def provision_of_article(c: str | Column) -> Column:
    """The last part of an article name after ``-`` or ``/``; null if there is none."""
    last = F.element_at(F.split(c, "[-/]"), -1)
    return F.when(last != "", last)


def law_of_section(c: str | Column) -> Column:
    """The law of a section_id ``law:section``."""
    return F.split_part(c, F.lit(":"), F.lit(1))


def commencement_date(c: str | Column) -> Column:
    """The ISO date in text on coming into force or ceasing to have effect: day month year, or the first of a month; else null."""
    low = F.lower(c)
    month = "|".join(MONTHS)
    day = lambda k: F.regexp_extract(low, rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({month})\s+(\d{{4}})", k)
    only = lambda k: F.regexp_extract(low, rf"({month})\s+(\d{{4}})", k)
    number = lambda name: F.lpad(F.array_position(F.lit(list(MONTHS)), name).cast("string"), 2, "0")
    told = low.rlike(r"comes? into (?:force|operation)|coming into (?:force|operation)|cease[sd]? to have effect")
    full = F.concat_ws("-", day(3), number(day(2)), F.lpad(day(1), 2, "0"))
    return F.when(told & (day(3) != ""), full).when(told & (only(2) != ""), F.concat_ws("-", only(2), number(only(1)), F.lit("01")))


def log_score(total: Column, n: Column) -> Column:
    """Mean times the binary logarithm of the count and one."""
    return total / n * F.log2(n + F.lit(1))


def metres(c: str | Column) -> Column:
    """A height in text, in metres: feet are 0.3048 m; null where no unit is named."""
    low = F.lower(c)
    m = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:m|metres?|meters?)\b", 1)
    ft = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:ft|feet|foot)\b", 1)
    return F.when(m != "", m.try_cast("double")).when(ft != "", ft.try_cast("double") * 0.3048)


def volts(c: str | Column) -> Column:
    """A voltage in text, in volts."""
    low = F.lower(c)
    kv = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*kv\b", 1)
    v = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:v|volts?)\b", 1)
    return F.when(kv != "", kv.try_cast("double") * 1000).when(v != "", v.try_cast("double"))


def kmh(c: str | Column) -> Column:
    """A speed in text, in kilometres an hour; a mile is 1.609 km."""
    low = F.lower(c)
    mph = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*mph\b", 1)
    k = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:km/h|kmh|kph)\b", 1)
    return F.when(mph != "", mph.try_cast("double") * 1.609).when(k != "", k.try_cast("double"))


def literal(value: str) -> str:
    """A SQL string literal; parameters of ``spark.sql`` are the better way where they are allowed."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
