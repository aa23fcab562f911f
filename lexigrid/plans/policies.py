"""Policy documents: citations of laws, roles, gaps in what is referred to, controls and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import actors, obligations, policy, taxa
from lexigrid.functions.dictionary import NO_ROLES, ROLE_NAMES

# Words of a citation that say nothing.
STOPWORDS = ("the", "of", "and", "at", "in", "to", "for", "etc", "etc.")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def citation_keywords(citation: str | Column) -> Column:
    """struct<keywords, year> of a law's citation: its significant words in lower case, without numbers; null without a year or a word."""
    citation = _c(citation)
    year = F.regexp_extract(citation, r"\b(\d{4})\b", 1).try_cast("int")
    words = F.transform(F.split(citation, r"(?U)[\s,()]"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    kept = F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOPWORDS) & ~w.rlike(r"^\d+$"))
    return F.when(year.isNotNull() & (F.size(kept) > 0), F.struct(kept.alias("keywords"), year.alias("year")))


def clean_roles(rows: DataFrame, of: str, role: str, kind: str) -> DataFrame:
    """(of, role, kind) without labels that are no roles, under the dictionary's names, each once."""
    name = F.coalesce(F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))[F.col(role)], F.col(role))
    return rows.where(~F.col(role).isin(*NO_ROLES)).select(of, name.alias(role), kind).distinct()


def gaps(references: DataFrame) -> DataFrame:
    """(source, law, n_references, n_sections) of resolved references (source, target, resolved): how often each law is referred to, and how many of its sections."""
    law = F.split_part("target", F.lit(":"), F.lit(1))
    section = F.when(F.col("target").contains(":"), F.col("target"))
    return references.where("resolved").groupBy("source", law.alias("law")).agg(F.count("*").alias("n_references"), F.countDistinct(section).alias("n_sections"))


def controls(artefacts: DataFrame, held: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each artefact with a control as JSON: all its columns, and the duties (``columns`` of ``held``) that ask for it, with their multiplicity."""
    grouped = held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("duties"))
    joined = artefacts.join(grouped, key, "left").withColumn("duties", F.coalesce("duties", F.array().cast(grouped.schema["duties"].dataType)))
    return joined.withColumn("control", F.to_json(F.struct(*artefacts.columns, "duties"))).drop("duties")


def without(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of keys that nothing is stored for."""
    return rows.join(stored.select(key).where(F.col(key).isNotNull()), key, "left_anti")


ARTEFACT = "struct<artefact_type:string,artefact_class:string,source:string,likelihood_ratio:string,title:string,what_it_proves:string>"
EVIDENCE = f"artefacts array<{ARTEFACT}>, judgement struct<needs_judgement:boolean,judgement_rationale:string,drift_conditions:string,recommended_method:string,basis_guidance:string,discriminating_question:string,drift_signal:string>, strategy struct<voi_quadrant:string,evidence_standard:string,staleness_tolerance:string,voi_rationale:string,recommended_interval:string,nature_strategy:string>"
CONTROL = "blast_radius string, info_distance string, nature string, load_bearing_judgement string"


def evidence_flags(evidence: str | Column, control: str | Column, enums: dict[str, tuple[str, ...]]) -> Column:
    """Flags of an evidence pattern (JSON) for a control (JSON): kinds outside ``enums``, empty fields, and parts that contradict each other."""
    e, c = F.from_json(_c(evidence), EVIDENCE), F.from_json(_c(control), CONTROL)
    judged, plan = e["judgement"], e["strategy"]
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    every = F.coalesce(e["artefacts"], F.array().cast(f"array<{ARTEFACT}>"))
    bad = lambda x, name: ~F.coalesce(x.isin(*enums[name]), F.lit(False))

    def of_artefact(a: Column) -> Column:
        found = [F.when(bad(a[f], f), f"INVALID_ENUM: {f}") for f in ("artefact_type", "artefact_class", "source", "likelihood_ratio") if f in enums]
        found.append(F.when((a["artefact_class"] == "Activity") & (a["likelihood_ratio"] == "High"), "CONSISTENCY: likelihood_ratio"))
        return F.array(*found, *(F.when(blank(a[f]), f"MISSING_FIELD: {f}") for f in ("title", "what_it_proves")))

    needs = F.coalesce(judged["needs_judgement"], F.lit(False))
    far = c["info_distance"] == "Remote"
    one = [
        F.when(~F.exists(every, lambda a: F.coalesce(a["artefact_class"] == "Outcome", F.lit(False))), "NO_TYPE_B"),
        *(F.when(blank(judged[f]), f"MISSING_FIELD: {f}") for f in ("judgement_rationale", "drift_conditions")),
        *([F.when(needs & bad(judged["recommended_method"], "recommended_method"), "INVALID_ENUM: recommended_method")] if "recommended_method" in enums else []),
        *(F.when(needs & blank(judged[f]), f"MISSING_FIELD: {f}") for f in ("basis_guidance", "discriminating_question", "drift_signal")),
        F.when(~blank(c["load_bearing_judgement"]) & ~needs, "CONSISTENCY: load_bearing_judgement"),
        *(F.when(bad(plan[f], f), f"INVALID_ENUM: {f}") for f in ("voi_quadrant", "evidence_standard", "staleness_tolerance") if f in enums),
        *(F.when(blank(plan[f]), f"MISSING_FIELD: {f}") for f in ("voi_rationale", "recommended_interval", "nature_strategy")),
        F.when((c["blast_radius"] == "Enterprise") & (c["nature"] == "Manual") & (plan["voi_quadrant"] == "Table Stakes"), "CONSISTENCY: voi_quadrant"),
        F.when((c["blast_radius"] == "Enterprise") & (plan["evidence_standard"] == "Basic"), "CONSISTENCY: evidence_standard"),
        F.when(far & c["blast_radius"].isin("Site", "Enterprise") & (plan["staleness_tolerance"] == "High"), "CONSISTENCY: staleness_tolerance"),
    ]
    flags = F.concat(F.array(F.when(F.size(every) == 0, "NO_ARTEFACTS")), F.flatten(F.transform(every, of_artefact)), F.array(*one))
    return F.filter(flags, lambda x: x.isNotNull())


def enriched(df: DataFrame, text: str) -> DataFrame:
    """Policy provisions with roles, modal, artefacts, references, terms and obligations: all that their documents are searched for."""
    return df.withColumns(
        {
            "roles": actors.policy_actors(text),
            "modal": taxa.modal(text),
            "artefacts": policy.artefacts(text),
            "references": policy.references(text),
            "terms": obligations.terms(F.col(text)),
            "obligations": obligations.obligations(F.col(text)),
        }
    )
