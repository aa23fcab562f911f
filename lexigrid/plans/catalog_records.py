"""Named queries over provision texts: signals, records, fitness rules, triage and its effect on laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions.dictionary import GOVERNMENT_WORDS
from lexigrid.functions import actors, decisions, dictionary, fitness, patterns, policy, records, scalars, taxa
from lexigrid.plans import applicability, coverage, making, policies, reports
from lexigrid.plans.bindings import bound
from lexigrid.plans.registry import query, read


def _says(pattern: str, text: str = "sentence") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({text}, '(?i){quoted}')"


def _listed(pairs: list[tuple[str, str]]) -> str:
    """SQL of the list of names whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{name}' END" for when, name in pairs) + "], lambda x: x IS NOT NULL)"


# Signals and decisions

_PLACE = lambda p: f"nullif(instr(lower(sentence), nullif(regexp_extract(lower(sentence), '{p}'), '')), 0)"
_FREE = f"coalesce({_PLACE(taxa.ENABLING)} < coalesce({_PLACE(taxa.OBLIGATION)}, 1000000000), false)"
_GOV = "(" + " OR ".join(f"contains(lower(sentence), '{w}')" for w in GOVERNMENT_WORDS) + ")"


def _government() -> str:
    pairs = [(f"{_says(p)}" + (f" AND {_GOV}" if needs else ""), tier, kind, c) for tier, table in (("government_1", decisions.FIRST), ("government_2", decisions.SECOND)) for kind, c, needs, p in table]
    pairs += [(f"{_GOV} AND {_says(taxa.OBLIGATION)} AND NOT free", "government_1", "Prescriptive", decisions.BLUNT_OBLIGATION), (f"{_GOV} AND free", "government_1", "Enabling", decisions.BLUNT_ENABLING)]
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN concat('{tier}/', CASE WHEN free THEN 'Enabling' ELSE '{kind}' END, '/{c}') END" for when, tier, kind, c in pairs) + "], lambda x: x IS NOT NULL)"


def _told(signals):
    return F.array_join(F.transform(signals, lambda s: F.concat_ws("/", s["tier"], s["kind"], s["confidence"].cast("string"))), "|")


@query(f"SELECT doc_id, array_to_string({_government()}, '|') AS signals FROM (SELECT *, {_FREE} AS free FROM texts)", "texts")
def government_signals(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").withColumn("gov", decisions.names_government("sentence"))
    return t.select("doc_id", _told(decisions.government("sentence", "gov")).alias("signals"))


_OFFENCES = ", ".join(f"CASE WHEN {_PLACE(p)} IS NOT NULL AND NOT coalesce({_PLACE(decisions.PENALTY)} < {_PLACE(p)}, false) THEN 'offence/Prohibitive/{c}' END" for c, p in decisions.OFFENCES)


@query(f", o AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'It is an offence for a person to dig. ' WHEN 1 THEN 'A person commits an offence if found there, and is liable to a fine. ' WHEN 2 THEN 'Any person guilty of an offence is liable on conviction. ' ELSE 'It shall be unlawful for anyone to enter. ' END, sentence) AS sentence FROM texts) SELECT doc_id, CASE WHEN {_says(decisions.PENALTY_FIRST)} THEN '' ELSE array_to_string(list_filter([{_OFFENCES}], lambda x: x IS NOT NULL), '|') END AS signals FROM o", "texts")
def offence_signals(spark, sf_dir):
    told = ("It is an offence for a person to dig. ", "A person commits an offence if found there, and is liable to a fine. ", "Any person guilty of an offence is liable on conviction. ", "It shall be unlawful for anyone to enter. ")
    lead = F.element_at(F.array(*(F.lit(x) for x in told)), (F.col("doc_id") % 4 + 1).cast("int"))
    t = bound(spark, sf_dir, "texts").withColumn("sentence", F.concat(lead, "sentence"))
    return t.select("doc_id", _told(decisions.offences("sentence")).alias("signals"))


_THINGS, _PERSONS = "|".join(records.THINGS), "|".join(records.PERSONS)
_RULES = f"""r AS (SELECT doc_id, regexp_extract_all(lower(sentence), '{records.RULE_MODAL}') AS words, string_split_regex(lower(sentence), '{records.RULE_MODAL}') AS parts FROM texts),
    w AS (SELECT doc_id, k, words[k] AS word, right(array_to_string(list_transform(generate_series(1, k), lambda i: parts[i] || CASE WHEN i < k THEN words[i] ELSE '' END), ''), 80) AS before
      FROM (SELECT *, unnest(generate_series(1, len(words))) AS k FROM r)),
    h AS (SELECT doc_id, k, word, regexp_extract(before, '(?s)^.*((?:{_THINGS}).*)$', 1) AS between FROM w)"""


@query(f", {_RULES} SELECT doc_id, CASE WHEN arg_min(word, k) IN ('may', 'entitled') THEN 'Enabling' ELSE 'ThingObligation' END AS kind FROM h WHERE between <> '' AND NOT regexp_matches(between, '{_PERSONS}') GROUP BY doc_id", "texts")
def rule_signals(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").select("doc_id", F.inline(records.rules_of_things("sentence")))
    return t.select("doc_id", "kind")


@query(f"SELECT doc_id, {_says(taxa.OBLIGATION)} AS obliges, {_says(taxa.ENABLING)} AS allows, {_FREE} AS allows_first, {_says(taxa.PROHIBITION)} AS forbids FROM texts", "texts")
def modal_families(spark, sf_dir):
    found = taxa.found
    return bound(spark, sf_dir, "texts").select("doc_id", found("sentence", taxa.OBLIGATION).alias("obliges"), found("sentence", taxa.ENABLING).alias("allows"), F.coalesce(decisions.enabling_first("sentence"), F.lit(False)).alias("allows_first"), found("sentence", taxa.PROHIBITION).alias("forbids"))


@query(
    """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'governed' WHEN 1 THEN 'government_1' WHEN 2 THEN 'government_2' WHEN 3 THEN 'offence' ELSE 'rule' END AS tier, user_id, event_type AS kind, ((event_id % 7) / 10)::DOUBLE AS confidence,
      CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END AS rank FROM events)
    SELECT user_id, 'tier_priority' AS reason, arg_max(tier, (-rank, confidence, event_id)) AS tier, arg_max(kind, (-rank, confidence, event_id)) AS kind, max(confidence) FILTER (WHERE rank = least_rank) AS confidence, count(*)::INT AS n_candidates
    FROM (SELECT *, min(rank) OVER (PARTITION BY user_id) AS least_rank FROM s) GROUP BY user_id"""
)
def decided_signals(spark, sf_dir):
    k = F.col("event_id")
    tier = F.element_at(F.lit(list(decisions.TIERS)), (k % 5 + 1).cast("int"))
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.struct(tier.alias("tier"), F.col("event_type").alias("kind"), (k % 7 / 10).alias("confidence")).alias("s"))
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "s"))), lambda x: x["s"]).alias("signals"))
    d = g.select("user_id", decisions.decide(F.lit("A short text"), F.col("signals").cast(decisions.SIGNAL), F.lit(False)).alias("d"))
    return d.select("user_id", "d.reason", "d.tier", "d.kind", "d.confidence", "d.n_candidates")


# Records


@query()
def provision_record(spark, sf_dir):
    r = records.record(bound(spark, sf_dir, "texts"), "sentence")
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["label"], x["position"])), "|")
    return r.select("doc_id", F.array_join("purposes", "|").alias("purposes"), "decision.reason", "decision.tier", "decision.kind", F.col("duty.actor").alias("actor"), "clause", F.col("clause_parts.modal").alias("modal"), "clause_confidence", F.array_join("categories", "|").alias("categories"), named("positions").alias("positions"), F.size("fitness").alias("n_rules"))


@query()
def decision_trails(spark, sf_dir):
    r = records.record(bound(spark, sf_dir, "texts"), "sentence")
    return r.select("doc_id", records.trail().alias("trail"))


@query(
    """, a AS (SELECT event_id, value, event_id % 150 AS place FROM events)
    SELECT event_id, array_to_string(list_filter(['Org: Employer=' || CASE WHEN place <= 53 AND place + 11 >= 50 OR NOT (place <= 53 AND place + 11 >= 50 OR 100 <= 53 AND 100 + 12 >= 50) THEN 'active' ELSE 'counterparty' END,
      'Gvt: Minister=counterparty'], lambda x: x IS NOT NULL), '|') AS positions FROM a""".replace(", a AS", "WITH a AS", 1)
)
def actor_positions(spark, sf_dir):
    k = F.col("event_id")
    actor = lambda label, word, at: F.struct(F.lit(label).alias("label"), F.lit(word).alias("keyword"), at.cast("int").alias("offset"))
    found = F.struct(F.array(actor("Org: Employer", "employer", k % 150)).alias("governed"), F.array(actor("Gvt: Minister", "the minister", F.lit(100))).alias("government"))
    duty = F.struct(F.lit(50).alias("actor_start"), F.lit(60).alias("modal_start"))
    e = read(spark, sf_dir, "events").select("event_id", records.positions(found, duty).alias("p"))
    return e.select("event_id", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["label"], x["position"])), "|").alias("positions"))


# Fitness

_ONE = lambda t: f"CASE WHEN {_says(applicability.DISAPPLIES, t)} THEN 'DisappliesTo' WHEN {_says(applicability.EXTENDS, t)} THEN 'ExtendsTo' WHEN {' OR '.join(_says(p, t) for p in (applicability.APPLIES, applicability.SUBJECT_TO, applicability.ACTIVITY, applicability.COMMENCES))} THEN 'AppliesTo' END"
_SPLIT = f"""f AS (SELECT doc_id, trim(sentence) AS s, instr(trim(sentence), regexp_extract(trim(sentence), '(?i){fitness.TURNS}')) AS place, regexp_matches(trim(sentence), '(?i){fitness.TURNS}') AS turns FROM texts),
    h AS (SELECT *, CASE WHEN turns THEN left(s, place - 1) ELSE '' END AS a, CASE WHEN turns THEN substr(s, place) ELSE '' END AS b FROM f),
    p AS (SELECT *, {_ONE('a')} AS pa, {_ONE('b')} AS pb, {_ONE('s')} AS ps FROM h),
    q AS (SELECT *, coalesce({_says(applicability.DISAPPLIES, 's')} AND {_says(applicability.APPLIES, 's')} AND turns AND pa <> pb, false) AS two FROM p),
    rules AS (SELECT doc_id, 0 AS part, CASE WHEN two THEN pa ELSE ps END AS polarity, CASE WHEN two THEN a ELSE s END AS t FROM q WHERE two OR ps IS NOT NULL UNION ALL SELECT doc_id, 1, pb, b FROM q WHERE two)"""
_TAGS = _listed([(_says(rf"\b{p}\b", "t"), f"{dim}: {term}") for dim, fam, p, term in fitness.DICTIONARY if not fam])


@query(f", {_SPLIT} SELECT doc_id, part, polarity, length(trim(t)) AS n, array_to_string(regexp_extract_all(t, '(?i){policy.CROSS_REFERENCE}'), '|') AS refs FROM rules", "texts")
def fitness_rules(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").select("doc_id", F.posexplode(fitness.rules("sentence")).alias("part", "r"))
    return t.select("doc_id", "part", "r.polarity", F.length("r.text").cast("long").alias("n"), F.array_join("r.references", "|").alias("refs"))


@query(f", {_SPLIT} SELECT doc_id, part, array_to_string(list_distinct({_TAGS}), '|') AS tags FROM rules".replace("list_distinct(", "("), "texts")
def fitness_tags(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").select("doc_id", F.posexplode(fitness.rules("sentence")).alias("part", "r"))
    return t.select("doc_id", "part", F.array_join(F.transform("r.tags", lambda x: F.concat_ws(": ", x["dimension"], x["term"])), "|").alias("tags"))


_TERMS = list(dict.fromkeys((dim, term) for dim, fam, _, term in fitness.DICTIONARY))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{t}', {i})" for i, (d, t) in enumerate(_TERMS)) + ") AS t(dimension, term, place)")
def fitness_terms(spark, sf_dir):
    return fitness.terms(spark, "OH&S: Offshore")


@query(f", {_SPLIT}, l AS (SELECT rules.*, {_TAGS} AS tags, source FROM rules JOIN texts ON rules.doc_id = texts.doc_id) SELECT source, count(*) AS n_rules, count(*) FILTER (WHERE len(tags) = 0) AS n_gaps, count(*) FILTER (WHERE len(regexp_extract_all(t, '(?i){policy.CROSS_REFERENCE}')) > 0) AS n_with_references, count(DISTINCT polarity) AS n_polarities FROM l GROUP BY source", "texts")
def fitness_audit(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").select("source", F.inline(fitness.rules("sentence")))
    return coverage.rule_audit(t, "source")


@query(f", {_SPLIT}, l AS (SELECT unnest({_TAGS}) AS tag FROM rules), d AS (SELECT concat(dimension, ': ', term) AS tag FROM (VALUES " + ", ".join(f"('{d}', '{t}')" for d, t in dict.fromkeys((d, t) for d, f, _, t in fitness.DICTIONARY if not f)) + ") AS t(dimension, term)) SELECT d.tag, count(l.tag) AS n FROM d LEFT JOIN l ON d.tag = l.tag GROUP BY d.tag", "texts")
def fitness_term_hits(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").select(F.inline(fitness.rules("sentence"))).select(F.inline("tags"))
    hits = coverage.term_hits(fitness.terms(spark), t)
    return hits.select(F.concat_ws(": ", "dimension", "term").alias("tag"), "n")


@query(
    """, m AS (SELECT user_id, event_id, event_type, event_id % 5 = 0 AS off, CAST(ts AS DATE)::VARCHAR AS day FROM events),
    n AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN 'activity' WHEN event_type = 'signup' THEN 'personal' ELSE 'material' END AS dimension FROM m),
    j AS (SELECT *, concat('{"op":"Match","dimension":"', dimension, '","codes":["', event_type, '"],"match_op":"AnyOf"}') AS node,
      concat('{"op":"TimeWindow","from":', CASE WHEN off THEN 'null' ELSE '"' || day || '"' END, ',"to":', CASE WHEN off THEN '"' || day || '"' ELSE 'null' END, '}') AS win FROM n),
    l AS (SELECT user_id, list(node ORDER BY event_id) FILTER (WHERE NOT off) AS yes, list(DISTINCT event_type) FILTER (WHERE NOT off) AS have, list(win ORDER BY event_id) AS wins FROM j GROUP BY 1),
    k AS (SELECT l.user_id, list(node ORDER BY event_id) FILTER (WHERE off AND NOT list_contains(coalesce(have, []), event_type)) AS no FROM j JOIN l ON j.user_id = l.user_id GROUP BY 1),
    t AS (SELECT l.user_id, list_concat(CASE WHEN yes IS NULL THEN [] WHEN len(yes) = 1 THEN yes ELSE ['{"op":"Or","children":[' || array_to_string(yes, ',') || ']}'] END,
      list_concat(CASE WHEN yes IS NULL OR no IS NULL THEN [] ELSE ['{"op":"Not","child":' || CASE WHEN len(no) = 1 THEN no[1] ELSE '{"op":"Or","children":[' || array_to_string(no, ',') || ']}' END || '}'] END, wins)) AS top FROM l JOIN k ON l.user_id = k.user_id)
    SELECT concat('U', CAST(user_id AS VARCHAR)) AS law_name, CASE WHEN len(top) = 1 THEN top[1] ELSE '{"op":"And","children":[' || array_to_string(top, ',') || ']}' END AS tree FROM t""".replace(", m AS", "WITH m AS", 1)
)
def compiled_applicability(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    polarity = F.when(F.col("event_id") % 5 == 0, "DisappliesTo").otherwise("AppliesTo")
    rows = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("law_name"), F.col("event_id").alias("id"), polarity.alias("polarity"), F.array("event_type", F.date_format("ts", "yyyy-MM-dd")).alias("entities"))
    return applicability.compile_laws(rows, {"click": "activity", "purchase": "activity", "signup": "personal"})


# Triage of laws by their provisions

_OWN = "(SELECT *, CASE WHEN len(raw) = 0 THEN ['Unclassified'] ELSE raw END AS own FROM (SELECT *, {raw} AS raw FROM texts))"
_RAW = _listed([(_says(p.replace(r"\p{Punct}", "[:punct:]")), n) for n, p in patterns.PURPOSES])


def _triaged(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").withColumn("own", taxa.purposes("sentence")).withColumn("actor", F.col("sentence").rlike("[Ee]mployer|Secretary of State"))
    return coverage.triage(t, "source", "sentence", "own", "actor")


_TRIAGE = f"""SELECT source, count(*) AS n_total, count(*) FILTER (WHERE own[1] = 'Process+Rule+Constraint+Condition') AS n_process_rule, count(*) FILTER (WHERE list_contains(own, 'Amendment')) AS n_amendment,
    count(*) FILTER (WHERE list_contains(own, 'Enactment+Citation+Commencement')) AS n_enactment, count(*) FILTER (WHERE list_contains(own, 'Interpretation+Definition')) AS n_interpretation,
    count(*) FILTER (WHERE regexp_matches(sentence, '[Ee]mployer|Secretary of State')) AS n_actor, count(*) FILTER (WHERE {_says(taxa.OBLIGATION)}) AS n_obligation, count(*) FILTER (WHERE {_says(taxa.ENABLING)}) AS n_enabling
    FROM {_OWN.format(raw=_RAW)} GROUP BY source"""


@query(_TRIAGE, "texts")
def triage_counts(spark, sf_dir):
    return _triaged(spark, sf_dir)


def _folded(steps: list[tuple[str, str, bool, float]], table: str, keep: str) -> str:
    """Queries in which one step after another moves the score of a table."""
    ctes, last = [f"s0 AS (SELECT *, {making.BASE}::DOUBLE AS score FROM {table})"], "s0"
    for i, (when, c, makes, weight) in enumerate(steps, 1):
        moved = f"score + (1 - score) * {c} * {weight}" if makes else f"score * (1 - {c} * {weight})"
        ctes.append(f"s{i} AS (SELECT * REPLACE (CASE WHEN {when} THEN {moved} ELSE score END AS score) FROM {last})")
        last = f"s{i}"
    tiers = " ".join(f"+ CASE WHEN {when} THEN 1 ELSE 0 END" for when, *_ in steps)
    kind = f"CASE WHEN round(score, 4) >= {making.MAKING} THEN 'making' WHEN round(score, 4) <= {making.NOT_MAKING} THEN 'not_making' ELSE 'uncertain' END"
    return ", ".join(ctes) + f" SELECT {keep}, round(score, 4) AS score, {kind} AS class, (0 {tiers})::INT AS n_signals FROM {last}"


_W = making.WEIGHTS
_FIVE = [
    ("n_amendment / n_total > 0.60 AND n_obligation < 3", "least(0.95, 0.70 + n_amendment / n_total * 0.25)", False, _W[5]),
    ("n_total >= 10 AND n_obligation = 0", "0.85", False, _W[5]),
    ("n_obligation >= 3 AND n_obligation / n_total > 0.10 AND n_actor / n_total > 0.05", "round(least(0.95, 0.60 + n_obligation / n_total * 0.4), 2)", True, _W[5]),
    ("n_process_rule / n_total > 0.40 AND n_amendment / n_total < 0.10 AND n_total >= 5", "least(0.85, 0.50 + n_process_rule / n_total * 0.3)", True, _W[5]),
]


@query(f", c AS ({_TRIAGE}), " + _folded(_FIVE, "c", "source"), "texts")
def triaged_laws(spark, sf_dir):
    counts = _triaged(spark, sf_dir).withColumns({"title": F.lit(""), "description": F.lit(""), "body_paras": F.lit(20), "schedule_paras": F.lit(0)})
    return making.detect(counts, counts=True).select("source", "score", "class", F.size("signals").alias("n_signals"))


_HAS = lambda column, text: f"coalesce(contains({column}, '{text}'), false)"
_APPOINTED = _HAS("title", "(Appointed Day")
_META = [(_APPOINTED, "1.0", False, _W[1]), (f"NOT {_APPOINTED} AND {_HAS('title', '(Commencement')}", "0.99", False, _W[1])]
_META += [(_HAS("title", text), str(c), False, _W[tier]) for tier, text, _, c in making.TITLES]
_META += [("body_paras <= 3 AND schedule_paras > 50", "0.9", False, _W[3]), ("body_paras <= 5", "0.6", False, _W[3])]
_META += [(_HAS("lower(description)", text), str(c), False, _W[4]) for text, _, c in making.MAKES_NOT]
_META += [("body_paras > 50", "round(least(0.85, 0.50 + body_paras / 500.0), 2)", True, _W[3])]
_META += [(_HAS("lower(description)", text), str(c), True, _W[4]) for text, _, c in making.MAKES]


@query(", " + _folded(_META, "metadata", "name"), "metadata")
def making_detection(spark, sf_dir):
    return making.detect(bound(spark, sf_dir, "metadata")).select("name", "score", "class", F.size("signals").alias("n_signals"))


_HEAT = f"""(CASE WHEN {_says(taxa.HEAT_MODAL)} THEN 3 ELSE 0 END + CASE WHEN contains(lower(sentence), 'employ') THEN 2 ELSE 0 END + CASE WHEN {_says(taxa.HEAT_ENABLING)} THEN 1 ELSE 0 END + CASE WHEN contains(sentence, 'Secretary of State') THEN 1 ELSE 0 END
    + CASE WHEN list_contains(own, 'Process+Rule+Constraint+Condition') THEN 1 ELSE 0 END + CASE WHEN list_has_all(['Interpretation+Definition', 'Amendment', 'Repeal+Revocation', 'Transitional Arrangement'], own) THEN -2 ELSE 0 END + CASE WHEN octet_length(encode(sentence)) < 50 THEN -1 ELSE 0 END)::INT"""


@query(f"SELECT doc_id, {_HEAT} AS heat FROM {_OWN.format(raw=_RAW)}", "texts")
def duty_heat(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").withColumn("own", taxa.purposes("sentence"))
    return t.select("doc_id", taxa.heat("sentence", "own", F.lower("sentence").contains("employ"), F.col("sentence").contains("Secretary of State")).alias("heat"))


@query(f"SELECT doc_id, heat FROM (SELECT doc_id, {_HEAT} AS heat FROM {_OWN.format(raw=_RAW)}) WHERE heat > 0 ORDER BY heat DESC, doc_id LIMIT 100", "texts")
def missed_duties(spark, sf_dir):
    return reports.hottest(duty_heat(spark, sf_dir), "heat", "doc_id", 100)


# Policy documents

def _named(kind: str) -> str:
    sql = lambda p: p.replace("'", "''")
    pairs = [(" OR ".join(f"regexp_matches(' ' || s || ' ', '{sql(f'{actors.EDGE}(?:{p}){actors.EDGE}')}')" for p in ps), sql(label)) for label, own, _, ps in dictionary.POLICIES if own == kind and ps]
    return f"array_to_string({_listed(pairs)}, '|')"


_ROLE_TEXT = "concat(sentence, ' ', CASE doc_id % 4 WHEN 0 THEN 'The Commanding Officer is to ensure it.' WHEN 1 THEN 'Line Managers and the Accountable Person are informed.' WHEN 2 THEN 'The Defence Safety Authority may inspect.' ELSE '' END)"


@query(f"SELECT doc_id, {_named('governed')} AS governed, {_named('government')} AS government FROM (SELECT doc_id, {_ROLE_TEXT} AS s FROM texts)", "texts")
def policy_actors(spark, sf_dir):
    t = bound(spark, sf_dir, "texts").select("doc_id", F.expr(_ROLE_TEXT).alias("s")).select("doc_id", actors.policy_actors("s").alias("a"))
    labels = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), "|")
    return t.select("doc_id", labels("a.governed").alias("governed"), labels("a.government").alias("government"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'jsp=JSP 375 Volume 1, Chapter 8|legislation=Health and Safety at Work etc. Act 1974' WHEN 1 THEN 'guidance=HSG 65|standard=BS EN ISO 14001' ELSE '' END AS cited FROM events")
def citations(spark, sf_dir):
    k = F.col("event_id") % 3
    told = F.when(k == 0, "see JSP 375 Volume 1, Chapter 8; the Health and Safety at Work etc. Act 1974").when(k == 1, "as HSG 65 says, and BS EN ISO 14001").otherwise("none")
    e = read(spark, sf_dir, "events").select("event_id", policy.references(told).alias("r"))
    return e.select("event_id", F.array_join(F.transform("r", lambda x: F.concat_ws("=", x["kind"], F.regexp_replace(x["citation"], "^the ", ""))), "|").alias("cited"))


@query()
def policy_enriched(spark, sf_dir):
    t = policies.enriched(bound(spark, sf_dir, "texts").select("doc_id", "sentence"), "sentence")
    return t.select("doc_id", F.size("roles.governed").alias("n_roles"), "modal.strength", F.size("artefacts").alias("n_artefacts"), F.size("references").alias("n_references"), F.size("terms").alias("n_terms"), F.size("obligations").alias("n_obligations"))


_STOP = "['" + "', '".join(policies.STOPWORDS) + "']"


@query(
    f""", t AS (SELECT event_id, concat('the Example, (No ', CAST(event_id % 9 AS VARCHAR), ') ', event_type, ' at Work etc. Regulations ', CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(1970 + event_id % 50 AS VARCHAR) END) AS cited FROM events),
    w AS (SELECT *, list_filter(list_transform(string_split_regex(cited, '[\\s,()]'), lambda x: lower(regexp_replace(x, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g'))), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x) AND NOT regexp_matches(x, '^\\d+$')) AS words FROM t)
    SELECT event_id, array_to_string(words, ' ') AS keywords, CAST(regexp_extract(cited, '\\b(\\d{{4}})\\b', 1) AS INT) AS year FROM w WHERE regexp_matches(cited, '\\b\\d{{4}}\\b')""".replace(", t AS", "WITH t AS", 1)
)
def citation_keywords(spark, sf_dir):
    k = F.col("event_id")
    cited = F.concat(F.lit("the Example, (No "), (k % 9).cast("string"), F.lit(") "), F.col("event_type"), F.lit(" at Work etc. Regulations "), F.when(k % 6 == 0, "").otherwise((k % 50 + 1970).cast("string")))
    e = read(spark, sf_dir, "events").select("event_id", policies.citation_keywords(cited).alias("c")).where("c is not null")
    return e.select("event_id", F.array_join("c.keywords", " ").alias("keywords"), "c.year")


_NAMES = list(dictionary.ROLE_NAMES)[:20]


@query(
    f"""WITH r AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN list_extract(['{"', '".join(x.replace("'", "''") for x in dictionary.NO_ROLES)}'], CAST(event_id % {len(dictionary.NO_ROLES)} + 1 AS INT))
      WHEN 1 THEN list_extract(['{"', '".join(_NAMES)}'], CAST(event_id % {len(_NAMES)} + 1 AS INT)) ELSE 'MoD: Auditor' END AS role, CASE event_id % 2 WHEN 0 THEN 'R' ELSE 'A' END AS kind, event_id % 3 AS k FROM events),
    m AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{dictionary.ROLE_NAMES[n]}')" for n in _NAMES)}) AS t(name, role))
    SELECT DISTINCT user_id, coalesce(m.role, r.role) AS role, kind FROM r LEFT JOIN m ON r.role = m.name WHERE k <> 0"""
)
def cleaned_roles(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda names: F.element_at(F.array(*(F.lit(x) for x in names)), (k % len(names) + 1).cast("int"))
    role = F.when(k % 3 == 0, pick(list(dictionary.NO_ROLES))).when(k % 3 == 1, pick(_NAMES)).otherwise("MoD: Auditor")
    rows = read(spark, sf_dir, "events").select("user_id", role.alias("role"), F.when(k % 2 == 0, "R").otherwise("A").alias("kind"))
    return policies.clean_roles(rows, "user_id", "role", "kind")


@query("SELECT CAST(user_id AS VARCHAR) AS source, concat('L', CAST(event_id % 40 AS VARCHAR)) AS law, count(*) AS n_references, count(DISTINCT CASE WHEN event_type <> 'view' THEN CAST(event_id AS VARCHAR) END) AS n_sections FROM events WHERE event_type <> 'error' GROUP BY ALL")
def reference_gaps(spark, sf_dir):
    law = F.concat(F.lit("L"), (F.col("event_id") % 40).cast("string"))
    target = F.when(F.col("event_type") == "view", law).otherwise(F.concat(law, F.lit(":"), F.col("event_id").cast("string")))
    refs = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), target.alias("target"), (F.col("event_type") != "error").alias("resolved"))
    return policies.gaps(refs)


@query("""SELECT p_partkey AS artefact, p_name AS title, coalesce(o.n, 0) AS n_duties, coalesce(o.lines, '') AS lines FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR), '|' ORDER BY l_orderkey, l_linenumber) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) o ON l_partkey = p_partkey""")
def controls_of_artefacts(spark, sf_dir):
    artefacts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("artefact"), F.col("p_name").alias("title"))
    held = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("artefact"), "l_orderkey", "l_linenumber")
    made = policies.controls(artefacts, held, "artefact", ["l_orderkey", "l_linenumber"])
    duties_ = F.from_json(F.get_json_object("control", "$.duties"), "array<struct<l_orderkey:long,l_linenumber:int>>")
    return made.select("artefact", "title", F.size(duties_).cast("long").alias("n_duties"), F.array_join(F.transform(duties_, lambda x: F.concat_ws("/", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"))), "|").alias("lines"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CASE WHEN event_id % 3 = 0 THEN 'Outcome' WHEN event_id % 3 = 1 THEN 'Activity' ELSE 'Thing' END END AS class, CASE WHEN event_id % 2 = 0 THEN 'High' ELSE 'Low' END AS ratio, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'because' END AS why FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN class IS NULL THEN 'NO_ARTEFACTS' END, CASE WHEN class = 'Thing' THEN 'INVALID_ENUM: artefact_class' END, CASE WHEN class = 'Activity' AND ratio = 'High' THEN 'CONSISTENCY: likelihood_ratio' END,
      CASE WHEN class IS DISTINCT FROM 'Outcome' THEN 'NO_TYPE_B' END, CASE WHEN why = '' THEN 'MISSING_FIELD: judgement_rationale' END], lambda x: x IS NOT NULL), '|') AS flags FROM e""")
def evidence_flags(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "Outcome").when(k % 3 == 1, "Activity").otherwise("Thing")
    artefact = F.struct(kind.alias("artefact_class"), F.when(k % 2 == 0, "High").otherwise("Low").alias("likelihood_ratio"), F.lit("t").alias("title"), F.lit("w").alias("what_it_proves"))
    evidence = F.to_json(F.struct(F.when(k % 5 == 0, F.slice(F.array(artefact), 1, 0)).otherwise(F.array(artefact)).alias("artefacts"), F.struct(F.when(k % 7 == 0, "").otherwise("because").alias("judgement_rationale"), F.lit("x").alias("drift_conditions"), F.lit(False).alias("needs_judgement")).alias("judgement"), F.struct(F.lit("v").alias("voi_rationale"), F.lit("r").alias("recommended_interval"), F.lit("n").alias("nature_strategy")).alias("strategy")))
    flags = policies.evidence_flags(evidence, F.lit("{}"), {"artefact_class": ("Outcome", "Activity")})
    return read(spark, sf_dir, "events").select("event_id", F.array_join(flags, "|").alias("flags"))


@query("SELECT doc_id, lang AS code, CASE lang WHEN 'en' THEN 'Org: Employer' WHEN 'de' THEN 'Org: Employer' ELSE lang END AS label FROM documents")
def normalised_labels(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("code"), scalars.mapped("lang", {"en": "Org: Employer", "de": "Org: Employer"}).alias("label"))
