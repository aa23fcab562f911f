"""The engine's tables, bound to the driver's: one SELECT for each, in SQL that Spark and the oracle both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCES = (
    ("section", "Every employer shall ensure, so far as is reasonably practicable, the health and safety of employees."),
    ("section", "The Secretary of State may by order appoint an inspector for the purposes of this Act."),
    ("heading", "Application"),
    ("section", "These Regulations may be cited as the Example Regulations 2024 and shall come into force on 1st April 2024."),
    ("section", "In this Act premises means any place and includes any vehicle or vessel."),
    ("section", "A person guilty of an offence shall be liable on summary conviction to a fine."),
    ("article", "Nothing in this section shall affect any right of appeal to the tribunal."),
    ("section", "The words in paragraph 3 shall be inserted after the definition of waste."),
    ("section", "This Act does not extend to Northern Ireland."),
    ("section", "The operator must keep a record of every inspection and notify the Agency of any hazard."),
    ("schedule", "Repeals and revocations"),
    ("section", "The authority shall be treated as a local authority for these purposes."),
    ("section", "Fees payable under this regulation may not exceed the cost of the assessment."),
    ("section", "The Regulations impose duties on employers to protect employees at a height of 4 metres."),
    ("section", "A supervisor should review the risk assessment at least once every two years."),
    ("section", "The policy is to be supplied in writing; training and competence are recorded."),
    ("section", "No person shall enter a confined space unless a permit has been issued, see JSP 375 Chapter 8."),
    ("paragraph", "It is a defence for a person to prove that the transitional provision applied until 3 May 2023 when it ceased to have effect."),
)

#: Parts of a clause that each document has besides: their numbers have no common divisor, so all combinations come up.
SUBJECTS = ("The employer", "The operator", "A local authority", "The Secretary of State", "A responsible person", "The inspector", "Every person who works there")
VERBS = ("shall", "must", "may", "shall not", "should")
ACTIONS = (
    "ensure the health and safety of employees",
    "carry out an assessment of the risks",
    "provide information to the public",
    "keep a record of each inspection",
    "notify the enforcing authority in writing",
    "provide training and instruction",
    "pay the fee for the licence",
    "review the risk assessment at least once every 5 years",
)
TAILS = (
    "",
    ", so far as is reasonably practicable",
    " unless a permit has been issued",
    " within 28 days",
    " where the dwelling is at a height of 3 metres",
    ", see JSP 440 Chapter 3",
    " and measures must be suitable and sufficient",
    ", but this section does not apply to a dwelling",
    " when it comes into force on 3 May 2023",
)

_quoted = lambda texts: ", ".join("({}, '{}')".format(i, t) for i, t in enumerate(texts))
_TEXTS = ", ".join("({}, '{}', '{}')".format(i, kind, text.replace("'", "''")) for i, (kind, text) in enumerate(SENTENCES))
_N = len(SENTENCES)

BOUND = {
    "laws": """SELECT concat('L', CAST(o_orderkey AS STRING)) AS name, year(o_orderdate) AS year, o_orderkey AS number,
        CASE o_orderstatus WHEN 'F' THEN 'in_force' WHEN 'O' THEN 'draft' WHEN 'P' THEN 'repealed' ELSE o_orderstatus END AS status,
        o_orderpriority AS family, concat('C', CAST(o_custkey AS STRING)) AS owner, o_totalprice AS price FROM orders""",
    "edges": """SELECT DISTINCT concat('S', CAST(l_suppkey AS STRING)) AS source_name, concat('P', CAST(l_partkey AS STRING)) AS target_name,
        CASE l_returnflag WHEN 'A' THEN 'amends' WHEN 'R' THEN 'rescinds' ELSE 'enacted_by' END AS edge_type FROM lineitem""",
    "provisions": """SELECT concat('L', CAST(l_orderkey AS STRING)) AS law_name, concat('L', CAST(l_orderkey AS STRING), ':s.', CAST(l_linenumber AS STRING)) AS section_id,
        lpad(CAST(l_linenumber AS STRING), 3, '0') AS sort_key, CASE WHEN l_returnflag = 'R' THEN 'part' ELSE 'section' END AS section_type,
        CASE WHEN l_quantity >= 34 THEN 'HIGH' WHEN l_quantity >= 17 THEN 'MEDIUM' ELSE 'LOW' END AS gravity,
        CASE WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.03 THEN 'MEDIUM' WHEN l_discount >= 0.01 THEN 'LOW' END AS scope_duty_bearer,
        CASE WHEN l_tax >= 0.05 THEN 'HIGH' WHEN l_tax >= 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS scope_protected_class,
        CASE WHEN l_linestatus = 'O' THEN 'HIGH' ELSE 'LOW' END AS strength,
        CASE WHEN l_linenumber <= 2 THEN 'HIGH' WHEN l_linenumber <= 4 THEN 'MEDIUM' WHEN l_linenumber <= 6 THEN 'LOW' END AS hierarchy,
        l_partkey AS part_number, l_suppkey AS supplier, l_linenumber AS line, l_quantity AS quantity, l_returnflag AS flag FROM lineitem""",
    "actors": """SELECT event_id AS section_id, user_id AS actor, concat('Org: ', event_type) AS actor_label,
        CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'counterparty' WHEN 2 THEN 'beneficiary' WHEN 3 THEN 'mentioned' END AS regex_pos,
        CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'counterparty' END AS cls_pos,
        CAST(CASE event_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.69 WHEN 2 THEN 0.95 ELSE 0.5 END AS FLOAT) AS cls_conf,
        CASE WHEN event_id % 17 = 0 THEN 'active' END AS inferred_pos,
        CASE WHEN event_id % 7 = 0 THEN 'mentioned' END AS slm_pos,
        CAST(CASE event_id % 2 WHEN 0 THEN 0.9 ELSE 0.89 END AS FLOAT) AS slm_conf,
        CASE WHEN event_id % 23 = 0 THEN 'beneficiary' END AS llm_pos FROM events""",
    "sections": """SELECT concat('U', CAST(user_id AS STRING)) AS law_name, CAST(event_id AS STRING) AS section_id, lpad(CAST(event_id AS STRING), 12, '0') AS sort_key,
        CASE WHEN event_type = 'signup' THEN 'part' ELSE 'section' END AS section_type, event_id AS number, ts,
        CASE WHEN event_id % 3 = 0 THEN NULL WHEN value >= 100 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS rating FROM events""",
    # A provision is a document's whole text, with a sentence and a clause before or after it.
    "texts": f"""SELECT d.doc_id, d.lang, d.source, t.section_type, CASE WHEN d.doc_id % 2 = 0 THEN concat(t.sentence, ' ', a.x, ' ', b.x, ' ', c.x, e.x, '. ', coalesce(d.text, ''))
          ELSE concat(coalesce(d.text, ''), ' ', t.sentence, ' ', a.x, ' ', b.x, ' ', c.x, e.x, '.') END AS sentence
        FROM documents d JOIN (VALUES {_TEXTS}) AS t(k, section_type, sentence) ON d.doc_id % {_N} = t.k JOIN (VALUES {_quoted(SUBJECTS)}) AS a(k, x) ON d.doc_id % {len(SUBJECTS)} = a.k
        JOIN (VALUES {_quoted(VERBS)}) AS b(k, x) ON d.doc_id % {len(VERBS)} = b.k JOIN (VALUES {_quoted(ACTIONS)}) AS c(k, x) ON d.doc_id % {len(ACTIONS)} = c.k
        JOIN (VALUES {_quoted(TAILS)}) AS e(k, x) ON d.doc_id % {len(TAILS)} = e.k""",
    "narratives": """SELECT event_id AS id, concat('site', CAST(user_id % 12 AS STRING)) AS site, event_type AS report_type, ts,
        CASE event_id % 12 WHEN 0 THEN 'speaks-up-to' WHEN 1 THEN 'cooperates-with' WHEN 2 THEN 'shares-information-with' WHEN 3 THEN 'directs'
            WHEN 4 THEN 'monitors' WHEN 5 THEN 'normalises' WHEN 6 THEN 'adapts-to' WHEN 7 THEN 'cares-for' WHEN 8 THEN 'responds-to-failure-of'
            WHEN 9 THEN 'protects' WHEN 10 THEN 'learns-from' ELSE 'recognises' END AS edge_type,
        CASE WHEN value > 50 THEN 1 ELSE 0 END AS cultural, event_id % 4 AS n_edges FROM events""",
    "metadata": """SELECT concat('L', CAST(o_orderkey AS STRING)) AS name,
        CASE o_orderkey % 7 WHEN 0 THEN 'The Example (Commencement No. 2) Order' WHEN 1 THEN 'The Example (Amendment) (Revocation) Regulations'
            WHEN 2 THEN 'The Example Act' WHEN 3 THEN 'The Example (Appointed Day) Order' WHEN 4 THEN 'The Waste (Transitional Provisions) Order' END AS title,
        CASE o_orderkey % 5 WHEN 0 THEN 'An Act to make provision for securing the health of persons at work' WHEN 1 THEN 'Regulations to amend the 1974 Act'
            WHEN 2 THEN 'An Act to require notices and to prohibit waste' WHEN 3 THEN '' END AS description,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 90 AS INT) END AS body_paras, CAST(o_orderkey % 130 AS INT) AS schedule_paras FROM orders""",
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's tables over a folder of the driver's."""
    sql = BOUND[name]
    tables = [t for t in ("orders", "lineitem", "events", "documents") if f" {t}" in sql]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def oracle(sql: str, *names: str) -> str:
    """The SQL with the named tables before it."""
    ddl = ", ".join("{} AS ({})".format(n, BOUND[n].replace("AS STRING", "AS VARCHAR")) for n in names)
    # A query with tables of its own goes on after a comma.
    return f"WITH {ddl} {sql}" if names else sql
