"""Queries of mentions, leads and anchors over whole documents, pages, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import checks as v
from attestry.operators import mentions as m
from attestry.plans.fixtures import plain, sql

def _values(rows: list[tuple], alias: str, columns: str) -> str:
    row = lambda i, w, ok: f"({i}, '" + w.replace("'", "''") + f"', {str(ok).lower()})"
    return "(VALUES " + ", ".join(row(i, w, ok) for i, (w, ok) in enumerate(rows)) + f") AS {alias}({columns})"


#: What stands before and after a name, and whether it leaves the name whole. By kind of name: a person, a company with a legal suffix, one without.
PERSON_BEFORE = [("", True), ("With ", True), ("Mr ", True), ("Anna ", False), ("Jean de ", False), ("Profile de ", True), ("Our president ", True), ("Anna president ", False), ("Dr. ", True)]
PERSON_AFTER = [(" said", True), (" Smith", False), (" Mr", True), (" Last updated", True), ("'s shop", True), (", Smith", True), (" de Villiers", False), (" de retour", True), ("-Smith", False), ("-CEO", True), (" and", True)]
COMPANY_BEFORE = [("", True), ("At ", True), ("Mega ", False), ("The Group ", True), ("Mega The Group ", False), ("filiale de ", True), ("Mega de ", False), ("Non-", False)]
COMPANY_AFTER = [(" announces", True), (" Group", False), (" et fils", False), (" County", False), (" county", True), (" & Co", False), ("-Nord", False), (", Paris", True), ("", True)]
ALIAS_AFTER = [(" announces", True), (" Inc", False), (" county", False), (" works employs people", False), (" works Ltd", False), (" publishes results", True), (" et Fils", False), ("", True), (" / Nord", False)]
#: Whole documents, each behind three lines that mention invented names, or nearly do.
LINES = f"""
SELECT doc_id, text, concat(pb.w, 'Quorra Vell', pa.w, '.') AS l1, concat(cb.w, 'Zorptek Ltd', ca.w, '.') AS l2, concat(ab.w, 'Zorptek', aa.w, '. Text') AS l3,
  length(pb.w) AS s1, length(cb.w) AS s2, length(ab.w) AS s3, pb.ok AND pa.ok AS ok1, cb.ok AND ca.ok AS ok2, ab.ok AND aa.ok AS ok3
FROM {{documents}}
JOIN {_values(PERSON_BEFORE, "pb", "i, w, ok")} ON pb.i = doc_id % {len(PERSON_BEFORE)} JOIN {_values(PERSON_AFTER, "pa", "i, w, ok")} ON pa.i = doc_id % {len(PERSON_AFTER)}
JOIN {_values(COMPANY_BEFORE, "cb", "i, w, ok")} ON cb.i = doc_id % {len(COMPANY_BEFORE)} JOIN {_values(COMPANY_AFTER, "ca", "i, w, ok")} ON ca.i = doc_id % {len(COMPANY_AFTER)}
JOIN {_values(COMPANY_BEFORE[:7], "ab", "i, w, ok")} ON ab.i = doc_id % 7 JOIN {_values(ALIAS_AFTER, "aa", "i, w, ok")} ON aa.i = doc_id % {len(ALIAS_AFTER)}
WHERE text IS NOT NULL
"""
TEXTS = f"SELECT doc_id AS text_id, concat(l1, chr(10), l2, chr(10), l3, chr(10), text) AS text FROM ({LINES}) x"
NAMES = " UNION ALL ".join(f"SELECT {i} AS name_id, '{n}' AS name, '{k}' AS entity_type FROM {{region}} WHERE r_regionkey = 0" for i, n, k in ((1, "Quorra Vell", "person"), (2, "Zorptek Ltd", "company"), (3, "Zorptek", "company")))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mentions(sql(spark, sf_dir, NAMES), sql(spark, sf_dir, TEXTS))


def j3_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


FOUND = f"""
lines AS ({plain(LINES)}),
f AS (
  SELECT doc_id AS text_id, 1 AS name_id, s1::BIGINT AS start, 11 AS n FROM lines WHERE ok1
  UNION ALL SELECT doc_id, 2, length(l1) + 1 + s2, 11 FROM lines WHERE ok2
  UNION ALL SELECT doc_id, 3, length(l1) + 1 + length(l2) + 1 + s3, 7 FROM lines WHERE ok3)"""
J3 = "WITH " + FOUND + ' SELECT text_id, name_id, start, start + n AS "end" FROM f'


def _proofs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = sql(spark, sf_dir, TEXTS).select("text_id")
    proofs = t.select(F.col("text_id").alias("claim_id"), "text_id", F.when(F.col("text_id") % 3 == 0, 4).otherwise(0).cast("long").alias("start"), F.when(F.col("text_id") % 5 == 0, 18).otherwise(60).cast("long").alias("end"))
    return proofs, proofs.where("claim_id % 7 > 0").select("claim_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("name_id"))


def j4_require_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs, allowed = _proofs(spark, sf_dir)
    ok, bad = m.require_mention(proofs, allowed, _found(spark, sf_dir))
    return ok.select("claim_id", F.lit(True).alias("accepted")).unionByName(bad.select("claim_id", F.lit(False).alias("accepted")))


J4 = "WITH " + FOUND + """
SELECT doc_id AS claim_id, doc_id % 7 > 0 AND EXISTS (SELECT 1 FROM f WHERE text_id = doc_id AND start >= CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END AND start + n <= CASE WHEN doc_id % 5 = 0 THEN 18 ELSE 60 END) AS accepted
FROM documents WHERE text IS NOT NULL
"""


def j7_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sql(spark, sf_dir, TEXTS).select(F.col("text_id").alias("page_id"), "text")
    proofs = t.select(F.col("page_id").alias("claim_id"), "page_id")
    head = F.element_at(F.split("text", "\n"), 1)
    new = t.select(F.col("page_id").alias("claim_id"), F.when(F.col("page_id") % 4 == 1, F.concat(head, F.lit(" never"))).otherwise(F.substring(head, 1, 11)).alias("excerpt"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix"))
    return m.relocate(proofs, new, t.where("page_id % 3 > 0")).select("claim_id", "code")


def j9_reconstruct_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sql(spark, sf_dir, TEXTS).select("text_id")
    request = (F.col("text_id") / 4).cast("long")
    pages = t.select(request.alias("request_id"), F.lit("k0").alias("candidate_key"), "text_id", F.col("text_id").alias("ord")).unionByName(t.select(request.alias("request_id"), F.lit("k1").alias("candidate_key"), "text_id", (-F.col("text_id")).alias("ord")))
    c = pages.select("request_id", "candidate_key").distinct().withColumn("name_id", F.when(F.col("candidate_key") == "k0", 1).otherwise(2))
    return m.reconstruct_identity(c, c.where("request_id % 5 = 0 and candidate_key = 'k0'"), pages, _found(spark, sf_dir))


J9 = "WITH " + FOUND + """,
r AS (SELECT *, text_id // 4 AS request_id, CASE name_id WHEN 1 THEN 'k0' ELSE 'k1' END AS candidate_key FROM f WHERE name_id < 3),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id, candidate_key ORDER BY CASE name_id WHEN 1 THEN text_id ELSE -text_id END, start) AS p FROM r WHERE NOT (request_id % 5 = 0 AND name_id = 1))
SELECT request_id, candidate_key, text_id, start, start + n AS "end" FROM o WHERE p = 1
"""

LEAD_CANDIDATES = "SELECT c_custkey AS request_id, 'k0' AS candidate_key, 0 AS ord, c_name AS display_name, CASE WHEN c_custkey % 2 = 0 THEN 'Brightco' END AS employer, concat('https://www.p', cast(c_custkey % 4 AS string), '.com/', cast(c_custkey AS string)) AS url FROM {customer}"
LEAD_SOURCES = "SELECT c_custkey AS request_id, o AS ord, concat('https://', CASE o WHEN 0 THEN concat('p', cast(c_custkey % 4 AS string), '.com/other') WHEN 1 THEN 'news.net/a' WHEN 2 THEN 'brightco.org/b' ELSE 'news.net/d' END) AS url, CASE o WHEN 0 THEN 'Some words here' WHEN 1 THEN concat('About ', upper(c_name)) WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Short' ELSE 'Longer title' END ELSE 'Unrelated words' END AS title FROM {customer} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s"
LEAD_FACTS = "SELECT o_custkey AS request_id, concat('https://f', cast(o_orderkey % 3 AS string), '.com/x') AS url FROM {orders} WHERE o_orderkey % 5 = 0"


def j12_title_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.title_leads(*(sql(spark, sf_dir, q) for q in (LEAD_CANDIDATES, LEAD_FACTS, LEAD_SOURCES)))


J12 = f"""
WITH c AS ({plain(LEAD_CANDIDATES)}), s AS ({plain(LEAD_SOURCES)}), f AS ({plain(LEAD_FACTS)}), n AS (SELECT request_id, count(*) AS facts, count(DISTINCT url) AS urls FROM f GROUP BY 1),
l AS (SELECT c.request_id, least(2, greatest(3 - coalesce(facts, 0), 2 - (1 + coalesce(urls, 0)), 0)) AS lack FROM c LEFT JOIN n USING (request_id)),
t AS (SELECT s.*, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS p FROM s WHERE ord < 2 OR (ord = 2 AND request_id % 2 = 0 AND title <> 'Short'))
SELECT request_id, 'k0' AS candidate_key, url, title FROM t JOIN l USING (request_id) WHERE p <= lack
"""

ANCHOR_FACTS = "SELECT o_custkey AS request_id, o_orderkey AS fact_id, concat('https://', CASE WHEN o_orderkey % 4 = 0 THEN 'base' ELSE 'other' END, '.com/') AS url, concat('The firm ', CASE WHEN o_orderkey % 3 = 0 THEN 'makes bolts' ELSE 'has won' END) AS excerpt, o_orderkey % 7 = 0 AS supporting FROM {orders}"
ANCHOR_DECISIONS = "SELECT c_custkey AS request_id, 'Bolt Firm' AS display_name, CASE WHEN c_custkey % 2 = 0 THEN 'verified_facts' ELSE 'dedicated' END AS basis FROM {customer}"
ANCHOR_PROOFS = "SELECT c_custkey AS request_id, 'https://base.com/a' AS url, 'With bolts' AS excerpt, CASE WHEN c_custkey % 3 = 0 THEN 'and the won' END AS title FROM {customer}"


def f2_anchor_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.anchor_continuity(*(sql(spark, sf_dir, q) for q in (ANCHOR_FACTS, ANCHOR_DECISIONS, ANCHOR_PROOFS))).select("request_id", "fact_id", "continuous")


F2 = "SELECT o_custkey AS request_id, o_orderkey AS fact_id, o_custkey % 2 = 1 OR o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 AS continuous FROM orders JOIN customer ON c_custkey = o_custkey"

KNOWN = "SELECT c_custkey AS request_id, 'k0' AS candidate_key, 'Firm Nord' AS display_name, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS value FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"
ASKED = "SELECT c_custkey AS request_id, concat(lower(n_name), ', Nord; the public services | IA, artificial intelligence | https://x.com/a | ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN ', one two three four five six seven eight nine' ELSE '' END) AS context FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"


def i7_context_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.context_terms(sql(spark, sf_dir, ASKED), sql(spark, sf_dir, KNOWN))


I7 = """
SELECT c_custkey AS request_id, 'k0' AS candidate_key, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS term, CASE WHEN c_custkey % 2 = 0 THEN 'discriminator' ELSE 'fragment' END AS source FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT c_custkey, 'k0', c_mktsegment, 'fragment' FROM customer UNION ALL SELECT c_custkey, 'k0', 'IA', 'fragment' FROM customer
"""

CONTRADICTIONS = "SELECT c_custkey AS request_id, concat('c', cast(c_custkey AS string)) AS contradiction_id, c_custkey % 11 <> 0 AS visible, CASE WHEN c_custkey % 5 = 0 THEN 'difference' ELSE 'contradiction' END AS classification, c_custkey % 6 <> 0 AS nature_checked, 'metric.revenue' AS predicate, 'k0' AS subject_key FROM {customer}"
VERSIONS = "SELECT concat('c', cast(o_custkey AS string)) AS contradiction_id, cast(o_orderkey AS string) AS claim_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_orderkey % 4 AS double) END AS normalized_value, CASE WHEN o_orderkey % 17 = 0 THEN 'Units' ELSE 'million' END AS unit, 'EUR' AS currency FROM {orders}"
VERSION_CLAIMS = "SELECT cast(o_orderkey AS string) AS claim_id, CASE WHEN o_orderkey % 19 = 0 THEN 'k1' ELSE 'k0' END AS subject_key, CASE WHEN o_orderkey % 23 = 0 THEN 'metric.profit' ELSE 'METRIC.revenue' END AS predicate, CASE WHEN o_orderkey % 7 = 0 THEN 'supported' ELSE 'contested' END AS state, 'contradiction' AS reconciliation, 'display_fact' AS decision, cast(o_orderkey % 4 AS double) AS value, 'Million' AS unit FROM {orders} WHERE o_orderkey % 29 <> 0"


def v6_contradiction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sql(spark, sf_dir, CONTRADICTIONS)
    return v.contradiction_rules(c, sql(spark, sf_dir, VERSIONS), sql(spark, sf_dir, VERSION_CLAIMS), c.where("request_id % 8 > 0").select("contradiction_id"))


V6 = f"""
WITH c AS ({plain(CONTRADICTIONS)}), x AS ({plain(VERSIONS)}), k AS ({plain(VERSION_CLAIMS)}), w AS (SELECT * FROM c WHERE visible), j AS (SELECT x.*, k.subject_key, k.predicate, k.state, k.value, k.claim_id IS NOT NULL AS there FROM x LEFT JOIN k USING (claim_id)),
g AS (SELECT contradiction_id, count(*) AS n, bool_or(normalized_value IS NULL) AS odd, count(DISTINCT normalized_value) AS vals, count(DISTINCT unit) AS units, count(DISTINCT subject_key) AS subs, max(subject_key) AS sub FROM j GROUP BY 1),
d AS (SELECT w.*, coalesce(n, 0) AS n, coalesce(odd, false) AS odd, coalesce(vals, 0) AS vals, coalesce(units, 0) AS units, coalesce(subs, 0) AS subs, sub FROM w LEFT JOIN g USING (contradiction_id)), e AS (SELECT j.*, w.request_id FROM j JOIN w USING (contradiction_id)), r AS (
  SELECT request_id, 'not_presented' AS code, contradiction_id AS id FROM d WHERE request_id % 8 = 0 UNION ALL SELECT request_id, 'wrong_classification', contradiction_id FROM d WHERE classification = 'difference'
  UNION ALL SELECT request_id, 'requires_value_nature_check', contradiction_id FROM d WHERE NOT nature_checked UNION ALL SELECT request_id, unnest(['needs_two_versions', 'needs_distinct_claims']), contradiction_id FROM d WHERE n < 2
  UNION ALL SELECT request_id, 'requires_finite_numeric_values', contradiction_id FROM d WHERE odd UNION ALL SELECT request_id, 'needs_distinct_values', contradiction_id FROM d WHERE vals < 2
  UNION ALL SELECT request_id, 'requires_same_unit_currency', contradiction_id FROM d WHERE units <> 1 UNION ALL SELECT request_id, 'requires_same_resolved_subject', contradiction_id FROM d WHERE subs <> 1 OR sub <> 'k0'
  UNION ALL SELECT request_id, 'requires_contested_claim', contradiction_id || ':' || claim_id FROM e WHERE NOT there OR state <> 'contested' UNION ALL SELECT request_id, 'predicate_mismatch', contradiction_id || ':' || claim_id FROM e WHERE predicate = 'metric.profit'
  UNION ALL SELECT request_id, 'unit_mismatch', contradiction_id || ':' || claim_id FROM e WHERE there AND unit = 'Units' UNION ALL SELECT request_id, 'value_mismatch', contradiction_id || ':' || claim_id FROM e WHERE there AND normalized_value IS NULL)
SELECT request_id, 'visible_contradiction_' || code AS code, id FROM r
"""

QUERIES = {q.__name__: q for q in (j3_mentions, j4_require_mention, j7_relocate, j9_reconstruct_identity, j12_title_leads, f2_anchor_continuity, i7_context_terms, v6_contradiction_rules)}
ORACLES = {"j3_mentions": J3, "j4_require_mention": J4, "j9_reconstruct_identity": J9, "j12_title_leads": J12, "f2_anchor_continuity": F2, "i7_context_terms": I7, "v6_contradiction_rules": V6}
ORACLES["j7_relocate"] = "SELECT doc_id AS claim_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 1 THEN 'source_excerpt_missing' WHEN regexp_matches(substr(h, length(rtrim(substr(h, 1, 11))) + 1, 1), '^\\pL') THEN 'source_excerpt_missing' END AS code FROM (SELECT doc_id, split_part(t, chr(10), 1) AS h FROM (SELECT text_id AS doc_id, text AS t FROM (" + plain(TEXTS) + ") x) y) z"
