"""Queries of dossier assembly and validation: customers are requests, orders facts, line items their proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import assembly as a
from attestry.operators.directory import directory_role
from attestry.operators import checks as v
from attestry.plans.fixtures import plain, sql

DECISIONS = "SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'insufficient_context' WHEN 2 THEN 'not_found_within_scope' ELSE 'resolved' END AS status, CASE WHEN c_custkey % 5 > 2 THEN 'k0' END AS selected_key FROM {customer}"
CANDIDATES = "SELECT c_custkey AS request_id, o AS ord, concat('k', cast(o AS string)) AS candidate_key, (c_custkey + o) % 3 <> 0 AS eligible FROM {customer} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) s"
PROOFS = "SELECT c_custkey AS request_id, concat('k', cast(o AS string)) AS candidate_key, p AS ord, concat(c_name, ' ', cast(o AS string), cast(p AS string)) AS excerpt, concat('https://p', cast(p AS string), '.example.com/', cast(c_custkey AS string)) AS url, p = 0 AS primary_, 'source_content' AS method FROM {customer} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) s CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) t"
FACTS = """
SELECT o_custkey AS request_id, o_orderkey AS fact_id, o_orderkey AS ord, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'metric' WHEN '2' THEN 'event' WHEN '3' THEN 'role' WHEN '4' THEN 'recent_signal' ELSE 'activity' END AS category,
  lower(o_orderstatus) AS predicate, concat('Order ', cast(o_orderkey AS string), ' was placed') AS excerpt, cast(o_orderkey % 100 AS string) AS normalized_value, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END AS unit,
  CASE WHEN o_orderkey % 9 = 0 THEN 'contradiction' WHEN o_orderkey % 7 = 0 THEN 'indetermination' ELSE 'confirmation' END AS reconciliation, CASE WHEN o_orderkey % 3 = 0 THEN 'historical' ELSE 'unknown' END AS temporal_status
FROM {orders}
"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda t: sql(spark, sf_dir, t)
    return a.build_claims(q(DECISIONS), q(CANDIDATES), q(PROOFS).withColumnRenamed("primary_", "primary"), q(FACTS))


def g1_build_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir)


CLAIMS = f"""
WITH d AS ({plain(DECISIONS)}), c AS ({plain(CANDIDATES)}), p AS ({plain(PROOFS)}), f AS ({plain(FACTS)}), cl AS (
  SELECT request_id, concat('identity-', request_id, '-k0') AS claim_id, -1::BIGINT AS ord, 'k0' AS subject_key, 'identity.proof' AS predicate, excerpt AS statement, 'supported' AS state, 'confirmation' AS reconciliation,
    'display_fact' AS decision, NULL::VARCHAR AS value, NULL::VARCHAR AS unit, 'unknown' AS temporal_status
  FROM d JOIN p USING (request_id) WHERE status = 'resolved' AND primary_ AND candidate_key = 'k0'
  UNION ALL SELECT request_id, concat('fact-', request_id, '-', fact_id), ord::BIGINT, 'k0', category || '.' || predicate, excerpt,
    CASE WHEN reconciliation = 'indetermination' THEN 'rejected' WHEN reconciliation = 'contradiction' THEN 'contested' WHEN temporal_status = 'historical' THEN 'historical' ELSE 'supported' END, reconciliation,
    CASE WHEN reconciliation = 'indetermination' THEN 'reject' ELSE 'display_fact' END, normalized_value, unit, temporal_status
  FROM d JOIN f USING (request_id) WHERE status = 'resolved'
  UNION ALL SELECT request_id, concat('candidate-', request_id, '-', candidate_key), c.ord::BIGINT, candidate_key, 'identity.candidate', excerpt, 'ambiguous', 'indetermination', 'display_ambiguity', NULL, NULL, 'unknown'
  FROM d JOIN c USING (request_id) JOIN p USING (request_id, candidate_key) WHERE status IN ('ambiguous', 'insufficient_context') AND eligible AND primary_)"""
G1 = CLAIMS + " SELECT * FROM cl"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    identity = sql(spark, sf_dir, PROOFS).join(claims.where("predicate <> 'identity.x' and predicate like 'identity.%'").select("request_id", "claim_id", F.col("subject_key").alias("candidate_key")), ["request_id", "candidate_key"])
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(sql(spark, sf_dir, FACTS).select("request_id", "fact_id", "excerpt"), F.col("l_orderkey") == F.col("fact_id"))
    facts = lines.select(F.concat_ws("-", F.lit("fact"), "request_id", "fact_id").alias("claim_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/")).alias("url"), "excerpt",
                         F.when(F.col("l_returnflag") == "R", "search_snippet").otherwise("source_content").alias("method"))
    proofs = identity.select("claim_id", "ord", "url", "excerpt", "method").unionByName(facts)
    return a.build_evidence(claims, proofs.withColumns({"prefix": F.lit("a"), "suffix": F.lit(None).cast("string")}))


def g2_build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)


EVIDENCE = CLAIMS + """,
pr AS (
  SELECT claim_id, cl.request_id, cl.predicate, p.ord, url, excerpt, method FROM cl JOIN p ON p.request_id = cl.request_id AND candidate_key = subject_key WHERE predicate LIKE 'identity.%'
  UNION ALL SELECT claim_id, cl.request_id, cl.predicate, l_linenumber, 'https://s' || l_suppkey || '.example.com/', statement, CASE WHEN l_returnflag = 'R' THEN 'search_snippet' ELSE 'source_content' END
  FROM cl JOIN f ON claim_id = concat('fact-', f.request_id, '-', fact_id) JOIN lineitem ON l_orderkey = fact_id),
ev AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ord, url, excerpt, method) AS place FROM pr),
e AS (
  SELECT request_id, claim_id, sha256(claim_id || '|' || place) AS evidence_id, place AS ord, url, excerpt, CASE WHEN predicate = 'identity.proof' AND place > 1 THEN 'context_only' ELSE 'supports' END AS relation, method,
    '{"exact":"' || excerpt || '","prefix":"a","final_url":"' || url || '"}' AS locator
  FROM ev)"""
G2 = EVIDENCE + " SELECT * FROM e"

STATUS = "SELECT request_id, status, CASE WHEN request_id % 3 = 0 THEN 'complete_within_scope' ELSE 'partial' END AS completeness, CASE WHEN request_id % 4 = 0 THEN 2 ELSE 0 END AS n_grounded FROM (" + DECISIONS + ") d"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.global_status(sql(spark, sf_dir, STATUS))


def g4_global_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("request_id", "global_status", "result_mode")


G4 = f"""
SELECT request_id, CASE status WHEN 'resolved' THEN CASE WHEN n_grounded > 0 THEN 'partial' ELSE completeness END WHEN 'not_found_within_scope' THEN 'insufficient_evidence' ELSE 'needs_clarification' END AS global_status,
  CASE WHEN status = 'not_found_within_scope' THEN 'silence' ELSE 'standard' END AS result_mode
FROM ({plain(STATUS)}) s
"""


def g7_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.presentation(_claims(spark, sf_dir))


LISTS = CLAIMS + """,
b AS (SELECT * FROM cl WHERE decision = 'display_fact' AND predicate NOT LIKE 'identity.%' AND state <> 'contested'),
ls AS (
  SELECT request_id, claim_id, 'key_facts' AS list, ord FROM cl WHERE predicate = 'identity.proof' UNION ALL SELECT request_id, claim_id, CASE WHEN predicate LIKE 'event.%' OR predicate LIKE 'recent_signal.%' THEN 'recent_signals' ELSE 'key_facts' END, ord FROM b
  UNION ALL SELECT request_id, claim_id, 'ambiguities', ord FROM cl WHERE decision = 'display_ambiguity'),
sm AS (SELECT *, row_number() OVER (PARTITION BY request_id, split_part(predicate, '.', 1) ORDER BY ord, claim_id) > 1 AS later FROM b),
li AS (
  SELECT request_id, claim_id, list, row_number() OVER (PARTITION BY request_id, list ORDER BY ord, claim_id) AS position FROM ls
  UNION ALL SELECT request_id, claim_id, 'summary', position FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY later, ord, claim_id) AS position FROM sm) WHERE position <= 3)"""
G7 = LISTS + " SELECT request_id, claim_id, list, position FROM li"

COUNTS = "SELECT c_custkey AS request_id, c_custkey % 5 > 2 AS resolved, c_custkey % 4 AS n_publishers, c_custkey % 3 AS n_duplicates, c_custkey % 6 - 2 AS n_truncated, c_nationkey % 2 AS n_contradictions FROM {customer}"


def g10_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.limitations(sql(spark, sf_dir, COUNTS)).select("request_id", F.array_join("limits", ",").alias("limits"))


G10 = f"""
SELECT request_id, concat_ws(',', 'public_pages_only,grounding_is_stated,dated_event_is_no_current_state,server_html_only', CASE WHEN resolved AND n_publishers < 2 THEN 'one_publisher' END, CASE WHEN n_duplicates > 0 THEN 'duplicates_merged' END,
  CASE WHEN n_truncated > 0 THEN 'facts_truncated' END, CASE WHEN n_contradictions > 0 THEN 'open_contradiction' END) AS limits
FROM ({plain(COUNTS)}) c
"""


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    return a.assemble(_status(spark, sf_dir), claims, _evidence(spark, sf_dir), a.presentation(claims), a.limitations(sql(spark, sf_dir, COUNTS)))


def _digest(d: DataFrame) -> DataFrame:
    ids = lambda k: F.array_join(F.coalesce(F.col("presentation")[k], F.array().cast("array<string>")), ",")
    links = F.array_join(F.transform("claims", lambda c: F.concat_ws(":", c["claim_id"], F.size(F.coalesce(c["evidence_ids"], F.array().cast("array<string>"))).cast("string"))), ",")
    return d.select("request_id", "global_status", F.coalesce(links, F.lit("")).alias("claims"), F.greatest(F.size("evidence"), F.lit(0)).cast("long").alias("n_evidence"), ids("key_facts").alias("key_facts"), ids("summary").alias("summary"), F.size("limits").cast("long").alias("n_limits"))


def g11_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(dossiers(spark, sf_dir))


G11 = LISTS.replace("WITH d AS", "WITH g10 AS (" + G10 + "), g4 AS (" + G4 + "), d AS", 1) + EVIDENCE[len(CLAIMS):] + """,
cc AS (SELECT cl.request_id, cl.claim_id, cl.ord, count(e.evidence_id) AS n FROM cl LEFT JOIN e USING (claim_id) GROUP BY ALL),
g AS (SELECT request_id, string_agg(claim_id || ':' || n, ',' ORDER BY ord, claim_id) AS claims, sum(n)::BIGINT AS n FROM cc GROUP BY 1),
kf AS (SELECT request_id, string_agg(claim_id, ',' ORDER BY position) FILTER (list = 'key_facts') AS k, string_agg(claim_id, ',' ORDER BY position) FILTER (list = 'summary') AS s FROM li GROUP BY 1)
SELECT request_id, global_status, coalesce(claims, '') AS claims, coalesce(n, 0)::BIGINT AS n_evidence, coalesce(k, '') AS key_facts, coalesce(s, '') AS summary, len(string_split(limits, ','))::BIGINT AS n_limits
FROM g4 JOIN g10 USING (request_id) LEFT JOIN g USING (request_id) LEFT JOIN kf USING (request_id)
"""


def s5_write_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers written to the shared folder and read back."""
    from attestry.sources.tables import shared_path

    path = shared_path(spark, "dossiers")
    a.write_dossiers(dossiers(spark, sf_dir), path)
    return _digest(spark.read.parquet(path))


#: Two proposals a customer: the second names the first's candidate in capitals, or another one.
PARTS = """
SELECT c_custkey AS request_id, p AS part, o AS ord, concat('k', cast(p * 10 + o AS string)) AS candidate_key, CASE WHEN p = 2 AND o = 0 THEN upper(c_name) WHEN p = 2 THEN concat(c_name, ' B') ELSE c_name END AS display_name, 'company' AS entity_type
FROM {customer} CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2) a CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) b WHERE (p = 2 OR (o = 0 AND c_custkey % 3 > 0))
"""
PROPOSED = """
SELECT o_custkey AS request_id, 1 + o_orderkey % 2 AS part, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'k10' ELSE concat('k2', cast(o_orderkey % 3 AS string)) END AS subject_key,
  concat('https://s', cast(o_orderkey % 4 AS string), '.example.com/') AS url, concat('Order of ', cast(o_orderkey % 5 AS string)) AS excerpt
FROM {orders}
"""


def d3_merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, claims = a.merge_documents(sql(spark, sf_dir, PARTS), sql(spark, sf_dir, PROPOSED))
    return claims.select("request_id", "subject_key", F.col("ord").alias("fact_id"), F.col("position").cast("long").alias("position"))


D3 = f"""
WITH f AS (
  SELECT *, CASE WHEN part = 1 THEN subject_key WHEN request_id % 3 > 0 THEN CASE WHEN subject_key = 'k20' THEN 'k10' END WHEN subject_key IN ('k20', 'k21') THEN subject_key END AS own FROM ({plain(PROPOSED)}) x),
u AS (SELECT *, row_number() OVER (PARTITION BY request_id, url, lower(excerpt) ORDER BY part, ord) AS n FROM f WHERE own IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY request_id, url ORDER BY part, ord) > 1 AS later FROM u WHERE n = 1)
SELECT * FROM (SELECT request_id, own AS subject_key, ord AS fact_id, row_number() OVER (PARTITION BY request_id ORDER BY later, part, ord) AS position FROM w) WHERE position <= 6
"""

PROPOSALS = r"""
SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'STATUS: silence' WHEN 1 THEN concat('CLAIM: ', line) ELSE
  concat('STATUS: evidence', chr(10), 'ENTITY_TYPE: ', CASE WHEN (conv_id + turn) % 6 = 2 THEN 'place' ELSE 'company' END, chr(10), 'CLAIM: ', line, chr(10), 'SOURCE_URL: https://a.example.com/', chr(10), 'EXCERPT: seen', chr(10), 'PREFIX: NONE', chr(10), 'SUFFIX: after') END AS text
FROM (SELECT conv_id, turn, trim(substr(regexp_replace(text, '[\\s]+', ' '), 1, CASE WHEN conv_id % 5 = 0 THEN 8 ELSE 240 - 40 * cast(turn % 4 AS int) END)) AS line FROM {conversations}) c
"""


def s8_parse_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.parse_proposals(sql(spark, sf_dir, PROPOSALS)).select("conv_id", "turn", "code", "entity_type", "claim", "prefix", "suffix", "claim_start", "claim_end")


S8 = f"""
WITH t AS ({plain(PROPOSALS).replace("'[\\\\s]+', ' ')", "'[\\s]+', ' ', 'g')")}),
l AS (SELECT *, string_split(text, chr(10)) AS l FROM t),
c AS (SELECT *, l[3][8:] AS claim FROM l),
k AS (
  SELECT *, CASE WHEN text = 'STATUS: silence' THEN 'source_metadata_missing' WHEN len(l) <> 7 OR l[2] <> 'ENTITY_TYPE: company' OR claim IS NULL OR claim = '' OR claim <> trim(claim) THEN 'invalid_provider_shape'
    WHEN length(claim) NOT BETWEEN 10 AND 200 THEN 'invalid_claim_length'
    WHEN regexp_matches(claim, '(?i)[;:]|\\b(?:et|ainsi que|mais|tandis que|alors que|dont|qui)\\b') OR len(regexp_extract_all(claim, '[.!?](?:\\s|$)')) > 1 THEN 'non_atomic_claim' END AS code FROM c)
SELECT conv_id, turn, code, CASE WHEN code IS NULL THEN 'company' END AS entity_type, CASE WHEN code IS NULL THEN claim END AS claim, NULL::VARCHAR AS prefix, CASE WHEN code IS NULL THEN 'after' END AS suffix,
  CASE WHEN code IS NULL THEN instr(text, 'CLAIM: ') + 6 END::BIGINT AS claim_start, CASE WHEN code IS NULL THEN instr(text, 'CLAIM: ') + 6 + length(claim) END::BIGINT AS claim_end
FROM k
"""

#: Facts about suppliers; what the page says of the subject follows the key.
ABOUT = """
SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 17 = 0 THEN 'k1' ELSE 'k0' END AS subject_key, CASE WHEN s_suppkey % 13 = 0 THEN 'person' ELSE 'company' END AS entity_type, CASE s_suppkey % 4 WHEN 0 THEN 'metric' WHEN 1 THEN 'role' ELSE 'activity' END AS category,
  CASE WHEN s_suppkey % 11 = 0 THEN 'brand' ELSE 'company' END AS scope_type, CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'Another Firm' WHEN s_suppkey % 5 = 0 THEN upper(bare) ELSE name END AS scope_label,
  concat('https://', CASE WHEN s_suppkey % 10 = 1 THEN 'www.own.example.com' ELSE 'press.example.com' END, '/', CASE WHEN s_suppkey % 8 = 6 THEN replace(lower(name), ' ', '-') ELSE 'x' END) AS url,
  CASE WHEN s_suppkey % 8 = 3 THEN concat('At ', name) ELSE 'Press' END AS title, CASE WHEN s_suppkey % 8 IN (1, 2) THEN concat(bare, ' sells parts') ELSE 'It sells parts' END AS excerpt,
  CASE WHEN s_suppkey % 8 IN (4, 5) THEN concat('By ', lower(name), ' sells parts') ELSE 'It sells parts' END AS page_text, CASE WHEN s_suppkey % 16 = 6 THEN 'search_snippet' ELSE 'source_content' END AS method
FROM (SELECT s_suppkey, concat('Firm ', translate(cast(s_suppkey AS string), '0123456789', 'ABCDEFGHIJ')) AS bare, concat('Firm ', translate(cast(s_suppkey AS string), '0123456789', 'ABCDEFGHIJ'), ' Ltd') AS name FROM {supplier}) s
"""
CHOSEN = "SELECT s_suppkey AS request_id, 'k0' AS selected_key, concat('Firm ', translate(cast(s_suppkey AS string), '0123456789', 'ABCDEFGHIJ'), ' Ltd') AS display_name, concat('Firm ', translate(cast(s_suppkey AS string), '0123456789', 'ABCDEFGHIJ'), ' Ltd') AS requested_name, 'company' AS selected_type, 'company' AS selected_scope, 'https://own.example.com/about' AS official_site FROM {supplier}"


def f1_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.attribute(sql(spark, sf_dir, ABOUT), sql(spark, sf_dir, CHOSEN)).select("request_id", "code", "anchor")


F1 = """
WITH k AS (
  SELECT s_suppkey AS i, CASE WHEN s_suppkey % 17 = 0 THEN 'subject_key_mismatch' WHEN s_suppkey % 13 = 0 THEN 'entity_type_mismatch' WHEN s_suppkey % 11 = 0 THEN 'scope_incompatible' WHEN s_suppkey % 6 = 0 AND s_suppkey % 4 < 2 THEN 'scope_label_required'
    WHEN s_suppkey % 6 <> 0 AND s_suppkey % 7 = 0 THEN 'scope_label_mismatch' WHEN s_suppkey % 10 <> 1 AND (s_suppkey % 8 IN (0, 7) OR (s_suppkey % 8 = 6 AND s_suppkey % 16 <> 6)) THEN 'page_identity_anchor_missing' END AS code FROM supplier)
SELECT i AS request_id, code, CASE WHEN code IS NULL THEN CASE WHEN i % 10 = 1 THEN 'official_domain' WHEN i % 8 IN (1, 2) THEN 'excerpt' WHEN i % 8 = 3 THEN 'title' WHEN i % 8 IN (4, 5) THEN 'page' ELSE 'url' END END AS anchor FROM k
"""

PEOPLE = """
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'activity' ELSE 'role' END AS category, 'person' AS entity_type, 'person' AS scope_type, CASE WHEN c_custkey % 8 = 0 THEN 'Jean Autre' ELSE name END AS scope_label, name AS display_name,
  concat('https://firm.example.com/', CASE c_custkey % 5 WHEN 0 THEN 'notre-%C3%A9quipe/' WHEN 1 THEN 'about-us' WHEN 2 THEN 'news/team' WHEN 3 THEN 'pages/x' ELSE 'fr/direction/membres' END) AS url,
  CASE WHEN c_custkey % 5 = 3 AND c_custkey % 2 = 0 THEN 'Firm | Meet the Team' WHEN c_custkey % 10 = 1 THEN 'Contact - Firm' ELSE 'Firm' END AS title,
  concat(CASE WHEN c_custkey % 7 = 0 THEN upper(name) ELSE name END, CASE c_custkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN ', ' WHEN 2 THEN ' – ' ELSE ' | ' END, CASE c_custkey % 4 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Directrice générale' WHEN 2 THEN 'Vice-President' ELSE 'Baker' END) AS excerpt
FROM (SELECT c_custkey, concat('Marie ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS name FROM {customer}) c
"""


def q2_directory_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory_role(sql(spark, sf_dir, PEOPLE)).select("c_custkey", "directory_role")


Q2 = "SELECT c_custkey, c_custkey % 9 <> 0 AND c_custkey % 8 <> 0 AND (c_custkey % 5 IN (0, 4) OR (c_custkey % 5 = 1 AND c_custkey % 10 <> 1) OR (c_custkey % 5 = 3 AND c_custkey % 2 = 0)) AND c_custkey % 4 <> 3 AS directory_role FROM customer"

#: Claims with one thing wrong in some of them.
BROKEN = """
SELECT o_custkey AS request_id, cast(o_orderkey AS string) AS claim_id, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'k0' END AS subject_key, concat(CASE o_orderkey % 6 WHEN 0 THEN 'metric' WHEN 1 THEN 'gossip' WHEN 2 THEN 'identity' ELSE 'role' END, '.x') AS predicate,
  concat('Order  ', cast(o_orderkey AS string)) AS statement, CASE WHEN o_orderkey % 11 = 0 THEN 'rejected' WHEN o_orderkey % 13 = 0 THEN 'contested' WHEN o_orderkey % 17 = 0 THEN 'odd' ELSE 'supported' END AS state,
  CASE WHEN o_orderkey % 7 = 0 THEN 'reject' ELSE 'display_fact' END AS decision, CASE WHEN o_orderkey % 5 = 0 THEN 'current' ELSE 'unknown' END AS temporal_status, o_orderkey % 4 <> 0 AS dated, CASE WHEN o_orderkey % 9 = 0 THEN 'undetermined' ELSE 'company' END AS scope_type,
  'Firm' AS scope_label, CASE WHEN o_orderkey % 23 = 0 THEN 'indetermination' ELSE 'confirmation' END AS reconciliation, CASE WHEN o_orderkey % 29 = 0 THEN 'ftp://a' ELSE 'https://a.example.com' END AS url, o_totalprice AS amount
FROM {orders}
"""
BROKEN_EVIDENCE = """
SELECT cast(l_orderkey AS string) AS claim_id, cast(l_suppkey AS string) AS source_id, CASE WHEN l_linenumber % 3 = 2 THEN 'k1' ELSE 'k0' END AS entity_key, CASE WHEN l_returnflag = 'N' THEN 'supports' ELSE 'context_only' END AS relation, 'source_content' AS method,
  concat(' Order ', cast(l_orderkey AS string)) AS excerpt FROM {lineitem}
"""


def v1_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.schema_check(sql(spark, sf_dir, BROKEN), "claim_id", ["subject_key", "statement", "predicate"], bounds={"amount": (0.0, 400_000.0)})


V1 = f"""
WITH b AS ({plain(BROKEN)})
SELECT claim_id, 'subject_key' AS path, 'required' AS keyword FROM b WHERE subject_key IS NULL UNION ALL SELECT claim_id, 'state', 'enum' FROM b WHERE state = 'odd'
UNION ALL SELECT claim_id, 'amount', 'range' FROM b WHERE amount NOT BETWEEN 0 AND 400000 UNION ALL SELECT claim_id, 'url', 'format' FROM b WHERE url LIKE 'ftp%'
"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    sources = s.select(F.col("s_suppkey").cast("string").alias("source_id"), F.when(F.col("s_suppkey") % 5 == 0, "k2").otherwise("k0").alias("assumed_key"))
    d = sql(spark, sf_dir, DECISIONS)
    claims = sql(spark, sf_dir, BROKEN)
    presented = claims.where("cast(claim_id as bigint) % 10 <> 3").select("claim_id")
    lines = sql(spark, sf_dir, BROKEN_EVIDENCE)
    visible = lines.where("cast(source_id as bigint) % 3 > 0").join(claims.select("claim_id", "request_id"), "claim_id").select("request_id", "source_id")
    return v.shown_claims(d, claims, lines, sources, presented, visible)


def v5_shown_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir)


SHOWN = f"""
WITH d AS ({plain(DECISIONS)}), b AS ({plain(BROKEN)}), n AS (SELECT *, claim_id::BIGINT AS i FROM b JOIN d USING (request_id)),
p AS (SELECT l_orderkey AS i, bool_or(l_suppkey % 3 > 0) AS seen FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber % 3 <> 2 AND l_suppkey % 5 <> 0 GROUP BY 1),
q AS (SELECT n.*, p.seen, decision = 'display_fact' AND state IN ('supported', 'contested') AS shown FROM n LEFT JOIN p USING (i)),
r AS (SELECT q.* REPLACE (CASE WHEN subject_key IS NULL THEN NULL ELSE seen END AS seen) FROM q),
c5 AS (
  SELECT request_id, claim_id, 'current_claim_without_dated_fact_period' AS code FROM r WHERE temporal_status = 'current' AND NOT dated
  UNION ALL SELECT request_id, claim_id, 'displayed_claim_has_non_factual_state' FROM r WHERE decision = 'display_fact' AND state IN ('rejected', 'odd')
  UNION ALL SELECT request_id, claim_id, 'displayed_claim_unknown_category' FROM r WHERE shown AND predicate = 'gossip.x'
  UNION ALL SELECT request_id, claim_id, 'displayed_metric_requires_period_and_scope' FROM r WHERE shown AND predicate = 'metric.x' AND (NOT dated OR scope_type = 'undetermined')
  UNION ALL SELECT request_id, claim_id, 'displayed_claim_requires_resolved_identity' FROM r WHERE shown AND status <> 'resolved'
  UNION ALL SELECT request_id, claim_id, 'displayed_claim_not_presented' FROM r WHERE shown AND i % 10 = 3
  UNION ALL SELECT request_id, claim_id, 'displayed_claim_without_attributable_evidence' FROM r WHERE shown AND seen IS NULL
  UNION ALL SELECT request_id, claim_id, 'displayed_claim_source_not_presented' FROM r WHERE shown AND NOT seen)"""
V5 = SHOWN + " SELECT request_id, claim_id, code FROM c5"


def v7_presentation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = sql(spark, sf_dir, BROKEN)
    i = F.col("claim_id").cast("long")
    kind = F.when(i % 5 == 0, "recent_signal").when(i % 5 == 1, "ambiguity").when(i % 5 == 2, "summary").otherwise("key_fact")
    lists = claims.select("request_id", kind.alias("list"), F.when(i % 31 == 0, F.concat("claim_id", F.lit("x"))).otherwise(F.col("claim_id")).alias("id"))
    e = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("request_id"), F.explode(F.array(*map(F.lit, ("contradiction", "unknown", "source")))).alias("list"))
    others = e.where("not (request_id % 4 = 0 and list = 'unknown') and not (request_id % 7 = 0 and list = 'source') and not (request_id % 9 = 0 and list = 'contradiction')").select("request_id", "list", F.lit("o").alias("id"), (F.col("request_id") % 5 > 0).alias("visible"))
    return v.presentation_rules(lists.unionByName(e.withColumn("id", F.lit("o"))), claims, others)


V7 = f"""
WITH b AS ({plain(BROKEN)}), t AS (SELECT *, claim_id::BIGINT AS i FROM b),
l AS (SELECT t.*, CASE i % 5 WHEN 0 THEN 'recent_signal' WHEN 1 THEN 'ambiguity' WHEN 2 THEN 'summary' ELSE 'key_fact' END AS list, i % 31 = 0 AS gone, CASE WHEN i % 31 = 0 THEN claim_id || 'x' ELSE claim_id END AS id,
  i % 31 <> 0 AND state IN ('supported', 'contested') AND decision = 'display_fact' AS fact, i % 31 <> 0 AND (state = 'contested' OR reconciliation = 'indetermination') AS unresolved FROM t)
SELECT request_id, 'presentation_invalid_' || list AS code, id FROM l WHERE list IN ('key_fact', 'recent_signal') AND NOT fact UNION ALL SELECT request_id, 'presentation_' || list || '_forbids_unresolved', id FROM l WHERE list IN ('key_fact', 'recent_signal') AND unresolved
UNION ALL SELECT request_id, 'presentation_invalid_ambiguity', id FROM l WHERE list = 'ambiguity' UNION ALL SELECT request_id, 'summary_requires_displayed_fact', id FROM l WHERE list = 'summary' AND NOT fact
UNION ALL SELECT request_id, 'summary_requires_business_fact', id FROM l WHERE list = 'summary' AND NOT gone AND predicate IN ('gossip.x', 'identity.x') UNION ALL SELECT request_id, 'summary_forbids_unresolved_fact', id FROM l WHERE list = 'summary' AND unresolved
UNION ALL SELECT c_custkey, 'presentation_hidden_contradiction', 'o' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 9 <> 0 UNION ALL SELECT c_custkey, 'presentation_missing_unknown', 'o' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'presentation_missing_source', 'o' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'presentation_missing_contradiction', 'o' FROM customer WHERE c_custkey % 9 = 0
UNION ALL SELECT request_id, 'summary_allows_at_most_three_items', NULL FROM l WHERE list = 'summary' GROUP BY request_id HAVING count(*) > 3
"""

ORDER = ["displayed_claim_requires_resolved_identity", "displayed_claim_has_non_factual_state", "displayed_claim_without_attributable_evidence", "displayed_claim_source_not_presented"]


def v10_first_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.first_issue(_shown(spark, sf_dir).select("request_id", "code", F.col("claim_id").alias("id")), ORDER)


V10 = SHOWN + f"""
SELECT request_id, code, claim_id AS id FROM c5
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY coalesce(nullif(list_position({ORDER}, code), 0), 99), code, claim_id) = 1
"""

QUERIES = {q.__name__: q for q in (g1_build_claims, g2_build_evidence, g4_global_status, g7_presentation, g10_limitations, g11_assemble, s5_write_dossiers, d3_merge_documents, s8_parse_proposals, f1_attribute, q2_directory_role, v1_schema_check, v5_shown_claims, v7_presentation_rules, v10_first_issue)}
ORACLES = {"g1_build_claims": G1, "g2_build_evidence": G2, "g4_global_status": G4, "g7_presentation": G7, "g10_limitations": G10, "g11_assemble": G11, "s5_write_dossiers": G11, "d3_merge_documents": D3, "s8_parse_proposals": S8, "f1_attribute": F1, "q2_directory_role": Q2, "v1_schema_check": V1, "v5_shown_claims": V5, "v7_presentation_rules": V7, "v10_first_issue": V10}
