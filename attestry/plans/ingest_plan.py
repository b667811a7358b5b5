"""Queries over requests, proposals, responses and event logs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.plans.fixtures import sql
from attestry.sources import ingest as i
from attestry.sources.proposals import ingest_documents


def s1_load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    r = c.select(
        k.alias("request_id"), F.when(k % 10 == 1, none).when(k % 10 == 2, F.lit(" x ")).otherwise(F.concat(F.lit("  "), F.regexp_replace("c_name", "#", " #  "))).alias("name"),
        F.when(k % 10 == 3, "thing").when(k % 10 == 9, "company").alias("entity_type"), F.when(k % 10 == 4, F.repeat(F.lit("abc "), F.lit(90))).otherwise(F.col("c_mktsegment")).alias("context"),
        F.when(k % 10 == 5, F.lit(" ")).otherwise(F.lit("Paris")).alias("city"), none.alias("organization"), none.alias("role"), none.alias("industry"),
        F.when(k % 10 == 6, "https://example.com/").when(k % 10 == 9, "https://example.com/?utm_source=a").alias("identity_source_url"),
        F.when((k % 10 == 9) & (k % 20 == 9), "https://example.com/#top").when(k % 10 == 9, "https://example.com/b").alias("source_url"))
    ok, bad = i.load_requests(r)
    return ok.select("request_id", "name", "identity_source_url", F.lit(None).cast("string").alias("code")).unionByName(
        bad.select("request_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("identity_source_url"), "code"))


S1 = r"""
WITH z AS (
  SELECT c_custkey AS k, trim(regexp_replace(replace(c_name, '#', ' #  '), '\s+', ' ', 'g')) AS n,
    CASE c_custkey % 10 WHEN 1 THEN 'name_required' WHEN 2 THEN 'invalid_name_length' WHEN 3 THEN 'invalid_entity_type' WHEN 4 THEN 'invalid_context_length' WHEN 5 THEN 'invalid_hint_length'
      WHEN 6 THEN 'identity_source_type_required' WHEN 9 THEN (CASE WHEN c_custkey % 20 <> 9 THEN 'conflicting_source_url' END) END AS code FROM customer)
SELECT k AS request_id, CASE WHEN code IS NULL THEN n END AS name, CASE WHEN code IS NULL AND k % 10 = 9 THEN 'https://example.com/' END AS identity_source_url, code FROM z
"""


#: One claim a turn; by turn one of them has an empty predicate, a key or a date that does not hold, or (null text) no excerpt. By conversation the document is
#: whole, lacks fields that may be null, lists its missing categories, or cannot be read: cut off, an unknown status, a number for a text.
PROPOSED = """
SELECT conv_id AS request_id, conv_id % 9 AS variant, concat('{{"identityStatus":"', CASE WHEN conv_id % 9 = 1 THEN 'sure' ELSE 'resolved' END, '","entityType":null,"missingCategories":', CASE conv_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["role","role","event"]'
    WHEN 2 THEN '["identity","activity","role","geography","metric","event","recent_signal","other","other"]' ELSE '["identity","activity","role","geography","metric","event","recent_signal"]' END,
  ',"candidates":[', CASE WHEN conv_id % 9 = 2 THEN '{{"candidateKey":5}}' ELSE '' END, '],"claims":', to_json(claims), '}}') AS json
FROM (
  SELECT conv_id, transform(sort_array(collect_list(named_struct('turn', turn, 'text', text))), t -> map_concat(
    map('subjectKey', CASE WHEN t.turn % 5 = 2 THEN 'Bad key' ELSE 'k0' END, 'category', 'activity', 'entityType', 'company', 'predicate', CASE WHEN t.turn % 5 = 1 THEN '  ' ELSE 'sells' END, 'scopeType', 'company',
      'sourceUrl', 'https://example.com/a', 'excerpt', concat('  ', coalesce(t.text, ''), ' ')),
    CASE WHEN conv_id % 3 = 0 THEN map('unit', 'kg') ELSE map('scopeLabel', '', 'factPeriodLabel', NULL, 'factDate', CASE WHEN t.turn % 5 = 3 THEN '99' ELSE '2020' END, 'normalizedValue', NULL, 'unit', NULL, 'currency', NULL, 'contradictionKey', NULL, 'prefix', NULL, 'suffix', NULL) END)) AS claims
  FROM {conversations} GROUP BY conv_id) c
"""


def s2_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sql(spark, sf_dir, PROPOSED)
    g = g.withColumn("json", F.when(F.col("variant") == 0, F.left("json", F.lit(60))).otherwise(F.col("json")))
    docs, _, facts, missing = ingest_documents(g)
    f = facts.groupBy("request_id").agg(F.sum(F.length("excerpt")).alias("n_chars"))
    m = missing.groupBy("request_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("category"))).alias("missing"))
    return docs.join(f, "request_id", "left").join(m, "request_id", "left").select("request_id", "rung", "n_facts", "dropped", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"), "missing")


S2 = r"""
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS e FROM conversations),
k AS (SELECT *, n <= 6 AND turn % 5 NOT IN (1, 2) AND (turn % 5 <> 3 OR conv_id % 3 = 0) AND e <> '' AS kept FROM r),
g AS (
  SELECT conv_id, CASE WHEN conv_id % 9 IN (0, 1, 2) THEN 'rejected' WHEN conv_id % 3 = 0 THEN 'defaults' ELSE 'strict' END AS rung, count(*) FILTER (kept) AS kept, count(*) AS n, coalesce(sum(least(500, length(e))) FILTER (kept), 0) AS chars
  FROM k GROUP BY conv_id),
l AS (
  SELECT *, rung <> 'rejected' AND (kept <> n OR conv_id % 4 = 2) AS dropped,
    CASE conv_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['event', 'role'] WHEN 2 THEN ['activity', 'event', 'geography', 'identity', 'metric', 'other', 'recent_signal', 'role'] ELSE ['activity', 'event', 'geography', 'identity', 'metric', 'recent_signal', 'role'] END AS base FROM g)
SELECT conv_id AS request_id, rung, CASE WHEN rung = 'rejected' THEN 0 ELSE kept END::BIGINT AS n_facts, dropped, CASE WHEN rung = 'rejected' THEN 0 ELSE chars END::BIGINT AS n_chars,
  CASE WHEN rung <> 'rejected' THEN nullif(array_to_string(list_sort(list_distinct(CASE WHEN dropped THEN base || ['other'] ELSE base END)), ','), '') END AS missing
FROM l
"""


def s3_gate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("page_id") % 10
    h = lambda n, v: F.struct(F.lit(n).alias("name"), (v if not isinstance(v, str) else F.lit(v)).alias("value"))
    kind = F.when(k == 1, "application/pdf").when(k == 3, "text/html; charset=latin-1").when(k == 9, "Text/HTML").otherwise("text/html; charset=UTF-8")
    headers = F.when(k == 2, F.array(h("Content-Type", "text/html"), h("content-type", "text/plain"))).when(k == 7, F.array(h("Content-Type", "text/plain"), h("Content-Length", "abc"))).otherwise(F.array(h("Content-Type", kind)))
    size = F.when(k == 4, 600_000).when(k == 8, 0).otherwise(F.octet_length("html"))
    r = p.select("page_id", F.when(k == 5, 404).when(k == 6, 302).otherwise(200).alias("status"), headers.alias("headers"), size.alias("body_bytes"))
    ok, bad = i.gate_responses(r)
    none = F.lit(None).cast("string")
    return ok.select("page_id", none.alias("code"), none.alias("media_class")).unionByName(bad)


S3 = """
SELECT page_id, (['source_content_type_unsupported', 'source_content_type_invalid', 'source_charset_unsupported', 'source_too_large', 'source_http_error', 'source_http_error', 'source_content_length_invalid', 'source_empty'])[page_id % 10] AS code,
  CASE WHEN page_id % 10 = 1 THEN 'pdf' END AS media_class
FROM pages
"""


def s6_decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 6
    state = F.when(F.col("event_type") == "error", "failed").otherwise("accepted")
    data = F.concat(F.lit('{"state": "'), F.when(k == 1, "building").otherwise(state), F.lit('",\ndata: "elapsed_ms": '), F.col("event_id").cast("string"), F.when(k == 2, "").otherwise("}"))
    text = F.concat(F.lit(": ping\nevent: "), F.when(k == 3, "dance").otherwise(state), F.when(k == 4, "\nretry: 5").otherwise(""), F.lit("\ndata: "), data, F.lit("\n"))
    ok, bad = i.decode_events(e.select(F.col("event_id").alias("block_id"), text.alias("text")))
    return ok.withColumn("code", F.lit(None).cast("string")).unionByName(bad.select("block_id", F.lit(None).cast("string").alias("event"), F.lit(None).cast("long").alias("elapsed_ms"), "code"))


S6 = """
SELECT event_id AS block_id, CASE WHEN event_id % 6 IN (0, 5) THEN (CASE WHEN event_type = 'error' THEN 'failed' ELSE 'accepted' END) END AS event,
  CASE WHEN event_id % 6 IN (0, 5) THEN event_id END AS elapsed_ms,
  CASE event_id % 6 WHEN 1 THEN 'state_mismatch' WHEN 2 THEN 'data_invalid' WHEN 3 THEN 'unknown_state' WHEN 4 THEN 'unknown_field' END AS code
FROM events
"""


def s7_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return i.receipts(e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("props").alias("prompt"), F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("provider_request_id")))


S7 = "SELECT event_id AS run_id, event_type AS status, substr(sha256('req-' || event_id), 1, 16) AS request_digest FROM events"

QUERIES = {f.__name__: f for f in (s1_load_requests, s2_ingest_documents, s3_gate_responses, s6_decode_events, s7_receipts)}
ORACLES = {"s1_load_requests": S1, "s2_ingest_documents": S2, "s3_gate_responses": S3, "s6_decode_events": S6, "s7_receipts": S7}
