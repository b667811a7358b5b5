"""Queries of dossier assembly, on orders, customers and events read as claims and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import dossier as d
from attestry.plans.fixtures import plain, sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("url", F.concat(F.lit("https://"), F.when(F.col("event_id") % 7 == 0, "www.linkedin.com/in/").otherwise("a.example.com/"), F.col("event_id").cast("string")))


def j8_ground_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    claims = e.select(F.col("event_id").alias("claim_id"), "url", (F.col("event_id") % 5 == 0).alias("has_page"))
    bindings = e.select(F.col("event_id").alias("claim_id"), F.when(F.col("event_type") == "view", "citation").when(F.col("event_type") == "click", "search_source").otherwise("structured_output").alias("binding_type"))
    return d.ground_failures(claims, e.where("event_id % 4 = 1").select(F.col("event_id").alias("claim_id")), bindings).select("claim_id", "grounding", "never_read")


J8 = """
SELECT event_id AS claim_id, CASE WHEN event_type = 'view' THEN 'provider_annotation' ELSE 'search_snippet' END AS grounding, event_id % 7 = 0 AS never_read
FROM events WHERE event_id % 4 <> 1 AND (event_type IN ('view', 'click') OR event_id % 5 = 0)
"""


def j10_selected_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    requests = c.select(k.alias("request_id"), F.col("c_name").alias("name"), F.lit("company").alias("entity_type"), F.when(k % 2 == 0, F.concat(F.lit("https://s.example.com/"), k.cast("string"))).alias("source_url"))
    cand = c.select(k.alias("request_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord"), "c_name")
    cand = cand.select("request_id", "ord", F.concat_ws("-", F.col("request_id").cast("string"), F.col("ord").cast("string")).alias("candidate_key"), F.when(F.col("ord") == 1, F.upper("c_name")).otherwise(F.concat("c_name", F.lit("x"))).alias("display_name"), F.lit("company").alias("entity_type"), F.lit("https://p.example.com/").alias("url"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    facts = o.select(F.col("o_custkey").alias("request_id"), F.concat_ws("-", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 3).cast("string")).alias("subject_key"), F.col("o_orderkey").alias("fact_id"))
    _, kept = d.apply_selected_source(requests, cand, facts)
    return kept.select("request_id", "subject_key", "fact_id")


J10 = """
SELECT o_custkey AS request_id, o_custkey || '-' || (o_orderkey % 3) AS subject_key, o_orderkey AS fact_id
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 2 = 1 OR o_orderkey % 3 = 1
"""


def g5_build_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy(F.col("user_id").alias("request_id")).agg(
        F.sum((F.col("event_type") == "error").cast("long")).alias("discarded_proofs"), F.sum((F.col("value") > 90).cast("long")).alias("quality_rejections"), F.sum((F.col("event_id") % 97 == 0).cast("long")).alias("silence"))
    return d.build_unknowns(g)


G5 = """
WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (value > 90) AS b, count(*) FILTER (event_id % 97 = 0) AS c FROM events GROUP BY 1)
SELECT user_id AS request_id, 'discarded_proofs' AS cause, a::BIGINT AS n FROM g WHERE a > 0
UNION ALL SELECT user_id, 'quality_rejections', b::BIGINT FROM g WHERE b > 0 UNION ALL SELECT user_id, 'silence', c::BIGINT FROM g WHERE c > 0
"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    claims = o.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "P", "contested").otherwise("supported").alias("state"), F.col("o_orderkey").alias("ord"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "metric").otherwise("role"), F.lit(".x")).alias("predicate"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ev = li.select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_returnflag") == "A", "source_content").when(F.col("l_returnflag") == "N", "search_snippet").otherwise("provider_annotation").alias("method"), (F.col("l_linenumber") == 1).alias("official"), F.concat(F.lit("https://p"), (F.col("l_suppkey") % 4).cast("string"), F.lit(".com/")).alias("url"))
    return d.confidence(claims, ev)


def g8_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("claim_id", "level")


LEVELS = """
WITH e AS (
  SELECT l_orderkey AS k, bool_or(l_returnflag = 'A') AS d, bool_or(l_returnflag = 'A' AND l_linenumber = 1) AS o, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey % 4 END) AS n, bool_or(l_returnflag = 'R') AS a
  FROM lineitem GROUP BY 1),
c AS (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'lead' WHEN d AND (o OR n >= 2) THEN 'confirmed' WHEN d OR a THEN 'supported' ELSE 'lead' END AS level
  FROM orders LEFT JOIN e ON k = o_orderkey)"""
G8 = LEVELS + " SELECT o_orderkey AS claim_id, level FROM c"


#: Pages of five kinds behind the evidence of orders; a subject whose name titles or URLs may hold.
RECORDS = """
SELECT l_orderkey AS claim_id, CASE WHEN l_orderkey % 5 < 3 THEN 'search_snippet' WHEN l_linenumber % 2 = 0 THEN 'provider_annotation' ELSE 'source_content' END AS method, l_linenumber = 1 AS official, l_suppkey % 8 > 0 AS accessible,
  CASE WHEN l_partkey % 9 = 0 THEN 'About  NORDIX Ltd' ELSE 'News' END AS title,
  concat('https://', CASE WHEN l_orderkey % 7 = 0 THEN 'www.linkedin.com/in/' WHEN l_partkey % 11 = 0 THEN 'www.data.gouv.fr/' WHEN l_partkey % 13 = 0 THEN 'news.com/nordix-ltd/' ELSE concat('p', cast(l_suppkey % 3 AS string), '.com/') END, cast(l_linenumber AS string)) AS url
FROM {lineitem}
"""
JUDGED = "SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 17 = 0 THEN 'contested' ELSE 'supported' END AS state, CASE WHEN o_orderkey % 19 = 0 THEN 'contradiction' ELSE 'confirmation' END AS reconciliation, CASE WHEN o_orderkey % 4 > 0 THEN 'Nordix Ltd' END AS subject FROM {orders}"


def g8_named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.confidence(sql(spark, sf_dir, JUDGED), sql(spark, sf_dir, RECORDS)).select("claim_id", "level")


G8_NAMED = f"""
WITH r AS ({plain(RECORDS)}), c AS ({plain(JUDGED)}), w AS (SELECT *, method = 'source_content' AND accessible AS direct FROM r),
g AS (
  SELECT c.claim_id, bool_or(direct) AS d, bool_or(direct AND official) AS o, count(DISTINCT CASE WHEN direct THEN regexp_extract(url, '([a-z0-9]+[.](com|fr|gouv[.]fr))/', 1) END) AS n, bool_or(method = 'provider_annotation') AS a, bool_and(contains(url, 'linkedin')) AS l,
    bool_or(method = 'search_snippet' AND (contains(url, 'gouv.fr') OR (subject IS NOT NULL AND (title LIKE 'About%' OR contains(url, 'nordix'))))) AS s
  FROM c JOIN w USING (claim_id) GROUP BY 1)
SELECT claim_id, CASE WHEN state = 'contested' OR reconciliation = 'contradiction' THEN 'lead' WHEN NOT l AND d AND (o OR n >= 2) THEN 'confirmed' WHEN d OR a OR s THEN 'supported' ELSE 'lead' END AS level FROM c LEFT JOIN g USING (claim_id)
"""


def g9_list_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.list_facts(_levels(spark, sf_dir))


G9 = LEVELS + """
SELECT o_custkey AS request_id, o_orderkey AS claim_id, CASE WHEN o_orderkey % 2 = 0 THEN 'figures' ELSE 'people' END AS display,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE level WHEN 'confirmed' THEN 1 WHEN 'supported' THEN 2 ELSE 3 END, o_orderkey) AS position
FROM c
"""


def v3_identity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 3 == 0, "ambiguous").otherwise("resolved").alias("status"), F.lit("k1").alias("selected_key"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("request_id"), F.concat(F.lit("k"), (F.col("o_orderkey") % 4).cast("string")).alias("candidate_key"), (F.col("o_orderpriority") == "1-URGENT").alias("selected"))
    return d.identity_rules(c, o)


V3 = """
WITH g AS (SELECT o_custkey AS k, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 1) AS m FROM orders GROUP BY 1),
j AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AS r, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM customer LEFT JOIN g ON k = c_custkey)
SELECT k AS request_id, 'resolved_identity_requires_exactly_one_candidate' AS code FROM j WHERE r AND n <> 1
UNION ALL SELECT k, 'resolved_identity_missing_selected_candidate' FROM j WHERE r AND m = 0 UNION ALL SELECT k, 'unresolved_identity_has_selected_candidate' FROM j WHERE NOT r AND n > 0
"""

QUERIES = {f.__name__: f for f in (j8_ground_failures, j10_selected_source, g5_build_unknowns, g8_confidence, g8_named_sources, g9_list_facts, v3_identity_rules)}
ORACLES = {"j8_ground_failures": J8, "j10_selected_source": J10, "g5_build_unknowns": G5, "g8_confidence": G8, "g8_named_sources": G8_NAMED, "g9_list_facts": G9, "v3_identity_rules": V3}
