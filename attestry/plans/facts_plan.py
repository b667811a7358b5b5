"""Queries over facts, requests and claims derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import facts as f
from attestry.operators import merge
from attestry.plans.fixtures import plain, sql

PERIODS = """
SELECT o_orderkey AS fact_id, o_orderkey % 5 AS variant, substr(cast(o_orderdate AS string), 1, 10) AS iso,
  CASE o_orderkey % 5 WHEN 3 THEN substr(cast(o_orderdate AS string), 1, 4) ELSE substr(cast(o_orderdate AS string), 1, 10) END AS fact_date,
  CASE o_orderkey % 5
    WHEN 0 THEN substr(cast(o_orderdate AS string), 1, 10)
    WHEN 1 THEN concat(substr(cast(o_orderdate AS string), 9, 2), '/', substr(cast(o_orderdate AS string), 6, 2), '/', substr(cast(o_orderdate AS string), 1, 4))
    WHEN 2 THEN concat(substr(cast(o_orderdate AS string), 9, 2), ' ',
      CASE substr(cast(o_orderdate AS string), 6, 2) WHEN '01' THEN 'janvier' WHEN '02' THEN 'février' WHEN '03' THEN 'mars' WHEN '04' THEN 'avril' WHEN '05' THEN 'mai' WHEN '06' THEN 'juin'
        WHEN '07' THEN 'juillet' WHEN '08' THEN 'août' WHEN '09' THEN 'septembre' WHEN '10' THEN 'octobre' WHEN '11' THEN 'novembre' ELSE 'décembre' END, ' ', substr(cast(o_orderdate AS string), 1, 4))
    WHEN 3 THEN concat('year ', substr(cast(o_orderdate AS string), 1, 4))
    ELSE '31/12/1901' END AS fact_period_label
FROM {orders}
"""


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sql(spark, sf_dir, PERIODS)
    return d.withColumns({"excerpt": F.concat(F.lit("Order placed on "), "fact_period_label", F.lit(" by Firm A Ltd.")), "category": F.lit("activity")})


def t1_fact_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = f.fact_period(_periods(spark, sf_dir))
    day = lambda c: F.date_format(F.col(f"period.{c}"), "yyyy-MM-dd")
    return p.select("fact_id", F.col("period.status").alias("status"), day("start").alias("start_day"), day("end").alias("end_day"), day("as_of").alias("as_of_day"))


T1 = "WITH p AS (" + plain(PERIODS) + """)
SELECT fact_id, CASE WHEN variant = 4 THEN 'unknown' ELSE 'stated' END AS status, CASE WHEN variant = 3 THEN fact_date || '-01-01' END AS start_day,
  CASE WHEN variant = 3 THEN fact_date || '-12-31' END AS end_day, CASE WHEN variant IN (0, 1, 2) THEN iso END AS as_of_day
FROM p
"""


def t2_temporal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _periods(spark, sf_dir).withColumn("excerpt", F.when(F.col("fact_id") % 2 == 0, F.concat(F.lit("Currently, "), "excerpt")).otherwise(F.col("excerpt")))
    return f.temporal_status(f.fact_period(d), F.lit("1998-08-02").cast("timestamp")).select("fact_id", "temporal_status")


T2 = "WITH p AS (" + plain(PERIODS) + """)
SELECT fact_id, CASE WHEN variant = 4 THEN 'unknown' WHEN variant <> 3 AND fact_id % 2 = 0 AND iso = '1998-08-02' THEN 'current'
  WHEN variant = 3 AND cast(fact_date AS int) < 1998 THEN 'historical' WHEN variant <> 3 AND iso <= '1998-08-02' THEN 'historical' ELSE 'unknown' END AS temporal_status
FROM p
"""

#: Claims of documents: eight variants, one for each quality code and one accepted.
QUALITY = """
SELECT doc_id AS fact_id, doc_id % 8 AS variant, concat('Firm ', translate(cast(doc_id % 50 AS string), '0123456789', 'ABCDEFGHIJ'), ' Ltd') AS subject, source
FROM {documents}
"""
QUALITY_CODES = {0: None, 1: "identity_not_business_fact", 2: "non_declarative_claim", 3: "weak_fragment", 4: "non_atomic_claim", 5: "subject_not_stated", 6: "structured_value_not_in_excerpt", 7: "dated_event_date_missing"}


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sql(spark, sf_dir, QUALITY)
    body = F.concat(F.col("subject"), F.lit(" provides measuring tools to many schools"))
    e = (
        F.when(F.col("variant") == 2, F.concat(body, F.lit("?"))).when(F.col("variant") == 3, F.concat(F.col("subject"), F.lit(" tools"))).when(F.col("variant") == 4, F.concat(body, F.lit(". It also sells many books.")))
        .when(F.col("variant") == 5, F.lit("Another house provides measuring tools to many schools")).otherwise(F.concat(body, F.lit(".")))
    )
    return d.withColumns({
        "excerpt": e, "category": F.when(F.col("variant") == 1, "identity").when(F.col("variant") == 7, "event").otherwise("activity"), "entity_type": F.lit("company"),
        "normalized_value": F.when(F.col("variant") == 6, "ninety").cast("string"), "fact_date": F.lit(None).cast("string"), "fact_period_label": F.lit(None).cast("string"),
    })


def q1_claim_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.claim_quality(f.fact_period(_quality(spark, sf_dir))).select("fact_id", "code")


Q1 = "SELECT doc_id AS fact_id, (CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in QUALITY_CODES.items() if v) + " END) AS code FROM documents"


def q3_grounded_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _quality(spark, sf_dir).withColumns({"scope_label": F.col("subject"), "unit": F.lit(None).cast("string"), "category": F.when(F.col("variant") == 6, "metric").otherwise(F.col("category"))})
    return f.grounded_quality(d).select("fact_id")


Q3 = "SELECT doc_id AS fact_id FROM documents WHERE doc_id % 8 NOT IN (1, 2, 6)"


def q4_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = f.claim_quality(f.fact_period(_quality(spark, sf_dir))).select(F.col("source").alias("stage"), "code")
    return f.funnel(d)


Q4 = "WITH d AS (SELECT source AS stage, coalesce((CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in QUALITY_CODES.items() if v) + """ END), 'accepted') AS code FROM documents)
SELECT stage, code, count(*)::BIGINT AS n FROM d GROUP BY ROLLUP (stage, code)
"""

MERGE = """
SELECT source AS request_id, doc_id AS ord, cast(doc_id AS string) AS fact_id, 'activity' AS category, 'company' AS scope_type, source AS scope_label, 'x' AS fact_date, NULL AS fact_period_label,
  NULL AS normalized_value, 'activity' AS predicate, NULL AS unit, NULL AS currency, concat('https://', source, '.example.com/', cast(doc_id AS string)) AS url, text AS excerpt
FROM {documents}
"""


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sql(spark, sf_dir, MERGE)
    return d.withColumns({c: F.col(c).cast("string") for c in ("fact_period_label", "normalized_value", "unit", "currency")})


def d1_dedupe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dedupe_facts(_merge(spark, sf_dir)).select("request_id", "fact_id", "n_duplicates", "n_proofs")


VISIBLE = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \t\x0b\f]+', ' ', 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))"
D1 = rf"""
WITH k AS (SELECT source, doc_id, text, rtrim(regexp_replace(trim(lower(regexp_replace({VISIBLE}, '\s+', ' ', 'g'))), '\.$', '')) AS key FROM documents)
SELECT source AS request_id, cast(arg_min(doc_id, length(text) * 10000000000 + doc_id) AS VARCHAR) AS fact_id, (count(*) - 1)::BIGINT AS n_duplicates, count(*)::BIGINT AS n_proofs
FROM k GROUP BY source, key
"""


#: Each document states a fact twice, under two categories and with another spelling; metrics share keys across texts.
CATEGORIES = """
SELECT source AS request_id, 2 * doc_id + n AS ord, concat(cast(doc_id AS string), '-', cast(n AS string)) AS fact_id,
  element_at(array('activity', 'event', 'role', 'metric'), cast((doc_id + n * (doc_id % 3)) % 4 + 1 AS int)) AS category, concat('p', cast(doc_id % 5 AS string)) AS predicate,
  'company' AS scope_type, lang AS scope_label, NULL AS fact_period_label, cast(2020 + doc_id % 2 AS string) AS fact_date, CASE WHEN doc_id % 7 = 0 THEN 'v' END AS normalized_value,
  'million' AS unit, 'EUR' AS currency, concat('https://', source, '.example.com/', cast(doc_id % 40 AS string)) AS url,
  CASE n WHEN 0 THEN text ELSE concat(upper(text), '  .') END AS excerpt
FROM {documents} LATERAL VIEW explode(array(0, 1)) t AS n
"""


def merge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sql(spark, sf_dir, CATEGORIES)
    return d.withColumn("fact_period_label", F.col("fact_period_label").cast("string"))


def d1_merge_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dedupe_facts(merge_facts(spark, sf_dir)).select("request_id", "fact_id", "ord", "n_duplicates", "n_proofs")


def d2_cap_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.cap_facts(_merge(spark, sf_dir)).select("request_id", "fact_id", "n_truncated")


D2 = """
SELECT source AS request_id, cast(doc_id AS VARCHAR) AS fact_id, greatest(n - 6, 0)::BIGINT AS n_truncated
FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= 6
"""


def d4_needs_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 7 == 0, "ambiguous").otherwise("resolved").alias("status"), (F.col("c_custkey") % 3).alias("n_candidates"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("request_id"), F.concat(F.lit("https://example.com/"), "o_orderpriority").alias("url"))
    return f.needs_supplement(r, o)


D4 = """
WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS u FROM orders GROUP BY 1)
SELECT c_custkey AS request_id, c_custkey % 7 <> 0 AND c_custkey % 3 = 1 AND (coalesce(n, 0) < 3 OR coalesce(u, 0) < 2) AS needs
FROM customer LEFT JOIN o ON o_custkey = c_custkey
"""


def d5_build_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("lang").alias("subject_key"), F.lit("company").alias("scope_type"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), (F.col("doc_id") % 9).cast("string")).alias("final_url"),
        (F.col("doc_id") % 2 == 0).alias("direct"), (F.col("source") == "src0").alias("identity_publisher"))
    return f.build_sources(p)


D5 = """
SELECT sha256(lang || '|company|' || u) AS source_id, lang AS subject_key, 'company' AS scope_type, u AS final_url, 'example.com' AS publisher,
  CASE WHEN bool_or(doc_id % 2 = 0 AND source = 'src0') THEN 'official_publication' ELSE 'search_result' END AS kind
FROM (SELECT *, 'https://www.' || source || '.example.com/' || (doc_id % 9) AS u FROM documents) GROUP BY lang, u
"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("claim_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("category"),
        F.concat(F.lit("https://"), "event_type", F.lit(".example.com/a?utm_source=x&n="), (F.col("event_id") % 3).cast("string")).alias("url"),
        F.when(F.col("event_id") % 5 == 0, "contradiction").otherwise("confirmation").alias("state"))


def g3_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    r = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("request_id")).distinct()
    r = r.withColumns({"resolved": F.col("request_id") % 5 != 0, "n_contradictions": (F.col("request_id") % 4 == 0).cast("long"), "n_scope_violations": (F.col("request_id") % 6 == 0).cast("long"), "n_unknowns": (F.col("request_id") % 7 == 0).cast("long")})
    return f.completeness(r, c).select("request_id", "n_claims", "n_categories", "n_pages", "n_publishers", "status", "reasons")


G3 = """
WITH r AS (SELECT DISTINCT user_id FROM events),
c AS (
  SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k, count(DISTINCT event_type || (event_id % 3)) AS p
  FROM events GROUP BY 1),
j AS (SELECT r.user_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(p, 0) AS p, CASE WHEN coalesce(k, 0) > 0 THEN 1 ELSE 0 END AS d FROM r LEFT JOIN c USING (user_id)),
z AS (
  SELECT *, array_to_string(list_filter([CASE WHEN user_id % 5 = 0 THEN 'identity_unresolved' END, CASE WHEN n NOT BETWEEN 3 AND 6 THEN 'business_claim_count_out_of_range' END,
    CASE WHEN k < 2 THEN 'business_category_diversity_missing' END, CASE WHEN p < 2 THEN 'canonical_page_diversity_missing' END, 'publisher_domain_diversity_missing',
    CASE WHEN user_id % 4 = 0 THEN 'visible_contradiction' END, CASE WHEN user_id % 6 = 0 THEN 'subject_scope_violation' END, CASE WHEN user_id % 7 = 0 THEN 'critical_unknown' END], lambda v: v IS NOT NULL), ',') AS reasons FROM j)
SELECT user_id AS request_id, n::BIGINT AS n_claims, k::BIGINT AS n_categories, p::BIGINT AS n_pages, d::BIGINT AS n_publishers, 'partial' AS status, reasons FROM z
"""


def g6_pick_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.pick_summary(_claims(spark, sf_dir)).select("request_id", "claim_id", F.col("position").cast("long").alias("position"))


G6 = """
WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS later FROM events WHERE event_id % 5 <> 0)
SELECT user_id AS request_id, event_id AS claim_id, r AS position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY later, event_id) AS r FROM c) WHERE r <= 3
"""


def i1_match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("request_id"), F.concat(F.lit("Firm "), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(" Ltd")).alias("name"))
    c = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("candidate_key"), F.concat(F.lit("FIRM  "), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.when(F.col("s_suppkey") % 5 == 0, " SA").otherwise(" Ltd")).alias("display_name"))
    return f.match_names(r, c)


I1 = "SELECT s_suppkey AS request_id, s_suppkey AS candidate_key FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 <> 0"


def i6_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", (F.col("doc_id") % 40).alias("topic"), F.concat(F.lit("https://"), "source", F.lit(".com/a")).alias("url"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lower(F.col("source")).alias("excerpt"))
    return f.independent(d, ["lang", "topic"])


I6 = """
SELECT lang, doc_id % 40 AS topic, count(DISTINCT source)::BIGINT AS n_publishers, count(DISTINCT text)::BIGINT AS n_digests, count(DISTINCT source)::BIGINT AS n_excerpts,
  count(DISTINCT source) >= 2 AND count(DISTINCT text) >= 2 AS independent
FROM documents GROUP BY 1, 2
"""


def i14_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "official_site").when(F.col("event_type") == "click", "city").when(F.col("event_type") == "view", "country").when(F.col("event_type") == "signup", "employer").otherwise("role")
    s = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("request_id"), (F.col("event_id") % 3).alias("candidate_key"), kind.alias("kind"), F.when(F.col("event_type").isin("purchase", "signup"), "strong").otherwise("medium").alias("strength"))
    return f.rank_candidates(s).select("request_id", "candidate_key", F.col("priority").cast("long").alias("priority"), F.col("position").cast("long").alias("position"), "wins")


I14 = """
WITH g AS (
  SELECT user_id, event_id % 3 AS c, sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'signup' THEN 4 ELSE 2 END) AS p,
    bool_or(event_type IN ('purchase', 'signup')) AS strong, count(DISTINCT CASE WHEN event_type NOT IN ('purchase', 'signup') THEN event_type END) AS medium
  FROM events GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, c) AS r, lead(p) OVER (PARTITION BY user_id ORDER BY p DESC, c) AS nx FROM g)
SELECT user_id AS request_id, c AS candidate_key, p::BIGINT AS priority, r AS position, r = 1 AND p - coalesce(nx, 0) >= 2 AND (strong OR medium >= 2) AS wins FROM w
"""

QUERIES = {g.__name__: g for g in (
    t1_fact_period, t2_temporal_status, q1_claim_quality, q3_grounded_quality, q4_funnel, d1_dedupe_facts, d1_merge_categories, d2_cap_facts, d4_needs_supplement, d5_build_sources, g3_completeness, g6_pick_summary,
    i1_match_names, i6_independent, i14_rank_candidates)}
ORACLES = {
    "t1_fact_period": T1, "t2_temporal_status": T2, "q1_claim_quality": Q1, "q3_grounded_quality": Q3, "q4_funnel": Q4, "d1_dedupe_facts": D1, "d2_cap_facts": D2, "d4_needs_supplement": D4,
    "d5_build_sources": D5, "g3_completeness": G3, "g6_pick_summary": G6, "i1_match_names": I1, "i6_independent": I6, "i14_rank_candidates": I14,
}
