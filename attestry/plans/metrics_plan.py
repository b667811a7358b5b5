"""Queries over metric sentences built from lineitem: parsed by the engine, checked against the numbers themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import numbers as num
from attestry.operators import metrics as m
from attestry.plans.fixtures import METRIC_FACTS, plain, sql
from attestry.sources.tables import settled


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, METRIC_FACTS)


FACTS = "WITH facts AS (" + plain(METRIC_FACTS) + ")"


def n1_metric_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("fact_id", num.metric_value(F.col("excerpt")).alias("value"))


N1 = FACTS + " SELECT fact_id, cast(true_value AS double) * 1000000 AS value FROM facts"


def n2_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.observe_metrics(_facts(spark, sf_dir)).select("fact_id", *[F.col(f"obs.{c}").alias(c) for c in ("metric", "definition", "currency", "scale", "scope_kind", "value", "period_key", "nature")])


N2 = FACTS + """
SELECT fact_id, CASE WHEN variant <> 3 THEN 'revenue' END AS metric, CASE WHEN variant <> 3 THEN 'standard' END AS definition,
  CASE WHEN variant <> 3 THEN currency END AS currency, CASE WHEN variant <> 3 THEN 'million' END AS scale, CASE WHEN variant <> 3 THEN 'entity' END AS scope_kind,
  CASE WHEN variant <> 3 THEN cast(true_value AS double) * 1000000 END AS value,
  CASE WHEN variant <> 3 THEN cast(true_year AS string) || CASE WHEN variant = 1 THEN '|fiscal' ELSE '|calendar' END END AS period_key,
  CASE WHEN variant <> 3 THEN (CASE WHEN variant = 2 THEN 'estimated' ELSE 'published' END) END AS nature
FROM facts
"""


def n3_value_nature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("fact_id", num.value_nature(F.col("excerpt")).alias("nature"))


N3 = FACTS + " SELECT fact_id, CASE WHEN variant = 2 THEN 'estimated' ELSE 'published' END AS nature FROM facts"


def n4_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    wrong = f.withColumn("currency", F.when(F.col("true_year") % 5 == 0, "GBP").otherwise(F.col("currency")))
    return m.metric_signature(wrong).select("fact_id", F.col("sig").isNotNull().alias("agrees"))


N4 = FACTS + " SELECT fact_id, variant <> 3 AND true_year % 5 <> 0 AS agrees FROM facts"

PAIRS = FACTS + """,
sure AS (SELECT * FROM facts),
pairs AS (
  SELECT a.request_id, a.subject_key, a.fact_id AS left_id, b.fact_id AS right_id, a.supp,
    CASE WHEN a.variant = 3 THEN 'indetermination' WHEN a.true_year <> b.true_year THEN 'explainable_difference'
      WHEN a.true_value = b.true_value THEN 'confirmation' ELSE 'contradiction' END AS relationship,
    a.flag_ AS lf, b.flag_ AS rf, a.digest AS ld, b.digest AS rd
  FROM (SELECT *, right(fact_id, 1) AS flag_ FROM sure) a JOIN (SELECT *, right(fact_id, 1) AS flag_ FROM sure) b
    ON a.request_id = b.request_id AND a.subject_key = b.subject_key AND a.ord < b.ord)"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with signatures, parsed once by all cores: a few long expressions a row, so rows are dealt out first."""
    f = _facts(spark, sf_dir)
    return settled(m.metric_signature(f.repartition(spark.sparkContext.defaultParallelism)), "metric-facts")


def n5_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.compare_metrics(_signed(spark, sf_dir)).select("left_id", "right_id", "relationship")


N5 = PAIRS + " SELECT left_id, right_id, relationship FROM pairs"


def _independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _signed(spark, sf_dir)
    return m.independent_pairs(m.compare_metrics(f), f.select("fact_id", "url", "digest"))


def n6_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _independent(spark, sf_dir).select("left_id", "right_id", "independent", "relationship")


INDEPENDENT = PAIRS + """,
ind AS (
  SELECT *, ld <> rd AS independent,
    CASE WHEN relationship = 'contradiction' AND ld = rd THEN 'indetermination' ELSE relationship END AS settled FROM pairs)"""
N6 = INDEPENDENT + " SELECT left_id, right_id, independent, settled AS relationship FROM ind"


def n7_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _signed(spark, sf_dir)
    return m.reconcile_facts(f, f.select("fact_id", "url", "digest"))


N7 = INDEPENDENT + """,
sides AS (SELECT left_id AS fact_id, settled FROM ind UNION ALL SELECT right_id, settled FROM ind),
worst AS (
  SELECT fact_id, max(CASE settled WHEN 'confirmation' THEN 1 WHEN 'explainable_difference' THEN 2 WHEN 'indetermination' THEN 3 ELSE 4 END) AS r FROM sides GROUP BY fact_id)
SELECT fact_id, (['confirmation', 'explainable_difference', 'indetermination', 'contradiction'])[r] AS state FROM worst
"""


def _groups(f: DataFrame) -> DataFrame:
    return m.conflict_groups(f, m.reconcile_facts(f, f.select("fact_id", "url", "digest")))


def n8_conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(_signed(spark, sf_dir)).select("subject_key", "period_key", "currency", "n_facts", "n_values", "n_pages", "n_digests", "unit")


N8 = FACTS + """
SELECT subject_key, cast(true_year AS string) || CASE WHEN max(variant) = 1 THEN '|fiscal' ELSE '|calendar' END AS period_key, max(currency) AS currency,
  count(*)::BIGINT AS n_facts, count(DISTINCT true_value)::BIGINT AS n_values, count(DISTINCT url)::BIGINT AS n_pages, count(DISTINCT digest)::BIGINT AS n_digests, 'million' AS unit
FROM facts WHERE variant NOT IN (3, 5) GROUP BY subject_key, true_year HAVING count(DISTINCT true_value) >= 2
"""


def n9_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _signed(spark, sf_dir)
    g = settled(_groups(f), "conflicts")
    v = m.conflict_versions(f, g).join(g.select("conflict_id", "subject_key", "period_key"), "conflict_id")
    return v.select("subject_key", "period_key", "version", "fact_id", "value")


N9 = FACTS + """,
g AS (SELECT subject_key, true_year FROM facts WHERE variant NOT IN (3, 5) GROUP BY subject_key, true_year HAVING count(DISTINCT true_value) >= 2)
SELECT subject_key, cast(true_year AS string) || CASE WHEN variant = 1 THEN '|fiscal' ELSE '|calendar' END AS period_key,
  row_number() OVER (PARTITION BY subject_key, true_year ORDER BY ord) - 1 AS version, fact_id, cast(true_value AS double) * 1000000 AS value
FROM facts JOIN g USING (subject_key, true_year)
"""


def t3_period_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("fact_id", num.period_key(F.col("excerpt")).alias("period_key"))


T3 = FACTS + " SELECT fact_id, cast(true_year AS string) || CASE WHEN variant = 1 THEN '|fiscal' ELSE '|calendar' END AS period_key FROM facts"

QUERIES = {f.__name__: f for f in (n1_metric_value, n2_observe, n3_value_nature, n4_signature, n5_compare, n6_independent, n7_reconcile, n8_conflict_groups, n9_contradictions, t3_period_key)}
ORACLES = {"n1_metric_value": N1, "n2_observe": N2, "n3_value_nature": N3, "n4_signature": N4, "n5_compare": N5, "n6_independent": N6, "n7_reconcile": N7, "n8_conflict_groups": N8, "n9_contradictions": N9, "t3_period_key": T3}
