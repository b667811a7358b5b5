"""Inputs derived from the given tables by SQL that Spark and the comparing engine both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: Digit-free subject names with a legal suffix.
SUBJECT = "concat('Firm ', translate(cast({k} as string), '0123456789', 'ABCDEFGHIJ'), ' Ltd')"

SUPPLIER_YEARS = """
SELECT l_suppkey, y, flag, v,
  concat('Firm ', translate(cast(l_suppkey AS string), '0123456789', 'ABCDEFGHIJ'), ' Ltd') AS subject
FROM (
  SELECT l_suppkey, year(l_shipdate) AS y, l_returnflag AS flag,
    cast(round(cast(sum(cast(l_extendedprice AS decimal(18, 2)) * (1 - cast(l_discount AS decimal(18, 2)))) AS decimal(28, 4)) / 1000000, 1) AS decimal(18, 1)) AS v
  FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), l_returnflag) s
WHERE v > 0
"""

METRIC_FACTS = f"""
SELECT concat('f-', cast(l_suppkey AS string), '-', cast(y AS string), '-', flag) AS fact_id, 'r-1' AS request_id, cast(l_suppkey AS string) AS subject_key,
  y * 10 + CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS ord, 'metric' AS category, 'revenue' AS predicate, 'company' AS scope_type, subject AS scope_label,
  cast(y AS string) AS fact_date,
  concat(CASE WHEN l_suppkey % 6 = 1 THEN 'fiscal year ' ELSE 'calendar year ' END, cast(y AS string)) AS fact_period_label,
  cast(v AS string) AS normalized_value, 'million' AS unit, CASE WHEN l_suppkey % 6 = 4 THEN 'USD' ELSE 'EUR' END AS currency, 'revenue' AS contradiction_key,
  concat(subject, CASE WHEN l_suppkey % 6 = 2 THEN ' estimated' ELSE ' reported' END, ' revenue of ', CASE WHEN l_suppkey % 6 = 3 THEN 'about ' ELSE '' END, cast(v AS string), ' million ',
    CASE WHEN l_suppkey % 6 = 4 THEN 'USD' ELSE 'EUR' END, CASE WHEN l_suppkey % 6 = 1 THEN ' in fiscal year ' ELSE ' in calendar year ' END, cast(y AS string)) AS excerpt,
  concat('https://', lower(flag), '.example.com/', cast(l_suppkey AS string), '/', cast(y AS string)) AS url,
  CASE WHEN l_suppkey % 6 = 5 THEN concat('d-', cast(l_suppkey AS string)) ELSE concat('d-', cast(l_suppkey AS string), '-', flag) END AS digest,
  v AS true_value, y AS true_year, l_suppkey % 6 AS variant, l_suppkey AS supp
FROM ({SUPPLIER_YEARS}) x
"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a derivation on the tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """The same derivation for an engine that has the tables as views."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
