"""Queries over page URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import urls as u
from attestry.operators import web


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def u1_admit_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.admit_urls(_pages(spark, sf_dir).select("page_id", "url"), "url").select("page_id", "admitted", "reason", "safe_href", "removed")


U1 = r"""
SELECT page_id, url LIKE 'https://%' AS admitted, CASE WHEN url LIKE 'https://%' THEN NULL ELSE 'not_https' END AS reason,
  CASE WHEN url LIKE 'https://%' THEN replace(replace(split_part(url, '#', 1), '?utm_source=feed', ''), '&utm_source=feed', '') END AS safe_href,
  CASE WHEN url LIKE 'https://%' THEN (CASE WHEN url LIKE '%utm_source=%' THEN 1 ELSE 0 END) END AS removed
FROM pages
"""


def u2_sensitive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["q", "accessToken", "page%5Fkey", "X-Amz-Signature", "caf%C3%A9", "a%2525b", "monkey", "sessionId", "id_token", "ref", "lang", "api.key", "%E0%A4%A"]))
    rows = _pages(spark, sf_dir).select("page_id", F.get(names, (F.col("page_id") % 13).cast("int")).alias("name"))
    d = rows.withColumn("url", F.concat(F.lit("https://www.example.com/a?x=1&"), "name", F.lit("=v")))
    return web.flag_sensitive_query(d, "url").select("page_id", "name", "sensitive")


U2 = """
SELECT page_id, n AS name, n NOT IN ('q', 'monkey', 'ref', 'lang') AS sensitive
FROM (SELECT page_id, (['q', 'accessToken', 'page%5Fkey', 'X-Amz-Signature', 'caf%C3%A9', 'a%2525b', 'monkey', 'sessionId', 'id_token', 'ref', 'lang', 'api.key', '%E0%A4%A'])[page_id % 13 + 1] AS n FROM pages)
"""


def u3_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.url_keys(_pages(spark, sf_dir).select("page_id", "url"), "url").select("page_id", "attributable_key", "canonical_page", "conflict_page_key", "publisher_domain")


U3 = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
    regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '^(https?)', 1) AS s FROM pages),
k AS (
  SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS kept,
    CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END AS short, list_filter(string_split(regexp_replace(h, '^www\.', ''), '.'), lambda x: x <> '') AS labels FROM p)
SELECT page_id,
  CASE WHEN s = 'https' THEN 'https://' || h || short || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END AS attributable_key,
  s || '://' || h || short || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_page,
  CASE WHEN s = 'https' THEN 'https://' || h || CASE WHEN path = '' THEN '/' ELSE path END END AS conflict_page_key,
  CASE WHEN len(labels) <= 2 THEN array_to_string(labels, '.') ELSE array_to_string(labels[-2:], '.') END AS publisher_domain
FROM k
"""

EDGES = """
SELECT concat('https://p', cast(page_id AS string), '.example.com/') AS from_url,
  CASE WHEN page_id % 40 = 0 THEN concat('https://p', cast(page_id AS string), '.example.com/')
    WHEN page_id % 40 = 8 THEN concat('http://p', cast(page_id + 1 AS string), '.example.com/')
    ELSE concat('https://p', cast(page_id + 1 AS string), '.example.com/') END AS to_url
FROM {pages} WHERE page_id % 4 = 0 OR page_id % 20 IN (9, 10, 11)
"""


def u4_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.plans.fixtures import sql

    start = sql(spark, sf_dir, "SELECT page_id, concat('https://p', cast(page_id AS string), '.example.com/') AS url FROM {pages}")
    return web.resolve_redirects(start, sql(spark, sf_dir, EDGES)).select("page_id", "final_url", "hops", "code")


U4 = """
WITH e AS (""" + EDGES.replace("{pages}", "pages") + """),
s AS (SELECT page_id, concat('https://p', cast(page_id AS string), '.example.com/') AS u0 FROM pages),
j AS (
  SELECT page_id, u0, e1.to_url AS u1, e2.to_url AS u2, e3.to_url AS u3
  FROM s LEFT JOIN e e1 ON e1.from_url = u0
  LEFT JOIN e e2 ON e2.from_url = e1.to_url LEFT JOIN e e3 ON e3.from_url = e2.to_url),
c AS (
  SELECT *, CASE
    WHEN u1 IS NULL THEN NULL
    WHEN u1 LIKE 'http:%' THEN 'redirect_rejected' WHEN u1 = u0 THEN 'redirect_loop'
    WHEN u2 IS NULL THEN NULL
    WHEN u2 LIKE 'http:%' THEN 'redirect_rejected' WHEN u2 IN (u0, u1) THEN 'redirect_loop'
    WHEN u3 IS NOT NULL THEN 'redirect_limit' END AS code FROM j)
SELECT page_id, CASE WHEN code IS NULL THEN coalesce(u2, u1, u0) END AS final_url,
  CASE WHEN code IS NULL THEN (CASE WHEN u1 IS NULL THEN 0 WHEN u2 IS NULL THEN 1 ELSE 2 END) END AS hops, code
FROM c
"""

ANSWERS = """
SELECT concat('h', cast(page_id % 50 AS string), '.example.com') AS host, 4 AS family,
  CASE WHEN page_id % 10 = 5 THEN concat('10.0.0.', cast(page_id % 250 AS string))
    WHEN page_id % 10 = 7 THEN concat('172.', cast(16 + page_id % 20 AS string), '.1.1')
    ELSE concat(cast(20 + page_id % 60 AS string), '.', cast(page_id % 200 AS string), '.3.4') END AS address
FROM {pages}
"""


def u5_screen_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.plans.fixtures import sql

    return web.screen_hosts(sql(spark, sf_dir, ANSWERS))


U5 = "WITH a AS (" + ANSWERS.replace("{pages}", "pages") + """),
n AS (
  SELECT host, address, cast(split_part(address, '.', 1) AS int) AS b1, cast(split_part(address, '.', 2) AS int) AS b2, cast(split_part(address, '.', 3) AS int) AS b3, cast(split_part(address, '.', 4) AS int) AS b4 FROM a)
SELECT host, count(*)::BIGINT AS n_answers, bool_and(NOT (b1 = 10 OR (b1 = 172 AND b2 BETWEEN 16 AND 31))) AS public,
  CASE WHEN bool_and(NOT (b1 = 10 OR (b1 = 172 AND b2 BETWEEN 16 AND 31))) THEN min_by(address, ((b1::BIGINT * 256 + b2) * 256 + b3) * 256 + b4) END AS address
FROM n GROUP BY host
"""


def u6_urls_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pages(spark, sf_dir).select("page_id", "url", F.regexp_replace(F.col("url"), "#.*$", "").alias("cited"))
    d = d.withColumn("cited", F.when(F.col("page_id") % 3 == 0, F.concat("cited", F.lit("#part"))).when(F.col("page_id") % 3 == 1, F.concat("cited", F.lit("/x"))).otherwise(F.col("cited")))
    return web.urls_agree(d, "cited", "url").select("page_id", "agree")


U6 = "SELECT page_id, url LIKE 'https://%' AND (page_id % 3 <> 1 OR url LIKE '%?utm_source=feed%') AS agree FROM pages"


def u7_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", u.url_words(F.col("url")).alias("words"))


U7 = r"""
SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || ' ' ||
  CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END,
  '[-_.]+', ' ', 'g'), '[/\s]+', ' ', 'g')) AS words
FROM pages
"""

QUERIES = {f.__name__: f for f in (u1_admit_urls, u2_sensitive_query, u3_url_keys, u4_redirects, u5_screen_hosts, u6_urls_agree, u7_url_words)}
ORACLES = {"u1_admit_urls": U1, "u2_sensitive_query": U2, "u3_url_keys": U3, "u4_redirects": U4, "u5_screen_hosts": U5, "u6_urls_agree": U6, "u7_url_words": U7}
