"""Queries over texts: forms, profiles, mirrors, blocks, evidence location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.operators import evidence as ev
from attestry.plans.fixtures import plain, sql
from attestry.sources.tables import dealt, settled


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


VISIBLE = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \t\x0b\f]+', ' ', 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))"


def x1_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(x.visible_text(F.col("text")).cast("binary"), 256).alias("digest"))


X1 = f"SELECT doc_id, sha256({VISIBLE}) AS digest FROM documents"


def x2_mechanical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(x.mechanical_key(F.col("text")).cast("binary"), 256).alias("digest"))


X2 = rf"SELECT doc_id, sha256(rtrim(regexp_replace(trim(lower(regexp_replace({VISIBLE}, '\s+', ' ', 'g'))), '\.$', ''))) AS digest FROM documents"


def x3_conflict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(x.conflict_text(F.col("text")).cast("binary"), 256).alias("digest"))


X3 = r"SELECT doc_id, sha256(lower(trim(regexp_replace(strip_accents(coalesce(text, '')), '\s+', ' ', 'g')))) AS digest FROM documents"


def x4_context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = x.context_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


X4 = r"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS t FROM documents)
"""


def x5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ev.blocks(_docs(spark, sf_dir).select("doc_id", x.visible_text(F.col("text")).alias("text")), "doc_id")
    return b.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.max(F.length("line")).cast("long").alias("longest"), F.min("line").alias("first_line"))


X5 = f"""
SELECT doc_id, count(*)::BIGINT AS n_blocks, max(length(l))::BIGINT AS longest, min(l) AS first_line
FROM (SELECT doc_id, unnest(string_split({VISIBLE}, chr(10))) AS l FROM documents) WHERE l <> '' GROUP BY doc_id
"""


def x6_sequence_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.split(F.lower("text"), " ")
    return _docs(spark, sf_dir).where("lang = 'en'").select("doc_id", F.size(x.sequence_starts(t, F.array(F.lit("of"), F.lit("the")))).cast("long").alias("n"))


X6 = """
SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))::BIGINT AS n
FROM (SELECT doc_id, string_split(lower(text), ' ') AS t FROM documents WHERE lang = 'en')
"""


def x6_sequence_starts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As x6_sequence_starts, over the documents of every language and of none."""
    t = F.split(F.lower("text"), " ")
    return _docs(spark, sf_dir).select("doc_id", F.size(x.sequence_starts(t, F.array(F.lit("of"), F.lit("the")))).cast("long").alias("n"))


X6_ALL = """
SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))::BIGINT AS n
FROM (SELECT doc_id, string_split(lower(text), ' ') AS t FROM documents)
"""


def x7_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.mirrors(_docs(spark, sf_dir), "doc_id", "text", "source")


X7 = """
SELECT sha256(coalesce(text, '')) AS digest, count(*)::BIGINT AS n_texts, count(DISTINCT source)::BIGINT AS n_publishers, min(doc_id) AS first_key
FROM documents GROUP BY 1 HAVING count(*) > 1
"""


def x8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = x.profile(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", *[p[c].alias(c) for c in ("code_points", "words", "letters", "separators", "question")])


X8 = rf"""
SELECT doc_id, length(v)::BIGINT AS code_points, len(regexp_extract_all(v, '[\p{{L}}\p{{N}}]+'))::BIGINT AS words,
  length(regexp_replace(v, '[^\p{{L}}]', '', 'g'))::BIGINT AS letters, length(regexp_replace(v, '[^|/•·:;+_-]', '', 'g'))::BIGINT AS separators,
  regexp_matches(v, '[?？]\s*$') AS question
FROM (SELECT doc_id, {VISIBLE} AS v FROM documents)
"""


def x9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(x.masked(F.col("text"))).cast("long").alias("n"))


X9 = """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(secret|token|api[_-]?key|authorization|password|credential|signature|bearer|sk-[a-z0-9_-]+)') THEN 0 ELSE length(text) END::BIGINT AS n
FROM documents
"""

#: One claim a document: its first line, in eight variants.
CLAIM_PAGES = """
SELECT doc_id AS page_id, concat('Firm ', translate(cast(doc_id % 50 AS string), '0123456789', 'ABCDEFGHIJ'), ' Ltd provides number ', translate(cast(doc_id AS string), '0123456789', 'KLMNOPQRST'), ' to all.') AS line,
  doc_id % 8 AS variant, text AS rest
FROM {documents}
"""
CLAIMS = f"""
SELECT page_id AS claim_id, page_id, variant,
  CASE variant WHEN 1 THEN upper(line) WHEN 2 THEN replace(line, ' to all', concat(chr(8239), 'to all')) WHEN 3 THEN substr(line, 3) WHEN 4 THEN concat('No ', line) WHEN 6 THEN '' ELSE line END AS excerpt,
  CASE WHEN variant = 7 THEN 'ne: ' END AS prefix, CASE WHEN variant = 7 THEN ' end' END AS suffix,
  CASE variant WHEN 5 THEN concat(line, chr(10), line) WHEN 7 THEN concat(line, ' and one: ', line, ' end') ELSE line END AS text, line
FROM ({CLAIM_PAGES}) c
"""


def j1_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sql(spark, sf_dir, CLAIMS.replace("chr(8239)", "' '").replace("chr(10)", "'\\n'"))
    return ev.locate(d.select("claim_id", "page_id", "excerpt", "prefix", "suffix"), d.select("page_id", "text")).select("claim_id", "code", "match_mode", "start", "end", "occurrence", "verified")


J1 = "WITH c AS (" + plain(CLAIMS) + """)
SELECT claim_id, CASE WHEN variant IN (3, 4, 6) THEN 'source_excerpt_missing' WHEN variant = 5 THEN 'source_excerpt_ambiguous' END AS code,
  CASE variant WHEN 0 THEN 'exact' WHEN 2 THEN 'exact' WHEN 7 THEN 'exact' WHEN 1 THEN 'mechanical_equivalence' END AS match_mode,
  CASE WHEN variant IN (0, 1, 2) THEN 0 WHEN variant = 7 THEN length(line) + 10 END AS start,
  CASE WHEN variant IN (0, 1, 2) THEN length(line) WHEN variant = 7 THEN 2 * length(line) + 10 END AS "end",
  CASE WHEN variant IN (0, 1, 2) THEN 0 WHEN variant = 7 THEN 1 END AS occurrence,
  CASE WHEN variant IN (0, 1, 2, 7) THEN line END AS verified
FROM c
"""


def j1_locate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head sentences, each in its whole document, and benchmark items in the documents that hold them. No SQL: see tests/test_rules.py."""
    return locate_in_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def locate_in_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    page = settled(dealt(docs.select("doc_id", "text")).select(F.col("doc_id").alias("page_id"), x.visible_text(F.col("text")).alias("text")), "pages")
    heads = page.select(F.lit("head").alias("kind"), F.lit(None).cast("long").alias("claim_id"), "page_id", F.regexp_extract("text", r"^[^\n]*?(?:[.!?](?= )|(?=\n)|$)", 0).alias("excerpt"))
    found = ev.search_excerpts(items, docs).select("doc_id", "item_id").join(items.select("item_id", "text"), "item_id")
    held = found.select(F.lit("item").alias("kind"), F.col("item_id").cast("long").alias("claim_id"), F.col("doc_id").alias("page_id"), F.col("text").alias("excerpt"))
    claims = heads.unionByName(held).withColumns({"prefix": none, "suffix": none})
    return ev.locate(claims, page).select("kind", "claim_id", "page_id", "code", "match_mode", "start", "end", "occurrence", "verified", "before", "after")


def j2_search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.search_excerpts(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _docs(spark, sf_dir))


J2 = f"""
WITH d AS (SELECT doc_id, {VISIBLE} AS t FROM documents), b AS (SELECT item_id, {VISIBLE} AS e FROM benchmark)
SELECT doc_id, item_id, (strpos(t, e) - 1)::BIGINT AS start FROM d JOIN b ON contains(t, e) WHERE e <> ''
"""

SPANS = """
SELECT concat(cast(conv_id AS string), '-', cast(turn AS string)) AS doc, turn AS claim_id, cast(length(text) % 37 AS int) AS start, cast(length(text) % 37 + length(text) % 11 AS int) AS end_, length(text) AS n
FROM {conversations} WHERE role = 'assistant'
"""


def j5_bind_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sql(spark, sf_dir, SPANS)
    claims = s.select("doc", "claim_id", "start", F.col("end_").alias("end"))
    cites = s.select("doc", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("citation_id")).select(
        "doc", "citation_id", (F.col("citation_id") * 15).alias("span_start"), (F.col("citation_id") * 15 + 20).alias("span_end"), F.concat(F.lit("https://example.com/"), "doc", F.lit("/"), F.col("citation_id").cast("string")).alias("url"))
    return ev.bind_spans(claims, cites).select("doc", "citation_id", "url", "code")


J5 = "WITH s AS (" + plain(SPANS) + """),
c AS (
  SELECT doc, start, end_, list_filter([0, 1, 2], lambda i: i * 15 <= start AND i * 15 + 20 >= end_) AS hits FROM s)
SELECT doc, CASE WHEN start < end_ AND len(hits) = 1 THEN hits[1] END AS citation_id,
  CASE WHEN start < end_ AND len(hits) = 1 THEN 'https://example.com/' || doc || '/' || hits[1] END AS url,
  CASE WHEN start >= end_ THEN 'span_invalid' WHEN len(hits) = 0 THEN 'citation_missing' WHEN len(hits) > 1 THEN 'citation_ambiguous' END AS code
FROM c
"""


CITATIONS = "SELECT doc, c AS citation_id, c * 15 AS span_start, CASE WHEN n % 7 = 0 AND c = 2 THEN n + 1 ELSE c * 15 + 20 END AS span_end, CASE WHEN claim_id % 11 = 0 THEN ' ' ELSE concat('https://example.com/', doc, '/', cast(c AS string)) END AS url, CASE WHEN n % 5 = 1 THEN NULL ELSE 'T' END AS title, CASE WHEN n % 3 = 0 THEN concat('s', cast(c AS string)) END AS source_id FROM (" + SPANS + ") s CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) k"
CITED = "SELECT doc, source_id, CASE WHEN citation_id = 1 THEN 'https://example.com/other' ELSE url END AS url FROM (" + CITATIONS + ") c WHERE source_id IS NOT NULL"


def j5_bind_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with titles and sources, over texts that some of them leave."""
    claims = sql(spark, sf_dir, SPANS).select("doc", "claim_id", "start", F.col("end_").alias("end"))
    texts = sql(spark, sf_dir, SPANS).select("doc", F.col("n").alias("n_chars"))
    return ev.bind_spans(claims, sql(spark, sf_dir, CITATIONS), sql(spark, sf_dir, CITED), texts).select("doc", "citation_id", "url", "code")


J5_CHECKED = "WITH s AS (" + plain(SPANS) + """),
c AS (SELECT *, list_filter([0, 1, 2], lambda i: i * 15 <= start AND i * 15 + 20 >= end_) AS hits FROM s),
k AS (SELECT *, CASE WHEN start >= end_ THEN 'span_invalid' WHEN n < 50 OR n % 7 = 0 THEN 'citation_out_of_bounds' WHEN len(hits) = 0 THEN 'citation_missing' WHEN len(hits) > 1 THEN 'citation_ambiguous' WHEN claim_id % 11 = 0 THEN 'source_url_missing'
  WHEN n % 3 = 0 AND hits[1] = 1 THEN 'source_unknown' WHEN n % 5 = 1 THEN 'title_missing' END AS code FROM c WHERE start IS NOT NULL)
SELECT doc, CASE WHEN code IS NULL THEN hits[1] END AS citation_id, CASE WHEN code IS NULL THEN 'https://example.com/' || doc || '/' || hits[1] END AS url, code FROM k
"""


def j6_bind_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("https://s.example.com/p/"), F.col("page_id").cast("string")).alias("base"))
    claims = p.select(F.lit("r").alias("request_id"), F.col("page_id").alias("claim_id"), F.concat("base", F.lit("/?utm_source=x#a")).alias("url"))
    kinds = F.array(*map(F.lit, ev.PRIORITY))
    b = p.where("page_id % 5 <> 0").select("page_id", "base", F.explode(F.sequence((F.col("page_id") % 4).cast("int"), F.lit(3))).alias("k"))
    b = b.select(F.lit("r").alias("request_id"), F.get(kinds, F.col("k")).alias("binding_type"), F.concat_ws("-", F.col("page_id").cast("string"), F.col("k").cast("string")).alias("binding_id"), F.col("k").alias("ord"), F.col("base").alias("url"))
    return ev.bind_urls(claims, b).select("claim_id", "binding_type", "binding_id", "code")


J6 = """
SELECT page_id AS claim_id, CASE WHEN page_id % 5 = 0 THEN 'structured_output' ELSE (['citation', 'direct_source', 'search_source', 'inspection'])[page_id % 4 + 1] END AS binding_type,
  CASE WHEN page_id % 5 <> 0 THEN page_id || '-' || (page_id % 4) END AS binding_id, NULL::VARCHAR AS code
FROM pages
"""


def s4_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_text, rejects = ev.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    none = F.lit(None).cast("string")
    return page_text.select("page_id", "safe_href", "title", none.alias("reason")).unionByName(rejects.select("page_id", none.alias("safe_href"), none.alias("title"), "reason"))


S4 = r"""
WITH p AS (SELECT page_id, html, url, replace(replace(split_part(url, '#', 1), '?utm_source=feed', ''), '&utm_source=feed', '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS page_id FROM p WHERE url LIKE 'https://%' GROUP BY h)
SELECT page_id, h AS safe_href,
  trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title, NULL AS reason
FROM p JOIN f USING (h, page_id)
UNION ALL SELECT page_id, NULL, NULL, 'not_https' FROM p WHERE url NOT LIKE 'https://%'
"""

#: One request an event, of thirty kinds: a search with sources, or none and an inspection; each rule is broken by a residue.
ACTION_CLAIMS = "SELECT event_id AS request_id, event_id AS claim_id, CASE WHEN event_id % 30 = 7 THEN 'http://a.example.com/p' WHEN event_id % 30 = 8 THEN 'https://a.example.com/other' ELSE 'https://a.example.com/p?utm_source=x' END AS url FROM {events}"
ACTION_CALLS = "SELECT event_id AS request_id, concat('c', cast(n AS string)) AS call_id FROM {events} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) k WHERE n = 0 OR event_id % 30 = 1"
ACTION_SOURCES = "SELECT event_id AS request_id, CASE n WHEN 0 THEN 'https://a.example.com/p' ELSE 'https://a.example.com/p/#x' END AS url FROM {events} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) k WHERE event_id % 30 < 10 AND (n = 0 OR event_id % 30 = 2)"
ACTIONS = "SELECT event_id AS request_id, CASE n WHEN 0 THEN 'c0' ELSE concat('o', cast(n AS string)) END AS call_id, CASE n WHEN 0 THEN 'search' WHEN 1 THEN 'open_page' ELSE 'find_in_page' END AS action_type FROM {events} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE (n = 0 AND event_id % 30 <> 10) OR (n = 1 AND event_id % 30 <> 11) OR (n = 2 AND event_id % 30 = 12)"
INSPECTIONS = """
SELECT event_id AS request_id, CASE WHEN event_id % 30 = 15 THEN 'o9' ELSE 'o1' END AS call_id, 'open_page' AS action_type, CASE event_id % 30 WHEN 19 THEN 'https://10.0.0.1/' WHEN 20 THEN 'https://a.example.com/q' ELSE 'https://a.example.com/p' END AS url,
  CASE event_id % 30 WHEN 16 THEN 'missing' WHEN 17 THEN 'invalid' WHEN 18 THEN 'several' ELSE 'present' END AS url_status
FROM {events} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) k WHERE event_id % 30 <> 13 AND (n = 0 OR event_id % 30 = 14)
"""
ANSWER_SOURCES = "SELECT event_id AS request_id, 'https://z.example.com/' AS url FROM {events} WHERE event_id % 30 = 21"


def j6_bind_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bind_actions(*(sql(spark, sf_dir, q) for q in (ACTION_CLAIMS, ACTION_CALLS, ACTION_SOURCES, ACTIONS, INSPECTIONS, ANSWER_SOURCES))).drop("request_id")


J6_ACTIONS = f"""
WITH c AS ({plain(ACTION_CLAIMS)}), k AS ({plain(ACTION_CALLS)}), s AS ({plain(ACTION_SOURCES)}), a AS ({plain(ACTIONS)}), i AS ({plain(INSPECTIONS)}), z AS ({plain(ANSWER_SOURCES)}),
g AS (
  SELECT c.*, (SELECT count(*) FROM k WHERE k.request_id = c.request_id) AS calls, (SELECT count(*) FROM s WHERE s.request_id = c.request_id) AS found, (SELECT count(*) FROM s WHERE s.request_id = c.request_id AND split_part(c.url, '?', 1) = rtrim(split_part(s.url, '#', 1), '/')) AS same,
    (SELECT count(*) FROM a WHERE a.request_id = c.request_id AND action_type = 'search') AS searches, (SELECT count(*) FROM a WHERE a.request_id = c.request_id AND action_type <> 'search') AS looks,
    (SELECT count(*) FROM i WHERE i.request_id = c.request_id) AS seen, (SELECT count(*) FROM z WHERE z.request_id = c.request_id) AS answers, (SELECT min(url) FROM i WHERE i.request_id = c.request_id) AS iu, (SELECT min(url_status) FROM i WHERE i.request_id = c.request_id) AS st,
    (SELECT bool_and(i.call_id = a.call_id) FROM i JOIN a USING (request_id) WHERE request_id = c.request_id AND a.action_type = 'open_page') AS own
  FROM c),
r AS (
  SELECT *, CASE WHEN calls > 1 THEN 'web_search_not_unique' WHEN found > 0 THEN CASE WHEN url LIKE 'http:%' THEN 'source_url_rejected' WHEN same <> 1 THEN 'source_metadata_missing' END
    WHEN searches <> 1 OR looks = 0 THEN 'inspection_url_missing' WHEN looks <> 1 THEN 'inspection_url_ambiguous' WHEN seen = 0 THEN 'inspection_url_missing' WHEN seen <> 1 OR answers > 0 OR NOT own THEN 'inspection_url_ambiguous'
    WHEN st = 'missing' THEN 'inspection_url_missing' WHEN st = 'invalid' THEN 'inspection_url_invalid' WHEN st <> 'present' THEN 'inspection_url_ambiguous' WHEN iu LIKE '%10.0.0.1%' THEN 'inspection_url_invalid' WHEN split_part(url, '?', 1) <> iu THEN 'inspection_url_mismatch' END AS code FROM g)
SELECT claim_id, CASE WHEN code IS NULL THEN CASE WHEN found > 0 THEN 'web_search_source' ELSE 'inspection_action_url' END END AS binding_type, CASE WHEN code IS NULL THEN 'https://a.example.com/p' END AS bound_url,
  CASE WHEN code IS NULL THEN CASE WHEN found > 0 THEN 'c0' ELSE 'o1' END END AS call_id, code FROM r
"""

QUERIES = {f.__name__: f for f in (
    x1_visible_text, x2_mechanical_key, x3_conflict_text, x4_context_tokens, x5_blocks, x6_sequence_starts, x6_sequence_starts_all, x7_mirrors, x8_profile, x9_masked, j1_locate, j1_locate_documents, j2_search_excerpts,
    j5_bind_spans, j5_bind_checked, j6_bind_urls, j6_bind_actions, s4_extract_pages)}
ORACLES = {
    "x1_visible_text": X1, "x2_mechanical_key": X2, "x3_conflict_text": X3, "x4_context_tokens": X4, "x5_blocks": X5, "x6_sequence_starts": X6, "x6_sequence_starts_all": X6_ALL, "x7_mirrors": X7, "x8_profile": X8,
    "x9_masked": X9, "j1_locate": J1, "j2_search_excerpts": J2, "j5_bind_spans": J5, "j5_bind_checked": J5_CHECKED, "j6_bind_urls": J6, "j6_bind_actions": J6_ACTIONS, "s4_extract_pages": S4,
}
