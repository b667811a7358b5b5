"""Queries over event logs and conversations: accounting, validation, and batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import ledger as l
from attestry.plans.fixtures import plain, sql
from attestry.streaming.guard import guard
from attestry.streaming import monitor as m


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def a1_account_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("view", "signup"), "search").when(F.col("event_type") == "click", "inspect").otherwise("open")
    calls = e.where("event_id % 10 <> 3").select((F.col("event_id") / 2).cast("long").alias("call_id"), kind.alias("action_type"))
    views = e.where("event_id % 4 = 0").select((F.col("event_id") / 2).cast("long").alias("call_id"), F.col("user_id").cast("string").alias("url"))
    return l.account_actions(calls, views)


A1 = """
WITH k AS (SELECT event_id // 2 AS call_id, event_id, user_id, CASE WHEN event_type IN ('view', 'signup') THEN 'search' WHEN event_type = 'click' THEN 'inspect' ELSE 'open' END AS kind FROM events),
c AS (SELECT call_id, count(DISTINCT kind) AS n, min(kind) AS kind FROM k WHERE event_id % 10 <> 3 GROUP BY 1),
v AS (SELECT call_id, count(*) AS n_views, count(DISTINCT user_id) AS n_urls FROM k WHERE event_id % 4 = 0 GROUP BY 1)
SELECT call_id, CASE WHEN n = 1 THEN kind END AS action_type, coalesce(n_views, 0)::BIGINT AS n_views,
  CASE WHEN n IS NULL THEN 'view_without_call' WHEN n > 1 THEN 'ambiguous_action_type' WHEN kind = 'search' AND n_views IS NULL THEN 'search_without_view'
    WHEN kind = 'inspect' AND coalesce(n_urls, 0) <> 1 THEN 'inspection_url_ambiguous' END AS code
FROM c FULL JOIN v USING (call_id)
"""


ACTIONS = "SELECT event_id % 4000 AS run_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'signup' THEN 'search' WHEN 'click' THEN 'open_page' ELSE 'find_in_page' END AS action_type FROM {events} WHERE event_id % 7 < 5"
ADMISSIONS = """
SELECT run_id, run_id % 4 AS n_http, CASE WHEN run_id % 31 = 0 THEN 'unknown' ELSE 'supported' END AS metadata_status, CASE WHEN run_id % 29 = 0 THEN NULL ELSE 'supported' END AS policy_status, CASE WHEN run_id % 37 = 0 THEN 'limit' END AS policy_code,
  n + CASE WHEN run_id % 41 = 0 THEN 1 ELSE 0 END AS n_actions, s + CASE WHEN run_id % 43 = 0 THEN 1 ELSE 0 END AS n_queries, n - s - CASE WHEN run_id % 11 = 0 THEN 2 ELSE 0 END AS n_inspections, n + CASE WHEN run_id % 41 = 0 THEN 1 ELSE 0 END - CASE WHEN run_id % 23 = 0 THEN 1 ELSE 0 END AS n_unique,
  CASE WHEN run_id % 19 = 0 THEN NULL ELSE n + CASE WHEN run_id % 41 = 0 THEN 1 WHEN run_id % 17 = 0 THEN 2 ELSE 0 END END AS n_tools
FROM (SELECT event_id % 4000 AS run_id, count(CASE WHEN event_id % 7 < 5 THEN 1 END) AS n, count(CASE WHEN event_id % 7 < 5 AND event_type IN ('view', 'signup') THEN 1 END) AS s FROM {events} GROUP BY event_id % 4000) g
"""


def a2_check_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.check_admission(sql(spark, sf_dir, ADMISSIONS), sql(spark, sf_dir, ACTIONS)).select("run_id", "admitted", "reason")


A2 = f"""
WITH r AS ({plain(ADMISSIONS)}), a AS (SELECT run_id, count(*) AS n, count(*) FILTER (action_type = 'search') AS s, count(*) FILTER (action_type <> 'search') AS p FROM ({plain(ACTIONS)}) GROUP BY 1),
j AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(p, 0) AS p FROM r LEFT JOIN a USING (run_id)),
z AS (
  SELECT run_id, CASE WHEN n_http < 1 THEN 'no_provider_call' WHEN n_http > 2 THEN 'too_many_provider_calls' WHEN metadata_status <> 'supported' THEN 'metadata_unsupported' WHEN policy_status IS NULL THEN 'policy_unsupported' WHEN policy_code IS NOT NULL THEN 'policy_code'
    WHEN n_tools IS NULL OR least(n_actions, n_queries, n_inspections, n_unique, n_tools) < 0 THEN 'count_invalid' WHEN n_queries < 1 THEN 'no_query' WHEN n_actions < 1 THEN 'no_action' WHEN n_actions > 8 THEN 'too_many_actions' WHEN n_unique <> n_actions THEN 'calls_not_unique'
    WHEN n_tools <> n_actions THEN 'tool_call_mismatch' WHEN n <> n_actions THEN 'action_count_mismatch' WHEN s <> n_queries THEN 'query_count_mismatch' WHEN p <> n_inspections THEN 'inspection_count_mismatch' WHEN n_actions <> n_queries + n_inspections THEN 'sum_mismatch' END AS reason FROM j)
SELECT run_id, reason IS NULL AS admitted, reason FROM z
"""


def a3_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    side = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")))
    u = c.groupBy(F.col("conv_id").alias("run_id")).agg(side("user").alias("input_tokens"), side("assistant").alias("output_tokens"), F.count("*").alias("n_actions"))
    return l.cost(u).select("run_id", F.round(F.col("cost_usd") * 100_000_000).cast("long").alias("cost_1e8"), "rejected")


A3 = """
WITH u AS (SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS i, sum(length(text)) FILTER (role = 'assistant') AS o, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id AS run_id, (i * 25 + o * 200 + n * 1000000)::BIGINT AS cost_1e8, coalesce(i * 25 + o * 200 + n * 1000000 > 10000000, true) AS rejected FROM u
"""


def a4_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "ts", "event_id")
    return l.stage_durations(e)


A4 = """
WITH d AS (SELECT user_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events)
SELECT user_id AS run_id, sum(us) FILTER (event_type = 'signup')::BIGINT AS signup, sum(us) FILTER (event_type = 'view')::BIGINT AS view, sum(us) FILTER (event_type = 'click')::BIGINT AS click,
  sum(us) FILTER (event_type = 'purchase')::BIGINT AS purchase, sum(us) FILTER (event_type = 'error')::BIGINT AS error
FROM d GROUP BY 1
"""


def a4_run_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    stages = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "ts", "event_id")
    kinds = F.array(*map(F.lit, ["call", "search", "view", "source", "token"]))
    usage = e.where("user_id % 4 > 0").select(F.col("user_id").alias("run_id"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"), (F.col("event_id") % 7).alias("amount"))
    got = l.run_receipts(stages, usage)
    return got.select("run_id", "view", "total_us", "n_events", "n_failures", "n_calls", "n_searches", "n_views", "n_sources", "n_tokens")


A4_RECEIPTS = """
WITH d AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events),
amount AS (SELECT *, CASE WHEN user_id % 4 > 0 THEN event_id % 7 END AS a FROM d)
SELECT user_id AS run_id, sum(us) FILTER (event_type = 'view')::BIGINT AS view, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS total_us, count(*)::BIGINT AS n_events, count(*) FILTER (event_type = 'error')::BIGINT AS n_failures,
  sum(CASE WHEN event_id % 5 = 0 OR a IS NULL THEN a ELSE 0 END)::BIGINT AS n_calls, sum(CASE WHEN event_id % 5 = 1 OR a IS NULL THEN a ELSE 0 END)::BIGINT AS n_searches, sum(CASE WHEN event_id % 5 = 2 OR a IS NULL THEN a ELSE 0 END)::BIGINT AS n_views,
  sum(CASE WHEN event_id % 5 = 3 OR a IS NULL THEN a ELSE 0 END)::BIGINT AS n_sources, sum(CASE WHEN event_id % 5 = 4 OR a IS NULL THEN a ELSE 0 END)::BIGINT AS n_tokens
FROM amount GROUP BY 1
"""

#: Every code and status, and the kinds, stages and aborts that come before or after them.
ERROR_CODES = [r[0][5:] for r in l.FAILURES if r[0].startswith("code:")] + ["never_heard_of"]
ERROR_STATUS = ["401", "403", "404", "408", "429", "500", "503", "NULL"]
ERROR_KINDS = ["configuration", "api", "no_object", "no_output", "timeout", "other"]
ERRORS = f"""
SELECT event_id AS error_id, CASE WHEN event_id % 3 = 0 THEN element_at(array({", ".join(f"'{c}'" for c in ERROR_CODES)}), cast(event_id % {len(ERROR_CODES)} + 1 AS int)) END AS code,
  element_at(array({", ".join(f"'{k}'" for k in ["api", *ERROR_KINDS])}), cast(event_id % 7 + 1 AS int)) AS kind, element_at(array({", ".join(ERROR_STATUS)}), cast(event_id % 8 + 1 AS int)) AS status, event_id % 2 = 0 AS can_retry,
  CASE event_id % 11 WHEN 0 THEN 'serialization' WHEN 1 THEN 'persistence' ELSE 'generation' END AS stage, event_id % 13 = 0 AS aborted
FROM {{events}}
"""


def a5_classify_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.classify_failures(sql(spark, sf_dir, ERRORS)).select("error_id", "category", "public_code", "reason_code", "retryable", "failed_stage", "http_status", "message")


def _listed(codes: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


A5 = f"""
WITH e AS ({plain(ERRORS).replace("element_at(array(", "list_extract(list_value(")}),
k AS (
  SELECT *, CASE WHEN aborted THEN 'abort' WHEN stage <> 'generation' THEN stage WHEN code IS NOT NULL THEN 'code' WHEN kind = 'api' THEN 'api' ELSE kind END AS by_ FROM e),
c AS (
  SELECT *, CASE by_ WHEN 'abort' THEN 'timeout' WHEN 'serialization' THEN 'serialization' WHEN 'persistence' THEN 'internal_unknown' WHEN 'configuration' THEN 'configuration' WHEN 'no_object' THEN 'structured_output_invalid' WHEN 'no_output' THEN 'no_output' WHEN 'timeout' THEN 'timeout'
    WHEN 'code' THEN CASE WHEN code LIKE 'web_search%' THEN 'provider_request' WHEN code IN ({_listed(l.SHAPE_CODES)}) THEN 'structured_output_invalid' WHEN code IN ({_listed(l.SOURCE_CODES + l.METADATA_CODES)}) THEN 'source_metadata_missing'
      WHEN code = 'source_timeout' THEN 'timeout' WHEN code = 'source_transport_error' THEN 'network' WHEN code IN ({_listed(l.CONTRACT_CODES)}) THEN 'truth_contract_rejected' ELSE 'internal_unknown' END
    WHEN 'api' THEN CASE WHEN status IS NULL THEN 'network' WHEN status = 401 THEN 'authentication' WHEN status = 403 THEN 'permission' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'provider_unavailable' WHEN status = 408 THEN 'timeout' ELSE 'provider_request' END
    ELSE 'internal_unknown' END AS category FROM k)
SELECT error_id, category,
  CASE WHEN category = 'timeout' AND by_ <> 'code' THEN 'provider_timeout' WHEN by_ = 'serialization' THEN 'terminal_serialization_failed' WHEN by_ = 'persistence' THEN 'receipt_persistence_failed' WHEN category IN ('structured_output_invalid', 'truth_contract_rejected') THEN category
    WHEN category = 'internal_unknown' THEN 'internal_failure' WHEN by_ = 'code' THEN code WHEN category = 'configuration' THEN 'configuration_unavailable' WHEN category = 'no_output' THEN 'provider_no_output' WHEN category = 'network' THEN 'provider_network_failed'
    WHEN category = 'authentication' THEN 'provider_authentication_failed' WHEN category = 'permission' THEN 'provider_permission_denied' WHEN category = 'rate_limit' THEN 'provider_rate_limited' WHEN category = 'provider_unavailable' THEN category ELSE 'provider_request_failed' END AS public_code,
  CASE WHEN by_ = 'code' AND category <> 'internal_unknown' THEN code END AS reason_code,
  CASE WHEN by_ IN ('abort', 'timeout') THEN true WHEN by_ = 'code' THEN code IN ('source_timeout', 'source_transport_error') WHEN by_ = 'api' THEN CASE WHEN status IN (401, 403) THEN false ELSE can_retry END ELSE false END AS retryable,
  CASE WHEN by_ IN ('abort', 'api', 'timeout') THEN 'provider_request' WHEN by_ IN ('serialization', 'persistence', 'configuration') THEN by_ WHEN by_ = 'code' THEN
      CASE WHEN code LIKE 'web_search%' OR code LIKE 'provider_%' OR code LIKE 'inspection_%' OR code = 'source_metadata_missing' THEN 'metadata_extraction' WHEN category IN ('structured_output_invalid', 'truth_contract_rejected') THEN 'truth_validation'
        WHEN category = 'internal_unknown' THEN stage ELSE 'source_verification' END ELSE stage END AS failed_stage,
  CASE WHEN by_ = 'api' THEN status END AS http_status, CASE WHEN category IN ({_listed(l.NO_PROOF)}) THEN 'no_sufficient_proof' WHEN category = 'timeout' THEN 'expired' ELSE 'unavailable' END AS message
FROM c
"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    none = F.lit(None).cast("string")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(  # 25 nations at every scale
        F.col("c_custkey").alias("request_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("organization"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).alias("city"), none.alias("role"), none.alias("industry"), F.concat(F.lit("x, "), F.lower("c_mktsegment"), F.lit("; y")).alias("context"))


def a6_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.query_plan(_requests(spark, sf_dir)).select("request_id", F.col("position").cast("long").alias("position"), "query")


A6_PLAN = """
WITH r AS (SELECT c_custkey, '"' || c_name || '"' AS q, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS o, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS c, lower(c_mktsegment) AS f
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (
  SELECT c_custkey, list_filter([q, q || ' "' || o || '"', q || ' "' || c || '"', q || ' "' || f || '"'], lambda v: v IS NOT NULL) AS qs FROM r),
plan AS (SELECT c_custkey AS request_id, i - 1 AS position, qs[i] AS query FROM (SELECT c_custkey, qs, unnest(range(1, len(qs) + 1)) AS i FROM p))"""
A6 = A6_PLAN + " SELECT request_id, position, query FROM plan"


def a7_plan_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = l.query_plan(_requests(spark, sf_dir))
    done = plan.select("request_id", F.when((F.col("request_id") + F.col("position")) % 4 == 0, F.concat("query", F.lit(" extra"))).otherwise(F.upper("query")).alias("query"))
    return l.plan_deviation(done, plan).select("request_id", "query")


A7 = A6_PLAN + " SELECT request_id, query || ' extra' AS query FROM plan WHERE (request_id + position) % 4 = 0"


#: The whole text of a conversation, or nearly: with a letter more, a part changed, or none.
WHOLE = """
SELECT conv_id AS doc, CASE conv_id % 7 WHEN 1 THEN concat(t, 'x') WHEN 2 THEN replace(t, 'e', 'E') WHEN 3 THEN NULL ELSE t END AS text FROM (
  SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, coalesce(text, '') AS text))), x -> x.text), '') AS t FROM {conversations} GROUP BY conv_id) w
WHERE conv_id % 7 <> 4
"""


def a8_global_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc"), F.col("turn").alias("part"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("local_start"), F.lit(5).alias("local_end"))
    plain_ = l.global_spans(c).select("doc", "part", F.col("start").alias("start_"), F.col("end").alias("end_"))
    return l.global_spans(c, sql(spark, sf_dir, WHOLE)).select("doc", "part", "start", "end").join(plain_, ["doc", "part"])


A8 = """
WITH o AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM conversations),
w AS (SELECT conv_id, conv_id % 7 IN (0, 5, 6) OR (conv_id % 7 = 2 AND NOT contains(string_agg(text, ''), 'e')) AS fits FROM conversations GROUP BY 1)
SELECT conv_id AS doc, turn AS part, CASE WHEN fits THEN o + 1 END::BIGINT AS start, CASE WHEN fits THEN o + 5 END::BIGINT AS "end", (o + 1)::BIGINT AS start_, (o + 5)::BIGINT AS end_
FROM o JOIN w USING (conv_id)
"""


def v2_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.concat_ws("-", "event_type", (F.col("event_id") % 40).cast("string")).alias("record_id"))
    return l.duplicate_ids(e)


V2 = """
SELECT user_id AS request_id, 'duplicate_id' AS code, event_type || '-' || (event_id % 40) AS record_id FROM events GROUP BY user_id, event_type || '-' || (event_id % 40) HAVING count(*) > 1
"""


REFERENCES = "SELECT user_id AS request_id, concat('presentation.', event_type) AS list, cast(event_id % 100 AS string) AS id FROM {events}"


def v2_duplicate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.duplicate_references(sql(spark, sf_dir, REFERENCES))


V2_REFERENCES = f"SELECT request_id, 'duplicate_reference' AS code, list AS record_id FROM ({plain(REFERENCES)}) GROUP BY request_id, list HAVING count(*) > count(DISTINCT id)"


def v4_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("r").alias("request_id"), "o_orderkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("r").alias("request_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_partkey") % 97 == 0, F.col("l_orderkey") + 100_000_000).otherwise(F.col("l_orderkey")).alias("o"))
    return l.dangling(li, o, "o", "o_orderkey", "evidence_missing_claim", "id")


V4 = """
SELECT 'r' AS request_id, 'evidence_missing_claim' AS code, l_orderkey || '-' || l_linenumber AS record_id
FROM lineitem WHERE l_partkey % 97 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
"""


STEPS = """
SELECT user_id AS request_id, event_id AS step_id, event_id AS ord, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, concat('n', cast(event_id AS string)) AS invocation_id, CASE WHEN event_id % 6 < 2 THEN concat('n', cast(event_id - event_id % 6 * 5 AS string)) END AS retry_of,
  event_id * 100 - CASE WHEN event_id % 50 = 0 THEN 6000000 ELSE 0 END AS start_ms, event_id * 100 + CASE WHEN event_id % 33 = 0 THEN -5 WHEN event_id % 50 = 0 THEN -5999900 ELSE 80 END AS end_ms, CASE WHEN event_id % 41 = 0 THEN NULL ELSE 80 + event_id % 21 END AS measured_ms FROM {events}
"""
RECEIPTS = "SELECT user_id AS request_id, min(event_id) * 100 AS start_ms, CASE WHEN user_id % 9 > 0 THEN max(event_id) * 100 + user_id % 4 * 30 END AS end_ms, (max(event_id) - min(event_id)) * 100 + 60 + user_id % 5 AS total_ms FROM {events} GROUP BY user_id"


def v8_step_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.step_timing(sql(spark, sf_dir, STEPS), sql(spark, sf_dir, RECEIPTS))


V8 = f"""
WITH s AS ({plain(STEPS)}), r AS ({plain(RECEIPTS)}),
b AS (SELECT s.*, last_value(CASE WHEN status = 'completed' THEN end_ms END IGNORE NULLS) OVER (PARTITION BY request_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
w AS (SELECT b.*, r.start_ms AS f, r.end_ms AS t FROM b JOIN r USING (request_id))
SELECT request_id, 'execution_step_missing_retry_target' AS code, step_id::VARCHAR AS record_id FROM w WHERE retry_of IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.request_id = w.request_id AND s.invocation_id = w.retry_of)
UNION ALL SELECT request_id, 'execution_step_invalid_timing', step_id::VARCHAR FROM w WHERE status = 'completed' AND (measured_ms IS NULL OR end_ms < start_ms OR start_ms < p OR abs(end_ms - start_ms - measured_ms) > 2)
UNION ALL SELECT request_id, 'execution_step_outside_receipt', step_id::VARCHAR FROM w WHERE status = 'completed' AND t IS NOT NULL AND (start_ms < f OR end_ms > t)
UNION ALL SELECT request_id, 'receipt_duration_timestamp_mismatch', NULL FROM r WHERE abs(end_ms - start_ms - total_ms) > 2
"""


STANDINGS = """
SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'needs_clarification' WHEN 2 THEN 'insufficient_evidence' ELSE 'complete_within_scope' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'silence' ELSE 'dossier' END AS mode,
  c_nationkey > 5 AS resolved, count(o_orderkey) AS n_supported, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS n_visible, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_business, count(DISTINCT o_orderstatus) AS n_categories,
  count(DISTINCT o_orderpriority) AS n_sources, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS n_pages, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS n_publishers,
  count(CASE WHEN o_orderkey % 9 = 0 THEN 1 END) AS n_contradictions
FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey
"""


def v9_status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.status_rules(sql(spark, sf_dir, STANDINGS))


V9 = f"""
WITH d AS ({plain(STANDINGS)}), k AS (SELECT *, status = 'complete_within_scope' AS c FROM d)
SELECT request_id, 'complete_requires_resolved_identity' AS code FROM k WHERE c AND NOT resolved UNION ALL SELECT request_id, 'complete_requires_three_visible_facts' FROM k WHERE c AND n_visible < 3
UNION ALL SELECT request_id, 'complete_requires_three_business_facts' FROM k WHERE c AND n_business < 3 UNION ALL SELECT request_id, 'complete_allows_at_most_six_business_facts' FROM k WHERE c AND n_business > 6
UNION ALL SELECT request_id, 'complete_requires_two_business_categories' FROM k WHERE c AND n_categories < 2 UNION ALL SELECT request_id, 'complete_requires_two_visible_sources' FROM k WHERE c AND n_sources < 2
UNION ALL SELECT request_id, 'complete_requires_two_business_source_pages' FROM k WHERE c AND n_pages < 2 UNION ALL SELECT request_id, 'complete_requires_two_publisher_domains' FROM k WHERE c AND n_publishers < 2
UNION ALL SELECT request_id, 'complete_forbids_visible_contradiction' FROM k WHERE c AND n_contradictions > 0 UNION ALL SELECT request_id, 'partial_requires_resolved_identity' FROM k WHERE status = 'partial' AND NOT resolved
UNION ALL SELECT request_id, 'needs_clarification_requires_unresolved_identity' FROM k WHERE status = 'needs_clarification' AND resolved UNION ALL SELECT request_id, 'needs_clarification_forbids_supported_facts' FROM k WHERE status = 'needs_clarification' AND n_supported > 0
UNION ALL SELECT request_id, 'insufficient_evidence_forbids_supported_facts' FROM k WHERE status = 'insufficient_evidence' AND n_supported > 0 UNION ALL SELECT request_id, 'silence_forbids_supported_facts' FROM k WHERE mode = 'silence' AND n_supported > 0
"""


def st1_admission_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.admission_pressure(_events(spark, sf_dir))


ST1 = """
SELECT user_id, start, count(*)::BIGINT AS n
FROM (SELECT user_id, unnest(range(date_trunc('minute', ts) - INTERVAL 9 MINUTE, date_trunc('minute', ts) + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS start FROM events) GROUP BY 1, 2
"""


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of forty clients, a month of them within hours, so that windows of ten minutes fill."""
    e = _events(spark, sf_dir)
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select((F.col("user_id") % 40).alias("client"), "event_id", F.timestamp_micros(F.floor(ts / 200)).alias("ts"), "value")


def st2_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.admit(_busy(spark, sf_dir)).select("event_id", "admitted", "retry_after_s")


def st2_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and, up to a minute later, ends of runs in five pools: refused by the client's or the pool's limit."""
    e = _busy(spark, sf_dir).withColumns({"pool": F.col("client") % 5, "run_id": F.col("event_id")})
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 13) * 5_000_000)
    both = e.select("pool", "client", "run_id", (2 * F.col("event_id")).alias("event_id"), F.lit("start").alias("kind"), "ts").unionByName(
        e.where("event_id % 11 > 0").select("pool", "client", "run_id", (2 * F.col("event_id") + 1).alias("event_id"), F.lit("end").alias("kind"), end.alias("ts")))
    return guard(both).select("pool", "event_id", "admitted", "code", "retry_after_s")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for kv in m.STATES.items() for x in kv])
    return _events(spark, sf_dir).select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("execution_id"), state[F.col("event_type")].alias("state"), F.col("value").alias("elapsed_ms"), "ts", "event_id")


def st3_check_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.check_protocol(_runs(spark, sf_dir))


RUNS = """
WITH r AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS execution_id, event_type, value, ts, event_id, event_type IN ('purchase', 'error') AS fin FROM events)"""
ST3 = RUNS + """,
w AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY execution_id) AS n FROM r)
SELECT execution_id, CASE WHEN bool_or(i = 1 AND event_type <> 'signup') THEN 'first_not_accepted' WHEN bool_or(coalesce(value < 0, true)) THEN 'elapsed_invalid'
  WHEN count(*) FILTER (fin) = 0 THEN 'terminal_missing' WHEN count(*) FILTER (fin) > 1 THEN 'terminal_repeated' WHEN bool_or(fin AND i < n) THEN 'event_after_terminal' END AS code
FROM w GROUP BY 1
"""


def st4_expire_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.expire_runs(_runs(spark, sf_dir), limit_s=3600)


ST4 = RUNS + " SELECT execution_id, coalesce(min(ts) FILTER (fin) > min(ts) + INTERVAL 1 HOUR, true) AS expired FROM r GROUP BY 1"


def st4_watch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.watch_runs(_runs(spark, sf_dir))


ST4_WATCH = RUNS + """,
n AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY ts, event_id) AS i, ts > min(ts) OVER (PARTITION BY execution_id) + INTERVAL 150 SECOND AS late FROM r),
e AS (SELECT *, min(CASE WHEN fin AND NOT late THEN i END) OVER (PARTITION BY execution_id) AS z FROM n)
SELECT execution_id, event_id, 'first_not_accepted' AS code FROM e WHERE i = 1 AND event_type <> 'signup' UNION ALL SELECT execution_id, event_id, 'elapsed_invalid' FROM e WHERE coalesce(value < 0, true)
UNION ALL SELECT execution_id, event_id, 'late_event' FROM e WHERE z IS NULL AND late UNION ALL SELECT execution_id, event_id, CASE WHEN fin THEN 'terminal_repeated' ELSE 'event_after_terminal' END FROM e WHERE i > z
UNION ALL SELECT execution_id, NULL, 'timeout' FROM e WHERE z IS NULL AND i = 1
"""


def st5_receipt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.receipt_rollup(_events(spark, sf_dir)).select("start", "n_runs", "n_failed")


ST5 = "SELECT date_trunc('hour', ts) AS start, count(*)::BIGINT AS n_runs, (count(*) FILTER (event_type = 'error'))::BIGINT AS n_failed FROM events GROUP BY 1"


def st6_dedupe_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    return m.dedupe_terminals(r.unionAll(r)).select("execution_id")


ST6 = RUNS + " SELECT DISTINCT execution_id FROM r WHERE fin"

QUERIES = {f.__name__: f for f in (
    a1_account_actions, a2_check_admission, a3_cost, a4_stage_durations, a4_run_receipts, a5_classify_failures, a6_query_plan, a7_plan_deviation, a8_global_spans, v2_duplicate_ids, v2_duplicate_references, v4_dangling, v8_step_timing, v9_status_rules,
    st1_admission_pressure, st2_admit, st2_guard, st3_check_protocol, st4_expire_runs, st4_watch_runs, st5_receipt_rollup, st6_dedupe_terminals)}
ORACLES = {
    "a1_account_actions": A1, "a2_check_admission": A2, "a3_cost": A3, "a4_stage_durations": A4, "a4_run_receipts": A4_RECEIPTS, "a5_classify_failures": A5, "a6_query_plan": A6, "a7_plan_deviation": A7, "a8_global_spans": A8,
    "v2_duplicate_ids": V2, "v2_duplicate_references": V2_REFERENCES, "v4_dangling": V4, "v8_step_timing": V8, "v9_status_rules": V9, "st1_admission_pressure": ST1, "st3_check_protocol": ST3, "st4_expire_runs": ST4,
    "st4_watch_runs": ST4_WATCH, "st5_receipt_rollup": ST5, "st6_dedupe_terminals": ST6,
}
