"""Accounting over logs, and validation rules as queries that return their violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import plain_key

#: USD for a million tokens, for an action, and the most a run may cost.
PRICES = {"input": 0.25, "output": 2.0}
ACTION_PRICE, MAX_COST = 0.01, 0.10
MAX_ACTIONS, MAX_PROVIDER_CALLS = 8, 2
#: What a failure is known by, its category, public code (None: the code itself), whether a retry helps (None: as the error says), and stage (None: as given).
SHAPE_CODES = ["invalid_provider_shape", "invalid_claim_length", "non_atomic_claim"]
SOURCE_CODES = [
    "ambiguous_source_relation", "missing_source_title", "source_not_in_provider_metadata", "source_excerpt_missing", "invalid_source_url", "source_url_rejected", "source_dns_rejected",
    "source_redirect_rejected", "source_body_too_large", "source_content_type_rejected", "source_http_error", "source_charset_rejected", "source_empty", "source_parse_failed", "source_excerpt_ambiguous",
]
METADATA_CODES = ["provider_citation_missing", "provider_citation_unbound", "provider_source_url_missing", "source_metadata_missing", "inspection_url_missing", "inspection_url_invalid", "inspection_url_ambiguous", "inspection_url_mismatch"]
CONTRACT_CODES = ["m2_contract_invalid", "m2_receipt_usage_missing", "runtime_invariants_invalid", "cost_limit_exceeded"]
FAILURES = [
    ("abort", "timeout", "provider_timeout", True, "provider_request"), ("stage:serialization", "serialization", "terminal_serialization_failed", False, "serialization"),
    ("stage:persistence", "internal_unknown", "receipt_persistence_failed", False, "persistence"),
    *((f"code:{c}", "provider_request", None, False, "metadata_extraction") for c in ("web_search_action_invalid", "web_search_not_unique")),
    *((f"code:{c}", "structured_output_invalid", "structured_output_invalid", False, "truth_validation") for c in SHAPE_CODES),
    *((f"code:{c}", "source_metadata_missing", None, False, "source_verification") for c in SOURCE_CODES), *((f"code:{c}", "source_metadata_missing", None, False, "metadata_extraction") for c in METADATA_CODES),
    ("code:source_timeout", "timeout", None, True, "source_verification"), ("code:source_transport_error", "network", None, True, "source_verification"),
    *((f"code:{c}", "truth_contract_rejected", "truth_contract_rejected", False, "truth_validation") for c in CONTRACT_CODES),
    ("kind:configuration", "configuration", "configuration_unavailable", False, "configuration"), ("status:401", "authentication", "provider_authentication_failed", False, "provider_request"),
    ("status:403", "permission", "provider_permission_denied", False, "provider_request"), ("status:429", "rate_limit", "provider_rate_limited", None, "provider_request"),
    ("status:5xx", "provider_unavailable", "provider_unavailable", None, "provider_request"), ("status:408", "timeout", "provider_timeout", None, "provider_request"),
    ("status:none", "network", "provider_network_failed", None, "provider_request"), ("status:other", "provider_request", "provider_request_failed", None, "provider_request"),
    ("kind:no_object", "structured_output_invalid", "structured_output_invalid", False, "generation"), ("kind:no_output", "no_output", "provider_no_output", False, "generation"),
    ("kind:timeout", "timeout", "provider_timeout", True, "provider_request"),
]
#: What a reader is told of a category.
NO_PROOF = ["structured_output_invalid", "source_metadata_missing", "truth_contract_rejected", "no_output"]


def account_actions(calls: DataFrame, views: DataFrame) -> DataFrame:
    """(call_id, action_type, n_views, code): one action type for each call, one source view for each search; both sides are kept.

    calls: call_id, action_type; views: call_id, url.
    """
    c = calls.groupBy("call_id").agg(F.collect_set("action_type").alias("types"))
    v = views.groupBy("call_id").agg(F.count("*").alias("n_views"), F.count_distinct("url").alias("n_urls"))
    j = c.join(v, "call_id", "full_outer").fillna(0, ["n_views", "n_urls"])
    kind = F.when(F.size("types") == 1, F.get("types", 0))
    code = (
        F.when(F.col("types").isNull(), "view_without_call").when(F.size("types") > 1, "ambiguous_action_type").when((kind == "search") & (F.col("n_views") == 0), "search_without_view")
        .when((kind == "inspect") & (F.col("n_urls") != 1), "inspection_url_ambiguous")
    )
    return j.select("call_id", kind.alias("action_type"), "n_views", code.alias("code"))


def check_admission(runs: DataFrame, actions: DataFrame) -> DataFrame:
    """runs with admitted and reason, the first of 15 conditions that fails.

    runs: run_id, n_http, metadata_status, policy_status, policy_code, and the declared n_actions, n_queries, n_inspections, n_unique, n_tools;
    actions: run_id, action_type (search, open_page, find_in_page), the observed ones. A count that is missing is not a count.
    """
    kind = F.col("action_type")
    seen = actions.groupBy("run_id").agg(F.count("*").alias("__all"), F.count_if(kind == "search").alias("__searches"), F.count_if(kind.isin("open_page", "find_in_page")).alias("__pages"))
    d = runs.join(seen, "run_id", "left").fillna(0, ["__all", "__searches", "__pages"])
    n = F.col("n_actions")
    wanted = [
        (F.col("n_http") >= 1, "no_provider_call"), (F.col("n_http") <= MAX_PROVIDER_CALLS, "too_many_provider_calls"), (F.col("metadata_status") == "supported", "metadata_unsupported"),
        (F.col("policy_status") == "supported", "policy_unsupported"), (F.col("policy_code").isNull(), "policy_code"), (F.least(*[F.coalesce(F.col(c), F.lit(-1)) for c in ("n_actions", "n_queries", "n_inspections", "n_unique", "n_tools")]) >= 0, "count_invalid"),
        (F.col("n_queries") >= 1, "no_query"), (n >= 1, "no_action"), (n <= MAX_ACTIONS, "too_many_actions"), (F.col("n_unique") == n, "calls_not_unique"), (F.col("n_tools") == n, "tool_call_mismatch"), (F.col("__all") == n, "action_count_mismatch"),
        (F.col("__searches") == F.col("n_queries"), "query_count_mismatch"), (F.col("__pages") == F.col("n_inspections"), "inspection_count_mismatch"), (n == F.col("n_queries") + F.col("n_inspections"), "sum_mismatch"),
    ]
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in wanted])
    return d.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull()).drop("__all", "__searches", "__pages")


def cost(usage: DataFrame) -> DataFrame:
    """usage (run_id, input_tokens, output_tokens, n_actions) with cost_usd (8 decimals, null if usage is unknown) and rejected (over the most a run may cost, or unknown)."""
    raw = (F.col("input_tokens") * PRICES["input"] + F.col("output_tokens") * PRICES["output"]) / 1_000_000 + F.col("n_actions") * ACTION_PRICE
    d = usage.withColumn("cost_usd", F.round(raw.cast("double"), 8))
    return d.withColumn("rejected", F.coalesce(F.col("cost_usd") > MAX_COST, F.lit(True)))


def stage_durations(events: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each run: its time in each stage (microseconds), from one event to the next. events: run, stage, ts."""
    w = Window.partitionBy(run).orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    d = events.withColumn("us", F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at))
    return d.groupBy(run).pivot("stage", ["signup", "view", "click", "purchase", "error"]).agg(F.sum("us"))


def run_receipts(events: DataFrame, usage: DataFrame, run: str = "run_id") -> DataFrame:
    """A4: one receipt a run: its time in each stage (us), start, end, total_us, n_events, n_failures, and from usage (run, kind, amount)
    n_calls, n_searches, n_views, n_sources and tokens; null where a run has no usage of any kind. A run of usage alone has no receipt."""
    at = F.col("ts").cast("timestamp")
    spans = events.groupBy(run).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_events"), F.sum((F.col("stage") == "error").cast("long")).alias("n_failures"))
    spans = spans.withColumn("total_us", F.unix_micros("end") - F.unix_micros("start"))
    names = {"call": "n_calls", "search": "n_searches", "view": "n_views", "source": "n_sources", "token": "n_tokens"}
    used = usage.groupBy(run).agg(*[F.sum(F.when(F.col("kind") == k, F.col("amount")).otherwise(0)).alias(n) for k, n in names.items()])
    return stage_durations(events, run).join(spans, run).join(used, run, "left")


def classify_failures(errors: DataFrame) -> DataFrame:
    """A5: errors with category, public_code, reason_code, retryable, failed_stage, http_status and message.

    errors: error_id, code (of validation), kind (configuration, api, no_object, no_output, timeout, other), status, can_retry, stage, aborted. A
    time limit that aborted the call comes first, then failures to serialise or store, then the validation code, then the kind. The rules
    are a table of some sixty rows joined by key; what it does not know is an internal failure.
    """
    rules = errors.sparkSession.createDataFrame(FAILURES, "key string, category string, public_code string, retryable boolean, at_stage string")
    status = F.col("status")
    answered = F.when(status.isNull(), "none").when(status.isin(401, 403, 429, 408), status.cast("string")).when(status >= 500, "5xx").otherwise("other")
    key = (
        F.when(F.col("aborted"), "abort").when(F.col("stage").isin("serialization", "persistence"), F.concat(F.lit("stage:"), "stage")).when(F.col("code").isNotNull(), F.concat(F.lit("code:"), "code"))
        .when(F.col("kind") == "api", F.concat(F.lit("status:"), answered)).otherwise(F.concat(F.lit("kind:"), F.coalesce("kind", F.lit("other"))))
    )
    d = errors.withColumn("__key", key).join(F.broadcast(rules.withColumnRenamed("key", "__key")), "__key", "left")  # a fixed table
    unknown = F.col("category").isNull()
    message = F.when(F.col("category").isin(*NO_PROOF), "no_sufficient_proof").when(F.col("category") == "timeout", "expired").otherwise("unavailable")
    d = d.withColumns({
        "category": F.coalesce("category", F.lit("internal_unknown")), "public_code": F.when(unknown, "internal_failure").otherwise(F.coalesce("public_code", "code")),
        "retryable": F.when(unknown, False).otherwise(F.coalesce("retryable", "can_retry", F.lit(False))), "failed_stage": F.coalesce("at_stage", "stage"),
        "http_status": F.when(F.col("__key").startswith("status:"), status), "reason_code": F.when(F.col("__key").startswith("code:") & ~unknown, F.col("code")),
    })
    return d.withColumn("message", message).drop("__key", "at_stage")


def query_plan(requests: DataFrame) -> DataFrame:
    """(request_id, position, query): at most four distinct searches: the quoted name, then with organisation, city, and role, industry or first context fragment."""
    quoted = lambda c: F.concat(F.lit('"'), F.trim(F.regexp_replace(c, '["“”]+', " ")), F.lit('"'))
    fragments = F.filter(F.transform(F.split("context", r"[,;|\n]+"), lambda f: F.trim(F.regexp_replace(f, r"\s+", " "))), lambda f: F.length(f) >= 2)
    last = F.coalesce("role", "industry", F.get(fragments, 0))
    name = quoted(F.col("name"))
    extra = [F.when(c.isNotNull(), F.concat(name, F.lit(" "), quoted(c))) for c in (F.col("organization"), F.col("city"), last)]
    queries = F.slice(F.array_distinct(F.array_compact(F.array(name, *extra))), 1, 4)
    return requests.select("request_id", F.posexplode(queries).alias("position", "query"))


def plan_deviation(executed: DataFrame, plan: DataFrame) -> DataFrame:
    """Executed queries (request_id, query) that the plan does not hold, by normal form."""
    key = lambda d: d.withColumn("__q", plain_key(F.col("query")))
    return key(executed).join(key(plan).select("request_id", "__q").distinct(), ["request_id", "__q"], "left_anti").drop("__q")


def global_spans(parts: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """parts (doc, part, text, local_start, local_end) with start and end in the whole text: the lengths of the parts before are added.

    With whole (doc, text) the parts must make up that text, each at its place and to its end; where they do not, or there is none, start and
    end of the whole document are null. Parts are compared one by one: none are put together.
    """
    w = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    d = parts.withColumn("offset", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long"))
    d = d.withColumns({"start": F.col("offset") + F.col("local_start"), "end": F.col("offset") + F.col("local_end")})
    if whole is None:
        return d
    j = d.select("doc", "offset", "text").join(whole.select("doc", F.col("text").alias("__w")), "doc", "left")
    here = F.coalesce(F.substring("__w", F.col("offset").cast("int") + 1, F.length("text")) == F.col("text"), F.lit(False))
    g = j.groupBy("doc").agg((F.min(here) & (F.max(F.col("offset") + F.length("text")) == F.max(F.length("__w")))).alias("__fits"))
    d = d.join(g, "doc", "left")
    ok = F.coalesce("__fits", F.lit(False))
    return d.withColumns({c: F.when(ok, F.col(c)) for c in ("start", "end")}).drop("__fits")


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """V2 (request_id, code, record_id): ids that a dossier uses more than once. ids: request_id, record_id."""
    g = ids.groupBy("request_id", "record_id").agg(F.count("*").alias("n")).where("n > 1")
    return g.select("request_id", F.lit("duplicate_id").alias("code"), "record_id")


def duplicate_references(references: DataFrame) -> DataFrame:
    """V2 (request_id, code, record_id): lists that name an id more than once; record_id is the list. references: request_id, list, id (one row for each entry)."""
    g = references.groupBy("request_id", "list", "id").agg(F.count("*").alias("n")).groupBy("request_id", "list").agg(F.max("n").alias("n")).where("n > 1")
    return g.select("request_id", F.lit("duplicate_reference").alias("code"), F.col("list").alias("record_id"))


def dangling(child: DataFrame, parent: DataFrame, link: str, target: str, code: str, record: str) -> DataFrame:
    """V4 (request_id, code, record_id): links of child rows that lead to no parent row of the same request."""
    p = parent.select("request_id", F.col(target).alias(link)).distinct()
    return child.where(F.col(link).isNotNull()).join(p, ["request_id", link], "left_anti").select("request_id", F.lit(code).alias("code"), F.col(record).alias("record_id"))


def step_timing(steps: DataFrame, receipts: DataFrame, tolerance_ms: int = 2) -> DataFrame:
    """V8 (request_id, code, record_id): retries of no known call, completed steps that end before they start, start before the completed one before them has
    ended, were measured more than tolerance_ms off or lie outside the receipt, and receipts whose times do not give their duration (record_id is null).

    steps: request_id, step_id, ord, status, invocation_id, retry_of, start_ms, end_ms, measured_ms; receipts: request_id, start_ms, end_ms, total_ms. A receipt without both times bounds nothing.
    """
    done = F.col("status") == "completed"
    w = Window.partitionBy("request_id").orderBy("ord", "step_id").rowsBetween(Window.unboundedPreceding, -1)
    d = steps.withColumn("__before", F.last(F.when(done, F.col("end_ms")), True).over(w))
    r = receipts.select("request_id", F.col("start_ms").alias("__from"), F.col("end_ms").alias("__to")).where("__from is not null and __to is not null")
    known = steps.select("request_id", F.col("invocation_id").alias("retry_of"), F.lit(True).alias("__known")).distinct()
    d = d.join(r, "request_id", "left").join(known, ["request_id", "retry_of"], "left")
    start, end = F.col("start_ms"), F.col("end_ms")
    timed = (end >= start) & (start >= F.coalesce("__before", "start_ms")) & (F.abs(end - start - F.col("measured_ms")) <= tolerance_ms)
    outside = F.coalesce(start < F.col("__from"), F.lit(False)) | F.coalesce(end > F.col("__to"), F.lit(False))
    codes = F.array_compact(F.array(
        F.when(F.col("retry_of").isNotNull() & F.col("__known").isNull(), "execution_step_missing_retry_target"), F.when(done & ~F.coalesce(timed, F.lit(False)), "execution_step_invalid_timing"),
        F.when(done & outside, "execution_step_outside_receipt"),
    ))
    off = receipts.where(F.abs(F.col("end_ms") - F.col("start_ms") - F.col("total_ms")) > tolerance_ms)
    of = F.col("step_id").cast("string").alias("record_id")
    return d.select("request_id", F.explode(codes).alias("code"), of).unionByName(off.select("request_id", F.lit("receipt_duration_timestamp_mismatch").alias("code"), F.lit(None).cast("string").alias("record_id")))


def status_rules(dossiers: DataFrame) -> DataFrame:
    """V9 (request_id, code): what a status promises and the dossier does not hold.

    dossiers: request_id, status, mode, resolved, n_supported (factual claims), and of what is shown: n_visible (facts), n_business, n_categories, n_sources, n_pages,
    n_publishers, n_contradictions.
    """
    status, some = F.col("status"), F.col("n_supported") > 0
    complete, asks = status == "complete_within_scope", status == "needs_clarification"
    rules = {
        "complete_requires_resolved_identity": complete & ~F.col("resolved"), "complete_requires_three_visible_facts": complete & (F.col("n_visible") < 3), "complete_requires_three_business_facts": complete & (F.col("n_business") < 3),
        "complete_allows_at_most_six_business_facts": complete & (F.col("n_business") > 6), "complete_requires_two_business_categories": complete & (F.col("n_categories") < 2),
        "complete_requires_two_visible_sources": complete & (F.col("n_sources") < 2), "complete_requires_two_business_source_pages": complete & (F.col("n_pages") < 2),
        "complete_requires_two_publisher_domains": complete & (F.col("n_publishers") < 2), "complete_forbids_visible_contradiction": complete & (F.col("n_contradictions") > 0),
        "partial_requires_resolved_identity": (status == "partial") & ~F.col("resolved"), "needs_clarification_requires_unresolved_identity": asks & F.col("resolved"),
        "needs_clarification_forbids_supported_facts": asks & some, "insufficient_evidence_forbids_supported_facts": (status == "insufficient_evidence") & some, "silence_forbids_supported_facts": (F.col("mode") == "silence") & some,
    }
    codes = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return dossiers.select("request_id", F.explode(codes).alias("code"))
