"""The stricter suite over stored dossiers (V11): each function reads some of their tables and returns its violations as (request_id, code, id).

Ids are unique inside a request; every join is on request_id and an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that may be shown, ways a proof counts as final, kinds of sources that are never proof, the redirect host,
#: the statement that silence needs, measurements of a receipt, and property names that a dossier must not have.
SHOWABLE = ["supported", "contested", "historical"]
FINAL_METHODS = ["source_content", "institutional_record", "manual_verification"]
NEVER_PROOF = ["aggregator", "search_result"]
REDIRECT_HOST = "vertexaisearch.cloud.google.com"
SILENCE = "Aucune source suffisamment fiable n’a été trouvée dans le périmètre de cette recherche."
MEASUREMENTS = ["total_duration_ms", "latency_ms", "provider_calls", "input_tokens", "output_tokens", "total_tokens", "amount_usd"]
FORBIDDEN = '"[^"]*(?:percent|percentage|progress)[^"]*"\\s*:'
HTTP = "(?i)^https?://[^\\s/]+"


def _no(c: Column) -> Column:
    """True where c is false or unknown."""
    return ~F.coalesce(c, F.lit(False))


def _found(d: DataFrame, rules: dict[str, Column], of: Column | None = None) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(bad, code) for code, bad in rules.items()]))
    return d.select("request_id", F.explode(codes).alias("code"), (F.lit(None) if of is None else of).cast("string").alias("id"))


def dossier_states(dossiers: DataFrame) -> DataFrame:
    """Status, identity, mode and error that do not go together, and the receipt's measurements.

    dossiers: request_id, status, identity_status, mode, error, body (its JSON), and the columns of MEASUREMENTS.
    """
    status, mode = F.col("status"), F.col("mode")
    failed, none = status == "technical_failure", status == "insufficient_evidence"
    found = _found(dossiers, {
        "clarification_requires_ambiguous_or_insufficient_identity": (status == "needs_clarification") & _no(F.col("identity_status").isin("ambiguous", "insufficient_context")),
        "insufficient_evidence_requires_silence_mode": none & _no(mode == "silence"),
        "insufficient_evidence_has_incompatible_identity_state": none & _no(F.col("identity_status").isin("resolved", "not_found_within_scope")),
        "technical_failure_requires_error": failed & (_no(mode == "technical_error") | F.col("error").isNull()), "technical_error_must_use_technical_failure": _no(failed) & F.col("error").isNotNull(),
        "silence_must_be_nontechnical_insufficient_evidence": (mode == "silence") & (_no(none) | F.col("error").isNotNull()),
        "total_tokens_below_input_plus_output": F.col("total_tokens") < F.col("input_tokens") + F.col("output_tokens"), "forbidden_progress_property": F.col("body").rlike("(?i)" + FORBIDDEN),
    })
    bad = F.filter(F.array(*[F.when(_no(F.col(m) >= 0), m) for m in MEASUREMENTS]), lambda m: m.isNotNull())
    return found.unionByName(dossiers.select("request_id", F.lit("negative_or_missing_measurement").alias("code"), F.explode(bad).alias("id")))


def empty_ids(ids: DataFrame) -> DataFrame:
    """ids: request_id, kind, record_id."""
    return _found(ids, {"empty_id": F.trim(F.coalesce("record_id", F.lit(""))) == ""}, F.col("kind"))


def source_urls(sources: DataFrame, fields: tuple[str, ...] = ("provider_url", "resolved_url", "canonical_url")) -> DataFrame:
    """invalid_http_url for each field that holds anything but an http address. sources: request_id, source_id, fields."""
    bad = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & ~F.col(f).rlike(HTTP), f) for f in fields]))
    d = sources.select("request_id", "source_id", F.explode(bad).alias("f"))
    return d.select("request_id", F.lit("invalid_http_url").alias("code"), F.concat_ws(":", "source_id", "f").alias("id"))


def claim_states(claims: DataFrame, cited: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """What a shown claim lacks, and states that do not fit the decision or the time.

    claims: request_id, claim_id, subject_id, state, decision, temporal_status, period_status (null without a period), has_marker, is_number, unit, scope_type;
    cited: request_id, claim_id, evidence_id; evidence: request_id, evidence_id, source_id, entity_id, relation, method, scope_type;
    sources: request_id, source_id, resolved_url, canonical_url, access, compliance, kind, assumed_id.

    A proof is final if it supports the claim's own subject and scope by a final method, from a permitted, accessible
    source that is no search result and has an address other than a redirect. Only narrow columns meet in the joins.
    """
    direct = lambda c: F.col(c).rlike(HTTP) & (F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)) != REDIRECT_HOST)
    s = sources.where((F.col("access") == "accessible") & (F.col("compliance") == "permitted") & ~F.coalesce(F.col("kind").isin(*NEVER_PROOF), F.lit(False)))
    s = s.where(F.coalesce(direct("resolved_url"), F.lit(False)) | F.coalesce(direct("canonical_url"), F.lit(False)))
    e = evidence.where((F.col("relation") == "supports") & F.col("method").isin(*FINAL_METHODS)).select("request_id", "evidence_id", "source_id", "entity_id", F.col("scope_type").alias("__scope"))
    e = e.join(s.select("request_id", "source_id", "assumed_id"), ["request_id", "source_id"])
    shown = F.col("decision") == "display_fact"
    c = cited.join(claims.where(shown).select("request_id", "claim_id", "subject_id", "scope_type"), ["request_id", "claim_id"]).join(e, ["request_id", "evidence_id"], "left")
    good = F.col("source_id").isNotNull() & F.col("entity_id").eqNullSafe(F.col("subject_id")) & F.col("assumed_id").eqNullSafe(F.col("subject_id")) & F.col("__scope").eqNullSafe(F.col("scope_type"))
    proof = c.groupBy("request_id", "claim_id").agg(F.max(good).alias("__final"))
    d = claims.join(proof, ["request_id", "claim_id"], "left")
    state, period, number = F.col("state"), F.col("period_status"), shown & F.col("is_number")
    return _found(d, {
        "displayed_claim_has_forbidden_state": shown & _no(state.isin(*SHOWABLE)), "displayed_claim_without_evidence": shown & F.col("__final").isNull(),
        "displayed_claim_without_final_support": shown & _no(F.col("__final")), "displayed_claim_without_temporal_qualification": shown & period.isNull(),
        "current_claim_without_temporal_qualification": shown & period.isNotNull() & (F.col("temporal_status") == "current") & (~period.isin("stated", "derived") | _no(F.col("has_marker"))),
        "quantitative_claim_without_unit": number & (F.trim(F.coalesce("unit", F.lit(""))) == ""), "quantitative_claim_without_scope": number & (F.col("scope_type") == "undetermined"),
        "quantitative_claim_without_period": number & (F.coalesce(period, F.lit("unknown")) == "unknown"),
        "ambiguous_claim_outside_ambiguity": (state == "ambiguous") & _no(F.col("decision") == "display_ambiguity"), "rejected_claim_presented": (state == "rejected") & _no(F.col("decision") == "reject"),
        "historical_claim_not_temporally_historical": (state == "historical") & _no(F.col("temporal_status") == "historical"),
    }, F.col("claim_id"))


def inference_states(inferences: DataFrame, claims: DataFrame) -> DataFrame:
    """inference_based_on_non_displayable_claim. inferences: request_id, inference_id, claim_id (one row for each claim it rests on)."""
    j = inferences.join(claims.select("request_id", "claim_id", "state"), ["request_id", "claim_id"])
    return _found(j, {"inference_based_on_non_displayable_claim": _no(F.col("state").isin(*SHOWABLE))}, F.concat_ws(":", "inference_id", "claim_id"))


def conflict_states(contradictions: DataFrame, versions: DataFrame, cited: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Contradictions with too few versions or values, or versions whose claims or evidence are missing or of another state or claim.

    contradictions: request_id, contradiction_id, classification, visible, nature_checked; versions: request_id, contradiction_id, claim_id, normalized_value;
    cited: request_id, contradiction_id, claim_id, evidence_id; claims: request_id, claim_id, state; evidence: request_id, evidence_id, claim_id.
    """
    key = ["request_id", "contradiction_id"]
    # a version without a value has a value of its own
    g = versions.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("claim_id", F.lit(""))).alias("n_claims"), F.count_distinct(F.coalesce(F.col("normalized_value").cast("string"), F.lit("null"))).alias("n_values"))
    d = contradictions.join(g, key, "left").fillna(0, ["n", "n_claims", "n_values"])
    real = F.col("classification") == "contradiction"
    whole = _found(d, {
        "conflict_needs_two_versions": F.col("n") < 2, "conflict_versions_must_reference_distinct_claims": F.col("n_claims") < F.col("n"), "contradiction_must_be_visible": real & _no(F.col("visible")),
        "contradiction_requires_published_estimated_check": real & _no(F.col("nature_checked")), "contradiction_requires_distinct_values": real & (F.col("n_values") < 2),
    }, F.col("contradiction_id"))
    c = claims.select("request_id", "claim_id", "state", F.lit(True).alias("__c"))
    v = versions.select(*key, "claim_id").join(c, ["request_id", "claim_id"], "left")
    each = _found(v, {"conflict_missing_claim": F.col("__c").isNull(), "conflict_claim_not_contested": F.col("__c").isNotNull() & _no(F.col("state") == "contested")}, F.concat_ws(":", "contradiction_id", "claim_id"))
    e = evidence.select("request_id", "evidence_id", F.col("claim_id").alias("__of"), F.lit(True).alias("__e"))
    p = cited.join(c, ["request_id", "claim_id"], "left_semi").join(e, ["request_id", "evidence_id"], "left")
    proofs = _found(p, {"conflict_missing_evidence": F.col("__e").isNull(), "conflict_evidence_claim_mismatch": F.col("__e").isNotNull() & _no(F.col("__of") == F.col("claim_id"))}, F.concat_ws(":", "contradiction_id", "evidence_id"))
    return whole.unionByName(each).unionByName(proofs)


def listed_states(lists: DataFrame, claims: DataFrame, inferences: DataFrame) -> DataFrame:
    """What a dossier lists must exist and be fit for the list. lists: request_id, list (key_fact, recent_signal, ambiguity, summary), kind (of summary items), id; inferences: request_id, inference_id."""
    d = lists.join(claims.select("request_id", F.col("claim_id").alias("id"), "state", "decision", F.lit(True).alias("__c")), ["request_id", "id"], "left")
    d = d.join(inferences.select("request_id", F.col("inference_id").alias("id")).distinct().withColumn("__i", F.lit(True)), ["request_id", "id"], "left")
    of, there, may = F.col("list"), F.col("__c").isNotNull(), F.col("state").isin(*SHOWABLE)
    fact, doubt, summary = of.isin("key_fact", "recent_signal"), of == "ambiguity", of == "summary"
    named = F.when(fact, F.concat_ws(":", "list", "id")).otherwise(F.col("id"))
    return _found(d, {
        "presentation_missing_claim": fact & ~there, "presentation_non_displayable_claim": fact & there & _no(may & (F.col("decision") == "display_fact")),
        "presentation_missing_ambiguity_claim": doubt & ~there, "presentation_ambiguity_requires_ambiguous_claim": doubt & there & _no(F.col("state") == "ambiguous"),
        "summary_missing_or_non_displayable_claim": summary & (F.col("kind") == "claim") & _no(there & may), "summary_missing_inference": summary & (F.col("kind") == "inference") & F.col("__i").isNull(),
    }, named)


def silence_states(dossiers: DataFrame, claims: DataFrame, lists: DataFrame, unknowns: DataFrame) -> DataFrame:
    """A silent dossier shows no fact and says so in the fixed words. unknowns: request_id, category, description."""
    mute = dossiers.where("mode = 'silence'").select("request_id")
    told = claims.where("decision = 'display_fact'").select("request_id").unionByName(lists.where("list in ('key_fact', 'recent_signal', 'summary')").select("request_id")).distinct()
    said = unknowns.where((F.col("category") == "no_reliable_source") & (F.col("description") == SILENCE)).select("request_id").distinct()
    code = lambda d, c: d.select("request_id", F.lit(c).alias("code"), F.lit(None).cast("string").alias("id"))
    return code(mute.join(told, "request_id", "left_semi"), "silence_forbids_displayed_claims").unionByName(code(mute.join(said, "request_id", "left_anti"), "silence_requires_bounded_canonical_statement"))


def step_states(dossiers: DataFrame, steps: DataFrame) -> DataFrame:
    """Failed and unfinished steps against the status, and retries. steps: request_id, step_id, invocation_id, status, attempt, retry_of, duration_ms."""
    g = steps.groupBy("request_id").agg(F.max(F.col("status") == "failed").alias("failed"), F.max(_no(F.col("status").isin("completed", "skipped"))).alias("open"))
    d = dossiers.select("request_id", "status", "error").join(g, "request_id", "left").fillna(False, ["failed", "open"])
    technical = F.col("status") == "technical_failure"
    whole = _found(d, {
        "technical_event_must_not_be_insufficient_evidence": (F.col("failed") | F.col("error").isNotNull()) & _no(technical), "technical_failure_requires_failed_step": technical & ~F.col("failed"),
        "complete_dossier_has_unfinished_step": (F.col("status") == "complete_within_scope") & F.col("open"),
    })
    known = steps.select("request_id", F.col("invocation_id").alias("retry_of")).distinct().withColumn("__k", F.lit(True))
    j = steps.join(known, ["request_id", "retry_of"], "left")
    again = F.col("attempt") > 1
    own = _found(j, {"retry_missing_prior_invocation": again & F.col("__k").isNull(), "first_attempt_cannot_be_retry": _no(again) & F.col("retry_of").isNotNull()}, F.col("invocation_id"))
    return whole.unionByName(own).unionByName(_found(j, {"negative_step_duration": F.col("duration_ms") < 0}, F.col("step_id")))
