"""Validation over dossier tables: every rule is a query that returns its violations as (request_id, code, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as x

#: States of factual claims, categories of business facts, ways a proof is known, allowed values of columns.
FACTUAL = ["supported", "contested", "historical"]
BUSINESS = ["activity", "role", "metric", "geography", "event", "recent_signal", "other"]
METHODS = ["source_content", "provider_annotation", "search_snippet"]
ENUMS = {
    "state": ["supported", "contested", "historical", "ambiguous", "rejected"], "reconciliation": ["confirmation", "explainable_difference", "contradiction", "indetermination", "not_applicable"],
    "decision": ["display_fact", "display_ambiguity", "reject"], "temporal_status": ["current", "historical", "unknown"],
}
FORMATS = {"url": "^https?://[^\\s/]+", "claim_id": "^\\S+$"}


def schema_check(table: DataFrame, key: str, required: list[str], enums: dict[str, list[str]] = ENUMS, bounds: dict[str, tuple[float, float]] | None = None, formats: dict[str, str] = FORMATS) -> DataFrame:
    """V1: (key, path, keyword) for every column that is missing (required), of another value (enum), out of bounds (range) or malformed (format)."""
    has = set(table.columns)
    rules = [(c, "required", F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")) for c in required if c in has]
    rules += [(c, "enum", ~F.col(c).isin(*v)) for c, v in enums.items() if c in has]
    rules += [(c, "range", ~F.col(c).between(*v)) for c, v in (bounds or {}).items() if c in has]
    rules += [(c, "format", ~F.col(c).rlike(v)) for c, v in formats.items() if c in has]
    hits = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(c).alias("path"), F.lit(k).alias("keyword"))) for c, k, bad in rules]))
    return table.select(key, F.explode(hits).alias("h")).select(key, "h.*")


def shown_claims(dossiers: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame, presented: DataFrame, presented_sources: DataFrame) -> DataFrame:
    """V5: what is shown must be factual, of a known category, dated and scoped if a metric, of a resolved identity, listed, and proved.

    dossiers: request_id, status; claims: request_id, claim_id, subject_key, predicate, statement, state, decision, temporal_status, dated, scope_type,
    scope_label; evidence: claim_id, source_id, entity_key, relation, method, excerpt; sources: source_id, assumed_key; presented: claim_id (listed,
    or in a listed visible contradiction); presented_sources: request_id, source_id.
    """
    same = lambda c: F.trim(F.regexp_replace(x.nfkc(F.col(c)), x.SPACE + "+", " "))
    shown = F.col("decision") == "display_fact"
    factual = shown & F.col("state").isin(*FACTUAL)
    head = F.substring_index("predicate", ".", 1)
    e = claims.where(factual).select("request_id", "claim_id", "subject_key", "statement").join(evidence.where((F.col("relation") == "supports") & F.col("method").isin(*METHODS)), "claim_id").join(sources, "source_id")
    e = e.where((F.col("entity_key") == F.col("subject_key")) & (F.col("assumed_key") == F.col("subject_key")) & (same("excerpt") == same("statement")))
    e = e.join(presented_sources.select("request_id", "source_id").distinct().withColumn("__s", F.lit(True)), ["request_id", "source_id"], "left")
    proof = e.groupBy("claim_id").agg(F.lit(True).alias("__q"), F.max(F.coalesce("__s", F.lit(False))).alias("__v"))
    d = claims.join(dossiers.select("request_id", "status"), "request_id").join(proof, "claim_id", "left").join(presented.select("claim_id").distinct().withColumn("__p", F.lit(True)), "claim_id", "left")
    metric = F.col("predicate").startswith("metric.")
    codes = [
        ((F.col("temporal_status") == "current") & ~F.col("dated"), "current_claim_without_dated_fact_period"), (shown & ~F.col("state").isin(*FACTUAL), "displayed_claim_has_non_factual_state"),
        (factual & ~head.isin(*BUSINESS) & ~F.col("predicate").startswith("identity."), "displayed_claim_unknown_category"),
        (factual & metric & (~F.col("dated") | (F.col("scope_type") == "undetermined") | F.col("scope_label").isNull()), "displayed_metric_requires_period_and_scope"),
        (factual & (F.col("status") != "resolved"), "displayed_claim_requires_resolved_identity"), (factual & F.col("__p").isNull(), "displayed_claim_not_presented"),
        (factual & F.col("__q").isNull(), "displayed_claim_without_attributable_evidence"), (factual & F.col("__q").isNotNull() & ~F.col("__v"), "displayed_claim_source_not_presented"),
    ]
    return d.select("request_id", "claim_id", F.explode(F.array_compact(F.array(*[F.when(c, code) for c, code in codes]))).alias("code"))


def presentation_rules(lists: DataFrame, claims: DataFrame, others: DataFrame, summary_limit: int = 3) -> DataFrame:
    """V7: (request_id, code, id): what a dossier lists must exist and be of the kind its list is for.

    lists: request_id, list (key_fact, recent_signal, ambiguity, summary, contradiction, unknown, source), id; claims: request_id, claim_id,
    predicate, state, reconciliation, decision; others: request_id, list, id, visible (contradictions, unknowns and sources there are).
    """
    d = lists.join(claims.select("request_id", F.col("claim_id").alias("id"), "predicate", "state", "reconciliation", "decision", F.lit(True).alias("__c")), ["request_id", "id"], "left")
    d = d.join(others.select("request_id", "list", "id", F.col("visible").alias("__visible"), F.lit(True).alias("__o")), ["request_id", "list", "id"], "left")
    of = F.col("list")
    there = F.col("__c").isNotNull()
    fact = there & F.coalesce(F.col("state").isin(*FACTUAL) & (F.col("decision") == "display_fact"), F.lit(False))
    unresolved = F.coalesce((F.col("state") == "contested") | (F.col("reconciliation") == "indetermination"), F.lit(False))
    business = F.substring_index("predicate", ".", 1).isin(*BUSINESS)
    codes = [((of == k) & ~fact, f"presentation_invalid_{k}") for k in ("key_fact", "recent_signal")] + [((of == k) & unresolved, f"presentation_{k}_forbids_unresolved") for k in ("key_fact", "recent_signal")]
    codes += [
        ((of == "ambiguity") & ~F.coalesce((F.col("state") == "ambiguous") & (F.col("decision") == "display_ambiguity"), F.lit(False)), "presentation_invalid_ambiguity"),
        ((of == "summary") & ~fact, "summary_requires_displayed_fact"), ((of == "summary") & there & ~business, "summary_requires_business_fact"), ((of == "summary") & unresolved, "summary_forbids_unresolved_fact"),
        ((of == "contradiction") & F.col("__o").isNotNull() & ~F.coalesce("__visible", F.lit(False)), "presentation_hidden_contradiction"),
    ] + [((of == k) & F.col("__o").isNull(), f"presentation_missing_{k}") for k in ("contradiction", "unknown", "source")]
    each = d.select("request_id", F.explode(F.array_compact(F.array(*[F.when(c, code) for c, code in codes]))).alias("code"), "id")
    many = lists.where("list = 'summary'").groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") > summary_limit)
    return each.unionByName(many.select("request_id", F.lit("summary_allows_at_most_three_items").alias("code"), F.lit(None).cast("string").alias("id")))


def first_issue(found: DataFrame, order: list[str]) -> DataFrame:
    """(request_id, code, id): the first issue of each dossier that must hide it, in the order of codes given; codes that are not listed come last."""
    place = reduce(lambda acc, kv: acc.when(F.col("code") == kv[1], kv[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order))
    g = found.groupBy("request_id").agg(F.min(F.struct(place.alias("place"), "code", "id")).alias("m"))
    return g.select("request_id", "m.code", "m.id")


def contradiction_rules(contradictions: DataFrame, versions: DataFrame, claims: DataFrame, presented: DataFrame) -> DataFrame:
    """V6, the rules that need no metric sentence: (request_id, code, id) of visible contradictions and their versions.

    contradictions: request_id, contradiction_id, visible, classification, nature_checked, predicate, subject_key; versions: contradiction_id, claim_id,
    normalized_value, unit, currency; claims: claim_id, subject_key, predicate, state, reconciliation, decision, value (a number), unit; presented: contradiction_id.
    """
    c = contradictions.where("visible").join(presented.select("contradiction_id").distinct().withColumn("__p", F.lit(True)), "contradiction_id", "left")
    text = lambda name: x.conflict_text(F.col(name))
    number = F.col("normalized_value")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    j = versions.join(claims.select("claim_id", F.col("subject_key").alias("__s"), F.col("predicate").alias("__cp"), "state", "reconciliation", "decision", "value", F.col("unit").alias("__cu"), F.lit(True).alias("__c")), "claim_id", "left")
    g = j.groupBy("contradiction_id").agg(
        F.count("*").alias("n"), F.count_distinct("claim_id").alias("n_claims"), F.max(~finite).alias("odd"), F.count_distinct("normalized_value").alias("n_values"),
        F.count_distinct(F.concat_ws("|", text("unit"), text("currency"))).alias("n_units"), F.collect_set("__s").alias("subjects"))
    d = c.join(g, "contradiction_id", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    codes = [
        (F.col("__p").isNull(), "not_presented"), (F.col("classification") != "contradiction", "wrong_classification"), (~F.col("nature_checked"), "requires_value_nature_check"), (n("n") < 2, "needs_two_versions"),
        (n("n_claims") < 2, "needs_distinct_claims"), (F.coalesce("odd", F.lit(False)), "requires_finite_numeric_values"), (n("n_values") < 2, "needs_distinct_values"), (n("n_units") != 1, "requires_same_unit_currency"),
        (~F.coalesce((F.size("subjects") == 1) & F.array_contains("subjects", F.col("subject_key")), F.lit(False)), "requires_same_resolved_subject"),
    ]
    whole = d.select("request_id", F.explode(F.array_compact(F.array(*[F.when(k, f"visible_contradiction_{code}") for k, code in codes]))).alias("code"), F.col("contradiction_id").alias("id"))
    e = j.join(c.select("contradiction_id", "request_id", "predicate"), "contradiction_id")
    there = F.col("__c").isNotNull()
    contested = F.coalesce((F.col("state") == "contested") & (F.col("reconciliation") == "contradiction") & (F.col("decision") == "display_fact"), F.lit(False))
    each = [
        (~contested, "requires_contested_claim"), (there & (text("__cp") != text("predicate")), "predicate_mismatch"), (there & (text("__cu") != text("unit")), "unit_mismatch"),
        (there & ~F.col("value").eqNullSafe(number), "value_mismatch"),
    ]
    of = F.concat_ws(":", "contradiction_id", "claim_id")
    return whole.unionByName(e.select("request_id", F.explode(F.array_compact(F.array(*[F.when(k, f"visible_contradiction_{code}") for k, code in each]))).alias("code"), of.alias("id")))
