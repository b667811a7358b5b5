"""Visible contradictions against the sentences and documents behind their versions (the rules of V6 that need them)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions.numbers import period_key
from attestry.functions.urls import conflict_page_key
from attestry.operators import metrics as m
from attestry.sources.tables import settled


def _same_text(a: str, b: str) -> Column:
    return x.conflict_text(F.col(a)) == x.conflict_text(F.col(b))


def grounding_rules(contradictions: DataFrame, versions: DataFrame, claims: DataFrame, links: DataFrame, cited: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, code, id): what a visible contradiction says and its versions' sentences, evidence or sources do not.

    contradictions: request_id, contradiction_id, visible, display_name (of the selected subject), period (a key of all its fields), period_status,
    period_text (label and dates), scope_type, scope_label; versions: contradiction_id, claim_id, normalized_value, unit, currency; claims: claim_id,
    subject_key, predicate, statement, period, scope_type, scope_label; links: claim_id, evidence_id (what a claim points to); cited: contradiction_id, claim_id,
    evidence_id (what a version points to); evidence: evidence_id, claim_id, entity_key, source_id, period, scope_type, scope_label, relation, method,
    excerpt, url, digest; sources: source_id, assumed_key, scope_type, scope_label, accessible, url. Claims, evidence and sources that are missing are
    left to the rules of links.
    """
    c = contradictions.where("visible").select(
        "request_id", "contradiction_id", "display_name", F.col("period").alias("c_period"), "period_status", "period_text", F.col("scope_type").alias("c_type"), F.col("scope_label").alias("c_label"))
    v = versions.join(c, "contradiction_id")
    j = v.join(claims, "claim_id").withColumn("subject", F.when(F.col("scope_label").isNotNull() & _same_text("scope_label", "display_name"), F.col("display_name")))
    j = settled(m.observe_metrics(j, "statement", "subject"), "grounding")
    o = F.col("obs")
    metric = F.coalesce(
        (m.declared_metric(F.col("predicate")) == o["metric"]) & (x.conflict_text(F.col("currency")) == x.conflict_text(o["currency"])) & m.unit_fits(F.col("unit"), o)
        & m.scope_fits(F.col("scope_type"), o) & m.scope_fits(F.col("c_type"), o), F.lit(False))
    period = F.coalesce((F.col("period_status") == "stated") & (period_key(F.col("period_text")) == o["period_key"]), F.lit(False))
    nature = F.coalesce(o["nature"] != "unknown", F.lit(False))
    scope = _same_text("scope_type", "c_type") & _same_text("scope_label", "c_label")
    j = j.withColumns({"metric_ok": metric, "period_ok": period, "nature_ok": nature, "value_ok": F.coalesce(o["value"] == F.col("normalized_value"), F.lit(False))})
    of = lambda name: F.concat_ws(":", "contradiction_id", name)
    rows = lambda d, codes, id_: d.select("request_id", F.explode(F.array_compact(F.array(*[F.when(k, f"visible_contradiction_{code}") for k, code in codes]))).alias("code"), id_.alias("id"))
    each = rows(j, [
        (~F.col("period").eqNullSafe(F.col("c_period")), "period_mismatch"), (~scope, "scope_mismatch"), (~F.col("metric_ok"), "metric_not_grounded"), (~F.col("period_ok"), "period_not_grounded"),
        (~F.col("nature_ok"), "value_nature_not_grounded"), (~F.col("value_ok"), "value_not_grounded"),
    ], of("claim_id"))

    e = evidence.select(
        "evidence_id", F.col("claim_id").alias("e_claim"), "entity_key", "source_id", F.col("period").alias("e_period"), F.col("scope_type").alias("e_type"), F.col("scope_label").alias("e_label"), "relation", "method", "excerpt",
        conflict_page_key(F.col("url")).alias("e_page"), F.lower("digest").alias("digest"))
    s = sources.select("source_id", "assumed_key", F.col("scope_type").alias("s_type"), F.col("scope_label").alias("s_label"), "accessible", conflict_page_key(F.col("url")).alias("s_page"))
    own = claims.select("claim_id", "subject_key", "statement", F.lit(True).alias("there"))
    k = cited.join(c, "contradiction_id").join(e, "evidence_id").join(own, "claim_id", "left").join(links.select("claim_id", "evidence_id").distinct().withColumn("linked", F.lit(True)), ["claim_id", "evidence_id"], "left").join(s, "source_id", "left")
    plain = lambda n: F.trim(F.regexp_replace(x.nfkc(F.col(n)), x.SPACE + "+", " "))
    bound, of_source = F.coalesce("linked", F.lit(False)), F.col("accessible").isNotNull()
    source_scope = _same_text("s_type", "c_type") & _same_text("s_label", "c_label")
    good = (
        bound & F.col("accessible") & (F.col("relation") == "supports") & (F.col("method") == "source_content") & (F.col("entity_key") == F.col("subject_key")) & (F.col("assumed_key") == F.col("subject_key"))
        & (plain("excerpt") == plain("statement")) & source_scope & (F.col("s_page") == F.col("e_page")) & F.col("digest").rlike("^[0-9a-f]{64}$")
    )
    k = settled(k.withColumns({
        "good": F.coalesce(good, F.lit(False)), "invalid": (F.col("e_claim") != F.col("claim_id")) | F.col("there").isNull() | ~bound, "off_period": ~F.col("e_period").eqNullSafe(F.col("c_period")),
        "off_scope": ~(_same_text("e_type", "c_type") & _same_text("e_label", "c_label")), "off_source": of_source & ~source_scope,
    }), "grounding-evidence")
    proofs = rows(k, [(F.col("invalid"), "invalid_evidence"), (F.col("off_period"), "evidence_period_mismatch"), (F.col("off_scope"), "evidence_scope_mismatch")], of("evidence_id"))
    proofs = proofs.unionByName(rows(k, [(F.col("off_source"), "source_scope_mismatch")], of("source_id")))
    none = v.join(k.where("good"), ["contradiction_id", "claim_id"], "left_anti")
    proofs = proofs.unionByName(rows(none, [(F.lit(True), "version_requires_qualifying_page")], of("claim_id")))

    held = k.where("good").select("contradiction_id", "source_id", F.col("claim_id").alias("value"), F.col("s_page").alias("page"), "digest")
    apart = held.join(m.witnesses(held, ["contradiction_id"]), "contradiction_id")
    apart = apart.where(F.exists("witnesses", lambda w: reduce(Column.__and__, [w[n] != F.col(n) for n in m.APART]))).select("contradiction_id", F.lit(True).alias("apart")).distinct()
    docs = held.groupBy("contradiction_id").agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("page").alias("pages"), F.count_distinct("digest").alias("digests"))
    said = j.groupBy("contradiction_id").agg(
        F.count_distinct(F.when(F.col("metric_ok"), F.concat_ws("|", o["metric"], o["definition"], F.coalesce(o["currency"], F.lit("")), o["scope_kind"]))).alias("metrics"),
        F.count_distinct(F.when(F.col("period_ok"), o["period_key"])).alias("periods"), F.count_distinct(F.when(F.col("nature_ok"), o["nature"])).alias("natures"))
    g = c.join(docs, "contradiction_id", "left").join(apart, "contradiction_id", "left").join(said, "contradiction_id", "left").fillna(0)
    whole = rows(g, [
        ((F.col("sources") < 2) | (F.col("pages") < 2), "requires_two_source_pages"), ((F.col("digests") < 2) | F.col("apart").isNull(), "requires_two_source_documents"), (F.col("metrics") != 1, "requires_same_grounded_metric"),
        (F.col("periods") != 1, "requires_same_grounded_period"), (F.col("natures") != 1, "requires_same_grounded_value_nature"),
    ], F.col("contradiction_id"))
    return each.unionByName(proofs).unionByName(whole)
