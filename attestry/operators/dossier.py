"""Assembly rules over verified material: grounding, selected sources, unknowns, confidence, listings, identity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions import urls as u
from attestry.functions.text import plain_key

#: Causes of what a dossier leaves unknown, and the display category of a predicate's first word.
CAUSES = [
    "missing_categories", "discarded_proofs", "degraded_grounding", "attribution_rejections", "quality_rejections", "non_comparable_values", "identity_ambiguity", "silence",
]
DISPLAY = {"activity": "activity", "role": "people", "metric": "figures", "geography": "places", "event": "news", "recent_signal": "news"}
LEVELS = ["confirmed", "supported", "lead"]


def ground_failures(claims: DataFrame, proofs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Claims without a proof that keep their citation: grounding is provider_annotation for a citation, else search_snippet.

    Structured-output URLs are kept only where a page is known; URLs of hosts that are never read keep their citation too.
    claims: claim_id, url, has_page; proofs: claim_id; bindings: claim_id, binding_type.
    """
    rest = claims.join(proofs.select("claim_id").distinct(), "claim_id", "left_anti").join(bindings, "claim_id")
    kept = rest.where((F.col("binding_type") != "structured_output") | F.col("has_page"))
    return kept.select("claim_id", "url", F.when(F.col("binding_type") == "citation", "provider_annotation").otherwise("search_snippet").alias("grounding"), u.host(F.col("url")).rlike(r"(^|\.)linkedin\.com$").alias("never_read"))


def apply_selected_source(requests: DataFrame, candidates: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, facts) where a request that names a source keeps one anchor candidate, the first of equal name and type, and its facts only."""
    fixed = requests.where("source_url is not null and entity_type <> 'auto'").select("request_id", plain_key(F.col("name")).alias("__n"), F.col("entity_type").alias("__t"), "source_url")
    c = candidates.join(fixed, "request_id", "left").withColumn("__same", (plain_key(F.col("display_name")) == F.col("__n")) & (F.col("entity_type") == F.col("__t")))
    c = c.withColumn("__r", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(F.coalesce("__same", F.lit(False))), "ord")))
    kept = c.where(F.col("source_url").isNull() | (F.col("__same") & (F.col("__r") == 1)))
    kept = kept.withColumn("url", F.coalesce("source_url", "url")).select(*candidates.columns)
    return kept, facts.join(kept.select("request_id", F.col("candidate_key").alias("subject_key")), ["request_id", "subject_key"], "left_semi")


def build_unknowns(counts: DataFrame) -> DataFrame:
    """(request_id, cause, n) for each cause whose count is positive. counts: request_id and a column for each cause."""
    each = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(c).cast("long").alias("n")) for c in CAUSES if c in counts.columns])
    return counts.select("request_id", F.explode(each).alias("e")).select("request_id", "e.cause", "e.n").where("n > 0")


#: Fixed value: hosts of public bodies.
INSTITUTIONAL = r"(?:\.gouv\.fr|\.gov|\.gov\.[a-z]{2})$"


def confidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (claim_id, state; reconciliation, subject if there) with level: contested or contradicted is a lead; read directly from an official page or from two publishers,
    unless all its pages are of the network that is never read, is confirmed; read or annotated is supported; so is a snippet whose title or URL has the
    subject's name or whose host is a public body's; else a lead.

    evidence: claim_id, method (source_content, provider_annotation, search_snippet), official, url, and title and accessible (else all are) if there.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(x.nfkc(F.coalesce(c, F.lit(""))), x.SPACE + "+", " ")))
    e = evidence if "accessible" in evidence.columns else evidence.withColumn("accessible", F.lit(True))
    e = e if "title" in e.columns else e.withColumn("title", F.lit(None).cast("string"))
    host = F.lower(u.host(F.col("url")))
    direct = (F.col("method") == "source_content") & F.col("accessible")
    institution = F.coalesce(host.rlike(INSTITUTIONAL), F.lit(False))
    if "subject" in claims.columns:
        e = e.join(claims.select("claim_id", plain(F.col("subject")).alias("__s")), "claim_id")
        has = lambda text: (F.col("__s") != "") & plain(text).contains(F.col("__s"))
        institution = has(F.col("title")) | has(u.url_text(F.col("url"))) | institution
    # narrow rows of fixed width: one group a claim, combined before the shuffle
    e = e.select(
        "claim_id", direct.alias("d"), (direct & F.col("official")).alias("o"), F.when(direct, F.coalesce(u.publisher_domain(F.col("url")), F.lit(""))).alias("p"), (F.col("method") == "provider_annotation").alias("a"),
        F.coalesce(host.rlike(r"(^|\.)linkedin\.com$"), F.lit(False)).alias("l"), ((F.col("method") == "search_snippet") & institution).alias("s"),
    )
    first, second = x.halves(F.col("p"))
    e = e.withColumns({"p1": first, "p2": second})
    g = e.groupBy("claim_id").agg(F.max("d").alias("d"), F.max("o").alias("o"), x.several(F.col("p1"), F.col("p2")).alias("n"), F.max("a").alias("a"), F.min("l").alias("l"), F.max("s").alias("s"))
    against = F.col("state") == "contested"
    if "reconciliation" in claims.columns:
        against = against | (F.col("reconciliation") == "contradiction")
    level = (
        F.when(against, "lead").when(~F.col("l") & F.col("d") & (F.col("o") | F.col("n")), "confirmed").when(F.col("d") | F.col("a"), "supported").when(F.col("s"), "supported").otherwise("lead")
    )
    return claims.join(g, "claim_id", "left").select(*claims.columns, level.alias("level"))


def list_facts(claims: DataFrame) -> DataFrame:
    """claims (request_id, claim_id, predicate, level, ord) with display category and position: by confidence, then order."""
    head = F.substring_index("predicate", ".", 1)
    display = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv]), head), F.lit("other"))
    w = Window.partitionBy("request_id").orderBy(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), "ord", "claim_id")
    return claims.select("request_id", "claim_id", display.alias("display"), F.row_number().over(w).cast("long").alias("position"))


def identity_rules(dossiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """V3 (request_id, code): a resolved identity has exactly one selected candidate, which exists; others have none.

    dossiers: request_id, status, selected_key; candidates: request_id, candidate_key, selected.
    """
    g = candidates.groupBy("request_id").agg(F.sum(F.col("selected").cast("int")).alias("n"), F.collect_set(F.when(F.col("selected"), F.col("candidate_key"))).alias("keys"))
    j = dossiers.join(g, "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    resolved = F.col("status") == "resolved"
    codes = F.array_compact(F.array(
        F.when(resolved & (F.col("n") != 1), "resolved_identity_requires_exactly_one_candidate"),
        F.when(resolved & ~F.coalesce(F.array_contains("keys", F.col("selected_key")), F.lit(False)), "resolved_identity_missing_selected_candidate"),
        F.when(~resolved & (F.col("n") > 0), "unresolved_identity_has_selected_candidate"),
    ))
    return j.select("request_id", F.explode(codes).alias("code"))
