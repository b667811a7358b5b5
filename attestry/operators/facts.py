"""Facts: periods, quality, merge, caps, sources, completeness, identity independence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions import urls as u
from attestry.functions.numbers import metric_value
from attestry.operators.directory import directory_role
from attestry.operators.names import with_named

#: Month names of dates in French and English, without accents.
MONTHS = {
    1: "janvier|january|jan", 2: "fevrier|february|fev|feb", 3: "mars|march|mar", 4: "avril|april|avr|apr", 5: "mai|may", 6: "juin|june|jun",
    7: "juillet|july|jul", 8: "aout|august|aug", 9: "septembre|september|sept|sep", 10: "octobre|october|oct", 11: "novembre|november|nov", 12: "decembre|december|dec",
}
CURRENT = r"(?i)(?:^|[\s,(])(?:actuellement|à ce jour|currently|current as of)(?=$|[\s,.;:])"
LEGAL = r"(?i)\s+(?:AG|Corp(?:oration)?|GmbH|Group|Groupe|Inc|LLC|Ltd|PLC|SA|SAS|SASU|SE)\.?$"
PERSON_PAIR = r"\b\p{Lu}[\p{L}'’-]+\s+\p{Lu}[\p{L}'’-]+\b"
RELATION = r"(?i)\b(?:chez|de|d['’]|du|of|at|pour|for)\b"
CATEGORIES = 2, 3, 6  # least categories, least and most facts of a complete dossier


def fact_period(facts: DataFrame) -> DataFrame:
    """facts (excerpt, fact_date, fact_period_label) with period: status, start, end, as_of, label.

    The label must stand in the excerpt. A year alone is that year; an ISO date counts if the label says the same
    day (ISO, day first, or with a month name) and, when the label is the ISO text itself, stands alone. Else unknown.
    """
    norm = x.conflict_text
    label = F.coalesce("fact_period_label", "fact_date")
    d = facts.withColumns({"__l": norm(label), "__e": norm(F.col("excerpt")), "__d": F.col("fact_date"), "__label": label})
    l, e, d_ = F.col("__l"), F.col("__e"), F.col("__d")
    alone = lambda text, lit: F.rlike(text, F.concat(F.lit(r"(?:^|[^\d])\Q"), lit, F.lit(r"\E(?=$|[^\d])")))
    year_ok = d_.rlike(r"^[1-9]\d{3}$") & alone(l, d_) & alone(e, d_)
    day = F.when(d_.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(d_, F.lit("yyyy-MM-dd")))
    y, m, dd = F.year(day), F.month(day), F.dayofmonth(day)
    numeric = r"\b(\d{1,2})[/. -](\d{1,2})[/. -](\d{4})\b"
    part = lambda i: F.regexp_extract(l, numeric, i).try_cast("int")
    named = reduce(lambda acc, kv: acc.when(l.rlike(rf"\b(?:{kv[1]})\b"), kv[0]), MONTHS.items(), F.when(F.lit(False), 0))
    numbers = F.transform(F.regexp_extract_all(l, F.lit(r"\b\d{1,4}\b"), F.lit(0)), lambda z: z.cast("int"))
    agrees = (
        F.when(l == d_, alone(e, d_)).when(l.rlike(numeric), (part(1) == dd) & (part(2) == m) & (part(3) == y))
        .otherwise((named == m) & F.array_contains(numbers, dd) & F.array_contains(numbers, y))
    )
    stands = F.coalesce((l != "") & e.contains(l), F.lit(False)) & d_.isNotNull()
    stated_year, stated_day = stands & year_ok, stands & day.isNotNull() & F.coalesce(agrees, F.lit(False))
    start = F.when(stated_year, F.make_timestamp(d_.try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    end = F.when(stated_year, F.make_timestamp(d_.try_cast("int"), F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59.999).cast("decimal(8,6)")))
    period = F.struct(
        F.when(stated_year | stated_day, "stated").otherwise("unknown").alias("status"), start.alias("start"), end.alias("end"),
        F.when(stated_day, day).alias("as_of"), F.when(stated_year | stated_day, F.col("__label")).alias("label"),
    )
    return d.withColumn("period", period).drop("__l", "__e", "__d", "__label")


def temporal_status(facts: DataFrame, observed_at: Column) -> DataFrame:
    """facts with period and temporal_status: current only where the excerpt says so of the observation day, past is historical, else unknown."""
    p = F.col("period")
    now = F.col("excerpt").rlike(CURRENT) & F.col("category").isin("activity", "role", "geography") & (F.to_date(p["as_of"]) == F.to_date(observed_at))
    moment = F.coalesce(p["as_of"], p["end"], p["start"])
    return facts.withColumn("temporal_status", F.when(now, "current").when(moment <= observed_at, "historical").otherwise("unknown"))


def claim_quality(facts: DataFrame) -> DataFrame:
    """facts (category, entity_type, excerpt, subject, normalized_value, period) with code: the first rule that fails, null if accepted.

    The subject must be mentioned whole (operators.names), with or without its legal suffix. Where facts has the columns of
    directory_role, a role that it accepts may be a short line without a relation. A metric needs scope_label, fact_period_label, normalized_value,
    unit and one number in its excerpt, as far as facts has those columns.
    """
    d = facts.withColumns({f"__{k}": v for k, v in x.profile(F.col("excerpt")).items()})
    p = {k: F.col(f"__{k}") for k in x.profile(F.col("excerpt"))}
    d = d.withColumns({"__k": x.plain_key(F.col("excerpt")), "__v": x.plain_key(F.col("normalized_value")), "__s": F.col("subject"), "__a": F.trim(F.regexp_replace("subject", LEGAL, ""))})
    d = with_named(d, F.col("excerpt"), F.col("__s"), F.col("entity_type"), "__named")
    d = with_named(d, F.col("excerpt"), F.when((F.length("__a") >= 3) & (F.col("__a") != F.col("__s")), F.col("__a")), F.col("entity_type"), "__alias")
    directory = F.lit(False)
    if {"scope_type", "scope_label", "url", "title", "display_name"} <= set(facts.columns):
        d = directory_role(d)
        directory = F.col("directory_role")
    k, v = F.col("__k"), F.col("__v")
    digits = lambda c: F.regexp_replace(c, r"[^\d]", "")
    shown = F.col("normalized_value").isNull() | ((digits(v) != "") & digits(k).contains(digits(v))) | ((F.length(v) >= 2) & k.contains(v))
    category, dated = F.col("category"), F.col("period.status") == "stated"
    needed = [c for c in ("scope_label", "fact_period_label", "normalized_value", "unit") if c in facts.columns]
    stated = reduce(Column.__and__, [F.col(c).isNotNull() for c in needed], dated & metric_value(x.visible_text(F.col("excerpt"))).isNotNull())
    relation = F.col("excerpt").rlike(PERSON_PAIR) & F.col("excerpt").rlike(RELATION)
    code = (
        F.when(category == "identity", "identity_not_business_fact").when(p["question"], "non_declarative_claim").when(x.weak(p) & ~directory, "weak_fragment").when(x.compound(p), "non_atomic_claim")
        .when(~F.col("__named") & ~F.col("__alias"), "subject_not_stated").when((category == "metric") & ~stated, "metric_scope_or_period_missing")
        .when((category != "metric") & ~shown, "structured_value_not_in_excerpt").when((category == "role") & ~directory & ~relation, "role_relation_missing")
        .when(category.isin("event", "recent_signal") & ~dated, "dated_event_date_missing")
    )
    return d.withColumn("__code", code).select(*facts.columns, F.col("__code").alias("code"))


def grounded_quality(facts: DataFrame) -> DataFrame:
    """Facts known only by their citation that are kept: 8 characters, no question, no identity, metrics fully stated."""
    full = F.col("scope_label").isNotNull() & F.col("fact_period_label").isNotNull() & F.col("normalized_value").isNotNull() & F.col("unit").isNotNull()
    e = x.visible_text(F.col("excerpt"))
    return facts.where((F.length(e) >= 8) & ~e.rlike(r"[?？]\s*$") & (F.col("category") != "identity") & ((F.col("category") != "metric") | full))


def funnel(decisions: DataFrame) -> DataFrame:
    """(stage, code, n) with sub-totals: null code is a stage's total, null stage the grand total. decisions: stage, code ('accepted' if none)."""
    r = decisions.select("stage", F.coalesce("code", F.lit("accepted")).alias("code"))
    return r.rollup("stage", "code").agg(F.count("*").alias("n"))


def cap_facts(facts: DataFrame, n: int = 6) -> DataFrame:
    """The first n facts of each request by ord, with n_truncated of the request."""
    w = Window.partitionBy("request_id")
    ranked = facts.withColumn("__r", F.row_number().over(w.orderBy("ord", "fact_id"))).where(F.col("__r") <= n)
    total = facts.groupBy("request_id").agg(F.count("*").alias("__n"))
    return ranked.join(total, "request_id").withColumn("n_truncated", F.greatest(F.col("__n") - n, F.lit(0))).drop("__r", "__n")


def needs_supplement(requests: DataFrame, facts: DataFrame, least_facts: int = 3, least_urls: int = 2) -> DataFrame:
    """(request_id, needs): not ambiguous, one candidate, and too few facts or URLs. requests: request_id, status, n_candidates."""
    g = facts.groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))
    few = (F.coalesce("n", F.lit(0)) < least_facts) | (F.coalesce("urls", F.lit(0)) < least_urls)
    return requests.join(g, "request_id", "left").select("request_id", ((F.col("status") != "ambiguous") & (F.col("n_candidates") == 1) & few).alias("needs"))


def build_sources(proofs: DataFrame) -> DataFrame:
    """One source for each (subject_key, scope_type, final URL): source_id, kind, publisher; official if some proof was read directly from an identity publisher."""
    g = proofs.groupBy("subject_key", "scope_type", "final_url").agg(F.max(F.col("direct") & F.col("identity_publisher")).alias("official"))
    sid = F.sha2(F.concat_ws("|", "subject_key", "scope_type", "final_url"), 256)
    return g.select(sid.alias("source_id"), "subject_key", "scope_type", "final_url", u.publisher_domain(F.col("final_url")).alias("publisher"), F.when(F.col("official"), "official_publication").otherwise("search_result").alias("kind"))


def completeness(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """requests (request_id, resolved, n_contradictions, n_unknowns; n_scope_violations if there) with the counts of their claims (category, url), status and reasons."""
    least_categories, least, most = CATEGORIES
    c = claims.where("category <> 'identity'").withColumns({"page": u.canonical_page(F.col("url")), "domain": u.publisher_domain(F.col("url"))})
    g = c.groupBy("request_id").agg(F.countDistinct("claim_id").alias("n_claims"), F.countDistinct("category").alias("n_categories"), F.countDistinct("page").alias("n_pages"), F.countDistinct("domain").alias("n_publishers"))
    j = requests.join(g, "request_id", "left").fillna(0, ["n_claims", "n_categories", "n_pages", "n_publishers"])
    reasons = F.array_compact(F.array(
        F.when(~F.col("resolved"), "identity_unresolved"), F.when(~F.col("n_claims").between(least, most), "business_claim_count_out_of_range"),
        F.when(F.col("n_categories") < least_categories, "business_category_diversity_missing"), F.when(F.col("n_pages") < 2, "canonical_page_diversity_missing"),
        F.when(F.col("n_publishers") < 2, "publisher_domain_diversity_missing"), F.when(F.col("n_contradictions") > 0, "visible_contradiction"),
        F.when(F.col("n_scope_violations") > 0 if "n_scope_violations" in requests.columns else F.lit(False), "subject_scope_violation"), F.when(F.col("n_unknowns") > 0, "critical_unknown"),
    ))
    return j.withColumn("reasons", F.array_join(reasons, ",")).withColumn("status", F.when(F.col("reasons") == "", "complete_within_scope").otherwise("partial"))


def pick_summary(claims: DataFrame, n: int = 3) -> DataFrame:
    """n claims for each request: the first of each category, then the rest, by ord; contested and indeterminate ones are left out."""
    c = claims.where(~F.col("state").isin("contradiction", "indetermination"))
    c = c.withColumn("__first", F.row_number().over(Window.partitionBy("request_id", "category").orderBy("ord", "claim_id")) > 1)
    c = c.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("__first", "ord", "claim_id")))
    return c.where(F.col("position") <= n).drop("__first")


def independent(proofs: DataFrame, keys: list[str]) -> DataFrame:
    """keys with n_publishers, n_digests, n_excerpts and independent: two or more of each. proofs: url, digest, excerpt."""
    d = proofs.withColumns({"__p": u.publisher_domain(F.col("url")), "__x": x.mechanical_key(F.col("excerpt"))})
    g = d.groupBy(*keys).agg(F.countDistinct("__p").alias("n_publishers"), F.countDistinct("digest").alias("n_digests"), F.countDistinct("__x").alias("n_excerpts"))
    return g.withColumn("independent", (F.col("n_publishers") >= 2) & (F.col("n_digests") >= 2) & (F.col("n_excerpts") >= 2))


def match_names(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request_id, candidate_key) whose names match: equal, or all requested words among the candidate's; a requested legal suffix must be there too.

    Blocked by the requested word that the fewest candidates have: one equi-join on words.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(x.conflict_text(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    r = requests.select("request_id", words("name").alias("w")).where(F.size("w") > 0)
    c = candidates.select("candidate_key", words("display_name").alias("v")).withColumn("b", F.explode("v"))
    often = c.groupBy("b").agg(F.count("*").alias("n"))
    # words that no candidate has match nothing, as all requested words must be there
    rarest = r.select("request_id", "w", F.explode("w").alias("b")).join(often, "b").groupBy("request_id", "w").agg(F.min(F.struct("n", "b")).alias("least"))
    r = rarest.select("request_id", "w", F.col("least.b").alias("b"))
    return r.join(c, "b").where(F.size(F.array_except("w", "v")) == 0).select("request_id", "candidate_key").distinct()


#: Weights of signals by kind; the margin and signals a winner needs.
WEIGHTS = {"source_domain": 5, "official_site": 5, "legal_identifier": 5, "employer": 4, "city": 2, "role": 2, "corroborated": 2}
MARGIN = 2


def rank_candidates(signals: DataFrame) -> DataFrame:
    """(request_id, candidate_key, priority, position, wins): the first wins with a margin over the second and a strong signal or two medium kinds.

    signals: request_id, candidate_key, kind, strength. Kinds that are not listed weigh 1.
    """
    weight = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0)).otherwise(1)
    g = signals.groupBy("request_id", "candidate_key").agg(
        F.sum(weight).alias("priority"), F.max(F.col("strength") == "strong").alias("strong"), F.count_distinct(F.when(F.col("strength") == "medium", F.col("kind"))).alias("medium"))
    w = Window.partitionBy("request_id").orderBy(F.desc("priority"), "candidate_key")
    g = g.withColumns({"position": F.row_number().over(w), "__next": F.lead("priority").over(w)})
    wins = (F.col("position") == 1) & ((F.col("priority") - F.coalesce("__next", F.lit(0))) >= MARGIN) & (F.col("strong") | (F.col("medium") >= 2))
    return g.withColumn("wins", wins).drop("__next", "strong", "medium")
