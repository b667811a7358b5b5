"""Metric facts: observation from a sentence, checks, comparison of sources, conflict groups.

Facts carry: fact_id, request_id, subject_key, ord, category, predicate, scope_type, scope_label,
fact_date, fact_period_label, normalized_value, unit, currency, contradiction_key, excerpt, url, digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import numbers as num
from attestry.functions.text import conflict_text, plain_key
from attestry.functions.urls import conflict_page_key
from attestry.sources.tables import settled

#: The grammar of a full metric sentence, without accents.
REFUSED = [
    r"%|[~≈<>]|\b(?:percent|percentage|pourcent(?:age)?|growth|grew|increase|increased|decrease|decreased|change|delta|croissance|hausse|baisse|variation"
    r"|progression|recul|about|approximately|around|circa|environ|approximativement|between|entre|from|de\s+plus\s+de|more\s+than|less\s+than|at\s+least"
    r"|at\s+most|up\s+to|over|under)\b",
    r"\d\s*(?:-|–|—|to|a)\s*\d",
]
REVENUE = r"\b(?:chiffres?\s+d\s+affaires?|revenus?|revenue|turnover|net\s+sales|sales)\b"
WORKFORCE = r"\b(?:effectifs?|employe(?:e|es|s)?|salarie(?:e|es|s)?|employees?|workforce|headcount|staff|etp|fte)\b"
RECURRING = r"\b(?:annual\s+recurring\s+revenue|arr|run[ -]rate\s+revenue|operating\s+revenue|revenu\s+recurrent\s+annuel|revenu\s+operationnel)\b"
WITH_SUBSIDIARIES = r"\s+(?:(?:and|including)\s+(?:all\s+)?(?:its\s+)?subsidiaries|(?:et|incluant|y compris)\s+(?:toutes?\s+)?ses\s+filiales)"
VERB = (
    r"(?:(?:a|ont|avait|avaient|has|have|had)\s+)?(?:publi(?:e|ee|es|ees)|declar(?:e|ee|es|ees)|declared|declares|reported|reports|published|publishes"
    r"|estim(?:e|ee|es|ees)|estimated|estimates|forecast|forecasted|forecasts)"
)
PERIOD = (
    r"(?:(?:calendar(?:[ -]year)?|annee\s+(?:civile|calendaire))\s+(?:19|20)\d{2}|(?:fy|fiscal(?:[ -]year)?|financial(?:[ -]year)?|exercice|annee\s+fiscale)\s+(?:19|20)\d{2})"
)
SCOPE = r"(?:consolidated|consolide(?:e|es|s)?|subsidiary|filiale|parent\s+company|maison\s+mere|societe\s+mere|for\s+the\s+group|au\s+niveau\s+du\s+groupe|group-wide)"
KIND = r"(?:adjusted|ajuste(?:e|es|s)?|organic|organique|gross|brut(?:e|es|s)?|net)"
OUTLOOK = (
    r"(?:expected|projected|target(?:ed)?|guidance|budgeted|preliminary|provisional|estimated|attendu(?:e|es|s)?|projete(?:e|es|s)?|objectif"
    r"|budgete(?:e|es|s)?|preliminaire|provisoire)"
)
ARTICLE = r"(?:a|an|the|un|une|le|la|les|l)"
MONEY = (
    r"(?:€|eur|(?:d\s+)?euros?|usd|us\s+dollars?|dollars?\s+americains?|£|gbp|pounds?\s+sterling|livres?\s+sterling|chf|francs?\s+suisses?|cad"
    r"|canadian\s+dollars?|dollars?\s+canadiens?|aud|australian\s+dollars?|dollars?\s+australiens?|jpy|yens?|cny|yuans?|renminbi)"
)
TAIL = rf"(?:\s+(?:(?:in|for|during|en|pour|pour\s+l|au\s+titre\s+de)\s+(?:the\s+)?{PERIOD}))?"
IS = r"(?:de|of|at|was|is|s\s+eleve\s+a|atteint|totaled|totalled)"
BASIS = r"(?:average|averaged|moyenne?|en\s+moyenne|year-end|at\s+year\s+end|end\s+of\s+(?:the\s+)?year|fin\s+d\s+annee|a\s+la\s+cloture|au\s+31\s+decembre)"
PEOPLE = r"(?:employees?|employe(?:e|es|s)?|salarie(?:e|es|s)?|effectifs?|headcount|staff|etp|fte)"
VALUE = rf"({num.NUMBER})(?:\s*({num.SCALE}))?(?![\d.,])"
REVENUE_BODY = (
    rf"^(?:(?:{ARTICLE}|{PERIOD}|{SCOPE}|{KIND}|{OUTLOOK}|annual)\s+)*(?:chiffres?\s+d\s+affaires?|revenus?|revenue|turnover|net\s+sales|sales)"
    rf"(?:\s+(?:{KIND}|{OUTLOOK}|{SCOPE}))*\s+{IS}\s+{VALUE}\s*{MONEY}{TAIL}$"
)
WORKFORCE_BODY = (
    rf"^(?:(?:{ARTICLE}|{PERIOD}|{SCOPE}|{OUTLOOK}|{BASIS})\s+)*(?:effectifs?|workforce|headcount|staff|etp|fte|full[ -]time\s+equivalents?)"
    rf"(?:\s+(?:{BASIS}|{OUTLOOK}|{SCOPE}))*\s+{IS}\s+{VALUE}\s+{PEOPLE}{TAIL}$"
)
SCOPE_KINDS = {
    "group": r"\b(?:consolidated|consolide(?:e|es|s)?|au niveau du groupe|for the group|group-wide|groupe dans son ensemble)\b",
    "subsidiary": r"\b(?:subsidiary|subsidiaries|filiale|filiales)\b",
    "parent": r"\b(?:parent company|maison mere|societe mere)\b",
}
DEFINITIONS = {
    "adjusted": r"\b(?:ajuste(?:e|es|s)?|adjusted)\b", "organic": r"\b(?:organique|organic)\b", "gross": r"\b(?:brut(?:e|es|s)?|gross)\b",
    "net": r"\b(?:net\s+(?:revenues?|turnover|sales)|(?:revenus?|turnover|sales|chiffres?\s+d\s+affaires?)\s+net(?:te)?s?)\b",
}
COUNTED = {
    "average": r"\b(?:average|averaged|moyenne?|en moyenne)\b",
    "year_end": r"\b(?:year-end|end of (?:the )?year|at year end|fin d annee|a la cloture|au 31 decembre)\b",
}
FTE = r"\b(?:etp|fte|full[ -]time equivalents?)\b"
EPSILON = 1e-12


def _only(text: Column, patterns: dict[str, str], otherwise: str | None) -> Column:
    """The one name whose pattern is found; null if several are."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in patterns.items()]))
    return F.when(F.size(found) == 0, F.lit(otherwise)).when(F.size(found) == 1, F.element_at(found, 1))


def observe_metrics(facts: DataFrame, excerpt: str = "excerpt", subject: str = "scope_label") -> DataFrame:
    """facts with obs: metric, definition, currency, scale, scope_kind, value, period_key, nature; null if the
    sentence is not a full, exact statement of one metric by the subject. Currencies count in what is stated: a subject's
    name that reads like one (CAD) is none, unlike in the reference, which looks at the whole clause."""
    relation = rf"^({WITH_SUBSIDIARIES})?[\s,]+{VERB}\b\s*(.*)$"
    # one column a step: what is used twice is computed once
    d = facts.withColumn("__t", F.regexp_replace(conflict_text(F.col(excerpt)), "[’']", " ")).withColumn("__s", F.regexp_replace(conflict_text(F.col(subject)), "[’']", " "))
    t, s = F.col("__t"), F.col("__s")
    clauses = F.filter(F.transform(F.split(t, r"[!?;\r\n]+|\.(?=\s+\p{L}|$)"), lambda c: F.trim(c)), lambda c: c != "")
    rest = lambda c: F.substring(c, F.length(s) + 1, F.length(c))
    d = d.withColumn("__owned", F.filter(clauses, lambda c: c.startswith(s) & ~rest(c).rlike(r"^[\p{L}\d]") & (F.trim(F.regexp_extract(rest(c), relation, 2)) != "")))
    d = d.withColumn("__clause", F.when((F.size("__owned") == 1) & (s != ""), F.element_at("__owned", 1)))
    clause = F.col("__clause")
    d = d.withColumn("__rest", rest(clause)).withColumn("__body", F.trim(F.regexp_extract("__rest", relation, 2))).withColumn("__subs", F.regexp_extract("__rest", relation, 1) != "")
    body = F.col("__body")
    d = d.withColumn("__revenue", t.rlike(REVENUE)).withColumn("__workforce", t.rlike(WORKFORCE))
    revenue, workforce = F.col("__revenue"), F.col("__workforce")
    pattern = lambda i: F.when(revenue, F.regexp_extract(body, REVENUE_BODY, i)).otherwise(F.regexp_extract(body, WORKFORCE_BODY, i))
    d = d.withColumn("__raw", pattern(1)).withColumn("__word", pattern(2)).withColumn("__factor", num.scale_factor(F.col("__word")))
    raw, word, factor = F.col("__raw"), F.col("__word"), F.col("__factor")
    three = raw.rlike(r"^[-+]?\d+[.,]\d{3}$")
    d = d.withColumn("__value", F.when((raw != "") & ~(three & (revenue | (word != ""))), num.literal_value(raw) * factor))
    d = d.withColumn("__kind", _only(body, SCOPE_KINDS, "entity")).withColumn("__money", num.currency(body)).withColumn("__period", num.period_key(clause, True)).withColumn("__nature", num.value_nature(clause, True))
    counted = F.concat(F.when(clause.rlike(FTE), "fte_").otherwise("headcount_"), _only(clause, COUNTED, None))
    d = d.withColumn("__definition", F.when(revenue, _only(body, DEFINITIONS, "standard")).otherwise(counted))
    kind, money = F.col("__kind"), F.col("__money")
    scope_ok = (kind != "parent") & (~F.col("__subs") | kind.isin("entity", "group"))
    money_ok = F.when(revenue, (F.size(money) == 1) & ~clause.rlike(RECURRING)).otherwise(F.size(money) == 0)
    ok = (
        ~t.rlike(REFUSED[0]) & ~t.rlike(REFUSED[1]) & (revenue != workforce) & clause.isNotNull() & F.col("__value").isNotNull()
        & F.col("__period").isNotNull() & scope_ok & money_ok & F.col("__definition").isNotNull()
    )
    scale = F.when(factor == 1e3, "thousand").when(factor == 1e6, "million").when(factor == 1e9, "billion")
    obs = F.struct(
        F.when(revenue, "revenue").otherwise("workforce").alias("metric"), F.col("__definition").alias("definition"), F.get(money, 0).alias("currency"), scale.alias("scale"),
        F.when(F.col("__subs"), "group").otherwise(kind).alias("scope_kind"), F.col("__value").alias("value"), F.col("__period").alias("period_key"), F.col("__nature").alias("nature"),
    )
    return d.withColumn("obs", F.when(F.coalesce(ok, F.lit(False)), obs)).select(*facts.columns, "obs")


def declared_metric(predicate: Column) -> Column:
    """revenue or workforce, as a predicate says; null for any other."""
    p = F.regexp_replace(conflict_text(predicate), "[^a-z0-9]+", " ")
    return F.when(p.rlike(r"\b(?:chiffre d affaires|chiffre affaires|revenue|turnover|sales)\b"), "revenue").when(p.rlike(r"\b(?:effectif|employees?|headcount|workforce|staff|etp|fte)\b"), "workforce")


def unit_fits(unit: Column, o: Column) -> Column:
    """A declared unit names what the observation o counts in."""
    u = conflict_text(unit)
    scaled = (
        F.when(o["scale"] == "thousand", u.rlike("^(k|thousands?|milliers?)$")).when(o["scale"] == "million", u.rlike("^millions?$"))
        .when(o["scale"] == "billion", u.rlike("^(milliards?|billions?|bn)$")).otherwise(u.rlike("^(currency|monetary|money)$"))
    )
    money = (u == "") | u.rlike("^(currency|monetary|money|revenue|turnover|sales|chiffre d affaires)$") | scaled
    people = u.rlike("^(employees?|employes?|salaries?|effectifs?|headcount|workforce|staff|etp|fte)$")
    return F.when(o["metric"] == "workforce", people).otherwise(money)


def scope_fits(scope_type: Column, o: Column) -> Column:
    """A declared scope type is that of the observation o."""
    scope = conflict_text(scope_type)
    return F.when(o["scope_kind"] == "group", scope == "group").when(o["scope_kind"] == "subsidiary", scope == "subsidiary").otherwise(scope == "company")


def metric_signature(facts: DataFrame) -> DataFrame:
    """facts with sig: obs if what the fact declares (predicate, date, period, scope, unit, currency) agrees with it."""
    d = facts if "obs" in facts.columns else observe_metrics(facts)
    o = F.col("obs")
    ok = (
        (F.col("category") == "metric") & F.col("scope_label").isNotNull() & (declared_metric(F.col("predicate")) == o["metric"])
        & (conflict_text(F.col("fact_date")) == F.substring_index(o["period_key"], "|", 1)) & (num.period_key(F.coalesce(F.col("fact_period_label"), F.lit(""))) == o["period_key"])
        & scope_fits(F.col("scope_type"), o) & unit_fits(F.col("unit"), o) & (conflict_text(F.col("currency")) == conflict_text(o["currency"]))
    )
    return d.withColumn("sig", F.when(F.coalesce(ok, F.lit(False)), o))


def compare_metrics(facts: DataFrame) -> DataFrame:
    """(request_id, subject_key, left_id, right_id, relationship) of metric facts that share the metric they state, or
    predicate and definition key. One equi-join on a comparison key; a pair that shares both keys counts once."""
    norm = lambda c: plain_key(F.col(c))
    d = (facts if "sig" in facts.columns else metric_signature(facts)).where("category = 'metric'").select(
        "request_id", "subject_key", "fact_id", "ord", "sig", F.col("scope_type"), norm("scope_label").alias("scope"), norm("predicate").alias("pred"), norm("contradiction_key").alias("def"))
    keys = F.array_compact(F.array(F.when(F.col("sig").isNotNull(), F.concat(F.lit("m|"), F.col("sig.metric"))), F.when(F.col("def") != "", F.concat(F.lit("p|"), F.col("pred"), F.lit("|"), F.col("def")))))
    k = d.withColumn("key", F.explode(keys))
    a, b = k.alias("a"), k.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("request_id", "subject_key", "key")] + [F.col("a.ord") < F.col("b.ord")]
    l, r = F.col("a.sig"), F.col("b.sig")
    # of a pair that shares both keys only the first key's row is kept
    once = (F.substring("a.key", 1, 2) == "m|") | ~F.coalesce(l["metric"] == r["metric"], F.lit(False))
    same = F.abs(l["value"] - r["value"]) <= F.greatest(F.lit(1.0), F.abs(l["value"])) * EPSILON
    ladder = (
        F.when(l.isNull() | r.isNull() | (l["metric"] != r["metric"]) | ~l["currency"].eqNullSafe(r["currency"]), "indetermination")
        .when((F.col("a.scope_type") != F.col("b.scope_type")) | (F.col("a.scope") != F.col("b.scope")) | (l["period_key"] != r["period_key"])
              | (l["definition"] != r["definition"]) | (l["scope_kind"] != r["scope_kind"]), "explainable_difference")
        .when((F.col("a.pred") != F.col("b.pred")) | (F.col("a.def") == "") | (F.col("a.def") != F.col("b.def")), "indetermination")
        .when((l["nature"] == "unknown") | (r["nature"] == "unknown"), "indetermination")
        .when(l["nature"] != r["nature"], "explainable_difference")
        .when(same, "confirmation").otherwise("contradiction")
    )
    return a.join(b, on).where(once).select(F.col("a.request_id"), F.col("a.subject_key"), F.col("a.fact_id").alias("left_id"), F.col("b.fact_id").alias("right_id"), ladder.alias("relationship"))


def independent_pairs(pairs: DataFrame, proofs: DataFrame) -> DataFrame:
    """pairs with independent: some proofs of both sides differ in page and in text digest; a contradiction without is indetermination.

    proofs: fact_id, url, digest. Sets per fact decide: two sides fail only if no page and digest differ together.
    """
    sets = proofs.select("fact_id", conflict_page_key(F.col("url")).alias("page"), F.lower("digest").alias("digest")).where("page is not null and digest is not null")
    sets = sets.groupBy("fact_id").agg(F.collect_set(F.struct("page", "digest")).alias("docs"))
    j = pairs.join(sets.select(F.col("fact_id").alias("left_id"), F.col("docs").alias("l")), "left_id", "left").join(
        sets.select(F.col("fact_id").alias("right_id"), F.col("docs").alias("r")), "right_id", "left")
    apart = F.exists("l", lambda x: F.exists("r", lambda y: (x["page"] != y["page"]) & (x["digest"] != y["digest"])))
    j = j.withColumn("independent", F.coalesce(apart, F.lit(False))).drop("l", "r")
    return j.withColumn("relationship", F.when((F.col("relationship") == "contradiction") & ~F.col("independent"), "indetermination").otherwise(F.col("relationship")))


RANK = ["confirmation", "explainable_difference", "indetermination", "contradiction"]


#: What comparisons look at, from the widest class to the narrowest.
CLASS = ["request_id", "subject_key", "metric", "currency", "statement", "pred", "def", "nature"]


def _classes(facts: DataFrame) -> DataFrame:
    """Metric facts with the columns of their class (metric, currency, statement: scope, period and definition; claim: predicate and
    declared definition; nature), known (has a signature), value, and k, a hash of the class."""
    norm = lambda c: plain_key(F.col(c))
    d = (facts if "sig" in facts.columns else metric_signature(facts)).where("category = 'metric'")
    s = F.col("sig")
    part = lambda *c: F.sha2(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in c]), 256)
    d = d.select(
        "request_id", "subject_key", "fact_id", s.isNotNull().alias("known"), s["metric"].alias("metric"), F.coalesce(s["currency"], F.lit("")).alias("currency"), s["value"].alias("value"), s["nature"].alias("nature"),
        F.when(s.isNotNull(), part(F.col("scope_type"), norm("scope_label"), s["period_key"], s["definition"], s["scope_kind"])).alias("statement"), norm("predicate").alias("pred"), norm("contradiction_key").alias("def"),
    )
    return d.where("request_id IS NOT NULL AND subject_key IS NOT NULL").withColumn("k", part(*map(F.col, [*CLASS, "known"])))


#: Coordinates that must all differ for two proofs to contradict each other independently.
APART = ("value", "page", "digest")


def witnesses(proofs: DataFrame, key: list[str]) -> DataFrame:
    """For each key at most 16 of its proofs (value, page, digest), among which every proof that some other one is apart from in all three finds such a one.

    Take any proof. What is not apart from it equals it in one coordinate, so for each coordinate take a proof that differs from the
    first there; what is not apart from that one either equals it in another coordinate; and so on through all three. Each step
    is a minimum by key, so a hot key is combined before the shuffle.
    """
    d = proofs.withColumn("__t", F.struct(*APART))
    held = d.groupBy(*key).agg(F.min("__t").alias("w"))
    paths: list[tuple[int, ...]] = [()]
    for depth in range(1, len(APART) + 1):
        nexts = [(*p, i) for p in paths for i in range(len(APART)) if i not in p]
        j = d.join(held, key)
        best = []
        for path in nexts:
            # apart in each coordinate of the path from the proof taken before it
            before = [F.col("w") if n == 0 else F.col("w" + "".join(map(str, path[:n]))) for n in range(depth)]
            ok = reduce(Column.__and__, [F.coalesce(F.col(APART[i]) != b[APART[i]], F.lit(False)) for i, b in zip(path, before)])
            best.append(F.min(F.when(ok, F.col("__t"))).alias("w" + "".join(map(str, path))))
        known = [c for c in held.columns if c not in key]
        held = j.groupBy(*key).agg(*[F.first(c).alias(c) for c in known], *best)
        paths = nexts
    taken = [c for c in held.columns if c not in key]
    return held.select(*key, F.array_distinct(F.array_compact(F.array(*taken))).alias("witnesses"))


def reconcile_facts(facts: DataFrame, proofs: DataFrame) -> DataFrame:
    """N7 without pairs: (fact_id, state), the worst relationship of each fact to the facts that it can be compared with; facts
    with none give no row. proofs: fact_id, url, digest.

    What decides is counted by class. Facts of a subject compare if they state one metric, or declare one predicate and
    definition. Then the first of these that holds for some other fact: apart in value and with independent proofs
    (contradiction); no or another signature or currency, another predicate or definition of one statement, an unknown nature,
    or a value apart without independent proofs (indetermination); another statement or nature (explainable). Values are equal within
    1e-12 of the larger one; a chain of equal ones counts as one value.
    """
    d = settled(_classes(facts), "metric-classes")
    # values of a class, the equal ones as one
    v = d.where("known AND def <> '' AND nature <> 'unknown'").select("k", "value").distinct()
    by_value = Window.partitionBy("k").orderBy("value")
    cut = F.coalesce((F.col("value") - F.lag("value").over(by_value) > F.greatest(F.lit(1.0), F.abs("value")) * EPSILON).cast("long"), F.lit(0))
    v = settled(v.withColumn("cut", cut).withColumn("cluster", F.sum("cut").over(by_value)).select("k", "value", "cluster"), "metric-values")
    apart = v.groupBy("k").agg((F.max("cluster") > 0).alias("apart"))
    disputed = d.join(v.join(apart.where("apart"), "k", "left_semi"), ["k", "value"]).select("fact_id", "k", F.col("cluster").alias("value"))
    docs = proofs.select("fact_id", conflict_page_key(F.col("url")).alias("page"), F.lower("digest").alias("digest")).where("page IS NOT NULL AND digest IS NOT NULL").distinct()
    own = settled(disputed.join(docs, "fact_id"), "metric-proofs")
    seen = own.join(witnesses(own, ["k"]), "k")
    against = seen.where(F.exists("witnesses", lambda w: reduce(Column.__and__, [w[c] != F.col(c) for c in APART]))).select("fact_id").distinct().withColumn("against", F.lit(True))
    # one row a class; the wider classes are sums of those
    c = d.groupBy("k", *CLASS, "known").agg(F.count("*").alias("n")).repartition("request_id", "subject_key").join(apart, "k", "left")
    known, declared = F.col("known"), F.col("def") != ""
    subject = CLASS[:2]
    within = lambda columns, n: F.sum(F.when(n, F.col("n")).otherwise(0)).over(Window.partitionBy(*subject, *columns))
    c = c.withColumns({
        "n_metric": within(["metric"], known), "n_currency": within(["metric", "currency"], known), "n_statement": within(["metric", "currency", "statement"], known), "n_claim": within(CLASS[2:7], known),
        "n_unknown": within(CLASS[2:7], known & (F.col("nature") == "unknown")), "n_declared": within(["pred", "def"], declared), "n_same": within(["pred", "def", "metric", "currency"], declared & known),
    })
    n, one = F.col, lambda name: F.when(known, F.col(name)).otherwise(0)
    indeterminate = (
        (one("n_metric") > one("n_currency")) | (one("n_statement") > one("n_claim")) | (~declared & (one("n_statement") > 1)) | (declared & (n("n_declared") > F.when(known, n("n_same")).otherwise(1)))
        | (declared & known & F.when(n("nature") == "unknown", n("n_claim") > 1).otherwise(n("n_unknown") > 0)) | F.coalesce("apart", F.lit(False))
    )
    explainable = (one("n_currency") > one("n_statement")) | (declared & known & (n("n_claim") > n("n")))
    compared = (one("n_metric") > 1) | (declared & (n("n_declared") > 1))
    c = c.where(compared).select("k", F.when(indeterminate, RANK[2]).when(explainable, RANK[1]).otherwise(RANK[0]).alias("state"))
    j = d.select("fact_id", "k").join(c, "k").join(against, "fact_id", "left")
    return j.select("fact_id", F.when(F.coalesce("against", F.lit(False)), RANK[3]).otherwise(F.col("state")).alias("state"))


def reconcile(pairs: DataFrame) -> DataFrame:
    """(fact_id, state): the worst relationship of each fact's pairs, where pairs are few enough to be listed."""
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("relationship"))
    sides = pairs.select(F.explode(F.array("left_id", "right_id")).alias("fact_id"), rank.alias("rank"))
    return sides.groupBy("fact_id").agg(F.max("rank").alias("rank")).select("fact_id", F.element_at(F.array(*map(F.lit, RANK)), F.col("rank").cast("int")).alias("state"))


def conflict_groups(facts: DataFrame, states: DataFrame) -> DataFrame:
    """Groups of comparable facts in conflict: two or more values, pages and digests, and an independent contradiction.

    states: fact_id, state (see reconcile_facts). Columns: request_id, subject_key, metric, period_key, scope, definition, currency,
    n_facts, n_values, n_pages, n_digests, unit (the common scale, else null), conflict_id. conflict_versions gives their facts, a row each.
    """
    d, key = _keyed(facts)
    against = states.where("state = 'contradiction'").select("fact_id", F.lit(True).alias("against"))
    g = d.join(against, "fact_id", "left").groupBy("request_id", "subject_key", *[f"g_{k}" for k in key], "conflict_id").agg(
        F.count("*").alias("n_facts"), F.countDistinct("sig.value").alias("n_values"), F.countDistinct(conflict_page_key(F.col("url"))).alias("n_pages"),
        F.countDistinct("digest").alias("n_digests"), F.max("against").alias("against"),
        F.when(F.countDistinct(F.coalesce("sig.scale", F.lit(""))) == 1, F.max("sig.scale")).alias("unit"),
    ).where("n_values >= 2 and n_pages >= 2 and n_digests >= 2 and against")
    return g.select("request_id", "subject_key", *[F.col(f"g_{k}").alias(k) for k in key], "n_facts", "n_values", "n_pages", "n_digests", "unit", "conflict_id")


def conflict_versions(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """(conflict_id, version, ord, fact_id, value, unit, currency): the facts of each group by ord, a row each; no winner is chosen."""
    d, _ = _keyed(facts)
    v = d.join(groups.select("conflict_id"), "conflict_id", "left_semi")
    n = F.row_number().over(Window.partitionBy("conflict_id").orderBy("ord", "fact_id")) - 1
    return v.select("conflict_id", n.cast("long").alias("version"), "ord", "fact_id", F.col("sig.value").alias("value"), "unit", F.col("sig.currency").alias("currency"))


def _keyed(facts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Facts with a signature, the parts of their group's key as g_ columns, and its id."""
    norm = lambda c: plain_key(F.col(c))
    d = (facts if "sig" in facts.columns else metric_signature(facts)).where("sig is not null")
    key = {
        "metric": F.col("sig.metric"), "period_key": F.col("sig.period_key"), "scope_type": F.col("scope_type"), "scope": norm("scope_label"), "definition": F.col("sig.definition"),
        "currency": F.col("sig.currency"), "scope_kind": F.col("sig.scope_kind"), "nature": F.col("sig.nature"), "predicate": norm("predicate"), "contradiction_key": norm("contradiction_key"),
    }
    d = d.withColumns({f"g_{k}": v for k, v in key.items()})
    return d.withColumn("conflict_id", F.sha2(F.concat_ws("|", "request_id", "subject_key", *[f"g_{k}" for k in key]), 256)), list(key)
