"""Who a request is about: scopes, evidence, context signals, eligibility, match and decision, for all requests at once.

Keys are request_id and candidate_key. A proof row says where a candidate was read: kind (identity or fact), ord, url,
title, excerpt, digest and method (source_content where the page was read, else provider_annotation or search_snippet).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions import urls as u
from attestry.operators.facts import LEGAL, MARGIN, WEIGHTS
from attestry.operators.names import with_named
from attestry.sources.tables import settled

#: How a sentence says what a subject is, the grammar of keys, and the kinds of medium signals.
RELATION = "(?:est|is|constitue|represente|represents|operates as|se presente comme)"
ARTICLE = "(?:(?:un|une|le|la|les|a|an|the)\\s+|l['’])?"
KINDS = {"brand": "(?:marque|brand)", "subsidiary": "(?:filiale|subsidiary)", "group": "(?:groupe|group|holding)"}
CANDIDATE_KEY = "^[a-z][a-z0-9_-]{0,31}$"
MEDIUM = ["city", "country", "industry", "year"]
KEY = ["request_id", "candidate_key"]


def _bare(c: Column) -> Column:
    """Lower-case text without marks."""
    return F.lower(x.without_marks(x.visible_text(F.coalesce(c, F.lit(""))), "NFD"))


def words(c: Column) -> Column:
    """Words with one space around each, so that a word sequence can be sought by containment."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(_bare(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))


def holds(text: Column, value: Column) -> Column:
    """True if the words of value follow one another in text; false for a value without words."""
    v = words(value)
    return F.coalesce((F.length(v) > 2) & words(text).contains(v), F.lit(False))


def domain(c: Column) -> Column:
    """Host of a URL or bare domain, without www."""
    h = F.lower(F.regexp_extract(F.trim(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r"\.$", ""), F.lit(""))


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)), F.lit(False))


def identifies(proofs: DataFrame, out: str) -> DataFrame:
    """proofs (method, excerpt, title, url, display_name, entity_type) with out: the proof names its candidate whole in its excerpt,
    or, where the page was not read, has the words of the name in its title or URL."""
    d = with_named(proofs, F.col("excerpt"), F.col("display_name"), F.col("entity_type"), out)
    unread = F.coalesce(F.col("method") != "source_content", F.lit(False))
    name = F.col("display_name")
    return d.withColumn(out, F.col(out) | (unread & (holds(F.col("title"), name) | holds(u.url_words(F.col("url")), name))))


def derive_scope(candidates: DataFrame, proofs: DataFrame) -> DataFrame:
    """Candidates with entity_scope: person; or what the first identity proof says the subject is; a name that ends in a
    group word is a group; else company."""
    first = proofs.where("kind = 'identity'").groupBy(*KEY).agg(F.min_by("excerpt", "ord").alias("__e"))
    e, name = _bare(F.col("__e")), F.trim(_bare(F.col("display_name")))
    # what stands within 80 characters behind the name, cut there, since patterns are no columns
    at = F.instr(e, name)
    behind = F.when((at > 0) & (name != ""), F.substring(e, at + F.length(name), F.lit(160)))
    says = lambda kind: F.coalesce(behind.rlike(rf"^(?!\w).{{0,80}}\b{RELATION}\s+{ARTICLE}{KINDS[kind]}\b"), F.lit(False))
    scope = F.when(F.col("entity_type") == "person", "person").when(says("brand"), "brand").when(says("subsidiary"), "subsidiary").when(says("group") | name.rlike(rf"\b{KINDS['group']}$"), "group").otherwise("company")
    d = candidates.join(first, KEY, "left").withColumn("__scope", scope)
    return d.select(*[c for c in candidates.columns if c != "entity_scope"], F.col("__scope").alias("entity_scope"))


def assemble_evidence(candidates: DataFrame, proofs: DataFrame) -> DataFrame:
    """Proofs of each candidate, distinct by URL, digest and excerpt, the direct one first, with primary and basis.

    Fact proofs count only if they name the candidate. The direct proof is primary if it names the candidate (basis dedicated),
    else the first fact proof, else the direct one (basis verified_facts). Candidates without proof give no rows. Of candidates that
    share a key the first by ord is read (decide() refuses such a request).
    """
    own = candidates.groupBy(*KEY).agg(F.min_by(F.struct("display_name", "entity_type"), "ord").alias("__c"))
    # written once: the filter below would run the rule of names a second time. Dealt out first, as a small table may be one split
    p = settled(identifies(proofs.repartition(*KEY).join(own.select(*KEY, "__c.*"), KEY), "names"), "evidence")
    p = p.where((F.col("kind") == "identity") | F.col("names"))
    direct = F.col("kind") == "identity"
    order = [F.when(direct, 0).otherwise(1), F.col("ord")]
    same = Window.partitionBy(*KEY, "url", "digest", x.plain_key(F.col("excerpt"))).orderBy(*order)
    p = p.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    whole = Window.partitionBy(*KEY)
    p = p.withColumn("basis", F.when(F.max(direct & F.col("names")).over(whole), "dedicated").otherwise("verified_facts"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.when(direct & F.col("names"), 0).when(~direct, 1).otherwise(2), *order))
    return p.withColumn("primary", rank == 1).drop("display_name", "entity_type")


def context_signals(requests: DataFrame, verified: DataFrame, proofs: DataFrame) -> DataFrame:
    """(request_id, candidate_key, kind, value, strength) of what a request's context shares with a candidate.

    requests: request_id, context, role; verified: KEY and the verified discriminators city, country, industry, year, employer,
    legal_identifier, official_site; proofs as above. Without a context there is no signal but the role.
    """
    r = requests.select("request_id", F.col("context").alias("__c"), F.col("role").alias("__role"))
    sites = F.transform(F.regexp_extract_all("__c", F.lit(r"(?i)((?:https?://)?(?:www\.)?(?:[a-z0-9][a-z0-9-]{0,62}\.)+[a-z]{2,63})"), F.lit(1)), domain)
    r = r.withColumn("__sites", F.array_distinct(F.coalesce(sites, F.array().cast("array<string>"))))
    p = proofs.withColumn("__d", domain(F.col("url"))).join(r, "request_id")
    cited = p.where(F.exists("__sites", lambda s: same_domain(s, F.col("__d")))).select(*KEY, F.lit("source_domain").alias("kind"), F.col("__d").alias("value"), F.lit("strong").alias("strength"))
    role = p.where(holds(F.concat_ws(" ", "excerpt", "title"), F.col("__role"))).select(*KEY, F.lit("role").alias("kind"), F.col("__role").alias("value"), F.lit("medium").alias("strength"))
    v = verified.join(r, "request_id")
    in_context = lambda c: F.when(holds(F.col("__c"), F.col(c)), F.col(c))
    long_words = F.size(F.filter(F.split(F.trim(words(F.col("employer"))), " "), lambda w: F.length(w) >= 4)) >= 2
    site = F.when(F.exists("__sites", lambda s: same_domain(s, domain(F.col("official_site")))), F.col("official_site"))
    found = [("official_site", "strong", site), ("legal_identifier", "strong", in_context("legal_identifier")), ("employer", "strong", F.when(long_words, in_context("employer")))]
    found += [(k, "medium", in_context(k)) for k in MEDIUM]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), value.cast("string").alias("value"), F.lit(s).alias("strength")) for k, s, value in found])
    stated = v.select(*KEY, F.explode(each).alias("e")).select(*KEY, "e.*").where("value is not null")
    return stated.unionByName(cited).unionByName(role).distinct()


def eligible(requests: DataFrame, candidates: DataFrame, evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidates with eligible and reasons, the tests they fail. requests: request_id, entity_type; matches: the pairs of match_names."""
    named = evidence.groupBy(*KEY).agg(F.max("names").alias("__named"))
    d = candidates.join(requests.select("request_id", F.coalesce("entity_type", F.lit("auto")).alias("__type")), "request_id").join(named, KEY, "left")
    d = d.join(matches.select(*KEY).distinct().withColumn("__match", F.lit(True)), KEY, "left")
    person, scope_person = F.col("entity_type") == "person", F.col("entity_scope") == "person"
    reasons = F.array_compact(F.array(
        F.when(~F.col("candidate_key").rlike(CANDIDATE_KEY), "candidate_key_invalid"), F.when((F.col("__type") != "auto") & (F.col("entity_type") != F.col("__type")), "candidate_type_mismatch"),
        F.when(person != scope_person, "candidate_scope_mismatch"), F.when(F.col("__match").isNull(), "candidate_name_mismatch"),
        F.when(~F.coalesce("__named", F.lit(False)), "candidate_proof_name_missing"),
    ))
    return d.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0).drop("__type", "__named", "__match")


def match_flag(requests: DataFrame, candidates: DataFrame, verified: DataFrame, signals: DataFrame, evidence: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
    """Candidates with matched, match_basis, strong, medium (kinds) and priority. requests: request_id, name, has_context.

    Without a context a person needs the exact name of two words or more, a company a legal identifier or a site whose
    first label is its name; a brand never matches. With one, a strong signal or two medium kinds are needed. A candidate that support
    (KEY, see support.fact_support) backs matches too, on facts; one whose evidence (assemble_evidence) rests on facts alone matches only so.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv]), F.col("kind")), F.lit(1))
    g = signals.groupBy(*KEY).agg(F.max(F.col("strength") == "strong").alias("strong"), F.count_distinct(F.when(F.col("strength") == "medium", F.col("kind"))).alias("medium"), F.sum(weight).alias("priority"))
    d = candidates.join(requests.select("request_id", F.col("name").alias("__name"), F.col("has_context").alias("__has")), "request_id")
    d = d.join(verified.select(*KEY, F.col("legal_identifier").alias("__legal"), F.col("official_site").alias("__site")), KEY, "left").join(g, KEY, "left")
    d = d.withColumns({"strong": F.coalesce("strong", F.lit(False)), "medium": F.coalesce("medium", F.lit(0)).cast("long"), "priority": F.coalesce("priority", F.lit(0)).cast("long")})
    bare = F.regexp_replace(words(F.regexp_replace("display_name", LEGAL, "")), " ", "")
    person = (words(F.col("__name")) == words(F.col("display_name"))) & (F.size(F.split(F.trim(words(F.col("display_name"))), " ")) >= 2)
    company = F.col("__legal").isNotNull() | F.coalesce((F.length(bare) >= 3) & (F.substring_index(domain(F.col("__site")), ".", 1) == bare), F.lit(False))
    alone = (F.col("entity_scope") != "brand") & F.when(F.col("entity_type") == "person", person).otherwise(company)
    own = F.when(F.col("__has"), F.col("strong") | (F.col("medium") >= 2)).otherwise(alone)
    backed, on_facts = F.lit(False), F.lit(False)
    if support is not None:
        d = d.join(support.select(*KEY).distinct().withColumn("__backed", F.lit(True)), KEY, "left")
        backed = F.coalesce("__backed", F.lit(False))
    if evidence is not None:
        d = d.join(evidence.groupBy(*KEY).agg((F.max("basis") == "verified_facts").alias("__facts")), KEY, "left")
        on_facts = F.coalesce("__facts", F.lit(False))
    own = own & ~on_facts
    d = d.withColumns({"matched": own | backed, "match_basis": F.when(~own & (backed | on_facts), "facts").otherwise("dedicated")})
    return d.drop("__name", "__has", "__legal", "__site", "__backed", "__facts")


def decide(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request_id, status, selected_key, reason, clarification). candidates: those of match_flag with eligible, method and url of the
    primary proof; requests: request_id, has_context.

    In order: a repeated key; none eligible; a winner by priority with the margin and a strong signal or two medium kinds; a
    single match (without a context only if it is the only one eligible); a single one that is not matched, with a
    context or a page of the network that is never read; several; too little context.
    """
    ok = F.col("eligible")
    c = candidates.withColumn("__p", F.when(ok, F.col("priority")))
    order = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("__p"), "ord")
    c = c.withColumns({"__r": F.row_number().over(order), "__next": F.lead("__p").over(order)})
    wins = ok & (F.col("__r") == 1) & F.col("__next").isNotNull() & (F.col("__p") - F.col("__next") >= MARGIN) & (F.col("strong") | (F.col("medium") >= 2))
    network = u.host(F.col("url")).rlike(r"(^|\.)linkedin\.com$")
    key = F.col("candidate_key")
    g = c.groupBy("request_id").agg(
        (F.count("*") > F.count_distinct("candidate_key")).alias("twice"), F.sum(ok.cast("long")).alias("n"), F.sum((ok & F.col("matched")).cast("long")).alias("m"),
        F.max(F.when(wins, key)).alias("winner"), F.max(F.when(ok & F.col("matched"), key)).alias("only"), F.max(F.when(ok, key)).alias("single"),
        F.max(F.when(ok, F.coalesce(network, F.lit(False)))).alias("network"),
    )
    j = requests.select("request_id", "has_context").join(g, "request_id", "left").fillna(0, ["n", "m"]).fillna(False, ["twice", "network"])
    has = F.col("has_context")
    ladder = [
        (F.col("twice"), "insufficient_context", None, "duplicate_candidate_key"), (F.col("n") == 0, "not_found_within_scope", None, "no_verified_candidate"),
        (F.col("winner").isNotNull(), "resolved", F.col("winner"), "unique_ranked_candidate"), ((F.col("m") == 1) & (has | (F.col("n") == 1)), "resolved", F.col("only"), "unique_verified_candidate"),
        ((F.col("m") == 0) & (F.col("n") == 1) & (has | F.col("network")), "resolved", F.col("single"), "unique_contextual_source_candidate"),
        ((F.col("m") > 1) | (~has & (F.col("n") > 1)), "ambiguous", None, "multiple_verified_candidates"), (F.lit(True), "insufficient_context", None, "context_not_demonstrated"),
    ]
    pick = F.lit(None).cast("struct<status:string,selected_key:string,reason:string>")
    for when, status, chosen, reason in reversed(ladder):
        chosen = F.lit(None).cast("string") if chosen is None else chosen.cast("string")
        pick = F.when(when, F.struct(F.lit(status).alias("status"), chosen.alias("selected_key"), F.lit(reason).alias("reason"))).otherwise(pick)
    asks = F.when(F.col("status").isin("resolved", "not_found_within_scope"), "").when(has, "official_site,discriminating_hint").otherwise("city,industry,employer,discriminating_hint")
    return j.withColumn("__d", pick).select("request_id", "has_context", "__d.*").select("request_id", "status", "selected_key", "reason", asks.alias("clarification"))
