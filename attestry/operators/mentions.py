"""Names in texts: where they are mentioned whole, which proofs hold one, and what follows for leads and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions import urls as u
from attestry.operators.evidence import locate
from attestry.operators.identity import holds
from attestry.operators.names import name_words, parsed, ranges, word_key, word_keys
from attestry.operators.support import GENERIC, fingerprint

#: Words that are no anchor.
NO_ANCHOR = ["avec", "chez", "dans", "des", "elle", "est", "for", "from", "les", "pour", "that", "the", "une", "with"]
TOKEN = r"[\p{L}\p{N}]+"


def _norm(c: Column) -> Column:
    return F.lower(x.without_marks(c, "NFD"))


def mentions(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, name_id, start, end): every place of a text where a whole name stands, as character offsets of the visible text.

    names: name_id, name, entity_type; texts: text_id, text. The rule is that of operators.names. Blocked by the longest word
    of the name: an equi-join on the distinct words of the texts, so texts are not carried by it and meet only names that may be theirs.
    Texts are shuffled once, as they came: what is parsed of them is several times as large and stays within a task.
    """
    n = names.withColumn("w", name_words(x.visible_text(F.col("name")))).where(F.size("w") > 0)
    longest = F.array_max(F.transform("w", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    # from a generator: of few names the optimizer would else write every form out again, as a filter on each word of the texts
    n = n.select(F.explode(F.array(word_key(longest))).alias("b"), F.struct("name_id", "name", "entity_type").alias("n"))
    # both readers of it ask for the same rows, so the second takes the first one's shuffle files: outer, as an inner explode's filter would go below them
    t = texts.select("text_id", "text").where("text_id IS NOT NULL").repartition("text_id")
    keys = t.select("text_id", F.explode_outer(word_keys(x.visible_text(F.coalesce("text", F.lit(""))))).alias("b"))
    theirs = keys.join(n, "b").groupBy("text_id").agg(F.collect_set("n").alias("n"))
    # one row a text here, so that it is parsed once for all its names
    p = parsed(t.join(theirs, "text_id"), F.col("text")).drop("text").withColumn("n", F.explode_outer("n"))
    found = ranges(p, F.col("n.name"), F.col("n.entity_type"), "m").select("text_id", "n.name_id", "m")
    # outer, since the filter that an inner explode infers would run the rule once more
    return found.select("text_id", "name_id", F.explode_outer("m").alias("m")).where("m IS NOT NULL").select("text_id", "name_id", "m.start", "m.end")


def require_mention(proofs: DataFrame, allowed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) proofs (claim_id, text_id, start, end): one whole mention of an allowed name must lie inside. A claim without allowed names is rejected.

    allowed: claim_id, name_id; found: what mentions() gives.
    """
    named = proofs.join(allowed, "claim_id")
    m = found.select("text_id", "name_id", F.col("start").alias("ms"), F.col("end").alias("me"))
    hits = named.join(m, ["text_id", "name_id"]).where((F.col("ms") >= F.col("start")) & (F.col("me") <= F.col("end"))).select("claim_id").distinct()
    return proofs.join(hits, "claim_id", "left_semi"), proofs.join(hits, "claim_id", "left_anti")


def relocate(proofs: DataFrame, excerpts: DataFrame, page_text: DataFrame) -> DataFrame:
    """New excerpts (claim_id, excerpt, prefix, suffix) located in the pages that their claims' proofs (claim_id, page_id) already hold."""
    return locate(excerpts.join(proofs.select("claim_id", "page_id").distinct(), "claim_id"), page_text)


def reconstruct_identity(candidates: DataFrame, verified: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """A name-only proof (request_id, candidate_key, text_id, start, end) for candidates without one whose page mentions their name: the first page, its first mention.

    candidates: request_id, candidate_key, name_id; verified: request_id, candidate_key; pages: request_id, candidate_key, text_id, ord.
    """
    key = ["request_id", "candidate_key"]
    open_ = candidates.join(verified.select(*key).distinct(), key, "left_anti")
    j = open_.join(pages, key).join(found, ["text_id", "name_id"])
    first = j.groupBy(*key).agg(F.min(F.struct("ord", "start", "text_id", "end")).alias("m"))
    return first.select(*key, "m.text_id", "m.start", "m.end")


def title_leads(candidates: DataFrame, facts: DataFrame, sources: DataFrame, least_facts: int = 3, least_sources: int = 2, most: int = 2) -> DataFrame:
    """(request_id, candidate_key, url, title): sources whose title or publisher ties them to a candidate, for requests with too few facts or pages.

    candidates: request_id, candidate_key, ord, display_name, employer, url (of the identity proof); facts: request_id, url; sources: request_id, ord, url, title.
    At most `most` a request and no more than what is lacking; pages already used are left out and no page counts twice.
    """
    used = candidates.select("request_id", "url").unionByName(facts.select("request_id", "url")).where("url is not null").distinct()
    n = used.groupBy("request_id").agg(F.count("*").alias("pages"))
    have = facts.groupBy("request_id").agg(F.count("*").alias("facts"))
    lack = candidates.select("request_id").distinct().join(n, "request_id", "left").join(have, "request_id", "left").fillna(0)
    lack = lack.select("request_id", F.least(F.lit(most), F.greatest(F.lit(least_facts) - F.col("facts"), F.lit(least_sources) - F.col("pages"), F.lit(0))).alias("lack")).where("lack > 0")
    plain = lambda c: F.lower(x.visible_text(F.coalesce(c, F.lit(""))))
    s = sources.join(used, ["request_id", "url"], "left_anti").withColumn("__t", x.visible_text(F.coalesce("title", F.lit("")))).where(F.length("__t") >= 8)
    c = candidates.select("request_id", "candidate_key", F.col("ord").alias("__o"), plain(F.col("display_name")).alias("__n"), plain(F.col("employer")).alias("__e"), u.publisher_domain(F.col("url")).alias("__d"))
    j = s.join(c, "request_id").join(lack, "request_id")
    t, site, e = F.lower("__t"), u.publisher_domain(F.col("url")), F.col("__e")
    tied = ((F.col("__n") != "") & t.contains(F.col("__n"))) | ((F.length(e) >= 3) & (t.contains(e) | F.coalesce(site.contains(e), F.lit(False)))) | F.coalesce(site == F.col("__d"), F.lit(False))
    j = j.where(tied).withColumn("__u", F.row_number().over(Window.partitionBy("request_id", "url").orderBy("__o", "ord"))).where("__u = 1")
    return j.withColumn("__r", F.row_number().over(Window.partitionBy("request_id").orderBy("__o", "ord"))).where(F.col("__r") <= F.col("lack")).select("request_id", "candidate_key", "url", F.col("__t").alias("title"))


def anchor_continuity(facts: DataFrame, decisions: DataFrame, proofs: DataFrame) -> DataFrame:
    """facts with continuous: where an identity rests on facts, a fact outside its support and from another publisher must share a word
    of four letters or more, no part of the name, with what the identity was read from.

    facts: request_id, fact_id, url, excerpt, supporting; decisions: request_id, display_name, basis; proofs: request_id, url, excerpt, title.
    """
    tokens = lambda c, name: F.filter(F.array_except(F.regexp_extract_all(F.lower(x.visible_text(F.coalesce(c, F.lit("")))), F.lit(TOKEN), F.lit(0)), F.regexp_extract_all(F.lower(x.visible_text(name)), F.lit(TOKEN), F.lit(0))), lambda w: (F.length(w) >= 4) & ~w.isin(*NO_ANCHOR))
    p = proofs.join(decisions.select("request_id", "display_name"), "request_id").select("request_id", u.publisher_domain(F.col("url")).alias("__d"), F.explode_outer(tokens(F.concat_ws(" ", "excerpt", "title"), F.col("display_name"))).alias("__w"))
    g = p.groupBy("request_id").agg(F.collect_set("__d").alias("__sites"), F.collect_set("__w").alias("__words"))
    d = facts.join(decisions.select("request_id", "display_name", "basis"), "request_id").join(g, "request_id", "left")
    needed = (F.col("basis") == "verified_facts") & ~F.col("supporting") & ~F.coalesce(F.array_contains("__sites", u.publisher_domain(F.col("url"))), F.lit(False))
    shared = F.coalesce(F.arrays_overlap("__words", tokens(F.col("excerpt"), F.col("display_name"))), F.lit(False))
    return d.withColumn("continuous", ~needed | shared).select(*facts.columns, "continuous")


def context_terms(requests: DataFrame, known: DataFrame, generic: list[str] = GENERIC) -> DataFrame:
    """(request_id, candidate_key, term, source): what of a request's context is asked for: discriminators that it names, and its fragments.

    requests: request_id, context; known: request_id, candidate_key, display_name, value (a discriminator, or null). A fragment is what stands
    between commas, semicolons, bars and line ends: at most 96 characters and 8 words, no URL, not made of generic words and words of the name alone; so is a discriminator.
    Terms that read alike (all names of artificial intelligence do) count once, a discriminator before a fragment.
    """
    j = known.join(requests.select("request_id", F.col("context").alias("__c")), "request_id")
    named = j.where(holds(F.col("__c"), F.coalesce("value", F.lit("")))).select("request_id", "candidate_key", F.col("value").alias("term"), F.lit("discriminator").alias("source"))
    w = lambda c: F.regexp_extract_all(_norm(x.visible_text(c)), F.lit(TOKEN), F.lit(0))
    f = j.select("request_id", "candidate_key", "display_name", F.explode(F.split("__c", r"[,;|\n]+")).alias("term")).withColumn("term", F.trim("term"))
    both = named.unionByName(f.select("request_id", "candidate_key", "term", F.lit("fragment").alias("source")))
    both = both.join(known.groupBy("request_id", "candidate_key").agg(F.first("display_name").alias("display_name")), ["request_id", "candidate_key"])
    rest = F.array_except(F.array_except(w(F.col("term")), w(F.col("display_name"))), F.array(*map(F.lit, generic)).cast("array<string>"))
    both = both.where(F.length("term").between(1, 96) & F.size(w(F.col("term"))).between(1, 8) & (F.size(rest) > 0) & ~F.col("term").contains("://")).withColumn("__k", fingerprint(F.col("term"))).drop("display_name")
    return both.withColumn("__r", F.row_number().over(Window.partitionBy("request_id", "candidate_key", "__k").orderBy("source", "term"))).where("__r = 1").drop("__k", "__r")
