"""Evidence in page texts: locating excerpts, corpus search, bindings, mirrors, pages."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import urls as u
from attestry.functions.text import QUOTES, ZERO_WIDTH, masked, visible_text
from attestry.sources.tables import dealt, settled

MAX_EXCERPT, CONTEXT = 500, 16
#: Elements whose text no reader sees, and elements that end a line.
HIDDEN_ELEMENTS = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "head", "title"}
BLOCK_ELEMENTS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}


VOID_ELEMENTS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDING_STYLES = {("display", "none"), ("visibility", "hidden"), ("content-visibility", "hidden")}


def _hides(tag: str, attrs: list) -> bool:
    """True for an element that no reader sees: by its kind, an attribute or its own style."""
    given = {k.lower(): (v or "") for k, v in reversed(attrs)}
    if tag in HIDDEN_ELEMENTS - {"head", "title"} or "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true":
        return True
    for rule in given.get("style", "").split(";"):
        name, _, value = rule.partition(":")
        if (name.strip().lower(), re.sub(r"\s*!important\s*$", "", value.strip().lower()).strip()) in HIDING_STYLES:
            return True
    return False


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.out, self.in_title = [], [], False
        self.hidden, self.depth = None, 0  # the hidden element that is open, and how many of its kind are

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag == self.hidden == "p":  # a paragraph ends where the next begins
                self.hidden = None
            else:
                self.depth += tag == self.hidden
                return
        if tag == "title":
            self.in_title = True
        elif _hides(tag, attrs):
            if tag not in VOID_ELEMENTS:
                self.hidden, self.depth = tag, 1
        elif tag in BLOCK_ELEMENTS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden:
            self.depth -= tag == self.hidden
            if not self.depth:
                self.hidden = None
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCK_ELEMENTS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.out.append(data)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def _read(html: pd.Series) -> pd.DataFrame:
    def one(h):
        p = _Page()
        p.feed(h or "")
        p.close()
        return " ".join("".join(p.title).split()) or None, "".join(p.out)

    return pd.DataFrame([one(h) for h in html], columns=["title", "body"])


def extract_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_text, rejects): title, visible text and its digest, one row for each page that is read; the smallest page_id stands for a URL."""
    d = pages.withColumn("reason", u.refusal(F.col("url"))).withColumn("safe_href", F.when(F.col("reason").isNull(), u.safe_href(F.col("url"))))
    first = d.where("reason is null").groupBy("safe_href").agg(F.min("page_id").alias("page_id"))
    read = d.join(first, ["safe_href", "page_id"]).withColumn("__p", _read("html"))
    text = visible_text(F.col("__p.body"))
    read = read.select("page_id", "safe_href", "url", F.col("__p.title").alias("title"), text.alias("text"))
    ok = F.col("title").isNotNull() & (F.col("text") != "")
    page_text = read.where(ok).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    rejects = d.where("reason is not null").select("page_id", "url", "reason").unionByName(read.where(~ok).select("page_id", "url", F.when(F.col("title").isNull(), "title_missing").otherwise("text_missing").alias("reason")))
    return page_text, rejects


def blocks(page_text: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): one row for each line of visible text."""
    return page_text.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where("line <> ''")


def mirrors(texts: DataFrame, key: str, text: str, publisher: str) -> DataFrame:
    """(digest, n_texts, n_publishers, first_key) of texts that occur more than once."""
    d = texts.select(key, publisher, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n_texts"), F.countDistinct(publisher).alias("n_publishers"), F.min(key).alias("first_key")).where("n_texts > 1")


def _edge(side: str, c) -> object:
    """True where a word goes on over the edge of a match."""
    return c.rlike(r"[\p{L}\p{M}\p{N}]['’\p{Pc}\p{Pd}]?$" if side == "before" else r"^['’\p{Pc}\p{Pd}]?[\p{L}\p{M}\p{N}]")


def _mechanical(text: str) -> tuple[str, list[int], list[int]]:
    """Mechanical form of a text, with the start and end in the text of each of its characters."""
    fold = {c: v for k, v in QUOTES.items() for c in k} | {"…": "...", "­": ""}
    out, starts, ends = [], [], []
    for i, c in enumerate(text):
        if c in ZERO_WIDTH:
            left, right = text[:i].rstrip(ZERO_WIDTH)[-1:], text[i:].lstrip(ZERO_WIDTH)[:1]
            if any(not x or x.isspace() or unicodedata.category(x).startswith("P") for x in (left, right)):
                continue
        r = " " if c.isspace() else fold.get(c, c).lower()
        if r == " " and out and out[-1] == " ":
            ends[-1] = i + 1
            continue
        for x in r:
            out.append(x)
            starts.append(i)
            ends.append(i + 1)
    return "".join(out), starts, ends


_WORD = re.compile(r"\w", re.UNICODE)


def _standalone(text: str, a: int, b: int) -> bool:
    joined = lambda s: bool(re.match(r"['’‿⁀_‐-―-]?[^\W_]", s))
    first, last = _WORD.match(text[a : a + 1]), _WORD.match(text[b - 1 : b])
    return not (first and joined(text[max(0, a - 2) : a][::-1])) and not (last and joined(text[b : b + 2]))


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "n")]))
def _mechanical_match(text: pd.Series, excerpt: pd.Series) -> pd.DataFrame:
    rows = []
    for t, e in zip(text, excerpt):
        whole, starts, ends = _mechanical(t or "")
        needle = _mechanical(e or "")[0]
        found, at = [], whole.find(needle) if needle else -1
        while at >= 0:
            z = at + len(needle) - 1
            cut = (at and starts[at - 1] == starts[at]) or (z + 1 < len(starts) and starts[z + 1] == starts[z])
            if not cut and _standalone(t, starts[at], ends[z]):
                found.append((starts[at], ends[z]))
            at = whole.find(needle, at + 1)
        rows.append((*(found[0] if found else (None, None)), len(found)))
    return pd.DataFrame(rows, columns=["start", "end", "n"]).astype({"start": "Int32", "end": "Int32", "n": "int32"})


def locate(claims: DataFrame, page_text: DataFrame, on: str = "page_id") -> DataFrame:
    """claims (claim_id, page key, excerpt, prefix, suffix) with code (null if located), match_mode, start, end, occurrence, verified, before, after.

    First exact matches at word borders, in SQL; several need a prefix and suffix that leave exactly one. Only
    claims without any go to the mechanical form, which must hit once and is mapped back to the page's own
    characters. before and after are up to 16 characters of the same line, blanked if they look like secrets.
    """
    page = page_text.select(F.col(on), F.col("text").alias("__t"))
    j = claims.join(page, on, "left").withColumn("__e", visible_text(F.coalesce("excerpt", F.lit(""))))
    t, e = F.col("__t"), F.col("__e")
    # the occurrences: lengths of the pieces between them; overlapping ones are found by the mechanical pass as ambiguous
    pieces = F.when(t.isNotNull() & t.contains(e) & (e != ""), F.split(t, F.concat(F.lit("\\Q"), F.replace(e, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1))
    j = j.withColumn("__p", pieces).withColumn("__n", F.coalesce(F.size("__p") - 1, F.lit(0)))
    lengths = F.transform(F.slice("__p", 1, F.greatest(F.col("__n"), F.lit(1))), lambda x: F.length(x))
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length(e), F.lit(0)) + x))
    j = j.withColumn("__at", F.when(F.col("__n") > 0, ends).otherwise(F.array().cast("array<int>")))
    inside = lambda s: F.substring(t, F.greatest(s - 1, F.lit(1)), F.least(s, F.lit(2)))
    free = lambda s: ~(e.rlike(r"^[\p{L}\p{M}\p{N}]") & _edge("before", inside(s))) & ~(e.rlike(r"[\p{L}\p{M}\p{N}]$") & _edge("after", F.substring(t, s + F.length(e) + 1, F.lit(2))))
    j = j.withColumn("__ok", F.filter("__at", free)).withColumn("__n", F.size("__ok"))
    p, x = F.coalesce("prefix", F.lit("")), F.coalesce("suffix", F.lit(""))
    near = F.filter("__ok", lambda s: (F.substring(t, F.greatest(s - F.length(p), F.lit(0)) + 1, F.least(F.length(p), s)) == p) & (F.substring(t, s + F.length(e) + 1, F.length(x)) == x))
    chosen = F.when(F.col("__n") == 1, F.get("__ok", 0)).when((F.trim(p) != "") & (F.trim(x) != "") & (F.size(near) == 1), F.get(near, 0))
    bad = F.when((e == "") | (F.length(e) > MAX_EXCERPT) | t.isNull(), "source_excerpt_missing").when((F.length(p) > CONTEXT) | (F.length(x) > CONTEXT), "source_excerpt_ambiguous")
    j = j.withColumn("__bad", bad).withColumn("__s", chosen).withColumn("__rest", F.col("__bad").isNull() & (F.col("__n") == 0))
    # one pass: only texts without an exact match are sent to Python, the others as null
    rest = F.col("__rest")
    j = j.withColumn("__m", _mechanical_match(F.when(rest, t), F.when(rest, e)))
    code = F.when(F.col("__m.n") == 0, "source_excerpt_missing").when(F.col("__m.n") > 1, "source_excerpt_ambiguous").when(F.col("__m.end") - F.col("__m.start") > MAX_EXCERPT, "source_excerpt_missing")
    d = j.select(
        *claims.columns, "__t", F.when(rest, code).otherwise(F.coalesce("__bad", F.when(F.col("__s").isNull(), "source_excerpt_ambiguous"))).alias("code"), F.when(rest, "mechanical_equivalence").otherwise("exact").alias("match_mode"),
        F.when(rest, F.col("__m.start")).otherwise(F.col("__s")).alias("start"), F.when(rest, F.col("__m.end")).otherwise(F.col("__s") + F.length("__e")).alias("end"),
        F.when(rest, F.lit(0).cast("long")).otherwise(F.array_position("__ok", F.col("__s")) - 1).alias("occurrence"))
    ok, t, s, z = F.col("code").isNull(), F.col("__t"), F.col("start"), F.col("end")
    line = lambda c, first: F.substring_index(c, "\n", 1 if first else -1)
    return d.select(
        *claims.columns, "code", F.when(ok, F.col("match_mode")).alias("match_mode"), F.when(ok, s).alias("start"), F.when(ok, z).alias("end"), F.when(ok, F.col("occurrence")).alias("occurrence"),
        F.when(ok, F.substring(t, s + 1, z - s)).alias("verified"),
        F.when(ok, masked(F.right(line(F.substring(t, F.lit(1), s), False), F.lit(CONTEXT)))).alias("before"),
        F.when(ok, masked(F.left(line(F.substring(t, z + 1, F.lit(CONTEXT)), True), F.lit(CONTEXT)))).alias("after"),
    )


def search_excerpts(excerpts: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", words: int = 5) -> DataFrame:
    """(key, item, start): documents that hold an excerpt, by visible text.

    Each excerpt is looked up by its rarest sequence of `words` words (its whole text if shorter): one
    equi-join of hashes, then containment. Sequences are counted over all documents; only those of excerpts are kept.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def grams(w, inner: bool = False):
        """Hashes of the sequences; inner ones leave out the first and last word, which may touch other text."""
        if inner:
            w = F.when(F.size(w) >= words + 2, F.slice(w, F.lit(2), F.size(w) - 2)).otherwise(F.array().cast("array<string>"))
        shifted = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(F.size(w), F.lit(1))).alias(f"w{i}") for i in range(words)])
        return F.array_compact(F.transform(shifted, lambda z: F.when(z[f"w{words - 1}"].isNotNull(), F.xxhash64(*[z[f"w{i}"] for i in range(words)]))))

    # texts are normalised once and (key, sequence) pairs that excerpts ask for are found once: both are read again below
    x = settled(excerpts.select(item, visible_text(F.col(text)).alias("e")).where("e <> ''").withColumn("w", split(F.col("e"))), "search-excerpts")
    d = settled(dealt(docs.select(key, text)).select(key, visible_text(F.col(text)).alias("t")), "search-texts")
    wanted = x.select(item, F.explode(F.array_distinct(grams(F.col("w"), True))).alias("g"))
    seen = settled(d.select(key, F.explode(F.array_distinct(grams(split(F.col("t"))))).alias("g")).join(wanted.select("g").distinct(), "g", "left_semi"), "search-seen")
    counts = seen.groupBy("g").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "g").groupBy(item).agg(F.min(F.struct("n", "g")).alias("m")).select(item, F.col("m.g").alias("g"))
    hits = seen.join(rarest, "g").select(key, item)
    # excerpts too short for an inner sequence have no rarer key than their first characters
    hits = hits.unionByName(seen_by_start(d, x.where(F.size("w") < words + 2), key, item))
    found = hits.join(x.select(item, "e"), item).join(d, key)
    return found.where(F.col("t").contains(F.col("e"))).select(key, item, (F.instr("t", F.col("e")) - 1).cast("long").alias("start"))


def seen_by_start(docs: DataFrame, short: DataFrame, key: str, item: str, most: int = 3) -> DataFrame:
    """(key, item): documents that hold the first characters of a short excerpt, spaces included: `most` of them, or all it has.

    Only hashes of the distinct pieces of a text are sent, never the text."""
    s = short.select(item, F.xxhash64(F.substring("e", 1, most)).alias("h"))
    at = lambda n: F.when(F.length("t") >= n, F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.xxhash64(F.substring("t", i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))
    pieces = docs.select(key, F.explode(F.array_distinct(F.concat(*[at(n) for n in range(1, most + 1)]))).alias("h"))
    return pieces.join(s.select("h").distinct(), "h", "left_semi").join(s, "h").select(key, item)


def bind_spans(claims: DataFrame, citations: DataFrame, sources: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """claims (doc, claim_id, start, end) with the one citation (doc, citation_id, span_start, span_end, url) that covers them, or a code.

    Range join inside one document; none or several covering citations are an error of their own. With texts (doc, n_chars) one citation out of
    bounds (before 0, empty, past the end) refuses all claims of its document. The citation must have a url and, where citations have the
    columns, a title and, if a source_id, a source (doc, source_id, url) of that id and url.
    """
    has = set(citations.columns)
    extra = [c for c in ("title", "source_id") if c in has]
    on = (claims["doc"] == citations["doc"]) & (citations["span_start"] <= claims["start"]) & (citations["span_end"] >= claims["end"])
    j = claims.join(citations, on, "left").select(claims["doc"], "claim_id", "start", "end", F.when(F.col("citation_id").isNotNull(), F.struct("citation_id", "url", *extra)).alias("c"))
    g = j.groupBy("doc", "claim_id", "start", "end").agg(F.count("c").alias("n"), F.min("c").alias("c"))
    bad, unknown = F.lit(False), F.lit(False)
    if texts is not None:
        odd = citations.join(texts, "doc").where((F.col("span_start") < 0) | (F.col("span_end") <= F.col("span_start")) | (F.col("span_end") > F.col("n_chars"))).select("doc").distinct()
        g = g.join(odd.withColumn("__odd", F.lit(True)), "doc", "left")
        bad = F.col("__odd").isNotNull()
    if sources is not None and "source_id" in has:
        known = sources.select("doc", F.col("source_id").alias("__s"), F.col("url").alias("__u")).distinct().withColumn("__known", F.lit(True))
        g = g.join(known, (g["doc"] == known["doc"]) & (F.col("c.source_id") == F.col("__s")) & (F.col("c.url") == F.col("__u")), "left").drop(known["doc"])
        unknown = F.col("c.source_id").isNotNull() & F.col("__known").isNull()
    untitled = F.col("c.title").isNull() if "title" in has else F.lit(False)
    code = (
        F.when((F.col("start") >= F.col("end")) | F.col("start").isNull() | F.col("end").isNull(), "span_invalid").when(bad, "citation_out_of_bounds").when(F.col("n") == 0, "citation_missing").when(F.col("n") > 1, "citation_ambiguous")
        .when(F.trim(F.coalesce("c.url", F.lit(""))) == "", "source_url_missing").when(unknown, "source_unknown").when(untitled, "title_missing")
    )
    g = g.withColumn("code", code)
    return g.select("doc", "claim_id", F.when(F.col("code").isNull(), F.col("c.citation_id")).alias("citation_id"), F.when(F.col("code").isNull(), F.col("c.url")).alias("url"), "code")


#: Order of binding kinds: what a claim's URL is bound to first.
PRIORITY = ["citation", "direct_source", "search_source", "inspection"]


def bind_urls(claims: DataFrame, bindings: DataFrame) -> DataFrame:
    """claims (request_id, claim_id, url) with binding_type and binding_id of the first binding of equal URL key, else structured_output; a refused URL gets a code."""
    c = claims.withColumn("key", u.attributable_key(F.col("url")))
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("binding_type"))
    b = bindings.withColumn("key", u.attributable_key(F.col("url"))).where("key is not null").groupBy("request_id", "key").agg(F.min(F.struct(rank.alias("r"), "ord", "binding_type", "binding_id")).alias("b"))
    j = c.join(b, ["request_id", "key"], "left")
    ok = F.col("key").isNotNull()
    return j.select("request_id", "claim_id", F.when(ok, F.coalesce("b.binding_type", F.lit("structured_output"))).alias("binding_type"), F.col("b.binding_id").alias("binding_id"), F.when(~ok, "source_url_rejected").alias("code"))


def bind_actions(claims: DataFrame, calls: DataFrame, call_sources: DataFrame, actions: DataFrame, inspections: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with offsets but no citation (request_id, claim_id, url) bound through the search of their request, or a code.

    The one search call's sources must hold the claim's URL once; a call without sources leaves the one inspection of the one search, whose URL
    must be the claim's. calls: request_id, call_id; call_sources: request_id, url; actions: request_id, call_id, action_type (search,
    open_page, find_in_page); inspections: request_id, call_id, action_type, url, url_status (present, missing, invalid or another); sources: request_id,
    url (those of the answer as a whole). Gives claim_id, request_id, binding_type, bound_url, call_id, code.
    """
    count = lambda d, name, where="true": d.where(where).groupBy("request_id").agg(F.count("*").alias(name))
    looks = "action_type IN ('open_page', 'find_in_page')"
    per = [
        calls.groupBy("request_id").agg(F.count("*").alias("n_calls"), F.min("call_id").alias("call")), count(call_sources, "n_call_sources"), count(actions, "n_searches", "action_type = 'search'"),
        actions.where(looks).groupBy("request_id").agg(F.count("*").alias("n_looks"), F.min(F.struct("call_id", "action_type")).alias("look")),
        inspections.groupBy("request_id").agg(F.count("*").alias("n_inspections"), F.min(F.struct("call_id", "action_type", "url", "url_status")).alias("i")), count(sources, "n_sources"),
    ]
    d = claims.withColumns({"key": u.attributable_key(F.col("url")), "refused": u.refusal(F.col("url")).isNotNull(), "href": u.safe_href(F.col("url"))})
    for p in per:
        d = d.join(p, "request_id", "left")
    d = d.fillna(0, ["n_calls", "n_call_sources", "n_searches", "n_looks", "n_inspections", "n_sources"])
    keyed = call_sources.select("request_id", u.attributable_key(F.col("url")).alias("key"), F.col("url").alias("su")).groupBy("request_id", "key").agg(F.count("*").alias("n_matches"), F.min("su").alias("match"))
    d = d.join(keyed, ["request_id", "key"], "left").fillna(0, ["n_matches"])
    n = F.col
    searched = (n("n_calls") == 1) & (n("n_call_sources") > 0)
    by_source = F.when(n("refused"), "source_url_rejected").when(n("n_matches") != 1, "source_metadata_missing")
    status = n("i.url_status")
    by_look = (
        F.when((n("n_searches") != 1) | (n("n_looks") == 0), "inspection_url_missing").when(n("n_looks") != 1, "inspection_url_ambiguous").when(n("n_inspections") == 0, "inspection_url_missing")
        .when((n("n_inspections") != 1) | (n("n_sources") > 0) | (n("look.call_id") != n("i.call_id")) | (n("look.action_type") != n("i.action_type")), "inspection_url_ambiguous")
        .when(status == "missing", "inspection_url_missing").when(status == "invalid", "inspection_url_invalid").when(~status.eqNullSafe("present"), "inspection_url_ambiguous")
        .when(u.refusal(n("i.url")).isNotNull(), "inspection_url_invalid").when(n("refused") | (n("href") != u.safe_href(n("i.url"))), "inspection_url_mismatch")
    )
    code = F.when(n("n_calls") > 1, "web_search_not_unique").when(searched, by_source).otherwise(by_look)
    d = d.withColumn("code", code)
    ok = n("code").isNull()
    return d.select(
        "request_id", "claim_id", F.when(ok, F.when(searched, "web_search_source").otherwise("inspection_action_url")).alias("binding_type"), F.when(ok, F.when(searched, n("match")).otherwise(n("i.url"))).alias("bound_url"),
        F.when(ok, F.when(searched, n("call")).otherwise(n("i.call_id"))).alias("call_id"), "code",
    )
