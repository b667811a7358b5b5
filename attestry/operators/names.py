"""Whole names in texts: where a text mentions a person or company, and not a longer name that holds theirs.

A text is its words (letters, marks, digits) and the gaps between them. A name matches where its words stand in
order and the text there, gaps included, has the mechanical form of the name. Both neighbours then decide: what is joined
to a person's name and looks like a part of it, or to a company's and does not start a clause, makes another name.
All of it is column expressions over the arrays of words and gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as x

#: Words that may stand around a name, by what they are.
PERSON_TITLES = [
    "ceo", "cfo", "coo", "cofondateur", "cofondatrice", "cto", "directeur", "directrice", "docteur", "dr", "fondateur", "fondatrice", "madame", "m", "mme", "monsieur", "mr", "mrs", "ms",
    "president", "presidente", "président", "présidente", "prof", "professeur",
]
PERSON_METADATA = ["last", "mis", "mise", "updated"]
PERSON_TITLE_CONTEXTS = ["her", "his", "la", "le", "les", "leur", "leurs", "nos", "notre", "our", "sa", "ses", "son", "the", "their", "vos", "votre", "your"]
PERSON_PREFIXES = [
    *PERSON_TITLES, "a", "about", "au", "aux", "avec", "by", "chez", "contact", "declare", "declares", "en", "et", "explains", "explique", "for", "indicates", "indique", "par", "pour", "profil", "profile",
    "said", "says", "selon", "states", "sur", "with",
]
PERSON_CONNECTORS = ["d", "de", "del", "des", "du", "la", "le", "van", "von"]
PERSON_CONNECTOR_CONTEXTS = ["about", "biographie", "biography", "portrait", "profil", "profile"]
COMPANY_PREFIXES = ["at", "by", "chez", "company", "entreprise", "for", "groupe", "group", "la", "le", "par", "pour", "société", "societe", "the"]
COMPANY_CONNECTOR_CONTEXTS = ["entreprise", "filiale", "groupe", "group", "société", "societe"]
COMPANY_PREFIXES_WITH_CONTEXT = ["company", "entreprise", "filiale", "groupe", "group", "la", "le", "société", "societe", "the"]
COMPANY_LEGAL_SUFFIXES = ["ag", "corp", "corporation", "gmbh", "group", "groupe", "inc", "llc", "ltd", "plc", "sa", "sas", "sasu", "se"]
COMPANY_WORD_CONNECTORS = ["and", "et"]
CONNECTOR_PREFIXES = ["d", "de", "del", "des", "du", "l", "la", "le", "van", "von"]
COMPANY_CLAUSE_LEADERS = [
    "a", "accompagne", "acquiert", "acquired", "acquires", "annonce", "announced", "announces", "are", "became", "becomes", "builds", "can", "collaborates", "commercialise", "compte", "confirms",
    "consolide", "conçoit", "creates", "crée", "delivered", "delivers", "designed", "designs", "développe", "develops", "dirige", "distribue", "distributes", "does", "employed", "emploie", "employs",
    "est", "exerce", "expanded", "expands", "exporte", "exports", "exploite", "fabrique", "fournit", "founded", "generates", "génère", "had", "has", "importe", "imports", "indicated", "indicates", "is",
    "lance", "launches", "manufactured", "manufactures", "n", "offre", "offers", "opère", "operates", "owns", "possède", "produit", "produces", "propose", "provides", "publie", "published", "publishes",
    "raised", "raises", "réalise", "regroupe", "reported", "reports", "représente", "s", "se", "sert", "serves", "sells", "supports", "travaille", "utilise", "uses", "va", "vient", "was", "vend", "were",
    "will", "works",
]
COMPANY_AUXILIARIES = ["a", "are", "can", "does", "est", "had", "has", "is", "n", "s", "se", "va", "vient", "was", "were", "will"]
#: Fixed value: how many words behind a name a legal suffix may close it.
CONTINUATION = 12

TOKEN = r"[\p{L}\p{M}\p{N}­]+"
JOINS = r"\A[\s'’\p{Cc}\p{Cf}\p{Pc}\p{Pd}-]+\z"
TIGHT = r"\A(?:['’\p{Pc}\p{Pd}-]|\p{Cf}|(?!\s)\p{Cc})+\z"
COMPANY_SIGN = r"\A[\s\p{Cc}\p{Cf}]*[&+/]+[\s\p{Cc}\p{Cf}]*\z"
SPACES = r"\A[\s\p{Cc}\p{Cf}]+\z"
#: The first letter is a capital.
CAPITAL = r"\A[^\p{L}]*\p{Lu}"


def _is(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _in(c: Column, words: list[str]) -> Column:
    # one pattern, not a list of literals: these lists stand many times in a plan
    return _is(c, rf"\A(?:{'|'.join(words)})\z")


def _plain(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("­"), F.lit(""))


def name_words(visible: Column) -> Column:
    """The words of a name, lower case."""
    bare = F.regexp_replace(_plain(visible), r"[^\p{L}\p{N}' ’-]+", " ")
    return F.filter(F.split(bare, r"[ '’-]+"), lambda w: w != "")


def word_key(word: Column) -> Column:
    """What stands for a word of name_words() in word_keys()."""
    return F.replace(word, F.lit("ς"), F.lit("σ"))


def word_keys(visible: Column) -> Column:
    """The distinct words of a text, as parsed() has them but for the two small sigmas: which of them lower case gives depends on what stands around."""
    return F.array_distinct(F.regexp_extract_all(word_key(_plain(visible)), F.lit(TOKEN), F.lit(0)))


def _person_suffix(raw, tok, gaps, e: Column) -> Column:
    """A part of a person's name is joined after it."""
    looks = lambda i: _is(F.get(raw, i), CAPITAL) & ~_in(F.get(tok, i), PERSON_TITLES + PERSON_METADATA)
    linked = _in(F.get(tok, e), PERSON_CONNECTORS) & F.get(tok, e + 1).isNotNull() & _is(F.get(gaps, e + 1), JOINS) & looks(e + 1)
    return F.get(tok, e).isNotNull() & _is(F.get(gaps, e), JOINS) & (looks(e) | linked)


def _closed(raw, tok, gaps, e: Column) -> Column:
    """A legal suffix that ends a name stands among the words from the second after it on, in the same clause."""
    go, yes, no = F.lit(0), F.lit(1), F.lit(2)

    def step(state: Column, k: Column) -> Column:
        i = e + 1 + k
        follows = F.get(tok, i + 1)
        ends = follows.isNull() | _is(F.get(gaps, i + 1), r"[,;:!?.\n]") | (_in(follows, COMPANY_CLAUSE_LEADERS) & ~((follows == "a") & _is(F.get(raw, i + 1), CAPITAL)))
        return (
            F.when(state != go, state).when(F.get(tok, i).isNull() | _is(F.get(gaps, i), r"[.!?;:\n]"), no)
            .when(_in(F.get(tok, i), COMPANY_LEGAL_SUFFIXES) & ends, yes).otherwise(go)
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(CONTINUATION - 1)), go, step) == yes


def _suffix(raw, tok, gaps, e: Column, tail: Column, person: Column, legal: Column) -> Column:
    """What follows is tied to the name, or goes on with a company's."""
    after, gap = F.get(tok, e), F.substr(F.get(gaps, e), tail + 1)
    tight = _is(gap, TIGHT) & ~(_is(gap, r"\A['’]\z") & (after == "s")) & ~(person & _is(gap, r"\A\p{Pd}\z") & _in(after, PERSON_TITLES))
    leads, suffix = _in(after, COMPANY_CLAUSE_LEADERS), _in(after, COMPANY_LEGAL_SUFFIXES) | _in(after, COMPANY_WORD_CONNECTORS)
    with_legal = ~leads & (suffix | _is(F.get(raw, e), CAPITAL))
    second = ~_in(after, COMPANY_AUXILIARIES) & _in(F.get(tok, e + 1), COMPANY_CLAUSE_LEADERS)
    alias = suffix | ~leads | _closed(raw, tok, gaps, e) | second
    company = F.when(_is(gap, COMPANY_SIGN), True).when(~_is(gap, SPACES), False).when(legal, with_legal).otherwise(alias)
    return F.when(after.isNull(), False).when(_is(gap, TIGHT), tight).when(person, False).otherwise(company)


def _prefix(tok, gaps, s: Column, lead: Column, person: Column) -> Column:
    """What stands before is tied to the name and may not."""
    both = lambda p, c, w: F.when(person, _in(w, p)).otherwise(_in(w, c))
    allowed = lambda w: both(PERSON_PREFIXES, COMPANY_PREFIXES, w)
    needs = lambda w: both(PERSON_TITLES + PERSON_TITLE_CONTEXTS, COMPANY_PREFIXES_WITH_CONTEXT, w)
    joined = lambda gap, w: _is(gap, JOINS) | (person & _in(w, PERSON_TITLES) & _is(gap, r"\A\.\s*\z"))
    go, yes, no = F.lit(0), F.lit(1), F.lit(2)

    def step(state: Column, k: Column) -> Column:
        i = s - 1 - k
        outer = F.get(tok, i - 1)
        return (
            F.when(state != go, state).when(~needs(F.get(tok, i)) | outer.isNull() | ~joined(F.get(gaps, i), outer), no)
            .when(~allowed(outer) & ~(person & _in(outer, PERSON_TITLE_CONTEXTS)), yes).otherwise(go)
        )

    before = F.get(tok, s - 1)
    gap = F.left(F.get(gaps, s), F.length(F.get(gaps, s)) - lead)
    # most lead-ins need no context: the walk over what stands before them is for the others
    chain = F.when(needs(before), F.aggregate(F.sequence(F.lit(0), s - 1), go, step) == yes).otherwise(False)
    outer = F.get(tok, s - 2)
    linked = outer.isNotNull() & _is(F.get(gaps, s - 1), JOINS) & both(PERSON_CONNECTOR_CONTEXTS, COMPANY_CONNECTOR_CONTEXTS, outer)
    return (
        F.when(before.isNull(), False).when(gap == "", True).when(~joined(gap, before), False).when(allowed(before), chain)
        .when(~_in(before, CONNECTOR_PREFIXES), True).otherwise(~linked)
    )


def parsed(df: DataFrame, text: Column) -> DataFrame:
    """df with __name_v (visible text), __name_raw, __name_tok (its words as they stand, and plain) and __name_gaps (what stands around them)."""
    d = df.withColumn("__name_v", x.visible_text(F.coalesce(text, F.lit(""))))
    d = d.withColumns({"__name_raw": F.regexp_extract_all("__name_v", F.lit(TOKEN), F.lit(0)), "__name_gaps": F.split("__name_v", TOKEN, -1)})
    return d.withColumn("__name_tok", F.transform("__name_raw", _plain))


def ranges(df: DataFrame, name: Column, entity_type: Column, out: str) -> DataFrame:
    """df from parsed(), with out: array of (start, end), the places of the visible text where the whole name stands. Null names stand nowhere."""
    d = df.withColumns({"__name_n": F.coalesce(x.visible_text(name), F.lit("")), "__name_person": entity_type.eqNullSafe("person")})
    n = F.col("__name_n")
    # from a generator, so that the optimizer does not write them out again inside the lambdas below
    forms = {
        "__name_w": name_words(n), "__name_form": x.mechanical_form(n), "__name_letters": F.regexp_replace(n, r"[^\p{L}]+", ""),
        "__name_lead": F.length(F.regexp_extract(n, rf"\A(.*?){TOKEN}", 1)), "__name_tail": F.length(F.regexp_extract(n, rf"{TOKEN}([^\p{{L}}\p{{M}}\p{{N}}­]*)\z", 1)),
    }
    d = d.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in forms.items()]))))
    # cheap first: the places where the words stand; what follows is computed only where there is one
    d = d.withColumn("__name_s", x.sequence_starts(F.col("__name_tok"), F.col("__name_w")))
    raw, tok, gaps, w = F.col("__name_raw"), F.col("__name_tok"), F.col("__name_gaps"), F.col("__name_w")
    lead, tail, person = F.col("__name_lead"), F.col("__name_tail"), F.col("__name_person")
    legal = _in(F.element_at(w, -1), COMPANY_LEGAL_SUFFIXES)
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, z: acc + F.length(z))

    def place(s: Column) -> Column:
        m = F.size(w)
        start = total(F.slice(gaps, F.lit(1), s + 1)) + total(F.slice(raw, F.lit(1), s))
        return F.struct(s.alias("s"), (start - lead).alias("start"), (start + total(F.slice(raw, s + 1, m)) + total(F.slice(gaps, s + 2, m - 1)) + tail).alias("end"))

    d = d.withColumn("__name_p", F.transform("__name_s", place))

    def whole(p: Column) -> Column:
        part = F.substr(F.col("__name_v"), p["start"] + 1, p["end"] - p["start"])
        letters = F.regexp_replace(part, r"[^\p{L}]+", "")
        case = person | legal | (letters == F.col("__name_letters")) | (letters == F.upper(letters))
        e = p["s"] + F.size(w)
        ok = (p["start"] >= 0) & (x.mechanical_form(part) == F.col("__name_form")) & (letters != "") & case
        return ok & ~_suffix(raw, tok, gaps, e, tail, person, legal) & ~_prefix(tok, gaps, p["s"], lead, person) & ~(person & _person_suffix(raw, tok, gaps, e))

    found = F.transform(F.filter("__name_p", whole), lambda p: F.struct(p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end")))
    return d.withColumn(out, F.when(F.size("__name_s") > 0, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))).drop("__name_n", "__name_w", "__name_form", "__name_letters", "__name_lead", "__name_tail", "__name_person", "__name_s", "__name_p")


def with_mentions(df: DataFrame, text: Column, name: Column, entity_type: Column, out: str) -> DataFrame:
    """df with out: array of (start, end) of each whole mention of name in the visible text, row by row."""
    return ranges(parsed(df, text), name, entity_type, out).drop("__name_v", "__name_raw", "__name_tok", "__name_gaps")


def with_named(df: DataFrame, text: Column, name: Column, entity_type: Column, out: str) -> DataFrame:
    """df with out (boolean): text mentions the whole name."""
    return with_mentions(df, text, name, entity_type, "__name_ranges").withColumn(out, F.size("__name_ranges") > 0).drop("__name_ranges")
