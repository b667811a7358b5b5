"""What supports an identity: discriminators and context terms bound to the subject, corroboration, organisation anchors, roles, and facts that prove who it is.

Keys are request_id and candidate_key. proofs: KEY, proof_id (one for each URL, digest and excerpt), url, digest, title, excerpt.
Everything is a join, a group or a column expression over short token lists; no text is carried by a join on anything but a candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions import urls as u
from attestry.operators.facts import claim_quality
from attestry.operators.identity import KEY, domain, same_domain
from attestry.operators.names import with_named
from attestry.sources.tables import dealt, settled

# Words of the rules, accents dropped.
NOT_A_PARTY = [
    "ai", "ambassadeur", "ambassadrice", "ceo", "cfo", "chief", "coo", "cto", "directeur", "directrice", "executive", "expert", "experte", "fondateur", "fondatrice", "founder",
    "general", "generale", "gerant", "gerante", "head", "ia", "last", "mis", "mise", "officer", "partner", "president", "presidente", "responsable", "specialiste", "updated",
]
ROLE_WORDS = [
    "associe", "associee", "ceo", "cfo", "chief", "co", "cofondateur", "cofondatrice", "coo", "cto", "design", "directeur", "directrice", "et", "executive", "fondateur",
    "fondatrice", "founder", "general", "generale", "head", "membre", "numerique", "officer", "partner", "president", "presidente", "responsable",
]
EMPLOYER_CONNECTORS = ["and", "at", "chez", "d", "de", "du", "et", "for", "l", "of", "pour"]
INDUSTRY_MARKERS = [
    "activite", "ambassadeur", "ambassadrice", "concoit", "consultant", "consultante", "developpe", "dirige", "directeur", "directrice", "expert", "experte", "formation",
    "industrie", "industry", "programme", "program", "recherche", "secteur", "specialise", "specialisee", "specialist", "specialiste",
]
INDUSTRY_CONNECTORS = ["and", "d", "dans", "de", "du", "en", "et", "in", "l", "of", "pour", "sur"]
LOCATION_CONNECTORS = ["a", "at", "dans", "de", "en", "in"]
BLOCKERS = [
    "accompagne", "accompanies", "avec", "cite", "cites", "collabore", "collaborates", "cote", "cotes", "interview", "interviewe", "interviews", "alongside", "meets", "mentionne",
    "mentions", "photograph", "photographie", "photographs", "presente", "presents", "recoit", "recoivent", "received", "receives", "rencontre", "tandis", "while", "with",
]
ACTIONS = ["anime", "concoit", "conduit", "developpe", "develops", "dirige", "est", "exerce", "is", "leads", "mene", "runs", "was"]
ARTICLES = ["a", "an", "des", "l", "la", "le", "les", "the", "un", "une"]
DESCRIPTORS = [
    "applique", "appliquee", "applied", "digital", "digitale", "industriel", "industrielle", "numerique", "professionnel", "professionnelle", "public", "publique", "recognized",
    "reconnu", "reconnue", "responsable", "transformation",
]
PLACE_ACTIONS = [
    "base", "based", "enseigne", "establi", "etablie", "headquartered", "implante", "implantee", "intervient", "lives", "located", "operates", "publie", "reside", "travaille",
    "vit", "works",
]
PLACE_DESCRIPTORS = [
    "activite", "ai", "artificial", "atelier", "aux", "comme", "conference", "dans", "entreprise", "entreprises", "etabli", "etablie", "filiale", "francais", "francaise", "groupe",
    "ia", "intelligence", "numeriques", "organisation", "organisations", "ordre", "programme", "services", "travaux",
]
LEGAL_MARKERS = ["identifiant", "immatricule", "immatriculee", "numero", "registered", "registration"]
YEAR_MARKERS = ["a", "depuis", "en", "founded", "fonde", "fondee", "in", "since"]
MONTHS = [
    "aout", "april", "august", "avril", "december", "decembre", "february", "fevrier", "january", "janvier", "juillet", "june", "juin", "march", "mars", "may", "mai", "november",
    "novembre", "october", "octobre", "september", "septembre",
]
EMPLOYED = "travaille chez|works at|works for|employe par|employee at|rejoint|joined|dirige|leads"
UPDATED, UPDATED_ARTICLES = "mise? a jour|updated on|last updated", "le|on|the"
AI_FORMS = ["ai", "ia", "artificial intelligence", "intelligence artificielle"]
ROLE_PREFIX = (
    r"^(?:(?:est|is|was) (?:l |le |la |un |une |a |an |the )?)?(?:ceo|cfo|chief executive officer|coo|cto|co fondateur|co fondatrice|co founder|cofondatrice|cofondateur|directeur|directrice"
    r"|fondateur|fondatrice|founder|gerant|gerante|head|partner|president|presidente|responsable)\b|^(?:dirige|leads|travaille chez|works at|works for)\b"
)
ROLE_CONNECTORS, ROLE_ARTICLES = "at|chez|d|de|des|du|for|of|pour", "a|an|l|la|le|les|the|un|une"
GENERIC = [
    "a", "activity", "activite", "afin", "ainsi", "an", "and", "as", "at", "au", "aux", "avec", "by", "ce", "ces", "chez", "comme", "company", "contexte", "context", "dans", "de",
    "des", "du", "elle", "en", "entreprise", "entre", "est", "et", "for", "from", "he", "her", "his", "il", "in", "information", "into", "is", "it", "la", "le", "les", "leur",
    "mais", "ne", "ni", "of", "official", "officiel", "on", "or", "ou", "par", "pas", "person", "personne", "pour", "public", "publique", "que", "qui", "role", "sans", "se", "ses",
    "she", "site", "son", "source", "services", "sous", "sur", "than", "that", "the", "their", "technologie", "technology", "to", "un", "une", "vers", "was", "with",
]
ANCHOR_STOPWORDS = GENERIC + [
    "ai", "artificial", "about", "accueil", "actualite", "actualites", "annuaire", "article", "blog", "contact", "direction", "directory", "equipe", "example", "france", "home",
    "ia", "intelligence", "lab", "labs", "news", "num", "page", "press", "presse", "profile", "profil", "propos", "group", "groupe", "organisation", "organization", "societe",
    "studio", "team",
]
URL_PREFIXES = ["get", "go", "hello", "join", "my", "the", "use", "weare"]
URL_SUFFIXES = ["app", "co", "company", "fr", "france", "group", "groupe", "hq", "lab", "labs", "official", "studio"]
DISCRIMINATORS = ["city", "country", "industry", "employer", "legal_identifier", "year"]
MOST_BRIDGE = 14

TOKEN = r"[\p{L}\p{N}]+"


def _list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _any(words: list[str]) -> str:
    return "|".join(words)


def _once(d: DataFrame, **values: Column) -> DataFrame:
    """d with columns that are computed once: what a generator gives is not written out again in the filters and columns that use it."""
    return d.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def _within(tokens: Column, words: list[str]) -> Column:
    return F.size(F.array_except(tokens, _list(words))) == 0


def _said(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _inside(long: Column, short: Column) -> Column:
    """True if the words of short follow one another in long; both joined by spaces."""
    return F.concat(F.lit(" "), long, F.lit(" ")).contains(F.concat(F.lit(" "), short, F.lit(" ")))


def _employs(bridge: Column) -> Column:
    """A joined bridge says that what follows employs the subject: a verb, or a role of at most six words and a connector."""
    word = _any(ROLE_WORDS + EMPLOYER_CONNECTORS)
    only = _any([w for w in ROLE_WORDS if w not in EMPLOYER_CONNECTORS])
    role = rf"^(?:(?:est|is) )?(?=(?:\S+ )*(?:{only})(?: |$))(?:(?:{word}) ){{0,5}}(?:{word})(?: (?:{_any(EMPLOYER_CONNECTORS)}))?$"
    return bridge.rlike(rf"^(?:{EMPLOYED})(?: l)?$") | bridge.rlike(role)


def _undated(c: Column) -> Column:
    """A joined bridge without the note of when its page was updated."""
    return F.regexp_replace(c, rf"^(?:{UPDATED})(?: (?:{UPDATED_ARTICLES}))?(?: (?:\d{{1,4}}|{_any(MONTHS)})){{1,4}}(?: |$)", "")


def _words(joined: Column) -> Column:
    return F.filter(F.split(joined, " "), lambda w: w != "")


def fingerprint(term: Column) -> Column:
    """The words of a term; all names of artificial intelligence are one."""
    joined = _said(x.context_tokens(term))
    return F.when(joined.isin(*AI_FORMS), "artificial-intelligence").otherwise(joined)


def bind_terms(candidates: DataFrame, proofs: DataFrame, terms: DataFrame) -> DataFrame:
    """(KEY, ord, term, key, proof_id): terms that a proof says of the subject itself.

    candidates: KEY, display_name, entity_type, employer, known (text of all its discriminators); terms: KEY, ord, term, key (one of DISCRIMINATORS). The subject stands once in the
    excerpt and the nearest place of the term after it is reached by 1 to 14 words: none of them a blocker or another named party, and of the kind that the key
    asks for. A null excerpt, name or term binds nothing.
    """
    none = F.array().cast("array<string>")
    p = _once(proofs.select(*KEY, "proof_id", "excerpt"), raw=F.regexp_extract_all(x.visible_text(F.col("excerpt")), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).drop("excerpt")
    p = _once(p, tok=F.transform("raw", lambda t: F.lower(x.without_marks(t, "NFD"))))
    c = _once(candidates.select(*KEY, "entity_type", "display_name", "employer", F.col("known").alias("__k")), name=x.context_tokens(F.col("display_name")), emp=F.coalesce(x.context_tokens(F.col("employer")), none), known=F.coalesce(x.context_tokens(F.col("__k")), none))
    p = _once(p.join(c.drop("display_name", "employer", "__k"), KEY), at=x.sequence_starts(F.col("tok"), F.col("name"))).where("size(at) = 1")
    p = p.withColumn("from", F.get("at", F.lit(0)) + F.size("name")).drop("at")
    t = _once(terms, w=x.context_tokens(F.col("term"))).where("size(w) > 0")
    t = t.withColumn("forms", F.when(_said(F.col("w")).isin(*AI_FORMS), F.transform(_list(AI_FORMS), lambda f: F.split(f, " "))).otherwise(F.array("w"))).drop("w")
    near = F.array_min(F.filter(F.flatten(F.transform("forms", lambda f: x.sequence_starts(F.col("tok"), f))), lambda i: i >= F.col("from")))
    d = _once(p.join(t, KEY), n=near - F.col("from")).where(F.col("n").between(1, MOST_BRIDGE))
    d = _once(d, b=F.slice("tok", F.col("from") + 1, F.col("n")), r=F.slice("raw", F.col("from") + 1, F.col("n"))).drop("raw", "tok", "forms")
    d = _once(d.where(~F.arrays_overlap("b", _list(BLOCKERS))), s=_said(F.col("b")))

    b, emp, size = F.col("b"), F.col("emp"), F.size("emp")
    named = lambda i: F.get("r", i).rlike(r"^[^\p{L}]*\p{Lu}") & ~F.get("b", i).isin(*NOT_A_PARTY) & ~((F.col("entity_type") == "company") & F.array_contains("name", F.get("b", i)))
    parties = F.filter(F.sequence(F.lit(0), F.col("n") - 1), named)
    own = F.filter(x.sequence_starts(b, emp), lambda i: named(i) & _employs(_said(F.slice(b, F.lit(1), i))))
    d = _once(d, parties=parties, own=own)
    d = d.where(~F.exists("parties", lambda i: ~F.exists("own", lambda e: (e <= i) & (i < e + size)))).drop("parties", "own")

    last = F.element_at("b", -1)
    body = _words(_undated(_said(F.slice(b, F.lit(1), F.col("n") - 1))))
    allowed = F.array_union(F.array_union(_list(ACTIONS + PLACE_ACTIONS + DESCRIPTORS + PLACE_DESCRIPTORS + INDUSTRY_CONNECTORS + INDUSTRY_MARKERS + ARTICLES + EMPLOYER_CONNECTORS + ROLE_WORDS), F.col("name")), F.col("known"))
    d = _once(d, last=last, body=body, allowed=allowed)
    odd = F.filter(F.sequence(F.lit(0), F.size("body") - 1), lambda i: ~F.array_contains("allowed", F.get("body", i)) & ~F.get("body", i).rlike(r"^\d+$"))
    d = _once(d, odd=F.when(F.size("body") > 0, odd).otherwise(F.array().cast("array<int>"))).drop("allowed")
    head, before = F.get("body", F.lit(0)), F.get("body", F.get("odd", F.lit(0)) - 1)
    introduced = (before == "comme") | ((head == "enseigne") & before.isin(*ARTICLES))
    run = (F.size("odd") <= 2) & (F.element_at("odd", -1) - F.get("odd", F.lit(0)) == F.size("odd") - 1) & F.coalesce((F.get("odd", F.lit(0)) > 0) & introduced, F.lit(False))
    place = F.col("last").isin(*LOCATION_CONNECTORS) & ((F.size("body") == 0) | (head.isin(*ACTIONS, *PLACE_ACTIONS, *INDUSTRY_MARKERS, *ROLE_WORDS) & ((F.size("odd") == 0) | run)))

    marks = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("b", i).isin(*INDUSTRY_MARKERS))
    d = _once(d, mark=F.array_max(marks))
    m = F.col("mark")
    d = _once(d, pre=_words(_undated(_said(F.slice(b, F.lit(1), F.coalesce(m, F.lit(0)))))), tail=F.slice(b, F.coalesce(m, F.lit(0)) + 2, F.greatest(F.col("n") - 2 - F.coalesce(m, F.lit(0)), F.lit(0))))
    d = _once(d, e1=x.sequence_starts(F.col("pre"), emp), e2=x.sequence_starts(F.col("tail"), emp))
    one, two = F.get("e1", F.lit(0)), F.get("e2", F.lit(0))
    pre_ok = F.when(F.size("e1") == 0, _within(F.col("pre"), ACTIONS + ARTICLES + INDUSTRY_MARKERS)).when(F.size("e1") > 1, False).otherwise(_employs(_said(F.slice("pre", F.lit(1), one))) & _within(F.slice("pre", one + size + 1, F.size("pre")), ["est", "is", "was"]))
    plain = INDUSTRY_CONNECTORS + DESCRIPTORS + INDUSTRY_MARKERS + ARTICLES
    led = _employs(F.concat_ws(" ", F.get("b", m), F.when(two > 0, _said(F.slice("tail", F.lit(1), two)))))
    tail_ok = F.when(F.size("e2") == 0, _within(F.col("tail"), plain)).when(F.size("e2") > 1, False).otherwise(led & _within(F.slice("tail", F.lit(1), two), plain) & _within(F.slice("tail", two + size + 1, F.size("tail")), plain))
    industry = F.col("last").isin(*INDUSTRY_CONNECTORS) & m.isNotNull() & pre_ok & tail_ok

    key = F.col("key")
    fits = (
        F.when(key == "employer", _employs(F.col("s"))).when(key.isin("city", "country"), place).when(key == "industry", industry)
        .when(key == "legal_identifier", F.arrays_overlap("b", _list(LEGAL_MARKERS))).when(key == "year", F.arrays_overlap("b", _list(YEAR_MARKERS)))
    )
    return d.where(fits).select(*KEY, "ord", "term", "key", "proof_id")


def verify_discriminators(candidates: DataFrame, proofs: DataFrame) -> DataFrame:
    """I4: (KEY, DISCRIMINATORS, official_site): the values that some proof binds to the subject; the site if some proof was read on it or under it. Others are null.

    candidates: KEY, display_name, entity_type, DISCRIMINATORS, official_site.
    """
    c = candidates.withColumn("known", F.concat_ws(" ", *DISCRIMINATORS, "official_site"))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.col(k).cast("string").alias("term")) for i, k in enumerate(DISCRIMINATORS)])
    terms = c.select(*KEY, F.explode(each).alias("e")).select(*KEY, "e.*").where("term is not null")
    bound = bind_terms(c, proofs, terms).groupBy(*KEY).pivot("key", DISCRIMINATORS).agg(F.max("term"))
    site = candidates.select(*KEY, domain(F.col("official_site")).alias("official_site")).join(proofs.select(*KEY, domain(F.col("url")).alias("__d")), KEY)
    site = site.where(same_domain(F.col("official_site"), F.col("__d"))).select(*KEY, "official_site").distinct()
    return candidates.select(*KEY).distinct().join(bound, KEY, "left").join(site, KEY, "left")


def _spread(d: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Groups with independent: two publishers, digests and excerpts (by their words) or more."""
    d = _once(d, __d=u.publisher_domain(F.col("url")), __w=F.xxhash64(_said(x.context_tokens(F.col("excerpt")))))
    g = d.groupBy(*keys).agg(F.count_distinct("__d").alias("__p"), F.count_distinct("digest").alias("__g"), F.count_distinct("__w").alias("__x"), *more)
    return g.withColumn("independent", (F.col("__p") >= 2) & (F.col("__g") >= 2) & (F.col("__x") >= 2)).drop("__p", "__g", "__x")


def corroborate(candidates: DataFrame, bound: DataFrame, proofs: DataFrame) -> DataFrame:
    """I8: (KEY, fingerprint, value): the first term that independent proofs bind to a person of exactly the requested name whose proofs are independent.

    candidates: KEY, entity_type, exact_name; bound: KEY, ord, term, proof_id (see bind_terms). Terms that read alike are one.
    """
    ok = _spread(proofs, KEY).where("independent").select(*KEY)
    ok = candidates.where((F.col("entity_type") == "person") & F.col("exact_name")).select(*KEY).join(ok, KEY, "left_semi")
    b = _once(bound, fingerprint=fingerprint(F.col("term"))).join(ok, KEY, "left_semi").join(proofs, [*KEY, "proof_id"])
    g = _spread(b, [*KEY, "fingerprint"], F.min(F.struct("ord", "term")).alias("m")).where("independent")
    first = g.groupBy(*KEY).agg(F.min(F.struct("m.ord", "fingerprint", F.col("m.term").alias("value"))).alias("f"))
    return first.select(*KEY, "f.fingerprint", "f.value")


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body over values that are computed once: lambda bodies may hold no Python function, and repeat what they hold for each element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def anchors(title: Column, url: Column, name: Column) -> Column:
    """Organisation anchors as joined words: runs of one to three title words, five letters or more, not all of them stop words and none of the name, that a host or path label holds."""
    path = F.coalesce(F.try_url_decode(u.path(url)), u.path(url), F.lit(""))
    lines = F.concat(F.translate(F.coalesce(u.host(url), F.lit("")), ".", "\n"), F.lit("\n"), F.translate(path, "/", "\n"))
    compound = lambda g: F.concat(F.transform(_list(URL_PREFIXES), lambda p: F.concat(p, g)), F.transform(_list(URL_SUFFIXES), lambda s: F.concat(g, s)))

    def runs(v: Column) -> Column:
        t, of = v["t"], v["of"]
        all_ = F.flatten(F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.when(i + n - 1 <= F.size(t), F.slice(t, i, n)))))
        ok = lambda r: r.isNotNull() & ~F.coalesce(F.arrays_overlap(r, of), F.lit(False)) & (F.size(F.array_except(r, _list(ANCHOR_STOPWORDS))) > 0) & (F.length(F.array_join(r, "")) >= 5)
        return F.transform(F.filter(F.when(F.size(t) > 0, all_), ok), _said)

    def held(v: Column) -> Column:
        labels = F.transform(F.split(v["l"], "\n"), lambda line: _said(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))))
        return _let(lambda w: F.filter(w["runs"], lambda g: F.exists(w["labels"], lambda line: _inside(line, g)) | (~g.contains(" ") & F.arrays_overlap(w["labels"], compound(g)))), runs=runs(v), labels=labels)

    found = _let(held, t=x.context_tokens(title), of=x.context_tokens(name), l=F.lower(x.without_marks(x.visible_text(lines), "NFD")))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def maximal(found: Column) -> Column:
    """Anchors that no longer one holds."""
    return F.filter(found, lambda g: ~F.exists(found, lambda o: (o != g) & _inside(o, g)))


def role_tail(excerpt: Column, name: Column) -> Column:
    """What follows the role that an excerpt states right after the subject, connector and article dropped; empty if nothing does, null if there is no such role."""
    def behind(v: Column) -> Column:
        at = x.sequence_starts(v["tok"], v["of"])
        return F.when(F.size(at) == 1, _said(F.slice(v["tok"], F.get(at, F.lit(0)) + F.size(v["of"]) + 1, F.greatest(F.size(v["tok"]), F.lit(1)))))

    after = _let(behind, tok=x.context_tokens(excerpt), of=x.context_tokens(name))
    def tail(v: Column) -> Column:
        role = F.regexp_extract(v["a"], ROLE_PREFIX, 0)
        rest = F.ltrim(F.substring(v["a"], F.length(role) + 1, F.length(v["a"])))
        return F.when(role != "", F.regexp_replace(F.regexp_replace(rest, f"^(?:{ROLE_CONNECTORS})(?: |$)", ""), f"^(?:{ROLE_ARTICLES})(?: |$)", ""))

    return _let(tail, a=after)


def _fits(tail: Column, anchor: Column) -> Column:
    return F.coalesce((tail == "") | F.startswith(F.concat(tail, F.lit(" ")), F.concat(anchor, F.lit(" "))), F.lit(False))


def traceable_role(proofs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Proofs with traceable: the excerpt names the person and states a role, and one maximal anchor of title and URL is what the role is at. candidates: KEY, display_name, entity_type."""
    c = candidates.select(*KEY, F.col("display_name").alias("__name"), (F.col("entity_type") == "person").alias("__person"))
    d = proofs.join(c, KEY)
    d = with_named(d, F.col("excerpt"), F.col("__name"), F.lit("person"), "__held")
    d = _once(d, __anchors=anchors(F.col("title"), F.col("url"), F.col("__name")), __tail=role_tail(F.col("excerpt"), F.col("__name")))
    d = _once(d, __max=maximal(F.col("__anchors")))
    ok = F.col("__person") & F.col("__held") & F.col("__tail").isNotNull() & (F.size("__max") == 1) & _fits(F.col("__tail"), F.get("__max", F.lit(0)))
    return d.withColumn("traceable", F.coalesce(ok, F.lit(False))).select(*proofs.columns, "traceable")


def role_anchor(facts: DataFrame, context: DataFrame, candidates: DataFrame) -> DataFrame:
    """(KEY, fact_id, proof_id): the first role fact from a publisher, digest and excerpt that the context proofs do not have, sharing exactly one maximal anchor with them, which is what its role is at.

    facts: KEY, fact_id, ord, category and the columns of proofs; context: the proofs behind corroborated terms; candidates: KEY, display_name.
    """
    c = candidates.select(*KEY, F.col("display_name").alias("__name"))
    said = _said(x.context_tokens(F.col("excerpt")))
    wide = lambda d: _once(d.join(c, KEY), __p=u.publisher_domain(F.col("url")), __x=said, __a=anchors(F.col("title"), F.col("url"), F.col("__name")))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    marks = F.concat(F.array(pair("publisher", F.col("__p")), pair("digest", F.col("digest").cast("string")), pair("excerpt", F.col("__x"))), F.transform("__a", lambda g: pair("anchor", g)))
    # one join finds both what a fact must not share with the context and the anchors that it shares
    base = wide(context).select(*KEY, F.inline(marks)).distinct()
    f = _once(wide(facts.where("category = 'role'")), __tail=role_tail(F.col("excerpt"), F.col("__name"))).where("__tail is not null and __p is not null")
    j = f.select(*KEY, "ord", "fact_id", "proof_id", "__tail", F.inline(marks)).join(base, [*KEY, "kind", "value"])
    g = j.groupBy(*KEY, "ord", "fact_id", "proof_id", "__tail").agg(F.max(F.col("kind") != "anchor").alias("clash"), F.collect_set(F.when(F.col("kind") == "anchor", F.col("value"))).alias("__s"))
    g = _once(g.where("not clash"), m=maximal(F.col("__s")))
    g = g.where((F.size("m") == 1) & _fits(F.col("__tail"), F.get("m", F.lit(0))))
    return g.groupBy(*KEY).agg(F.min(F.struct("ord", "fact_id", "proof_id")).alias("f")).select(*KEY, "f.fact_id", "f.proof_id")


def fact_support(candidates: DataFrame, bound: DataFrame, proofs: DataFrame, facts: DataFrame) -> DataFrame:
    """(KEY, basis, proof_id): the proofs that facts back: `corroborated` where a free context is corroborated and a second term or a role anchor stands beside it, else the first traceable role (`single_role`).

    candidates: KEY, display_name, entity_type, exact_name, has_context; bound as in corroborate; facts: KEY, fact_id, ord, category and the columns of proofs.
    """
    # what several branches read is computed once
    bound = settled(bound, "support-bound")
    first = corroborate(candidates.where("has_context"), bound, proofs).select(*KEY, F.col("fingerprint").alias("__f"))
    b = _once(bound, fingerprint=fingerprint(F.col("term"))).join(first, KEY)
    b = settled(b, "support-terms")
    cor = settled(b.where("fingerprint = __f").select(*KEY, "proof_id").distinct(), "support-corroborated")
    second = b.where("fingerprint <> __f").join(cor, [*KEY, "proof_id"], "left_semi").select(*KEY).distinct()
    anchor = role_anchor(facts, proofs.join(cor, [*KEY, "proof_id"], "left_semi"), candidates).join(second, KEY, "left_anti").select(*KEY, "proof_id")
    second, anchor = settled(second, "support-second"), settled(anchor, "support-anchors")
    keys = second.unionByName(anchor.select(*KEY))
    chosen = cor.join(keys, KEY, "left_semi").unionByName(anchor).distinct()
    backed = chosen.join(facts.select(*KEY, "proof_id"), [*KEY, "proof_id"], "left_semi").select(*KEY).distinct()
    chosen = chosen.join(backed, KEY, "left_semi").withColumn("basis", F.lit("corroborated"))
    roles = traceable_role(facts.where("category = 'role'"), candidates.where("exact_name")).where("traceable")
    single = roles.groupBy(*KEY).agg(F.min(F.struct("ord", "proof_id")).alias("m")).select(*KEY, F.col("m.proof_id").alias("proof_id"), F.lit("single_role").alias("basis")).join(backed, KEY, "left_anti")
    return chosen.unionByName(single).select(*KEY, "basis", "proof_id")


def derive_role_facts(people: DataFrame, most_chars: int = 500) -> DataFrame:
    """(KEY, category, excerpt): at most a role and an activity read off the page that proves a person.

    people: KEY, display_name, url, title, excerpt (the proof), text (its page). Read are the proof, each line that holds the name and that line with the next, at most most_chars long, the
    shortest first; a line must stand once in the page. The first traceable one (I9) is the role, the first other one that passes the quality rules the activity.
    A person without page or name has the proof alone.
    """
    low = lambda c: F.lower(c)
    p = _once(dealt(people, *KEY), __t=x.visible_text(F.col("text")), __n=low(x.visible_text(F.col("display_name")))).drop("text")
    p = _once(p, __l=F.split("__t", "\n"))
    named = F.filter(F.sequence(F.lit(0), F.size("__l") - 1), lambda i: low(F.get("__l", i)).contains(F.col("__n")))
    pair = lambda i: F.when(F.get("__l", i + 1).isNotNull(), F.concat_ws("\n", F.get("__l", i), F.get("__l", i + 1)))
    lines = F.flatten(F.transform(F.when((F.size("__l") > 0) & (F.col("__n") != ""), named), lambda i: F.array(F.trim(F.get("__l", i)), F.trim(pair(i)))))
    once = lambda e: F.length("__t") - F.length(F.replace("__t", e, F.lit(""))) == F.length(e)
    lines = F.filter(F.array_distinct(lines), lambda e: e.isNotNull() & F.length(e).between(1, most_chars) & (e != F.col("excerpt")) & once(e))
    d = p.withColumn("__e", F.concat(F.array("excerpt"), F.coalesce(lines, F.array().cast("array<string>")))).select(*KEY, "display_name", "url", "title", F.posexplode("__e").alias("ord", "excerpt"))
    # pages are read once; the role and the activity are chosen among a few lines a person
    d = settled(d.withColumn("len", F.length("excerpt")), "role-lines")
    who = people.select(*KEY, "display_name").distinct().withColumn("entity_type", F.lit("person"))
    first = lambda d: d.groupBy(*KEY).agg(F.min(F.struct("len", "ord", "excerpt")).alias("m"))
    role = first(traceable_role(d.drop("display_name"), who).where("traceable")).select(*KEY, F.lit("role").alias("category"), "m.excerpt")
    q = d.withColumns({"category": F.lit("activity"), "entity_type": F.lit("person"), "subject": F.col("display_name"), "normalized_value": F.lit(None).cast("string"), "period": F.struct(F.lit("unknown").alias("status"))})
    q = claim_quality(q).where("code is null").join(role.select(*KEY, F.col("excerpt").alias("__r")), KEY, "left").where(~F.col("excerpt").eqNullSafe(F.col("__r")))
    return role.unionByName(first(q).select(*KEY, F.lit("activity").alias("category"), "m.excerpt"))
