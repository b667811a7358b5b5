"""Literal cases of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F


def _column(spark, rows, f):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in d.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_metric_values(spark):
    from attestry.functions.numbers import metric_value

    cases = {
        "1 milliard EUR": 1e9, "1000 millions EUR": 1e9, "1.5 billion EUR": 1.5e9, "157 894 employés": 157894.0, "in 2024 revenue of 3,2 millions": 3.2e6,
        "1,234 million": None, "3 or 4 sites": None, "none": None, "1.234.567,5 EUR": None, "1.234.567 EUR": 1234567.0, "in 2024": None,
    }
    assert _column(spark, list(cases), metric_value) == list(cases.values())


def test_value_nature(spark):
    from attestry.functions.numbers import value_nature

    cases = {
        "Firm A reported revenue of 3 million EUR": "published", "estimated revenue": "estimated", "not yet published": "unknown", "unreported": "unknown",
        "reported and estimated": "unknown", "les chiffres publiés": "published", "chiffre contesté, publié": "unknown", None: "unknown",
    }
    assert _column(spark, list(cases), value_nature) == list(cases.values())


def test_period_key(spark):
    from attestry.functions.numbers import period_key

    cases = {"calendar year 2024": "2024|calendar", "exercice 2023": "2023|fiscal", "Q1 fiscal year 2024": None, "fiscal year 2023 and 2024": None, "2024": None, "": None}
    assert _column(spark, list(cases), period_key) == list(cases.values())


def test_refusal(spark):
    from attestry.functions.urls import refusal

    cases = {
        "https://example.com/a": None, "http://example.com/": "not_https", "https://u:p@example.com/": "credentials", "https://example.com:8443/": "port", "https://10.0.0.1/": "ip_literal",
        "https://localhost/": "not_public", "https://a.internal/": "private_suffix", "https://-a.com/": "host_malformed", "https://a.b1/": "suffix_malformed", "https://a\\b.com/": "backslash",
        "nonsense": "malformed", None: "malformed",
    }
    assert _column(spark, list(cases), refusal) == list(cases.values())


def test_mechanical_key(spark):
    from attestry.functions.text import mechanical_key

    rows = ["“A”  b—c…", '"a" b-c...', "Été chaud.", "x​ y", None]
    got = _column(spark, rows, mechanical_key)
    assert got[0] == got[1] == '"a" b-c..' and got[2] == "été chaud" and got[3] == "x y" and got[4] is None


def test_workforce_observation(spark):
    from attestry.operators.metrics import observe_metrics

    rows = [("Acme Ltd reported average headcount of 157 894 employees in fiscal year 2024", "Acme Ltd"), ("Acme Ltd reported headcount of 5 employees in fiscal year 2024", "Acme Ltd"), (None, "x"), ("", None)]
    got = [r.obs for r in observe_metrics(spark.createDataFrame(rows, "excerpt string, scope_label string")).collect()]
    assert got[0].metric == "workforce" and got[0].definition == "headcount_average" and got[0].value == 157894 and got[1:] == [None] * 3


def test_proofs_of_facts_are_rows(spark):
    """Proofs are counted and listed one a row: no array of texts grows with a hot fact."""
    from attestry.operators.merge import dedupe_facts, fact_proofs

    rows = [("r", i, f"f{i}", "Same  text." if i % 2 else "same text", f"u{i % 40}") for i in range(200)] + [("r", 900, "g", None, "u"), (None, 901, "h", "same text", None)]
    d = spark.createDataFrame(rows, "request_id string, ord long, fact_id string, excerpt string, url string")
    d = d.withColumns({"category": F.lit("activity"), "scope_type": F.lit("company"), **{c: F.lit(None).cast("string") for c in ("scope_label", "fact_period_label", "fact_date", "normalized_value", "predicate", "unit", "currency")}})
    out = dedupe_facts(d)
    assert not [f.name for f in out.schema if f.dataType.typeName() == "array"]
    got = {(r.request_id, r.fact_id): (r.excerpt, r.n_duplicates, r.n_proofs) for r in out.collect()}
    assert got == {("r", "f0"): ("same text", 199, 40), ("r", "g"): (None, 0, 1), (None, "h"): ("same text", 0, 1)}
    proofs = sorted(map(tuple, fact_proofs(d).collect()), key=repr)
    assert proofs == sorted({(r[0], "f0" if r[2][0] == "f" else r[2], r[4], r[3]) for r in rows}, key=repr)


def test_excerpts_in_whole_documents(spark):
    """Repeated heads, borders, contexts and a very long text, against a search in Python."""
    from attestry.plans.text_plan import locate_in_documents

    head, item = "Firm A sells tools.", "one two three four five six seven eight nine"
    texts = [
        (1, f"{head} It is old.\n{'filler words here ' * 60_000}\nend"), (2, f"{head} Later: {head} Again."), (3, f"{head}\nx{head}"), (4, None), (5, ""), (6, "long " * 200 + "end"),
        (7, f"Start here. And {item} then\nmore"), (8, f"Begin now. {item}, and {item}."),
    ]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.kind, r.page_id): r for r in locate_in_documents(d, spark.createDataFrame([(70, item)], "item_id long, text string")).collect()}
    codes = {k: r.code for k, r in got.items()}
    missing, many = "source_excerpt_missing", "source_excerpt_ambiguous"
    assert codes == {("head", 1): None, ("head", 2): many, ("head", 3): None, ("head", 4): missing, ("head", 5): missing, ("head", 6): missing, ("head", 7): None, ("head", 8): None, ("item", 7): None, ("item", 8): many}
    for k, r in got.items():
        if r.code is None:
            t = dict(texts)[k[1]]
            assert (r.start, r.verified) == (t.index(r.verified), t[r.start : r.end]) and r.verified in (head, item, "Start here.", "Begin now.")
    assert (got["item", 7].before, got["item", 7].after) == ("Start here. And ", " then")


def test_short_excerpts_of_short_words(spark):
    from attestry.operators.evidence import search_excerpts

    docs = [(1, "now it is so and more"), (2, "it is"), (3, "也 是 的 more"), (4, "z"), (5, None), (6, "")]
    items = [(10, "it is so"), (11, "是 的"), (12, "z"), (13, "it"), (14, "or")]
    got = search_excerpts(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, i, t.index(e)) for k, t in docs for i, e in items if e in (t or ""))


def test_discriminators_bound_to_the_subject(spark):
    from attestry.operators.support import DISCRIMINATORS, verify_discriminators

    cases = [
        ("Jeanne Martin travaille chez Nordix", "employer", "Nordix", True), ("Jeanne Martin est directrice générale de Nordix", "employer", "Nordix", True), ("Jeanne Martin rencontre Nordix", "employer", "Nordix", False),
        ("Jeanne Martin, with Paul Durand, works at Nordix", "employer", "Nordix", False), ("Nordix emploie Jeanne Martin", "employer", "Nordix", False), ("Jeanne Martin travaille à Lyon", "city", "Lyon", True),
        ("Jeanne Martin mise à jour le 3 mai 2024 à Lyon", "city", "Lyon", True), ("Jeanne Martin enseigne le piano à Lyon", "city", "Lyon", True), ("Jeanne Martin mange des pommes à Lyon", "city", "Lyon", False),
        ("Jeanne Martin et Paul Durand vit à Lyon", "city", "Lyon", False), ("Jeanne Martin est experte en intelligence artificielle", "industry", "AI", True), ("Jeanne Martin aime les robots en IA", "industry", "ia", False),
        ("Jeanne Martin dirige une formation professionnelle en robotique", "industry", "Robotique", True), ("Jeanne Martin immatriculée au RCS sous le numéro 123", "legal_identifier", "123", False),
        ("Jeanne Martin immatriculée numero 123", "legal_identifier", "123", True), ("Jeanne Martin active depuis 2019", "year", "2019", True), ("Jeanne Martin et Jeanne Martin depuis 2019", "year", "2019", False), (None, "year", "2019", False),
    ]
    rows = [(i, "k", "Jeanne Martin", "person", *[v if k == key else None for k in DISCRIMINATORS], "https://www.site.fr") for i, (_, key, v, _) in enumerate(cases)]
    schema = "request_id int, candidate_key string, display_name string, entity_type string, " + ", ".join(f"{k} string" for k in DISCRIMINATORS) + ", official_site string"
    proofs = [(i, "k", i, "https://a.site.fr/x" if i == 0 else "https://other.fr/x", f"d{i}", None, c[0]) for i, c in enumerate(cases)]
    proofs = spark.createDataFrame(proofs, "request_id int, candidate_key string, proof_id int, url string, digest string, title string, excerpt string")
    got = {r.request_id: r.asDict() for r in verify_discriminators(spark.createDataFrame(rows, schema), proofs).collect()}
    assert {i: got[i][key] for i, (_, key, _, _) in enumerate(cases)} == {i: v if ok else None for i, (_, _, v, ok) in enumerate(cases)}
    assert [i for i in got if got[i]["official_site"]] == [0]


def test_anchors_and_roles(spark):
    from attestry.operators import support as s

    rows = [
        ("Jeanne Martin | Atelier Nordix", "https://www.atelier-nordix.fr/equipe", "Jeanne Martin est directrice de l'Atelier Nordix", ["atelier", "nordix", "atelier nordix"], ["atelier nordix"], "atelier nordix"),
        ("Nordix - Contact", "https://getnordix.com/", "Jeanne Martin leads", ["nordix"], ["nordix"], ""), ("Équipe", "https://x.fr/equipe", "Nordix nomme Jeanne Martin", [], [], None),
        (None, None, None, [], [], None), ("Jeanne Martin", "https://jeanne-martin.fr", "Jeanne Martin fondatrice Jeanne Martin", [], [], None), ("Prix Nordix", "https://a.fr/nordix%20x", "Jeanne Martin is the CEO at the Nordix", ["nordix"], ["nordix"], "nordix"),
    ]
    d = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, title string, url string, excerpt string")
    a = s.anchors(F.col("title"), F.col("url"), F.lit("Jeanne Martin"))
    got = d.withColumn("a", a).select("a", s.maximal(F.col("a")).alias("m"), s.role_tail(F.col("excerpt"), F.lit("Jeanne Martin")).alias("t"), "i").orderBy("i").collect()
    assert [(sorted(r.a), r.m, r.t) for r in got] == [(sorted(r[3]), r[4], r[5]) for r in rows]


def test_support_of_facts(spark):
    """Corroboration by two publishers, a second term or a role anchor beside it, and a single traceable role."""
    from attestry.operators import support as s

    who = spark.createDataFrame([(i, "k", "Jeanne Martin", "person", i != 5, i != 4) for i in range(6)], "request_id int, candidate_key string, display_name string, entity_type string, exact_name boolean, has_context boolean")
    proof = lambda i, n, host, title, text: (i, "k", n, f"https://{host}/{n}", f"d{n}", title, text)
    cols = "request_id int, candidate_key string, proof_id int, url string, digest string, title string, excerpt string"
    p = [proof(i, n, f"p{n}.fr/nordix", "Nordix news", f"Jeanne Martin est experte en robotique numero {n}") for i in range(6) for n in (1, 2)]
    facts = [(*proof(i, 3, "p3.fr/nordix", "Nordix team", "Jeanne Martin est directrice de Nordix"), 7, 1, "role") for i in (1, 2, 4, 5)] + [(*proof(0, 1, "p1.fr/nordix", "x", "y"), 6, 0, "activity")]
    bound = [(i, "k", 0, "robotique", n) for i in range(6) for n in (1, 2)] + [(0, "k", 1, "Lyon", 2), (3, "k", 1, "Lyon", 2)]
    p, facts = spark.createDataFrame(p, cols), spark.createDataFrame(facts, cols + ", fact_id int, ord int, category string")
    bound = spark.createDataFrame(bound, "request_id int, candidate_key string, ord int, term string, proof_id int")
    assert {(r.request_id, r.fingerprint) for r in s.corroborate(who, bound, p).collect()} == {(i, "robotique") for i in range(5)}
    got = {(r.request_id, r.basis, r.proof_id) for r in s.fact_support(who, bound, p, facts).collect()}
    both = {(i, "corroborated", n) for i in (1, 2) for n in (1, 2, 3)} | {(0, "corroborated", n) for n in (1, 2)}
    assert got == both | {(4, "single_role", 3)}


def test_role_lines(spark):
    from attestry.operators.support import derive_role_facts

    text = "Nordix\nJeanne Martin\nDirectrice de Nordix\nAutre ligne\nJeanne Martin travaille chez Nordix depuis longtemps."
    rows = [(1, "k", "Jeanne Martin", "https://nordix.fr/equipe", "Nordix", "Jeanne Martin", text), (2, "k", "Jeanne Martin", "https://nordix.fr", "Nordix", "Jeanne Martin", None), (3, "k", None, None, None, None, "")]
    got = derive_role_facts(spark.createDataFrame(rows, "request_id int, candidate_key string, display_name string, url string, title string, excerpt string, text string")).collect()
    assert {(r.request_id, r.category, r.excerpt) for r in got} == {(1, "role", "Jeanne Martin\nDirectrice de Nordix"), (1, "activity", "Jeanne Martin travaille chez Nordix depuis longtemps.")}


def test_client_keys(spark):
    import hashlib

    from attestry.streaming.monitor import client_key

    rows = [(0, None, " 1.2.3.4 , 9.9.9.9"), (1, "5.6.7.8", "1.2.3.4"), (2, None, None), (3, "", "1.2.3.4"), (4, None, "x" * 200)]
    d = spark.createDataFrame(rows, "i int, a string, b string")
    got = [r.k for r in d.select("i", client_key({"x-vercel-forwarded-for": F.col("a"), "x-forwarded-for": F.col("b")}, "salt").alias("k")).orderBy("i").collect()]
    assert got == [hashlib.sha256(f"salt{v}".encode()).hexdigest() for v in ("1.2.3.4", "5.6.7.8", "address-unavailable", "address-unavailable", "x" * 128)]
