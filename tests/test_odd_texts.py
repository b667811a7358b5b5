"""Texts in which a rule's word stands where it is none: names like currencies, joining words before letters with marks."""

from __future__ import annotations

from attestry.operators.assembly import parse_proposals
from attestry.operators.metrics import metric_signature, observe_metrics


def _observed(spark, rows):
    return {r.name: r.obs for r in observe_metrics(spark.createDataFrame(rows, "name string, text string"), "text", "name").collect()}


def test_a_name_like_a_currency_is_none(spark):
    said = "{} reported revenue of {} in calendar year 1995"
    names = {"Firm CAD Ltd": ("1.9 million EUR", "EUR"), "Firm CHF Ltd": ("2 million USD", "USD"), "Firm BD Ltd": ("2 million EUR", "EUR"), "Firm EUR Ltd": ("3 million", None), "Firm GBP Ltd": ("1 million EUR and USD", None)}
    got = _observed(spark, [(n, said.format(n, v)) for n, (v, _) in names.items()])
    assert {n: o and o.currency for n, o in got.items()} == {n: c for n, (_, c) in names.items()}


def test_a_signature_of_a_name_like_a_currency(spark):
    name, year = "Firm CAD Ltd", "1996"
    row = ("f", "metric", "revenue", "company", name, year, f"calendar year {year}", "million", "EUR", f"{name} reported revenue of 1.4 million EUR in calendar year {year}")
    d = spark.createDataFrame([row], "fact_id string, category string, predicate string, scope_type string, scope_label string, fact_date string, fact_period_label string, unit string, currency string, excerpt string")
    assert metric_signature(d).first().sig.currency == "EUR"


def test_joining_words_end_where_ascii_letters_end(spark):
    shape = "STATUS: evidence\nENTITY_TYPE: company\nCLAIM: {}\nSOURCE_URL: https://a.example.com/\nEXCERPT: seen\nPREFIX: NONE\nSUFFIX: after"
    claims = {"Elle vend pour etépaenaux ici": "non_atomic_claim", "Elle vend éqûet à Paris ici": "non_atomic_claim", "Elle vend des étuis et rien": "non_atomic_claim", "Elle vend etal_et etc ici": None, "Elle vend des quiches ici": None}
    got = {r.id: r.code for r in parse_proposals(spark.createDataFrame([(c, shape.format(c)) for c in claims], "id string, text string")).collect()}
    assert got == claims
