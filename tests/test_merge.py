"""The merge of facts against a port of its order-dependent rule."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions.numbers import metric_value
from attestry.operators import merge
from attestry.plans.facts_plan import merge_facts
from tests.compare import SF

COLUMNS = ("request_id", "ord", "fact_id", "category", "predicate", "scope_type", "scope_label", "fact_period_label", "fact_date", "normalized_value", "unit", "currency", "url", "excerpt")


def port(rows):
    """rows: dicts with mech (mechanical key), number, visible (length) too. One pass, a list of groups, first match wins."""
    norm = lambda v: " ".join((v or "").lower().replace("’", "'").split())
    meta = lambda c: (c["category"], norm(c["predicate"]), c["scope_type"], norm(c["scope_label"]), norm(c["fact_period_label"] or c["fact_date"]), c["number"], norm(c["unit"]), norm(c["currency"]))

    def same(a, b):
        text = bool(a["mech"]) and a["mech"] == b["mech"]
        if a["category"] != b["category"]:
            return text
        if meta(a)[2:5] != meta(b)[2:5]:
            return False
        if a["category"] == "metric":
            return meta(a) == meta(b)
        return norm(a["normalized_value"]) == norm(b["normalized_value"]) and text

    out = set()
    for request in {r["request_id"] for r in rows}:
        groups = []
        for r in sorted((r for r in rows if r["request_id"] == request), key=lambda r: (r["ord"], r["fact_id"])):
            proof = (r["url"], norm(r["excerpt"]))
            g = next((g for g in groups if same(g[0], r)), None)
            if g is None:
                groups.append([r, [proof], 0, r["ord"]])
                continue
            g[2] += 1
            if proof not in g[1]:
                g[1].append(proof)
            if r["visible"] < g[0]["visible"]:
                g[0] = r
        out |= {(request, g[0]["fact_id"], g[3], g[0]["excerpt"], g[2], len(g[1])) for g in groups}
    return out


def check(facts):
    d = facts.withColumns({"mech": x.mechanical_key(F.col("excerpt")), "number": F.coalesce(metric_value(x.visible_text(F.col("excerpt"))).cast("string"), F.lit("unparseable")), "visible": F.length(x.visible_text(F.coalesce("excerpt", F.lit(""))))})
    want = port([r.asDict() for r in d.collect()])
    got = merge.dedupe_facts(facts).select("request_id", "fact_id", "ord", "excerpt", "n_duplicates", "n_proofs")
    assert {tuple(r) for r in got.collect()} == want
    proofs = merge.fact_proofs(facts).groupBy("request_id", "fact_id").count().collect()
    assert sorted(r["count"] for r in proofs) == sorted(w[-1] for w in want)
    return want


def test_merge_of_documents_under_several_categories(spark):
    want = check(merge_facts(spark, SF))
    assert any(w[4] > 3 for w in want)


def test_merge_depends_on_the_order(spark):
    """Random small requests with many near matches: chains over metrics and texts, shorter excerpts that take over, null columns."""
    r = random.Random(8)
    texts = ["Firm A grew.", "firm a  grew", "FIRM A GREW", "Firm A sold 3 million EUR.", "Firm A sold 3 million EUR", "Firm  A sold 3,0 million EUR in all", "", None, "Other line", "other   line ."]
    rows = [
        (r.choice(["a", "b", "c", None]), i, f"f{i}", r.choice(["metric", "metric", "event", "activity", None]), r.choice(["p", "P ", "q"]), "company", r.choice(["L", "l", None]), r.choice([None, None, "2020"]),
         r.choice(["2020", None]), r.choice([None, None, "7"]), "million", r.choice(["EUR", None]), f"u{r.randint(0, 4)}", r.choice(texts))
        for i in range(400)
    ]
    schema = ", ".join(f"{c} {'long' if c == 'ord' else 'string'}" for c in COLUMNS)
    d = spark.createDataFrame(rows, schema)
    check(d.repartition(4))
    assert merge.dedupe_facts(d.limit(0)).count() == 0


def test_no_group_is_held_in_one_frame(spark):
    plan = merge.dedupe_facts(merge_facts(spark, SF))._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "collect_" not in plan
