"""States of metric facts by class against all pairs, and a subject with a hundred thousand facts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SIG = "struct<metric:string,definition:string,currency:string,scale:string,scope_kind:string,value:double,period_key:string,nature:string>"
FACT = f"request_id string, subject_key string, fact_id string, ord long, category string, scope_type string, scope_label string, predicate string, contradiction_key string, unit string, url string, digest string, sig {SIG}"


def facts(spark, n: int, seed: int):
    r = random.Random(seed)
    first = {"metric": "revenue", "definition": "standard", "kind": "entity", "period": "2020|fiscal", "nature": "published", "currency": "EUR", "type": "company", "label": "A", "pred": "p", "def": "d", "value": 5.0, "page": 0, "digest": 0}
    other = {
        "metric": ["workforce"], "definition": ["adjusted"], "kind": ["group"], "period": ["2021|fiscal"], "nature": ["estimated", "unknown"], "currency": ["USD"], "type": ["group"], "label": ["B", "a "], "pred": ["q"],
        "def": ["", None, "e"], "value": [5.0 + 1e-13, 7.0, 9.0], "page": [1, 2], "digest": [1, 2],
    }
    rows, loose = [], {}
    for i in range(n):
        subject = r.randrange(n // 4)
        varies = loose.setdefault(subject, r.sample(sorted(other), r.randint(0, 3)) + r.choice([[], ["value"], ["value", "page"], ["value", "page", "digest"]]))
        f = first | {k: r.choice([first[k], *other[k]]) for k in varies}
        sig = None if r.random() < 0.03 else (f["metric"], f["definition"], f["currency"], "million", f["kind"], f["value"], f["period"], f["nature"])
        rows.append(("r", f"s{subject}", f"f{i}", i, "metric", f["type"], f["label"], f["pred"], f["def"], "million", f"https://x.com/{f['page']}", f"d{f['digest']}", sig))
    return spark.createDataFrame(rows, FACT)


def test_states_equal_those_of_all_pairs(spark):
    from attestry.operators import metrics as m

    for seed in (1, 2):
        d = facts(spark, 260, seed)
        r = random.Random(seed)
        more = [(f"f{i}", f"https://x{r.randrange(3)}.com/{r.randrange(2)}", f"d{r.randrange(3)}") for i in range(0, 260, 2)]
        proofs = d.select("fact_id", "url", "digest").unionByName(spark.createDataFrame(more, "fact_id string, url string, digest string")).withColumn("digest", F.when(F.col("fact_id") != "f9", F.col("digest")))
        want = {tuple(x) for x in m.reconcile(m.independent_pairs(m.compare_metrics(d), proofs)).collect()}
        got = {tuple(x) for x in m.reconcile_facts(d, proofs).collect()}
        assert got == want
        assert len({s for _, s in got}) == 4
    assert m.reconcile_facts(d.limit(0), proofs).count() == 0


def test_one_subject_with_very_many_facts(spark):
    """No pair is made: a hundred thousand comparable facts of one subject take groups, not a self-join."""
    from attestry.operators import metrics as m

    d = spark.range(100_000).select(
        F.lit("r").alias("request_id"), F.lit("s").alias("subject_key"), F.col("id").cast("string").alias("fact_id"), F.col("id").alias("ord"), F.lit("metric").alias("category"), F.lit("company").alias("scope_type"), F.lit("A").alias("scope_label"),
        F.lit("p").alias("predicate"), F.lit("d").alias("contradiction_key"), F.lit("million").alias("unit"), F.concat(F.lit("https://x.com/"), F.col("id") % 1000).alias("url"), (F.col("id") % 1000).cast("string").alias("digest"),
        F.struct(*[F.lit(v).alias(k) for k, v in (("metric", "revenue"), ("definition", "standard"), ("currency", "EUR"), ("scale", "million"), ("scope_kind", "entity"))], (F.col("id") % 777).cast("double").alias("value"), F.lit("2020|fiscal").alias("period_key"), F.lit("published").alias("nature")).alias("sig"),
    )
    states = m.reconcile_facts(d, d.select("fact_id", "url", "digest"))
    assert states.groupBy("state").count().collect() == [("contradiction", 100_000)]
    groups = m.conflict_groups(d, states)
    assert [(r.n_facts, r.n_values, r.n_pages) for r in groups.collect()] == [(100_000, 777, 1000)]
    assert m.conflict_versions(d, groups).agg(F.count("*"), F.max("version")).first() == (100_000, 99_999)
    assert not [f for f in groups.schema if f.dataType.typeName() == "array"]
