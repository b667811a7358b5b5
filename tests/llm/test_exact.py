"""Exact duplicates against brute force, and the filters by themselves."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import exact

SCHEMA = "doc_id long, text string, keep_id string, n int, digest string, part int"
ROWS = [
    (1, "a"), (2, "a"), (3, "a "), (4, ""), (5, None), (6, "b"), (6, "b"), (7, "b"), (7, "b"), (None, "c"), (None, "c"), (None, "d"), (8, "d"), (9, "long " * 60_000), (10, "long " * 60_000),
    (11, "long " * 60_000 + "x"), (12, "é"), (13, "é"), *[(100 + i, "hot") for i in range(300)], *[(1000 + i, f"t{i % 90}") for i in range(120)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "mine", 1, "d", i) for i, (k, t) in enumerate(ROWS)], SCHEMA).repartition(3).cache()


def brute():
    groups: dict[str, list] = {}
    for k, t in ROWS:
        groups.setdefault(t or "", []).append(k)
    out = []
    for k, t in ROWS:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((k, keep, len(g), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("old", ["part % 2 = 0", "part % 7 < 6", "true", "false", "null"])
def test_groups_by_brute_force(docs, old):
    """However rows are dealt between snapshot and batch, and with many small filters."""
    got = exact.deduplicate(docs, F.expr(old).cast("boolean"), columns=["doc_id"], per_filter=5)
    assert sorted(map(tuple, got.collect()), key=repr) == brute()


def test_clashing_columns_and_empty_tables(docs):
    got = exact.deduplicate(docs, F.col("part") > 100)
    assert got.columns == [*docs.columns, "keep_id", "group_size", "kept", "text_sha256"]
    assert {r[2] for r in got.collect()} == {"mine"}
    assert exact.deduplicate(docs.limit(0), F.lit(True)).count() == 0


def test_filters_miss_nothing_and_pass_little():
    r = np.random.default_rng(3)
    other = r.integers(0, 2**63, 50_000).astype(np.uint64)
    for n in (1, 2, 3, 17, 1000, 60_000):
        keys = r.integers(0, 2**63, n).astype(np.uint64)
        f = exact.fuse(np.concatenate((keys, keys[:5])))
        assert exact.holds(keys, *f).all()
        assert exact.holds(other, *f).mean() < 0.006
        assert len(f[3]) < 10 * n / 8 + 64 or n <= 1000


def test_screen_lets_copies_and_few_others_pass(spark):
    """Copies always pass, whatever the number of tasks; texts are joined without another shuffle of them."""
    text = lambda lo, hi: exact.with_digest(spark.range(lo, hi).withColumn("text", F.concat(F.lit("t"), "id")), "id", "text")
    s = exact.snapshot(text(0, 20_000), per_filter=500)
    assert s.filters.count() == 256 and s.rows == 20_000
    batch = text(19_000, 40_000)
    passed = {bytes(r.digest) for r in exact.screen(batch.select("digest"), s, per_task=50).collect()}
    assert {bytes(r.digest) for r in text(19_000, 20_000).collect()} <= passed
    assert len(passed) < 1_000 + 20_000 * 0.006
