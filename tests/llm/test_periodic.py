"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction


from attestry.llm import periodic, queries

R = random.Random(11)


def brute(w: list) -> list[tuple[int, int, int]]:
    best: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def texts():
    out = [[], ["a"], list("aaaaa"), list("aaaaaa"), list("abababa"), list("abababab"), list("x" + "abc" * 4 + "x"), list("ab" * 40 + "c" + "ab" * 3), list("aabaabaabaab" * 3), list("a" * 500), list("abcde" * 200)]
    for _ in range(400):
        n, k = R.randint(0, 60), R.choice((1, 2, 2, 3, 5))
        w = [R.choice("abcde"[:k]) for _ in range(n)]
        if n and R.random() < 0.7:
            a, p = R.randrange(n), R.randint(1, 9)
            w = w[:a] + (w[a : a + p] * R.randint(2, 30))[: R.randint(1, 90)] + w[a:]
        out.append(w)
    unit = [R.choice("abc") for _ in range(7)]
    out.append(unit * 5 + ["z"] + unit * 9 + ["y", "y"] + unit * 4)
    out.append(sum(([R.choice("abcd")] * R.randint(1, 9) for _ in range(300)), []))
    return out


def test_runs_by_brute_force():
    docs = texts()
    got = periodic.runs_of(docs)
    for w, g in zip(docs, got):
        assert g == brute(w), "".join(w)
    assert [periodic.runs_of([w])[0] for w in docs[:60]] == got[:60]


def test_collisions_cost_no_result(monkeypatch):
    """Small pieces of work give the same runs."""
    monkeypatch.setattr(periodic, "AT_ONCE", 7)
    docs = texts()[:80]
    assert periodic.runs_of(docs) == [brute(w) for w in docs]


def test_grammar_derives_the_text():
    """Every place of a rule spells the same words, and the start rule covers the text."""
    for w in texts():
        ids = [ord(x) for x in w]
        starts, rules = periodic.repair(ids)
        assert starts == sorted(set(starts)) and (not w or starts[0] == 0)
        for left, size, at in rules:
            assert 0 < left < size and len(at) >= periodic.LEAST
            assert len({tuple(ids[p : p + size]) for p in at}) == 1


def planted(k, words):
    h = zlib.crc32(str(k).encode()) if k is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(k, text):
    w = planted(k, (text or "").encode().split())
    runs = brute(w)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        k, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_by_brute_force(spark, tmp_path):
    """Edge rows with every plant, a very long text, repeated rows, null ids and clashing columns."""
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, " \n\t"), (None, None), (4, "x " * 30_000), (4, "x " * 30_000), (5, "ü é " * 50), (6, "a b " * 7)]
    rows += [(i, " ".join(w)) for i, w in enumerate(texts()[:200], 100)]
    rows += [(i, "\n".join(f"w{R.randint(0, 400)}" for _ in range(R.randint(1, 300)))) for i in range(1000, 1150)]
    d = spark.createDataFrame([(k, t, "mine", 3) for k, t in rows], "doc_id long, text string, runs string, n_words int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:8] for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(k, t) for k, t in rows), key=repr)
    assert sum(1 for r in got if r[1]) > 50
    carried = periodic.periodic_runs(d)
    assert carried.columns == [*d.columns, "runs", "n_words", "collapsed"] and {r[2] for r in carried.collect()} == {"mine"}
    assert periodic.periodic_runs(d.limit(0)).count() == 0
