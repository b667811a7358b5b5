"""Conversation repair against a cheapest-way search over whole audits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from attestry.llm import conversation, queries
from tests.compare import both

R = random.Random(13)
SCHEMA = "conv_id long, turn long, role string, text string, audit string, k int, here boolean"


def rows():
    texts = ["Yes.", "No!", "what", "", " \n", "ok?", "a. b", "end.\n", None]
    out = []
    for c in [*range(60), None]:
        for _ in range(R.choice((1, 2, 5, 9, 14))):
            out.append((c, R.choice((None, *range(12))), R.choice(("system", "user", "user", "assistant", "assistant", "tool", "", None)), R.choice(texts)))
    out += [(900, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(300)] + [(901, i, "user", "same.") for i in range(3000)] + [(902, i, "assistant", f"t{i}") for i in range(2500)]
    out += [(903, 0, "user", "long " * 60_000 + "."), (903, 1, "assistant", "x.")] + [(904, 5, "user", "Twice."), (904, 5, "user", "Twice.")]
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0 and i > 1000)
    return [*out, (dropped, 0, "user", "gone.")]


def damage(c, turn, role, text):
    sp = lambda x: " " if x is None else str(x)
    m, role, text = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
    if m == 1:
        text = ""
    if m == 2:
        text = re.sub("[.!?]", "", text)
    if m == 4:
        role = "user"
    return [(turn, role, text)] * (0 if m == 0 else 2 if m == 3 else 1)


def brute(turns):
    """turns: (turn, role, text) in order. Cheapest, then least audit, by a search in order of (cost, audit)."""
    seen, faults = set(), []
    for _, r, t in turns:
        bare = t.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (r, t) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, t))
    heap, closed = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = roles[-1:] if roles else "-"
        if i == len(turns) and state in "-a":
            break
        if (i, state) in closed:
            continue
        closed.add((i, state))
        to = {"-": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, f"{name}:")))
        if i < len(turns):
            _, r, t = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if (state, r[:1]) in {("-", "s"), ("-", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[:1], (*lines, f"{r}:{t}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to, (*lines, f"{name}:{t}")))
    at = [t for t, *_ in turns if t is not None]
    return (
        max(at) - min(at) + 1 - len(set(at)) if at else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit, lines,
    )


def expected(data, hurt=True):
    convs: dict = {}
    for c, turn, role, text in data:
        convs.setdefault(c, []).extend(damage(c, turn, role, text) if hurt else [(turn, " " if role is None else role, " " if text is None else text)])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: brute(sorted(t, key=order)) for c, t in convs.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("conversations")
    data = rows()
    d = spark.createDataFrame([(*r, "mine", 1, None) for r in R.sample(data, len(data))], SCHEMA)
    d.repartition(3).write.parquet(f"{at}/conversations.parquet")
    return str(at), data


def test_query_by_brute_force(spark, folder):
    at, data = folder
    small = [r for r in data if r[0] not in (901, 902)]
    want = {(c, *w[:-1], hashlib.sha256("\n".join(w[-1]).encode()).hexdigest()) for c, w in expected(small).items()}
    got = {tuple(r) for r in queries.op13_conversation_repair(spark, at).collect() if r.conv_id not in (901, 902)}
    assert got == want
    assert any(w[7] == "" for w in want) and {x for w in want for x in w[7]} == set("DKR")  # an insert never pays at these costs


def test_query_by_sql(spark, folder):
    """With nulls in every column, long runs of one symbol, and a conversation all of whose rows are dropped."""
    import duckdb

    at, data = folder
    spark.read.parquet(f"{at}/conversations.parquet").where("conv_id NOT IN (901, 902) OR conv_id IS NULL OR turn < 150").coalesce(1).write.parquet(f"{at}/few")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/few/*.parquet'")
    got = db.sql(queries.OP13_SQL)
    want = sorted(map(repr, got.fetchall()))
    d = queries.damaged(spark.read.parquet(f"{at}/few"))
    ours = conversation.repair(d, present=d["here"]).select(*got.columns)
    assert sorted(repr(tuple(r)) for r in ours.collect()) == want


def test_matches_sql(spark):
    ours, theirs = both(spark, queries.op13_conversation_repair, queries.OP13_SQL)
    assert ours == theirs


def test_long_runs_by_powers():
    """Runs of thousands of equal symbols give what single rows give, and the halves agree with the whole."""
    for symbols in ([((1, 0), 5000)], [((2, 3), 3000), ((1, 1), 2500)], [((0, 0), 1), ((1, 0), 2049), ((3, 0), 1500)]):
        whole = conversation.Repair().edits([list(x) for x in symbols])
        single = conversation.Repair().edits([[s, 1] for s, n in symbols for _ in range(n)])
        assert whole == single and len(whole[1]) >= sum(n for _, n in symbols)


def test_repaired_rows(spark, folder):
    """The rows themselves, without damage; columns with other names and an empty table."""
    at, data = folder
    small = [r for r in data if r[0] is None or r[0] < 40 or r[0] == 903]
    d = spark.createDataFrame(small, "c long, n long, r string, x string").repartition(2)
    got: dict = {}
    for c, position, role, text in sorted(map(tuple, conversation.repaired_rows(d, "c", "n", "r", "x").collect()), key=lambda r: r[1]):
        assert len(got.setdefault(c, [])) == position
        got[c].append(f"{role}:{text}")
    assert got == {c: list(w[-1]) for c, w in expected(small, hurt=False).items() if w[-1]}
    assert conversation.repair(d.limit(0), "c", "n", "r", "x").count() == 0
