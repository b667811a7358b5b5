"""Periodic runs of words (operator 12), found on a grammar.

A run is a stretch of consecutive words with smallest period q and length >= max(6, 4 q) that no neighbouring
word extends. Each document is compressed by Re-Pair on word ids: the most frequent pair of neighbours becomes
a nonterminal until no pair stands three times. All that stays, the start rule, is closed by a balanced tree. A
nonterminal has one boundary, between its two parts, and every run crosses the boundary of the smallest
nonterminal that holds it; so the runs across each boundary are computed once, on one expansion, translated
to all places of its derivation and merged to maximal intervals.

A run holds each of its pairs three times at least. Where a document has a pair that does not stand three times, no run
crosses, and the document falls apart there: only stretches of frequent pairs are compressed and searched.

Across a boundary b, a run of period q and length 4 q has 2 q words on one side, so the q words beside b equal the next q.
Sums of word values times powers, modulo 2**64, propose such q for all boundaries of a batch at once; what they propose
is compared word by word, so a collision can cost time only.
"""

from __future__ import annotations

import bisect
import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import map_arrow, words_of

#: A pair becomes a nonterminal from this many places on: a run of exponent four (or of six equal words) has no fewer.
LEAST = 3
SHORTEST = 6
EXPONENT = 4
#: Pairs of boundary and period that are looked at together.
AT_ONCE = 1_000_000

OUTPUTS = T.StructType([
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))),
    T.StructField("n_words", T.LongType()),
    T.StructField("collapsed", T.StringType()),
])


def repair(word: list[int]) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Re-Pair. word has ids >= 0, a pair that must not be joined has an id of its own between.

    Gives the places where the symbols of the start rule begin, and the rules (words of the left part, words of both,
    all places where the rule stands). The places of a rule are those replaced when it is made: later rules only
    take it in, so they are all positions of its derivation.
    """
    n = len(word)
    sym, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(word, word[1:])):
        places.setdefault(pair, []).append(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) >= LEAST]
    heapq.heapify(heap)
    size: dict[int, int] = {}
    rules: list[tuple[int, int, list[int]]] = []
    new = max(word, default=0) + 1
    while heap:
        count, pair = heapq.heappop(heap)
        a, b = pair
        at, end = [], -1
        for i in places[pair]:  # those that still stand and do not overlap
            if i >= end and sym[i] == a and after[i] < n and sym[after[i]] == b:
                at.append(i)
                end = after[after[i]]
        if len(at) < LEAST:
            continue
        if len(at) < -count:
            places[pair] = at
            heapq.heappush(heap, (-len(at), pair))
            continue
        left = size.get(a, 1)
        size[new] = left + size.get(b, 1)
        rules.append((left, size[new], at))
        for i in at:
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
        made: dict[tuple[int, int], list[int]] = {}
        for i in at:
            if (p := before[i]) >= 0:
                made.setdefault((sym[p], new), []).append(p)
            if (k := after[i]) < n and sym[k] != new:
                made.setdefault((new, sym[k]), []).append(i)
        for p, x in made.items():
            if len(x) >= LEAST:
                places[p] = x
                heapq.heappush(heap, (-len(x), p))
        new += 1
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = after[i]
    return starts, rules


def _reach(w: np.ndarray, x: int, q: int, stop: int, step: int) -> int:
    """How far from x, in direction step and before stop, words equal those q places on."""
    n, size = abs(stop - x), 32
    done = 0
    while done < n:
        take = min(size, n - done)
        low = x + done if step > 0 else x - done - take + 1
        same = w[low : low + take] == w[low + q : low + q + take]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done, size = done + take, size * 4
    return n


def crossing(w: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, start, end, q): stretches of period q, as long as runs are, at the boundary of each node (low, boundary, high)."""
    if not len(nodes):
        return []
    low, mid, high = nodes.T
    power = np.cumprod(np.full(len(w) + 1, 0x9E3779B97F4A7C15, np.uint64))
    value = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power[:-1])))
    out: list[tuple[int, int, int, int]] = []
    for side in (1, -1):
        most = np.minimum((high - mid if side > 0 else mid - low) // 2, (high - low) // EXPONENT)
        most[high - low < SHORTEST] = 0
        ends = np.cumsum(most)
        first = 0
        while first < len(nodes):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
            m = most[first:last]
            node = np.repeat(np.arange(first, last), m)
            q = np.arange(len(node)) - np.repeat(np.cumsum(m) - m, m) + 1
            b = mid[node]
            hit = w[b] == w[b + q] if side > 0 else w[b - 1] == w[b - 1 - q]
            node, q = node[hit], q[hit]
            x = mid[node] - (0 if side > 0 else 2 * q)
            one, two = total[x + q] - total[x], total[x + 2 * q] - total[x + q]
            hit = one * power[q - 1] == two
            found = None
            for k, p, at in zip(node[hit].tolist(), q[hit].tolist(), x[hit].tolist()):
                # a multiple of a period that reaches as far says nothing new
                if found and found[0] == k and p % found[3] == 0 and found[1] <= at and at + 2 * p <= found[2]:
                    continue
                s = at - _reach(w, at - 1, p, int(low[k]) - 1, -1)
                e = at + _reach(w, at, p, int(high[k]) - p, 1) + p
                if e - s >= max(SHORTEST, EXPONENT * p):
                    found = (k, s, e, p)
                    out.append(found)
            first = last
    return out


def _tree(starts: list[int], end: int) -> list[tuple[int, int, int]]:
    """The nodes of a balanced tree over symbols: (start, start of the right half, end)."""
    edges, out, step, m = [*starts, end], [], 1, len(starts)
    while step < m:
        for i in range(0, m - step, 2 * step):
            out.append((edges[i], edges[i + step], edges[min(i + 2 * step, m)]))
        step *= 2
    return out


def stretches(w: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) of what runs can lie in: words whose neighbours are pairs that the document has three times."""
    if len(w) < SHORTEST:
        return []
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = np.flatnonzero(doc[:-1] == doc[1:])
    pair = w[:-1][inside] * (int(w.max()) + 1) + w[1:][inside]
    _, pair = np.unique(pair, return_inverse=True)
    key = doc[inside] * len(pair) + pair
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    many = np.repeat(np.diff(cut) >= LEAST, np.diff(cut))
    hot = np.zeros(len(w) + 1, bool)
    hot[inside[order[many]]] = True
    change = np.diff(hot.astype(np.int8), prepend=0)
    a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    keep = b - a >= SHORTEST - 1
    return list(zip(doc[a[keep]].tolist(), a[keep].tolist(), (b[keep] + 1).tolist()))


def runs_of(words: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document, ordered by start, then period."""
    ids: dict = {}
    w = np.array([ids.setdefault(x, len(ids)) for doc in words for x in doc], np.int64)
    edges = np.concatenate(([0], np.cumsum([len(doc) for doc in words]))).astype(np.int64)
    nodes: list[tuple[int, int, int]] = []
    standing: list[tuple[int, list[int]]] = []  # document and places of each node
    pieces = stretches(w, edges)
    at = 0
    while at < len(pieces):
        doc, text, place = pieces[at][0], [], []
        own: list[tuple[int, int]] = []
        while at < len(pieces) and pieces[at][0] == doc:
            _, a, b = pieces[at]
            own.append((len(text), len(text) + b - a))
            text += [*w[a:b].tolist(), len(ids) + at]  # what ends a stretch stands once
            place += range(a, b + 1)
            at += 1
        starts, rules = repair(text)
        for left, size, where in rules:
            p = place[where[0]]
            nodes.append((p, p + left, p + size))
            standing.append((doc, [place[x] for x in where]))
        for a, b in own:
            top = _tree([place[x] for x in starts if a <= x < b], place[b - 1] + 1)
            nodes += top
            standing += [(doc, [node[0]]) for node in top]
    found: dict[int, set] = {}
    first = edges.tolist()
    for k, s, e, q in crossing(w, np.array(nodes, np.int64).reshape(-1, 3)):
        doc, where = standing[k]
        found.setdefault(doc, set()).update((q, s - nodes[k][0] + p - first[doc], e - nodes[k][0] + p - first[doc]) for p in where)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for doc, spans in found.items():
        out[doc] = sorted((s, e - s, q) for s, e, q in maximal(spans))
    return out


def maximal(spans: set) -> list[tuple[int, int, int]]:
    """Maximal intervals (start, end, q) of spans (q, start, end).

    Those of one period that share q words or more are one. What lies in a run of a proper divisor of its period is a
    part of that run."""
    by_period: dict[int, list[list[int]]] = {}
    for q, s, e in sorted(spans):
        mine = by_period.setdefault(q, [])
        if mine and s + q <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], e)
        else:
            mine.append([s, e])
    out = []
    for q, mine in by_period.items():
        smaller = [x for p, x in by_period.items() if p < q and q % p == 0]
        for s, e in mine:
            if not any((i := bisect.bisect_right(x, [s, sys.maxsize])) and e <= x[i - 1][1] for x in smaller):
                out.append((s, e, q))
    return out


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that a run has after its first period."""
    gone = np.zeros(len(words) + 1, np.int32)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [x for x, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def periodic_runs(df: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """df with runs (array of start, length, period in words, from 0, by start and period), n_words, and collapsed
    (the words without the repeats of any run, joined by one space).

    Words part at the six ASCII white-space bytes and are compared unchanged. Null and empty texts have no words, no
    runs and an empty collapsed. Each row is worked by itself, whole and however long, so repeated rows get equal
    answers and an empty table an empty one. Results stand beside columns of df that have their names (by place).
    keep limits the columns carried. Map only: nothing is shuffled.
    """

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            found = runs_of(words)
            kept = [b" ".join(collapse(w, r) if r else w).decode("utf-8", "surrogatepass") for w, r in zip(words, found)]
            shape = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            runs = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], shape)
            return [runs, pa.array([len(w) for w in words], pa.int64()), pa.array(kept, pa.string())]

        return run

    return map_arrow(df, [F.col(f"`{text}`")], make, OUTPUTS, keep)
