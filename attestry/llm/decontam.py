"""Benchmark decontamination (operator 8).

Words (lower case, letters and digits) of an item and of item-sized windows of a document are embedded by
the CGK random walk: at step j the walk writes the current word and moves on if a random bit of (j, word)
says so, which turns few edits into few changed places. Sampled places of several independent walks
are the LSH keys of a window; windows that share a key with an item are verified by the exact word
edit distance (bit-parallel, free ends), on the words' 64-bit hashes.

An item of more than PIECE words is keyed by its pieces, which cover it: of the edits allowed in the whole item at least
one piece holds no more than its share, so that piece is found as an item of its own would be. A shorter item is keyed
by its first and its last words, as many as a window size has. The number of walks is the least with which
simulated pairs at the limit reach the target recall. Before all that, a lossless sieve drops windows:
a piece of m words within d edits leaves at least m - q + 1 - q d of its q-word sequences untouched.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.wordhash import ALNUM, mix, spans, windows, word_hashes

SAMPLES, PLACES, PIECE = 8, 3, 48
#: Window sizes: a piece is looked up by windows of the largest of these that fits, at its start and at its end.
GRID = [*range(1, 17), 18, 20, 22, 24, 26, 28, 30, 32, 36, 40, 44, 48]
_SIGNS = regex.compile(r"[^\x00-\x7f\p{L}\p{N}\p{M}]+")


def normal_words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 of a text with the starts and ends of its words."""
    text = (text or "").lower()
    if not text.isascii():
        text = _SIGNS.sub(" ", text)
    raw = text.encode("utf-8", "surrogatepass")
    return raw, *spans(raw, ALNUM)


def edit_distance(pattern: list, text: list) -> tuple[int, int]:
    """Least edits from pattern to a part of text, and where that part ends: Myers' bit-parallel search."""
    m = len(pattern)
    peq: dict = defaultdict(int)
    for i, p in enumerate(pattern):
        peq[p] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for j, t in enumerate(text):
        eq = peq.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces_of(n: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces that an item of n words is cut into: all of about one size, up to PIECE words."""
    count = -(-n // PIECE)
    edges = [n * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class Index:
    """Keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float, walks: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.share, self.walks = share, walks
        self.items = []
        for key, text in items:
            raw, s, e = normal_words(text)
            if len(s):
                self.items.append((key, word_hashes(raw, s, e)))
        self.edits = [int(share * len(h)) for _, h in self.items]
        self.steps = 2 * PIECE
        self.odd = rng.integers(1, 2**63, (walks, self.steps), np.uint64) * np.uint64(2) + np.uint64(1)
        grams: dict[int, list] = {1: [], 3: []}
        needs, self.reach = [], 0
        # windows by size: (item, start in the item)
        self.sizes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, h) in enumerate(self.items):
            for start, n in pieces_of(len(h)):
                d = self.edits[i] * n // len(h)  # a piece's share of the item's edits, rounded down
                q = 3 if n - 2 - 3 * d >= 1 else 1
                grams[q].append(windows(h[start : start + n], q))
                needs.append(n - q + 1 - q * d)
                self.reach = max(self.reach, n + d)
                size = max(g for g in GRID if g <= n)
                self.sizes[size] += sorted({(i, start), (i, start + n - size)})
        self.grams = {q: np.unique(np.concatenate(g)) for q, g in grams.items() if g}
        self.need = max(1, min(needs, default=1))
        self.places = {
            (size, w): [(np.sort(rng.choice(2 * size, min(PLACES, 2 * size), replace=False)), rng.integers(1, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)) for _ in range(SAMPLES)]
            for size in GRID for w in range(walks)
        }
        # the items' own keys: sorted arrays with the windows of each key
        self.keys: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for size, own in self.sizes.items():
            flat = np.concatenate([self.items[i][1][at : at + size] for i, at in own])
            starts = np.arange(len(own)) * size
            for w in range(walks):
                for t, k in enumerate(self._keys(flat, starts, w, size, *self._walk(flat, starts, w, 2 * size))):
                    order = np.argsort(k, kind="stable")
                    self.keys[size, w, t] = (k[order], np.array(own)[order])

    def _walk(self, h: np.ndarray, starts: np.ndarray, w: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Words written and how far the walk has come, for each step (rows) and start."""
        n = len(h) - 1
        wrote, far = np.empty((steps, len(starts)), np.uint64), np.empty((steps, len(starts)), np.int16)
        at = np.zeros(len(starts), np.int64)
        for j in range(steps):
            word = h[np.minimum(starts + at, n)]
            wrote[j], far[j] = word, at
            at = at + ((word * self.odd[w, j]) >> np.uint64(63)).astype(np.int64)
        return wrote, far

    def _keys(self, h, starts, w, size, wrote, far) -> list[np.ndarray]:
        out = []
        for places, odd in self.places[size, w]:
            k = np.zeros(len(starts), np.uint64)
            for p, o in zip(places, odd):
                k += np.where(far[p] < size, wrote[p], np.uint64(0)) * o
            out.append(mix(k))
        return out

    def starts(self, h: np.ndarray) -> np.ndarray:
        """Starts that the sieve leaves."""
        n = len(h)
        if not n or not self.grams:
            return np.zeros(0, np.int64)
        hit = np.zeros(n + 1, np.int64)
        for q, known in self.grams.items():
            g = windows(h, q)
            if len(g):
                found = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
                hit[1 : len(g) + 1] |= found
        if not hit.any():
            return np.zeros(0, np.int64)
        c = np.cumsum(hit)
        upto = np.minimum(np.arange(n) + self.reach, n)
        return np.flatnonzero(c[upto] - c[:n] >= self.need)

    def candidates(self, docs: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(document, item) -> where the item would start by windows that share a key (before the document, if below 0)."""
        found: dict[tuple[int, int], set] = defaultdict(set)
        at = [self.starts(h) for h in docs]
        offsets = np.concatenate(([0], np.cumsum([len(h) + self.reach for h in docs]))).astype(np.int64)
        own = np.concatenate([np.full(len(a), d) for d, a in enumerate(at)]) if docs else np.zeros(0, np.int64)
        if not len(own):
            return {}
        # documents in a row, each followed by words that are none
        flat = np.zeros(int(offsets[-1]), np.uint64)
        for d, h in enumerate(docs):
            flat[offsets[d] : offsets[d] + len(h)] = h
        starts = np.concatenate([a + offsets[d] for d, a in enumerate(at)])
        for low in range(0, len(starts), 1 << 14):
            s, o = starts[low : low + (1 << 14)], own[low : low + (1 << 14)]
            for w in range(self.walks):
                wrote, far = self._walk(flat, s, w, 2 * max(self.sizes))
                for size in self.sizes:
                    for t, k in enumerate(self._keys(flat, s, w, size, wrote, far)):
                        known, items = self.keys[size, w, t]
                        left = np.searchsorted(known, k)
                        for x in np.flatnonzero(known[np.minimum(left, len(known) - 1)] == k):
                            i = left[x]
                            while i < len(known) and known[i] == k[x]:
                                found[int(o[x]), int(items[i][0])].add(int(s[x] - offsets[o[x]] - items[i][1]))
                                i += 1
        return {k: sorted(v) for k, v in found.items()}

    def verified(self, h: np.ndarray, item: int, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best part of a document, if within the item's edits."""
        pattern, d = self.items[item][1].tolist(), self.edits[item]
        best, low = None, 0
        while low < len(starts):
            high = low
            while high + 1 < len(starts) and starts[high + 1] - starts[high] <= len(pattern):
                high += 1
            a, b = max(0, starts[low] - 2 * d - 1), max(0, min(len(h), starts[high] + len(pattern) + 2 * d + 1))
            part = h[a:b].tolist()
            dist, end = edit_distance(pattern, part)
            if dist <= d and (best is None or dist < best[0]):
                back, size = edit_distance(pattern[::-1], part[:end][::-1])
                best = (dist, a + end - (size if back == dist else len(pattern)), a + end)
            low = high + 1
        return best


@lru_cache
def walks_for(share: float, recall: float, trials: int = 500, most: int = 40) -> int:
    """Walks with which `recall` of simulated pieces of several sizes, edited up to the limit, share a key with their item."""
    rng = np.random.default_rng(17)
    index = Index([], share, most, 19)
    need = 1
    for size in (10, 14, 20, 28, 38, PIECE):
        g = max(g for g in GRID if g <= size)
        items, texts, begins = [], [], []
        for _ in range(trials):
            words = rng.integers(1, 2**63, size, np.uint64)
            new = words.tolist()
            for _ in range(int(share * size)):
                p, kind = int(rng.integers(0, len(new))), int(rng.integers(0, 3))
                fresh = int(rng.integers(1, 2**63))
                new[p : p + 1] = ([], [fresh], [new[p], fresh])[kind]
            items.append(words)
            # only windows that start where the item's do, or a word or two beside
            begins.append([2 + x for x in (-2, -1, 0, 1, 2)])
            begins[-1] += [x + len(new) - size for x in begins[-1]]
            texts.append(np.concatenate((rng.integers(1, 2**63, 2, np.uint64), np.array(new, np.uint64), rng.integers(1, 2**63, 2 * PIECE, np.uint64))))
        offsets = np.cumsum([0, *(len(t) for t in texts[:-1])])
        at = np.maximum(0, np.array(begins)) + offsets[:, None]
        flat, own = np.concatenate(texts), np.concatenate(items)
        own_at = np.arange(trials) * size
        own_at = np.stack([own_at, own_at + size - g], axis=1)
        found = np.zeros((trials, most), bool)
        for w in range(most):
            mine = index._keys(own, own_at.ravel(), w, g, *index._walk(own, own_at.ravel(), w, 2 * g))
            theirs = index._keys(flat, at.ravel(), w, g, *index._walk(flat, at.ravel(), w, 2 * g))
            for a, b in zip(mine, theirs):
                same = a.reshape(trials, 2, 1) == b.reshape(trials, 2, 5)  # first words with the windows at the start, last ones with those at the end
                found[:, w] |= same.any(axis=(1, 2))
        got = np.logical_or.accumulate(found, axis=1).mean(axis=0)
        enough = np.flatnonzero(got >= recall)
        need = max(need, int(enough[0]) + 1 if len(enough) else most)
    return need


OUT = T.StructType([
    T.StructField("distance", T.IntegerType()), T.StructField("n_item_words", T.IntegerType()),
    T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()),
])


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    share: float = 0.2, recall: float = 0.995, block_items: int = 2000, block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row for each document and item of which the document holds a passage within share * words edits.

    Columns: the document's key, the item's key, distance (word edits), n_item_words, and the words of the
    document (start_word, end_word) that match best, the first of equally good ones. recall is what the keys find of
    passages at the limit of edits; nothing is found that is not within it. Null, empty and wordless texts
    match nothing; items with a null key are left out; repeated documents give repeated rows, repeated items too. Very
    long texts and items are worked whole, window by window. Further columns of docs and items, whatever their names,
    play no part; an item key named like the documents' key comes back as <name>_item. Items are held against all
    documents in blocks of about block_items or block_bytes, so what goes to the executors is bounded.
    No shuffle: documents are read once for each block.
    """
    known = items.select(F.col(f"`{item_key}`").alias("k"), F.col(f"`{item_text}`").alias("t")).where("k is not null and t is not null")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // block_items), -(-size.b // block_bytes))
    d = docs.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{text}`").alias("__t"))
    walks = walks_for(share, recall)
    schema = T.StructType([d.schema[0], T.StructField("__i", known.schema[0].dataType), *OUT])
    out = None
    for b in range(blocks):
        rows = [(r.k, r.t) for r in known.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).orderBy("k").collect()]
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = Index(sent.value, share, walks)
            for whole in batches:
                for low in range(0, whole.num_rows, 1024):
                    batch = whole.slice(low, 1024)
                    hs = [word_hashes(*normal_words(t)) for t in batch.column(1).to_pylist()]
                    got = []
                    for (doc, item), starts in sorted(index.candidates(hs).items()):
                        if hit := index.verified(hs[doc], item, starts):
                            got.append((doc, index.items[item][0], hit[0], len(index.items[item][1]), hit[1], hit[2]))
                    if got:
                        at = pa.array([g[0] for g in got], pa.int64())
                        cols = [batch.column(0).take(at), pa.array([g[1] for g in got]), *(pa.array([g[i] for g in got], kind) for i, kind in ((2, pa.int32()), (3, pa.int32()), (4, pa.int64()), (5, pa.int64())))]
                        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        part = d.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    names = [key, item_key if item_key != key else f"{item_key}_item"]
    return out.toDF(*names, *OUT.names)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents without those that hold an item; columns, null texts and documents with a null key are kept.

    Of rows with one key all go if one holds an item; without items, or of an empty table, nothing goes."""
    hits = contaminated(docs, items, key=key, **options).select(F.col(f"`{key}`").alias("__hit")).distinct()
    return docs.join(hits, F.col(f"`{key}`") == F.col("__hit"), "left_anti")
