"""N-gram Jaccard self-join by chosen paths (operator 2).

Texts become sets of word n-grams, sets become min-hash sketches. A run starts from one node that holds all
sketches; a node samples places of the sketch, each with probability 1 / (threshold * places), and sends a set to one
child for each sampled place, by its value there, so similar sets share a child as often as not. Nodes
of at most bucket sets are leaves and are compared by brute force on the exact n-gram sets; larger ones
are split again. Independent runs are repeated until the target recall. What is still large at the last
level is compared in blocks, exactly, so no hot bucket is capped and none lands in one task.

A pair that meets in several leaves counts in the one with the smallest number only. A leaf never emits
its pairs: it emits, for each set, the number of links counted there and the smallest member of its local
component; components of all leaves are then merged by star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import map_arrow, remove, written
from attestry.llm.wordhash import mix, spans, windows, word_hashes

PLACES = 64
_ODD = np.random.default_rng(11).integers(1, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(12).integers(1, 2**63, PLACES, np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word sequences; of all words if there are fewer; none without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    h = word_hashes(raw, *spans(raw))
    return np.unique(windows(h, min(n, len(h)))) if len(h) else h


def sketch(sh: np.ndarray) -> np.ndarray:
    out = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(sh), 4096):
        part = (sh[low : low + 4096, None] * _ODD[None, :]) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def runs_for(threshold: float, recall: float, depth: int) -> int:
    """Runs so that a pair just at the threshold shares a node of the last level with probability recall."""
    alive = 1.0
    for _ in range(depth):  # children shared by the pair: Poisson with mean 1 at the threshold
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _children(nodes: np.ndarray, sk: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for every sampled place: which places a node samples depends on the node alone."""
    limit = np.uint64(int(2**64 / (threshold * PLACES)))
    draw = mix(nodes[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ _SALT[None, :])
    row, place = np.nonzero(draw < limit)
    child = mix(draw[row, place] ^ (sk[row, place].astype(np.uint64) << np.uint64(20)) ^ nodes[row])
    return row, child


def _descend(rows: DataFrame, threshold: float, runs: int | None = None) -> DataFrame:
    """(node, k) of the children of rows (k, sk) at the roots of runs, or of rows (k, sk, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sk = np.frombuffer(b"".join(b.column("sk").to_pylist()), np.uint32).reshape(-1, PLACES)
            keys = b.column("k")
            parts = [np.full(len(sk), r, np.uint64) for r in range(1, runs + 1)] if runs else [np.asarray(b.column("node")).view(np.uint64)]
            for nodes in parts:
                row, child = _children(nodes, sk, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), keys.take(pa.array(row))], names=["node", "k"])

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("k", rows.schema["k"].dataType)])
    return rows.mapInArrow(run, schema)


def _linked(sets: list[np.ndarray], share: Fraction) -> np.ndarray:
    """Matrix of pairs with Jaccard similarity of at least share, in integers: I / (a + b - I) >= p / q."""
    m = len(sets)
    p, q = share.numerator, share.denominator
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        inter = np.zeros((2, 2), np.int64)
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        flat, own = np.concatenate(sets), np.repeat(np.arange(m), size)
        _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n[at] > 1
        own, at = own[shared], (np.cumsum(n > 1) - 1)[at[shared]]
        inter = np.zeros((m, m), np.float32)
        n_shared = int((n > 1).sum())
        step = max(1, min(n_shared, max(256, (16 << 20) // m)))  # a slice of the n-grams at a time
        order = np.argsort(at, kind="stable")
        own, at = own[order], at[order]
        for low in range(0, n_shared, step):
            a, b = np.searchsorted(at, [low, low + step])
            x = np.zeros((m, step), np.float32)
            x[own[a:b], at[a:b] - low] = 1
            inter += x @ x.T
        inter = np.rint(inter).astype(np.int64)
    linked = (p + q) * inter >= p * (size[:, None] + size[None, :])
    linked &= (size[:, None] > 0) & (size[None, :] > 0)
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(keys: list, leaves: list, texts: list, blocks: list, node: int, n: int, share: Fraction) -> list[tuple]:
    """(key, smallest key of its local component, links counted here) of one leaf or pair of blocks."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, leaves, blocks = [keys[i] for i in order], [leaves[i] for i in order], [blocks[i] for i in order]
    linked = _linked([shingles(texts[i], n) for i in order], share)
    k = np.array(keys)
    linked &= k[:, None] != k[None, :]
    if len(set(blocks)) > 1:  # pairs inside one block are compared in a cell of their own
        b = np.array(blocks)
        linked &= b[:, None] != b[None, :]
    if not linked.any():
        return []
    fresh = linked.copy()
    earlier: dict[int, list[int]] = {}
    for i, own in enumerate(leaves):
        for x in own:
            if x < node:
                earlier.setdefault(x, []).append(i)
    for rows in earlier.values():
        if len(rows) > 1:
            fresh[np.ix_(rows, rows)] = False
    root, count = _roots(linked), fresh.sum(axis=1)
    return [(keys[i], keys[root[i]], int(count[i])) for i in np.flatnonzero(linked.any(axis=1))]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, root) for every node of edges (u, v): root is the smallest node of its component.

    Alternating large and small stars; tables are written after each round, and only counts reach the driver.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    before, old = None, e
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if old is not None:
            remove(old)
        old = e
        if now == before:
            return e.select("u", F.col("v").alias("root"))
        before = now


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: str = "0.8", recall: float = 0.999,
    bucket: int = 1024, depth: int = 3, runs: int | None = None,
) -> DataFrame:
    """One row for each document: key, class_id (smallest key of its near-duplicate class), n_links, n_copies.

    Two different texts are linked if their sets of n-word sequences have a Jaccard similarity of threshold
    or more; a class is what links and equality of texts connect. n_links counts the different texts linked
    to a document's text, n_copies the documents with the same text. A text of fewer than n words is one sequence;
    a null or wordless text is never linked, and null and empty texts are copies of each other. Repeated
    rows are copies. Rows with a null key come back with a null class, no links and no copies. Keys are integers.
    """
    spark, share = docs.sparkSession, Fraction(threshold)
    runs = runs or runs_for(float(share), recall, depth)
    d = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    named = d.where("k is not null")
    equal = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")]

    def make():
        return lambda batch: [pa.array([sketch(s).tobytes() if len(s := shingles(t, n)) else None for t in batch.column(0).to_pylist()], pa.binary())]

    sketched = map_arrow(named.select("k", "t", *equal), [F.col("t")], make, T.StructType([T.StructField("sk", T.BinaryType())]), [F.col("k"), F.col("h1"), F.col("h2")])
    texts = written(sketched.groupBy("h1", "h2").agg(F.min(F.struct("k", "sk")).alias("first"), F.count("*").alias("n_copies")).select("h1", "h2", "first.*", "n_copies"), "jaccard-texts")
    sets = texts.where("sk is not null").select("k", "sk")

    # nodes, level by level: small ones are leaves, large ones are split
    found = []
    rows = written(_descend(sets, float(share), runs), "jaccard-nodes")
    for level in range(1, depth + 1):
        sizes = written(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.bit_xor(F.xxhash64("k")).alias("x")).where("n > 1"), "jaccard-sizes")
        large = sizes.where(F.col("n") > bucket).select("node", "n")
        last = level == depth or large.isEmpty()
        # leaves with the same members are one
        leaves = sizes.where(F.lit(last) | (F.col("n") <= bucket)).groupBy("n", "low", "x").agg(F.min("node").alias("node")).select("node", "n")
        found.append(rows.join(leaves, "node"))
        if last:
            break
        deeper = rows.join(large.select("node"), "node").join(sets, "k").select("k", "sk", "node")
        rows = written(_descend(deeper, float(share)), "jaccard-nodes")
    members = found[0]
    for f in found[1:]:
        members = members.unionAll(f)
    members = written(members.select("k", "node", "n").distinct(), "jaccard-members")

    # cells: a leaf, or each pair of blocks of a leaf that stayed large
    nb = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(bucket)).cast("int"))
    own = F.when(nb == 1, 0).otherwise(F.pmod(F.xxhash64("k"), nb)).cast("int")
    cells = members.select("k", "node", own.alias("b"), nb.alias("nb"))
    cells = cells.select("k", "node", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    cells = cells.select("k", "node", "b", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"))
    lists = members.groupBy("k").agg(F.collect_set("node").alias("leaves"))
    chosen = lists.join(texts.select("k", "h1", "h2"), "k")
    held = named.select("k", "t", *equal).join(chosen, ["k", "h1", "h2"]).select("k", "t", "leaves").dropDuplicates(["k"])
    full = cells.join(held, "k").repartition("node", "b1", "b2").sortWithinPartitions("node", "b1", "b2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows_, out = None, [], []

        def close():
            if len(rows_) > 1:
                ks, bs, ls, ts = zip(*rows_)
                out.extend(_compare(ks, ls, ts, bs, cell[0], n, share))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("node", "b1", "b2", "k", "b", "leaves", "t")]
            for node, b1, b2, *rest in zip(*cols):
                if (node, b1, b2) != cell:
                    close()
                    cell, rows_ = (node, b1, b2), []
                rows_.append(rest)
            if len(out) > 4096:
                yield table(out)
                out.clear()
        close()
        yield table(out)

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("root", T.LongType()), T.StructField("links", T.LongType())])

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=schema.names)

    local = written(full.mapInArrow(compare, schema), "jaccard-local")
    links = local.groupBy("k").agg(F.sum("links").alias("n_links"))
    roots = components(local.select(F.col("k").alias("u"), F.col("root").alias("v")), "jaccard-components")
    classed = texts.select("h1", "h2", "k", "n_copies").join(links, "k", "left").join(roots.withColumnRenamed("u", "k"), "k", "left")
    classed = classed.select("h1", "h2", "n_copies", F.coalesce("root", "k").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = named.select("k", *equal).join(classed, ["h1", "h2"]).select(F.col("k"), "class_id", "n_links", "n_copies")
    lost = d.where("k is null").select("k", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return out.unionAll(lost).withColumnRenamed("k", key)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are the smallest key of their class, and those with a null key; columns unchanged.

    Null and empty texts are copies of each other; texts without words but not empty stay unless they are copies. Rows that
    repeat a kept row stay with it, as they share its key; an empty table gives an empty table.
    """
    found = near_duplicates(docs, key, text, **options)
    drop = found.where(F.col(f"`{key}`") != F.col("class_id")).select(F.col(f"`{key}`").alias("__drop"))
    return docs.join(drop, F.col(f"`{key}`") == F.col("__drop"), "left_anti")
