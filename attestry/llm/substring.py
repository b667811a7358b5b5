"""Removal of repeated word sequences (operator 9), anchored on fixed blocks.

Every block words a document has a reference block; a repeat of window words (at least 2 * block - 1) always
holds a whole reference block of its earlier place. Every rolling block of every document probes the
index of reference blocks, through packed fingerprints (see blocks), which only find candidates. A hit is extended
to all windows of the full length around it; windows are equal if the BLAKE2 digests of their words are (over 100
bits), and all but the first of equal windows are repeats; windows that follow one another join to maximal
spans. No pair of documents is ever formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import blocks
from attestry.llm.common import bits_for, map_arrow, remove, text_bytes, written
from attestry.llm.wordhash import digest, spans, windows, word_hashes


def repeated_windows(docs: DataFrame, whole: DataFrame, window: int, block: int, per_chunk: int, per_bucket: int) -> DataFrame:
    """(k, th, at): runs of starts of windows that also start earlier. docs: k (not null), th, t; whole: copies of smaller keys."""
    n_words = max(1, text_bytes(docs, "t") // 6)

    def probes(t: str | None):
        raw = (t or "").encode("utf-8", "surrogatepass")
        s, e = spans(raw)
        if len(s) < window:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        h = windows(word_hashes(raw, s, e), block)
        at = np.arange(len(h))
        return len(s), at, h, at % block == 0

    def shared(chunk: blocks.Chunk):
        if not chunk.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), [], np.zeros(0, np.int64), None
        at, h, reference, _ = chunk.columns()
        values, first, group, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        indexed = np.zeros(len(values), bool)
        np.logical_or.at(indexed, group[reference], True)
        order = np.sort(first)  # by position
        low = (h[order] << np.uint64(20) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
        return at[order], h[order], [low | indexed[group[order]].astype(np.uint32)], at[n[group] > 1], None

    def hit(arrays, own):
        value = arrays[0] >> np.uint32(1)
        _, group, n = np.unique(value, return_inverse=True, return_counts=True)
        indexed = np.bincount(group, arrays[0] & np.uint32(1)) > 0
        return ((n > 1)[group] & indexed[group]).astype(np.uint8)

    packed = blocks.packed(docs.select("k", "th", "t"), probes, shared, bits_for(n_words, per_bucket, 5, 20), per_chunk)
    hits_table = written(blocks.answered(packed, hit, [np.uint32]).select("k", "th", "at"), "substring-hits")
    hits = hits_table.join(whole, ["k", "th"], "left_anti")  # copies are settled

    near = window - block

    def candidates(t: str | None, at: bytes):
        raw = (t or "").encode("utf-8", "surrogatepass")
        s, e = spans(raw)
        m = len(s) - window + 1
        if m <= 0:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        starts = np.flatnonzero(blocks.mask(blocks.spread(at), m, before=near))
        joined = b" ".join(raw.split())
        size = e - s + 1
        ends = np.cumsum(size) - 1
        first, last = (ends - size + 1)[starts].tolist(), ends[starts + window - 1].tolist()
        both = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(first, last)]), np.uint64).reshape(-1, 2)
        return len(s), starts, both[:, 0], both[:, 1]

    def earliest(chunk: blocks.Chunk):
        if not chunk.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), [], np.zeros(0, np.int64), None
        at, one, two, key = chunk.columns()
        first = np.array(chunk.firsts)
        place = at - first[np.searchsorted(first, at, side="right") - 1]
        later = _later([one, two], key, place)
        # of equal windows with the same key and place (a row given twice) one entry is enough, but both need the answer
        keep = np.flatnonzero(~later)
        keep = keep[np.argsort(at[keep], kind="stable")]
        rest = (two[keep] << np.uint64(20) >> np.uint64(32)).astype(np.uint32)  # beside the bucket's bits: over 100 bits in all
        return at[keep], two[keep], [one[keep], rest, key[keep], place[keep].astype(np.uint32)], at[later], None

    def after(arrays, own):
        one, two, key, place = arrays
        return _later([one, two], key, place).astype(np.uint8)

    found = docs.select("k", "th", "t").join(hits, ["k", "th"]).select("k", "th", "t", "at")
    bits = bits_for(n_words // 4, per_bucket, 5, 20)
    again = blocks.packed(found, candidates, earliest, bits, per_chunk)
    out = written(blocks.answered(again, after, [np.uint64, np.uint32, np.int64, np.uint32]).select("k", "th", "at"), "substring-repeats")
    remove(hits_table)
    return out


def _later(values: list[np.ndarray], key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True for entries whose values occur with a smaller (key, place)."""
    order = np.lexsort((place, key, *values))
    new = np.ones(len(order), bool)
    for v in values:
        x = v[order]
        new[1:] &= x[1:] == x[:-1]
    new[0:1] = False  # new is now: same values as the one before
    group = np.cumsum(~new)
    start = np.flatnonzero(~new)
    low_key, low_place = key[order][start][group - 1], place[order][start][group - 1]
    out = np.zeros(len(order), bool)
    out[order] = (key[order] != low_key) | (place[order] != low_place)
    return out


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, joined: bool = False,
    columns: list[str] | None = None, per_chunk: int = 2_000_000, per_bucket: int = 1_000_000,
) -> DataFrame:
    """docs with n_words, n_removed (long), spans (array of word ranges removed) and kept (string).

    A word is removed if a window of `window` consecutive words around it also starts earlier: in a document with a
    smaller key, or before in the same document. Windows are judged on the input. kept is the text
    without those words: unchanged if nothing is removed, otherwise cut at word borders; with joined, the
    kept words with single spaces in any case. Null and empty texts have no words and an empty kept text;
    texts under `window` words lose nothing. Rows with a null key neither lose words nor count as earlier. Rows that
    repeat another row whole are the same document. Keys are integers; columns (all by default) are kept.
    """
    block = (window + 1) // 2
    columns = docs.columns if columns is None else columns
    others = [c for c in columns if c not in (key, text)]
    extra = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(others)]
    d = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"), F.col(f"`{text}`").alias("t"), *extra)
    known = d.where("k is not null")
    whole = blocks.copies(known.select("k", "th", "t"), "substring-copies")
    starts = repeated_windows(known.select("k", "th", "t"), whole, window, block, per_chunk, per_bucket)
    starts = starts.unionAll(whole.select("k", "th", F.lit(blocks.ALL).alias("at")))
    have = known.join(starts, ["k", "th"], "left").unionByName(d.where("k is null").withColumn("at", F.lit(None).cast("binary")))
    names = {key: F.col("k").cast(docs.schema[key].dataType), text: F.col("t")} | {c: F.col(f"x{i}") for i, c in enumerate(others)}

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            n_words, n_removed, ranges, kept = [], [], [], []
            for t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if not at or len(raw) < 2 * window - 1 or len(spans(raw)[0]) < window:
                    words = raw.split()
                    n_words.append(len(words))
                    n_removed.append(0)
                    ranges.append([])
                    kept.append(b" ".join(words).decode("utf-8", "replace") if joined else t or "")
                    continue
                s, e = spans(raw)
                gone = blocks.mask(np.minimum(blocks.spread(at), len(s) - window + 1), len(s), after=window - 1)
                cut = blocks.spread(blocks.runs(np.flatnonzero(gone)))
                n_words.append(len(s))
                n_removed.append(int(gone.sum()))
                ranges.append([{"start": int(a), "end": int(b)} for a, b in cut])
                if joined:
                    kept.append(b" ".join([raw[a:b] for a, b in zip(s[~gone], e[~gone])]).decode("utf-8", "replace"))
                else:
                    edges = [0, *(x for a, b in cut for x in (int(s[a]), int(s[b]) if b < len(s) else len(raw))), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "replace"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(ranges, kind), pa.array(kept, pa.string())]

        return run

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(pair)), T.StructField("kept", T.StringType())])
    return map_arrow(have, [F.col("t"), F.col("at")], make, out, [names[c] for c in columns]).toDF(*columns, *out.names)
