"""Removal of repeated byte strings with a sampled, range-partitioned suffix sort (operator 5).

Suffixes are taken at anchors: starts of words, and any byte that has no word start among itself and the
half - 1 bytes before it, where half is half the length. Each string of `length` bytes belongs to the first anchor that
it alone determines: a word start in its bytes 1 to half, else the byte at half. So equal strings have the
same anchor, and one suffix record (the bytes before and after an anchor, its body) stands for all strings of the
anchor. Exact copies of documents are settled before, by their smallest key.

1. Packed fingerprints of the half bytes after each anchor, the lead (see blocks), tell which leads two documents share.
2. Of those, bodies that repeat whole are settled by a hash of about 130 bits: all but the smallest key's are
   repeats. What is left of a lead with a single body has no equal; the rest are edges of repeats.
3. Only edges are sorted: sampled splitters range-partition their suffixes by their leads, a partition sorts its strings
   by a multikey quicksort (eight bytes are one key character) and compares neighbours byte for byte. Splitters
   are leads, so a lead lies in one partition and no group spans a boundary.

A hot lead (one that drawn documents show in more than `hot` records) would fill its partition. It is settled in step 2 by
the hash of its bodies instead of its own. Its strings are combined in step 3 by map task, in which all but the
smallest key of a string are decided, and go to partitions of their own by the hash of the whole string, so
a hot string has one entry a task; they are compared in a pass that carries one string and its least key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import blocks
from attestry.llm.common import bits_for, map_arrow, remove, text_bytes, written
from attestry.llm.wordhash import BARE, characters, mix

_BASE = 0xD1342543DE82EF95
_ODD = np.random.default_rng(303).integers(1, 2**63, (2, 64), np.uint64) * np.uint64(2) + np.uint64(1)


def lanes(raw: bytes) -> np.ndarray:
    """The 8 bytes from every place of a text, scrambled."""
    return mix(characters(raw) ^ np.uint64(_BASE))


def anchors(raw: bytes, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors, and how many of the strings that begin before each belong to it (they begin 1 to that many bytes before)."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    word = BARE[b]
    starts = np.zeros(n, bool)
    starts[1:] = word[1:] & ~word[:-1]
    last = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # last word start at or before each byte
    at = np.arange(n)
    before = np.concatenate(([-1], last[:-1]))  # last word start before each byte
    reach = np.where(starts, np.minimum(half, at - np.maximum(before, 0)), 0)
    # far from any word start: exactly the string that begins half bytes before
    alone = (at >= half) & (at - last >= half) & ~starts
    keep = starts & (reach > 0) | alone
    places = np.flatnonzero(keep)
    return places, np.where(alone[places], -1, reach[places])


def leading(raw: bytes, places: np.ndarray, half: int, lane: np.ndarray | None = None) -> np.ndarray:
    """Hash of the half bytes (8 or more) from each place, which must all lie inside the text."""
    lane = lanes(raw) if lane is None else lane
    out = np.zeros(len(places), np.uint64)
    for odd, at in zip(_ODD[0], [*range(0, half - 8, 8), half - 8]):
        out += lane[places + at] * odd
    return mix(out)


def body_hashes(lane: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, half: int) -> list[np.ndarray]:
    """Two hashes of the bytes from start to end, which are length to length + half - 1: lanes from the start, then from the end."""
    sums = [np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)]
    n = length // 8
    back = -(-(length + half - 8 * n) // 8)
    for i, at in enumerate([start + 8 * j for j in range(n)] + [end - 8 * (j + 1) for j in range(back)]):
        value = lane[at]
        for out, odd in zip(sums, _ODD[:, 16 + i]):
            out += value * odd
    return [mix(x) for x in sums]


def sort_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 8-byte key characters sorted key by key: (order, group number along it), groups being equal rows.

    As in a multikey quicksort, all rows are ordered by the first character and only runs of equals go on to the
    next one; the ordering by one character is numpy's.
    """
    n, width = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    group = np.concatenate(([0], np.cumsum(np.diff(keys[order, 0]) != 0))) if n else np.zeros(0, np.int64)
    for c in range(1, width):
        size = np.bincount(group)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        own, value = group[open_], keys[order[open_], c]
        again = np.lexsort((value, own))
        order[open_] = order[open_][again]
        own, value = own[again], value[again]
        split = np.zeros(n, np.int64)
        split[open_[1:]] = (own[1:] == own[:-1]) & (value[1:] != value[:-1])
        group = group + np.cumsum(split)
    return order, group


def splitters(edges: DataFrame, half: int, parts: int, n: int) -> list[bytes]:
    """parts - 1 leads that cut the leads of n edges (k, t, at2) evenly, from about 30 hash-drawn ones a part; results do not depend on them."""
    if parts < 2:
        return []
    limit = np.uint64(min(2**64 - 1, int(2**64 * 30 * parts / max(1, n))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for t, at in zip(batch.column("t").to_pylist(), batch.column("at2").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                p, _, _ = edge_ranges(raw, blocks.spread(at), half, 2 * half)
                p = p[leading(raw, p, half) * np.uint64(_BASE) < limit]
                out.extend(raw[x : x + half] for x in p.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["lead"])

    leads = sorted({bytes(r.lead) for r in edges.mapInArrow(some, "lead binary").distinct().collect()})
    return sorted({leads[len(leads) * i // parts] for i in range(1, parts)}) if len(leads) >= parts else leads


def string_ranges(raw: bytes, hits: np.ndarray, half: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors whose leads are shared, as runs of their numbers in hits say, with low and high: their strings begin low to high bytes before them."""
    places, reach = anchors(raw, half)
    use = blocks.mask(hits, len(places))
    # a string can repeat only if all anchors in its first half do: the next one that does not bounds it
    bar = np.minimum.accumulate(np.where(use, len(raw) + length, places)[::-1])[::-1]
    p, r, bar = places[use], reach[use], bar[use]
    high, low = np.where(r < 0, half, r), np.where(r < 0, half, 1)
    low = np.maximum(np.maximum(low, p + length - len(raw)), p + half - bar + 1)
    good = low <= high
    return p[good], low[good], high[good]


def edge_ranges(raw: bytes, starts: np.ndarray, half: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the strings that begin in the runs of starts; of each anchor they are the first ones, or none."""
    p, reach = anchors(raw, half)
    high, low = np.where(reach < 0, half, reach), np.where(reach < 0, half, 1)
    c = np.concatenate(([0], np.cumsum(blocks.mask(starts, len(raw)))))
    n = c[p - low + 1] - c[p - high]
    there = n > 0
    return p[there], (high - n + 1)[there], high[there]


def hot_leads(docs: DataFrame, half: int, hot: int, texts: int = 8000) -> np.ndarray:
    """Sorted hashes of the leads of about `hot` records or more, by `texts` hash-drawn documents (one in 1,000 if that is more).

    At most 200,000, the most frequent ones; results do not depend on which they are."""
    n = docs.select("k").count()
    share = min(1.0, max(texts / max(1, n), 0.001))
    drawn = docs.where((F.xxhash64("k", F.lit(6)) % 1_000_000 + 1_000_000) % 1_000_000 < F.lit(1_000_000 * share)).select("t")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total(parts: list[np.ndarray]) -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=["h", "n"])

        parts, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) < 2 * half:
                    continue
                p = anchors(raw, half)[0]
                parts.append(leading(raw, p[p + half <= len(raw)], half))
                size += len(parts[-1])
                if size >= 2_000_000:
                    yield total(parts)
                    parts, size = [], 0
        if parts:
            yield total(parts)

    least = max(2, round(hot * share))
    rows = drawn.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(200_000).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def listed(k: np.ndarray, tag: np.ndarray, place: np.ndarray) -> list[tuple]:
    """(key, tag, runs of places) of each document."""
    order = np.lexsort((place, tag, k))
    k, tag, place = k[order], tag[order], place[order]
    cut = np.concatenate(([0], np.flatnonzero((np.diff(k) != 0) | (np.diff(tag) != 0)) + 1, [len(k)]))
    return [(k[x], tag[x], blocks.runs(place[x:y])) for x, y in zip(cut[:-1], cut[1:])] if len(k) else []


def repeated_strings(docs: DataFrame, whole: DataFrame, length: int, per_chunk: int, per_bucket: int, per_partition: int, hot: int) -> DataFrame:
    """(k, th, at): runs of starts of strings that also start in a smaller key. docs: k (not null), th, t; whole: copies of smaller keys."""
    half = length // 2
    n_bytes = max(1, text_bytes(docs, "t"))

    def prints(t: str | None):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) < length:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        places, _ = anchors(raw, half)
        places = places[places + half <= len(raw)]
        return len(places), np.arange(len(places)), leading(raw, places, half)  # anchors by number: shared ones make long runs

    def shared(chunk: blocks.Chunk):
        if not chunk.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), [], np.zeros(0, np.int64), None
        at, h, key = chunk.columns()
        order = np.argsort(h, kind="stable")
        h, at, key = h[order], at[order], key[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        other = np.maximum.reduceat(key, start) != np.minimum.reduceat(key, start)  # in two documents of this chunk
        # one entry a value and chunk, but all places of a value are answered through its document's repeats
        count = np.diff(np.append(start, len(h)))
        decided = at[other[group]]
        single = start[~other & (count == 1)]
        many = ~other & (count > 1)
        send = np.concatenate((single, start[other], np.flatnonzero(many[group])))
        send = send[np.argsort(at[send], kind="stable")]
        return at[send], h[send], [(h[send] << np.uint64(20) >> np.uint64(32)).astype(np.uint32)], decided, None

    def hit(arrays, own):
        order = np.lexsort((own, arrays[0]))
        v, c = arrays[0][order], own[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        start = np.flatnonzero(new)
        mixed = np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
        out = np.zeros(len(v), np.uint8)
        out[order] = mixed[np.cumsum(new) - 1]
        return out

    packed = blocks.packed(docs.select("k", "th", "t"), prints, shared, bits_for(n_bytes // 6, per_bucket, 5, 20), per_chunk)
    hits_table = written(blocks.answered(packed, hit, [np.uint32]).select("k", "th", "at"), "suffix-hits")
    hits = hits_table.join(whole, ["k", "th"], "left_anti")  # copies are settled
    often = hot_leads(docs, half, hot)

    def bodies(t: str | None, at: bytes):
        raw = (t or "").encode("utf-8", "surrogatepass")
        p, low, high = string_ranges(raw, blocks.spread(at), half, length)
        if not len(p):
            return 0, *(np.zeros(0, x) for x in (np.int64, np.uint64, np.uint64, np.uint64, np.int64))
        shape = mix((low << 8 | high).astype(np.uint64))
        lane = lanes(raw)
        one, two = (x ^ shape for x in body_hashes(lane, p - high, p - low + length, length, half))
        return len(raw), p - high, leading(raw, p, half, lane), one, two, high - low + 1

    def later(key: np.ndarray, *values: np.ndarray) -> np.ndarray:
        """True for entries whose values a smaller key has too."""
        order = np.lexsort((key, *values))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for v in values:
            new[1:] |= v[order][1:] != v[order][:-1]
        out = np.zeros(len(order), bool)
        out[order] = key[order] != key[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        return out

    def settled(chunk: blocks.Chunk):
        if not chunk.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, lead, one, two, size, key = chunk.columns()
        late = later(key, one, two)
        value = np.where(often[np.minimum(np.searchsorted(often, lead), len(often) - 1)] == lead, mix(one), lead) if len(often) else lead
        keep = np.flatnonzero(~late)
        keep = keep[np.argsort(at[keep], kind="stable")]
        rest = (lead[keep] << np.uint64(20) >> np.uint64(32)).astype(np.uint32)
        return at[keep], value[keep], [rest, one[keep], (two[keep] >> np.uint64(32)).astype(np.uint32), key[keep], size[keep].astype(np.uint8)], at[late], size[late]

    def judge(arrays, own):
        lead, one, two, key, _ = arrays
        out = later(key, one, two).astype(np.uint8)
        rest = np.flatnonzero(out == 0)
        order = rest[np.lexsort((one[rest], lead[rest]))]
        new = np.concatenate(([True], lead[order][1:] != lead[order][:-1]))
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        kinds = np.maximum.reduceat(one[order], start) != np.minimum.reduceat(one[order], start)
        docs_ = np.maximum.reduceat(key[order], start) != np.minimum.reduceat(key[order], start)
        out[order] = np.where((kinds & docs_)[group], 2, 0)
        return out

    def judge_hot(arrays, own):
        # bodies of a hot lead do not meet in one bucket: each may have equals among the strings of the others
        out = judge(arrays, own)
        hot_rest = ((often << np.uint64(20)) >> np.uint64(32)).astype(np.uint32)
        return np.where((out == 0) & np.isin(arrays[0], hot_rest), 2, out)

    held_ = docs.select("k", "th", "t").join(hits, ["k", "th"]).select("k", "th", "t", "at")
    packed = blocks.packed(held_, bodies, settled, bits_for(n_bytes // 20, per_bucket, 5, 20), 6 * per_chunk)
    kinds = [np.uint32, np.uint64, np.uint32, np.int64, np.uint8]
    marks = written(blocks.answered(packed, judge_hot if len(often) else judge, kinds, codes=2, sizes=4), "suffix-marks")
    remove(hits_table)

    edges = docs.select("k", "th", "t").join(marks.where("octet_length(at2) > 0").select("k", "th", "at2"), ["k", "th"])
    counted = marks.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).first()
    n_edges = counted.n or 0
    if not n_edges:
        return marks.where("octet_length(at) > 0").select("k", "th", "at")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_edges * (length + half) // per_partition))
    share = 64 if counted.docs > 100_000 else 1  # one document in so many is read for the splitters
    cuts = splitters(edges.where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(share)) == 0).select("t", "at2"), half, parts, n_edges // share)
    cut_bytes = np.array(cuts, dtype=f"S{half}")
    width = -(-length // 8)
    # parts by number: ranges of leads, then strings of hot leads by hash, then places decided by map tasks
    base = len(cuts) + 1
    schema = "part int, body binary, low short, high short, k long, tag short, place int"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record for each anchor found: the bytes of all its strings, as far as the text goes; strings one by one for hot leads."""
        held: list[tuple] = []
        n_held = 0

        def rows(part, bodies, edge: int, k, tag, place) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), bodies, pa.array(np.full(len(k), edge, np.int16)), pa.array(np.full(len(k), edge, np.int16)), pa.array(k, pa.int64()),
                 pa.array(tag.astype(np.int16)), pa.array(place.astype(np.int32))],
                names=["part", "body", "low", "high", "k", "tag", "place"])

        def combined(strings, k, tag, place) -> Iterator[pa.RecordBatch]:
            """Strings of hot leads: the smallest key's go on, the others' places are decided."""
            keys = np.zeros((len(k), width * 8), np.uint8)
            keys[:, :length] = strings
            keys = keys.view(">u8").astype(np.uint64)
            order, group = sort_groups(keys)
            start = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
            late = k[order] > np.minimum.reduceat(k[order], start)[group]
            done = listed(k[order[late]], tag[order[late]], place[order[late]])
            for a in range(0, len(done), 10_000):
                ks, ts, runs = zip(*done[a : a + 10_000])
                ks = np.array(ks, np.int64)
                yield rows((2 * base + ks % base).astype(np.int32), pa.array(runs, pa.binary()), -2, ks, np.array(ts), np.zeros(len(ks)))
            order, group = order[~late], group[~late]
            again = np.lexsort((place[order], tag[order], group))
            order, group = order[again], group[again]
            new = np.concatenate(([True], (np.diff(group) != 0) | (np.diff(tag[order]) != 0) | (np.diff(place[order]) != 0)))  # a row may be repeated
            order = order[new]
            value = np.zeros(len(order), np.uint64)
            for c in range(width):
                value = mix(value * np.uint64(_BASE) + keys[order, c])
            for a in range(0, len(order), 10_000):
                o = order[a : a + 10_000]
                offsets = np.arange(len(o) + 1, dtype=np.int32) * np.int32(length)
                bodies = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(offsets), pa.py_buffer(strings[o].tobytes())])
                yield rows((base + (value[a : a + 10_000] % np.uint64(base)).astype(np.int64)).astype(np.int32), bodies, -1, k[o], tag[o], place[o])

        for whole_ in batches:
            for a in range(0, whole_.num_rows, 128):
                batch = whole_.slice(a, 128)
                parts: list[tuple] = []
                data: list[np.ndarray] = []
                for k, th, t, at in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    p, low, high = edge_ranges(raw, blocks.spread(at), half, length)
                    if len(often) and len(p):
                        h = leading(raw, p, half)
                        is_hot = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
                        firsts, counts = (p - high)[is_hot], (high - low + 1)[is_hot]
                        firsts = np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                        for a_ in range(0, len(firsts), 200_000):
                            some = firsts[a_ : a_ + 200_000]
                            held.append((np.frombuffer(raw, np.uint8)[some[:, None] + np.arange(length)], np.full(len(some), k), np.full(len(some), th & 0x7FFF), some))
                            n_held += len(some)
                            if n_held >= 400_000:
                                yield from combined(*(np.concatenate(x) for x in zip(*held)))
                                held, n_held = [], 0
                        p, low, high = p[~is_hot], low[~is_hot], high[~is_hot]
                    if len(p):
                        size = high + length - low
                        ends = np.cumsum(size)
                        data.append(np.frombuffer(raw, np.uint8)[np.repeat(p - high - ends + size, size) + np.arange(ends[-1])])
                        lead = np.frombuffer(raw, np.uint8)[p[:, None] + np.arange(half)]
                        part = np.searchsorted(cut_bytes, lead.view(f"S{half}").ravel(), side="right")
                        parts.append((size, low, high, np.full(len(p), k), np.full(len(p), th), p, part))
                if parts:
                    size, low, high, k, th, p, part = (np.concatenate(x) for x in zip(*parts))
                    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                    body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part.astype(np.int32)), body, pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), pa.array(k.astype(np.int64)),
                         pa.array((th & 0x7FFF).astype(np.int16)), pa.array(p.astype(np.int32))],
                        names=["part", "body", "low", "high", "k", "tag", "place"])
        if held:
            yield from combined(*(np.concatenate(x) for x in zip(*held)))

    found = edges.select("k", "th", "t", "at2").mapInArrow(records, schema)
    # the part number in front: a task that gets two parts sorts one after the other
    lead = F.expr(f"case when high < 0 then body else substring(body, high + 1, {half}) end")
    order_by = ["part", lead, "k"] if len(often) else ["part", lead]
    own = F.when(F.col("part") < 2 * base, F.col("part")).otherwise(F.col("part") - base)
    placed = found.repartitionById(base * 2 if len(often) else base, own).sortWithinPartitions(*order_by)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of whole groups of one lead, which hold about `hot` rows at most; strings of hot leads as they come."""
        held: list[pa.RecordBatch] = []
        rows_, enough = 0, 60_000
        string, least = None, 0
        for whole_ in batches:
            if not whole_.num_rows:
                continue
            first, second = np.searchsorted(np.asarray(whole_.column("part")), [base, 2 * base]).tolist()
            if second < whole_.num_rows:
                done = whole_.slice(second)
                yield pa.RecordBatch.from_arrays([done.column("k"), done.column("tag").cast(pa.int64()), done.column("body")], names=["k", "tag", "at"])
            if first < second:
                batch = pa.Table.from_batches([whole_.slice(first, second - first)])
                data, offsets = content(batch)
                strings = data[offsets[:-1, None] + np.arange(length)]
                k, tag, place = (np.asarray(batch.column(c)).astype(np.int64) for c in ("k", "tag", "place"))
                new = np.concatenate(([string is None or bool((strings[0] != string).any())], (strings[1:] != strings[:-1]).any(axis=1)))
                group = np.cumsum(new)  # 0 goes on with the string before
                lows = np.concatenate(([least], k[new]))  # keys ascend in a string
                late = k > lows[group]
                string, least = strings[-1].copy(), int(lows[-1])
                yield from found_runs(listed(k[late], tag[late], place[late]))
            if not first:
                continue
            held.append(whole_.slice(0, first))
            rows_ += first
            if rows_ >= enough:
                table = pa.Table.from_batches(held).combine_chunks()
                codes = leads(table)
                keep = int(np.searchsorted(codes, codes[-1]))
                if keep:
                    yield from compare(table.slice(0, keep))
                    held = table.slice(keep).to_batches()
                    rows_ -= keep
                else:
                    held = table.to_batches()
                enough = max(60_000, 2 * rows_)
        if rows_:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    def found_runs(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["k", "tag", "at"])

    def content(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the bodies, and where each body starts."""
        body = table.column("body").combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        return np.frombuffer(body.buffers()[2], np.uint8), offsets

    def leads(table: pa.Table) -> np.ndarray:
        """Number of each record's lead along the sorted table."""
        data, offsets = content(table)
        at = offsets[:-1] + np.asarray(table.column("high"))
        lead = data[at[:, None] + np.arange(half)]
        return np.concatenate(([0], np.cumsum((lead[1:] != lead[:-1]).any(axis=1))))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = content(table)
        low, high, k, th, place = (np.asarray(table.column(c)).astype(np.int64) for c in ("low", "high", "k", "tag", "place"))
        count = high - low + 1
        # strings of records with a lead of their own have no equal: only those that share a lead in two documents
        codes = leads(table)
        lowest, highest = np.full(codes.max() + 1, np.iinfo(np.int64).max), np.full(codes.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(lowest, codes, k)
        np.maximum.at(highest, codes, k)
        use = np.flatnonzero((lowest != highest)[codes])
        edges = np.searchsorted(np.cumsum(count[use]), np.arange(400_000, int(count[use].sum()) + 400_000, 400_000), side="right") if len(use) else []
        a = 0
        lists: list[tuple] = []
        for e in [*edges, len(use)]:
            # whole groups of a lead only
            b = max(int(e), a)
            while 0 < b < len(use) and codes[use[b]] == codes[use[b - 1]]:
                b += 1
            if b <= a:
                continue
            own = np.repeat(use[a:b], count[use[a:b]])
            shift = np.arange(len(own)) - np.repeat(np.cumsum(count[use[a:b]]) - count[use[a:b]], count[use[a:b]])
            first = offsets[own] + shift
            keys = np.zeros((len(own), width), np.uint64)
            for c in range(width):
                for i in range(8):
                    keys[:, c] <<= np.uint64(8)
                    if c * 8 + i < length:
                        keys[:, c] |= data[first + c * 8 + i]
            order, group = sort_groups(keys)
            start = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
            least = np.minimum.reduceat(k[own][order], start)
            late = order[k[own][order] > least[group]]
            if len(late):
                lists.append((k[own[late]], th[own[late]], (place[own[late]] - high[own[late]] + shift[late]).astype(np.int64)))
            a = b
        if lists:
            yield from found_runs(listed(*(np.concatenate(x) for x in zip(*lists))))

    late = placed.mapInArrow(sweep, "k long, tag long, at binary")
    runs = late.groupBy("k", "tag").agg(F.array_join(F.collect_list(F.hex("at")), "").alias("at")).select("k", "tag", F.unhex("at").alias("at"))
    # the tag is the low bits of the text hash; the hash itself comes from the small table of documents with marks
    tagged = marks.select("k", "th", "at", F.col("th").bitwiseAND(F.lit(0x7FFF).cast("long")).alias("tag")).join(runs.withColumnRenamed("at", "more"), ["k", "tag"], "left")
    empty = F.lit(b"")
    out = written(tagged.select("k", "th", F.concat(F.coalesce("at", empty), F.coalesce("more", empty)).alias("at")).where("octet_length(at) > 0"), "suffix-repeats")
    remove(marks)
    return out


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, columns: list[str] | None = None,
    per_chunk: int = 1_500_000, per_bucket: int = 1_000_000, per_partition: int = 24 << 20, hot: int = 5_000,
) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long), spans (array of byte ranges removed) and kept (binary).

    A byte is removed if a string of `length` bytes around it also starts in a document with a smaller key;
    strings are judged on the input and never cross documents. Null texts are empty; texts under `length`
    bytes lose nothing. length is from 16 to 320. Rows with a null key neither lose bytes nor count as earlier; rows that share their key
    are the same document, so neither is earlier. Keys are integers; columns (all by default) are kept. Leads of
    more than about `hot` records are worked string by string; results do not depend on it.
    """
    columns = docs.columns if columns is None else columns
    others = [c for c in columns if c not in (key, text)]
    extra = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(others)]
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.xxhash64(plain).alias("th"), F.col(f"`{text}`").alias("t"), *extra)
    known = d.where("k is not null")
    # exact copies: all of a copy is a repeat of the smallest key; only that one is compared with other texts
    whole = blocks.copies(known.select("k", "th", "t"), "suffix-copies")
    starts = repeated_strings(known.select("k", "th", "t"), whole, length, per_chunk, per_bucket, per_partition, hot)
    marks = starts.unionAll(whole.select("k", "th", F.lit(blocks.ALL).alias("at")))
    have = known.join(marks, ["k", "th"], "left").unionByName(d.where("k is null").withColumn("at", F.lit(None).cast("binary")))
    names = {key: F.col("k").cast(docs.schema[key].dataType), text: F.col("t")} | {c: F.col(f"x{i}") for i, c in enumerate(others)}

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            sizes, removed, counts, ranges, kept = [], [], [], [], []
            for t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                cut = np.zeros((0, 2), np.int64)
                if at and len(raw) >= length:
                    rows = blocks.spread(at)
                    rows = np.minimum(rows, len(raw) - length + 1)
                    cut = blocks.spread(blocks.runs(np.flatnonzero(blocks.mask(rows, len(raw), after=length - 1))))
                sizes.append(len(raw))
                removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                counts.append(len(cut))
                ranges.append([{"start": int(a), "end": int(b)} for a, b in cut])
                edges = [0, *cut.ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(ranges, kind), pa.array(kept, pa.binary())]

        return run

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(pair)), T.StructField("kept", T.BinaryType()),
    ])
    return map_arrow(have, [F.col("t"), F.col("at")], make, out, [names[c] for c in columns]).toDF(*columns, *out.names)
