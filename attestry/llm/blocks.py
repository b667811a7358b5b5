"""Finding shared fingerprints across documents without pairs: chunks, hash buckets and the way back.

Each task cuts its documents into chunks. A chunk keeps one entry for each distinct fingerprint
(combining before the shuffle, so a passage that fills a third of the corpus has at most one entry a chunk)
and sends its entries, packed by hash bucket, to the bucket's task, which answers with the entries that
something elsewhere shares. A directory row of each chunk goes the same way and leads the answers back
to documents and positions. Chunks are numbered by task and order, so a task that runs again makes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import written

PACKED = "bucket long, chunk long, kind int, body binary, extra binary"
ANSWERS = "chunk long, kind int, body binary, extra binary"
ENTRIES, DIRECTORY, NARROW, FOUND = 0, 1, 2, 8


class Chunk:
    """Documents of a chunk: key, text hash, first position in the chunk, and positions already decided."""

    def __init__(self):
        self.keys: list[int] = []
        self.hashes: list[int] = []
        self.firsts: list[int] = []
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, key: int, text_hash: int, length: int, *arrays: np.ndarray) -> None:
        """arrays: positions in the document first, then what belongs to each of them."""
        self.keys.append(key)
        self.hashes.append(text_hash)
        self.firsts.append(self.size)
        if len(arrays[0]):
            self.parts.append((arrays[0] + self.size, *arrays[1:], np.full(len(arrays[0]), key, np.int64)))
        self.size += length

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts)] if self.parts else []

    def directory(self, decided: np.ndarray, sizes: np.ndarray | None) -> tuple[bytes, bytes]:
        head = np.array([self.keys, self.hashes, self.firsts], np.int64)
        return head.tobytes(), _positions(decided, sizes)


def _positions(at: np.ndarray, sizes: np.ndarray | None) -> bytes:
    """Positions, each of which stands for itself, or for as many as sizes says."""
    flat = at if sizes is None else np.repeat(at, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return runs(np.unique(flat))


def packed(docs: DataFrame, each: Callable, close: Callable, bits: int, per_chunk: int, keep_empty: bool = False) -> DataFrame:
    """Rows for the buckets. docs has k, th, t. each(t) gives (length, positions, ...) of a text;
    close(chunk) gives (positions, bucket values uint64, bodies by entry as arrays, decided positions, their sizes or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, chunk = 0, Chunk()

        def rows(chunk: Chunk, number: int):
            name = (task << 24) | number
            at, value, arrays, decided, sizes = close(chunk)
            out = []
            if len(at):
                bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, at, arrays = bucket[order], at[order], [a[order] for a in arrays]
                edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
                for a, b in zip(edges[:-1], edges[1:]):
                    gaps = np.diff(at[a:b], prepend=0)
                    narrow = gaps.max() < 1 << 16
                    body = gaps.astype(np.uint16 if narrow else np.uint32).tobytes()
                    out.append((int(bucket[a]), name, NARROW if narrow else ENTRIES, body, b"".join(x[a:b].tobytes() for x in arrays)))
            if len(at) or len(decided):
                head, done = chunk.directory(decided, sizes)
                out.append((-1 - name, name, DIRECTORY, head, done))
            for low in range(0, len(out), 512):
                part = out[low : low + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in part], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["bucket", "chunk", "kind", "body", "extra"],
                )

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for k, th, *rest in zip(*[part.column(i).to_pylist() for i in range(part.num_columns)]):
                    length, *arrays = each(*rest)
                    if length:
                        chunk.add(k, th, length, *arrays)
                    if chunk.size >= per_chunk:
                        yield from rows(chunk, number)
                        number, chunk = number + 1, Chunk()
        if chunk.size:
            yield from rows(chunk, number)

    return docs.mapInArrow(run, PACKED)


def answered(rows: DataFrame, decide: Callable, kinds: list[type], codes: int = 1, sizes: int | None = None) -> DataFrame:
    """(k, th, at, ...): runs of positions of each document, a column for each code (at, at2, ...), as uint32 bytes.

    decide(arrays) gets the entries of a bucket, one array for each of kinds and the chunk's number of each,
    and gives the code of each entry, 0 for none. What a chunk decided has code 1. With sizes, the number
    of one of the arrays, an entry stands for as many positions as that says. n counts the entries of the last code.
    """

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iloc[0] == DIRECTORY:
            return pdf[["chunk", "kind", "body", "extra"]]
        gaps = [np.frombuffer(b, np.uint16 if kind == NARROW else np.uint32) for b, kind in zip(pdf["body"], pdf["kind"])]
        counts = [len(g) for g in gaps]
        arrays: list[list] = [[] for _ in kinds]
        for extra, n in zip(pdf["extra"], counts):
            low = 0
            for i, kind in enumerate(kinds):
                arrays[i].append(np.frombuffer(extra, kind, n, low))
                low += n * np.dtype(kind).itemsize
        at = np.concatenate([np.cumsum(g, dtype=np.int64) for g in gaps])
        own = np.repeat(np.arange(len(counts)), counts)
        joined = [np.concatenate(a) for a in arrays]
        code = decide(joined, own)
        size = None if sizes is None else joined[sizes].astype(np.int64)
        out = []
        ends = np.cumsum(counts)
        for name, a, b in zip(pdf["chunk"], ends - counts, ends):
            for c in range(1, codes + 1):
                hit = a + np.flatnonzero(code[a:b] == c)
                if len(hit):
                    out.append((name, FOUND + c, _positions(at[hit], None if size is None else size[hit]), len(hit).to_bytes(8, "little")))
        return pd.DataFrame(out, columns=["chunk", "kind", "body", "extra"])

    names = ["at", *(f"at{c}" for c in range(2, codes + 1))]

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["kind"] == DIRECTORY]
        if not len(head):
            return pd.DataFrame({c: [] for c in ("k", "th", *names, "n")})
        keys, hashes, firsts = np.frombuffer(head["body"].iloc[0], np.int64).reshape(3, -1)
        by_doc: dict[int, list] = {}
        for c in range(1, codes + 1):
            mine = pdf[pdf["kind"] == FOUND + c]
            rows_ = [spread(b) for b in mine["body"]] + ([spread(head["extra"].iloc[0])] if c == 1 else [])
            found = np.concatenate(rows_) if rows_ else np.zeros((0, 2), np.int64)
            found = found[np.argsort(found[:, 0], kind="stable")]
            # runs of one task may touch those of another, and end where a document does
            doc = np.searchsorted(firsts, found[:, 0], side="right") - 1
            last = np.searchsorted(firsts, found[:, 1] - 1, side="right") - 1
            cut = np.flatnonzero(doc != last)
            if len(cut):  # a run over several documents
                more = [(max(a, firsts[d]), min(b, firsts[d + 1] if d + 1 < len(firsts) else b), d) for (a, b), x, y in zip(found[cut].tolist(), doc[cut].tolist(), last[cut].tolist()) for d in range(x, y + 1)]
                keep = doc == last
                found = np.concatenate((found[keep], np.array([m[:2] for m in more], np.int64)))
                doc = np.concatenate((doc[keep], np.array([m[2] for m in more], np.int64)))
                order = np.argsort(found[:, 0], kind="stable")
                found, doc = found[order], doc[order]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)])) if len(doc) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                d = int(doc[a])
                by_doc.setdefault(d, [b""] * codes)[c - 1] = united(found[a:b] - firsts[d])
        n = sum(int.from_bytes(x, "little") for x in pdf[pdf["kind"] == FOUND + codes]["extra"])
        out = [(keys[d], hashes[d], *cols, n if i == 0 else 0) for i, (d, cols) in enumerate(sorted(by_doc.items()))]
        return pd.DataFrame(out, columns=["k", "th", *names, "n"])

    got = rows.groupBy("bucket").applyInPandas(bucket, ANSWERS)
    return got.groupBy("chunk").applyInPandas(back, f"k long, th long, {', '.join(f'{c} binary' for c in names)}, n long")


def copies(docs: DataFrame, name: str) -> DataFrame:
    """(k, th): documents (k, th, t) whose text a smaller key has too; written, as several joins read it.

    Texts are equal if their lengths and SHA-256 are. The groups are a table of their own, so that a join with
    one large group can be split."""
    t = F.coalesce("t", F.lit(""))
    d = docs.select("k", "th", F.unhex(F.substring(F.sha2(t, 256), 1, 32)).alias("digest"))
    groups = d.groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last").select("digest", "first")
    groups = written(groups, name)
    return written(d.join(groups, "digest").where("k > first").select("k", "th").distinct(), name)


#: Runs that reach past any text: all of it.
ALL = np.array([[0, 2**31 - 1]], np.uint32).tobytes()


def runs(at: np.ndarray) -> bytes:
    """Sorted positions as runs [start, end), in bytes."""
    if not len(at):
        return b""
    cut = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1], axis=1).astype(np.uint32).tobytes()


def united(rows: np.ndarray) -> bytes:
    """Sorted runs [start, end), which may touch or overlap, as separate ones in bytes."""
    if not len(rows):
        return b""
    end = np.maximum.accumulate(rows[:, 1])
    cut = np.flatnonzero(rows[1:, 0] > end[:-1])
    return np.stack([rows[np.concatenate(([0], cut + 1)), 0], end[np.concatenate((cut, [len(rows) - 1]))]], axis=1).astype(np.uint32).tobytes()


def spread(body: bytes | None) -> np.ndarray:
    """Runs [start, end) as an array of two columns."""
    return np.frombuffer(body or b"", np.uint32).reshape(-1, 2).astype(np.int64)


def mask(rows: np.ndarray, length: int, before: int = 0, after: int = 0) -> np.ndarray:
    """True from before places before the start of each run to after places past its end."""
    change = np.zeros(length + 1, np.int32)
    if len(rows):
        np.add.at(change, np.clip(rows[:, 0] - before, 0, length), 1)
        np.add.at(change, np.clip(rows[:, 1] + after, 0, length), -1)
    return np.cumsum(change[:-1]) > 0
