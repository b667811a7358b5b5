"""Exact duplicates against immutable snapshots (operator 11).

A snapshot holds one entry for each distinct text of rows that will not change: its SHA-256, the largest key,
the number of rows and the text, in a table bucketed by digest, and beside it one static binary-fuse filter
for each range of digests. The digests of an incoming batch are screened by the filters alone: what a filter
refuses is new; only what passes is joined with the exact buckets, where the texts are compared byte for byte.
Copies within the batch are grouped apart, before anything is screened. Batch and snapshot have the same
buckets, so their texts are shuffled once, when they are written, and never for a join.

Fuse filters take three places of a table of bytes, in three neighbouring segments, whose XOR is the key's
fingerprint: 9 bits a key, one false positive in 256, none missed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import FILE_CLEANUP, scratch, written

#: Digests that a filter, or a screening task, holds at most on average.
PER_FILTER = 100_000
CLASH = "two texts with one SHA-256"
FILTERS = "bucket string, seed long, segment long, segments long, places binary"


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three places of each key and its fingerprint."""
    u = np.uint64
    h = keys ^ u((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> u(shift))) * u(factor)
    h ^= h >> u(31)
    first = ((h >> u(32)) * u(segment * segments)) >> u(32)
    low = u(segment - 1)
    at = np.stack([first, (first + u(segment)) ^ ((h >> u(18)) & low), (first + u(2 * segment)) ^ (h & low)])
    return at.astype(np.int64), ((h ^ (h >> u(29))) & u(255)).astype(np.uint8)


def fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, places) of a filter that holds all keys (uint64, at least one)."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, min(18, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    size = segment * (segments + 2)
    for seed in range(1, 1000):
        at, prints = _places(keys, seed, segment, segments)
        # a place that one key alone uses is set last; taking such keys away leaves others alone in turn
        uses = np.bincount(at.ravel(), minlength=size)
        sums = sum(np.bincount(a, weights=np.arange(n), minlength=size) for a in at)
        rounds, left = [], n
        alone = np.flatnonzero(uses == 1)
        while len(alone):
            key, pick = np.unique(sums[alone].astype(np.int64), return_index=True)
            rounds.append((key, alone[pick]))
            left -= len(key)
            touched = at[:, key].ravel()
            np.subtract.at(uses, touched, 1)
            np.subtract.at(sums, touched, np.tile(key, 3))
            touched = np.unique(touched)
            alone = touched[uses[touched] == 1]
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for key, own in reversed(rounds):
            a = at[:, key]
            table[own] = prints[key] ^ table[a[0]] ^ table[a[1]] ^ table[a[2]]  # its own place is still 0
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed gives a filter")


def holds(keys: np.ndarray, seed: int, segment: int, segments: int, places: bytes) -> np.ndarray:
    """Whether the filter may hold each key; always true for those that it was made of."""
    at, prints = _places(keys, seed, segment, segments)
    table = np.frombuffer(places, np.uint8)
    return table[at[0]] ^ table[at[1]] ^ table[at[2]] == prints


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """64 bits of each digest, from behind those that choose its range."""
    flat = digests.combine_chunks().cast(pa.binary(32))
    raw = np.frombuffer(flat.buffers()[1], np.uint8, len(flat) * 32, flat.offset * 32)
    return raw.reshape(-1, 32)[:, 16:24].copy().view(np.uint64).ravel()


@dataclass(frozen=True)
class Snapshot:
    """entries (digest, keep, n, t), bucketed by digest; filters by the first hex digits of the digest."""

    entries: DataFrame
    filters: DataFrame
    digits: int
    rows: int


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder, in as many buckets of its digest as the session has shuffle partitions."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.format("parquet").option("path", path).bucketBy(n, "digest").saveAsTable(table)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: the files are not the catalog's
    return out


def grouped(rows: DataFrame) -> DataFrame:
    """One entry for each distinct text of rows (k, t, digest): copies are combined before the shuffle, and all texts
    under a digest are compared byte for byte (two that differ would stop the job, never be taken for one)."""
    texts = F.col("ts")
    one = F.when(F.size(texts) == 1, texts[0]).otherwise(F.raise_error(F.lit(CLASH)))
    got = rows.groupBy("digest").agg(F.max("k").alias("keep"), F.count(F.lit(1)).alias("n"), F.collect_set("t").alias("ts"))
    return got.select("digest", "keep", "n", one.alias("t"))


def with_digest(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(k, t, digest, ...): null texts are empty ones."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{key}`").alias("k"), t.alias("t"), F.unhex(F.sha2(t, 256)).alias("digest"), *more)


def snapshot(rows: DataFrame, per_filter: int = PER_FILTER) -> Snapshot:
    """Write the entries of rows (k, t, digest) and a filter for each range of their digests."""
    entries = _bucketed(grouped(rows), "exact-entries")
    n = entries.count()
    digits = max(1, math.ceil(math.log(max(1, n) / per_filter, 16)))

    def make(table: pa.Table) -> pa.Table:
        seed, segment, segments, places = fuse(_keys(table.column("digest")))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": [bucket], "seed": [seed], "segment": [segment], "segments": [segments], "places": pa.array([places], pa.binary())})

    filters = entries.select(_range(digits), "digest").groupBy("bucket").applyInArrow(make, FILTERS)
    return Snapshot(entries, written(filters, "exact-filters"), digits, n)


def _range(digits: int) -> Column:
    return F.substring(F.hex("digest"), 1, digits).alias("bucket")


def screen(digests: DataFrame, s: Snapshot, per_task: int = PER_FILTER) -> DataFrame:
    """The distinct digests that the snapshot's filters let pass. A task holds one filter and its share of the digests:
    where a batch is large beside the snapshot, filters are given to several tasks."""
    salts = max(1, math.ceil(digests.count() / 16**s.digits / per_task))
    salt = F.pmod(F.xxhash64("digest"), F.lit(salts)).alias("salt")

    def probe(key, incoming: pa.Table, own: pa.Table) -> pa.Table:
        got = incoming.select(["digest"])
        if not own.num_rows or not incoming.num_rows:
            return got.slice(0, 0)
        f = own.slice(0, 1).to_pylist()[0]
        return got.filter(pa.array(holds(_keys(got.column("digest")), f["seed"], f["segment"], f["segments"], f["places"])))

    left = digests.select(_range(s.digits), salt, "digest").groupBy("bucket", "salt")
    right = s.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))).groupBy("bucket", "salt")
    return left.cogroup(right).applyInArrow(probe, "digest binary")


def deduplicate(df: DataFrame, old: Column, key: str = "doc_id", text: str = "text", columns: list[str] | None = None, per_filter: int = PER_FILTER) -> DataFrame:
    """Columns of df (or those named) with keep_id, group_size, kept and text_sha256, a row for each row.

    Rows where old holds (a null counts as not) make the snapshot, the others the batch that comes in. Of equal
    texts the row with the largest key stays; rows that repeat that key stay with it. A null text is an empty
    text. A null key is smaller than any other; where a whole group has null keys, keep_id is null and all
    stay. Very long texts are one row each. An empty table, snapshot or batch passes as one. Columns of df whose
    names clash with a result's are kept beside it, by place.

    The answers go back to the rows by digest, as narrow rows; Spark's skew join splits a digest that many have.
    """
    is_old = F.coalesce(old, F.lit(False))
    rows = with_digest(df, key, text, is_old.alias("old"))
    s = snapshot(rows.where("old"), per_filter)
    batch = _bucketed(grouped(rows.where("NOT old")), "exact-batch")
    passed = written(screen(batch.select("digest"), s, per_filter), "exact-passed")
    e, b = s.entries, batch
    found = passed.join(b, "digest").join(e.select("digest", *[F.col(c).alias(f"e_{c}") for c in ("keep", "n", "t")]), "digest")
    # compared in the projection: as a join key the texts would be shuffled again
    n = F.when(F.col("t") == F.col("e_t"), F.col("n") + F.col("e_n")).otherwise(F.raise_error(F.lit(CLASH)).cast("long"))
    both = written(found.select("digest", F.greatest("keep", "e_keep").alias("keep"), n.alias("n")), "exact-both")
    # single texts need no answer: their rows stay as they are
    apart = [x.select("digest", "keep", "n").where("n > 1").join(both, "digest", "left_anti") for x in (e, b)]
    groups = both.unionByName(apart[0]).unionByName(apart[1])

    carried = df.columns if columns is None else columns
    own = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{key}`").alias("k"),
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("digest"),
    )
    got = own.join(groups, "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("k")).otherwise(F.col("keep"))
    got = got.select(
        *[f"c{i}" for i in range(len(carried))], keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("k").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return got.toDF(*carried, "keep_id", "group_size", "kept", "text_sha256")
