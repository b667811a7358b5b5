"""The guard of pools: literal steps, a port over random events, and the stream against the table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from attestry.streaming.guard import STATE_STORE, guard

SCHEMA = "pool string, client string, run_id long, event_id long, kind string, ts timestamp"
T0 = datetime(2026, 1, 1)


def events(n: int, seed: int):
    r = random.Random(seed)
    out, at = [], 0.0
    for i in range(n):
        at += r.choice((0, 1, 3, 20))
        pool, client = r.choice("ab"), r.choice("uvw")
        out.append((pool, client, i, 2 * i, "start", T0 + timedelta(seconds=at)))
        if r.random() < 0.9:
            out.append((pool, client, i, 2 * i + 1, "end", T0 + timedelta(seconds=at + r.choice((1, 5, 40)))))
    return sorted(out, key=lambda e: (e[5], e[3]))


def port(rows, window=600, most=8, running=2):
    times, active, out = {}, {}, []
    for pool, client, run, event_id, kind, ts in rows:
        on = active.setdefault(pool, set())
        if kind == "end":
            on.discard(run)
            continue
        kept = [t for t in times.get((pool, client), []) if t > ts - timedelta(seconds=window)]
        if len(kept) >= most:
            wait = (kept[0] + timedelta(seconds=window) - ts).total_seconds()
            out.append((pool, client, event_id, ts, False, "rate_limited", max(1, int(-(-wait // 1)))))
        elif len(on) >= running:
            out.append((pool, client, event_id, ts, False, "server_busy", 1))
        else:
            kept.append(ts)
            on.add(run)
            out.append((pool, client, event_id, ts, True, None, 0))
        times[pool, client] = kept
    return sorted(out, key=repr)


def test_table_by_port(spark):
    rows = events(600, 3)
    want = port(rows)
    assert {r[5] for r in want} == {None, "rate_limited", "server_busy"}
    d = spark.createDataFrame([*rows, ("a", "u", 1, 1, "other", T0), ("a", "u", 1, 1, "start", None)], SCHEMA)
    assert sorted(map(tuple, guard(d.repartition(4)).collect()), key=repr) == want
    assert guard(d.limit(0)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    rows = events(160, 5)
    want = sorted(map(tuple, guard(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert {r[5] for r in want} == {None, "rate_limited", "server_busy"}
    for i, (a, b) in enumerate(((0, 60), (60, 150), (150, len(rows)))):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        d = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
        q = guard(d).writeStream.outputMode("append").format("memory").queryName("guarded").option("checkpointLocation", f"{tmp_path}/at").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    assert sorted(map(tuple, spark.table("guarded").collect()), key=repr) == want
