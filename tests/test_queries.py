from __future__ import annotations

import pytest

from attestry.plans import registry
from tests.compare import SF, both


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert ours == theirs


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_admission_by_hand(spark):
    """Eight admitted in the window; refused requests do not count; the retry time runs from the oldest admitted one."""
    from datetime import datetime, timedelta

    from attestry.streaming.monitor import admit

    t0 = datetime(2026, 1, 1)
    rows = [("a", i, t0 + timedelta(seconds=10 * i)) for i in range(12)] + [("a", 99, t0 + timedelta(seconds=601))]
    got = {r.event_id: (r.admitted, r.retry_after_s) for r in admit(spark.createDataFrame(rows, "client string, event_id long, ts timestamp")).collect()}
    assert [got[i][0] for i in range(12)] == [True] * 8 + [False] * 4
    assert got[8] == (False, 520) and got[99][0]


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from attestry.streaming.monitor import admission_pressure, receipt_rollup

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for f in (admission_pressure, receipt_rollup):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
        batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(f.__name__).option("checkpointLocation", str(tmp_path / f.__name__)).start()
        q.processAllAvailable()
        q.stop()
        key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
        assert sorted(map(key, spark.table(f.__name__).collect())) == sorted(map(key, f(batch).collect()))


def test_admission_of_a_hot_client(spark):
    """A client's events come in many small batches; no operator of the static plan takes a client's events as one frame."""
    from datetime import datetime, timedelta

    from attestry.streaming.monitor import admit, decide

    t0, n = datetime(2026, 1, 1), 5_000
    rows = [("hot" if i % 3 else f"c{i % 7}", i, t0 + timedelta(seconds=i * 7919 % n)) for i in range(n)] + [(None, n, t0), (None, n + 1, None)]
    want, times = {}, {}
    for c, i, ts in sorted(rows[:-1], key=lambda r: (str(r[0]), r[2], r[1])):
        ok, retry, times[c] = decide(times.get(c, []), (ts - t0).total_seconds(), 600, 8)
        want[i] = (c, ts, ok, retry)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = admit(spark.createDataFrame(rows, "client string, event_id long, ts timestamp"))
        assert "FlatMapGroupsIn" not in out._jdf.queryExecution().toString()
        got = {r.event_id: (r.client, r.ts, r.admitted, r.retry_after_s) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.pop(n + 1)[:3] == (None, None, True)
    assert got == want


def _stream(spark, tmp_path, name, rows, schema, f, batches, mode="append"):
    """Rows of a streaming job over files that are read one a micro-batch."""
    src = tmp_path / f"{name}-in"
    for i, part in enumerate(batches):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.parquet(str(src / f"p{i:03d}"))
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(src))
    q = f(d).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-at")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def test_watched_stream_equals_batch(spark, tmp_path):
    """Faults, timers and late events of a stream are those of the static table."""
    from datetime import datetime, timedelta

    from attestry.streaming.monitor import watch_runs

    t0 = datetime(2026, 1, 1)
    steps = {
        "fine": [("accepted", 0), ("building", 10), ("completed", 100)], "odd": [("building", 0), ("what", 5), ("failed", 9), ("failed", 10), ("building", 11)],
        "slow": [("accepted", 0), ("completed", 151)], "edge": [("accepted", 0), ("completed", 150)], "lost": [("accepted", 3)], "late": [("accepted", 0), ("building", 400), ("completed", 401)],
    }
    rows = [(k, i * 100 + j, s, float(at) if (k, j) != ("fine", 1) else None, t0 + timedelta(seconds=at)) for i, (k, v) in enumerate(steps.items()) for j, (s, at) in enumerate(v)]
    rows.sort(key=lambda r: r[4])
    rows += [("zend", 9_000, "accepted", 1.0, t0 + timedelta(days=1)), ("zend", 9_001, "completed", 1.0, t0 + timedelta(days=1, seconds=1))]
    schema = "execution_id string, event_id long, state string, elapsed_ms double, ts timestamp"
    batch = sorted(map(tuple, watch_runs(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert {r[0] for r in batch if r[2] == "timeout"} == {"slow", "lost", "late"} and ("late", 502, "late_event") in batch
    n = len(rows)
    parts = [range(0, 4), range(4, n - 2), range(n - 2, n - 1), range(n - 1, n)]
    assert _stream(spark, tmp_path, "watched", rows, schema, watch_runs, parts) == batch


def test_admission_and_terminal_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    from attestry.streaming.monitor import admit, dedupe_terminals

    t0 = datetime(2026, 1, 1)
    rows = [("a" if i % 4 else "b", i, t0 + timedelta(seconds=20 * i)) for i in range(40)]
    schema = "client string, event_id long, ts timestamp"
    batch = sorted(map(tuple, admit(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert {r[3] for r in batch} == {True, False}
    assert _stream(spark, tmp_path, "admitted", rows, schema, admit, [range(0, 7), range(7, 30), range(30, 40)]) == batch
    ends = [(f"r{i % 5}", "completed" if i % 3 else "building", t0 + timedelta(seconds=i)) for i in range(30)]
    schema = "execution_id string, state string, ts timestamp"
    got = _stream(spark, tmp_path, "ended", ends, schema, lambda d: dedupe_terminals(d).select("execution_id"), [range(0, 15), range(15, 30)])
    assert got == sorted(map(tuple, dedupe_terminals(spark.createDataFrame(ends, schema)).select("execution_id").collect()), key=repr)
