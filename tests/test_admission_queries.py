"""The admission queries on the given events, whose times have no zone, against a port over plain rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb

from attestry.plans import registry
from attestry.streaming.monitor import decide
from tests.compare import SF
from tests.test_guard import port

START = datetime(1970, 1, 1)


def busy():
    rows = duckdb.sql(f"SELECT user_id % 40, event_id, epoch_us(ts) // 200 FROM '{SF}/events.parquet'").fetchall()
    return [(str(c), i, START + timedelta(microseconds=us)) for c, i, us in rows]


def test_admit(spark):
    want, times = {}, {}
    for c, i, ts in sorted(busy(), key=lambda r: (r[0], r[2], r[1])):
        ok, retry, times[c] = decide(times.get(c, []), (ts - START).total_seconds(), 600, 8)
        want[i] = (ok, retry)
    got = registry.QUERIES["st2_admit"](spark, SF).collect()
    assert {r.event_id: (r.admitted, r.retry_after_s) for r in got} == want and len(got) == len(want)


def test_guard(spark):
    rows = []
    for c, i, ts in busy():
        pool = str(int(c) % 5)
        rows.append((pool, c, i, 2 * i, "start", ts))
        if i % 11:
            rows.append((pool, c, i, 2 * i + 1, "end", ts + timedelta(seconds=5 * (i % 13))))
    want = port(sorted(rows, key=lambda e: (e[5], e[3])))
    got = registry.QUERIES["st2_guard"](spark, SF).collect()
    assert sorted(((r.pool, r.event_id, r.admitted, r.code, r.retry_after_s) for r in got), key=repr) == sorted(((w[0], w[2], *w[4:]) for w in want), key=repr)
