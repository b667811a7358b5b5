"""Admission by a guard: so many admissions a client in a window, and so many runs at once in a pool.

A pool is what shares a guard (a server, a region). Its state is the admitted times inside the window and the runs that have not
ended. A stream keeps it with transformWithStateInPandas, as lists, and an event-time timer drops what has left the
window; it needs the RocksDB state store. A static table is sorted by pool and time and read row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attestry.streaming.monitor import LATE, MAX_ADMISSIONS, decide

#: Fixed value: runs at once.
MAX_RUNNING = 2
DECISIONS = "pool string, client string, event_id long, ts timestamp, admitted boolean, code string, retry_after_s long"
#: For the state store of a session that runs the stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pool:
    """What a guard knows: admitted times of each client, in order, and the runs that go on."""

    def __init__(self, window_s: float, most: int, running: int):
        self.window_s, self.most, self.running = window_s, most, running
        self.times: dict[str, list[float]] = {}
        self.active: set[int] = set()

    def take(self, kind: str, client: str, run: int, at: float) -> tuple[bool, str | None, int] | None:
        """The decision on a start; None for an end, which frees its place once if the run was admitted."""
        if kind == "end":
            self.active.discard(run)
            return None
        ok, retry, kept = decide(self.times.get(client, []), at, self.window_s, self.most)
        if not ok:
            self.times[client] = kept
            return False, "rate_limited", retry
        if len(self.active) >= self.running:
            self.times[client] = kept[:-1]
            return False, "server_busy", 1
        self.times[client] = kept
        self.active.add(run)
        return True, None, 0

    def prune(self, at: float) -> None:
        self.times = {c: k for c, t in self.times.items() if (k := [x for x in t if x > at - self.window_s])}


def guard(events: DataFrame, window_s: float = 600, most: int = MAX_ADMISSIONS, running: int = MAX_RUNNING) -> DataFrame:
    """(pool, client, event_id, ts, admitted, code, retry_after_s) of the starts among events (pool, client, run_id, event_id, kind, ts).

    kind is `start` or `end`; rows without a time or of another kind are left out, ends of runs that were not admitted change nothing. The
    client's limit is looked at first, then the pool's; refused starts count for neither. Rows of one time go by event_id. A stream
    sorts what a micro-batch brings for a pool.
    """
    d = events.select(
        F.coalesce(F.col("pool").cast("string"), F.lit("")).alias("pool"), F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), F.col("run_id").cast("long").alias("run_id"),
        F.col("event_id").cast("long").alias("event_id"), "kind", F.col("ts").cast("timestamp").alias("ts"),
    ).where("kind IN ('start', 'end') AND ts IS NOT NULL")
    names = ["pool", "client", "event_id", "ts", "admitted", "code", "retry_after_s"]

    if not events.isStreaming:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_pool, state = None, Pool(window_s, most, running)
            for batch in batches:
                seconds = batch.column(5).cast(pa.int64()).to_pylist()
                took, answers = [], []
                for i, (pool, client, run_id, kind, at) in enumerate(zip(*[batch.column(j).to_pylist() for j in (0, 1, 2, 4)], seconds)):
                    if pool != at_pool:
                        at_pool, state = pool, Pool(window_s, most, running)
                    answer = state.take(kind, client, run_id, at / 1e6)
                    if answer:
                        took.append(i)
                        answers.append(answer)
                rows = batch.take(pa.array(took, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(j) for j in (0, 1, 3, 5)] + [pa.array([a[n] for a in answers], t) for n, t in enumerate((pa.bool_(), pa.string(), pa.int64()))], names=names
                )

        return d.repartition("pool").sortWithinPartitions("pool", "ts", "event_id").mapInArrow(run, DECISIONS)

    class Guard(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.admitted = handle.getListState("admitted", "client string, at double")
            self.active = handle.getListState("active", "run_id long")

        def _load(self) -> Pool:
            pool = Pool(window_s, most, running)
            for client, at in self.admitted.get():
                pool.times.setdefault(client, []).append(at)
            pool.active = {r[0] for r in self.active.get()}
            return pool

        def _save(self, pool: Pool) -> None:
            times = sorted((at, c) for c, t in pool.times.items() for at in t)
            self.admitted.put([(c, at) for at, c in times]) if times else self.admitted.clear()
            self.active.put([(r,) for r in sorted(pool.active)]) if pool.active else self.active.clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if times:
                self.handle.registerTimer(int((times[0][0] + window_s) * 1000) + 1)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            pool, out = self._load(), []
            for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
                answer = pool.take(r.kind, r.client, r.run_id, r.ts.value / 1e9)
                if answer:
                    out.append((key[0], r.client, r.event_id, r.ts, *answer))
            self._save(pool)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            pool = self._load()
            pool.prune(expiredTimerInfo.getExpiryTimeInMs() / 1000)
            self._save(pool)
            yield from ()

        def close(self) -> None:
            pass

    return d.withWatermark("ts", LATE).groupBy("pool").transformWithStateInPandas(Guard(), DECISIONS, "Append", "EventTime")
