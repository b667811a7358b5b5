"""Admission pressure, run protocol, receipts and terminals as streaming transformations.

Functions take and return DataFrames, streaming or not: on a static table each is its own batch twin. check_protocol and
expire_runs sum up finished runs and are for static tables; watch_runs reports the same faults event by event on both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, SLIDE, LATE = "10 minutes", "1 minute", "10 minutes"
MAX_ADMISSIONS = 8
TERMINAL = ("completed", "failed")
STATES = {"signup": "accepted", "view": "researching_and_resolving", "click": "source_verifying", "purchase": "completed", "error": "failed"}
KNOWN = (*STATES.values(), "building", "validating")
#: Headers that name the client's address, in order.
FORWARDED = ("x-vercel-forwarded-for", "x-forwarded-for", "x-real-ip")


def admission_pressure(events: DataFrame, client: str = "user_id", ts: str = "ts", window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """(client, start, n): requests of a client in each sliding window; append mode once the watermark has passed."""
    d = events.withWatermark(ts, LATE)
    return d.groupBy(client, F.window(ts, window, slide)).agg(F.count("*").alias("n")).select(client, F.col("window.start").alias("start"), "n")


def receipt_rollup(events: DataFrame, ts: str = "ts", window: str = "1 hour") -> DataFrame:
    """(start, n_runs, n_failed, value): totals of tumbling windows."""
    d = events.withWatermark(ts, LATE)
    g = d.groupBy(F.window(ts, window)).agg(F.count("*").alias("n_runs"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_failed"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "n_runs", "n_failed", "value")


def dedupe_terminals(events: DataFrame, key: str = "execution_id", ts: str = "ts") -> DataFrame:
    """One terminal event for each run, whatever is replayed inside the watermark."""
    d = events.where(F.col("state").isin(*TERMINAL))
    return d.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key]) if events.isStreaming else d.dropDuplicates([key])


ADMITTED = "client string, event_id long, ts timestamp, admitted boolean, retry_after_s long"


def decide(times: list[float], at: float, window_s: float, most: int) -> tuple[bool, int, list[float]]:
    """One request: at most `most` admitted ones in (at - window, at]; refused ones do not count."""
    kept = [t for t in times if t > at - window_s]
    if len(kept) >= most:
        return False, max(1, -int(-(kept[0] + window_s - at) // 1)), kept
    return True, 0, [*kept, at]


def in_order(batches: Iterator[pa.RecordBatch], window_s: float, most: int) -> Iterator[pa.RecordBatch]:
    """Decisions of rows (client, event_id, ts) sorted by client and time."""
    client, times = object(), []  # no client yet
    for batch in batches:
        ok, retry = [], []
        for who, at in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.int64()).to_pylist()):
            if who != client:
                client, times = who, []
            admitted, wait, times = decide(times, float("nan") if at is None else at / 1e6, window_s, most)
            ok.append(admitted)
            retry.append(wait)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(retry, pa.int64())], names=["client", "event_id", "ts", "admitted", "retry_after_s"])


def admit(requests: DataFrame, window_s: float = 600, most: int = MAX_ADMISSIONS) -> DataFrame:
    """(client, event_id, ts, admitted, retry_after_s) of requests (client, event_id, ts).

    The state of a client is its admitted times inside the window, at most `most` of them. Streaming keeps it with
    applyInPandasWithState; a static table is sorted by client and time and read row by row, and only the state is
    carried from one batch to the next.
    """
    d = requests.select(F.col("client").cast("string").alias("client"), "event_id", "ts")

    def rows(key, pdf: pd.DataFrame, times: list[float]):
        out = []
        for event_id, ts in pdf.sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
            ok, retry, times = decide(times, ts.timestamp(), window_s, most)
            out.append((key[0], event_id, ts, ok, retry))
        return pd.DataFrame(out, columns=["client", "event_id", "ts", "admitted", "retry_after_s"]), times

    if not d.isStreaming:
        d = d.select("client", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
        placed = d.repartition("client").sortWithinPartitions("client", F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
        return placed.mapInArrow(lambda batches: in_order(batches, window_s, most), ADMITTED)

    def stateful(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches))
        out, times = rows(key, pdf, times)
        state.update((times,))
        state.setTimeoutTimestamp(int(max(out["ts"]).timestamp() * 1000 + window_s * 1000) + 1)
        yield out

    return d.withWatermark("ts", LATE).groupBy("client").applyInPandasWithState(stateful, ADMITTED, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def check_protocol(events: DataFrame) -> DataFrame:
    """(execution_id, code) of a finished table of runs: the first event is `accepted`, states are known, exactly one terminal and nothing after it.

    events: execution_id, state, elapsed_ms, ts, event_id.
    """
    w = Window.partitionBy("execution_id").orderBy("ts", "event_id")
    d = events.withColumns({"__r": F.row_number().over(w), "__next": F.lead("state").over(w), "__end": F.col("state").isin(*TERMINAL)})
    known = F.col("state").isin(*KNOWN)
    g = d.groupBy("execution_id").agg(
        F.max((F.col("__r") == 1) & (F.col("state") != "accepted")).alias("a"), F.max(~known).alias("b"), F.max(F.coalesce(F.col("elapsed_ms") < 0, F.lit(True))).alias("c"),
        F.sum(F.col("__end").cast("int")).alias("n"), F.max(F.col("__end") & F.col("__next").isNotNull()).alias("e"))
    code = (
        F.when(F.col("a"), "first_not_accepted").when(F.col("b"), "unknown_state").when(F.col("c"), "elapsed_invalid").when(F.col("n") == 0, "terminal_missing")
        .when(F.col("n") > 1, "terminal_repeated").when(F.col("e"), "event_after_terminal")
    )
    return g.select("execution_id", code.alias("code"))


def expire_runs(events: DataFrame, limit_s: int = 150) -> DataFrame:
    """(execution_id, expired): no terminal within limit_s of the first event. events: execution_id, state, ts."""
    end = F.min(F.when(F.col("state").isin(*TERMINAL), F.col("ts")))
    g = events.groupBy("execution_id").agg(F.min("ts").alias("a"), end.alias("z"))
    return g.select("execution_id", F.coalesce(F.col("z") > F.col("a") + F.make_dt_interval(secs=F.lit(limit_s)), F.lit(True)).alias("expired"))


def client_key(headers: dict[str, Column], salt: str) -> Column:
    """Salted digest of the first forwarded address (128 characters at most), so that no address is kept. headers: columns by name, in the order of the fixed names."""
    first = F.trim(F.substring_index(F.coalesce(*[headers[h] for h in FORWARDED if h in headers], F.lit("")), ",", 1))
    return F.sha2(F.concat(F.lit(salt), F.when(first == "", "address-unavailable").otherwise(F.substring(first, 1, 128))), 256)


WATCHED = "execution_id string, event_id long, code string"
OPEN, ENDED, EXPIRED = 0, 1, 2


def judge(run: tuple[int, int] | None, state: str | None, elapsed: float | None, at: int, limit_us: int) -> tuple[tuple[int, int], list[str]]:
    """The run (start, phase) after one more event, and what is wrong: the same for streams and tests."""
    codes = []
    start, phase = run or (at, OPEN)
    if run is None and state != STATES["signup"]:
        codes.append("first_not_accepted")
    if state not in KNOWN:
        codes.append("unknown_state")
    if elapsed is None or not 0 <= elapsed < float("inf"):
        codes.append("elapsed_invalid")
    if phase == OPEN and at > start + limit_us:
        phase = EXPIRED
        codes.append("timeout")
    if phase == EXPIRED:
        codes.append("late_event")
    elif phase == ENDED:
        codes.append("terminal_repeated" if state in TERMINAL else "event_after_terminal")
    elif state in TERMINAL:
        phase = ENDED
    return (start, phase), codes


def watch_runs(events: DataFrame, limit_s: int = 150, keep_s: int = 600) -> DataFrame:
    """ST3, ST4 (execution_id, event_id, code): what is wrong with each event of a run; `timeout` has no event.

    events: execution_id, event_id, state, elapsed_ms, ts; rows without an execution_id or time are left out. A run without terminal limit_s after its first event has timed out;
    what comes later is reported as late and changes nothing. A stream keeps (start, phase) of each run; its event-time timer fires at
    the limit and, keep_s later, drops the state. A static table is one window by run, in the JVM.
    """
    ts = F.col("ts").cast("timestamp")
    d = events.select("execution_id", F.col("event_id").cast("long").alias("event_id"), "state", F.col("elapsed_ms").cast("double").alias("elapsed_ms"), ts.alias("ts")).where("execution_id is not null and ts is not null")
    limit_us = limit_s * 1_000_000
    if not events.isStreaming:
        run = Window.partitionBy("execution_id")
        d = d.withColumns({"__n": F.row_number().over(run.orderBy("ts", "event_id")), "__us": F.unix_micros("ts"), "__fin": F.col("state").isin(*TERMINAL)})
        d = d.withColumn("__late", F.col("__us") > F.min("__us").over(run) + limit_us)
        d = d.withColumn("__end", F.min(F.when(F.col("__fin") & ~F.col("__late"), F.col("__n"))).over(run))
        lost = F.col("__end").isNull()
        after = F.col("__n") > F.col("__end")
        elapsed = F.col("elapsed_ms")
        codes = [
            ((F.col("__n") == 1) & ~F.col("state").eqNullSafe(STATES["signup"]), "first_not_accepted"), (~F.coalesce(F.col("state").isin(*KNOWN), F.lit(False)), "unknown_state"),
            (~F.coalesce((elapsed >= 0) & (elapsed < float("inf")), F.lit(False)), "elapsed_invalid"), (lost & F.col("__late"), "late_event"), (after & F.col("__fin"), "terminal_repeated"),
            (after & ~F.coalesce("__fin", F.lit(False)), "event_after_terminal"),
        ]
        own = d.select("execution_id", "event_id", F.explode(F.array_compact(F.array(*[F.when(bad, code) for bad, code in codes]))).alias("code"))
        return own.unionByName(d.where(lost & (F.col("__n") == 1)).select("execution_id", F.lit(None).cast("long").alias("event_id"), F.lit("timeout").alias("code")))

    def follow(key, batches, state: GroupState):
        out, run = [], tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if run[1] != OPEN:
                state.remove()
                return
            run = (run[0], EXPIRED)
            out.append((key[0], None, "timeout"))
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for event_id, name, elapsed, ts in rows[["event_id", "state", "elapsed_ms", "ts"]].itertuples(index=False):
                run, codes = judge(run, name, elapsed, int(ts.value // 1000), limit_us)
                out += [(key[0], None if code == "timeout" else event_id, code) for code in codes]
        state.update(run)
        due = run[0] // 1000 + limit_s * 1000 + (0 if run[1] == OPEN else keep_s * 1000)
        # a timer must lie past the watermark
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"execution_id": [r[0] for r in out], "event_id": pd.array([r[1] for r in out], "Int64"), "code": [r[2] for r in out]})

    return d.withWatermark("ts", LATE).groupBy("execution_id").applyInPandasWithState(follow, WATCHED, "start long, phase int", "append", GroupStateTimeout.EventTimeTimeout)
