"""Repair of conversation structure (operator 13).

Rows of a conversation are taken by turn (nulls first). The cheapest edits make the initials of the roles
`(s?(ua)+)?`: keep 0, rerole to user or assistant 1, delete 2 (required for blank and duplicate rows), insert an
empty user or assistant row 5; a truncated row that stays adds 5. Of equally cheap edits the string of their
initials that is least in ASCII is taken.

A row is a symbol: its initial and whether it must go or is truncated. Equal consecutive symbols are one run. What
is still to pay, from each of four states (nothing yet, after s, after u, after a), is carried backwards over a
run by the binary powers of the symbol's min-plus transition, which are kept for all conversations of a task.
Then the choices are unrolled forwards; from a state each letter leads to one state only, so the least letter that
stays on a cheapest way is right.

Texts are never held: faults and symbols come from narrow rows, whose edits (a letter a row, as in the result) are then
sent ahead of the rows of their conversation, and what stays is written or digested as the rows stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of the edits, white space, and what ends a sentence.
RECAST, DELETE, INSERT, CUT = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States: nothing yet, after a system, a user and an assistant row. The row that may come next, by initial: 0 s, 1 u, 2 a.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: Where a row made user or assistant, or put in, leads: there is one way from each state.
NEXT = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
INFO = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _apply(a: tuple, v: tuple) -> tuple:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


def _inserts() -> tuple:
    rows = []
    for s in range(4):
        row, at, cost = [NEVER] * 4, s, 0
        while row[at] > cost:
            row[at] = cost
            at, cost = NEXT[at], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()
END = _apply(INSERTS, (0, NEVER, NEVER, 0))


def moves(state: int, symbol: tuple[int, int]) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, letters ascending."""
    initial, fault = symbol
    out = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        more = CUT if fault == TRUNCATED else 0
        if (state, initial) in KEPT:
            out.append(("K", more, KEPT[state, initial]))
        out.append(("R", RECAST + more, NEXT[state]))
    return out


class Repair:
    """Transitions, their powers and the choices made so far, kept for a task."""

    def __init__(self):
        self.powers: dict[tuple[int, int], list[tuple]] = {}
        self.choices: dict[tuple, tuple[str, int]] = {}

    def power(self, symbol: tuple[int, int], k: int) -> tuple:
        """The transition of 2**k rows of a symbol, with the inserts before each."""
        got = self.powers.get(symbol)
        if got is None:
            step = [[NEVER] * 4 for _ in range(4)]
            for s in range(4):
                for _, cost, to in moves(s, symbol):
                    step[s][to] = min(step[s][to], cost)
            got = self.powers[symbol] = [_times(INSERTS, tuple(map(tuple, step)))]
        while len(got) <= k:
            got.append(_times(got[-1], got[-1]))
        return got[k]

    def before(self, symbol: tuple[int, int], n: int, v: tuple) -> tuple:
        """What is to pay before n rows of a symbol, given what is to pay after them."""
        k = 0
        while n >> k:
            if n >> k & 1:
                v = _apply(self.power(symbol, k), v)
            k += 1
        return v

    def choose(self, symbol: tuple[int, int], state: int, v: tuple, after: tuple) -> tuple[str, int]:
        """The letters up to and with that of one row, and the state after it."""
        low = min(after)
        key = symbol, state, tuple(x - low for x in after)
        got = self.choices.get(key)
        if got is None:
            letters = ""
            while True:
                options = [(x, to, cost + after[to]) for x, cost, to in moves(state, symbol)] + [("I", NEXT[state], INSERT + v[NEXT[state]])]
                letter, to, _ = min(o for o in options if o[2] == v[state])
                letters, state = letters + letter, to
                if letter != "I":
                    break
            got = self.choices[key] = letters, state
        return got

    def unroll(self, symbol: tuple[int, int], n: int, state: int, after: tuple, out: list[str]) -> int:
        """Letters of a run of n rows; long runs are halved, so that few vectors are held at once."""
        if n > 1024:
            half = n // 2
            state = self.unroll(symbol, half, state, self.before(symbol, n - half, after), out)
            return self.unroll(symbol, n - half, state, after, out)
        vs = [after]
        for _ in range(n):
            vs.append(_apply(self.power(symbol, 0), vs[-1]))
        for i in range(n, 0, -1):
            letters, state = self.choose(symbol, state, vs[i], vs[i - 1])
            out.append(letters)
        return state

    def edits(self, runs: list[list]) -> tuple[int, str]:
        """(cost, audit) of the runs [symbol, rows] of a conversation."""
        vs = [END]
        for symbol, n in reversed(runs):
            vs.append(self.before(symbol, n, vs[-1]))
        out: list[str] = []
        state = START
        for i, (symbol, n) in enumerate(runs):
            state = self.unroll(symbol, n, state, vs[len(runs) - 1 - i], out)
        while state not in (START, ASSISTANT):
            out.append("I")
            state = NEXT[state]
        return vs[-1][START], "".join(out)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            yield from zip(*[c.to_pylist() for c in part.columns])


def _parts(df: DataFrame, key: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """(k, here, turn, role, text, digest): null roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    d = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(present, F.lit(True)).alias("here"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    return d.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _audits(d: DataFrame) -> DataFrame:
    """A row (k, gaps, ..., audit) for each key of d."""
    seen = Window.partitionBy("k", "here", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    narrow = d.select(
        "k", "here", "turn", "role", "digest", (F.length(bare) == 0).alias("empty"), (~F.right(bare, F.lit(1)).isin(*STOPS)).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
    ).repartition("k")
    again = F.row_number().over(seen) > 1
    fault = F.when(F.col("empty"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    narrow = narrow.withColumn("again", again).select("k", "here", "turn", "role", "digest", "initial", fault.alias("fault"))
    # a row and those that repeat it stand together, the first of them first
    narrow = narrow.sortWithinPartitions("k", F.col("turn").asc_nulls_first(), "role", "digest", F.col("fault") == DUPLICATE).select("k", "here", "turn", "initial", "fault")
    names = ["k", *(x.split()[0] for x in INFO.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, done, key_type = Repair(), [], None
        key, runs, counts, illegal, last, turns = (), [], [0] * 4, 0, None, []

        def close():
            cost, audit = repair.edits(runs)
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((key[0], gaps, *counts[1:], illegal, cost, audit))

        def sent() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (key_type, *[pa.int64()] * 6, pa.string()))], names=names)

        size = 0
        for batch in batches:
            key_type = batch.column(0).type
            for k, here, turn, initial, fault in _grouped(iter([batch])):
                if (k,) != key:
                    if key:
                        close()
                        size += len(done[-1][-1])
                        if len(done) >= 4096 or size > 1 << 22:
                            yield sent()
                            size = 0
                    key, runs, counts, illegal, last, turns = (k,), [], [0] * 4, 0, None, []
                if not here:
                    continue
                counts[fault] += 1
                symbol = (initial, BLANK if fault == DUPLICATE else fault)
                if runs and runs[-1][0] == symbol:
                    runs[-1][1] += 1
                else:
                    runs.append([symbol, 1])
                if last is not None and (last, initial) not in ((0, 1), (1, 2), (2, 1)):
                    illegal += 1
                last = initial
                if turn is not None:
                    if not turns:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns[1:] = [turn, turns[2] + 1]
        if key:
            close()
            yield sent()

    info = T.StructType([T.StructField("k", d.schema["k"].dataType), *T.StructType.fromDDL(INFO).fields])
    return narrow.mapInArrow(run, info)


def _streamed(d: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of d in order, each conversation's row of audits before them."""
    names = [x.split()[0] for x in INFO.split(", ")]
    head = audits.select("k", F.lit(0).alias("kind"), *[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")], *names)
    rows = d.where("here").select("k", F.lit(1).alias("kind"), "turn", "role", "text", "digest", *[F.lit(None).cast(audits.schema[c].dataType).alias(c) for c in names])
    both = head.unionByName(rows).repartition("k").sortWithinPartitions("k", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    return both.select("k", "kind", "role", "text", *names)


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, audit row or None, role, text): the start of each conversation, then each row that stays."""
    audit, at, state, key = "", 0, START, None

    def put_in():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            yield key, None, "assistant" if state == ASSISTANT else "user", ""

    for k, kind, role, text, *info in rows:
        if kind == 0:
            yield from put_in()
            key, audit, at, state = k, info[-1], 0, START
            yield key, info, None, None
            continue
        yield from put_in()
        letter, at = audit[at], at + 1
        if letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield key, None, role, text
        elif letter == "R":
            state = NEXT[state]
            yield key, None, "assistant" if state == ASSISTANT else "user", text
    yield from put_in()


_PARAMETERS = """
    df has a row for each turn. Rows where present is false count only for their key. Null roles and texts are one space
    (so a null text is blank); null turns come first, a null key is one conversation. Rows of one turn are
    taken by role, then by the SHA-256 of their text, so equal rows stand together. A role is known by its first letter (s, u, a);
    any other, and an empty one, cannot be kept. A conversation may have any number of rows: its letters, never
    its texts, are held in one task. Very long texts are one row each. Columns of df other than the four are not looked
    at, whatever their names.
"""


def repaired_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(key, position, role, text) of the repaired conversations, positions from 0."""
    d = _parts(df, key, turn, role, text, F.lit(True) if present is None else present)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, position = None, [], 0

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield b

        def sent():
            cols = [list(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.string()))], names=["k", "position", "role", "text"])

        for k, info, r, t in _edited(_grouped(typed())):
            if info is not None:
                position = 0
                continue
            out.append((k, position, r, t))
            position += 1
            if len(out) >= 1024:
                yield sent()
        if out:
            yield sent()

    shape = T.StructType([T.StructField("k", d.schema["k"].dataType), *T.StructType.fromDDL("position long, role string, text string").fields])
    return _streamed(d, _audits(d)).mapInArrow(run, shape).toDF(key, "position", role, text)


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each key.

    repaired_sha256 digests the repaired `role:text`, newline-joined: a serial digest, so one task sees the rows of a
    conversation pass, holding none of them. A key without rows that count has zeros, an empty audit and the digest of nothing.
    """
    d = _parts(df, key, turn, role, text, F.lit(True) if present is None else present)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, now, digest, first = None, [], None, None, True
        names = ["k", *(x.split()[0] for x in INFO.split(", ")), "repaired_sha256"]

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield b

        def sent():
            cols = [list(c) for c in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, *[pa.int64()] * 6, pa.string(), pa.string()))], names=names)

        for k, info, r, t in _edited(_grouped(typed())):
            if info is not None:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                    if len(done) >= 1024:
                        yield sent()
                now, digest, first = (k, *info), hashlib.sha256(), True
                continue
            digest.update(("" if first else "\n").encode() + f"{r}:{t}".encode("utf-8", "surrogatepass"))
            first = False
        if now is not None:
            done.append((*now, digest.hexdigest()))
            yield sent()

    shape = T.StructType([T.StructField("k", d.schema["k"].dataType), *T.StructType.fromDDL(INFO + ", repaired_sha256 string").fields])
    got = _streamed(d, _audits(d)).mapInArrow(run, shape)
    return got.toDF(key, *shape.names[1:])


repaired_rows.__doc__ += _PARAMETERS
repair.__doc__ += _PARAMETERS
