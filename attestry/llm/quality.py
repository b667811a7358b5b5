"""Quality rules as a bitmask ledger (operator 10).

ledger() measures every text once and evaluates every rule once: the measurements and one long of failure
bits are stored. A policy is a versioned set of rules, a bit mask: applying one is a bitwise AND, and
ablations come from counts of the distinct bit patterns, never from the texts again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import map_arrow

#: The characters that count as symbols, and the white space between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct_words", "n_upper")
_UPPER_LATIN = bytes(c for c in range(256) if chr(c).isupper())
_UPPER = regex.compile(r"\p{Lu}")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text; a null text has no words."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), *(0,) * 5)
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        reach = 0  # words before this are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(reach, i)
                reach = i + 3
    try:
        upper = len(raw := text.encode("latin-1")) - len(raw.translate(None, _UPPER_LATIN))
    except UnicodeEncodeError:
        upper = len(_UPPER.findall(text))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated, len(set(words)), upper


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition holds; bit is its fixed place in every stored ledger."""

    name: str
    bit: int
    fails: Callable[[dict[str, Column]], Column]


#: Bits are never reused: a new rule takes the next one.
RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 50),
    Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", 2, lambda m: 100 * m["n_symbols"] > 5 * m["word_chars"]),
    Rule("upper_case", 3, lambda m: 100 * m["n_upper"] > 40 * m["word_chars"]),
    Rule("repeated_lines", 4, lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("long_words", 5, lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("few_distinct_words", 6, lambda m: (m["n_words"] >= 100) & (100 * m["n_distinct_words"] < 10 * m["n_words"])),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
#: Version 1 had few_distinct_words too: the share of distinct words falls with the length of any text, so it rejected clean
#: long texts. The rule stays in the ledger, its bit for those who want it.
STANDARD = Policy("standard", 2, tuple(r.name for r in RULES if r.name != "few_distinct_words"))
ANY_LENGTH = STANDARD


def ledger(df: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """df with the measurements (long) and failed_bits (long: bit of each failed rule), one pass over the texts.

    Null and empty texts have no words and fail few_words. Every row is measured by itself, so repeated rows
    get equal ledgers; a very long text is measured whole, as one row; an empty table gives an empty table. keep limits the columns carried on.
    """

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            got = [measure(t) for t in batch.column(0).to_pylist()]
            return [pa.array([g[i] for g in got], pa.int64()) for i in range(len(MEASURES))]

        return run

    # names are set by place, so a column of df that has a measurement's name is kept beside it
    cols = [F.col(f"`{c}`") for c in df.columns] if keep is None else keep
    names = df.select(*cols).columns
    out = map_arrow(df, [F.col(f"`{text}`")], make, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]), cols)
    out = out.toDF(*[f"__d{i}" for i in range(len(names))], *[f"__m_{m}" for m in MEASURES])
    m = {x: F.col(f"__m_{x}") for x in MEASURES}
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("__bits", bits)
    return out.toDF(*names, *MEASURES, "failed_bits")


def apply_policy(ledger_df: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with kept (boolean): no rule of the policy has failed."""
    return ledger_df.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(ledger_df: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of a policy: rows failing it, rows only it rejects (kept again without it), rows rejected in all.

    One count of distinct bit patterns (at most 2 to the number of rules, summed before the shuffle), then
    bitwise tests on those few rows. An empty ledger gives no rows.
    """
    masked = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = ledger_df.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    failing = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failing, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum("n").alias("n_rows"),
    )
