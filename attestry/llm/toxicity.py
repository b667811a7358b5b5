"""Toxicity by a weighted lexicon (operator 4).

Texts are folded first: lower case, look-alike letters of other scripts and digits or signs
used as letters replaced, everything else one space; words with accents are read without them as well. An Aho-Corasick automaton over the lexicon's terms
and the exception phrases reads each whole text once; a term inside an exception phrase does not count.
The sum of the weights found, divided by the square root of the number of words, is turned into a
score by a table fitted on the labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import map_arrow, written

#: Letters of other scripts, digits and signs that pass for Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ʏ": "y",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l",
}
#: Invisible characters that are dropped, not read as a gap.
HIDDEN = "­​‌‍⁠﻿"
#: Letters that cannot be told apart after folding share one form.
SAME = {"l": "i"}


class _Fold(dict):
    """Translation table, filled as characters turn up; bounded by the number of code points."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = ""
        if c not in HIDDEN:
            for part in unicodedata.normalize("NFKC", c).lower():
                part = LOOKALIKES.get(part, part)
                out += SAME.get(part, part) if part.isalpha() or unicodedata.combining(part) else " "
        self[code] = out
        return out


FOLD = _Fold()
#: Between the folded text and the accent-free forms of its accented words.
BREAK = "¶"
_ACCENTED = re.compile(r"[^ ]*[^\x00-\x7f ][^ ]*")


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def fold(text: str | None) -> str:
    """Folded words with one space around each; a sign at a word's end is punctuation, not a letter."""
    if not text:
        return " "
    out = " ".join([w.rstrip("!|$.,;:?") for w in text.split()]).translate(FOLD)
    return f" {' '.join(out.split())} "


def readings(text: str | None) -> str:
    """The folded text, then the accent-free forms of its accented words, each apart: an accent may be a disguise."""
    folded = fold(text)
    if folded.isascii():
        return folded
    return f"{folded}{BREAK} {f' {BREAK} '.join(plain(w) for w in _ACCENTED.findall(folded))} "


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]  # of whole words
    stems: dict[str, float] = field(default_factory=dict)  # of beginnings of words that are no term themselves
    exceptions: list[str] = field(default_factory=list)  # phrases inside which nothing counts
    edges: list[float] = field(default_factory=list)  # lower ends of the bins of the normalised sum
    rates: list[float] = field(default_factory=list)  # score of each bin


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        entries = {f" {t}": (w, None) for t, w in lexicon.stems.items()}
        entries |= {f" {t} ": (w, w) for t, w in lexicon.weights.items()}
        entries |= {f" {t} ": (None, None) for t in lexicon.exceptions}
        for k, (w, whole) in entries.items():
            self.automaton.add_word(k, (len(k), w, whole is not None))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def density(self, text: str | None) -> tuple[float, int]:
        """Sum of weights over the root of the number of words, and the number of words that count.

        A whole term decides for its word; otherwise the longest stem does.
        """
        read = readings(text)
        if self.empty or len(read) < 3:
            return 0.0, 0
        words: dict[int, tuple[bool, int, float]] = {}
        spared = []
        for end, (size, weight, whole) in self.automaton.iter(read):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                words[start] = max(words.get(start, (False, 0, 0.0)), (whole, size, weight))
        if spared:
            words = {s: w for s, w in words.items() if not any(a <= s < b for a, b in spared)}
        total = sum(w for _, _, w in words.values())
        n = read.partition(BREAK)[0].count(" ") - 1
        return max(0.0, total) / max(1, n) ** 0.5, sum(w > 0 for _, _, w in words.values())

    def score(self, density: float) -> float:
        if not self.lexicon.rates:
            return 0.0
        return float(self.lexicon.rates[max(0, int(np.searchsorted(self.lexicon.edges, density, side="right")) - 1)])


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most_rows: int = 12_000,
    least_texts: int = 5, least_rate: float = 0.8, stem_rate: float = 0.3, phrases: list[str] = (),
) -> Lexicon:
    """Learn terms, exceptions and the score table from about most_rows labelled documents (whole texts).

    The labels (key, label) are drawn by a hash of their key down to that bound and sent to the documents,
    which are read once and not shuffled. A term is a folded word in at least least_texts distinct texts,
    least_rate or more of them toxic; its weight is the smoothed log odds. A stem is a beginning of words, four
    to eight letters, in three times as many toxic texts and with stem_rate or more toxic; words under a stem
    are terms with their own weight, negative too, where they are common enough. An exception is a pair of words
    that holds a term and occurs in at least least_texts distinct texts of which fewer than half are toxic;
    given phrases are added. All that pass these tests are taken; the sample bounds how many can. Rows with a null text, label or key teach nothing; without rows the lexicon is
    empty and every score 0.
    """
    marks = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).dropna()
    n = marks.count()
    if not n:
        return Lexicon({}, {}, [fold(p).strip() for p in phrases])
    draw = (F.xxhash64("key", F.lit(11)) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000
    # at most about most_rows * 12 bytes: small enough to send to every executor at any size of the corpus
    drawn = F.broadcast(marks.where(draw < most_rows / n).groupBy("key").agg(F.max("label").alias("label")))
    sample = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key")).dropna().join(drawn, "key").select("text", "label")
    # copies of a text count once; only its hash is shuffled
    texts = written(sample.select("text", "label", F.xxhash64("text").alias("h")).dropDuplicates(["h"]), "toxicity-sample")

    def table(each):
        """Rows (term, bad, good): in how many toxic and other texts of a task each term is; '' counts the texts."""

        def run(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for batch in batches:
                for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                    counts[y > 0].update(each(fold(t).split()))
                    counts[y > 0][""] += 1
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()), pa.array([counts[0][w] for w in names], pa.int64())],
                names=["term", "bad", "good"],
            )

        return texts.mapInArrow(run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    def beginnings(words):
        found = set(words)
        return {*found, *(f"{w[:k]}*" for w in found for k in range(4, min(len(w), 9)))}

    found = written(table(beginnings).where(f"term = '' or bad + good >= {least_texts}"), "toxicity-terms")
    total = found.where("term = ''").first()
    bad, good = (total.bad, total.good) if total else (0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    found = found.where("term <> ''").withColumn("w", odds)
    stem = F.col("term").endswith("*")
    often = (F.col("bad") >= 3 * least_texts) & (F.col("bad") >= stem_rate * (F.col("bad") + F.col("good")))
    stems: dict[str, tuple[float, int]] = {}
    longer: dict[str, int] = {}  # of each beginning, the most toxic texts of a chosen stem that goes on from it
    for r in found.where(stem & often).orderBy(F.length("term").desc(), F.desc("bad"), "term").collect():
        name = r.term[:-1]
        if longer.get(name, -1) < 0.8 * r.bad:
            stems[name] = (r.w, r.bad)
            for size in range(4, len(name) + 1):
                longer[name[:size]] = max(longer.get(name[:size], 0), r.bad)
    under = F.lit(False)
    for size in sorted({len(x) for x in stems}):
        under = under | F.substring("term", 1, size).isin([x for x in stems if len(x) == size])
    sure = (F.col("bad") >= least_texts) & (F.col("bad") >= least_rate * (F.col("bad") + F.col("good")))
    chosen = found.where(~stem & (sure | under))
    weights = {r.term: r.w for r in chosen.collect()}

    def pairs(words):
        return {f"{a} {b}" for a, b in zip(words, words[1:]) if weights.get(a, 0) > 0 or weights.get(b, 0) > 0}

    spared = table(pairs).where((F.col("term") != "") & (F.col("bad") + F.col("good") >= least_texts) & (F.col("bad") < F.col("good")))
    exceptions = [r.term for r in spared.collect()]
    lexicon = Lexicon(weights, {k: w for k, (w, _) in stems.items()}, sorted({*exceptions, *(fold(p).strip() for p in phrases)}))

    # the share of toxic texts by bins of the density, made monotonic
    edges = [-1.0, 1e-9, *[0.05 * 1.35**i for i in range(24)]]

    def binned(batches):
        matcher = Matcher(lexicon)
        counts = np.zeros((len(edges), 2), np.int64)
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts[max(0, int(np.searchsorted(edges, matcher.density(t)[0], side="right")) - 1), int(y > 0)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(edges)), pa.int32()), pa.array(counts[:, 1]), pa.array(counts[:, 0])], names=["b", "bad", "good"])

    got = {r.b: (r.bad, r.good) for r in texts.mapInArrow(binned, "b int, bad long, good long").groupBy("b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    prior = bad / max(1, bad + good)
    rates: list[float] = []
    carry = [0.0, 0.0]
    for b in range(len(edges)):
        y, n_ = got.get(b, (0, 0))
        if b:
            carry = [carry[0] * 0.2 + y, carry[1] * 0.2 + n_]
            rate = (carry[0] + 2 * (rates[-1] if b > 1 else 0.5)) / (carry[0] + carry[1] + 2)
        else:
            rate = (y + 2 * prior) / (y + n_ + 2)
        rates.append(max(rate, rates[-1]) if rates else rate)
    return Lexicon(weights, lexicon.stems, lexicon.exceptions, edges, [min(1.0, max(0.0, r)) for r in rates])


def toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.3, keep: list[Column] | None = None) -> DataFrame:
    """df with score (0 to 1), predicted (1 if score >= threshold) and n_terms (long) for every whole text.

    Null and empty texts have no words: density 0 and the score of that bin. Repeated rows agree; an empty
    table gives an empty table; other columns are kept under their names.
    """

    def make():
        matcher = Matcher(lexicon)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            got = [matcher.density(t) for t in batch.column(0).to_pylist()]
            scores = [matcher.score(d) for d, _ in got]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([n for _, n in got], pa.int64())]

        return run

    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_terms", T.LongType())])
    return map_arrow(df, [F.col(f"`{text}`")], make, out, keep)
