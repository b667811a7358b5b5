"""Token counts by a count-only Viterbi over a unigram vocabulary (operator 1).

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a character, longest first;
dynamic programming carries the best score and its piece count, never the pieces. Ties go to the match
that starts first, as in the unigram tokenizer: a later candidate replaces only if strictly better. A
character without a piece of its own costs the lowest score less 10 and counts as its UTF-8 bytes (byte
fallback). Pieces never cross a word boundary and scores are whole numbers, so the best path of a text is
the best paths of its words, put together exactly; words are cached up to a bound.
"""

from __future__ import annotations

import re
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import pieces
from attestry.llm.common import map_arrow

SEGMENT = re.compile(f"{pieces.SPACE}+[^{pieces.SPACE}]*|[^{pieces.SPACE}]+")
#: Fixed value of the unigram tokenizer: how far an unknown character lies below the lowest score.
UNKNOWN_PENALTY = 10.0
CACHED = 400_000


class Counter:
    """Piece count and best score of a text."""

    def __init__(self, vocabulary: pieces.Vocabulary):
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        known = [(p, v.scores[i]) for p, i in v.ids.items() if v.types[i] != pieces.UNUSED]
        for piece, score in known:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in known), default=0.0) - UNKNOWN_PENALTY
        whole = all(float(s).is_integer() for _, s in known)
        self.by_word = v.splits and whole
        self.cache: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        reached = 1  # ends below this are final
        single = False
        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            if end >= reached:  # the first, longest match of a new end
                if end > reached or not single:
                    self._close(text, reached, end, single, best, count)
                start = end - size
                best[end], count[end] = best[start] + score, count[start] + 1
                reached, single = end + 1, size == 1
                self._open = end
            else:
                start = end - size
                if best[start] + score > best[end]:
                    best[end], count[end] = best[start] + score, count[start] + 1
                single = single or size == 1
        self._close(text, reached, n + 1, single, best, count)
        return count[n], best[n]

    def _close(self, text, reached, end, single, best, count) -> None:
        """Before the ends reached..end-1, which no piece reaches: unknown characters; first the last open end."""
        last = reached - 1
        if last > 0 and not single:
            self._unknown(text, last, best, count, True)
        for e in range(reached, end):
            self._unknown(text, e, best, count, False)

    def _unknown(self, text, e, best, count, taken) -> None:
        score = best[e - 1] + self.unknown
        if not taken or score > best[e]:
            best[e] = score
            count[e] = count[e - 1] + (len(text[e - 1].encode("utf-8", "surrogatepass")) if self.vocabulary.byte_fallback else 1)

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = pieces.escaped(text)
        if not self.by_word:
            return self.viterbi(text)
        n, score, cache = 0, 0.0, self.cache
        for word in SEGMENT.findall(text):
            got = cache.get(word)
            if got is None:
                got = self.viterbi(word)
                if len(word) <= 48:
                    if len(cache) >= CACHED:
                        cache = self.cache = dict(islice(cache.items(), CACHED // 2))  # frequent words came first
                    cache[word] = got
            n += got[0]
            score += got[1]
        return n, score


def token_counts(df: DataFrame, text: str = "text", model_path: str | None = None) -> DataFrame:
    """df with n_tokens (long) and score (double, of the best segmentation) of a whole text column.

    Null and empty texts count 0 with score 0.0; rows, repeated or not, are counted one by one; other columns
    are kept as they are. An empty table gives an empty table. The vocabulary file is read by the driver
    and sent once to each executor (a file of fixed size, under 1 MB).
    """
    spark: SparkSession = df.sparkSession
    data = spark.sparkContext.broadcast(open(model_path or pieces.default_path(), "rb").read())

    def make():
        counter = Counter(pieces.parse(data.value))

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            got = [counter(t) for t in batch.column(0).to_pylist()]
            return [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())]

        return run

    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])
    return map_arrow(df, [F.col(f"`{text}`")], make, out)
