"""Language identification by nearest centroid (operator 3).

A text becomes the TF-IDF vector of its letter n-grams (one to three bytes of the lower-cased UTF-8, runs of
non-letters as one space, hashed to a fixed number of dimensions), scaled to length one. Each language has
several centroids, found by spherical k-means on its training texts; the language of the centroid with the
largest cosine wins. A text further than max_distance (1 - cosine) from all of them is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import map_arrow

DIMENSIONS = 4096
UNDETERMINED = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_ASCII = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts of a whole text; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    text = text.lower()
    raw = text.encode().translate(_ASCII) if text.isascii() else _OTHER.sub(" ", text).encode("utf-8", "surrogatepass")
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    two = b[:-1] << np.uint64(8) | b[1:]
    three = two[:-1] << np.uint64(8) | b[2:]
    out = np.zeros(DIMENSIONS, np.float32)
    for grams, salt in zip((b, two, three), _SALTS):
        out += np.bincount(((grams * salt) >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the texts that have letters, and their places."""
    rows, at = [], []
    for i, t in enumerate(texts):
        if (c := counts(t)) is not None:
            rows.append(c)
            at.append(i)
    if not rows:
        return np.zeros((0, DIMENSIONS), np.float32), np.array([], np.int64)
    v = np.log1p(np.stack(rows)) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32), np.array(at, np.int64)


def clustered(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows: farthest-first start, then spherical k-means; fewer if rows coincide."""
    mean = v.mean(axis=0)
    seeds = [v[np.argmax(v @ mean)]]
    nearest = v @ seeds[0]
    while len(seeds) < k and nearest.min() < 0.9999:
        seeds.append(v[np.argmin(nearest)])
        nearest = np.maximum(nearest, v @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", where: Column | None = None, per_language: int = 400, centroids: int = 4) -> Model:
    """Learn from at most about per_language texts of each language (a documented bound; chosen by a hash of their key, so that copies are drawn one by one; whole texts).

    Rows with a null language, or none of whose characters is a letter, teach nothing. The driver gets the
    document frequencies of the fixed dimensions and a few centroids for each language. Without any training
    row the model has no language.
    """
    # the condition may use other columns of df
    rows = (df.where(where) if where is not None else df).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key")).where("lang is not null and text is not null")
    known = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not known:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [])
    share = F.create_map(*[F.lit(x) for k, n in sorted(known.items()) for x in (k, min(1.0, per_language / n))])
    draw = (F.xxhash64("key", F.lit(7)) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000
    sample = rows.where(draw < F.element_at(share, F.col("lang")))

    def frequencies(batches):
        df_, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if (c := counts(t)) is not None:
                    df_ += c > 0
                    n += 1
        at = np.flatnonzero(df_)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*df_[at].tolist(), n], pa.int64())], names=["d", "n"])

    got = {r.d: r.n for r in sample.select("text").mapInArrow(frequencies, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()}
    total = got.pop(-1, 0)
    idf = np.zeros(DIMENSIONS, np.float32)
    for d, n in got.items():
        idf[d] = np.log((1 + total) / (1 + n)) + 1

    def centre(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v, _ = vectors(pdf["text"].tolist(), idf)
        c = clustered(v, centroids) if len(v) else v
        return pd.DataFrame({"lang": [key[0]] * len(c), "centre": [x.tobytes() for x in c]})

    found = sorted((r.lang, bytes(r.centre)) for r in sample.groupBy("lang").applyInPandas(centre, "lang string, centre binary").collect())
    rows_ = [np.frombuffer(c, np.float32) for _, c in found]
    return Model(idf, np.stack(rows_) if rows_ else np.zeros((0, DIMENSIONS), np.float32), [k for k, _ in found])


def identify(df: DataFrame, model: Model, text: str = "text", max_distance: float = 0.6, keep: list[Column] | None = None) -> DataFrame:
    """df with lang_pred (string), score (cosine with the nearest centroid, 0 to 1) and rejected (boolean).

    A null text and one without a letter get `und`, score 0.0, rejected; so does every text under a model
    without languages. Other texts name the nearest language even if rejected; ties go to the first language
    in alphabetical order. Repeated rows agree; an empty table gives an empty table.
    """

    def make():
        langs = model.languages

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(0).to_pylist()
            pred, score, far = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for start in range(0, len(texts) if langs else 0, 256):
                v, at = vectors(texts[start : start + 256], model.idf)
                if len(v):
                    sims = v @ model.centroids.T
                    for i, j, s in zip(at, np.argmax(sims, axis=1), sims.max(axis=1)):
                        pred[start + i], score[start + i] = langs[j], float(min(1.0, max(0.0, s)))
                        far[start + i] = bool(1 - s > max_distance)
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]

        return run

    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_arrow(df, [F.col(f"`{text}`")], make, out, keep)
