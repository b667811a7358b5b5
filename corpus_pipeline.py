"""From raw documents to token ids: five stages, each a job over all that its predecessor kept.

A stage gives back the columns of its input under their names, whatever they are, except the last. Rows with a null doc_id
pass stages 2 to 4 unless their text is rejected by stage 1. An empty table passes as one. Very long texts
are one row each in every stage. Repeated rows are worked alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontam, jaccard, quality, spm, substring
from attestry.llm.common import remove, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., so that no name clashes with a result's, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps; null, empty and short texts (under 50 words) go."""
    d, names = _numbered(docs)
    kept = quality.apply_policy(quality.ledger(d, text=names["text"]), quality.ANY_LENGTH).where("kept")
    return kept.select(*names.values()).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id; rows that repeat it stay with it."""
    return jaccard.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the word sequences of 20 or more that came earlier; n_chars is counted anew, null texts stay null."""
    d, names = _numbered(docs)
    text = F.when(F.col(names["text"]).isNotNull(), F.col("kept"))
    got = substring.remove_repeats(d, key=names["doc_id"], text=names["text"]).withColumn(names["text"], text)
    return got.withColumn(names["n_chars"], F.length(names["text"]).cast("long")).select(*names.values()).toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null texts hold none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (none for null and empty texts); what they decode to is checked against the text."""
    keep = [F.col(c) for c in ("doc_id", "lang", "source", "n_chars", "text")]
    got = spm.encode_decode(docs, keep=keep)
    return got.select(
        "doc_id", "lang", "source", "n_chars", F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the merges of the tokenizer nor the edit search; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
