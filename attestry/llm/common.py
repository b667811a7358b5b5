"""Helpers shared by the text operators: shared-folder tables, Arrow batches, word splitting."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word pattern of every operator here: runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows worked on at once in Python; Spark bounds what is sent to it at once by bytes.
ROWS = 256


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() parts exactly at the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none and runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and lost executors cost nothing before it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")  # the shuffle files of this job go with its end, not with the driver's garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove(df: DataFrame) -> None:
    """Delete the files of a table that written() made; nothing may read it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(
    df: DataFrame, inputs: list[Column], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array] | None]],
    outputs: T.StructType, keep: list[Column] | None = None,
) -> DataFrame:
    """Add columns computed batch by batch in Python.

    keep are the columns to carry (all of df by default), inputs what the function reads. Internal names
    are generated, so clashing or extra columns of df do no harm. make() runs once for each task and
    returns the batch function.
    """
    keep = [F.col(f"`{c}`") for c in df.columns] if keep is None else keep
    names = [f.name for f in df.select(*keep).schema]
    # an input that is carried anyway is sent to Python once
    carried = {str(c): i for i, c in enumerate(keep)}
    own = [c for c in inputs if str(c) not in carried]
    kept = df.select(*[c.alias(f"__k{i}") for i, c in enumerate(keep)], *[c.alias(f"__i{i}") for i, c in enumerate(own)])
    n = len(keep)
    places = [carried[str(c)] if str(c) in carried else n + [str(x) for x in own].index(str(c)) for c in inputs]
    fields = [T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(kept.schema.fields[:n])]
    schema = T.StructType(fields + [T.StructField(f"__o{i}", f.dataType) for i, f in enumerate(outputs)])
    labels = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):  # what a batch becomes in Python stays small
                batch = whole.slice(start, ROWS)
                cols = batch.columns
                out = f(pa.RecordBatch.from_arrays([cols[p] for p in places], names=[str(i) for i in range(len(places))]))
                yield pa.RecordBatch.from_arrays(cols[:n] + out, names=labels)

    out = kept.mapInArrow(run, schema)
    return out.toDF(*names, *outputs.names)


def bits_for(rows: int, per_bucket: int, least: int = 4, most: int = 24) -> int:
    """Bits of a hash prefix so that a bucket gets about per_bucket rows."""
    return min(most, max(least, math.ceil(math.log2(max(1, rows / per_bucket)))))


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of text in the table, from one narrow aggregate: sizes buckets."""
    row = df.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()
    return row.n or 0
