"""Loading requests, proposals, crawl responses and event logs: good rows and rows with a code, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import urls as u
from attestry.functions.text import nfkc

#: Lengths in code points, and what a crawl response may be.
NAME, CONTEXT, HINTS = (2, 120), 300, {"city": 100, "organization": 160, "role": 160, "industry": 160}
MAX_BYTES = 524_288
MEDIA = ["text/html", "application/xhtml+xml", "text/plain"]
CHARSETS = ["utf-8", "us-ascii"]
MEDIA_CLASSES = {"application/pdf": "pdf", "application/json": "json", "text/xml": "xml", "application/xml": "xml"}
STATES = ["accepted", "researching_and_resolving", "source_verifying", "building", "validating", "completed", "failed"]


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(c), r"\s+", " "))


def load_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, quarantine) of requests (request_id, name, entity_type, context, city, organization, role, industry, identity_source_url, source_url).

    Texts are normalised (NFKC, one space for any run, trimmed). The first rule that fails is the code of a quarantined row.
    """
    d = df.withColumns({c: _clean(F.col(c)) for c in ("name", "context", *HINTS)}).withColumn("entity_type", F.coalesce("entity_type", F.lit("auto")))
    hint = F.lit(False)
    for c, most in HINTS.items():
        hint = hint | (F.col(c).isNotNull() & ((F.length(c) == 0) | (F.length(c) > most)))
    a, b = F.col("identity_source_url"), F.col("source_url")
    code = (
        F.when(F.col("name").isNull(), "name_required").when(~F.col("entity_type").isin("auto", "person", "company"), "invalid_entity_type")
        .when(~F.length("name").between(*NAME), "invalid_name_length").when(F.length("context") > CONTEXT, "invalid_context_length").when(hint, "invalid_hint_length")
        .when(a.isNotNull() & (F.col("entity_type") == "auto"), "identity_source_type_required").when(a.isNotNull() & u.refusal(a).isNotNull(), "invalid_identity_source_url")
        .when(b.isNotNull() & ((F.col("entity_type") == "auto") | u.refusal(b).isNotNull()), "invalid_source_url").when(u.safe_href(a) != u.safe_href(b), "conflicting_source_url")
    )
    d = d.withColumn("code", code)
    source = F.coalesce(F.when(b.isNotNull(), u.safe_href(b)), F.when(a.isNotNull(), u.safe_href(a)))
    ok = d.where("code is null").withColumn("identity_source_url", source).withColumn("context", F.when(F.col("context") != "", F.col("context"))).drop("code", "source_url")
    return ok, d.where("code is not null").select("request_id", "code")


def gate_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected) of responses (page_id, status, headers array<struct<name, value>>, body_bytes): code, and the media class of a bad type."""
    values = lambda n: F.array_distinct(F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == n), lambda h: F.lower(F.trim(h["value"]))))
    d = responses.withColumns({"__type": values("content-type"), "__length": values("content-length")})
    media = F.trim(F.substring_index(F.get("__type", 0), ";", 1))
    charset = F.regexp_extract(F.get("__type", 0), r"charset\s*=\s*\"?([^\s;\"]+)", 1)
    declared = F.get("__length", 0).try_cast("long")
    code = (
        F.when(~F.col("status").between(200, 299) | F.col("status").isNull(), "source_http_error").when(F.size("__type") != 1, "source_content_type_invalid").when(~media.isin(MEDIA), "source_content_type_unsupported")
        .when(~charset.isin("", *CHARSETS), "source_charset_unsupported").when((F.size("__length") > 1) | ((F.size("__length") == 1) & declared.isNull()), "source_content_length_invalid")
        .when((declared > MAX_BYTES) | (F.col("body_bytes") > MAX_BYTES), "source_too_large").when(F.coalesce("body_bytes", F.lit(0)) == 0, "source_empty")
    )
    kind = F.when(media.startswith("image/"), "image").when(media.startswith("video/"), "video").when(media.startswith("audio/"), "audio")
    for k, v in MEDIA_CLASSES.items():
        kind = kind.when(media == k, v)
    d = d.withColumn("code", code).withColumn("media_class", F.when(F.col("code") == "source_content_type_unsupported", kind.otherwise("other"))).drop("__type", "__length")
    return d.where("code is null").drop("code", "media_class"), d.where("code is not null").select("page_id", "code", "media_class")


def decode_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of event blocks (block_id, text): `event:` and `data:` lines, comments left out, data lines joined; the data's state must be the event's name."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: (x != "") & ~x.startswith(":"))
    of = lambda name: F.transform(F.filter("__l", lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    d = df.withColumn("__l", lines).withColumns({"__e": of("event"), "data": F.array_join(of("data"), "\n")})
    d = d.withColumns({"event": F.get("__e", 0), "state": F.get_json_object("data", "$.state"), "__ok": F.expr("try_parse_json(data)").isNotNull()})
    other = F.exists("__l", lambda x: ~x.rlike("^(event|data):"))
    code = (
        F.when(other, "unknown_field").when(F.size("__e") != 1, "event_name_invalid").when(~F.col("__ok"), "data_invalid").when(~F.col("event").isin(STATES), "unknown_state")
        .when(~F.col("state").eqNullSafe(F.col("event")), "state_mismatch")
    )
    d = d.withColumn("code", code)
    elapsed = F.get_json_object("data", "$.elapsed_ms").try_cast("long")
    return d.where("code is null").select("block_id", "event", elapsed.alias("elapsed_ms")), d.where("code is not null").select("block_id", "code")


#: The only columns that a receipt may hold.
RECEIPT = ["run_id", "status", "category", "elapsed_ms", "input_tokens", "output_tokens", "cost_usd"]


def receipts(runs: DataFrame) -> DataFrame:
    """Receipts without names, prompts or excerpts: the allowed columns that runs has, and the first 16 hex digits of the request id's digest."""
    kept = [c for c in RECEIPT if c in runs.columns]
    return runs.select(*kept, F.substring(F.sha2(F.col("provider_request_id").cast("binary"), 256), 1, 16).alias("request_digest"))


def write_receipts(runs: DataFrame, path: str, batch_id: int) -> bool:
    """Write the receipts of a batch under its id, once: a batch that is there whole already stays as it is. True if written.

    The mark is the file that Spark's committer leaves last, so a batch that broke off is written anew.
    """
    spark = runs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}/_SUCCESS")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return False
    receipts(runs).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return True


def sink_receipts(runs: DataFrame, path: str, checkpoint: str):
    """A streaming query that keeps the receipts of a stream of runs under path, each micro-batch exactly once whatever is replayed."""
    once = lambda df, batch_id: write_receipts(df, path, batch_id)
    return runs.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).start()
