"""Proposed documents (JSON): read strictly, else with null defaults, else refused; clipped, checked and bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Enumerations, the fields of each record with their most characters, and how many records count.
STATUSES = ["resolved", "ambiguous", "insufficient_context", "not_found"]
ENTITY_TYPES = ["person", "company"]
ENTITY_SCOPES = ["person", "company", "group", "subsidiary", "brand"]
CATEGORIES = ["identity", "activity", "role", "geography", "metric", "event", "recent_signal", "other"]
SCOPE_TYPES = ["person", "company", "group", "subsidiary", "brand", "country", "establishment", "undetermined"]
DISCRIMINATORS = {"city": 100, "country": 100, "industry": 160, "employer": 160, "officialSite": 253, "legalIdentifier": 100, "year": 4}
CANDIDATE_FIELDS = {"prefix": 16, "suffix": 16}
CLAIM_FIELDS = {"scopeLabel": 160, "factPeriodLabel": 80, "factDate": 40, "normalizedValue": 160, "unit": 40, "currency": 20, "contradictionKey": 100, "prefix": 16, "suffix": 16}
MOST_CANDIDATES, MOST_CLAIMS, MOST_MISSING = 3, 6, 8
KEY = "^[a-z][a-z0-9_-]{0,31}$"
SHAPE = "struct<identityStatus string, entityType string, candidates array<map<string,string>>, claims array<map<string,string>>, missingCategories array<string>>"
#: A scalar that is neither text nor null, in the notation of schema_of_variant.
OTHER_SCALAR = r"(?:: |ARRAY<)(?!OBJECT<|ARRAY<|STRING|VOID)"


def _has(m: Column, names: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, names)), F.map_keys(m))) == 0


def _texts(m: Column, names: list[str]) -> Column:
    return reduce(Column.__and__, [F.element_at(m, n).isNotNull() for n in names])


def _one_of(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _clip(c: Column, most: int) -> Column:
    return F.left(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(most))


def _bounded(c: Column, most: int) -> Column:
    """Trimmed and clipped; null if nothing is left."""
    return F.nullif(_clip(c, most), F.lit(""))


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def ingest_documents(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, candidates, facts, missing) of proposed documents (request_id, json).

    documents: request_id, rung, n_candidates, n_facts, dropped. rung is `strict` if every field is there, `defaults` if only fields that may be null are
    missing, `rejected` if the text is no JSON object, a required field is missing, an enumeration does not hold or a scalar is no
    text; a rejected document gives no other rows. The first three candidates and six facts count; texts are trimmed and clipped by
    code points; a record that still breaks a bound is dropped. missing holds each category once, eight at most, and `other` where
    anything was dropped (in the eighth's place if there are eight). Null and empty json are rejected.
    """
    v = F.expr("try_parse_json(json)")
    d = df.select("request_id", F.from_json("json", SHAPE).alias("d"), F.schema_of_variant(v).alias("types"), F.map_keys(F.from_json("json", "map<string,string>")).alias("top"))
    none = F.array().cast("array<map<string,string>>")
    d = d.withColumns({"cs": F.coalesce("d.candidates", none), "fs": F.coalesce("d.claims", none), "ms": F.coalesce("d.missingCategories", F.array().cast("array<string>"))})
    arrays = [F.lit(True)]
    for name in ("candidates", "claims", "missingCategories"):
        arrays.append(~F.array_contains("top", name) | F.coalesce(F.col("types").rlike(rf"(?:<|, ){name}: ARRAY<"), F.lit(False)))
    known = lambda m: F.from_json(F.element_at(m, "discriminators"), "map<string,string>")
    candidate = lambda m: (
        _texts(m, ["candidateKey", "displayName", "sourceUrl", "excerpt"]) & _one_of(F.element_at(m, "entityType"), ENTITY_TYPES) & _one_of(F.element_at(m, "entityScope"), ENTITY_SCOPES)
        & (~F.map_contains_key(m, "discriminators") | F.coalesce(_has(known(m), list(DISCRIMINATORS)), F.lit(False)))
    )
    claim = lambda m: (
        _texts(m, ["subjectKey", "predicate", "sourceUrl", "excerpt"]) & _one_of(F.element_at(m, "category"), CATEGORIES) & _one_of(F.element_at(m, "entityType"), ENTITY_TYPES)
        & _one_of(F.element_at(m, "scopeType"), SCOPE_TYPES)
    )
    every = lambda a, f: F.forall(a, lambda m: F.coalesce(f(m), F.lit(False)))
    readable = (
        reduce(Column.__and__, arrays) & F.col("types").startswith("OBJECT<") & ~F.col("types").rlike(OTHER_SCALAR) & _one_of(F.col("d.identityStatus"), STATUSES)
        & (F.col("d.entityType").isNull() | _one_of(F.col("d.entityType"), ENTITY_TYPES)) & every("cs", candidate) & every("fs", claim) & every("ms", lambda m: _one_of(m, CATEGORIES))
    )
    whole = (
        (F.size(F.array_except(F.array(*map(F.lit, ["entityType", "candidates", "claims", "missingCategories"])), F.col("top"))) == 0)
        & every("cs", lambda m: _has(m, ["discriminators", *CANDIDATE_FIELDS])) & every("fs", lambda m: _has(m, list(CLAIM_FIELDS)))
    )
    d = d.withColumn("rung", F.when(~F.coalesce(readable, F.lit(False)), "rejected").when(whole, "strict").otherwise("defaults"))

    url = lambda c: F.coalesce(F.try_parse_url(c, F.lit("HOST")).isNotNull() & F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull(), F.lit(False))
    rows = lambda name, most: d.where("rung <> 'rejected'").select("request_id", F.posexplode(F.slice(name, 1, most)).alias("ord", "m"))
    at = lambda n: F.element_at("m", n)
    c = rows("cs", MOST_CANDIDATES).withColumn("k", F.from_json(at("discriminators"), "map<string,string>"))
    c = c.select(
        "request_id", F.col("ord").cast("int").alias("ord"), _clip(at("candidateKey"), 32).alias("candidate_key"), _clip(at("displayName"), 160).alias("display_name"), at("entityType").alias("entity_type"),
        at("entityScope").alias("entity_scope"), F.struct(*[_bounded(F.element_at("k", n), most).alias(_snake(n)) for n, most in DISCRIMINATORS.items()]).alias("discriminators"),
        at("sourceUrl").alias("url"), _clip(at("excerpt"), 500).alias("excerpt"), *[_bounded(at(n), most).alias(n) for n, most in CANDIDATE_FIELDS.items()],
    )
    year = F.col("discriminators.year")
    c = c.where(F.col("candidate_key").rlike(KEY) & (F.length("display_name") > 0) & (F.length("excerpt") > 0) & url(F.col("url")) & (year.isNull() | year.rlike(r"^\d{4}$")))
    f = rows("fs", MOST_CLAIMS).select(
        "request_id", F.col("ord").cast("int").alias("ord"), _clip(at("subjectKey"), 32).alias("subject_key"), at("category").alias("category"), at("entityType").alias("entity_type"), _clip(at("predicate"), 80).alias("predicate"),
        at("scopeType").alias("scope_type"), *[_bounded(at(n), most).alias(_snake(n)) for n, most in CLAIM_FIELDS.items()], at("sourceUrl").alias("url"), _clip(at("excerpt"), 500).alias("excerpt"),
    )
    date = F.col("fact_date")
    f = f.where(F.col("subject_key").rlike(KEY) & (F.length("predicate") > 0) & (F.length("excerpt") > 0) & url(F.col("url")) & (date.isNull() | (F.length(date) >= 4)))

    counts = [x.groupBy("request_id").agg(F.count("*").alias(n)) for x, n in ((c, "n_candidates"), (f, "n_facts"))]
    d = d.select("request_id", "rung", F.size("cs").alias("all_c"), F.size("fs").alias("all_f"), "ms")
    for x in counts:
        d = d.join(x, "request_id", "left")
    d = d.fillna(0, ["n_candidates", "n_facts"])
    lost = (F.col("rung") != "rejected") & ((F.col("all_c") != F.col("n_candidates")) | (F.col("all_f") != F.col("n_facts")) | (F.size("ms") > MOST_MISSING))
    d = d.withColumn("dropped", lost)
    once = F.slice(F.array_distinct("ms"), 1, MOST_MISSING)
    other = F.array(F.lit("other"))
    named = F.when(~F.col("dropped") | F.array_contains(once, "other"), once).otherwise(F.concat(F.slice(once, 1, MOST_MISSING - 1), other))
    missing = d.where("rung <> 'rejected'").select("request_id", F.explode(named).alias("category"))
    return d.select("request_id", "rung", "n_candidates", "n_facts", "dropped"), c, f, missing
