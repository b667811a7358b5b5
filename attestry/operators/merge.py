"""Merging facts that say the same, in the order they came.

Facts of a request are taken by ord. Each joins the first group, in the order of their making, whose
representative says the same; else it makes a group. A shorter excerpt becomes the group's representative,
so what a group takes in changes as it goes. Two facts say the same if:

- their categories differ and their excerpts are mechanically equal, or
- both are metrics with one metadata key (category, predicate, scope, label, period, value, unit, currency), whatever their words, or
- category, scope, label, period and value agree and their excerpts are mechanically equal.

Facts meet only over an equal text or an equal metadata key. Where a text has one kind of fact, "the same" is
transitive and grouping is enough: that part is an aggregate which combines before the shuffle. Texts with several
kinds, and the metrics tied to them, are walked through in order, each connected set by itself, as narrow
rows sorted by Spark; only the representatives of the groups made so far are in memory.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import text as x
from attestry.functions.numbers import metric_value
from attestry.sources.tables import settled



def _hash(*columns: Column) -> Column:
    """16 bytes of a digest over the digests of columns; a null is unlike any text."""
    each = [F.coalesce(F.sha2(c.cast("string").cast("binary"), 256), F.lit("-")) for c in columns]
    return F.substring(F.unhex(F.sha2(F.concat(*each) if len(each) > 1 else each[0], 256)), 1, 16)


def _normal(visible: Column) -> Column:
    """Lower case on one line, with plain apostrophes: visible text has single spaces already."""
    return F.coalesce(F.lower(F.replace(F.replace(visible, F.lit("\n"), F.lit(" ")), F.lit("’"), F.lit("'"))), F.lit(""))


def _narrow(facts: DataFrame) -> DataFrame:
    """(request_id, ord, fact_id, e, cat, t, cls, m, len, p): hashes of the excerpt, its mechanical key (null if empty), what kind of fact it is, its metric key, its proof."""
    named = ("scope_label", "predicate", "normalized_value", "unit", "currency")
    d = facts.select(
        "request_id", "ord", "fact_id", "category", "scope_type", "url", _hash(F.col("excerpt")).alias("e"), x.visible_text(F.col("excerpt")).alias("v"),
        x.visible_text(F.coalesce("fact_period_label", "fact_date")).alias("period"), *[x.visible_text(F.col(c)).alias(c) for c in named],
    )
    v, text = F.col("v"), {c: _normal(F.col(c)) for c in (*named, "period")}
    scope = [F.coalesce("category", F.lit("")), F.coalesce("scope_type", F.lit("")), text["scope_label"], text["period"]]
    metric = F.coalesce(F.col("category") == "metric", F.lit(False))
    number = F.coalesce(metric_value(v).cast("string"), F.lit("unparseable"))
    m = F.when(metric, _hash(*scope, text["predicate"], number, text["unit"], text["currency"]))
    key = F.rtrim(F.regexp_replace(x.mechanical_form(v), r"\.$", ""))
    d = d.select("request_id", "ord", "fact_id", "e", "category", key.alias("key"), m.alias("m"), _hash(*scope, text["normalized_value"]).alias("c"), F.coalesce(F.length("v"), F.lit(0)).alias("len"), _hash(F.col("url"), _normal(v)).alias("p"))
    return d.select(
        "request_id", "ord", "fact_id", "e", F.coalesce("category", F.lit("")).alias("cat"), F.when(F.coalesce("key", F.lit("")) != "", _hash(F.col("key"))).alias("t"), F.coalesce("m", "c").alias("cls"), "m", "len", "p",
    )


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = a["request_id"].eqNullSafe(b["request_id"])
    for n in names:
        on = on & (a[n] == b[n])
    return on


def _labels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Least text of the connected set of each text and of each metric. edges: request_id, t, m."""
    own = settled(edges.select("request_id", "t", F.col("t").alias("set")).distinct(), "merge-sets")
    while True:
        of_m = edges.join(own.withColumnsRenamed({"request_id": "r", "t": "u"}), F.col("request_id").eqNullSafe(F.col("r")) & (F.col("t") == F.col("u"))).groupBy("request_id", "m").agg(F.min("set").alias("set"))
        back = edges.join(of_m.withColumnsRenamed({"request_id": "r", "m": "v"}), F.col("request_id").eqNullSafe(F.col("r")) & (F.col("m") == F.col("v"))).groupBy("request_id", "t").agg(F.min("set").alias("set"))
        new = settled(back, "merge-sets")
        if new.exceptAll(own).isEmpty():
            return new, of_m
        own = new


class Groups:
    """The groups of one connected set: representatives by text and by metric key, least number first."""

    def __init__(self):
        self.count = 0
        self.held: dict[int, tuple] = {}  # number: (cat, text, cls, metric, length, proof)
        self.by_text: dict[tuple, list[int]] = {}  # (text, cat), (text, cat, cls)
        self.cats: dict[bytes, set] = {}
        self.by_metric: dict[bytes, list[int]] = {}

    def _places(self, fact: tuple) -> list[list[int]]:
        cat, text, cls, metric, *_ = fact
        out = [self.by_metric.setdefault(metric, [])] if metric is not None else []
        if text is not None:
            self.cats.setdefault(text, set()).add(cat)
            out += [self.by_text.setdefault((text, cat), []), self.by_text.setdefault((text, cat, cls), [])]
        return out

    def find(self, fact: tuple) -> int | None:
        cat, text, cls, metric, *_ = fact
        lists = [self.by_metric.get(metric)] if metric is not None else []
        if text is not None:
            lists += [self.by_text.get((text, c)) for c in self.cats.get(text, ()) if c != cat]
            if metric is None:
                lists.append(self.by_text.get((text, cat, cls)))
        return min((a[0] for a in lists if a), default=None)

    def add(self, fact: tuple) -> int:
        """The number of the group that takes the fact."""
        number = self.find(fact)
        if number is None:
            number, self.count = self.count, self.count + 1
        elif fact[4] < (rep := self.held[number])[4]:
            for a in self._places(rep):
                del a[bisect.bisect_left(a, number)]
        else:
            return number
        self.held[number] = fact
        for a in self._places(fact):
            bisect.insort(a, number)
        return number


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, groups = None, Groups()
    for batch in batches:
        numbers = []
        for request, own, *fact in zip(*[batch.column(n).to_pylist() for n in ("request_id", "set", "cat", "t", "cls", "m", "len")]):
            if (request, own) != at:
                at, groups = (request, own), Groups()
            numbers.append(groups.add(tuple(fact)))
        keep = [n for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*keep, "number"])


def _assigned(facts: DataFrame) -> DataFrame:
    """Narrow rows with fact, a hash of the group that each fact is in."""
    n = settled(_narrow(facts), "merge-facts")
    by_text = n.where("t IS NOT NULL").groupBy("request_id", "t").agg((F.min("cls") != F.max("cls")).alias("mixed"))
    mixed = settled(by_text.where("mixed").select("request_id", "t"), "merge-mixed")
    plain = F.when(F.col("m").isNotNull(), _hash(F.col("m"))).when(F.col("t").isNotNull(), _hash(F.col("t"), F.col("cls"))).otherwise(_hash(F.col("ord"), F.col("fact_id"), F.col("e")))
    if mixed.isEmpty():
        return n.withColumn("fact", plain)
    metrics = n.where("m IS NOT NULL")
    tied = metrics.join(mixed, _same(metrics, mixed, "t"), "left_semi").select("request_id", "m").distinct()
    edges = settled(metrics.join(tied, _same(metrics, tied, "m"), "left_semi").where("t IS NOT NULL").select("request_id", "t", "m").distinct(), "merge-edges")
    of_t, of_m = _labels(edges)
    alone = mixed.join(of_t, _same(mixed, of_t, "t"), "left_anti").select("request_id", "t", F.col("t").alias("set"))
    of_t = of_t.unionByName(alone).select(F.col("request_id").alias("r1"), F.col("t").alias("t1"), F.col("set").alias("s1"))
    of_m = of_m.select(F.col("request_id").alias("r2"), F.col("m").alias("m2"), F.col("set").alias("s2"))
    j = n.join(of_t, F.col("request_id").eqNullSafe(F.col("r1")) & (F.col("t") == F.col("t1")), "left")
    j = j.join(of_m, F.col("request_id").eqNullSafe(F.col("r2")) & (F.col("m") == F.col("m2")), "left")
    j = settled(j.select(*n.columns, F.coalesce("s2", "s1").alias("set")), "merge-sets")
    some = j.where("set IS NOT NULL").repartition("request_id", "set").sortWithinPartitions("request_id", "set", "ord", "fact_id", "e")
    walked = some.mapInArrow(_walk, T.StructType([*some.schema.fields, T.StructField("number", T.LongType())]))
    walked = walked.select(*n.columns, _hash(F.col("set"), F.col("number")).alias("fact"))
    return j.where("set IS NULL").select(*n.columns, plain.alias("fact")).unionByName(walked)


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """One row for each distinct fact of a request: (request_id, fact_id, ord, excerpt, n_duplicates, n_proofs).

    fact_id and excerpt are the representative's, ord is that of the group's first fact (groups are in that order).
    n_proofs counts distinct pairs of url and excerpt; fact_proofs lists them. facts: request_id, ord, fact_id, category, predicate,
    scope_type, scope_label, fact_period_label, fact_date, normalized_value, unit, currency, url, excerpt. Nulls are empty texts;
    a null request is a request; facts of one ord go by fact_id. A fact with an empty excerpt is like no other but by its metadata key.
    """
    a = _assigned(facts)
    rep = F.min(F.struct("len", "ord", "fact_id", "e"))
    proofs = a.groupBy("request_id", "fact", "p").agg(rep.alias("m"), F.min("ord").alias("first"), F.count("*").alias("n"))
    g = proofs.groupBy("request_id", "fact").agg(F.min("m").alias("m"), F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("n_proofs"))
    texts = facts.select(F.col("request_id").alias("r"), F.col("ord").alias("o"), F.col("fact_id").alias("f"), _hash(F.col("excerpt")).alias("h"), "excerpt").dropDuplicates(["r", "o", "f", "h"])
    own = F.col("request_id").eqNullSafe(F.col("r")) & F.col("m.ord").eqNullSafe(F.col("o")) & F.col("m.fact_id").eqNullSafe(F.col("f")) & (F.col("m.e") == F.col("h"))
    return g.join(texts, own).select("request_id", F.col("m.fact_id").alias("fact_id"), F.col("first").alias("ord"), "excerpt", (F.col("n") - 1).alias("n_duplicates"), "n_proofs")


def fact_proofs(facts: DataFrame) -> DataFrame:
    """(request_id, fact_id, url, excerpt): the distinct proofs of each fact of dedupe_facts, one a row (the earliest of equal ones)."""
    a = _assigned(facts)
    rep = a.groupBy("request_id", "fact").agg(F.min(F.struct("len", "ord", "fact_id")).alias("rep")).select(F.col("request_id").alias("r0"), F.col("fact").alias("f0"), F.col("rep.fact_id").alias("named"))
    p = a.groupBy("request_id", "fact", "p").agg(F.min(F.struct("ord", "fact_id", "e")).alias("m"))
    p = p.join(rep, F.col("request_id").eqNullSafe(F.col("r0")) & (F.col("fact") == F.col("f0")))
    texts = facts.select(F.col("request_id").alias("r"), F.col("ord").alias("o"), F.col("fact_id").alias("f"), _hash(F.col("excerpt")).alias("h"), "url", "excerpt").dropDuplicates(["r", "o", "f", "h", "url"])
    own = F.col("request_id").eqNullSafe(F.col("r")) & F.col("m.ord").eqNullSafe(F.col("o")) & F.col("m.fact_id").eqNullSafe(F.col("f")) & (F.col("m.e") == F.col("h"))
    return p.join(texts, own).select("request_id", F.col("named").alias("fact_id"), "url", "excerpt")
