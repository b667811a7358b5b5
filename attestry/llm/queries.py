"""Registered queries of the text operators, and their SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.suffix import remove_repeats

    got = remove_repeats(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS g
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
early AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) <> max(doc_id)),
late AS (SELECT doc_id, i FROM win JOIN early USING (g) WHERE doc_id > m),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM late),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
span AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM span),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS z,
    string_agg(substr(x, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS y
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(y, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.common import scratch
    from attestry.llm.warc import page_records, read_archives, write_archives

    path = scratch(spark, "warc")
    write_archives(page_records(table(spark, sf_dir, "pages")), path)
    got = read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    key = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    # a response is measured by the payload read back, a revisit by what its header says of the full payload
    return got.select(
        key(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", key(F.col("refers_to"))).alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.spm import encode_decode

    got = encode_decode(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT t, min(doc_id) AS k, count(*)::BIGINT AS n_copies FROM d GROUP BY t),
w AS (SELECT k, regexp_extract_all(t, '[^ 	-
]+') AS w FROM texts),
s AS (
  SELECT DISTINCT k, g FROM (
    SELECT k, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
pairs AS (
  SELECT a.k AS u, b.k AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN n nu ON nu.k = u JOIN n nv ON nv.k = v WHERE 5 * common >= 4 * (nu.n + nv.n - common)),
reach(u, v) AS (SELECT k, k FROM texts UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
root AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT d.doc_id, root.class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies
FROM d JOIN texts USING (t) JOIN root ON root.u = texts.k LEFT JOIN degree ON degree.u = texts.k
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs, where=~held_out)
    return identify(docs, model, keep=[F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.toxicity import fit, toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    lexicon = fit(docs.select("doc_id", "text"), labels.where(~held_out).select("doc_id", "toxic"))
    got = toxicity(docs, lexicon, keep=[F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")])
    return got.select("doc_id", "held_out", "score", "predicted", "n_terms")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.substring import remove_repeats

    got = remove_repeats(table(spark, sf_dir, "documents"), joined=True, columns=["doc_id"])
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH p AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM p WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM p),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM p LEFT JOIN kept USING (doc_id)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.quality import BASE, STANDARD, apply_policy, ledger

    got = ledger(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    base = apply_policy(got, BASE).withColumn("base_failed", ~F.col("kept"))
    return apply_policy(base, STANDARD).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the standard policy rejects, and what it alone rejects."""
    from attestry.llm.quality import STANDARD, ablations, ledger

    return ablations(ledger(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")]), STANDARD)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT row_number() OVER () AS r, * FROM parts),
tri AS (
  SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM windows WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_distinct(w)) AS n_distinct_words,
    length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM windows LEFT JOIN covered USING (r)),
f AS (
  SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words >= 100 AND 100 * n_distinct_words < 10 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
  failed_bits % 4 <> 0 AS base_failed, failed_bits % 64 = 0 AS kept
FROM f
"""

ABLATIONS_SQL = OP10_SQL[: OP10_SQL.rindex("SELECT doc_id")] + r"""
SELECT r.name AS rule, (count(*) FILTER (failed_bits // r.bit % 2 = 1))::BIGINT AS n_failed,
  (count(*) FILTER (failed_bits % 64 = r.bit))::BIGINT AS n_only, (count(*) FILTER (failed_bits % 64 <> 0))::BIGINT AS n_rejected, count(*)::BIGINT AS n_rows
FROM f CROSS JOIN (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('upper_case', 8), ('repeated_lines', 16), ('long_words', 32)) r(name, bit)
GROUP BY r.name
"""


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, dealt by a hash of the id, is the snapshot; the other half comes in as a batch."""
    from attestry.llm.exact import deduplicate

    old = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return deduplicate(table(spark, sf_dir, "documents"), old, columns=["doc_id"])


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of each text joined by one space; in a tenth of the documents, chosen by a hash of the id,
    the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    d = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    d = d.select("*", n.alias("n"), g.alias("g")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    d = d.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    unit, rest = F.expr("slice(w, int(a) + 1, int(p))"), F.expr("int(n - a)")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    repeated = F.concat_ws(" ", F.expr("slice(w, 1, int(a))"), tail)
    return d.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.periodic import periodic_runs

    got = periodic_runs(planted_repeats(table(spark, sf_dir, "documents")), keep=[F.col("doc_id")])
    # quotients of numbers under 2**26 are equal as doubles only if they are equal
    ranked = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = got.select("*", F.array_max(ranked).alias("top"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"), F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with planted faults, by a hash of id and turn; nulls are one space. here is false for dropped ones."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), m.alias("m"))
    text = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("m") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("m") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("m") != 0).alias("here"), F.explode(times)).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.conversation import repair

    return repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("here"))


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda h, b:
    list_reduce([xor(h, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


#: All pairs of equal words within a quarter of the document; stretches of them at one distance are repetitions.
OP12_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id::VARCHAR AS name FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, """
    + _crc32_sql("name")
    + r""" AS h FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n END AS a FROM h),
p AS (SELECT r, doc_id, n, a, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM a),
word AS (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM h),
planted AS (
  SELECT w.r, w.i, p.n, coalesce(v.x, w.x) AS x
  FROM word w JOIN p USING (r) LEFT JOIN word v ON v.r = w.r AND w.i >= a AND v.i = a + (w.i - a) % p),
same AS (SELECT s.r, t.i - s.i AS q, s.i FROM planted s JOIN planted t ON s.r = t.r AND s.x = t.x AND t.i > s.i AND 4 * (t.i - s.i) <= s.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
span AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, l, min(q) AS q FROM span GROUP BY r, s, l),
top AS (
  SELECT r, count(*) AS n_runs, arg_max({'s': s, 'l': l, 'q': q}, (l / q, -s, -q)) AS t,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM planted ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, t.s::BIGINT AS start, t.l::BIGINT AS length, t.q::BIGINT AS period,
  (1000 * t.l // t.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256,
  n::BIGINT AS n_words
FROM p LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""
)


#: crc32 bit by bit; then the edits forwards, row by row: for each state the cheapest audit, the least of equals, and what it leaves.
OP13_SQL = (
    r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
marked AS (
  SELECT *, """
    + _crc32_sql("name")
    + r""" % 20 AS m
  FROM named),
hurt AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
    CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM marked)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ending FROM hurt),
rows_ AS (
  SELECT *, left(role, 1) AS c,
    CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows_) GROUP BY conv_id),
nexts(st, st2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins(st, st2, cost, letters, lines) AS (
  SELECT st, st, 0, '', [] FROM nexts UNION ALL SELECT st, st2, 5, 'I', [role || ':'] FROM nexts
  UNION ALL SELECT a.st, b.st2, 10, 'II', [a.role || ':', b.role || ':'] FROM nexts a JOIN nexts b ON a.st2 = b.st),
keep(st, c, st2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves AS (
  SELECT conv_id, i, s.st, 'D' AS letter, s.st AS st2, 2 AS cost, [] AS lines FROM rows_ CROSS JOIN (VALUES (0), (1), (2), (3)) s(st)
  UNION ALL SELECT conv_id, i, st, 'K', st2, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, [role || ':' || text]
    FROM rows_ JOIN keep USING (c) WHERE fault IN ('fine', 'truncated')
  UNION ALL SELECT conv_id, i, st, 'R', st2, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, [n.role || ':' || text]
    FROM rows_ CROSS JOIN nexts n WHERE fault IN ('fine', 'truncated')),
steps AS (
  SELECT conv_id, i, ins.st, m.st2, ins.cost + m.cost AS cost, letters || letter AS letters, ins.lines || m.lines AS lines
  FROM moves m JOIN ins ON ins.st2 = m.st),
best(conv_id, i, st, b) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT b.conv_id, b.i + 1, s.st2, min({'cost': b.b.cost + s.cost, 'audit': b.b.audit || s.letters, 'lines': b.b.lines || s.lines})
  FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.st = b.st GROUP BY ALL),
done AS (
  SELECT b.conv_id, min({'cost': b.b.cost + ins.cost, 'audit': b.b.audit || ins.letters, 'lines': b.b.lines || ins.lines}) AS b
  FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id JOIN ins USING (st)
  WHERE b.i = coalesce(c.n, 0) AND ins.st2 IN (0, 3) GROUP BY b.conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, d.b.cost::BIGINT AS cost, d.b.audit AS audit,
  sha256(array_to_string(d.b.lines, chr(10))) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""
)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_jaccard_join, op3_language_id, op4_toxicity, op5_suffix_dedup, op6_warc, op7_sentencepiece, op8_decontamination, op9_substring_dedup, op10_quality_rules, op11_exact_dedup, op12_periodic_runs, op13_conversation_repair, quality_ablations)}
ORACLES: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_conversation_repair": OP13_SQL, "quality_ablations": ABLATIONS_SQL}
