"""Steps whose memory or work must not grow faster than the input: what their plans hold, and the same results."""

from __future__ import annotations

from tests.compare import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_confidence_has_one_group_a_claim(spark):
    """publishers are told apart without a group for each; evidence meets its claim once."""
    from attestry.operators.dossier import confidence

    claims = spark.createDataFrame([(i, "supported") for i in range(5)], "claim_id long, state string")
    read = [(0, "https://a.com/1"), (0, "https://www.a.com/2"), (1, "https://a.com/1"), (1, "https://b.com/1"), (2, None), (2, "https://a.com/1"), (3, None), (3, "no url")]
    evidence = spark.createDataFrame([(i, "source_content", False, u) for i, u in read], "claim_id long, method string, official boolean, url string")
    got = confidence(claims, evidence)
    plan = _plan(got)
    assert plan.count("Join") == 1 and plan.count("HashAggregate(") == 2
    assert {r.claim_id: r.level for r in got.collect()} == {0: "supported", 1: "confirmed", 2: "confirmed", 3: "supported", 4: "lead"}


def test_links_of_dossiers_are_joined_once(spark):
    """the issues of links, of claims and of pages are read from one joined table, not from a join each."""
    from attestry.plans.gate_plan import v10_display_issues

    plan = _plan(v10_display_issues(spark, SF))
    assert "lineitem.parquet" not in plan and plan.count("Join") < 12


def test_pages_of_one_row_group_are_dealt_out(spark):
    """the pages of people are read once, by all cores."""
    from attestry.operators.support import derive_role_facts

    people = spark.createDataFrame([(i, "k", "Jeanne Martin", "https://nordix.fr/equipe", "Nordix", "Jeanne Martin", "Jeanne Martin\nDirectrice de Nordix") for i in range(3)],
                                   "request_id long, candidate_key string, display_name string, url string, title string, excerpt string, text string").coalesce(1)
    got = derive_role_facts(people)
    assert "Directrice" not in _plan(got) and "role-lines" in _plan(got)
    assert {(r.request_id, r.category, r.excerpt) for r in got.collect()} == {(i, "role", "Jeanne Martin\nDirectrice de Nordix") for i in range(3)}


def test_texts_meet_their_claims_once(spark):
    """exact and mechanical matches come from one pass over one join."""
    from attestry.operators.evidence import locate

    claims = spark.createDataFrame([(1, 1, "Red roof", None, None), (2, 1, "RED ROOF", None, None), (3, 1, "blue", None, None), (4, 2, "x", None, None), (5, 1, "", None, None)], "claim_id int, page_id int, excerpt string, prefix string, suffix string")
    got = locate(claims, spark.createDataFrame([(1, "The Red roof.\nEnd")], "page_id int, text string"))
    assert _plan(got).count("Join") == 1
    assert {(r.claim_id, r.code, r.match_mode, r.start, r.verified) for r in got.collect()} == {
        (1, None, "exact", 4, "Red roof"), (2, None, "mechanical_equivalence", 4, "Red roof"), (3, "source_excerpt_missing", None, None, None), (4, "source_excerpt_missing", None, None, None), (5, "source_excerpt_missing", None, None, None)}


def test_forms_of_long_texts_try_patterns_only_where_needed(spark):
    """visible and mechanical forms run a pattern over a text only if a character that it changes stands in it, and give what the patterns give."""
    import random
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from attestry.functions import text as x

    wide, zero, mark = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "".join(x.ZERO_WIDTH), "".join(x.QUOTES)
    space = f"[ \t\n\x0b\f\r{wide}]"

    def visible(s):
        s = re.sub(f"[ \t\x0b\f\r{wide}]+", " ", re.sub("\r\n|[\r\x85\u2028\u2029]", "\n", unicodedata.normalize("NFKC", s)))
        return "\n".join(filter(None, (line.strip(" ") for line in s.split("\n"))))

    def mechanical(v):
        at = lambda i: 0 <= i < len(v) and not v[i] in " \t\n\x0b\f\r" and not unicodedata.category(v[i]).startswith("P")
        v = "".join(c for i, c in enumerate(v) if not (c in zero and not (at(_before(v, i)) and at(_after(v, i)))))
        v = v.translate({ord(c): p for k, p in x.QUOTES.items() for c in k} | {0xAD: None})
        return re.sub(f"{space}+", " ", v.replace("\u2026", "...")).lower().strip(" ")

    def _before(v, i):
        while i >= 0 and v[i] in zero:
            i -= 1
        return i

    def _after(v, i):
        while i < len(v) and v[i] in zero:
            i += 1
        return i

    r = random.Random(5)
    odd = [*"aB.,    \n\r\t\x0b\f\x1c", "\r\n", *mark, *zero, "\xad", "\u2026", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", "\xc9", "\ufb01"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 16))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", x.visible_text(F.col("text")).alias("v"))
    d = d.select("text", "v", x.mechanical_form(F.col("v")).alias("m"))
    for text, v, m in d.collect():
        assert (v, m) == ((None, None) if text is None else (visible(text), mechanical(visible(text)))), ascii(text)
    plan = _plan(d)
    assert plan.count("regexp_replace(") <= plan.count("CASE WHEN Contains(") + plan.count("CASE WHEN (Contains(") + plan.count("CASE WHEN ((")
    assert "rlike" not in plan.lower()


def test_evidence_of_dossiers_is_built_once(spark):
    """claims and their evidence go to their request together; claims without evidence, evidence without a claim, equal ids and null ids stay as they are."""
    from attestry.operators.assembly import assemble
    from attestry.plans.assembly_plan import dossiers

    rest = "'s', 'p', 't', 'supported', 'confirmation', 'display_fact', NULL, NULL, 'unknown'"
    claims = spark.sql(f"SELECT * FROM VALUES (1L, 'a', 2L, {rest}), (1L, 'b', 1L, {rest}), (2L, 'c', 0L, {rest}), (2L, 'c', 0L, {rest}), (3L, NULL, 0L, {rest}), (4L, 'a', 0L, {rest}) AS "
                       "t(request_id, claim_id, ord, subject_key, predicate, statement, state, reconciliation, decision, value, unit, temporal_status)")  # fmt: skip
    proof = "'u', 'x', 'supports', 'm', 'l'"
    evidence = spark.sql(f"SELECT * FROM VALUES (1L, 'a', 2L, 'e2', {proof}), (1L, 'a', 1L, 'e1', {proof}), (2L, 'c', 1L, 'e3', {proof}), (3L, NULL, 1L, 'e4', {proof}), (5L, 'none', 1L, 'e5', {proof}) AS "
                         "t(request_id, claim_id, ord, evidence_id, url, excerpt, relation, method, locator)")  # fmt: skip
    status = spark.range(1, 7).withColumnRenamed("id", "request_id")
    lists = spark.createDataFrame([(1, "key_facts", "a", 1)], "request_id long, list string, claim_id string, position long")
    got = assemble(status, claims, evidence, lists, spark.createDataFrame([], "request_id long, limits array<string>"))
    assert {r.request_id: (r.claims and [(c.claim_id, c.evidence_ids) for c in r.claims], r.evidence and [(e.claim_id, e.evidence_id) for e in r.evidence]) for r in got.collect()} == {
        1: ([("b", None), ("a", ["e1", "e2"])], [("a", "e1"), ("a", "e2")]), 2: ([("c", ["e3"])] * 2, [("c", "e3")]), 3: ([(None, None)], [(None, "e4")]), 4: ([("a", ["e1", "e2"])], None), 5: (None, [("none", "e5")]), 6: (None, None)}
    assert _plan(dossiers(spark, SF)).count("lineitem.parquet") == 1


def test_dossiers_are_written_compressed(spark, tmp_path):
    """ids are hexadecimal, which the default compression leaves as it is."""
    from attestry.operators.assembly import write_dossiers

    write_dossiers(spark.sql("SELECT id, sha2(cast(id AS string), 256) AS e, 'partial' AS global_status FROM range(20000)").coalesce(1), str(tmp_path / "d"))
    assert sum(p.stat().st_size for p in (tmp_path / "d").rglob("*.parquet")) < 50 * 20000


def test_texts_of_mentions_are_shuffled_once_as_they_came(spark):
    """what is parsed of a text is neither written nor shuffled; names and words with either small sigma meet."""
    import random
    import re

    from pyspark.sql import functions as F

    from attestry.functions.text import visible_text
    from attestry.operators.mentions import mentions
    from attestry.operators.names import parsed, word_key, word_keys

    names = spark.createDataFrame([(1, "Quorra Vell", "person"), (2, "Zorptek", "company"), (3, "ΝΙΚΟΣ", "company"), (4, "Nobody Else", "person"), (5, None, "person"), (6, "++", "company")], "name_id int, name string, entity_type string")
    texts = spark.createDataFrame([(7, "Mr Quorra Vell said. Zorptek publishes. Quorra Vell"), (8, "Nobody"), (9, None), (10, "ΝΙΚΟΣ. νικος"), (None, "Zorptek")], "text_id int, text string")
    found = mentions(names, texts)
    assert sorted(map(tuple, found.collect())) == [(7, 1, 3, 14), (7, 1, 40, 51), (7, 2, 21, 28), (10, 3, 0, 5)]
    plan = _plan(found).split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert "mention-texts" not in plan and ["ReusedExchange" in line for line in shuffles].count(False) == 1 and len(shuffles) == 2, shuffles

    r, odd = random.Random(3), ["a", "B", "Σ", "ς", "σ", "Ά", "İ", "'", "’", ".", " ", "\n", "-", "\xad", "\u0301", "1", "É", "Ⓐ"]
    rows = ["".join(r.choice(odd) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    d = parsed(spark.createDataFrame([(t,) for t in rows], "text string"), F.col("text"))
    got = d.select("text", F.transform("__name_tok", word_key).alias("w"), word_keys(visible_text(F.col("text"))).alias("k")).collect()
    assert [ascii(x.text) for x in got if set(x.w) - {""} != set(x.k)] == [] and re.search("ς", "".join(rows))


def test_an_allowed_name_meets_the_mentions_in_its_own_texts(spark):
    """allowed names are joined with mentions by text and name: by the name alone each claim would meet every text of the corpus."""
    import re

    from attestry.operators.mentions import require_mention

    proofs = spark.createDataFrame([(1, 10, 0, 20), (2, 10, 5, 20), (3, 11, 0, 20), (3, 12, 0, 20), (4, 12, 0, 20), (5, 13, 0, 20), (6, 10, 0, 20), (None, 10, 0, 20)], "claim_id int, text_id int, start long, end long")
    allowed = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (5, 1), (None, 1)], "claim_id int, name_id int")
    found = spark.createDataFrame([(10, 1, 0, 9), (11, 2, 0, 9), (12, 1, 3, 20), (13, 1, 12, 21), (13, 2, 0, 3)], "text_id int, name_id int, start long, end long")
    ok, bad = require_mention(proofs, allowed, found)
    assert sorted(r.claim_id for r in ok.collect()) == [1, 3, 3, 4]
    assert {r.claim_id for r in bad.collect()} == {2, 5, 6, None}
    assert not re.search(r"Join \[name_id#\d+\], \[name_id#\d+\]", _plan(ok) + _plan(bad))
