"""Each text operator against brute force, the library it must equal, an exact round trip or held-out labels."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
R = random.Random(5)
PASSAGES = [" ".join(R.choice(["the", "of", "ab", "x" * 60, "日本語テキスト", "and", "é", "ünder"]) + str(R.randint(0, 99)) for _ in range(R.randint(8, 40))) for _ in range(8)] + ["z" * 200]
EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "a"), (904, "one two three"), (None, PASSAGES[0]), (None, None), (905, "a" * 49), (906, "a" * 50), (907, "long " * 30_000)]


def rows():
    out = [(i, "".join(R.choice([R.choice(PASSAGES), " ", str(R.random()), "\n"]) for _ in range(R.randint(0, 7)))) for i in range(80)]
    return [*out, *[(i + 100, t) for i, t in out[:20]], (3, out[3][1]), *EDGE]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, copies, a repeated row, and columns whose names clash with results."""
    d = spark.createDataFrame([(i, t, "src", 7, None) for i, t in rows()], "doc_id long, text string, kept string, n_words int, th string")
    return d.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts_equal_the_unigram_tokenizer(docs, empty):
    from tokenizers.models import Unigram

    from attestry.llm import pieces
    from attestry.llm.tokencount import token_counts

    v = pieces.parse(open(pieces.default_path(), "rb").read())
    library = Unigram(list(zip(v.pieces, map(float, v.scores))), v.unk, True)  # the same pieces and scores, byte fallback
    got = token_counts(docs).collect()
    assert len(got) == docs.count() and got[0].kept == "src"
    for r in got:
        assert r.n_tokens == (len(library.tokenize(pieces.escaped(r.text))) if r.text else 0)
    assert token_counts(empty).count() == 0


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece

    from attestry.llm.pieces import default_path
    from attestry.llm.spm import encode_decode

    library = sentencepiece.SentencePieceProcessor(model_file=default_path())
    for r in encode_decode(docs).collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert encode_decode(empty).count() == 0


def test_near_duplicates_by_brute_force(spark, docs, empty):
    from attestry.llm.jaccard import near_duplicates

    base = [" ".join(f"w{R.randint(0, 999)}" for _ in range(80)) for _ in range(6)]
    more = []
    for i in range(60):
        w = R.choice(base).split()
        for _ in range(R.choice([0, 1, 2, 3, 5])):
            w[R.randrange(len(w))] = f"q{R.randint(0, 999)}"
        more.append((1000 + i, " ".join(w)))
    d = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    texts: dict[str, int] = {}
    for k, t in [(r.doc_id, r.text or "") for r in d.collect() if r.doc_id is not None]:
        texts[t] = min(k, texts.get(t, k))
    grams = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in texts if (w := t.split()) or True}
    grams = {t: (g if t.split() else set()) for t, g in grams.items()}
    links = {t: [u for u in texts if u != t and grams[t] and grams[u] and 5 * len(grams[t] & grams[u]) >= 4 * len(grams[t] | grams[u])] for t in texts}
    root = {t: k for t, k in texts.items()}
    for _ in texts:
        root = {t: min([root[t], *(root[u] for u in links[t])]) for t in texts}
    counts = Counter((r.text or "") for r in d.collect() if r.doc_id is not None)
    for bucket in (1024, 4):  # small buckets: every level and the blocks are used
        got = {(r.doc_id): (r.class_id, r.n_links, r.n_copies) for r in near_duplicates(d, bucket=bucket, runs=16).collect() if r.doc_id is not None}
        want = {r.doc_id: (root[r.text or ""], len(links[r.text or ""]), counts[r.text or ""]) for r in d.collect() if r.doc_id is not None}
        assert got == want
    assert near_duplicates(empty).count() == 0


def brute_bytes(data, size=50):
    first: dict = {}
    for k, t in data:
        b = (t or "").encode()
        for i in range(len(b) - size + 1 if k is not None else 0):
            first[b[i : i + size]] = min(k, first.get(b[i : i + size], k))
    out = {}
    for k, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1 if k is not None else 0):
            if first[b[i : i + size]] < k:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[k, t] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_byte_repeats_by_brute_force(docs, empty):
    from attestry.llm.suffix import remove_repeats

    small = docs.where("doc_id is null or doc_id <> 907")
    want = brute_bytes([(r.doc_id, r.text) for r in small.collect()])
    for chunk in (300, 1_500_000):
        for r in remove_repeats(small, per_chunk=chunk, columns=["doc_id", "text"]).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id, r.text]
    assert remove_repeats(empty).count() == 0


def test_byte_repeats_of_hot_leads_by_brute_force(spark, docs, monkeypatch):
    """A passage in every text, whose contexts differ: no task gets the group of one lead, and results are the same."""
    from attestry.llm import suffix

    common = "The quick report of the committee says that nothing was found here"
    more = [(2000 + i, f"{R.random()} {R.choice(['', 'a b '])}{common}{R.choice(['', ' at all'])} {R.random()}" * R.randint(1, 2)) for i in range(400)]
    d = docs.where("doc_id is null or doc_id <> 907").select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string")).repartition(3).cache()
    want = brute_bytes([(r.doc_id, r.text) for r in d.collect()])
    sizes = []
    leads = suffix.hot_leads
    monkeypatch.setattr(suffix, "hot_leads", lambda *a: sizes.append(len(found := leads(*a))) or found)
    for hot in (2, 100):
        got = suffix.remove_repeats(d, columns=["doc_id", "text"], hot=hot).collect()
        assert len(got) == d.count()
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id, r.text]
    assert sizes[0] > sizes[1] > 0


def test_word_repeats_of_words_that_defeat_power_hashes(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo any power of two; here they are different words."""
    from attestry.llm.substring import remove_repeats

    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    first, second = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    lead = " ".join(f"w{i}" for i in range(19))
    d = spark.createDataFrame([(1, f"{lead} {first}"), (2, f"{lead} {second}"), (3, f"{lead} other"), (4, f"{lead} {second}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(d).collect()} == {1: 0, 2: 0, 3: 0, 4: 20}


def test_word_repeats_by_brute_force(docs, empty):
    from attestry.llm.substring import remove_repeats

    data = [(r.doc_id, r.text) for r in docs.collect()]
    first: dict = {}
    for k, t in data:
        w = (t or "").encode().split()
        for i in range(len(w) - 19 if k is not None else 0):
            g = tuple(w[i : i + 20])
            first[g] = min((k, i), first.get(g, (k, i)))
    for chunk in (300, 2_000_000):
        got = remove_repeats(docs, joined=True, per_chunk=chunk, columns=["doc_id", "text"]).collect()
        assert len(got) == len(data)
        for r in got:
            w = (r.text or "").encode().split()
            gone = [False] * len(w)
            for i in range(len(w) - 19 if r.doc_id is not None else 0):
                if first[tuple(w[i : i + 20])] < (r.doc_id, i):
                    gone[i : i + 20] = [True] * 20
            assert (r.n_words, r.n_removed) == (len(w), sum(gone))
            assert r.kept.encode() == b" ".join(x for x, g in zip(w, gone) if not g)
    assert remove_repeats(empty).count() == 0


def test_decontamination_finds_edited_passages(spark, docs, empty):
    from attestry.llm.decontam import contaminated

    items = spark.createDataFrame([(i, " ".join(f"v{i}x{j}" for j in range(14 + 3 * i))) for i in range(12)] + [(50, None), (51, ""), (52, "solo")], "item_id long, text string")
    planted = []
    for r in items.where("item_id < 12").collect():
        for e in range(6):
            w = r.text.split()
            for _ in range(int(0.2 * len(w)) * e // 5):
                p = R.randrange(len(w))
                w[p : p + 1] = R.choice([[], ["new"], [w[p], "more"]])
            planted.append((10_000 + r.item_id * 10 + e, "Some lead words. " + " ".join(w).upper() + ", and an end"))
    d = docs.select("doc_id", "text").unionAll(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(d, items).collect()}
    want = {(k, (k - 10_000) // 10) for k, _ in planted}
    assert len(want & got.keys()) >= 0.97 * len(want) and got.keys() <= want
    assert all(got[k] == 0 for k in got if k[0] % 10 == 0)
    assert contaminated(empty, items).count() == 0 and contaminated(d, items.limit(0)).count() == 0


def edit_table(pattern, text):
    """Least edits from pattern to any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_decontamination_equals_an_edit_search(spark):
    """Short items, long ones and clashing columns against the plain table of edits, over all pairs."""
    from attestry.llm.decontam import contaminated, decontaminate

    r = random.Random(3)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 6)) for _ in range(n)] for n in (6, 9, 15, 30, 60, 130)]
    docs = [(i, " ".join(r.choice(base)[: r.randint(3, 140)] + [f"z{r.randint(0, 99)}" for _ in range(r.randint(0, 9))])) for i in range(60)]
    for i in range(60, 120):
        w = list(r.choice(base))
        for _ in range(r.randint(0, len(w) // 4)):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice([[], ["new"], [w[p], "more"]])
        docs.append((i, " ".join(["lead"] * r.randint(0, 5) + w + ["end"] * r.randint(0, 5))))
    docs += [(200, None), (201, ""), (None, docs[60][1]), (60, docs[60][1]), (202, "word " * 30_000 + docs[70][1])]
    items = spark.createDataFrame([(i, " ".join(b), 1) for i, b in enumerate(base)], "doc_id long, text string, distance int")
    d = spark.createDataFrame([(k, t, 2, "x") for k, t in docs], "doc_id long, text string, start_word int, __k string")
    got = Counter((x.doc_id, x.doc_id_item, x.distance) for x in contaminated(d, items, item_key="doc_id", recall=0.999).collect())
    want = Counter((k, i, e) for k, t in docs if k != 202 for i, b in enumerate(base) if (e := edit_table(b, (t or "").split())) <= int(0.2 * len(b)))
    assert Counter({x: n for x, n in got.items() if x[0] != 202}) == want and sum(want.values()) > 60
    assert {x[1:] for x in got if x[0] == 202} == {x[1:] for x in got if x[0] == 70}
    left = decontaminate(d, items, item_key="doc_id")
    assert left.columns == d.columns and {x.doc_id for x in left.collect()} == {k for k, _ in docs} - {x[0] for x in got if x[0] is not None}


@pytest.mark.parametrize("n, edits, within", [(40, 8, 40), (36, 7, 36), (63, 12, 56), (400, 80, 400), (400, 60, 128), (600, 110, 128)])
def test_decontamination_recall(n, edits, within):
    """Share of edited passages found, edits spread over the whole item or crowded at its start."""
    from attestry.llm.decontam import Index, walks_for
    from attestry.llm.wordhash import spans, word_hashes

    r, trials, found = random.Random(n + edits), 100, 0
    walks = walks_for(0.2, 0.995)
    for x in range(trials):
        words = [f"w{r.randint(0, 3000)}" for _ in range(n)]
        new = list(words)
        for _ in range(edits):
            p = r.randrange(min(within, len(new)))
            new[p : p + 1] = r.choice([[], [f"q{r.randint(0, 3000)}"], [new[p], f"q{r.randint(0, 3000)}"]])
        raw = " ".join([f"w{r.randint(0, 3000)}" for _ in range(20)] + new + [f"w{r.randint(0, 3000)}" for _ in range(20)]).encode()
        index = Index([(1, " ".join(words))], 0.2, walks)
        h = word_hashes(raw, *spans(raw))
        found += any(index.verified(h, item, starts) for (_, item), starts in index.candidates([h]).items())
    assert found >= 0.98 * trials


def test_quality_ledger_and_ablations(docs, empty):
    from attestry.llm.quality import RULES, STANDARD, ablations, apply_policy, ledger, measure

    assert measure("a b c a b c\n\n a b c a b c\nx") [:6] == (13, 13, 0, 0, 3, 12)
    assert measure("line\nline\n \n") [3:5] == (1, 2) and measure(None) == (0,) * 8 and measure(" #\n")[2] == 1
    got = apply_policy(ledger(docs, keep=[F.col("doc_id"), F.col("text")]), STANDARD)
    table = got.collect()
    assert len(table) == docs.count() and all(r.kept == (r.failed_bits & STANDARD.mask == 0) for r in table)
    assert sorted(map(tuple, (r for r in table if r.doc_id == 3)), key=repr)[0] == sorted(map(tuple, (r for r in table if r.doc_id == 3)), key=repr)[1]  # a repeated row
    for a in ablations(got, STANDARD).collect():
        bit = 1 << next(r.bit for r in RULES if r.name == a.rule)
        assert a.n_failed == sum(bool(r.failed_bits & bit) for r in table) and a.n_only == sum(r.failed_bits & STANDARD.mask == bit for r in table)
    assert ledger(empty).count() == 0


def test_quality_query_keeps_clean_long_texts(spark, tmp_path):
    from attestry.llm.queries import op10_quality_rules

    r = random.Random(11)
    long = " ".join(f"word{r.randrange(6_000)}" for _ in range(100_000))
    spark.createDataFrame([(1, long), (2, "again and again " * 100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.kept for r in op10_quality_rules(spark, str(tmp_path)).collect()} == {1: True, 2: False}


def test_language_id_on_held_out(spark, docs, empty):
    from attestry.llm.langid import fit, identify
    from attestry.llm.queries import op3_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_language_id(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    model = fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in identify(docs, model).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert identify(empty, model).count() == 0
    none = fit(spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    from attestry.llm.toxicity import Lexicon, Matcher, fit, readings, toxicity

    m = Matcher(Lexicon({"idiot": 5.0, "ciown": 4.0}, {"disgusti": 2.0}, ["ciown fish"], [-1.0, 0.1], [0.0, 1.0]))
    hits = {"You IDIOT!": 1, "1d10t": 1, "ïdíot": 1, "іdiоt": 1, "idi­ot": 1, "idiotic": 0, "a clown": 1, "a clown fish": 0, "disgusting": 1, None: 0, "": 0, "...": 0}
    assert {t: m.density(t)[1] for t in hits} == hits and readings(None) == " "
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = fit(d, labels.where("doc_id % 2 = 0"))
    held = toxicity(d, lexicon).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    assert toxicity(docs, lexicon).count() == docs.count() and toxicity(empty, lexicon).count() == 0
    assert {r.score for r in toxicity(docs, fit(d, labels.limit(0))).collect()} == {0.0}


def test_warc_round_trip(spark, tmp_path):
    from attestry.llm.warc import page_records, read_archives, write_archives

    big = "é" * 900
    pages = spark.createDataFrame([(1, "https://a/", big), (2, "https://b/", big), (3, None, None), (4, "https://d/\r\nX: y", "<p>\r\n\r\nWARC/1.1"), (5, "e", "x" * 999), (6, "f", "x" * 999), (None, "g", big), (1, "https://a/", big)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    write_archives(page_records(pages), path)
    got = read_archives(spark, path).where("record_type <> 'warcinfo'").collect()
    assert len(got) == 8
    kinds = Counter((r.record_type, r.record_id, r.refers_to) for r in got)
    assert kinds[("revisit", "<urn:page:1>", "<urn:page:2>")] == 2 and kinds[("revisit", None, "<urn:page:2>")] == 1 and kinds[("response", "<urn:page:2>", None)] == 1
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
    assert {bytes(r.payload) for r in got if r.record_id == "<urn:page:4>"} == {b"<p>\r\n\r\nWARC/1.1"}
    head = read_archives(spark, path, payload="false", recordtypes="revisit").collect()
    assert len(head) == 3 and all(r.payload is None for r in head)
    assert read_archives(spark, path).where("target_uri = 'https://b/'").count() == 1
    write_archives(page_records(pages.limit(0)), path + "-none")
    assert read_archives(spark, path + "-none").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    cols = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == cols, name
    last = p.STAGES[-1][1](spark, docs, SF).collect()
    assert last and all(r.round_trip for r in last)


def test_pipeline_stages_on_edge_rows(spark):
    """Null keys and texts, empty, very long, repeated rows and copies, clashing columns; each stage by brute force or by what it must keep."""
    import corpus_pipeline as p
    from attestry.llm.quality import measure

    r = random.Random(21)
    words = lambda n: " ".join(f"w{r.randrange(5_000)}" for _ in range(n))
    base = words(120)
    shared = words(40)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = [(1, base), (2, base), (3, base.replace("w1", "v1", 1)), (4, f"{words(80)} {shared} {words(30)}"), (5, f"{words(60)} {shared} {words(50)}"), (6, f"{words(60)} {item} {words(60)}"),
             (7, words(60_000)), (8, None), (9, ""), (10, "too short"), (None, words(70)), (None, None), (1, base), (11, "again " * 300)]
    d = spark.createDataFrame([(k, t, "en", "s", len(t or ""), True, 7, "x", "y") for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words int, th string, at string")
    after = {}
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, d.limit(0), SF).columns == d.columns
        d = p.written(stage(spark, d, SF), f"test-{name}")
        after[name] = [(x.doc_id, x.text) for x in d.collect()]
        assert len(d.columns) == 9 and all((x.kept, x.n_words, x.th, x.at) == (True, 7, "x", "y") for x in d.collect())
    bad = lambda t: (m := measure(t))[0] < 50 or 100 * m[5] > 50 * m[0]
    assert Counter(after["quality_rules"]) == Counter((k, t) for k, t in texts if not bad(t))
    assert Counter(k for k, _ in after["near_duplicates"]) == Counter([1, 1, 4, 5, 6, 7, None])
    cut = dict(after["substring_dedup"])
    assert shared in cut[4] and shared not in cut[5] and len(cut[5].split()) == 110 and cut[7] == dict(texts)[7]
    assert {k for k, _ in after["decontamination"]} == {1, 4, 5, 7, None}
    last = p.STAGES[-1][1](spark, d, SF).collect()
    assert len(last) == 6 and all(x.round_trip and x.n_tokens == len(x.token_ids) > 0 for x in last)


def test_pipeline_keeps_clean_long_texts(spark):
    """The share of distinct words falls with the length of a text: a long clean one is not removed for it."""
    from corpus_pipeline import quality_rules

    r = random.Random(11)
    long = " ".join(f"word{r.randrange(6_000)}" for _ in range(100_000))
    d = spark.createDataFrame([(1, long), (2, "again and again " * 100)], "doc_id long, text string")
    assert [x.doc_id for x in quality_rules(spark, d, SF).collect()] == [1]
