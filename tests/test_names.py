"""Whole names: literal cases of the rule, then a port over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

CASES = [
    ("C Corp develops tools.", "C++", "company", False), ("Yahoo! développe des services.", "Yahoo!", "company", True), ("Acme Inc. développe des services.", "Acme Inc.", "company", True),
    (".NET Foundation publie.", ".NET Foundation", "company", True), ("Mega Acme SAS développe des outils.", "Acme SAS", "company", False),
    ("Mega Group Acme SAS développe des outils.", "Acme SAS", "company", False), ("Mega The Group Acme SAS développe.", "Acme SAS", "company", False), ("The Group Acme SAS développe.", "Acme SAS", "company", True),
    ("Acme", "Acme", "company", True), ("Acme publie ses résultats.", "Acme", "company", True), ("Acme Logistics publie.", "Acme", "company", False), ("Acme Solutions SAS publie.", "Acme", "company", False),
    ("Acme SAS publie.", "Acme", "company", False), ("Acme Inc. publie.", "Acme", "company", False), ("Acme SAS Solutions publie.", "Acme", "company", False), ("Acme & Logistics SAS publie.", "Acme", "company", False),
    ("Acme + logistics SAS publie.", "Acme", "company", False), ("Acme / Logistics publie.", "Acme", "company", False), ("acme logistics sas publie.", "Acme", "company", False),
    ("Acme solutions SAS publie.", "Acme", "company", False), ("Acme et Fils SAS publie.", "Acme", "company", False), ("Acme and Logistics SAS publishes.", "Acme", "company", False),
    ("acme logistics", "Acme", "company", False), ("acme logistics publie.", "Acme", "company", False), ("acme works employs 100 people.", "Acme", "company", False), ("aCME works employs 100 people.", "Acme", "company", False),
    ("Acme works employs 100 people.", "Acme", "company", False), ("nova labs works employs 100 people.", "Nova Labs", "company", False), ("Acme works Ltd employs 100 people.", "Acme", "company", False),
    ("Acme designs SAS manufactures aircraft.", "Acme", "company", False), ("Acme works & Sons Ltd employs people.", "Acme", "company", False), ("Acme works and Sons Ltd employs people.", "Acme", "company", False),
    ("Acme works-global Systems Ltd employs people.", "Acme", "company", False), ("Acme works global advanced integrated systems Ltd employs people.", "Acme", "company", False),
    ("Acme works group employs people.", "Acme", "company", False), ("Nova Labs works global advanced integrated systems Ltd employs people.", "Nova Labs", "company", False),
    ("Acme développe des logiciels.", "Acme", "company", True), ("Acme publishes its results.", "Acme", "company", True), ("Acme est un groupe industriel.", "Acme", "company", True), ("Acme a publié ses résultats.", "Acme", "company", True),
    ("Acme exploite un établissement.", "Acme", "company", True), ("Acme designs aircraft.", "Acme", "company", True), ("Acme manufactures equipment.", "Acme", "company", True), ("Acme delivered aircraft.", "Acme", "company", True),
    ("Acme employed 250 people.", "Acme", "company", True), ("ACME exerce une activité industrielle.", "Acme", "company", True), ("Jo Ann Lee travaille à Paris.", "Ann Lee", "person", False), ("jo Ann Lee travaille à Paris.", "Ann Lee", "person", False),
    ("Non-Acme SAS travaille à Paris.", "Acme SAS", "company", False), ("Profil : Ann Lee, CEO.", "Ann Lee", "person", True),
    # persons and companies whose name is a part of another's
    ("With Thomas Martin", "Thomas Martin", "person", True), ("Thomas Martin de Villiers", "Thomas Martin", "person", False), ("Jean de Thomas Martin", "Thomas Martin", "person", False),
    ("Orange Group announces", "Orange", "company", False), ("Orange County sells land", "Orange", "company", False), ("Big Orange announces", "Orange", "company", False), ("Orange et Fils vend", "Orange", "company", False),
    ("Profile de Thomas Martin", "Thomas Martin", "person", True), ("Our president Thomas Martin said", "Thomas Martin", "person", True), ("Anna president Thomas Martin said", "Thomas Martin", "person", False),
    ("Dr. Thomas Martin", "Thomas Martin", "person", True), ("Thomas Martin-CEO", "Thomas Martin", "person", True), ("Thomas Martin-Smith", "Thomas Martin", "person", False), ("Thomas Martin's shop", "Thomas Martin", "person", True),
    ("thomas martin said", "Thomas Martin", "person", True), ("Thomas Martin Last updated", "Thomas Martin", "person", True), ("Thomas Martin\nSmith", "Thomas Martin", "person", False), ("Thomas, Martin", "Thomas Martin", "person", False),
    ("THOMAS MARTIN", "Thomas Martin", "person", True), ("Thomas-Martin said", "Thomas Martin", "person", False), ("Jean-Luc Roy. He", "Jean‑Luc Roy", "person", True), ("Véll", "Vell", "person", False),
    ("", "Acme", "company", False), (None, "Acme", "company", False), ("Acme", None, "company", False), ("Acme", "", "company", False), ("Acme", "++", "company", False), ("Acme", "Acme", None, True),
]


def test_cases(spark):
    from attestry.operators.names import with_named

    d = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, text string, name string, kind string, want boolean")
    got = {r.i: r.got for r in with_named(d, F.col("text"), F.col("name"), F.col("kind"), "got").collect()}
    assert [CASES[i] for i in sorted(got) if got[i] != CASES[i][3]] == []
    assert len(got) == len(CASES)


def test_ranges_are_places_of_the_visible_text(spark):
    from attestry.operators.names import with_mentions

    rows = [("By Ann Lee, et\u00a0 Ann Lee; Jo Ann Lee. ANN LEE", "Ann Lee", "person"), ("x.\n.NET Foundation publie. .NET Foundation est", ".NET Foundation", "company")]
    d = spark.createDataFrame(rows, "text string, name string, kind string")
    got = [[(m.start, m.end) for m in r.m] for r in with_mentions(d, F.col("text"), F.col("name"), F.col("kind"), "m").collect()]
    assert got == [[(3, 10), (15, 22), (36, 43)], [(3, 18), (27, 42)]]


def test_a_long_text_is_not_copied_for_each_start(spark):
    """slice() in a lambda copies the whole list for each start: words are compared one by one."""
    from pyspark.sql import functions as F

    from attestry.functions.text import sequence_starts

    words = ["a", "b"] * 30_000 + ["a", "b", "c"]
    rows = [(0, words, ["a", "b", "c"]), (1, words[:5], ["a", "b"]), (2, ["a", "a", "a"], ["a", "a"]), (3, ["a"], ["a", "b"]), (4, ["a"], []), (5, None, ["a"]), (6, ["a", None, "b"], [None, "b"]), (7, ["a"], None)]
    d = spark.createDataFrame(rows, "i int, h array<string>, w array<string>").select("i", sequence_starts(F.col("h"), F.col("w")).alias("at"))
    assert "slice" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: r.at for r in d.collect()} == {0: [60_000], 1: [0, 2], 2: [0, 1], 3: [], 4: [], 5: [], 6: [1], 7: []}


def test_the_rule_of_names_stands_once_in_the_plan_of_mentions(spark):
    from attestry.operators.mentions import mentions

    names = spark.createDataFrame([(1, "Quorra Vell", "person")], "name_id int, name string, entity_type string")
    texts = spark.createDataFrame([(7, "Mr Quorra Vell said. Anna Quorra Vell. " + "word " * 500 + ". Quorra Vell"), (8, "Nobody"), (9, None)], "text_id int, text string")
    found = mentions(names, texts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("biographie") == 1
    assert sorted(map(tuple, found.collect())) == [(7, 1, 3, 14), (7, 1, 2541, 2552)]
