"""Proposals rung by rung, and the receipt sink under replays."""

from __future__ import annotations

import glob
import json

CLAIM = {
    "subjectKey": "k0", "category": "activity", "entityType": "company", "predicate": "sells", "scopeType": "company", "scopeLabel": None, "factPeriodLabel": None, "factDate": None, "normalizedValue": None, "unit": None,
    "currency": None, "contradictionKey": None, "sourceUrl": "https://example.com/a", "excerpt": " It sells. ", "prefix": None, "suffix": "s" * 30,
}
KNOWN = {"city": "  Lyon ", "country": None, "industry": None, "employer": "", "officialSite": None, "legalIdentifier": None, "year": None}
CANDIDATE = {"candidateKey": " k0 ", "displayName": "é" * 200, "entityType": "company", "entityScope": "company", "discriminators": KNOWN, "sourceUrl": "https://example.com/a", "excerpt": "x" * 600, "prefix": None, "suffix": None}


def document(**more):
    return {"identityStatus": "resolved", "entityType": None, "candidates": [CANDIDATE], "claims": [CLAIM], "missingCategories": []} | more


def without(d, *names):
    return {k: v for k, v in d.items() if k not in names}


def test_rungs_bounds_and_missing(spark):
    from attestry.sources.proposals import ingest_documents

    bad_year = CANDIDATE | {"discriminators": KNOWN | {"year": "20"}}
    cases = {
        1: (document(), "strict", 1, 1, False, []), 2: (document(claims=[without(CLAIM, "unit", "prefix")]), "defaults", 1, 1, False, []), 3: (document(claims=[without(CLAIM, "excerpt")]), "rejected", 0, 0, False, None),
        4: ("{", "rejected", 0, 0, False, None), 5: (None, "rejected", 0, 0, False, None), 6: ("", "rejected", 0, 0, False, None), 7: ("[]", "rejected", 0, 0, False, None), 8: (document(identityStatus="sure"), "rejected", 0, 0, False, None),
        9: (document(claims=[CLAIM | {"unit": 5}]), "rejected", 0, 0, False, None), 10: (document(claims=[CLAIM] * 8), "strict", 1, 6, True, ["other"]), 11: (document(candidates=[bad_year, CANDIDATE]), "strict", 1, 1, True, ["other"]),
        12: (document(claims=[CLAIM | {"factDate": "99"}, CLAIM | {"sourceUrl": "nowhere"}, CLAIM | {"subjectKey": "K"}, CLAIM | {"predicate": " "}, CLAIM | {"excerpt": " "}], missingCategories=["role", "role"]), "strict", 1, 0, True, ["other", "role"]),
        13: (without(document(), "candidates", "missingCategories"), "defaults", 0, 1, False, []), 14: (document(candidates="none"), "rejected", 0, 0, False, None), 15: (document(candidates=[CANDIDATE | {"discriminators": {"city": "Lyon"}}]), "rejected", 0, 0, False, None),
        16: (document(missingCategories=["identity", "activity", "role", "geography", "metric", "event", "recent_signal", "role"], claims=[CLAIM] * 7), "strict", 1, 6, True, ["activity", "event", "geography", "identity", "metric", "other", "recent_signal", "role"]),
        17: (document(missingCategories=["unheard"]), "rejected", 0, 0, False, None), 18: (document(claims=[CLAIM | {"excerpt": None}]), "rejected", 0, 0, False, None), 19: (document(candidates=[], claims=[]), "strict", 0, 0, False, []),
    }
    d = spark.createDataFrame([(k, v[0] if v[0] is None or isinstance(v[0], str) else json.dumps(v[0])) for k, v in cases.items()], "request_id long, json string")
    docs, candidates, facts, missing = ingest_documents(d)
    named: dict = {}
    for r in missing.collect():
        named.setdefault(r.request_id, []).append(r.category)
    got = {r.request_id: (r.rung, r.n_candidates, r.n_facts, r.dropped, sorted(named.get(r.request_id, [])) if r.rung != "rejected" else None) for r in docs.collect()}
    assert {k: v for k, v in got.items() if v != cases[k][1:]} == {} and len(got) == len(cases)
    c = candidates.where("request_id = 1").first()
    assert (c.candidate_key, len(c.display_name), len(c.excerpt), c.discriminators.city, c.discriminators.employer) == ("k0", 160, 500, "Lyon", None)
    f = facts.where("request_id = 1").first()
    assert (f.excerpt, len(f.suffix), f.scope_label) == ("It sells.", 16, None)


def test_receipts_are_kept_once(spark, tmp_path):
    """A replayed batch leaves the same files, one that broke off is written anew, and a stream's receipts are those of the table."""
    from attestry.sources.ingest import receipts, sink_receipts, write_receipts

    rows = [(i, "completed", "secret name", f"req-{i}") for i in range(20)]
    schema = "run_id long, status string, name string, provider_request_id string"
    d = spark.createDataFrame(rows, schema)
    assert receipts(d).columns == ["run_id", "status", "request_digest"]
    at = f"{tmp_path}/kept"
    assert write_receipts(d.where("run_id < 10"), at, 0)
    before = sorted(glob.glob(f"{at}/*/part-*"))
    assert not write_receipts(d.where("run_id < 10"), at, 0) and sorted(glob.glob(f"{at}/*/part-*")) == before
    (tmp_path / "kept" / "batch=0" / "_SUCCESS").unlink()
    assert write_receipts(d.where("run_id < 10"), at, 0) and spark.read.parquet(at).count() == 10
    for i in range(2):
        d.where(f"run_id % 2 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    for checkpoint in ("one", "two"):  # the second checkpoint replays every batch
        q = sink_receipts(source(), f"{tmp_path}/sink", f"{tmp_path}/{checkpoint}")
        q.processAllAvailable()
        q.stop()
        got = sorted((r.run_id, r.status, r.request_digest) for r in spark.read.parquet(f"{tmp_path}/sink").collect())
        assert got == sorted(map(tuple, receipts(d).collect()))
