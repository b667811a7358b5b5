"""Run a query and its SQL side by side on one folder of tables."""

from __future__ import annotations

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def both(spark, query, sql: str, sf: str = SF):
    df = query(spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = db.sql(sql)
    names = got.columns
    assert sorted(names) == cols
    return ours, sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
