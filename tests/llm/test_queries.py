from __future__ import annotations

import pytest

from attestry.llm import queries
from tests.compare import both


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert ours == theirs
