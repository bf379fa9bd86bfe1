"""The queries that have SQL, against it."""

import harness
import pytest

from capsule.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(name, spark, root, con):
    assert harness.compare(queries.QUERIES[name](spark, root), con, queries.SQL[name]) == []
