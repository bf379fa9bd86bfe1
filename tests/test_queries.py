"""Every registered query against its SQL on the smallest tables."""

import harness
import pytest

from capsule.catalog import QUERIES, Tables


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, root, con):
    q = QUERIES[name]
    df = q.run(Tables(spark, root))
    if q.sql is None:
        assert df.count() > 0
    else:
        assert harness.compare(df, con, q.sql) == []
