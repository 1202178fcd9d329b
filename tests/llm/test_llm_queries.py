"""Every query of the training-data problems against its SQL."""

import pytest
from compare import connect, same_rows

from tallyframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLES:
        same_rows(df, connect(sf), queries.ORACLES[name])
    else:
        assert df.count() > 0
