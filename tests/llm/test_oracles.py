"""Every registered query that SQL can say gives the rows of its SQL."""

import pytest

from sediment.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
