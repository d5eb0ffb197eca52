"""Every registered query of the catalogue gives the rows of its SQL; those without SQL are held against plain Python elsewhere."""

import pytest

from sediment.plans import catalogue

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
