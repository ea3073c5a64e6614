"""Every query with SQL gives the rows of that SQL; the others run."""

import pytest

from answerloom import catalog
from tests.conftest import SF, same

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.oracle_sql():
        assert same(rows, df.columns, duck.execute(catalog.oracle_sql()[name]))
