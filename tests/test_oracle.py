import pytest
from oracle import SF, same

from lodestone import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        same(df, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0
