"""Every query of the library over the smallest tables, against DuckDB where it has SQL."""

import pytest
from compare import same_rows

from tidewell import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data_dir, name):
    df = catalog.QUERIES[name](spark, data_dir)
    if name in catalog.SQL:
        same_rows(df, duck.sql(catalog.SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
