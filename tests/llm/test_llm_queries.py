"""Every query of the folder over the smallest tables, against DuckDB where it has SQL."""

import pytest
from compare import same_rows

from tidewell.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data_dir, name):
    df = catalog.QUERIES[name](spark, data_dir)
    if name in catalog.SQL:
        same_rows(df, duck.sql(catalog.SQL[name]))
    else:
        assert df.count() > 0 or name == "op10_secret_scan"  # the smallest tables hold no credential; test_secret_words has a table that does


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
