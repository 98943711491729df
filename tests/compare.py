"""Comparison of Spark rows with DuckDB's."""


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def same_rows(df, relation):
    """Asserts that a DataFrame and a DuckDB result have the same columns and rows, in any order."""
    rows, cols = df.collect(), df.columns
    others = [d[0] for d in relation.description]
    assert sorted(cols) == sorted(others)
    order = sorted(cols)
    a = sorted(repr(tuple(plain(r[cols.index(c)]) for c in order)) for r in rows)
    b = sorted(repr(tuple(plain(r[others.index(c)]) for c in order)) for r in relation.fetchall())
    assert a == b
