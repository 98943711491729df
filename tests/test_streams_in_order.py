"""Streams over tables whose files don't lie in the order of their rows."""

from compare import same_rows

from tidewell import catalog
from tidewell.streaming import crawl as stream


def backwards(spark, path, rows):
    """A table of many files, the last rows in the first of them."""
    for part in (rows[200:], rows[100:200], rows[:100]):
        spark.createDataFrame(part, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(path)


def test_stream_slots(spark, tmp_path):
    import duckdb

    backwards(spark, str(tmp_path / "pages.parquet"), [(k, f"https://h{k % 7}.com/{k}", "") for k in range(300)])
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(catalog.QUERIES["stream_slots"](spark, str(tmp_path)), duck.sql(catalog.SQL["stream_slots"]))


def test_in_order(spark, tmp_path):
    """Several micro-batches, each behind all lower ones."""
    rows = spark.range(1_000).selectExpr("id * 7919 % 1000 AS seq", "'x' AS url").repartition(5)
    seen = []
    stream.each_batch(stream.replayed_in_order(rows, "seq", 200), lambda df, _: seen.append(sorted(r.seq for r in df.collect())), str(tmp_path / "progress"))
    whole = [x for part in seen for x in part]
    assert len([part for part in seen if part]) > 3 and whole == list(range(1_000))
    none = stream.replayed_in_order(rows.limit(0), "seq")
    assert stream.stored_stream(none, str(tmp_path / "out"), str(tmp_path / "progress2")).count() == 0
