"""What Python holds of pages, links and positions doesn't grow with the rows of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import html
from tidewell.plans import rank


def page(k):
    return f"<title>Page {k}</title>" + "".join(f'<a href="/{k}/{j}">link {j}</a> some more words ' for j in range(60))


def pages(n):
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"https://h.com/{k}" for k in range(n)]), pa.array([page(k) for k in range(n)])], ["page_id", "url", "html"])


def peak(n):
    batch, rows = pages(n), 0
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    most = 0
    for out in html.parsed_batches(iter([batch])):
        rows, most = rows + len(out), max(most, pa.total_allocated_bytes() - before)
    most += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n
    return most


def test_parsed_memory():
    assert peak(6_000) < 1.5 * peak(1_500)


def test_parsed_rows(spark, monkeypatch):
    rows = [(k, f"https://h.com/{k}", page(k) if k % 5 else None) for k in range(50)] + [(50, None, "a <b> c")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(2)
    want = [(k, u, p.words, p.title_words, [tuple(x) for x in p.links], p.base) for k, u, h in rows for p in [html.parse(h)]]
    for size in (1, 5_000, 1 << 20):
        monkeypatch.setattr(html, "PARSED_BYTES", size)
        plain = [(r.page_id, r.url, r.words, r.title_words, [tuple(x) for x in r.links], r.base) for r in html.parse_pages(df).collect()]
        assert sorted(plain, key=lambda r: r[0]) == want
    links = html.parse_pages(df, ("links",))
    assert links.columns == ["page_id", "url", "links"] and links.selectExpr("sum(size(links))").first()[0] == 40 * 60
    assert "InPandas" not in links._jdf.queryExecution().executedPlan().toString()


def test_join_and_scores(spark):
    df = spark.createDataFrame([("https://a.com/b", "/c"), (None, "x"), ("https://a.com", None)], "base string, link string")
    joined = df.select(urls.url_join("base", "link").alias("u"))
    assert [r.u for r in joined.collect()] == ["https://a.com/c", None, None]
    rows = spark.range(300).select(F.col("id"), F.array(F.col("id"), F.col("id") + 7).alias("a"), F.array(F.col("id") + 2).alias("b"), F.array().cast("array<bigint>").alias("c"))
    scored = rows.select("id", rank.text_score([F.col("a"), F.col("b"), F.col("c")], F.lit(1)).alias("s"))
    none = np.array([], np.int64)
    for r in scored.collect():
        assert abs(r.s - rank.score([np.array([r.id, r.id + 7]), np.array([r.id + 2]), none], 1)) < 1e-12
