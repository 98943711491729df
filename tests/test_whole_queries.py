"""Queries that once read or kept a part of their rows only."""

from compare import same_rows

from tidewell import catalog
from tidewell.operators import crawl


def test_frontier_level_cap(spark, duck, data_dir, tmp_path):
    spark.range(60).selectExpr("id AS page_id", "concat('https://h', id, '.com/a') AS url", "'' AS html").write.parquet(str(tmp_path / "pages.parquet"))
    assert catalog.QUERIES["frontier_level_cap"](spark, str(tmp_path)).count() == 60
    whole = f"WITH {catalog._PRIO} SELECT url, priority, page_id AS seq FROM pr WHERE priority >= 0 QUALIFY row_number() OVER (PARTITION BY priority ORDER BY page_id) <= 500000"
    same_rows(catalog.QUERIES["frontier_level_cap"](spark, data_dir), duck.sql(whole))


def test_level_cap_itself(spark):
    f = spark.range(500_003).selectExpr("concat('u', id) AS url", "IF(id < 2, 1, 3) AS priority", "id AS seq")
    got = crawl.capped_by_level(f).groupBy("priority").agg({"seq": "max", "*": "count"})
    assert {tuple(r[c] for c in ("priority", "count(1)", "max(seq)")) for r in got.collect()} == {(1, 2, 1), (3, 500_000, 500_001)}


def test_old_link_limits(spark, duck, data_dir, tmp_path):
    own, far = [f"/p{k}" for k in range(5)], [f"https://h{k}.org/x" for k in range(9)]
    page = lambda *links: "".join(f'<a href="{x}">t</a>' for x in links)
    rows = [(21, "https://s.com/1", page(*own, *far)), (41, "https://s.com/2", page(own[0], "/login", own[1])), (42, "https://s.com/3", "none")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["old_link_limits"](spark, str(tmp_path)).collect()
    want = [(21, k, f"https://s.com/p{k}") for k in range(3)] + [(21, 5 + k, u) for k, u in enumerate(far[:5])] + [(41, 0, "https://s.com/p0"), (41, 2, "https://s.com/p1")]
    assert sorted(map(tuple, got)) == want
    whole = f"""WITH {catalog._LINKS}, j AS (SELECT page_id, no, page_url, regexp_replace({catalog._JOINED}, '/$', '') AS url FROM l),
        a AS (SELECT page_id, no, url, {catalog._OWN} = {catalog._OWN.replace("(url", "(page_url")} AS own FROM j WHERE {catalog._LIKED}),
        b AS (SELECT * FROM a QUALIFY NOT own OR row_number() OVER (PARTITION BY page_id, own ORDER BY no) <= 3)
        SELECT page_id, no, url FROM b QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY no) <= 8"""
    same_rows(catalog.QUERIES["old_link_limits"](spark, data_dir), duck.sql(whole))


def test_rank_loss(spark, duck, data_dir, tmp_path):
    spark.createDataFrame([(k, "en", 1000 - k) for k in range(300)], "doc_id long, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(300)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["rank_loss"](spark, str(tmp_path)).collect()] == [("en", 0.0)]  # judged and actual ranks agree
    whole = f"""WITH {catalog._QRELS}, r AS (SELECT lang AS query, doc_id::VARCHAR AS url, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id::VARCHAR) AS actual FROM documents)
        SELECT qr.query, sum(pow(qr.rank - coalesce(actual, 100), 2)) AS loss FROM qr LEFT JOIN r USING (query, url) GROUP BY qr.query"""
    same_rows(catalog.QUERIES["rank_loss"](spark, data_dir), duck.sql(whole))
