import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators import crawl, crawllog, evalrank, robots
from tidewell.sources import files
from tidewell.streaming import crawl as stream


def test_robots(spark):
    text = "User-agent: x\nDisallow: /a\nUser-agent: *\r\nDisallow: /b\nAllow: /b/c\nDisallow:\nSitemap: s\nUser-agent: y\nDisallow: /d\n"
    rules = robots.parse_robots(spark.createDataFrame([("h.com", text)], "host string, text string"))
    assert [(r.rule_no, r.allow, r.pattern) for r in rules.orderBy("rule_no").collect()] == [(1, False, "/b"), (2, True, "/b/c")]
    asked = ["https://h.com/b", "https://h.com/bb", "https://h.com/b/x", "https://h.com/b/c/d", "https://h.com/a", "https://h.com/d", "https://o.com/b", "https://h.com/"]
    got = robots.allowed(spark.createDataFrame([(u,) for u in asked], "url string"), rules)
    assert {r.url for r in got.collect() if not r.allowed} == {"https://h.com/b", "https://h.com/b/x"}


def test_pop_and_caps(spark):
    f = spark.createDataFrame([("a", 1, 0), ("b", 3, 2), ("c", 3, 1), ("d", 0, 0)], "url string, priority int, seq long")
    assert [r.url for r in crawl.pop(f, 3).collect()] == ["c", "b", "a"]
    assert {r.url for r in crawl.capped_by_level(f, 1).collect()} == {"a", "c", "d"}
    assert crawl.pop(f, 4, chance=0.6).count() == 4
    urls = spark.createDataFrame([(f"https://h.com/{k}",) for k in range(9)] + [("https://github.com/x",)], "url string")
    assert crawl.capped_by_host(urls, [F.col("url")]).count() == 6
    assert crawl.capped_by_host(urls, [F.col("url")], spark.createDataFrame([("h.com", 3)], "host string, n int")).count() == 3


def test_crawl_rounds(spark, tmp_path):
    page = lambda k, *links: (k, f"https://s.com/{k}", "".join(f'<a href="{x}">t</a>' for x in links))
    pages = spark.createDataFrame([page(1, "/2", "/3", "/login"), page(2, "/1", "/4"), page(3), page(4, "https://s.com/5/"), page(5)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("s.com", 1, False, "/3")], "host string, rule_no int, allow boolean, pattern string")
    seeds = spark.createDataFrame([("https://s.com/1",)], "url string")
    n = iter(range(100))

    def store(df):
        p = str(tmp_path / str(next(n)))
        df.write.parquet(p)
        return spark.read.parquet(p)

    met = crawl.crawl(seeds, pages, rules, 4, 10, store)
    assert {(r.page_id, r.round) for r in met.collect()} == {(1, 0), (2, 1), (4, 2), (5, 3)}


def test_log(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 100, 300, 301, 900)] + [("b", t0)]
    log = spark.createDataFrame(rows, "server string, ts timestamp")
    got = {(r.server, r.ts): r.rate for r in crawllog.trailing_rate(log).collect()}
    n = lambda k: k * 4095 / 300
    assert [round(got[x] - e, 9) for x, e in zip(rows, [n(2), n(3), n(4), n(3), n(1), n(2)], strict=True)] == [0] * 6
    last = {r.server: r for r in crawllog.last_rate(log, now_us=int((t0 + dt.timedelta(seconds=930)).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)).collect()}
    assert round(last["a"].rate, 6) == round(4095 / 599, 6) and last["b"].rate is None and last["b"].stale and not last["a"].stale
    assert crawllog.cumulative(log).agg(F.max("docs")).first()[0] == 6 * 4095


def test_descend():
    at = evalrank.descend(lambda w: (w[0] - 3) ** 2 + (w[1] + 1) ** 2, [0.0, 0.0], rate=0.2, step=0.5, stop=1e-6)
    assert abs(at[0] - 3) < 1e-3 and abs(at[1] + 1) < 1e-3


def test_files(spark, tmp_path):
    (tmp_path / "seeds.txt").write_bytes(b"https://a.com\r\n\nhttps://b.com\n")
    assert [r.url for r in files.lines(spark, str(tmp_path / "seeds.txt")).collect()] == ["https://a.com", "https://b.com"]
    (tmp_path / "log").write_text("1700000000000\nnone\n\n1700000001000\n")
    assert files.crawl_log(spark, str(tmp_path / "log"), "s").count() == 2
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "new york.json").write_text('["u1", "u2"]')
    got = files.judgments(spark, str(tmp_path / "q"))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [("new + york", 1, "u1"), ("new + york", 2, "u2")]
    files.write_lists(got, str(tmp_path / "lists"))
    assert spark.read.text(str(tmp_path / "lists")).count() == 2
    assert [r.url for r in files.datagrams(spark.createDataFrame([("a\0b\0",)], "value string")).collect()] == ["a", "b"]
    assert [tuple(r) for r in files.word_url_stream(spark.createDataFrame([("1 w",), ("0 u",), ("x",)], "value string")).collect()] == [("word", "w"), ("url", "u")]
    f = spark.createDataFrame([("u", 1, 2)], "url string, priority int, seq long")
    files.write_frontier(f, str(tmp_path / "f"))
    assert files.frontier(spark, str(tmp_path / "f")).collect() == f.collect()


def test_page_source(spark):
    from tidewell.sources.fetch import PageSource

    spark.dataSource.register(PageSource)
    assert spark.read.format("web_pages").option("urls", "https://127.0.0.1/x").option("timeout", "0.2").load().count() == 0


def test_fetching(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from tidewell.sources.fetch import PageSource, RobotsSource

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/a?x=1": b"<p>h\xc3\xa9</p>", "/robots.txt": b"User-agent: *\nDisallow: /b\n" + b"#" * 20_000}.get(self.path)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8" if self.path.startswith("/a") else "text/plain")
            self.end_headers()
            self.wfile.write(body or b"no")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PageSource)
    spark.dataSource.register(RobotsSource)
    read = lambda kind, urls: spark.read.format(kind).option("urls", urls).option("port", server.server_port).option("tls", "false").option("timeout", "5").load().collect()
    assert [tuple(r) for r in read("web_pages", "https://127.0.0.1/a?x=1\nhttps://127.0.0.1/text")] == [("https://127.0.0.1/a?x=1", "<p>h\u00e9</p>")]
    (robots_,) = read("robots_files", "127.0.0.1")
    assert robots_.host == "127.0.0.1" and robots_.text.startswith("User-agent: *") and len(robots_.text) == 16 * 1024
    server.shutdown()


def test_older_readers(spark):
    from tidewell.operators import html

    rows = [(1, 200, "text/html; x", "<html lang='en-US'><script>no</script>Hi, <b>You</b>"), (2, 404, "text/html", "x"), (3, 200, "text/plain", "x"), (4, 200, "text/html", '<HTML class="a" lang="fr">x'), (5, 200, "text/html", "<p>x<!-- y --></p>"), (6, 200, None, "x")]
    got = html.readable(spark.createDataFrame(rows, "id long, status int, content_type string, html string")).select("id", html.plain_text(F.col("html")).alias("t")).collect()
    assert {r.id: r.t.split() for r in got} == {1: ["Hi,", "You"], 5: ["x"]}


def test_streams(spark, tmp_path):
    def table(name, rows, schema):
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return stream.replayed(spark, str(tmp_path / name), schema)

    urls = table("u", [[("https://a.com/X",), ("http://www.a.com/x",)], [("a.com/x",), ("b.com",)]], "url string")
    stream.written(stream.new_urls(urls), "new_urls", str(tmp_path / "c1"))
    assert spark.table("new_urls").count() == 2
    add = lambda k: (f"https://h.com/{k}", "add", k)
    events = table("e", [[add(k) for k in range(7)], [("https://h.com/0", "done", 7), add(8), add(9)]], "url string, kind string, seq long")
    stream.written(stream.host_slots(events), "slots", str(tmp_path / "c2"))
    assert spark.table("slots").count() == 6
    t0 = dt.datetime(2024, 1, 1)
    log = table("l", [[("s", t0 + dt.timedelta(seconds=k * 60)) for k in range(40)]], "server string, ts timestamp")
    stream.written(stream.sliding_rate(log), "rates", str(tmp_path / "c3"), "complete")
    assert spark.table("rates").agg(F.max("rate")).first()[0] == 5 * 4095 / 300
    stream.written(stream.log_lines(log), "lines", str(tmp_path / "c4"), "complete")
    assert spark.table("lines").first().lines == 0
    many = table("d", [[("s",)] * 5_000, [("s",)] * 4_000, [("t",)] * 10], "server string")
    stream.written(stream.log_lines(many), "many", str(tmp_path / "c5"), "complete")
    assert {r.server: r.lines for r in spark.table("many").collect()} == {"s": 2, "t": 0}
    met = []
    stream.each_batch(table("h", [[("u1",)], [("u2",), ("u3",)]], "url string"), lambda rows, no: met.append(sorted(r.url for r in rows.collect())), str(tmp_path / "c6"))
    assert sorted(met) == [["u1"], ["u2", "u3"]]
