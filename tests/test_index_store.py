"""The stored index: exact chunk cut, nothing lost, lookups pushed down; visited set; hashes with published check values."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hashes
from tidewell.operators import crawl, crawllog, index
from tidewell.plans import match, search
from tidewell.sources import files


def sequential(sizes, tokens, servers):
    """Chunk and start of each document by a loop, as a crawler cuts them."""
    state, out = {}, {}
    for i, n in sorted(sizes.items()):
        no, held = state.get(i % servers, (0, 0))
        out[i] = (no * servers + i % servers, held)
        held += n + 1
        state[i % servers] = (no + 1, 0) if held > tokens else (no, held)
    return out


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize(("tokens", "servers"), [(500, 1), (50_000, 3), (0, 1)])
def test_cut(spark, adaptive, tokens, servers):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(0, 20_000, 1, 7).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 23).cast("int")).alias("text"))
        docs = index.chunked(index.docs_of_texts(df.repartition(9)), tokens, servers)
        got = {r.doc_id: (r.chunk_id, r.start_pos) for r in docs.select("doc_id", "chunk_id", "start_pos").collect()}
        assert got == sequential({i: i * 7919 % 23 for i in range(20_000)}, tokens, servers)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_write_keeps_all(spark, tmp_path):
    df = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all n"), "id", F.when(F.col("id") % 2 == 0, " even").otherwise(" Odd.")).alias("text"))
    index.IndexBuilder(1_000, 2).add(index.docs_of_texts(df)).write(str(tmp_path / "i"))
    docs, posts = index.read_index(spark, str(tmp_path / "i"))
    stats = index.read_terms(spark, str(tmp_path / "i"))
    assert docs.count() == 5_000 and posts.select(F.sum(F.size("positions"))).first()[0] == 15_000
    assert stats.where("term = 'all'").agg(F.sum("cf"), F.sum("df")).first() == (5_000, 5_000) and stats.select("chunk_id").distinct().count() > 10
    found = match.matches(posts, "even - n4")
    assert found.count() == 2_499
    assert "PushedFilters: [In(term" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plain = search.scored(index.inverted(index.postings(docs.limit(0).withColumn("body", F.array().cast("array<string>")).withColumn("title", F.array().cast("array<string>")))), docs, "even all")
    assert plain.count() == 0
    by_posts, by_stats = (search.scored(posts, docs, "even all", s).select("doc_id", F.round("score", 9)) for s in (None, stats))
    assert by_posts.exceptAll(by_stats).count() == 0 and by_stats.count() == 2_500
    longer = search.scored(posts, docs.withColumn("doc_len", F.when(F.col("doc_id") == 2, 350).otherwise(3)), "even all", stats, length_bonus=7.0)
    base = {r[0]: r[1] for r in by_stats.collect()}
    assert {r.doc_id for r in longer.collect() if abs(r.score - base[r.doc_id] - 7) < 1e-6} == {2}


def test_published_check_values():
    """Keys 0, 01, 012 ... with seeds 256, 255 ..., hashed together once more: the values that the hash's author published."""

    def check(fn):
        whole = b"".join(fn(bytes(range(i)), 256 - i) for i in range(256))
        return int.from_bytes(fn(whole, 0)[:4], "little")

    assert check(lambda k, s: hashes.murmur3_128([k], s).tobytes()) == 0xB3ECE62A
    assert check(lambda k, s: hashes.murmur3_32(k, s).to_bytes(4, "little")) == 0xB0F57EE3


def test_bloom():
    words = [f"Key{k}" for k in range(2_000)]
    f = hashes.Bloom(2_000, 1e-4)
    assert not f.might_hold(words).any()
    f.add(words[:1_000])
    g = hashes.Bloom(2_000, 1e-4)
    g.add(words[1_000:])
    both = hashes.Bloom(2_000, 1e-4, (f | g).save())
    assert both.might_hold([w.upper() for w in words]).all() and f.might_hold(words[1_000:]).mean() < 0.01


def test_codes(spark):
    n = [0, 1, 127, 128, 16_383, 16_384, 2**40, None]
    df = spark.createDataFrame([(x,) for x in n], "n long").select("n", hashes.varint_column("n").alias("c"), hashes.prefixed_column("n").alias("p"))
    rows = df.select("n", "c", "p", hashes.varints_column("c").alias("b")).collect()
    assert [r.b[0] if r.b is not None else None for r in rows] == n and rows[3].c == b"\x01\x80" and rows[-1].p is None
    assert [hashes.unprefixed(bytes(r.p))[0] for r in rows[:-1]] == n[:-1]
    got = spark.createDataFrame([("Ab",), ("aB",), (None,)], "u string").select(hashes.murmur_hash("u").alias("h")).collect()
    assert got[0].h == got[1].h and got[2].h.low is None


def test_visited_files(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.com",), ("https://a.com",), ("https://b.com",)], "url string")
    files.write_visited(rows, str(tmp_path / "v"))
    assert files.visited(spark, str(tmp_path / "v")).count() == 2


def test_turns_go_on(spark):
    new = spark.createDataFrame([("c", 2, 0), ("a", 1, 1), ("b", 1, 0)], "url string, page_id long, no int")
    old = spark.createDataFrame([(7,)], "seq long")
    got = crawl.in_turn(new, [F.col("page_id"), F.col("no")], old)
    assert [(r.url, r.seq) for r in got.orderBy("seq").collect()] == [("b", 8), ("a", 9), ("c", 10)]


def site(spark):
    page = lambda k, *links: (k, f"https://s.com/{k}", "".join(f'<a href="{x}">t</a>' for x in links))
    return spark.createDataFrame([page(1, *(f"/{k}" for k in range(2, 12)))] + [page(k) for k in range(2, 12)], "page_id long, url string, html string")


def test_slots_over_rounds(spark):
    """A host has five slots: five of ten links get in; URLs that wait keep theirs."""
    seeds, rules = spark.createDataFrame([("https://s.com/1",)], "url string"), spark.createDataFrame([], "host string, rule_no int, allow boolean, pattern string")
    seen = []
    met = crawl.crawl(seeds, site(spark), rules, 4, 2, on_round=lambda k, parsed, frontier, visited: seen.append((k, frontier.count(), visited.count())))
    assert sorted(r.page_id for r in met.collect()) == [1, 2, 3, 4, 5, 6]
    assert seen == [(0, 5, 6), (1, 3, 6), (2, 1, 6), (3, 0, 6)]
    asked = iter([False, True])
    assert crawl.crawl(seeds, site(spark), rules, 4, 2, stop=lambda: next(asked)).count() == 1


def test_old_crawl(spark):
    met = crawl.old_crawl(spark.createDataFrame([("https://s.com/1",)], "url string"), site(spark), 3, 2)
    assert sorted((r.page_id, r.round) for r in met.collect()) == [(1, 0), (2, 1), (3, 1), (4, 2)]  # three of the own domain


def test_rate_sum(spark):
    rows = [("a", 0), ("a", 10), ("b", 0), ("b", 5), ("c", 3), ("d", -900), ("d", -800)]
    log = spark.createDataFrame(rows, "server string, s long").select("server", F.timestamp_seconds("s").alias("ts"))
    got = crawllog.summed_rate(log, 20_000_000).first()
    assert got.servers == 2 and abs(got.rate - (4095 / 10 + 4095 / 5)) < 1e-9


def test_numbered(spark):
    """Rows of a `by` that holds most rows are numbered over several ranges; null keys are a group."""
    from tidewell.operators.store import numbered

    df = spark.range(0, 9_000, 1, 5).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").alias("k"), F.hash("id").alias("h"))
    got = numbered(df, [F.col("k")], [F.desc("h"), F.asc("id")], "no")
    assert got.columns == ["id", "k", "h", "no"]
    groups = {}
    for r in sorted(got.collect(), key=lambda r: (-r.h, r.id)):
        groups.setdefault(r.k, []).append(r.no)
    assert {k: len(v) for k, v in groups.items()} == {"hot": 7_200, "b": 900, None: 900} and all(v == list(range(1, len(v) + 1)) for v in groups.values())
    assert [r.no for r in numbered(df, [], [F.asc("id")], "no").orderBy("id").collect()] == list(range(1, 9_001))
    plan = crawl.capped_by_host(spark.createDataFrame([("https://a.com/x",)], "url string"), [F.col("url")])
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
