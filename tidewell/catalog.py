"""The queries over the library's operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashes, stem, text, urls
from .operators import crawl, crawllog, evalrank, html, index, robots, store
from .plans import match, qlang, search
from .plans.rank import nearest, rarest
from .sources import files
from .streaming import crawl as stream

Q_AND, Q_NOT, Q_OR, Q_PHRASE, Q_NESTED = "of + with", "the - of", "la | und", '" of the "', "[ of | und ] + [ with - [ la | in ] ]"
Q_TITLE, Q_RANK, PAGE_QUERY = "the#", "of the with", "the | and | of"
PAGE_REQUEST = "The%20|%20AND%20|%20of"  # PAGE_QUERY as a browser sends it
#: Of the stored index: tokens after which a chunk is closed, and servers that documents are dealt to.
CHUNK, SERVERS = 50_000, 2
_built: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.docs_of_texts(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return html.parse_pages(table(spark, sf_dir, "pages"), only or tuple(html.COLUMNS))


def urls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("server"), F.to_timestamp("ts").alias("ts"))


def index_path(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Where the index of the documents or pages of sf_dir lies; written at its first use in this application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _built or not store.exists(spark, f"{_built[key]}/terms"):
        path = store.new_path(spark, f"index-{kind}")
        docs = documents(spark, sf_dir) if kind == "documents" else index.docs_of_pages(pages(spark, sf_dir, "words", "title_words"))
        index.IndexBuilder(CHUNK, SERVERS).add(docs).write(path)
        _built[key] = path
    return _built[key]


def matched(query: str, kind: str = "documents"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match.matches(index.read_index(spark, index_path(spark, sf_dir, kind))[1], query).select("doc_id")

    return run


def scored(spark: SparkSession, sf_dir: str, query: str, kind: str = "documents") -> DataFrame:
    path = index_path(spark, sf_dir, kind)
    docs, posts = index.read_index(spark, path)
    return search.scored(posts, docs, query, index.read_terms(spark, path))


def column(name: str, make):
    """A query that maps a function over the pages' URLs."""
    return lambda spark, sf_dir: urls_of(spark, sf_dir).select("page_id", make(F.col("url")).alias(name))


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = index.read_index(spark, index_path(spark, sf_dir, "documents"))[1]
    return posts.where("term = 'with'").select("doc_id", F.explode("positions").alias("pos"))


def index_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings as they come back from a stored index, with their document's place."""
    docs, posts = index.read_index(spark, index_path(spark, sf_dir, "documents"))
    rows = posts.select("chunk_id", "term", "doc_id", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).alias("first_pos"))
    return rows.join(docs.select("doc_id", "start_pos", "doc_len"), "doc_id")


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.by_document(documents(spark, sf_dir))
    return found.select("term", "doc_id", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "doc_len")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(documents(spark, sf_dir))


def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chunked(documents(spark, sf_dir), CHUNK, SERVERS).select("doc_id", "chunk_id", "start_pos", "doc_len")


def rare_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Q_RANK.split()
    stats = index.read_terms(spark, index_path(spark, sf_dir, "documents")).where(F.col("term").isin(*words))
    counts = stats.groupBy("chunk_id").agg(*(F.sum(F.when(F.col("term") == w, F.col("cf")).otherwise(0)).alias(w) for w in words))
    return counts.select("chunk_id", F.element_at(F.array(*map(F.lit, words)), rarest([F.col(w) for w in words]) + 1).alias("rarest"))


def nearest_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.positions(index.read_index(spark, index_path(spark, sf_dir, "documents"))[1], ["with", "of"])
    rows = found.select("doc_id", "b1", F.explode("b0").alias("pos"))
    return rows.select("doc_id", "pos", nearest(F.col("b1"), F.col("pos")).alias("nearest"))


def span_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, Q_RANK).select("doc_id", F.round("body_score", 6).alias("score"))


def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(scored(spark, sf_dir, Q_RANK)).select("doc_id", F.round("score", 6).alias("score"))


def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.results_json(page_search(spark, sf_dir).withColumn("chunk_id", F.lit(0)))


def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(scored(spark, sf_dir, PAGE_QUERY, "pages")).select("doc_id", "url", F.round("score", 6).alias("score"))


def front_door(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = index_path(spark, sf_dir, "pages")
    docs, posts = index.read_index(spark, path)
    return search.search(posts, docs, PAGE_REQUEST, stats=index.read_terms(spark, path)).select("doc_id", "url", F.round("score", 6).alias("score"))


ASKED = ("a - b", '"x y" | z', "[ a | b ] - [ c d ]", "a b + c", "[]", '"x', "b ]", "a +")


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words by which results of some queries are ranked; null where a query can't be read."""

    def ranked(query: str) -> str | None:
        try:
            return " ".join(qlang.rank_words(qlang.parse(query)))
        except qlang.QueryError:
            return None

    return spark.createDataFrame([(q, ranked(q)) for q in ASKED], "query string, words string")


def url_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_of(spark, sf_dir).select("page_id", F.round(urls.url_score(F.col("url"), ["the", "en", "html"]), 6).alias("score"))


def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = index.postings(documents(spark, sf_dir))
    return flat.groupBy("term").agg(F.count("*").alias("n"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = index.postings(documents(spark, sf_dir)).select("term").distinct()
    return words.select("term", stem.stem_column(F.col("term")).alias("stem"), stem.stem_column(F.col("term"), "classic").alias("classic_stem"))


def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.page_links(pages(spark, sf_dir, "links"))
    return found.select("page_id", "no", urls.drop_last_slash(urls.url_join("page_url", "url")).alias("url"))


def split_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_of(spark, sf_dir).select("page_id", urls.split_url(F.col("url")).alias("u"), urls.fetchable(F.col("url")).alias("fetchable")).select("page_id", "u.*", "fetchable")


def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.size("words").alias("n_words"), F.array_join("title_words", " ").alias("title"), F.size("links").alias("n_links"), "base")


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(pages(spark, sf_dir, "links")).select("page_id", F.col("no").cast("long").alias("no"), "url", F.array_join("anchor_text", " ").alias("anchor"))


def links_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.discovered(pages(spark, sf_dir, "links"))


def html_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no headers: each page gets one by its number."""
    kind = F.element_at(F.array(*map(F.lit, ("text/html; charset=utf-8", "application/pdf", "TEXT/HTML"))), (F.col("page_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), kind, F.lit("\r\n")).alias("header"))
    return rows.where(html.is_html(F.col("header"))).select("page_id")


def older_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, kind = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200), F.when(F.col("page_id") % 7 == 0, "image/png").otherwise("text/html")
    rows = table(spark, sf_dir, "pages").withColumn("status", status).withColumn("content_type", kind)
    return html.readable(rows).select("page_id", F.size(text.plain_words(html.plain_text(F.col("html")))).alias("n_words"))


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(html.is_english(F.col("html"))).select("page_id")


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.distinct_urls(urls_of(spark, sf_dir), [F.col("page_id")])


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many peers each URL lands when all are sent to seven."""
    sent = crawl.by_peer(urls_of(spark, sf_dir), 7).select(urls.url_key(F.col("url")).alias("url_key"), F.spark_partition_id().alias("peer"))
    return sent.groupBy("url_key").agg(F.count_distinct("peer").alias("peers"))


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed and peer lists: the pages' URLs written as a list with odd line ends, and read back."""
    path = store.new_path(spark, "seeds")
    urls_of(spark, sf_dir).select(F.concat("url", F.element_at(F.array(F.lit("\r"), F.lit("\n"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))).write.text(path)
    return files.lines(spark, path)


def log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a crawl log of milliseconds with other lines between, read back: lines a server second."""
    path = store.new_path(spark, "log")
    log(spark, sf_dir).select(F.explode(F.array(F.unix_millis("ts").cast("string"), F.lit("started"))).alias("line")).write.text(path)
    return files.crawl_log(spark, path, "s1").groupBy("server", F.unix_millis("ts").alias("ms")).agg(F.count("*").alias("n"))


def judgment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged documents as files of JSON arrays, one a language, read back with their ranks."""
    path = store.new_path(spark, "judged")
    lists = _qrels(spark, sf_dir).groupBy("query").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "url"))), lambda x: x.getField("url"))).alias("json"))
    lists.repartition("query").write.partitionBy("query").text(path)
    raw = spark.read.option("basePath", path).text(path, wholetext=True)
    assert raw.columns == ["value", "query"]
    return raw.select("query", F.posexplode(F.from_json("value", "array<string>")).alias("rank", "url")).withColumn("rank", F.col("rank") + 1)


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists written a folder a query, and read back."""
    path = store.new_path(spark, "lists")
    files.write_lists(_qrels(spark, sf_dir), path)
    return spark.read.text(path).select("query", F.col("value").alias("url"))


def frontier_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "frontier")
    files.write_frontier(crawl.prioritized(urls_of(spark, sf_dir), F.col("page_id")), path)
    return files.frontier(spark, path)


def visited_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "visited")
    files.write_visited(urls_of(spark, sf_dir), path)
    return files.visited(spark, path)


def received_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' URLs as messages of a host each, its URLs ended by a NUL, taken apart again."""
    made = urls_of(spark, sf_dir).groupBy(urls.hostname(F.col("url"))).agg(F.concat_ws("\0", F.collect_list("url"), F.array(F.lit(""))).alias("value"))
    return files.datagrams(made)


def word_url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = urls_of(spark, sf_dir).select(F.concat(F.element_at(F.array(F.lit("0 "), F.lit("1 "), F.lit("2 ")), (F.col("page_id") % 3 + 1).cast("int")), "url").alias("value"))
    return files.word_url_stream(lines)


def streamed(name: str, run, mode: str = "append"):
    """A query that runs a stream over what a table holds and returns what came out."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stream.stored_stream(run(spark, sf_dir), store.new_path(spark, f"stream-{name}"), store.new_path(spark, f"progress-{name}"), mode)

    return query


def replayed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stream.replayed(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)  # a pattern may name a file, a path must name a folder


def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stream.replayed_in_order(table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("seq")), "seq")
    return stream.host_slots(asked.select("url", F.lit("add").alias("kind"), "seq"))


def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replayed(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("server"), F.to_timestamp("ts").alias("ts"))
    return stream.sliding_rate(rows).select("server", F.unix_micros("start").alias("start_us"), F.round("rate", 6).alias("rate"))


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.log_lines(replayed(spark, sf_dir, "events").select(F.col("event_type").alias("server")))


def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = urls_of(spark, sf_dir)
    return crawl.unseen(all_, all_.where(F.col("url").startswith("https://")))


def host_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.capped_by_host(urls_of(spark, sf_dir), [F.col("page_id")])


def frontier_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = urls_of(spark, sf_dir)
    return crawl.pop(crawl.prioritized(all_, F.col("page_id")), 50)


def frontier_level_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.capped_by_level(crawl.prioritized(urls_of(spark, sf_dir), F.col("page_id")))


def old_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.page_links(pages(spark, sf_dir, "links"))
    joined = found.withColumn("url", urls.drop_last_slash(urls.url_join("page_url", "url"))).withColumn("no", F.col("no").cast("long"))
    return crawl.old_link_limits(joined).select("page_id", "no", "url")


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no robots.txt: each host gets one that its name makes."""
    hosts = urls_of(spark, sf_dir).select(F.substring_index(urls.strip_prefix(F.col("url")), "/", 1).alias("host")).distinct()
    body = F.concat(F.lit("User-agent: other\nDisallow: /en\nUser-agent: *\nDisallow: /fr\nAllow: /en\nDisallow: /de\n"), F.when(F.instr("host", "blog") > 0, "Disallow: /en\n").otherwise(""), F.lit("User-agent: last\nDisallow: /es"))
    return robots.parse_robots(hosts.select("host", body.alias("text")))


def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.allowed(urls_of(spark, sf_dir), robots_rules(spark, sf_dir))


def crawl_rate_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawllog.trailing_rate(log(spark, sf_dir)).select("event_id", F.round("rate", 6).alias("rate"))


def crawl_rate_by_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawllog.trailing_rate(log(spark, sf_dir), "server").select("event_id", F.round("rate", 6).alias("rate"))


def cumulative_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawllog.cumulative(log(spark, sf_dir)).select("event_id", "docs")


def cumulative_by_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawllog.cumulative(log(spark, sf_dir), "server").select("event_id", "docs")


def rate_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawllog.last_rate(log(spark, sf_dir)).select("server", F.round("rate", 6).alias("rate"))


def rate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of a minute before the log's middle line in time: later servers' last lines aren't stale, earlier ones' are."""
    now = log(spark, sf_dir).agg(F.max(F.unix_micros("ts"))).first()[0]
    return crawllog.summed_rate(log(spark, sf_dir), now - 3_600_000_000).select(F.round("rate", 4).alias("rate"), "servers")


def total_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawllog.total_docs(log(spark, sf_dir))


def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawllog.index_size(table(spark, sf_dir, "documents").select(F.col("source").alias("host"), F.octet_length("text").cast("long").alias("bytes")))


def not_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    line = F.concat("event_type", F.lit(" "), F.floor("value").cast("string"))
    return crawllog.not_ready(events.select(F.col("user_id").alias("host")).distinct(), events.select(F.col("user_id").alias("host"), line.alias("line")), "purchase 10")


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    placed = store.numbered(labels, [F.col("lang")], [F.desc("quality"), F.asc("doc_id")], "rank")
    return placed.select(F.col("lang").alias("query"), F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("url"))


def qrels_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled = table(spark, sf_dir, "documents").where("n_chars > 1000").select(F.col("doc_id").cast("string").alias("url"))
    return evalrank.judged_and_crawled(_qrels(spark, sf_dir), crawled)


def rank_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    results = docs.select(F.col("lang").alias("query"), F.col("doc_id").cast("string").alias("url"), F.col("n_chars").cast("double").alias("score"))
    return evalrank.rank_loss(_qrels(spark, sf_dir), evalrank.ranked(results))


def stopword_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shortcut(spark, "the")


def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.plain_words("text")).alias("n"))


def integer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", text.integer_sqrt(n).alias("root"), text.bit_width(n).cast("long").alias("width"), text.round_up(n, 8).alias("aligned"), hashes.varint_size(n).cast("long").alias("coded"))


def rolling_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_of(spark, sf_dir).select("page_id", hashes.rolling_hash("url").alias("hash"))


def bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, hashes_ = hashes.bloom_size(100_000_000, 1e-4)
    return spark.range(1).select(F.lit(bits).cast("long").alias("bits"), F.lit(hashes_).cast("long").alias("hashes"))


def murmur_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_of(spark, sf_dir).select("page_id", hashes.murmur_hash("url").alias("h")).select("page_id", "h.low", "h.high")


def varint_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a document's line ends as 7-bit groups, and how many bytes the 7-bit and the prefix code take."""
    ends = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.octet_length(x).cast("long")), lambda n: n >= 0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(ends).alias("n"))
    return rows.select("doc_id", "n", F.hex(hashes.varint_column("n")).alias("code"), F.length(hashes.prefixed_column("n")).alias("prefixed"), F.element_at(hashes.varints_column(hashes.varint_column("n")), 1).alias("back"))


def percent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_of(spark, sf_dir).select("page_id", text.percent_decode(F.concat(F.url_encode("url"), F.lit("%2Fa%C3%A9"))).alias("decoded"))


def file_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that result files' names stand for, asking for all words and for any."""
    named = table(spark, sf_dir, "pages").select("page_id", text.query_of_file(F.regexp_replace("url", "[/.]", " ")).alias("query"))
    return named.withColumn("any_query", text.any_of(F.col("query")))


def decode_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("%5B"), F.replace("url", F.lit("/"), F.lit("%20")), F.lit("%22%2B%5D"))
    return urls_of(spark, sf_dir).select("page_id", text.decode_request(asked).alias("query"))


QUERIES = {
    "term_lookup": term_lookup, "index_write": index_write, "and_query": matched(Q_AND), "or_query": matched(Q_OR), "not_query": matched(Q_NOT), "phrase_query": matched(Q_PHRASE),
    "nested_query": matched(Q_NESTED), "title_query": matched(Q_TITLE, "pages"), "inverted_index": inverted_index, "doc_length": doc_length, "term_stats": term_stats,
    "collection_freq": lambda s, d: term_stats(s, d).select("term", "cf"), "doc_freq": lambda s, d: term_stats(s, d).select("term", "df"),
    "vocab_size": lambda s, d: index.vocabulary(documents(s, d)), "chunk_layout": chunk_layout, "rare_word": rare_word, "nearest_pos": nearest_pos,
    "span_score": span_score, "topk_search": topk_search, "url_score": url_score, "page_search": page_search, "results_json": results_json, "stopword_shortcut": stopword_shortcut,
    "normalize_words": normalize_words, "plain_words": plain_words, "stems": stems, "integer_functions": integer_functions, "rolling_hashes": rolling_hashes,
    "bloom_size": bloom_size, "murmur_hashes": murmur_hashes, "varint_round_trip": varint_round_trip, "decode_request": decode_request, "strip_prefix": column("stripped", urls.strip_prefix), "hostname": column("host", urls.hostname),
    "base_root": column("root", urls.base_root), "base_path": column("path", urls.base_path), "drop_last_slash": column("cut", urls.drop_last_slash), "split_url": split_url,
    "frontier_priority": column("priority", urls.frontier_priority), "blacklist_filter": column("barred", urls.barred), "url_reject": column("refused", lambda u: urls.refused(text.ascii_lower(u))),
    "old_policy": column("liked", urls.old_policy), "old_link_limits": old_links, "url_join": url_join, "html_parse": html_parse, "link_extract": link_extract, "links_kept": links_kept,
    "language_gate": language_gate, "url_dedup": url_dedup, "visited_anti_join": unseen, "host_cap": host_cap, "frontier_pop": frontier_pop, "frontier_level_cap": frontier_level_cap,
    "robots_rules": robots_rules, "robots_filter": robots_filter, "crawl_rate_5min": crawl_rate_5min, "crawl_rate_by_server": crawl_rate_by_server,
    "cumulative_docs": cumulative_docs, "cumulative_by_server": cumulative_by_server, "rate_lag": rate_lag, "rate_sum": rate_sum, "total_docs": total_docs, "index_size": index_size,
    "front_door": front_door, "query_words": query_words, "html_gate": html_gate, "older_gate": older_gate, "peers": peers, "seed_lines": seed_lines, "log_file": log_file,
    "judgment_files": judgment_files, "list_files": list_files, "frontier_restore": frontier_restore, "visited_restore": visited_restore, "received_urls": received_urls,
    "word_url_lines": word_url_lines, "percent_decode": percent_decode, "file_queries": file_queries,
    "stream_new_urls": streamed("new", lambda s, d: stream.new_urls(replayed(s, d, "pages").select("url")).select("url_key")), "stream_slots": streamed("slots", stream_slots),
    "stream_rate": streamed("rate", stream_rate, "complete"), "stream_lines": streamed("lines", stream_lines, "complete"),
    "not_ready": not_ready, "qrels_semi": qrels_semi, "rank_loss": rank_loss,
}

# ---------------------------------------------------------------------------------------------------------------- SQL

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_P = rf"""
    w0 AS (SELECT doc_id, string_split_regex(text, '[ \n\t\r\f]+') AS ws FROM documents),
    w1 AS (SELECT doc_id, unnest(ws) AS raw, unnest(range(len(ws))) AS i FROM w0),
    w2 AS (SELECT doc_id, trim({_LOW.format("raw")}, '.!?,)(#''";') AS term, i FROM w1),
    p AS MATERIALIZED (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM w2 WHERE term <> '')"""
_HAS = "bool_or(term = '{}')"
_RANK = Q_RANK.split()
#: The pages' terms by patterns instead of a state machine: body words, then title words with #, in one position space.
_PAGE_P = rf"""
    g0 AS (SELECT page_id AS doc_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<title>[^<]*</title>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[^ \n\t\r\f]+') AS ws,
        regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^ \n\t\r\f]+') AS ts FROM pages),
    g1 AS (SELECT doc_id, unnest(ws) AS raw, unnest(range(len(ws))) AS i, '' AS mark FROM g0 UNION ALL SELECT doc_id, unnest(ts), unnest(range(len(ts))) + len(ws), '#' FROM g0),
    g2 AS (SELECT doc_id, trim({_LOW.format("raw")}, '.!?,)(#'';"') AS term, i, mark FROM g1),
    p AS MATERIALIZED (SELECT doc_id, term || mark AS term, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM g2 WHERE term <> '')"""


def _chunks(docs: str, key: str) -> str:
    """CTEs that cut the documents of a table into chunks, by their terms p."""
    return f"""
    sz AS (SELECT d.{key} AS doc_id, d.{key} % {SERVERS} AS server, count(p.term) AS doc_len FROM {docs} d LEFT JOIN p ON p.doc_id = d.{key} GROUP BY d.{key}),
    st AS MATERIALIZED (SELECT *, (sum(doc_len + 1) OVER (PARTITION BY server ORDER BY doc_id) - doc_len - 1)::BIGINT AS start_ FROM sz),
    ck(server, no, first_) AS (SELECT DISTINCT server, 0::BIGINT, 0::BIGINT FROM st UNION ALL
        SELECT st.server, ck.no + 1, min(st.start_) FROM ck JOIN st ON st.server = ck.server AND st.start_ > ck.first_ + {CHUNK} GROUP BY st.server, ck.no),
    ch AS MATERIALIZED (SELECT doc_id, doc_len, max(no) * {SERVERS} + st.server AS chunk_id, start_ - max(first_) AS start_pos
        FROM st JOIN ck ON st.server = ck.server AND first_ <= start_ GROUP BY doc_id, doc_len, st.server, start_)"""


def _rare(words: list[str]) -> str:
    """CTEs that find each chunk's rarest word."""
    return f"""
    q(term, i) AS (VALUES {", ".join(f"('{w}', {i})" for i, w in enumerate(words))}),
    cf AS (SELECT chunk_id, i, term, count(*) AS n FROM p JOIN q USING (term) JOIN ch USING (doc_id) GROUP BY chunk_id, i, term),
    rare AS (SELECT chunk_id, i AS r, term FROM cf QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n, i) = 1)"""


def _span(words: list[str], mark: str = "", every: bool = True) -> str:
    """CTEs that score the documents (those with every word, or all) by the nearness of body words, or with the mark # of title words."""
    t = "title_" if mark else "body_"
    return f"""
    {t}ok AS (SELECT doc_id FROM p JOIN q USING (term) GROUP BY doc_id HAVING count(DISTINCT term) = {len(set(words))} OR {not every}),
    {t}x AS (SELECT p.doc_id, p.pos AS x, r FROM p JOIN ch ON ch.doc_id = p.doc_id JOIN rare ON p.term = rare.term || '{mark}' AND rare.chunk_id = ch.chunk_id {"" if not every else f"JOIN {t}ok ON {t}ok.doc_id = p.doc_id"}),
    {t}n AS (SELECT x.doc_id, x.x, x.r, q.i, arg_min(p.pos, 2 * abs(p.pos - x.x) + CASE WHEN p.pos >= x.x THEN 1 ELSE 0 END) AS y
          FROM {t}x x, q JOIN p ON p.term = q.term || '{mark}' WHERE p.doc_id = x.doc_id GROUP BY x.doc_id, x.x, x.r, q.i),
    {t}o AS (SELECT *, (i < r AND y <= x) OR (i > r AND y >= x) AS fits FROM {t}n),
    {t}two AS (SELECT doc_id, x, sum((CASE WHEN fits THEN 1.0::DOUBLE ELSE 0.5 END) / greatest(abs(y - x), 1)) AS s FROM {t}o WHERE i <> r GROUP BY doc_id, x),
    {t}three AS (SELECT a.doc_id, a.x, sum((CASE WHEN (b.i < a.r AND b.y <= a.x AND a.y <= b.y) OR (b.i > a.r AND b.y >= a.x AND a.fits) THEN 1.0::DOUBLE ELSE 0.5 END)
              / greatest(greatest(a.y, b.y, a.x) - least(a.y, b.y, a.x), 1)) AS s
              FROM {t}o a JOIN {t}o b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i WHERE a.i <> a.r AND b.i <> b.r GROUP BY a.doc_id, a.x),
    {t}span AS (SELECT doc_id, x, CASE WHEN count(*) = {len(words)} AND max(y) > min(y) THEN 1.0::DOUBLE / (max(y) - min(y)) ELSE 0 END AS s FROM {t}o GROUP BY doc_id, x),
    {t}score AS (SELECT span.doc_id, sum((coalesce(two.s, 0) + coalesce(three.s, 0) + span.s) / pow(1.05::DOUBLE, span.x)) AS score
              FROM {t}span span LEFT JOIN {t}two two USING (doc_id, x) LEFT JOIN {t}three three USING (doc_id, x) GROUP BY span.doc_id)"""


_CHUNKS, _RARE = _chunks("documents", "doc_id"), _rare(_RANK)
_SPAN = f"WITH RECURSIVE {_P}, {_CHUNKS}, {_RARE}, {_span(_RANK)}"
_ENDS = lambda u, w: f"(instr(substr({u}, 1, length({u}) - 1), '{w}') > 0)"
_STRIP = "regexp_replace(url, '^(https?://)?(www\\.)?', '')"
_KEY = _LOW.format(_STRIP)
_HOST = "regexp_extract(url, '^(?:https?://)?(?:www\\.)?([^/#]*)', 1, 's')"
_U = _LOW.format("url")
_SLASH = "(length(url) - length(replace(url, '/', '')))"
_BARRED = ", ".join(f"'{w}'" for w in sorted(urls.BARRED))
_TRUSTED = ", ".join(f"'{w}'" for w in urls.TRUSTED)
_REFUSED = f"(regexp_matches({_U}, '\\.(jpe?g|png|svg)$') OR {' OR '.join(_ENDS(_U, w) for w in ('download', 'sitemap', 'updatestar', 'whatlinkshere'))})"
_PRIORITY = f"""CASE WHEN instr(url, 'login') > 0 OR instr(url, 'signin') > 0 OR instr(url, 'signup') > 0 THEN -1
    WHEN tld = '' THEN short WHEN {_SLASH} < 2 OR {_SLASH} > 9 THEN -1
    ELSE short + CASE WHEN tld IN ('com', 'edu', 'gov', 'net', 'org') THEN 1 ELSE 0 END + CASE WHEN {_SLASH} <= 4 THEN 1 ELSE 0 END END::INTEGER"""
_PRIO = f"""pr AS (SELECT page_id, url, {_PRIORITY} AS priority FROM (SELECT *, CASE WHEN strlen(host) <= 25 THEN 1 ELSE 0 END AS short,
    CASE WHEN instr(host, '.') > 0 THEN regexp_extract(host, '([^.]*)$', 1) ELSE substr(host, 2) END AS tld FROM (SELECT page_id, url, {_HOST} AS host FROM pages)))"""
_OWN = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#;]*)', 1)"
_LIKED = f"""(NOT regexp_matches(lower({_PATH}), '\\.(gif|jpe?g|mp[34]|pdf|png|zip)$') AND NOT regexp_matches(lower({_PATH}), '/(admin|login|logout|signup)')
    AND regexp_matches(lower({_OWN}), '\\.(com|edu|gov|org)$') AND NOT regexp_matches(lower({_OWN}), 'api\\.|cdn\\.|drive\\.google\\.com')
    AND CASE WHEN trim({_PATH}, '/') = '' THEN 0 ELSE len(string_split(trim({_PATH}, '/'), '/')) END < 5)"""
_ROBOTS = """h AS (SELECT DISTINCT string_split(regexp_replace(url, '^(https?://)?(www\\.)?', ''), '/')[1] AS host FROM pages),
    ru AS (SELECT host, rule_no::INTEGER AS rule_no, allow, pattern FROM h, (VALUES (1, false, '/fr'), (2, true, '/en'), (3, false, '/de')) v(rule_no, allow, pattern)
           UNION ALL SELECT host, 4, false, '/en' FROM h WHERE instr(host, 'blog') > 0)"""
_LINKS = """l0 AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>[^<]*', 1) AS hs, regexp_extract_all(html, '<a href="[^"]*"[^>]*>([^<]*)', 1) AS ts FROM pages),
    l AS (SELECT page_id, page_url, unnest(hs) AS link, unnest(ts) AS anchor, unnest(range(len(hs))) AS no FROM l0)"""
_JOINED = """CASE WHEN starts_with(link, 'http://') OR starts_with(link, 'https://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(page_url, '^([^/]*)', 1) || link
    WHEN starts_with(link, '/') THEN array_to_string(string_split(page_url, '/')[1:3], '/') || regexp_replace(link, '\\.$', '')
    ELSE array_to_string(string_split(page_url, '/')[1:3], '/') || regexp_replace('/' || regexp_extract(page_url, '^[^/]*/[^/]*/[^/]*/(.*/)?[^/]*$', 1) || link, '\\.$', '') END"""
_IS_BARRED = f"""(url = '' OR suffix(url, 'print.html') OR instr(substr(url, 2, length(url) - 2), 'http') > 0
    OR ({_ENDS("url", "wikipedia")} AND NOT starts_with(url, 'https://en.wikipedia'))
    OR EXISTS (SELECT 1 FROM (SELECT unnest(string_split_regex(url, '[-/.#?&=_:]')) AS t) WHERE length(t) > 1 AND t IN ({_BARRED})))"""
_QRELS = """qr AS (SELECT lang AS query, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, doc_id)::INTEGER AS rank, doc_id::VARCHAR AS url
    FROM labels JOIN documents USING (doc_id))"""
_URL_WORDS = ["the", "en", "html"]
_PLACES = ", ".join(f"instr({_U}, '{w}') - 1 AS p{i}" for i, w in enumerate(_URL_WORDS))
_COUNT = " + ".join(f"(CASE WHEN p{i} >= 0 THEN 1 ELSE 0 END)" for i in range(3))
_ORDER = (
    "greatest(CASE WHEN p0 >= 0 THEN 1 ELSE 0 END, CASE WHEN p1 >= 0 THEN 1 + CASE WHEN p0 >= 0 AND p0 < p1 THEN 1 ELSE 0 END ELSE 0 END, "
    "CASE WHEN p2 >= 0 THEN 1 + CASE WHEN p0 >= 0 AND p0 < p2 THEN 1 ELSE 0 END + CASE WHEN p1 >= 0 AND p1 < p2 THEN 1 ELSE 0 END ELSE 0 END)"
)


def _any(u: str, words: tuple[str, ...], points: int) -> str:
    return f"CASE WHEN {' OR '.join(_ENDS(u, w) for w in words)} THEN {points}.0::DOUBLE ELSE 0 END"


def _url_points() -> str:
    return f"""CASE WHEN {_REFUSED} THEN -1e20 ELSE {_any(_U, urls.TRUSTED, 78)} + {_any(_U, urls.SCORED_TLD, 75)} + {_any(_U, ("?",), -55)}
            - greatest({_SLASH} - 2, 0) - 3 * floor(sqrt(strlen(url))) + 800.0::DOUBLE * ({_COUNT}) * {_ORDER} END"""


_PAGE_WORDS = qlang.rank_words(qlang.parse(PAGE_QUERY))
_PAGE_SEARCH = f"""WITH RECURSIVE {_PAGE_P}, {_chunks("pages", "page_id")}, {_rare(_PAGE_WORDS)}, {_span(_PAGE_WORDS, every=False)}, {_span(_PAGE_WORDS, "#", every=False)},
    hit AS (SELECT DISTINCT doc_id FROM p WHERE term IN ({", ".join(f"'{w}', '{w}#'" for w in _PAGE_WORDS)})),
    u AS (SELECT page_id AS doc_id, url, {", ".join(f"instr({_U}, '{w}') - 1 AS p{i}" for i, w in enumerate(_PAGE_WORDS))} FROM pages),
    s AS (SELECT doc_id, url, chunk_id, coalesce(body_score.score, 0) + 30 * coalesce(title_score.score, 0) + {_url_points()} AS score
        FROM hit JOIN u USING (doc_id) JOIN ch USING (doc_id) LEFT JOIN body_score USING (doc_id) LEFT JOIN title_score USING (doc_id)),
    best AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, chunk_id, doc_id LIMIT 10)"""


SQL = {
    "term_lookup": f"WITH {_P} SELECT doc_id, pos FROM p WHERE term = 'with'",
    "and_query": f"WITH {_P} SELECT doc_id FROM p GROUP BY doc_id HAVING {_HAS.format('of')} AND {_HAS.format('with')}",
    "or_query": f"WITH {_P} SELECT doc_id FROM p GROUP BY doc_id HAVING {_HAS.format('la')} OR {_HAS.format('und')}",
    "not_query": f"WITH {_P} SELECT doc_id FROM p GROUP BY doc_id HAVING {_HAS.format('the')} AND NOT {_HAS.format('of')}",
    "phrase_query": f"WITH {_P} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'",
    "nested_query": f"""WITH {_P} SELECT doc_id FROM p GROUP BY doc_id HAVING ({_HAS.format('of')} OR {_HAS.format('und')}) AND {_HAS.format('with')}
        AND NOT ({_HAS.format('la')} OR {_HAS.format('in')})""",
    "title_query": rf"""WITH t AS (SELECT page_id, unnest(string_split_regex(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \n\t\r\f]+')) AS w FROM pages)
        SELECT DISTINCT page_id AS doc_id FROM t WHERE trim({_LOW.format("w")}, '.!?,)(#''";') = 'the'""",
    "inverted_index": f"WITH {_P} SELECT term, doc_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM p GROUP BY term, doc_id",
    "doc_length": f"WITH {_P} SELECT d.doc_id, count(p.term) AS doc_len FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id",
    "term_stats": f"WITH {_P} SELECT 0::BIGINT AS chunk_id, term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM p GROUP BY term",
    "collection_freq": f"WITH {_P} SELECT term, count(*) AS cf FROM p GROUP BY term",
    "doc_freq": f"WITH {_P} SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term",
    "vocab_size": f"WITH {_P} SELECT count(DISTINCT term) AS n_terms, count(*) + (SELECT count(*) FROM documents) AS n_tokens FROM p",
    "chunk_layout": f"WITH RECURSIVE {_P}, {_CHUNKS} SELECT doc_id, chunk_id, start_pos, doc_len FROM ch",
    "index_write": f"""WITH RECURSIVE {_P}, {_CHUNKS}, n AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM p GROUP BY doc_id, term)
        SELECT chunk_id, term, doc_id, n, first_pos, start_pos, doc_len FROM n JOIN ch USING (doc_id)""",
    "rare_word": f"WITH RECURSIVE {_P}, {_CHUNKS}, {_RARE} SELECT chunk_id, term AS rarest FROM rare",
    "nearest_pos": f"""WITH {_P}, a AS (SELECT doc_id, pos FROM p WHERE term = 'with'), b AS (SELECT doc_id, pos FROM p WHERE term = 'of')
        SELECT a.doc_id, a.pos, arg_min(b.pos, 2 * abs(b.pos - a.pos) + CASE WHEN b.pos >= a.pos THEN 1 ELSE 0 END) AS nearest
        FROM a LEFT JOIN b ON a.doc_id = b.doc_id GROUP BY a.doc_id, a.pos""",
    "span_score": f"{_SPAN} SELECT doc_id, round(score, 6) AS score FROM body_score",
    "topk_search": f"{_SPAN} SELECT doc_id, round(score, 6) AS score FROM body_score JOIN ch USING (doc_id) WHERE score > 0 ORDER BY body_score.score DESC, chunk_id, doc_id LIMIT 10",
    "url_score": f"WITH u AS (SELECT page_id, url, {_PLACES} FROM pages) SELECT page_id, round({_url_points()}, 6)::DOUBLE AS score FROM u",
    "page_search": f"{_PAGE_SEARCH} SELECT doc_id, url, round(score, 6)::DOUBLE AS score FROM best",
    "results_json": f"{_PAGE_SEARCH} SELECT to_json(list(url ORDER BY round(score, 6) DESC, doc_id))::VARCHAR AS json FROM best WHERE url <> ''",
    "html_parse": f"""WITH {_PAGE_P} SELECT g0.doc_id AS page_id, len(ws)::INTEGER AS n_words, array_to_string(ts, ' ') AS title,
        len(regexp_extract_all(html, '<a href="'))::INTEGER AS n_links, '' AS base FROM g0 JOIN pages ON page_id = g0.doc_id""",
    "stopword_shortcut": "SELECT unnest([" + ", ".join(f"'{p}the'" for p in search.REFERENCE_PAGES) + "]) AS url",
    "normalize_words": f"WITH {_P} SELECT term, count(*) AS n FROM p GROUP BY term",
    "plain_words": r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g'), '[^ \t\n\x0b\f\r]+'))::INTEGER AS n FROM documents""",
    "integer_functions": """WITH n AS (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents) SELECT doc_id, floor(sqrt(n))::BIGINT AS root,
        (CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END)::BIGINT AS width, ((n + 7) // 8 * 8)::BIGINT AS aligned, greatest(1, (length(bin(n)) + 6) // 7)::BIGINT AS coded FROM n""",
    "bloom_size": "SELECT floor(-1e8 * ln(1e-4) / (ln(2) * ln(2)))::BIGINT AS bits, floor(floor(-1e8 * ln(1e-4) / (ln(2) * ln(2))) / 1e8 * ln(2))::BIGINT AS hashes",
    "decode_request": f"""SELECT page_id, {_LOW.format("'[' || replace(url, '/', ' ') || '\"%2b]'")} AS query FROM pages""",
    "strip_prefix": f"SELECT page_id, {_STRIP} AS stripped FROM pages",
    "hostname": f"SELECT page_id, {_HOST} AS host FROM pages",
    "base_root": "SELECT page_id, array_to_string(string_split(url, '/')[1:3], '/') AS root FROM pages",
    "base_path": "SELECT page_id, CASE WHEN len(string_split(url, '/')) > 3 THEN '/' || array_to_string(string_split(url, '/')[4:], '/') ELSE '/' END AS path FROM pages",
    "drop_last_slash": "SELECT page_id, regexp_replace(url, '/$', '') AS cut FROM pages",
    "split_url": """SELECT page_id, string_split(url, ':')[1] AS service, string_split(string_split(url, '//')[2], '/')[1] AS host, '' AS port,
        array_to_string(string_split(url, '/')[4:], '/') AS path, regexp_matches(string_split(url, '//')[2], '^[A-Za-z0-9]') AS fetchable FROM pages""",
    "frontier_priority": f"WITH {_PRIO} SELECT page_id, priority FROM pr",
    "blacklist_filter": f"SELECT page_id, {_IS_BARRED} AS barred FROM pages",
    "url_reject": f"SELECT page_id, {_REFUSED} AS refused FROM pages",
    "old_policy": f"SELECT page_id, {_LIKED} AS liked FROM pages",
    "old_link_limits": f"""WITH {_LINKS}, j AS (SELECT page_id, no, page_url, regexp_replace({_JOINED}, '/$', '') AS url FROM l),
        a AS (SELECT page_id, no, url, {_OWN} = {_OWN.replace("(url", "(page_url")} AS own FROM j WHERE {_LIKED}),
        b AS (SELECT * FROM a QUALIFY NOT own OR row_number() OVER (PARTITION BY page_id, own ORDER BY no) <= 3)
        SELECT page_id, no, url FROM b QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY no) <= 8""",
    "url_join": f"WITH {_LINKS} SELECT page_id, no::INTEGER AS no, regexp_replace({_JOINED}, '/$', '') AS url FROM l",
    "link_extract": rf"WITH {_LINKS} SELECT page_id, no, link AS url, trim(regexp_replace(anchor, '[ \n\t\r\f]+', ' ', 'g')) AS anchor FROM l",
    "links_kept": f"""WITH {_LINKS}, k AS (SELECT *, link AS url FROM l), m AS (SELECT * FROM k WHERE url <> '' AND NOT starts_with(url, '#') AND strlen(url) <= 400 AND NOT {_IS_BARRED}),
        j AS (SELECT page_id, no::INTEGER AS no, regexp_replace({_JOINED}, '/$', '') AS url FROM m) SELECT * FROM j WHERE NOT starts_with(url, 'http://')""",
    "language_gate": f"SELECT page_id FROM pages WHERE instr({_LOW.format('html')}, 'lang=\"en\"') > 0",
    "url_dedup": f"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY page_id) = 1",
    "visited_anti_join": f"SELECT page_id, url FROM pages WHERE {_KEY} NOT IN (SELECT {_KEY} FROM pages WHERE starts_with(url, 'https://'))",
    "host_cap": f"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) <= CASE WHEN {_HOST} IN ({_TRUSTED}) THEN 40 ELSE 5 END",
    "frontier_pop": f"WITH {_PRIO} SELECT url, priority, page_id AS seq FROM pr WHERE priority >= 0 ORDER BY priority DESC, page_id LIMIT 50",
    "frontier_level_cap": f"WITH {_PRIO} SELECT url, priority, page_id AS seq FROM pr WHERE priority >= 0 QUALIFY row_number() OVER (PARTITION BY priority ORDER BY page_id) <= {crawl.LEVEL_CAP}",
    "robots_rules": f"WITH {_ROBOTS} SELECT * FROM ru",
    "robots_filter": rf"""WITH {_ROBOTS}, u AS (SELECT page_id, url, string_split({_STRIP}, '/')[1] AS host, nullif(regexp_extract(url, '^(?:https?://)?[^/]*(/.+)$', 1), '') AS route FROM pages)
        SELECT page_id, any_value(u.url) AS url, coalesce(arg_max(allow, rule_no), true) AS allowed
        FROM u LEFT JOIN ru ON u.host = ru.host AND (route = pattern OR starts_with(route, pattern || '/')) GROUP BY page_id""",
    "crawl_rate_5min": "SELECT event_id, round(count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)::DOUBLE / 300 * 4095, 6) AS rate FROM events",
    "crawl_rate_by_server": "SELECT event_id, round(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)::DOUBLE / 300 * 4095, 6) AS rate FROM events",
    "cumulative_docs": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) * 4095 AS docs FROM events",
    "cumulative_by_server": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 4095 AS docs FROM events",
    "rate_lag": """WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events)
        SELECT user_id AS server, CASE WHEN us - b > 0 THEN round(4095 * 1e6::DOUBLE / (us - b), 6) END AS rate FROM e WHERE n = 1""",
    "rate_sum": """WITH n AS (SELECT max(epoch_us(ts)) - 3600000000 AS now_ FROM events),
        e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events)
        SELECT round(coalesce(sum(4095 * 1e6::DOUBLE / (us - b)), 0), 4) AS rate, count(*) AS servers FROM e, n WHERE e.n = 1 AND us > b AND now_ - us <= 60000000""",
    "rolling_hashes": """WITH RECURSIVE pw(i, x) AS (SELECT 0, 1::HUGEINT UNION ALL SELECT i + 1, x * 101 % 18446744073709551616 FROM pw WHERE i < (SELECT max(strlen(url)) FROM pages)),
        b AS (SELECT page_id, hex(encode(url)) AS h FROM pages), c AS (SELECT page_id, h, unnest(range(length(h) // 2)) AS i FROM b),
        d AS (SELECT page_id, i, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS v FROM c),
        s AS (SELECT page_id, (sum((CASE WHEN v > 127 THEN v - 256 ELSE v END) * x % 18446744073709551616) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 AS u FROM d JOIN pw USING (i) GROUP BY page_id)
        SELECT page_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash FROM s""",
    "varint_round_trip": """WITH l AS (SELECT DISTINCT doc_id, strlen(unnest(string_split(text, chr(10))))::BIGINT AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, n, CASE WHEN n < 128 THEN printf('%02X', n + 128) WHEN n < 16384 THEN printf('%02X%02X', n // 128, n % 128 + 128)
            ELSE printf('%02X%02X%02X', n // 16384, n // 128 % 128, n % 128 + 128) END AS code,
            (CASE WHEN n < 32 THEN 1 WHEN n < 8192 THEN 2 ELSE 3 END)::INTEGER AS prefixed, n AS back FROM l""",
    "front_door": f"{_PAGE_SEARCH} SELECT doc_id, url, round(score, 6)::DOUBLE AS score FROM best",
    "query_words": """SELECT * FROM (VALUES ('a - b', 'a'), ('"x y" | z', 'x y z'), ('[ a | b ] - [ c d ]', 'a b'), ('a b + c', 'a b c'), ('[]', ''), ('"x', NULL), ('b ]', NULL), ('a +', 'a ')) v(query, words)""",
    "html_gate": "SELECT page_id FROM pages WHERE page_id % 3 <> 1",
    "older_gate": r"""WITH g AS (SELECT page_id, html FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0 AND regexp_extract(html, '<html lang="([a-z]*)', 1) IN ('', 'en')),
        t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[!-/:-@\[-`{-~]', '', 'g') AS t FROM g)
        SELECT page_id, len(regexp_extract_all(t, '[^ \t\n\x0b\f\r]+'))::INTEGER AS n_words FROM t""",
    "peers": f"SELECT DISTINCT {_KEY} AS url_key, 1::BIGINT AS peers FROM pages",
    "seed_lines": "SELECT url FROM pages",
    "log_file": "SELECT 's1' AS server, epoch_us(ts) // 1000 AS ms, count(*) AS n FROM events GROUP BY ms",
    "judgment_files": f"WITH {_QRELS} SELECT query, rank, url FROM qr",
    "list_files": f"WITH {_QRELS} SELECT query, url FROM qr",
    "frontier_restore": f"WITH {_PRIO} SELECT url, priority, page_id AS seq FROM pr WHERE priority >= 0",
    "visited_restore": "SELECT DISTINCT url FROM pages",
    "received_urls": "SELECT url FROM pages",
    "word_url_lines": "SELECT CASE page_id % 3 WHEN 0 THEN 'url' ELSE 'word' END AS kind, url AS value FROM pages WHERE page_id % 3 < 2",
    "percent_decode": "SELECT page_id, url || '/aé' AS decoded FROM pages",
    "file_queries": """WITH n AS (SELECT page_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(url, '[/.]', ' ', 'g'), '[^a-zA-Z0-9 ]', '', 'g'), '[^ ]+'), ' + ') AS query FROM pages)
        SELECT page_id, query, replace(query, '+', '|') AS any_query FROM n""",
    "stream_new_urls": f"SELECT DISTINCT {_KEY} AS url_key FROM pages",
    "stream_slots": f"SELECT url FROM pages QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) <= CASE WHEN {_HOST} IN ({_TRUSTED}) THEN 40 ELSE 5 END",
    "stream_rate": """WITH w AS (SELECT user_id::VARCHAR AS server, (epoch_us(ts) // 60000000 - unnest(range(5))) * 60000000 AS start_us FROM events)
        SELECT server, start_us, round(count(*) * 4095 / 300.0::DOUBLE, 6) AS rate FROM w GROUP BY server, start_us""",
    "stream_lines": "SELECT event_type AS server, (count(*) // 4095)::BIGINT AS lines FROM events GROUP BY event_type",
    "total_docs": "SELECT count(*) * 4095 AS docs FROM events",
    "index_size": """WITH h AS (SELECT source, sum(strlen(text))::BIGINT AS b FROM documents GROUP BY source), t AS (SELECT sum(b)::BIGINT AS total, max(b) AS largest FROM h)
        SELECT total, largest, CASE WHEN total >= 1099511627776 THEN floor(total / 1099511627776)::BIGINT || 'T' WHEN total >= 1073741824 THEN floor(total / 1073741824)::BIGINT || 'G'
        WHEN total >= 1048576 THEN floor(total / 1048576)::BIGINT || 'M' WHEN total >= 1024 THEN floor(total / 1024)::BIGINT || 'K' WHEN total >= 1 THEN total || 'B' END AS total_text FROM t""",
    "not_ready": "SELECT DISTINCT user_id AS host FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE contains(event_type || ' ' || floor(value)::BIGINT::VARCHAR, 'purchase 10'))",
    "qrels_semi": f"WITH {_QRELS} SELECT * FROM qr WHERE url IN (SELECT doc_id::VARCHAR FROM documents WHERE n_chars > 1000)",
    "rank_loss": f"""WITH {_QRELS}, r AS (SELECT lang AS query, doc_id::VARCHAR AS url, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id::VARCHAR) AS actual FROM documents)
        SELECT qr.query, sum(pow(qr.rank - coalesce(actual, 100), 2)) AS loss FROM qr LEFT JOIN r USING (query, url) GROUP BY qr.query""",
}
