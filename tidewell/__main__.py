"""Command line: python -m tidewell index|search|crawl, alone or by spark-submit (see scripts/).

    index  DOCS INDEX [--pages] [--tokens N] [--servers N]    writes a new index, in place of an old one
    search INDEX QUERY...                                     the ten best of each query, their scores and the time it took
    crawl  SEEDS PAGES INDEX [--rounds N] [--batch N]         crawls stored pages from a list of seeds, then indexes what it met
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators import crawl, html, index, store
from .plans import search
from .sources import files


def write(spark: SparkSession, docs: str, path: str, pages: bool, tokens: int, servers: int) -> int:
    """The number of documents that were indexed."""
    rows = spark.read.parquet(docs)
    made = index.docs_of_pages(html.parse_pages(rows)) if pages else index.docs_of_texts(rows)
    index.IndexBuilder(tokens, servers).add(made).write(path)
    return index.read_index(spark, path)[0].count()


def ask(spark: SparkSession, path: str, query: str) -> tuple[list, float]:
    """The best results of a query, and seconds."""
    began = time.perf_counter()
    docs, posts = index.read_index(spark, path)
    found = search.search(posts, docs, query, stats=index.read_terms(spark, path)).collect()
    return found, time.perf_counter() - began


def run_crawl(spark: SparkSession, seeds: str, pages: str, path: str, rounds: int, batch: int, tokens: int, servers: int) -> int:
    all_ = spark.read.parquet(pages)
    none = spark.createDataFrame([], "host string, rule_no int, allow boolean, pattern string")
    met = store.stored(crawl.crawl(files.lines(spark, seeds), all_, none, rounds, batch), "met")
    parsed = html.parse_pages(all_.join(met.select("page_id"), "page_id", "left_semi"))
    index.IndexBuilder(tokens, servers).add(index.docs_of_pages(parsed)).write(path)
    return met.count()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("tidewell", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in (("index", ("docs", "index")), ("search", ("index",)), ("crawl", ("seeds", "pages", "index"))):
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        if name == "search":
            c.add_argument("query", nargs="+")
            continue
        c.add_argument("--tokens", type=int, default=index.CHUNK_TOKENS)
        c.add_argument("--servers", type=int, default=1)
        if name == "index":
            c.add_argument("--pages", action="store_true")
        else:
            c.add_argument("--rounds", type=int, default=5)
            c.add_argument("--batch", type=int, default=100_000)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    if a.command == "index":
        print(f"{write(spark, a.docs, a.index, a.pages, a.tokens, a.servers)} documents indexed")
    elif a.command == "crawl":
        print(f"{run_crawl(spark, a.seeds, a.pages, a.index, a.rounds, a.batch, a.tokens, a.servers)} pages met")
    else:
        for q in a.query:
            found, took = ask(spark, a.index, q)
            for r in found:
                print(f"{r.score:12.3f}  {r.doc_id}  {r.url or ''}")
            print(f"{len(found)} results for {q!r} in {took * 1000:.0f} ms")


if __name__ == "__main__":
    main()
