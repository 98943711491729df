"""Postings and counts made where the documents lie: the same as by a shuffle of all tokens, with groups and files of few tokens too."""

import random

from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import index


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def corpus(spark):
    rng = random.Random(3)
    chars = " \n\t\r\f.!?,)(#'\";aAbÄé-"
    rows = [(k, "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    return spark.createDataFrame([*rows, (400, None), (401, ""), (402, "..."), (403, "." * 50_000 + "x"), (404, "a " * 3_000)], "doc_id long, text string").repartition(3)


def test_terms(spark):
    both = corpus(spark).select("text", text.terms(F.col("text")).alias("a"), text.terms_of(F.split("text", text.SPACES)).alias("b"))
    assert both.where("NOT a <=> b").count() == 0 and both.where("size(a) > 0").count() > 300


def test_postings(spark, monkeypatch):
    monkeypatch.setattr(index, "GROUP_TOKENS", 50)
    docs = index.docs_of_texts(corpus(spark)).withColumn("title", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("zz"))).otherwise(F.col("title")))
    docs = docs.withColumn("chunk_id", F.col("doc_id") % 4)
    got, want = index.by_document(docs), index.inverted(index.postings(docs))
    assert shuffles(got) == 0
    cols = ["chunk_id", "term", "doc_id", "positions"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    per = index.postings(docs).groupBy("chunk_id", "term").agg(F.count("*").alias("cf"), F.count_distinct("doc_id").alias("df"))
    stats = index.term_stats(docs)
    assert shuffles(stats) == 1
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, per.collect()))


def test_stored(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(index, "FILE_TOKENS", 500)
    docs = index.docs_of_texts(corpus(spark))
    index.IndexBuilder(100, 3).add(docs).write(str(tmp_path / "i"))
    placed, posts = index.read_index(spark, str(tmp_path / "i"))
    want = index.inverted(index.postings(index.chunked(docs, 100, 3)))
    cols = ["chunk_id", "term", "doc_id", "positions"]
    assert sorted(map(tuple, posts.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert placed.count() == 405 and {p.name for p in (tmp_path / "i").iterdir()} == {"docs", "postings", "terms"}
    stats = posts.groupBy("term", "chunk_id").agg(F.sum(F.size("positions")).alias("cf"), F.count("*").alias("df"))
    assert sorted(map(tuple, index.read_terms(spark, str(tmp_path / "i")).collect())) == sorted(map(tuple, stats.collect()))
    ends = [(f.min, f.max) for f in posts.groupBy(F.input_file_name()).agg(F.min("term").alias("min"), F.max("term").alias("max")).collect()]
    ends.sort()
    assert len(ends) > 3 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
