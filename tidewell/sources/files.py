"""Readers and writers of the library's files, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import query_of_file


def lines(spark: SparkSession, path: str, name: str = "url") -> DataFrame:
    """Seed and peer lists: one value a line, without the line's CR, empty lines left out."""
    return spark.read.text(path).select(F.regexp_replace("value", "\\r$", "").alias(name)).where(F.col(name) != "")


def crawl_log(spark: SparkSession, path: str, server: str) -> DataFrame:
    """(server, ts) of a log of epoch milliseconds; other lines are left out."""
    ms = F.trim("value").try_cast("bigint")
    return spark.read.text(path).select(F.lit(server).alias("server"), F.timestamp_millis(ms).alias("ts")).where("ts IS NOT NULL")


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, url) of files that hold a JSON array of URLs each and are named after their query."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]*?)(?:\.json)?$", 1).alias("name"), "value")
    return raw.select(query_of_file(F.col("name")).alias("query"), F.posexplode(F.from_json("value", "array<string>")).alias("rank", "url")).withColumn("rank", F.col("rank") + 1)


def write_lists(rows: DataFrame, path: str) -> None:
    """rows (query, rank, url) as text, a folder a query, a URL a line in the order of rank."""
    rows.repartition("query").sortWithinPartitions("query", "rank").select("query", "url").write.mode("overwrite").partitionBy("query").text(path)


def robots_files(spark: SparkSession, path: str, limit: int = 16 * 1024) -> DataFrame:
    """(host, text) of stored robots.txt files named host.txt, as far as the crawler reads one."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]*)\.txt$", 1).alias("host"), F.substring("value", 1, limit).alias("text"))


def frontier(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FRONTIER).parquet(path)


def write_frontier(rows: DataFrame, path: str) -> None:
    rows.select("url", "priority", "seq").write.mode("overwrite").parquet(path)


def visited(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string").parquet(path)


def write_visited(rows: DataFrame, path: str) -> None:
    """The visited set as its URLs, exact where a filter of bits would err."""
    rows.select("url").distinct().write.mode("overwrite").parquet(path)


def word_url_stream(lines_: DataFrame) -> DataFrame:
    """(kind, value) of lines `1 word` and `0 url`, from a batch or a stream (value)."""
    return lines_.select(F.when(F.col("value").startswith("1 "), "word").when(F.col("value").startswith("0 "), "url").alias("kind"), F.substring("value", 3, 1 << 30).alias("value")).where("kind IS NOT NULL")


def datagrams(rows: DataFrame) -> DataFrame:
    """(url) of messages (value BINARY or STRING) that hold URLs each ended by a NUL."""
    return rows.select(F.explode(F.split(F.col("value").cast("string"), "\\x00")).alias("url")).where("url <> ''")
