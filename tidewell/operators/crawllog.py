"""Crawl-log analytics over (server, ts): a line stands for LINE_DOCS documents. ts without a time zone is read as UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import numbered

LINE_DOCS, TRAIL_S, STALE_S = 4095, 300, 60


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def cumulative(log: DataFrame, by: str | None = None) -> DataFrame:
    """log with docs: documents so far, of the server (by) or of all; ties in ts go by the other columns."""
    order = [F.asc("ts"), *(F.asc(c) for c in log.columns if c not in (by, "ts"))]
    return numbered(log, [F.col(by)] if by else [], order, "_no").select(*log.columns, (F.col("_no") * LINE_DOCS).cast("long").alias("docs"))


def trailing_rate(log: DataFrame, by: str | None = None) -> DataFrame:
    """log with rate: documents a second over the five minutes up to each line, of the server (by) or of all. A line is sent to its
    own time slot and as a witness to the next, so each slot is a window of its own."""
    us = micros()
    slot = F.floor(us / F.lit(TRAIL_S * 1_000_000)).cast("long")
    both = log.withColumn("_us", us).withColumn("_own", slot).withColumn("_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    n = F.count("*").over(Window.partitionBy(*([by] if by else []), "_slot").orderBy("_us").rangeBetween(-TRAIL_S * 1_000_000, 0))
    return both.withColumn("rate", n.cast("double") / TRAIL_S * LINE_DOCS).where("_slot = _own").drop("_us", "_own", "_slot")


def last_rate(log: DataFrame, now_us: int | None = None) -> DataFrame:
    """(server, rate, stale): documents a second between a server's last two lines; null if they don't differ. Stale, and
    not to be added up, if the last is over a minute older than now. Each task sends two lines a server."""
    place = F.row_number().over(Window.partitionBy("server").orderBy(F.desc("us")))
    two = log.select("server", micros().alias("us")).withColumn("n", place).where("n <= 2")
    last = two.groupBy("server").agg(F.max("us").alias("us"), (F.max("us") - F.min("us")).alias("gap"))
    rate = F.when(F.col("gap") > 0, F.lit(LINE_DOCS * 1e6) / F.col("gap"))
    return last.select("server", rate.alias("rate"), (F.lit(now_us) - F.col("us") > STALE_S * 1_000_000 if now_us is not None else F.lit(False)).alias("stale"))


def summed_rate(log: DataFrame, now_us: int | None = None) -> DataFrame:
    """(rate, servers): the last rates of all servers that aren't stale and have one, added up."""
    fresh = last_rate(log, now_us).where("rate IS NOT NULL AND NOT stale")
    return fresh.agg(F.coalesce(F.sum("rate"), F.lit(0.0)).alias("rate"), F.count("*").alias("servers"))


def total_docs(log: DataFrame) -> DataFrame:
    return log.agg((F.count("*") * LINE_DOCS).alias("docs"))


def index_size(files: DataFrame) -> DataFrame:
    """(total, largest, total_text) of files (host, bytes): bytes over all hosts, of the largest host, and in words."""
    per = files.groupBy("host").agg(F.sum("bytes").alias("bytes")).agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest"))
    steps = F.lit(None).cast("string")
    for unit, size in (("B", 1), ("K", 1 << 10), ("M", 1 << 20), ("G", 1 << 30), ("T", 1 << 40)):
        steps = F.when(F.col("total") >= size, F.concat(F.floor(F.col("total") / size).cast("string"), F.lit(unit))).otherwise(steps)
    return per.withColumn("total_text", steps)


def not_ready(hosts: DataFrame, log: DataFrame, message: str) -> DataFrame:
    """hosts (host) whose log (host, line) lacks the message."""
    return hosts.join(log.where(F.contains("line", F.lit(message))), "host", "left_anti")
