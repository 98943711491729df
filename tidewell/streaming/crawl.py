"""The crawl's continuous operators as Structured Streaming; each has its batch twin in operators/."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import TRUSTED, hostname, url_key
from ..operators.crawllog import LINE_DOCS
from ..operators.store import new_path

#: About how many rows of a table that is replayed in order make a micro-batch.
BATCH_ROWS = 500_000


def new_urls(urls: DataFrame, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Each URL once, whichever case, protocol or www it comes in. With a watermark on ts, keys older than it are forgotten."""
    keyed = urls.withColumn("url_key", url_key(F.col("url")))
    if watermark:
        return keyed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["url_key"])
    return keyed.dropDuplicates(["url_key"])


def host_slots(events: DataFrame) -> DataFrame:
    """(url) of the URLs admitted from events (url, kind, seq): kind "add" asks for one of its host's slots, "done" gives
    one back. A URL that finds no slot is dropped. seq orders the events of a micro-batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        busy, cap, out = (state.get[0] if state.exists else 0), 40 if key[0] in TRUSTED else 5, []
        for kind, url in pd.concat(list(batches)).sort_values("seq", kind="stable")[["kind", "url"]].itertuples(index=False):
            if kind == "done":
                busy = max(0, busy - 1)
            elif busy < cap:
                busy += 1
                out.append(url)
        if busy:
            state.update((busy,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"url": pd.Series(out, dtype=object)})

    return events.withColumn("host", hostname(F.col("url"))).groupBy("host").applyInPandasWithState(run, "url string", "busy int", "append", GroupStateTimeout.NoTimeout)


def sliding_rate(log: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(server, start, end, rate): documents a second in sliding five-minute windows of a log (server, ts TIMESTAMP)."""
    windows = log.withWatermark("ts", late).groupBy("server", F.window("ts", "5 minutes", every).alias("w")).agg(F.count("*").alias("n"))
    return windows.select("server", F.col("w.start").alias("start"), F.col("w.end").alias("end"), (F.col("n") * LINE_DOCS / 300).alias("rate"))


def log_lines(docs: DataFrame) -> DataFrame:
    """(server, lines): how many log lines the documents (server, ...) of a stream make, one each LINE_DOCS."""
    return docs.groupBy("server").agg(F.floor(F.count("*") / LINE_DOCS).alias("lines"))


def each_batch(stream: DataFrame, hook: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls hook(rows, number) with each micro-batch of what is there now: the place of a callback per received URL."""
    stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now into Parquet below path, and reads that. A micro-batch that is run again overwrites what
    it wrote before; in complete mode the last one's table stays."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/none")

    def write(rows: DataFrame, no: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{'whole' if mode == 'complete' else no}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def replayed(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stored table as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def replayed_in_order(rows: DataFrame, by: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """rows as a stream in the order of a column, whatever files they lie in: a micro-batch holds one range of it and comes after all lower
    ranges. A file source takes files by their time, so each range is written as a file of its own, one after the other."""
    spark, ranges, path = rows.sparkSession, new_path(rows.sparkSession, "ranges"), new_path(rows.sparkSession, "ordered")
    rows.repartitionByRange(-(-rows.count() // batch_rows) or 1, by).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(ranges)
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/none")
    for (k,) in sorted(spark.read.schema(f"{by} string, _range int").parquet(ranges).select("_range").distinct().collect()):
        spark.read.schema(rows.schema).parquet(f"{ranges}/_range={k}").coalesce(1).write.parquet(f"{path}/{k:08d}")
    return replayed(spark, f"{path}/*", rows.schema)


def written(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what is there now into an in-memory table."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
