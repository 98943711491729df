"""Tables written into the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of this run's own on a local master; an error on a cluster,
    whose executors would each see another folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses, deleted at the end of the run."""
    path = f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[Column], order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered from 1 within `by`, in the given order. Rows are numbered within ranges of (by, order), and the ranges'
    counts are added, so that a `by` with a third of all rows is no one task's. The ranges are written down once, so that numbers and
    counts see the same ones."""
    keys = [f"_by{k}" for k in range(len(by))]
    keyed = df.withColumns(dict(zip(keys, by, strict=True))) if by else df
    part = stored(keyed.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = part.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys).orderBy("_range") if keys else Window.orderBy("_range")  # a row a range
    counts = counts.withColumn("_before", F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    row = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    same = part.withColumn("_row", row).alias("a").join(counts.alias("b"), [F.col("a._range") == F.col("b._range"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)])
    return same.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("_before") + F.col("_row")).alias(name))


def drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass
