"""What the operators of this folder share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import shared_dir

#: A word is a run of characters other than these six ASCII spaces, in Spark, in DuckDB and (as bytes.split) in Python.
WORD = r"[^ \t\n\x0b\f\r]+"
#: Beyond this many rows a side that is counted first is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def at(name: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names for working columns that no column of df has, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for b in bases:
        name = f"_tw_{b}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *names: str | None) -> list[str]:
    """The columns of df whose names, compared without case, aren't among the given ones."""
    taken = {n.lower() for n in names if n}
    return [c for c in df.columns if c.lower() not in taken]


def words(text: Column) -> Column:
    """Number of words; 0 where the text is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a stored() table that no result reads."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _drop(df.sparkSession, f)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast only if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
