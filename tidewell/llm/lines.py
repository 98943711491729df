r"""Line dedup: lines that more than THRESHOLD documents have are dropped from all of them.

Lines end at "\n". A line's key is its lower-cased text with runs of space, tab and carriage return as one space, trimmed,
hashed to 96 bits; documents are counted once per key. Only hashes are counted and joined; the text then meets the
dropped keys of its own document, one list a document, and what is left is reassembled by position.

Defined cases: lines with an empty key are neither counted nor dropped; a document whose lines all go is left with the empty
text; null and empty texts stay as they are; a document is a (doc_id, text), so rows repeated whole count once (a null doc_id
too), and each gets the result; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, fresh, others, read, stored

THRESHOLD = 10


def line_key(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[ \\t\\r]+", " "))


def _hash(line: Column) -> Column:
    key = line_key(line)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g")))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, dropped_col: str | None = None) -> DataFrame:
    """docs with the kept lines as text; dropped_col, if given, counts the lines that went (in place of a column of that name)."""
    who, bad, lines, kept = fresh(docs, "who", "bad", "lines", "kept")
    text = at("text")
    identity = F.struct(F.xxhash64(at("doc_id"), text).alias("a"), F.hash(text, at("doc_id")).alias("b"))
    keys = F.array_compact(F.array_distinct(F.transform(F.split(text, "\n", -1), _hash)))
    seen = stored(docs.where(text.isNotNull()).select(identity.alias("who"), F.explode(keys).alias("key")))
    often = seen.groupBy("key").agg(F.count_distinct("who").alias("n")).where(F.col("n") > threshold).select("key")
    mine = seen.join(often, "key").groupBy(F.col("who").alias(who)).agg(F.collect_set("key").alias(bad))
    out = docs.withColumn(who, identity).join(mine, who, "left")
    out = out.withColumn(lines, F.when(at(bad).isNotNull(), F.split(text, "\n", -1)))
    out = out.withColumn(kept, F.filter(at(lines), lambda x: ~F.coalesce(F.array_contains(at(bad), _hash(x)), F.lit(False))))
    new = F.when(at(bad).isNull(), text).otherwise(F.array_join(at(kept), "\n"))
    count = F.when(at(bad).isNull(), F.lit(0)).otherwise(F.size(at(lines)) - F.size(at(kept)))
    return out.select(*(new.alias(c) if c == "text" else at(c) for c in others(docs, dropped_col)), *([count.cast("long").alias(dropped_col)] if dropped_col else []))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), dropped_col="dropped")


SQL = {
    "op2_line_dedup": rf"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
        n AS (SELECT *, trim(regexp_replace(lower(line), '[ \t\r]+', ' ', 'g')) AS key FROM l),
        c AS (SELECT key FROM n WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) > {THRESHOLD}),
        k AS (SELECT n.*, c.key IS NOT NULL AS gone FROM n LEFT JOIN c ON n.key = c.key),
        r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS left_, count(*) FILTER (WHERE gone) AS dropped FROM k GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_, '') END AS text, coalesce(dropped, 0) AS dropped
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
}
QUERIES = {"op2_line_dedup": op2_line_dedup}
