r"""Mixing sources to target weights.

Tokens (words) are summed per source over all documents; source s with whole-number weight w_s gets the repetition rate
w_s * total / (sum of weights * tokens_s); each document is emitted floor(rate) times, and once more if its draw, the
first 52 bits of md5("seed:doc_id") as a fraction, lies below the fraction of the rate.

Defined cases: a null source counts as the source ""; sources without a weight have default_weight; a source without any
token has the rate 1 (its documents pass as they are) and no part in the sum of weights; a null text has no token; a null
doc_id draws as ""; repeated rows draw alike; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, at, fresh, others, read, small, stored, words

WEIGHTS, DEFAULT_WEIGHT, SEED = {"src0": 300}, 36, 17


def source_rates(docs: DataFrame, weights: dict[str, int], default_weight: int, target_tokens: int | None = None) -> DataFrame:
    """(source, tokens, rate), one row a source, stored."""
    per = docs.groupBy(F.coalesce(at("source"), F.lit("")).alias("source")).agg(F.sum(words(at("text"))).alias("tokens"))
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(default_weight)) if pairs else F.lit(default_weight)
    per = stored(per.withColumn("weight", weight.cast("long")))
    sums = per.where("tokens > 0").agg(F.sum("weight").alias("weights"), F.sum("tokens").alias("total")).first()
    goal = (sums.total or 0) if target_tokens is None else target_tokens
    rate = (F.col("weight") * F.lit(goal).cast("long")).cast("double") / (F.lit(sums.weights or 1).cast("long") * F.col("tokens")).cast("double")
    return per.select("source", "tokens", F.when(F.col("tokens") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT, seed: int = SEED, target_tokens: int | None = None, copy_col: str | None = None) -> DataFrame:
    """The documents, each as often as its source's rate says; copy_col, if given, numbers the copies of a row from 1 (in place of a
    column of that name).

    The rates are one row a source and are broadcast only if they are few; the documents then stay where they are."""
    key, rate, copies, no = fresh(docs, "source", "rate", "copies", "copy")
    rates = small(stored(source_rates(docs, weights, default_weight, target_tokens)))
    rates = rates.select(F.col("source").alias(key), F.col("rate").alias(rate))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(at("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    whole = F.floor(at(rate))
    out = docs.withColumn(key, F.coalesce(at("source"), F.lit(""))).join(rates, key)
    out = out.withColumn(copies, (whole + F.when(draw < at(rate) - whole, 1).otherwise(0)).cast("int")).where(at(copies) > 0)
    out = out.withColumn(no, F.explode(F.sequence(F.lit(1), at(copies))))
    return out.select(*(at(c) for c in others(docs, copy_col)), *([at(no).cast("long").alias(copy_col)] if copy_col else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), copy_col="copy").select("doc_id", "source", "copy")


_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
SQL_CTE = f"""
    d AS (SELECT *, coalesce(source, '') AS s_, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS n_ FROM {{docs}}),
    p AS (SELECT s_, sum(n_)::BIGINT AS tok, (CASE s_ {_CASE} ELSE {DEFAULT_WEIGHT} END)::BIGINT AS w FROM d GROUP BY s_),
    t AS (SELECT sum(w)::BIGINT AS sw, sum(tok)::BIGINT AS total FROM p WHERE tok > 0),
    r AS (SELECT s_, CASE WHEN tok > 0 THEN (w * total)::DOUBLE / (sw * tok)::DOUBLE ELSE 1.0::DOUBLE END AS rate FROM p, t),
    e AS (SELECT d.*, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
          / 4503599627370496::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies_ FROM d JOIN r USING (s_))"""
SQL = {"op4_mixing": "WITH " + SQL_CTE.format(docs="documents") + " SELECT doc_id, source, unnest(range(1, copies_ + 1)) AS copy FROM e"}
QUERIES = {"op4_mixing": op4_mixing}
