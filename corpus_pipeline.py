"""The corpus pipeline: toxic documents go, then exact and near copies; sources are mixed to their weights; the rest is packed.

Defined cases, as each stage's operator states them: a null text is not toxic, equals nothing, is like nothing, has no token and so comes
into no bin; an empty one likewise, but that equal empty texts leave one; a row without a doc_id is kept unless another row has its
text, and its bins say null; of rows repeated whole one stays; ties go by doc_id; very long texts are read whole and fill several bins;
an empty table gives an empty result at each stage; extra columns, of whatever names, pass through to the last stage, which
returns its own columns only. Without labels of both kinds no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import common, exact, mixing, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_bins),
]
#: A trained model, an LSH forest and greedy packing have no SQL; tests/llm holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
