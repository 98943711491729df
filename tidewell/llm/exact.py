"""Exact dedup that no hot text can stall.

Rows are combined three times, always by their whole content beside its digest: within each map task (the partial
aggregate), within (digest, salt), and over the salts of a digest. A text with a million copies is thus met by at most
`salts` merging tasks, each fed one row per map task, and its last combination sees at most `salts` rows.

Digests are counted first, without text; those met twice are kept as bits of a sieve of fixed size (SIEVE_BITS, 16 MB), so that
texts without a copy aren't shuffled at all: a row whose bit is not set has no copy. More repeated digests than bits make it pass
more rows, never fewer. Who has a copy is then told by joining (digest, doc_id) rows with the one winner of a digest, without
any list of ids; only where content showed two texts of one digest, their rows are told apart by content again.

Defined cases: a null text equals nothing and is kept; empty texts equal each other; the copy with the least doc_id stays
(a null doc_id comes last, then the least hash of the other columns decides); rows repeated whole leave one; an empty table
gives an empty result; extra columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at, fresh, read, small, stored

SALTS, SIEVE_BITS = 16, 1 << 27


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))


def sieve(docs: DataFrame, digest: Column, bits: int = SIEVE_BITS) -> DataFrame:
    """(bucket, bits): a bit for each digest that two rows or more have, packed by bucket."""
    often = docs.where(digest.isNotNull()).groupBy(digest.alias("digest")).agg(F.count("*").alias("n")).where("n > 1")
    slots = often.select(F.pmod("digest", F.lit(bits)).alias("slot"))
    return stored(slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")))


def sifted(docs: DataFrame, digest: Column, found: DataFrame, maybe: str, bits: int = SIEVE_BITS) -> DataFrame:
    """docs with `maybe`: whether the sieve holds the row's digest, as it does for every row that has a copy."""
    bucket, packed, slot = fresh(docs, "bucket", "bits", "slot")
    mine = F.broadcast(found.select(F.col("bucket").alias(bucket), F.col("bits").alias(packed)))  # at most bits / 8 bytes
    place = F.bitmap_bit_position(at(slot))
    byte = F.conv(F.hex(F.substring(at(packed), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2.0), place % 8).cast("int")) > 0
    out = docs.withColumn(slot, F.pmod(digest, F.lit(bits))).withColumn(bucket, F.bitmap_bucket_number(at(slot)))
    return out.join(mine, bucket, "left").withColumn(maybe, F.coalesce(hit, F.lit(False))).drop(bucket, packed, slot)


def exact_dedup(docs: DataFrame, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text", digest_of: Callable[[Column], Column] = F.xxhash64, bits: int = SIEVE_BITS) -> DataFrame:
    """The kept row of each text, with the columns of docs."""
    digest, salt, row, order, maybe = fresh(docs, "digest", "salt", "row", "order", "maybe")
    rest = [c for c in docs.columns if c != text_col]
    hashed = [at(f.name) for f in docs.schema.fields if f.name != text_col and _comparable(f.dataType)]
    text = at(text_col)
    key = F.when(text.isNotNull(), digest_of(text).cast("long"))
    flagged = sifted(docs, key, sieve(docs, key, bits), maybe, bits)
    keyed = flagged.where(at(maybe)).select(
        key.alias(digest),
        F.pmod(F.xxhash64(at(id_col)), F.lit(salts)).cast("int").alias(salt),
        text.alias(text_col),
        F.struct(*(at(c) for c in rest)).alias(row),
        F.struct(at(id_col).isNull(), at(id_col), F.xxhash64(*hashed)).alias(order),
    )
    first = [F.min_by(at(row), at(order)).alias(row), F.min(order).alias(order)]
    salted = keyed.groupBy(digest, salt, at(text_col)).agg(*first)
    whole = salted.groupBy(digest, at(text_col)).agg(first[0])
    kept = whole.select(*(at(c) if c == text_col else at(row).getField(c).alias(c) for c in docs.columns))
    return flagged.where(~at(maybe)).select(*(at(c) for c in docs.columns)).unionByName(kept)


def exact_copies(docs: DataFrame, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text", digest_of: Callable[[Column], Column] = F.xxhash64, bits: int = SIEVE_BITS) -> DataFrame:
    """(doc_id, keep_id) of every document that has the text of keep_id, the least doc_id with it. Rows without a
    doc_id or text appear in no pair."""
    rows = docs.where(at(text_col).isNotNull() & at(id_col).isNotNull()).select(at(text_col).alias("text"), at(id_col).alias("id"))
    digest = digest_of(F.col("text")).cast("long")
    flagged = sifted(rows, digest, sieve(rows, digest, bits), "maybe", bits).where("maybe").select(digest.alias("digest"), "text", "id")
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    salted = flagged.groupBy("digest", salt.alias("salt"), "text").agg(F.min("id").alias("id"))
    winners = salted.groupBy("digest", "text").agg(F.min("id").alias("keep_id"))
    tops = stored(winners.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id")))
    found = flagged.select("digest", "id").join(small(tops.where("texts = 1")), "digest").select("id", "keep_id")
    clashes = tops.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        told = winners.join(clashes, "digest", "left_semi")
        found = found.unionByName(flagged.join(told, ["digest", "text"]).select("id", "keep_id"))
    return found.where("id <> keep_id").distinct().select(F.col("id").alias("doc_id"), "keep_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(read(spark, sf_dir, "documents"))


SQL = {
    "op5_exact_dedup": """
        SELECT DISTINCT doc_id, keep_id FROM (
          SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents
          WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        WHERE doc_id <> keep_id"""
}
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
