"""Best-fit packing with large-item matching.

Documents become items of at most `capacity` tokens (words): a longer one fills whole bins with its leading pieces and
leaves its rest as an item. Items above a third of the capacity (no three fit one bin) are matched greedily: the largest left opens a
bin and takes the largest partner that fits. Smaller items then go, largest first, into the smallest gap that holds them, or
open a bin.

Only how many items have each size decides how bins are filled, and there are at most `capacity` sizes. So one packing of all items is
planned on those counts, equal bins in runs, and gives the same bins as taking items one by one; its size doesn't grow
with the items. Each item then finds its bin by its number among the items of its size, which comes from numbers within (size, shard)
and the counts of the shards before. Only (doc_id, length) is shuffled, never text; shards bound a task's rows and only decide
which of several equal items goes where.

Defined cases: null and empty texts have no token and are in no bin; a null doc_id stays null, any other is a whole number; items of equal size are
interchangeable: they go by shard (a hash of doc_id and length), then by doc_id and piece; repeated rows are items of their own; an empty
table gives an empty result; other columns are not read; texts of any length are packed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at, read, stored, words

CAPACITY, SHARD_ITEMS = 2048, 50_000
SCHEMA = "bin_id long, slot int, doc_id long, start long, tokens long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the items of each size go, as runs (size, first, each, bin, slot): items from number `first` of that size on lie
    `each` to a bin, from this bin and, in each bin, this slot on."""
    left = {s: n for s, n in counts.items() if n}
    there = sum(1 << s for s in left if 3 * s > capacity)
    runs, numbered, bins = [], dict.fromkeys(left, 0), 0
    holes: dict[int, list[tuple[int, int, int]]] = {}  # gap -> (first bin, bins, filled slots)
    open_ = 0

    def put(size: int, n: int, each: int, first_bin: int, slot: int) -> None:
        runs.append((size, numbered[size], each, first_bin, slot))
        numbered[size] += n

    def free(gap: int, first_bin: int, n: int, slots: int) -> None:
        nonlocal open_
        if gap and n:
            holes.setdefault(gap, []).append((first_bin, n, slots))
            open_ |= 1 << gap

    for s in sorted((x for x in left if 3 * x > capacity), reverse=True):
        while n := left[s]:
            own = there & ~(1 << s) if n == 1 else there
            p = (own & ((1 << (min(capacity - s, s) + 1)) - 1)).bit_length() - 1
            if p <= 0:
                k, gap, slots = n, capacity - s, 1
                put(s, k, 1, bins, 0)
                left[s] = 0
            elif p == s:
                k, gap, slots = n // 2, capacity - 2 * s, 2
                put(s, 2 * k, 2, bins, 0)
                left[s] -= 2 * k
            else:
                k, gap, slots = min(n, left[p]), capacity - s - p, 2
                put(s, k, 1, bins, 0)
                put(p, k, 1, bins, 1)
                left[s] -= k
                left[p] -= k
                if not left[p]:
                    there &= ~(1 << p)
            free(gap, bins, k, slots)
            bins += k
        there &= ~(1 << s)
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[s]
        while n:
            fits = open_ >> s
            if fits:
                gap = (fits & -fits).bit_length() - 1 + s
                first, many, slot = holes[gap].pop()
                if not holes[gap]:
                    open_ &= ~(1 << gap)
            else:
                gap, first, slot, many = capacity, bins, 0, -(-n // (capacity // s))
                bins += many
            each = gap // s
            full = min(many, n // each)
            if full:
                put(s, full * each, each, first, slot)
                free(gap - each * s, first, full, slot + each)
                n -= full * each
            if n and full < many:
                put(s, n, n, first + full, slot)
                free(gap - n * s, first + full, 1, slot + n)
                n, full = 0, full + 1
            free(gap, first + full, many - full, slot)
    return runs


class Places:
    """Looks up (bin, slot) by size and number."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]) -> None:
        table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
        self.key, self.first, self.each, self.bin, self.slot = (table[:, 0] << 44) + table[:, 1], *table[:, 1:].T

    def __call__(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (size << 44) + number, side="right") - 1
        past = number - self.first[k]
        return self.bin[k] + past // self.each[k], self.slot[k] + past % self.each[k]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes are from 1 to capacity. Equal sizes go in their order in the list."""
    size = np.array(sizes, dtype=np.int64)
    order = np.argsort(size, kind="stable")
    kinds, starts, n = np.unique(size[order], return_index=True, return_counts=True)
    number = np.empty(len(size), dtype=np.int64)
    number[order] = np.arange(len(size)) - np.repeat(starts, n)
    places = Places(plan(dict(zip(kinds.tolist(), n.tolist(), strict=True)), capacity))
    return places(size, number)[0].tolist() if len(size) else []


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(bin_id, slot, doc_id, start, tokens): tokens words of doc_id from its word `start` on lie in that slot of the bin."""
    spread = F.when(at("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)  # those rows are alike but for their length
    items = stored(docs.select(at("doc_id").cast("long").alias("doc_id"), words(at("text")).alias("n"), spread.alias("spread")).where("n > 0"))
    shards = max(1, -(-items.count() // shard_items))
    first = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity)), lambda k: k * capacity))
    pieces = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "spread"), F.lit(shards))).withColumn("start", first)
    pieces = pieces.select("shard", "doc_id", "start", F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("long").alias("tokens"))
    counts = stored(pieces.groupBy("tokens", "shard").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    places = Places(plan({r.tokens: r.n for r in sizes}, capacity))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("tokens", "shard", upto.alias("before"))
    row = F.row_number().over(Window.partitionBy("tokens", "shard").orderBy("doc_id", "start"))
    numbered = pieces.withColumn("row", row).join(before, ["tokens", "shard"]).select("doc_id", "start", "tokens", (F.col("before") + F.col("row") - 1).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, slot = places(b.column(2).to_numpy(), b.column(3).to_numpy()) if b.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(slot.astype(np.int32)), b.column(0), b.column(1), b.column(2)], ["bin_id", "slot", "doc_id", "start", "tokens"])

    return numbered.mapInArrow(run, SCHEMA)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
