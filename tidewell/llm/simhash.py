"""SimHash near-dedup through an LSH forest.

Each document gets a 256-bit SimHash of its set of words and a 128-bit one of its set of word pairs. Documents with equal
hashes are one point from the start, so thousands of copies cost one row each, once. Every point is a query in each tree; a
tree orders the points by the bits of the first hash in a random order of its own, and points that share a prefix share a bucket.

Depth follows density. forest() takes the depth at which a bucket is expected to hold BUCKET points, and as many trees as a pair at
the DESIGN distance, the farthest that the verifier accepts, needs to meet with probability TARGET: deeper prefixes are bought
with more trees (their number grows as about points ** 0.43). Within a bucket, which is one task's work, a forest of further tries goes on:
prefixes over fresh bit orders deepen with the number of points until few unlike ones (DENSE) share one, and the number of tries
keeps the recall at the DESIGN distance at LOCAL_TARGET (INNER_TARGET further in); forest() counts with that loss. Seen from a point,
its query starts at the deep prefixes of a dense place or at the short ones of a sparse place, which is as far up as it has to
climb for the target recall there, and no farther.

Groups of near copies don't cost their square: random pivots are compared with a whole dense bucket first, hits are united at once,
and points that are known to be linked are not compared again; only the few outside of a bucket's main group meet all of it.
A bucket of more than HOT points is never one task's: its points are compared with a pivot; if few lie outside of the pivot's
group, the group is dealt to salts and the others go to each; else the bucket's points get deeper prefixes in several tries, as
in a task. No bucket, query or partner count is capped, and none is left out.

Candidates are verified by the whole hashes: at most MAX_WORDS of 256 bits and at most MAX_PAIRS of 128 bits apart (a
cosine of about 0.83 and 0.6). Verified links leave a bucket as stars, so a group of n sends n rows, and connected
components over the stars give the groups; the least doc_id of a group is kept.

Defined cases: words are runs of letters and digits, lower-cased; a null text or one without any word is like nothing and is
kept; texts of one word have no pair and are alike only if all their bits are; rows of the same doc_id (a whole number) are one document; a
row without a doc_id is like nothing and is kept; an empty table gives an empty result; extra columns pass through; texts of
any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, drop, fresh, read, small, stored

BITS, PAIR_BITS, TREES, TARGET = 256, 128, 16, 0.95
BUCKET, HOT, HOT_KEYS, PIVOTS, DEEPER = 1_000_000, 2_000_000, 1_000_000, 8, 8
MAX_WORDS, MAX_PAIRS, DENSE, LOCAL_TARGET, INNER_TARGET, UNLIKE = 48, 38, 512, 0.75, 0.98, 0.38
DESIGN = MAX_WORDS / BITS
PENDING = 1_000_000  # pairs held at once
SIGS = "id long, h binary"


def _bits(h: np.ndarray, words: int) -> np.ndarray:
    """64 * words pseudo-random bits of each 64-bit hash, as bytes of 0 and 1."""
    out = np.empty((len(h), words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = x ^ (x >> np.uint64(31))
    return np.unpackbits(out.view(np.uint8), axis=1)


LETTER = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, dtype=np.uint64)], dtype=np.uint64) for x in (BASE, pow(BASE, -1, 2**64)))
        return self.up[:n], self.down[:n]


def word_hashes(texts: list[str | None], powers: Powers) -> list[np.ndarray]:
    """The 64-bit hash of each word of each text, in order; a word is a run of letters and digits, lower-cased."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    inside = LETTER[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)
        h = (total[ends - 1] - total[starts - 1]) * down[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    places = np.cumsum([1, *(len(x) + 1 for x in parts)])
    return np.split(h, np.searchsorted(starts, places[1:-1])) if parts else []


def simhashes(texts: list[str | None], powers: Powers) -> list[bytes | None]:
    """The 48 bytes of both hashes of each text; None without a word."""
    return [_both(h) for h in word_hashes(texts, powers)]


def _both(h: np.ndarray) -> bytes | None:
    if not len(h):
        return None
    one = _distinct(h)
    with np.errstate(over="ignore"):
        pairs = _distinct(h[:-1] * np.uint64(BASE) + (h[1:] ^ (h[1:] >> np.uint64(29))))
    out = [2 * _count(keys, bits) > len(keys) for keys, bits in ((one, BITS), (pairs, PAIR_BITS))]
    return np.packbits(np.concatenate(out)).tobytes()


def chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """Runs of whole texts of about so many characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _count(keys: np.ndarray, bits: int) -> np.ndarray:
    """How many keys have each bit. Eight byte-wide counters are added at once, so at most 255 rows at a time."""
    total = np.zeros(bits, dtype=np.int64)
    for k in range(0, len(keys), 4080):
        part = _bits(keys[k : k + 4080], bits // 64).view(np.uint64)
        for m in range(0, len(part), 255):
            total += part[m : m + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def signatures(docs: DataFrame) -> DataFrame:
    """(id, h) of the documents that have an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            texts = b.column(1).to_pylist()
            h = [x for part in chunks(texts) for x in simhashes(part, powers)]
            keep = pa.array([x is not None for x in h])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary())], ["id", "h"]).filter(keep)

    return docs.where(at("doc_id").isNotNull() & at("text").isNotNull()).select(at("doc_id").cast("long").alias("id"), at("text").alias("text")).mapInArrow(run, SIGS)


def climb_depth(trees: int = TREES, design: float = DESIGN, target: float = TARGET, local: float = LOCAL_TARGET) -> int:
    """The deepest prefix at which a pair at the design distance meets in one of the trees, and is found there by a bucket's
    forest, with the target's probability."""
    k = 1
    while 1 - (1 - local * (1 - design) ** (k + 1)) ** trees >= target:
        k += 1
    return k


def forest(points: int, bucket: int = BUCKET) -> tuple[int, int]:
    """(depth, trees) for so many points: prefixes deep enough for buckets of about `bucket` points, and trees enough for TARGET."""
    depth = max(climb_depth(), int(np.ceil(np.log(max(points / bucket, 1)) / -np.log(1 - UNLIKE))))
    return depth, tries(depth, TARGET, LOCAL_TARGET)


def tries(depth: int, target: float, inner: float = 1.0, design: float = DESIGN) -> int:
    """How many prefixes of this depth bring a pair at the design distance together with the target's probability."""
    return int(np.ceil(np.log(1 - target) / np.log1p(-inner * (1 - design) ** depth)))


def bit_orders(trees: int, depth: int, seed: int = 0) -> np.ndarray:
    """For each tree the first bits of its order."""
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(BITS)[:depth] for _ in range(trees)])


def prefixes(bits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The chosen bits of each row as a number."""
    return bits[:, order].astype(np.int64) @ (1 << np.arange(len(order), dtype=np.int64))


def packed_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """prefixes() of rows of packed 64-bit words, without their bits spread out."""
    raw, out = words.view(np.uint8), np.zeros(len(words), dtype=np.int64)
    for k, bit in enumerate(order.tolist()):
        out |= ((raw[:, bit >> 3] >> np.uint8(7 - (bit & 7))) & 1).astype(np.int64) << k
    return out


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether hashes (rows of six 64-bit words) verify as near copies."""
    d = np.bitwise_count(a ^ b)
    return (d[..., :4].sum(-1, dtype=np.int32) <= MAX_WORDS) & (d[..., 4:].sum(-1, dtype=np.int32) <= MAX_PAIRS)


class Known:
    """Which rows are linked so far: label is the least row of each row's group. Without `skip`, nothing counts as known."""

    def __init__(self, n: int, skip: bool = True) -> None:
        self.label, self.skip, self.left, self.right, self.held = np.arange(n), skip, [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray, at_once: bool = False) -> None:
        if not self.skip:
            return
        self.left.append(i), self.right.append(j)
        self.held += len(i)
        if at_once or self.held >= min(PENDING, max(1000, len(self.label) // 4)):
            self.fold()

    def fold(self) -> None:
        if self.held:
            self.label = stars(len(self.label), np.concatenate([np.arange(len(self.label)), *self.left]), np.concatenate([self.label, *self.right]))
            self.left, self.right, self.held = [], [], 0

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.label[i] != self.label[j] if self.skip else np.ones(np.broadcast(i, j).shape, dtype=bool)


def _across(words: np.ndarray, few: np.ndarray, rows: np.ndarray, known: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of a row of `few` with one of `rows`."""
    for f in few.tolist():
        other = rows[known.apart(rows, np.int64(f)) & (rows != f)] if known.skip else rows[rows > f]
        hit = other[near(words[other], words[f])]
        if len(hit):
            known.add(hit, np.full(len(hit), f))
            yield np.minimum(hit, f), np.maximum(hit, f)


def _dense(words: np.ndarray, rows: np.ndarray, dense: int, level: int, known: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs within one dense bucket."""
    own = words[rows]
    rng = np.random.default_rng(int(np.bitwise_xor.reduce(own[:, 0])) ^ level)  # by content: a pair's buckets in other trees differ
    others, missed = rows, 0
    while known.skip and missed < PIVOTS and len(others) > dense:
        pivot = int(rng.choice(others))
        hit = rows[near(own, words[pivot]) & (rows != pivot)]
        if len(hit):
            known.add(hit, np.full(len(hit), pivot), at_once=True)
            yield np.minimum(hit, pivot), np.maximum(hit, pivot)
        missed = 0 if 16 * len(hit) >= len(others) else missed + 1
        label, n = np.unique(known.label[rows], return_counts=True)
        others = rows[known.label[rows] != label[np.argmax(n)]]
    if known.skip and len(others) <= dense:
        yield from _across(words, others, rows, known)
        return
    n = len(others) if known.skip else len(rows)
    same = len(np.unique(own[: 4 * dense, 0])) < dense  # texts of the same words in other orders: only their pairs differ
    first, size, design = (BITS, PAIR_BITS, MAX_PAIRS / PAIR_BITS) if same else (0, BITS, DESIGN)
    depth = min(60, max(4, int(np.ceil(np.log(n / 32) / -np.log(1 - UNLIKE)))))
    for _ in range(tries(depth, INNER_TARGET if level else LOCAL_TARGET, design=design)):
        k = packed_prefixes(own, first + rng.permutation(size)[:depth])
        if (k == k[0]).all():  # nothing parts these rows
            yield from _across(words, others, rows, known)
            return
        by = np.argsort(k, kind="stable")
        yield from _pairs(words, rows[by], k[by], dense, level + 1, known)


def _pairs(words: np.ndarray, rows: np.ndarray, keys: np.ndarray, dense: int, level: int, known: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs among the rows (numbers into words) that share a key; they come sorted by key."""
    if not len(keys):
        return
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of, end_of = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes)
    at_ = np.flatnonzero((size_of <= dense) & (size_of > 1))
    step = 1
    while len(at_ := at_[at_ + step < end_of[at_]]):
        for part in np.array_split(at_, -(-len(at_) // 65536)):
            i, j = rows[part], rows[part + step]
            if known.skip:
                new = known.label[i] != known.label[j]
                i, j = i[new], j[new]
            hit = near(words[i], words[j])
            if hit.any():
                i, j = i[hit], j[hit]
                known.add(i, j)
                yield np.minimum(i, j), np.maximum(i, j)
        step += 1
    for s, n in zip(starts[sizes > dense].tolist(), sizes[sizes > dense].tolist(), strict=True):
        yield from _dense(words, rows[s : s + n], dense, level, known)


def linked(words: np.ndarray, keys: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """All verified pairs that the search meets among the rows that share a key (sorted by key), pairs within known groups too."""
    found = list(_pairs(words, np.arange(len(keys)), keys, dense, 0, Known(len(keys), skip=False)))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def linked_stars(words: np.ndarray, keys: np.ndarray, dense: int = DENSE, main: np.ndarray | None = None) -> np.ndarray:
    """For each row the least row of its group, by verified pairs among the rows that share a key (sorted by key). Rows marked
    as main are one group within each key from the start."""
    known = Known(len(keys))
    if main is not None and main.any():
        at_ = np.flatnonzero(main)
        same = keys[at_[1:]] == keys[at_[:-1]]
        known.add(at_[1:][same], at_[:-1][same], at_once=True)
    for _ in _pairs(words, np.arange(len(keys)), keys, dense, 0, known):
        pass
    known.fold()
    return known.label


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that pairs link it to."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        after = least.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, least[i], low)
        np.minimum.at(after, least[j], low)
        after = after[after]
        if (after == least).all():
            return least
        least = after


def _hashes(column: pa.Array) -> np.ndarray:
    """A column of 48-byte hashes as rows of six 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, 6)


def _counted(orders: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hashes(b.column(1))
            for t, order in enumerate(orders):
                key, n = np.unique(packed_prefixes(h, order) * len(orders) + t, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return run


def _planted(orders: np.ndarray, hot: np.ndarray, want_hot: bool):
    """Points (id, h) -> (key, id, h, main) in each tree, in hot buckets or in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hashes(b.column(1))
            for t, order in enumerate(orders):
                key = packed_prefixes(h, order) * len(orders) + t
                full = pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1), pa.array(np.zeros(len(key), dtype=bool))], ["key", "id", "h", "main"])
                yield full.filter(pa.array(np.isin(key, hot) == want_hot)) if len(hot) else full

    return run


def _deeper(level: int):
    """Rows (key, id, h) -> (key, id, h) in the deeper prefixes of several tries; every third level takes bits of word pairs."""
    pairs = level % 3 == 2
    first, size, design = (BITS, PAIR_BITS, MAX_PAIRS / PAIR_BITS) if pairs else (0, BITS, DESIGN)
    rng = np.random.default_rng(1000 + level)
    orders = [first + rng.permutation(size)[:DEEPER] for _ in range(tries(DEEPER, INNER_TARGET, design=design))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, key = _hashes(b.column(2)), b.column(0).to_numpy().view(np.uint64)
            for t, order in enumerate(orders):
                with np.errstate(over="ignore"):
                    x = (key ^ (packed_prefixes(h, order).view(np.uint64) * np.uint64(1024) + np.uint64(t))) * np.uint64(BASE) + key
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    x ^= x >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), b.column(1), b.column(2)], ["key", "id", "h"])

    return run


def _beside_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, h, pivot, pivot_h) -> (key, id, h, main, pivot): whether a row is the pivot or verifies with it."""
    for b in batches:
        main = near(_hashes(b.column(2)), _hashes(b.column(4)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(main), b.column(3)], ["key", "id", "h", "main", "pivot"])


def hot_links(rows: DataFrame, hot: int, level: int = 0) -> DataFrame:
    """Links (a, b) among rows (key, id, h) that share a key, for keys of more than `hot` rows each."""
    pivots = rows.groupBy("key").agg(F.min_by(F.struct("id", "h"), F.struct(F.xxhash64("id", F.lit(level)), "id")).alias("p"))
    pivots = stored(pivots.select("key", F.col("p.id").alias("pivot"), F.col("p.h").alias("pivot_h")))
    beside = stored(rows.join(small(pivots), "key").select("key", "id", "h", "pivot", "pivot_h").mapInArrow(_beside_pivot, "key long, id long, h binary, main boolean, pivot long"))
    stars_ = beside.where("main AND id <> pivot").select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b"))
    sizes = stored(beside.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("main"), 1).otherwise(0)).alias("others")))
    marked = beside.drop("pivot").join(small(sizes), "key")
    near_one = marked.where(F.col("others") <= hot)
    salts = F.ceil(F.col("n") / hot).cast("int")
    mine = F.when(F.col("main"), F.array(F.pmod(F.xxhash64("id"), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
    dealt = near_one.withColumn("salt", F.explode(mine)).select(F.xxhash64("key", "salt").alias("key"), "id", "h", "main")
    found = stars_.unionByName(harvested(dealt))
    wide = sizes.where(F.col("others") > hot)
    if wide.isEmpty():
        return found
    deeper = stored(marked.where(F.col("others") > hot).select("key", "id", "h").mapInArrow(_deeper(level), "key long, id long, h binary"))
    counts = stored(deeper.groupBy("key").agg(F.count("*").alias("n")))
    sized = deeper.join(small(counts), "key")
    found = found.unionByName(harvested(sized.where(F.col("n") <= hot).select("key", "id", "h", F.lit(False).alias("main"))))
    rest = stored(sized.where(F.col("n") > hot).select("key", "id", "h"))
    return found if rest.isEmpty() else found.unionByName(hot_links(rest, hot, level + 1))


def harvested(planted: DataFrame) -> DataFrame:
    """Links (a, b) among planted rows (key, id, h, main) that share a key: each bucket is whole in one task."""
    return planted.repartition("key").sortWithinPartitions("key").mapInArrow(_harvest, "a long, b long")


def _harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole partitions in the order of key -> stars (a, b) with a > b."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal parts, held
        k, i, h, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = len(k) if last else int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
        parts, held = [(k[n:], i[n:], h[n:], m[n:])], 0
        k, i, h, m = k[:n], i[:n], h[:n], m[:n]
        order = np.lexsort((i, k))
        k, i, h, m = k[order], i[order], h[order], m[order]
        least = linked_stars(h, k, main=m)
        # rows lie by (key, id): the least row of a group within a key has its least id
        moved = np.flatnonzero(least != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(i[moved]), pa.array(i[least[moved]])], ["a", "b"])

    for b in batches:
        if b.num_rows:
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _hashes(b.column(2)), b.column(3).to_numpy(zero_copy_only=False)))
            held += b.num_rows
            if held >= 100_000:
                yield from out(False)
    if parts:
        yield from out(True)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id of links (a > b) but the roots: its component's least id. Alternates large and small stars
    until nothing changes; each round is one shuffle by id, and hooks at least halve the longest path."""
    edges, before = stored(links.distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))  # large star
        rest = edges.join(low, "a")
        small = rest.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = stored(big.unionByName(small).unionByName(rest.select("a", F.col("low").alias("b"))).where("a > b").distinct())
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = after
        if sums == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = sums


def near_copies(docs: DataFrame, trees: int | None = None, depth: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id) of every document that is in the group of keep_id, the group's least doc_id."""
    sigs = stored(signatures(docs))
    points = stored(sigs.groupBy("h").agg(F.min("id").alias("id")).select("id", "h"))
    n = points.count()
    deep, many = forest(n)
    orders = bit_orders(trees or many, depth or deep)
    most = max(hot, -(-n * len(orders) // HOT_KEYS))  # so that there are at most HOT_KEYS hot keys, whatever the points
    counts = points.mapInArrow(_counted(orders), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = np.array(sorted(r.key for r in counts.where(F.col("n") > most).collect()), dtype=np.int64)
    found = harvested(points.mapInArrow(_planted(orders, keys, False), "key long, id long, h binary, main boolean"))
    if len(keys):
        rows = stored(points.mapInArrow(_planted(orders, keys, True), "key long, id long, h binary, main boolean").drop("main"))
        found = found.unionByName(hot_links(rows, most))
    roots = components(found)
    same = sigs.join(sigs.groupBy("h").agg(F.min("id").alias("first")), "h").select("id", "first")
    out = same.join(roots.select(F.col("id").alias("first"), "root"), "first", "left").select("id", F.coalesce("root", "first").alias("keep_id"))
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.min("keep_id").alias("keep_id")).where("doc_id <> keep_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, and all others, with the columns of docs."""
    (gone,) = fresh(docs, "gone")
    losers = near_copies(docs).select(F.col("doc_id").alias(gone))
    return docs.join(losers, at("doc_id") == at(gone), "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_simhash": op6_simhash}
