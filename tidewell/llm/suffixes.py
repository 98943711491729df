"""Repeated passages through merged Burrows-Wheeler transforms of words.

A passage of LENGTH words that occurs at two places, in one document or two, is found at both. Three steps:

1. Anchors. Of each LENGTH-word window the 8-word run of least hash is kept (the leftmost on ties), so equal windows keep
   equal anchors. Anchors are counted over all documents; only those met twice can lie in a repeated passage.
2. Windows. Around each such anchor the words that a repeated passage over it could span go to the anchor's bucket, as
   32-bit word hashes; overlapping windows of a document in a bucket are joined, so no place is there twice.
3. Transforms. A bucket's windows are split into shards. For a shard, the word suffixes are ordered by LENGTH words, and
   its transform is kept: for each suffix in order, the STEP words before it. Shard transforms are merged by iterative
   refinement of their interleave, without sorting suffixes again: round h holds the suffixes' order by their first h * STEP
   words, and a stable distribution by the symbols in front gives round h + 1. Where a round first parts two neighbours,
   their common prefix is shorter than its words; after LENGTH / STEP rounds, intervals that no boundary parts share
   LENGTH words, and those with two suffixes are the repeats.

The words of a bucket are bounded: the number of buckets follows from the counted anchors, and an anchor with more windows than fill a quarter of a
bucket (HOT) goes to none. Windows over such hot anchors, one per place and nothing around it, are hashed whole (128 bits) and counted
before they are shuffled, which splits a hot anchor by all of its contexts, so that a passage in a third of all documents is no
task's load. Which windows those are is read from bits of a fixed number (SIEVE_BITS); a bit that another anchor shares makes more
windows go this way too, with the same result.

Defined cases: words are runs of characters other than ASCII white space, compared as bytes; doc_id is a whole number; null, empty and shorter texts have no
passage; a document is a (doc_id, text), so rows repeated whole are one document; a row without a doc_id is reported
with null; spans that touch or overlap are one; texts of any length are read whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at, read, small, stored

LENGTH, STEP, GRAM, BUCKET_WORDS, SHARD_WORDS = 50, 10, 8, 1_500_000, 500_000
HOT, SIEVE_BITS, SIEVE_PART = BUCKET_WORDS // (4 * (2 * LENGTH - GRAM)), 1 << 27, 32768
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BASE = 0x9E3779B97F4A7C15
SPANS = "doc_id long, who long, start long, end long"


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_up, _down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, kept as far as they were needed."""
    global _up, _down
    if len(_up) < n:
        with np.errstate(over="ignore"):
            _up, _down = (np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, b, dtype=np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 2**64)))
    return _up[:n], _down[:n]


def run_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run x[start:end]."""
    up, down = powers(len(x) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])
        return mixed((total[ends] - total[starts]) * down[starts])


def words_of(texts: list[str]) -> list[np.ndarray]:
    """The 64-bit hash of each word of each text, in order."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    inside = ~SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    places = np.cumsum([1, *(len(x) + 1 for x in parts)])
    return np.split(run_hashes(raw, starts, ends), np.searchsorted(starts, places[1:-1]))


def least_grams(words: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of length words the place of its least gram, and the hash of the gram at each place."""
    n, wide = len(words) - gram + 1, length - gram + 1
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = run_hashes(words, np.arange(n), np.arange(n) + gram)
    low = np.uint64(n.bit_length())  # the hash's upper bits, then the place: ties go to the left
    key = ((h >> low) << low) | np.arange(n, dtype=np.uint64)
    size = -(-n // wide) * wide
    block = np.concatenate([key, np.full(size - n, np.iinfo(np.uint64).max)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - wide + 1], ahead[wide - 1 : n])
    return (least & np.uint64((1 << int(low)) - 1)).astype(np.int64), h


def anchors(words: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the least gram of each window of length words."""
    place, h = least_grams(words, length, gram)
    place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place  # places never go back
    return place, h[place]


def distribute(symbols: np.ndarray) -> np.ndarray:
    """The stable order of symbols below 2**48, by passes over 16 bits."""
    digits = np.ascontiguousarray(symbols).view(np.uint16).reshape(-1, 4)  # little-endian
    order = np.argsort(digits[:, 0], kind="stable")
    for k in (1, 2):
        order = order[np.argsort(digits[order, k], kind="stable")]
    return order


class Shard:
    """Strings of word hashes and their transform.

    Each string has STEP more suffixes at its end, so that the suffix STEP words before another exists for all, in a
    circle. Suffixes without STEP whole words in front or behind have symbols of their own, which equal no other.
    order: suffixes by their first LENGTH words; front: the symbol before each, in that order; place: where it starts."""

    def __init__(self, front: np.ndarray, place: np.ndarray, bound: np.ndarray) -> None:
        self.front, self.place, self.bound = front, place, bound


def symbols(strings: list[np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
    """For all suffixes of all strings, laid end to end: a symbol for the step words from there on (a hash below 2**47; where fewer
    words are left, a number of its own above), and the suffix step words before, in the string's circle."""
    sizes = np.array([len(s) + step for s in strings])
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    flat = np.zeros(total, dtype=np.uint64)
    for s, a in zip(strings, starts, strict=True):
        flat[a : a + len(s)] = s
    own = np.repeat(starts, sizes)
    rel = np.arange(total) - own
    size = np.repeat(sizes, sizes)
    whole = np.flatnonzero(rel <= size - 2 * step)
    out = np.arange(total, dtype=np.uint64) | np.uint64(1 << 47)
    out[whole] = run_hashes(flat, whole, whole + step) >> np.uint64(17)
    return out, own + (rel - step) % size


def build(code: np.ndarray, before: np.ndarray, member: np.ndarray, rounds: int) -> Shard:
    """The transform of the suffixes `member` (whole strings of them): the only sort, within one shard."""
    order = member
    after = np.empty(len(code), dtype=np.int64)
    after[before] = np.arange(len(code))
    hop = [member]
    for _ in range(rounds - 1):
        hop.append(after[hop[-1]])
    rank = np.arange(len(member))
    for h in reversed(hop):
        rank = rank[distribute(code[h[rank]])]
    order = member[rank]
    fresh_ = np.zeros(len(member), dtype=bool)
    fresh_[:1] = True
    for h in hop:
        c = code[h[rank]]
        fresh_[1:] |= c[1:] != c[:-1]
    return Shard(code[before[order]], order, fresh_)


def merge(a: Shard, b: Shard, rounds: int) -> Shard:
    """Interleaves two transforms. source says for each merged place which transform its suffix comes from; each round
    reads the symbols in that order and distributes them stably, and splits the intervals that it finds unequal."""
    n = len(a.front) + len(b.front)
    source = np.zeros(n, dtype=bool)
    source[len(a.front) :] = True
    bound = np.zeros(n, dtype=bool)
    bound[:1] = True
    read_ = np.empty(n, dtype=np.uint64)
    for _ in range(rounds):
        read_[~source], read_[source] = a.front, b.front
        order = distribute(read_)
        interval, sym = np.cumsum(bound)[order], read_[order]
        source = source[order]
        bound = np.ones(n, dtype=bool)
        bound[1:] = (sym[1:] != sym[:-1]) | (interval[1:] != interval[:-1])
    front, place = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.int64)
    front[~source], front[source] = a.front, b.front
    place[~source], place[source] = a.place, b.place
    return Shard(front, place, bound)


def repeated(strings: list[np.ndarray], length: int = LENGTH, step: int = STEP, shard_words: int = SHARD_WORDS) -> list[np.ndarray]:
    """For each string the places at which length words start that start elsewhere in the strings too."""
    if not strings:
        return []
    rounds = length // step
    code, before = symbols(strings, step)
    ends = np.cumsum([len(s) + step for s in strings])
    cuts = [0, *(int(ends[k]) for k in np.flatnonzero(np.diff(ends // shard_words)) ), int(ends[-1])]
    shards = [build(code, before, np.arange(x, y), rounds) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
    while len(shards) > 1:
        shards = [merge(*shards[k : k + 2], rounds) if k + 1 < len(shards) else shards[k] for k in range(0, len(shards), 2)]
    whole = shards[0]
    alone = whole.bound & np.r_[whole.bound[1:], True]
    hit = np.sort(whole.place[~alone])
    at_ = np.searchsorted(ends, hit, side="right")
    start = np.r_[0, ends[:-1]]
    return [x - start[k] for k, x in enumerate(np.split(hit, np.searchsorted(at_, np.arange(1, len(strings)))))]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            found = [anchors(w) for w in words_of(part.column(1).to_pylist())] if part.num_rows else []
            n = [len(p) for p, _ in found]
            who = np.repeat(part.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([p for p, _ in found])), pa.array(np.concatenate([h for _, h in found]).view(np.int64))], ["who", "pos", "key"])


def _windowed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids, who, marks = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
                rows: list[tuple] = []
                for i, w, words, mine in zip(ids, who, words_of(part.column(2).to_pylist()), marks, strict=True):
                    small = words.astype(np.uint32)
                    pos, key = np.array([m["pos"] for m in mine]), np.array([m["key"] for m in mine], dtype=np.int64)
                    into = mixed(key.view(np.uint64)) % np.uint64(buckets)
                    order = np.lexsort((pos, into))
                    pos, into = pos[order], into[order]
                    lo, hi = np.maximum(0, pos + GRAM - LENGTH), np.minimum(len(words), pos + LENGTH)
                    new = np.r_[True, (into[1:] != into[:-1]) | (lo[1:] > hi[:-1])]
                    first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(pos)] - 1
                    rows += [(int(into[f]), i, w, int(lo[f]), small[lo[f] : hi[g]].tobytes()) for f, g in zip(first, last, strict=True)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["bucket", "doc_id", "who", "start", "words"])

    return run


def _hot_windows(parts: dict[int, bytes], bits: int):
    """Documents (doc_id, who, text) -> (doc_id, who, start, h, g): the windows whose anchor's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(-(-bits // SIEVE_PART) * SIEVE_PART // 8, dtype=np.uint8)
        for k, packed in parts.items():
            on[(k - 1) * SIEVE_PART // 8 : k * SIEVE_PART // 8] = np.frombuffer(packed, dtype=np.uint8)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n, start, h, g = [], [], [], []
                for words in words_of(part.column(2).to_pylist()):
                    place, grams = least_grams(words)
                    slot = np.mod(grams.view(np.int64), bits)
                    hot = ((on[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                    s = np.flatnonzero(hot[place])
                    n.append(len(s)), start.append(s)
                    h.append(run_hashes(words, s, s + LENGTH)), g.append(run_hashes(mixed(words), s, s + LENGTH))
                rows = np.repeat(np.arange(part.num_rows), n)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(np.concatenate(start).astype(np.int64)),
                    pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(g).view(np.int64)),
                ], ["doc_id", "who", "start", "h", "g"])

    return run


def hot_spans(docs: DataFrame, hot: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """SPANS of the repeated windows over the anchors hot (key), from documents (doc_id, who, text)."""
    slot = F.pmod("key", F.lit(bits)) + 1
    packed = hot.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    parts = {r.part: bytes(r.bits) for r in packed.collect()}  # at most bits / 8 bytes
    windows = docs.select("doc_id", "who", "text").mapInArrow(_hot_windows(parts, bits), "doc_id long, who long, start long, h long, g long")
    windows = stored(windows.groupBy("doc_id", "who", "start").agg(F.min("h").alias("h"), F.min("g").alias("g")))  # repeated rows are one document
    often = stored(windows.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"))
    return windows.join(small(often), ["h", "g"]).select("doc_id", "who", "start", (F.col("start") + LENGTH).alias("end"))


def _passages(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["doc_id", "who", "start"])
    out = []
    strings = [np.frombuffer(w, dtype=np.uint32) for w in pdf["words"]]
    for i, w, s, hit in zip(pdf["doc_id"], pdf["who"], pdf["start"], repeated(strings), strict=True):
        if len(hit):
            cut = np.flatnonzero(np.diff(hit) > LENGTH)
            out += [(i, w, s + a, s + b + LENGTH) for a, b in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]], strict=True)]
    return pd.DataFrame(out, columns=["doc_id", "who", "start", "end"]).astype({"doc_id": "Int64"})


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word) of the longest runs of words all of which lie in a repeated passage of LENGTH words."""
    docs = docs.where(at("text").isNotNull()).select(at("doc_id").cast("long").alias("doc_id"), F.xxhash64(at("doc_id"), at("text")).alias("who"), at("text").alias("text"))
    marks = stored(docs.select("who", "text").mapInArrow(_anchored, "who long, pos long, key long"))
    often = stored(marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    mine = stored(marks.join(often.where(F.col("n") <= hot).select("key"), "key").groupBy("who").agg(F.collect_set(F.struct("pos", "key")).alias("marks")))
    count = mine.agg(F.sum(F.size("marks"))).first()[0] or 0
    buckets = max(1, -(-count * (2 * LENGTH - GRAM) // BUCKET_WORDS))
    windows = docs.join(mine, "who").select("doc_id", "who", "text", "marks").mapInArrow(_windowed(buckets), "bucket long, doc_id long, who long, start long, words binary")
    found = windows.groupBy("bucket").applyInPandas(_passages, SPANS)
    loud = often.where(F.col("n") > hot).select("key")
    if not loud.isEmpty():
        found = found.unionByName(hot_spans(docs, loud))
    by = Window.partitionBy("who", "doc_id").orderBy("start", "end")
    far = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("new", F.when(far >= F.col("start"), 0).otherwise(1)).withColumn("no", F.sum("new").over(by))
    return spans.groupBy("who", "doc_id", "no").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).select("doc_id", "start_word", "end_word")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


SQL = {
    "op9_repeated_passages": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH}),
        g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h FROM p),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
        s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new_ FROM r),
        t AS (SELECT *, sum(new_) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM s)
        SELECT doc_id, min(i) - 1 AS start_word, max(i) - 1 + {LENGTH} AS end_word FROM t GROUP BY doc_id, no"""
}
QUERIES = {"op9_repeated_passages": op9_repeated_passages}
