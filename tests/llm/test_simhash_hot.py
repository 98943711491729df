"""Near-dedup of large groups of near copies, and of buckets that are too large for one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import simhash


def flipped(n, share, centers, seed):
    """n points around so many centers, each bit flipped with the chance `share`."""
    rng = np.random.default_rng(seed)
    bits = np.repeat(rng.integers(0, 2, (centers, 384), dtype=np.uint8), n // centers, axis=0)
    return np.packbits(bits ^ (rng.random(bits.shape) < share), axis=1).view(np.uint64)


def brute(h):
    """Groups by all pairs."""
    found = [(np.full(len(hit), k), hit) for k in range(len(h)) if len(hit := np.flatnonzero(simhash.near(h[k + 1 :], h[k])) + k + 1)]
    i, j = (np.concatenate([np.arange(len(h)), *x]) for x in zip(*found, strict=True))
    return simhash.stars(len(h), i, j)


@pytest.mark.parametrize(("n", "share", "centers"), [(5_000, 0.03, 1), (5_000, 0.08, 1), (5_000, 0.1, 1), (4_000, 0.05, 400)])
def test_large_group(n, share, centers):
    h = flipped(n, share, centers, 1)
    assert (simhash.linked_stars(h, np.zeros(n, dtype=np.int64)) == brute(h)).mean() > 0.999


def test_main_group_and_others():
    h = np.concatenate([flipped(3_000, 0.03, 1, 2), flipped(600, 0.03, 200, 3)])
    main = np.arange(len(h)) < 3_000
    assert (simhash.linked_stars(h, np.zeros(len(h), dtype=np.int64), main=main) == brute(h)).mean() > 0.999
    key = np.repeat([1, 2], [1_000, len(h) - 1_000])
    got = simhash.linked_stars(h, key, main=main)
    assert (got[:1_000] == 0).all() and (got[1_000:3_000] == 1_000).all()


def test_same_words_in_other_orders():
    """Points that agree in all bits of their words and differ in those of their pairs end, and groups among them are found."""
    h = flipped(4_000, 0.05, 40, 4)
    h[:, :4] = h[0, :4]
    assert (simhash.linked_stars(h, np.zeros(len(h), dtype=np.int64)) == brute(h)).mean() > 0.97


@pytest.mark.parametrize("hot", [150, 900])
def test_hot_buckets(spark, hot):
    """Buckets above `hot` are dealt out: one with a third of all points, and dense ones of unlike points."""
    h = np.concatenate([flipped(1_000, 0.03, 1, 5), flipped(2_000, 0.04, 500, 6)])
    rows = spark.createDataFrame([(7, i, bytearray(x.tobytes())) for i, x in enumerate(h)], "key long, id long, h binary")
    links = np.array([tuple(r) for r in simhash.hot_links(rows, hot).collect()])
    got, want = simhash.stars(len(h), links[:, 0], links[:, 1]), brute(h)
    assert (got == want).mean() > 0.97 and len(set(zip(got.tolist(), want.tolist()))) == len(set(got.tolist()))  # none that brute force lacks
    assert len(np.unique(got[:1_000])) == 1


def test_hot_documents(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
    texts = []
    for k in range(400):
        own = list(words) if k % 2 else [f"v{x}" for x in rng.integers(0, 10**6, 80)]
        own[int(rng.integers(len(own)))] = f"u{k}"
        texts.append((k, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(k, 1) for k in range(3, 400, 2)}
    assert {tuple(r) for r in simhash.near_copies(df).collect()} == want
    assert {tuple(r) for r in simhash.near_copies(df, trees=4, depth=1, hot=50).collect()} == want


def test_depth_follows_the_points():
    for n in (1, 10**5, 10**8, 10**10):
        depth, trees = simhash.forest(n)
        met = simhash.LOCAL_TARGET * (1 - simhash.DESIGN) ** depth
        assert 1 - (1 - met) ** trees >= simhash.TARGET and n * (1 - simhash.UNLIKE) ** depth <= simhash.BUCKET
    assert simhash.forest(10**5) == (simhash.climb_depth(), simhash.TREES)


def test_packed_prefixes():
    h = flipped(50, 0.5, 1, 8)
    order = simhash.bit_orders(1, 20, 3)[0]
    bits = np.unpackbits(h.copy().view(np.uint8), axis=1)
    assert (simhash.packed_prefixes(h, order) == simhash.prefixes(bits, order)).all()
