"""Recall of the near-dedup's candidate search by distance, up to the farthest pair that the verifier accepts."""

import numpy as np
import pytest

from tidewell.llm import simhash

BANDS, EACH = (24, 32, 36, 40, 44, 48), 400


def planted(n, seed):
    """n random points, and EACH pairs of them at each distance of BANDS; pair k's rows are n + 2k and n + 2k + 1."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n + 2 * EACH * len(BANDS), 384), dtype=np.uint8)
    for k in range(EACH * len(BANDS)):
        a, b = n + 2 * k, n + 2 * k + 1
        bits[b] = bits[a]
        bits[b, rng.permutation(256)[: BANDS[k // EACH]]] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


def recall(h, n, trees, depth, dense):
    bits = np.unpackbits(h[:, :4].copy().view(np.uint8), axis=1)
    met = np.zeros(EACH * len(BANDS), dtype=bool)
    for order in simhash.bit_orders(trees, depth) if depth else [None]:
        key = simhash.prefixes(bits, order) if depth else np.zeros(len(h), dtype=np.int64)
        by = np.argsort(key, kind="stable")
        i, j = simhash.linked(h[by], key[by], dense)
        i, j = np.minimum(by[i], by[j]), np.maximum(by[i], by[j])
        good = (i >= n) & ((i - n) % 2 == 0) & (j == i + 1)
        met[(i[good] - n) // 2] = True
    return met.reshape(len(BANDS), EACH).mean(axis=1)


@pytest.mark.parametrize(("n", "dense"), [(5_000, 512), (60_000, 512), (20_000, 64)])  # sparse; some dense; all dense
def test_recall_by_distance(n, dense):
    got = recall(planted(n, 1), n, simhash.TREES, simhash.climb_depth(), dense)
    assert (got >= 0.93).all(), dict(zip(BANDS, got, strict=True))  # 0.95, less three times the spread of 400 draws


@pytest.mark.parametrize("n", [10_000, 100_000])
def test_local_recall(n):
    got = recall(planted(n, 2), n, 1, 0, simhash.DENSE)
    assert (got >= simhash.LOCAL_TARGET - 0.07).all(), dict(zip(BANDS, got, strict=True))


def test_stars_of_parts(monkeypatch):
    h = planted(2_000, 3)
    key = np.zeros(len(h), dtype=np.int64)
    whole = simhash.linked_stars(h, key)
    monkeypatch.setattr(simhash, "PENDING", 1)
    assert (simhash.linked_stars(h, key) == whole).all() and (whole != np.arange(len(h))).any()
