from collections import Counter

import numpy as np
import pytest

from tidewell.llm import suffixes


def brute_force(strings, length):
    seen = Counter(tuple(s[i : i + length].tolist()) for s in strings for i in range(len(s) - length + 1))
    return [[i for i in range(len(s) - length + 1) if seen[tuple(s[i : i + length].tolist())] > 1] for s in strings]


@pytest.mark.parametrize(("length", "step"), [(50, 10), (6, 2), (4, 4), (5, 1)])
def test_repeated(length, step):
    rng = np.random.default_rng(length)
    for t in range(60):
        shared = [rng.integers(0, 2**32, rng.integers(length, 3 * length)) for _ in range(3)]
        strings = []
        for _ in range(rng.integers(1, 9)):
            s = list(rng.integers(0, 3 if t % 3 == 0 else 2**32, rng.integers(0, 2 * length)))
            if rng.random() < 0.7:
                s += [*shared[rng.integers(3)][rng.integers(0, 4) :], *rng.integers(0, 2**32, 3)]
            strings.append(np.array(s, dtype=np.uint32))
        got = suffixes.repeated(strings, length, step, shard_words=int(rng.integers(20, 300)))
        assert [x.tolist() for x in got] == brute_force(strings, length)
    assert suffixes.repeated([]) == []


def test_merge_is_the_sort_of_both():
    rng = np.random.default_rng(9)
    strings = [rng.integers(0, 3, 40).astype(np.uint32) for _ in range(6)]
    code, before = suffixes.symbols(strings, 2)
    half = sum(len(s) + 2 for s in strings[:3])
    parts = [suffixes.build(code, before, np.arange(a, b), 3) for a, b in ((0, half), (half, len(code)))]
    whole, merged = suffixes.build(code, before, np.arange(len(code)), 3), suffixes.merge(*parts, 3)
    assert (whole.bound == merged.bound).all()
    cut = np.flatnonzero(whole.bound)[1:]
    assert all(set(x) == set(y) for x, y in zip(np.split(whole.place, cut), np.split(merged.place, cut), strict=True))


def test_shared_windows_share_an_anchor():
    rng = np.random.default_rng(3)
    for _ in range(50):
        p = rng.integers(0, 2**63, 50).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64), p, rng.integers(0, 2**63, 20).astype(np.uint64)]) for _ in range(2))
        assert set(suffixes.anchors(a)[1]) & set(suffixes.anchors(b)[1])


def test_passages(spark, odd_documents, no_documents):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    p, q = words(60), words(49)
    texts = [words(30) + p + words(40), p + words(90), words(100) + p, words(20) + q + words(20), q + words(70), words(300), words(10) + p + p[:49]]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for hot in (suffixes.HOT, 3, 1):  # no hot anchor, some, and all that repeat
        got = {tuple(r) for r in suffixes.repeated_passages(df, hot).collect()}
        assert got == {(0, 30, 90), (1, 0, 60), (2, 100, 160), (6, 10, 70)}
    odd = [tuple(r) for r in suffixes.repeated_passages(odd_documents).collect()]
    assert odd == [(6, 0, 60_000)]
    assert suffixes.repeated_passages(no_documents).count() == 0


def test_hot_passage_in_many_documents(spark):
    """A passage in a third of 3,000 documents, hot or not, against all windows; rows repeated whole and null doc_ids among them."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    shared, pair = words(70), words(55)
    rows = [(k, words(12) + (shared if k % 3 == 0 else pair if k in (1, 2) else words(60)) + words(9)) for k in range(3_000)]
    rows += [rows[4], rows[4], (None, rows[0][1])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(5)
    want = {(k, 12, 82) for k in range(3, 3_000, 3)} | {(1, 12, 67), (2, 12, 67), (None, 0, 91), (0, 0, 91)}
    for hot in (500, suffixes.HOT):
        got = [tuple(r) for r in suffixes.repeated_passages(df, hot).collect()]
        assert set(got) == want and len(got) == len(want)


def test_sieve_of_few_bits(spark):
    """Bits that other anchors share only make more windows go the hot way."""
    rng = np.random.default_rng(6)
    p = [f"w{x}" for x in rng.integers(0, 10**9, 60)]
    rows = [(k, k, " ".join([f"a{k}"] * 60 + p)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, who long, text string")
    grams = suffixes.anchors(suffixes.words_of([" ".join(p)])[0])[1].view(np.int64).tolist()
    hot = spark.createDataFrame([(g,) for g in grams], "key long")
    some, all_ = ({tuple(r) for r in suffixes.hot_spans(docs, hot, bits).collect()} for bits in (1 << 27, 1))
    assert {(k, k, 60 + j, 110 + j) for k in range(20) for j in range(11)} <= some <= all_
