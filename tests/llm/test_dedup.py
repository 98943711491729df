import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import exact, lines, simhash


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_copies(odd_documents, no_documents):
    assert found(exact.exact_copies(odd_documents)) == [(2, 1), (5, 4)]
    assert found(exact.exact_copies(odd_documents, salts=1)) == [(2, 1), (5, 4)]
    assert exact.exact_copies(no_documents).count() == 0


def test_exact_dedup(odd_documents, no_documents):
    out = exact.exact_dedup(odd_documents)
    assert out.columns == odd_documents.columns and out.dtypes == odd_documents.dtypes
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (False, 6), (False, 7), (True, 0)]
    assert exact.exact_dedup(no_documents).count() == 0


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcdefgh") * rng.randint(1, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    least = {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    assert found(exact.exact_dedup(df)) == sorted(((i, t) for t, i in least.items()), key=repr)
    assert found(exact.exact_copies(df)) == sorted(((i, least[t]) for i, t in rows if least[t] != i), key=repr)


def test_exact_with_clashing_digests(spark):
    """Digests that many texts share: content decides; and a sieve of few bits passes more, with the same result."""
    rng = random.Random(4)
    rows = [(i if i % 40 else None, "".join(rng.choices("ab", k=rng.randint(0, 4))) if i % 60 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    least = {}
    for i, t in rows:
        if i is not None and t is not None:
            least[t] = min(i, least.get(t, i))
    want = sorted(((i, least[t]) for i, t in rows if i is not None and t is not None and least[t] != i), key=repr)
    for of, bits in ((F.length, 1 << 27), (F.xxhash64, 8), (lambda t: F.lit(7), 64)):
        assert found(exact.exact_copies(df, digest_of=of, bits=bits)) == want
        kept = found(exact.exact_dedup(df, digest_of=of, bits=bits))
        assert kept == sorted([(i, t) for t, i in least.items()] + [(i, t) for i, t in rows if t is None], key=repr)


def test_hot_text(spark):
    """One text with very many copies: no list of their ids, one row each."""
    df = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    got = exact.exact_copies(df).agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.count_distinct("doc_id")).first()
    assert tuple(got) == (666_665, 1, 1, 666_665)
    assert exact.exact_dedup(df).count() == 333_335


def test_lines(spark, odd_documents, no_documents):
    rows = [(i, f"Own {i}\nShared  LINE\n\nshared line \nend{i % 2}") for i in range(5)] + [(9, "shared line"), (9, "shared line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in lines.dedup_lines(df, 3, "n").collect()}
    assert got[0] == ("Own 0\n\nend0", 2) and got[9] == ("", 1)
    assert {r.doc_id: r.text for r in lines.dedup_lines(df, 6).collect()} == dict(rows)  # six documents have the line, not more
    out = lines.dedup_lines(odd_documents, 1)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, "") in texts and (3, None) in texts and (4, "") in texts and (7, "other words\nof a kind") in texts
    assert lines.dedup_lines(no_documents).count() == 0


def corpus(n, seed=1):
    """Texts of random words, some with near copies; and which are copies of which."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    texts, group = [], []
    for g in range(n):
        words = rng.choices(vocabulary, k=rng.randint(40, 200))
        texts.append(" ".join(words))
        group.append(g)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(max(1, len(words) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            group.append(g)
    return texts, group


def hashed(texts):
    return np.frombuffer(b"".join(simhash.simhashes(texts, simhash.Powers())), dtype=np.uint64).reshape(-1, 6)


def test_forest_recall():
    texts, _ = corpus(400)
    h = hashed(texts)
    brute = {(i, j) for i in range(len(h)) for j in (np.flatnonzero(simhash.near(h[i + 1 :], h[i])) + i + 1).tolist()}
    assert len(brute) > 300
    bits = np.unpackbits(h[:, :4].copy().view(np.uint8), axis=1)
    met = set()
    for order in simhash.bit_orders(simhash.TREES, simhash.climb_depth()):
        key = simhash.prefixes(bits, order)
        by = np.argsort(key, kind="stable")
        i, j = simhash.linked(h[by], key[by])
        met |= {tuple(sorted(p)) for p in zip(by[i].tolist(), by[j].tolist(), strict=True)}
    assert met <= brute and len(met) >= 0.9 * len(brute)
    i, j = simhash.linked(h, np.zeros(len(h), dtype=np.int64), dense=64)  # one dense bucket with a forest of its own
    dense = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert dense <= brute and len(dense) >= 0.9 * len(brute)


def test_near_copies(spark, odd_documents, no_documents):
    texts, group = corpus(150, seed=2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, simhash.near_copies(df).collect()))
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    true = {i: first[g] for i, g in enumerate(group) if first[g] != i}
    assert sum(got.get(i) == k for i, k in true.items()) >= 0.95 * len(true)
    assert all(group[i] == group[k] for i, k in got.items())
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert kept == set(range(len(texts))) - set(got)
    assert found(simhash.near_copies(odd_documents)) == [(2, 1)]
    out = simhash.drop_near_copies(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count() - 2
    assert simhash.near_copies(no_documents).count() == 0 and simhash.drop_near_copies(no_documents).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [tuple(sorted(rng.sample(range(200, 260), 2), reverse=True)) for _ in range(50)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: top(x) for x in root if top(x) != x}
