"""The pipeline's stages: decisions take effect, columns and clean documents stay; and each stage, and run(), against plain Python."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_mixing_packing import naive_pack

from tidewell.llm import common, mixing, packing, simhash, toxicity


def test_stages_over_odd_documents(spark, odd_documents, data_dir, tmp_path):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data_dir)
        if name != "best-fit packing":
            assert out.columns == odd_documents.columns
        assert stage(spark, odd_documents.limit(0), data_dir).count() == 0
        out.write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
    assert docs.count() > 0


def copies_of(i, rate):
    draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    return int(rate) + (draw < rate - int(rate))


def test_stages_against_plain_python(spark, duck, data_dir):
    rows = {i: (t, s) for i, t, s in duck.sql("SELECT doc_id, text, source FROM documents").fetchall()}
    model = toxicity.train(common.read(spark, data_dir, "documents"), common.read(spark, data_dir, "labels"))
    docs, out = common.read(spark, data_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, data_dir))
        out[name] = docs
    ids = lambda name: Counter(r.doc_id for r in out[name].collect())
    clean = {i for i, (t, _) in rows.items() if model.document(t) < model.threshold}
    assert ids("toxicity") == Counter(clean)

    first = {}
    for i in sorted(clean):
        first.setdefault(rows[i][0], i)
    unique = sorted(first.values())
    assert ids("exact dedup") == Counter(unique)

    h = np.frombuffer(b"".join(simhash.simhashes([rows[i][0] for i in unique], simhash.Powers())), dtype=np.uint64).reshape(-1, 6)
    links = [(k, j) for k in range(len(h)) for j in (np.flatnonzero(simhash.near(h[k + 1 :], h[k])) + k + 1).tolist()]
    i, j = (np.array([*range(len(h)), *x]) for x in zip(*links, strict=True))
    least = simhash.stars(len(h), i, j)
    apart = {unique[k] for k in np.flatnonzero(least == np.arange(len(h)))}
    kept = ids("simhash near-dedup")
    assert apart <= set(kept) and len(kept) <= 1.02 * len(apart) and max(kept.values()) == 1  # none is lost; an approximate search may miss a few

    tokens = {i: len(rows[i][0].split()) for i in kept}
    had = Counter()
    for i in kept:
        had[rows[i][1]] += tokens[i]
    weight = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in had}
    rate = {s: weight[s] * sum(had.values()) / (sum(weight.values()) * had[s]) for s in had}
    mixed = Counter({i: n for i in kept if (n := copies_of(i, rate[rows[i][1]]))})
    assert ids("mixing") == mixed

    load, held = Counter(), defaultdict(Counter)
    got = [tuple(r) for r in corpus_pipeline.run(spark, data_dir).collect()]
    assert sorted(got) == sorted(tuple(r) for r in out["best-fit packing"].collect())
    for b, _, i, start, n in got:
        load[b] += n
        held[i][start, n] += 1
    size = packing.CAPACITY
    want = {i: Counter({(k, min(size, tokens[i] - k)): n for k in range(0, tokens[i], size)}) for i, n in mixed.items() if tokens[i]}
    assert held == want
    items = [n for i in want for (_, n), c in want[i].items() for _ in range(c)]
    assert sorted(size - x for x in load.values()) == naive_pack(items, size)
