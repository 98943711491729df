import random
import re
from collections import defaultdict
from math import log10

import numpy as np

from tidewell.llm import secrets, toxicity


def test_noisy_or():
    z = np.array([-2.0, 0.5, 3.0])
    p = 1 / (1 + np.exp(-z))
    assert abs(toxicity.noisy_or(z) - (1 - np.prod(1 - p))) < 1e-12 and toxicity.noisy_or([]) == 0.0


def test_slope_against_finite_differences():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 12, 40))
    entries = 150
    bags = toxicity.Bags(rng.integers(0, 9, entries), np.sort(rng.integers(0, 40, entries)), rng.integers(1, 3, entries), doc, 9, 12)
    y, weight, w = (rng.random(12) < 0.4).astype(float), rng.random(12), rng.normal(size=10)
    got = bags.slope(w, y, weight, 0.05, 0.01)
    for k in range(10):
        step = np.zeros(10)
        step[k] = 1e-6
        by_difference = (bags.loss(w + step, y, weight, 0.05, 0.01) - bags.loss(w - step, y, weight, 0.05, 0.01)) / 2e-6
        assert abs(by_difference - got[k]) < 1e-6
    clean = np.ones(12)  # noisy-or by the product itself
    z = bags.soft(w)[0]
    for s, d in enumerate(doc):
        clean[d] *= 1 - 1 / (1 + np.exp(-z[s]))
    assert np.allclose(np.exp(-bags.soft(w)[1]), clean)


def test_query_against_plain_python(spark, duck, data_dir):
    """op1_toxicity's rows from its model's weights, by loops over sentences, tokens and beginnings."""
    model = toxicity.train(*(spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels")))
    want = {}
    for i, text in duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        found, at = [], 0
        for m in re.finditer(r"[^.!?\n]+[.!?]*", text):
            if tokens := set(m.group().split()):
                gains = [model.weights[f] for t in tokens for x in re.findall(r"[^\W\d_]+", t.lower()) for f in [x, *(x[:k] + "*" for k in (4, 5, 6, 7) if len(x) > k)] if f in model.weights]
                found.append((at, m.start(), m.end(), 1 / (1 + np.exp(-model.bias - sum(gains))) if gains and any(gains) else 0.0))
                at += 1
        p = 1 - np.prod([1 - x[3] for x in found]) if found else 0
        if found and p >= model.threshold:
            top = max(x[3] for x in found)
            want |= {(i, s): (a, b, round(q, 6), round(p, 6)) for s, a, b, q in found if q >= model.threshold / 2 or q == top}
    got = {(r.doc_id, r.sentence): (r.start, r.end, round(r.score, 6), round(r.toxicity, 6)) for r in toxicity.op1_toxicity(spark, data_dir).collect()}
    assert got.keys() == want.keys() and len(want) > 0
    for k, (a, b, q, p) in want.items():
        assert got[k][:2] == (a, b) and abs(got[k][2] - q) < 2e-6 and abs(got[k][3] - p) < 2e-6


def test_sample_is_bounded_in_characters(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(50, "y" * 400_000), (50, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(51)], "doc_id long, toxic int")
    rows = toxicity.sample(df, labels, max_chars=1_000)
    assert rows.groupby("toxic")["id"].count().to_dict() == {0: 10, 1: 10} and 50 not in set(rows["id"])
    assert len(toxicity.sample(df, labels)) == 50


def labelled(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    bad = ["zorgle", "quibbnax", "frumpet"]
    rows = []
    for i in range(n):
        sentences = [rng.choices(vocabulary, k=8) for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.3
        where = rng.randrange(len(sentences)) if toxic else None
        if toxic:
            sentences[where][3] = rng.choice(bad)
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic), where))
    return rows


def test_finds_documents_and_sentences(spark):
    train, held = labelled(600, 1), labelled(200, 1)[:200]
    held = [(i + 1000, t, y, w) for i, t, y, w in labelled(900, 1)[600:]]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in train + held], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in train] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = defaultdict(set)
    for r in toxicity.offending_sentences(df, model).collect():
        got[r.doc_id].add(r.sentence)
    true = {i: w for i, _, y, w in held if y}
    clean = [i for i, _, y, _ in held if not y]
    assert sum(i in got for i in true) >= 0.9 * len(true) and sum(i in got for i in clean) <= 0.05 * len(clean)
    assert sum(w in got[i] for i, w in true.items()) >= 0.9 * len(true)
    kept = {r.doc_id for r in toxicity.drop_toxic(df, model).collect()}
    assert kept == {i for i, *_ in train + held} - set(got)


def test_odd_documents(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd_documents, none) is None
    assert toxicity.offending_sentences(odd_documents, None).count() == 0
    model = toxicity.Model({"same": 9.0}, -4.0, 0.5)
    assert {(r.doc_id, r.sentence) for r in toxicity.offending_sentences(odd_documents, model).collect()} == {(1, 0), (2, 0), (None, 0)}
    out = toxicity.drop_toxic(odd_documents, model)
    assert out.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 3, 4, 5, 6, 7]
    assert toxicity.drop_toxic(no_documents, model).count() == 0 and toxicity.offending_sentences(no_documents, model).count() == 0
    assert toxicity.train(no_documents, none) is None


def brute_force(v):
    best = defaultdict(lambda: 1e9)
    for i, j, g in secrets.spans(v):
        best[i, j] = min(best[i, j], g)

    def cost(i, j):
        classes = 0
        for c in v[i:j]:
            classes |= 1 << secrets.kind(c)
        return min(best[i, j], (j - i) * log10(secrets.SIZE[classes]))

    n = len(v)
    options = []
    for m in range(1 << (n - 1)):
        cuts = [0, *(k + 1 for k in range(n - 1) if m >> k & 1), n]
        options.append(sum(cost(a, b) for a, b in zip(cuts, cuts[1:], strict=False)) + (len(cuts) - 2) * secrets.SPLIT)
    return min(options)


def test_guess_cost():
    rng = random.Random(4)
    values = ["password1", "P4ssw0rd!", "aaaaaaaa", "qwerty12", "abc19990", "2020-1-1x", "zxcvbnm", "04dbebab9", "x", "Ab1!x9Zq", "abab12ab12"]
    values += ["".join(rng.choices("abq1234.Az", k=rng.randint(1, 10))) for _ in range(40)]
    for v in values:
        assert abs(brute_force(v) - secrets.guesses(v)) < 1e-9
    assert secrets.guesses("password") < 1 < secrets.guesses("k7#Qz") < secrets.guesses("04dbebab91ab85687d33eeaaf9ac699e1188f962")
    assert secrets.guesses("a" * 5000) < 10


def test_scan(spark, odd_documents, no_documents):
    texts = ['x token = "04dbebab91ab85687d33eeaaf9ac699e" y', "password: changeme, API_KEY='Zk8#mQ2!vR5x' z", "no secret here", "secret => \"\" pwd=hunter", "token = \n x"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.name, r.length, r.secret) for r in got} == {(0, "token", 32, True), (1, "password", 8, False), (1, "api_key", 12, True), (3, "pwd", 6, False)}
    assert secrets.scan(odd_documents).count() == 0 and secrets.scan(no_documents).count() == 0
