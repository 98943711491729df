"""The proximity score against a loop over positions."""

import random

from pyspark.sql import functions as F

from tidewell.plans import rank


def loop_score(places, rare):
    total = 0.0
    k = len(places)
    if k < 2:
        return 0.0
    for r in places[rare]:
        near = []
        for p in places:
            near.append(min(p, key=lambda y: (abs(y - r), y)) if p else None)
        gain, met = 0.0, [i for i in range(k) if i != rare and near[i] is not None]
        fits = lambda i: (i < rare and near[i] <= r) or (i > rare and near[i] >= r)
        for n, i in enumerate(met):
            gain += (1.0 if fits(i) else 0.5) / max(1, abs(near[i] - r))
            for j in met[n + 1 :]:
                three = (near[i], near[j], r)
                good = (j < rare and near[j] <= r and near[i] <= near[j]) or (j > rare and near[j] >= r and fits(i))
                gain += (1.0 if good else 0.5) / max(1, max(three) - min(three))
        if len(met) == k - 1:
            ends = [near[i] for i in met] + [r]
            if max(ends) > min(ends):
                gain += 1.0 / (max(ends) - min(ends))
        total += gain / (1.05**r if r < 14_000 else float("inf"))
    return total


def test_text_score(spark):
    rng = random.Random(5)
    for k in (1, 2, 3, 5):
        rows = []
        for _ in range(60):
            places = [sorted(rng.sample(range(40), rng.randint(0, 6))) for _ in range(k)]
            if k > 2 and rng.random() < 0.3:
                places[1] = places[0]
            rows.append((places, rng.randrange(k)))
        df = spark.createDataFrame(rows, "p array<array<bigint>>, rare int")
        got = df.select(rank.text_score([F.col("p")[i] for i in range(k)], F.col("rare")).alias("s"), "p", "rare").collect()
        for r in got:
            assert abs(r.s - loop_score(r.p, r.rare)) < 1e-9


def test_far_positions_add_nothing(spark):
    df = spark.createDataFrame([([20_000], [20_001])], "a array<bigint>, b array<bigint>")
    assert df.select(rank.text_score([F.col("a"), F.col("b")], F.lit(0))).first()[0] == 0.0


def test_rarest(spark):
    df = spark.createDataFrame([(5, 2, 2), (0, 9, 4), (0, 0, 0)], "a long, b long, c long")
    assert [r[0] for r in df.select(rank.rarest([F.col(c) for c in "abc"])).collect()] == [1, 2, 0]
