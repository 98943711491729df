import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewell.llm import lines, mixing, packing, urls


def test_mix(spark, odd_documents, no_documents):
    rows = [(i, "abc"[i % 3] if i % 4 else "hot", "w " * (1 + i % 5)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(df, {"hot": 5, "a": 2}, 1, copy_col="n").collect()
    tokens, had = Counter(), Counter()
    size = {i: 1 + i % 5 for i, _, _ in rows}
    copies = Counter(r.doc_id for r in out)
    for r in out:
        tokens[r.source] += size[r.doc_id]
    for i, s, _ in rows:
        had[s] += size[i]
    total = sum(had.values())
    goal = {"hot": 5 / 9, "a": 2 / 9, "b": 1 / 9, "c": 1 / 9}
    for s, share in goal.items():
        rate = share * total / had[s]
        assert abs(tokens[s] / total - share) < 0.03
        assert {copies[i] for i, t, _ in rows if t == s} <= {int(rate), int(rate) + 1}
    assert [tuple(r) for r in sorted(out)] == [tuple(r) for r in sorted(mixing.mix(df.repartition(5), {"hot": 5, "a": 2}, 1, copy_col="n").collect())]
    odd = mixing.mix(odd_documents, {"a": 1}, 1)
    assert odd.columns == odd_documents.columns and odd.where("source = 'a'").count() > 0
    assert odd.where("text IS NULL").count() == 2  # the source of null texts has no token: rate 1
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mix(df, {}, 1).count() > 0


def test_clashing_output_names(spark):
    df = spark.createDataFrame([(1, "a", "x y", 9, 9, 9, 9, 9)], "doc_id long, source string, text string, COPY int, dropped int, canonical int, Rules int, blocked int")
    mixed = mixing.mix(df, copy_col="copy")
    assert [c.lower() for c in mixed.columns].count("copy") == 1 and mixed.first()["copy"] == 1
    cleaned = lines.dedup_lines(df, dropped_col="dropped")
    assert cleaned.columns.count("dropped") == 1 and cleaned.first()["dropped"] == 0
    urled = urls.filter_urls(df, url_col="text")
    assert len({c.lower() for c in urled.columns}) == len(urled.columns) and urled.first()["canonical"] == "x y"


def naive_pack(sizes, capacity):
    """The same rules by plain search."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    large, out, gaps = [i for i in order if 3 * sizes[i] > capacity], {}, []
    while large:
        i = large.pop(0)
        gap, out[i] = capacity - sizes[i], len(gaps)
        fit = [k for k in large if sizes[k] <= gap]
        if fit:
            k = min(fit, key=lambda k: (-sizes[k], k))
            large.remove(k)
            out[k] = len(gaps)
            gap -= sizes[k]
        gaps.append(gap)
    for i in (i for i in order if 3 * sizes[i] <= capacity):
        fit = [b for b, g in enumerate(gaps) if g >= sizes[i]]
        if fit:
            b = min(fit, key=lambda b: gaps[b])
        else:
            b = len(gaps)
            gaps.append(capacity)
        gaps[b] -= sizes[i]
        out[i] = b
    return sorted(gaps)


def test_pack_against_naive():
    rng = random.Random(6)
    for capacity in (1, 2, 3, 10, 97):
        for _ in range(40):
            sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
            bins = packing.pack(sizes, capacity)
            load, large = defaultdict(int), Counter()
            for s, b in zip(sizes, bins, strict=True):
                load[b] += s
                large[b] += 3 * s > capacity
            assert max(load.values(), default=0) <= capacity and max(large.values(), default=0) <= 2
            assert sorted(load) == list(range(len(load)))
            assert sorted(capacity - x for x in load.values()) == naive_pack(sizes, capacity)


def test_best_fit_pack(spark, odd_documents, no_documents):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 40, 64, 130, 300]))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.best_fit_pack(df, capacity=64, shard_items=200).collect()
    held, load, slots = defaultdict(list), Counter(), defaultdict(list)
    for r in got:
        held[r.doc_id].append((r.start, r.tokens))
        load[r.bin_id] += r.tokens
        slots[r.bin_id].append(r.slot)
    assert max(load.values()) <= 64 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    for i, t in rows:
        at = 0
        for start, n in sorted(held[i]):
            assert start == at
            at += n
        assert at == len(t.split())
    assert sum(load.values()) / (64 * len(load)) > 0.9
    odd = packing.best_fit_pack(odd_documents, capacity=100)
    assert odd.agg(F.sum("tokens")).first()[0] == 4 * 3 + 60_000 + 5
    assert packing.best_fit_pack(no_documents).count() == 0


def test_packing_is_one_over_all_shards(spark):
    """The bins are those of plain search over all items, however many shards number them, with null and repeated doc_ids."""
    rng = random.Random(9)
    rows = [(None if i % 50 == 0 else i // 2, " ".join(["w"] * rng.randint(0, 150))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = [x for _, t in rows for n in [len(t.split())] for x in [64] * (n // 64) + ([n % 64] if n % 64 else [])]
    for shard_items in (10, 100_000):
        load = Counter()
        for r in packing.best_fit_pack(df, capacity=64, shard_items=shard_items).collect():
            load[r.bin_id] += r.tokens
        assert sorted(load) == list(range(len(load)))
        assert sorted(64 - x for x in load.values()) == naive_pack(items, 64)


def test_plan_does_not_grow_with_items():
    rng = random.Random(10)
    counts = {s: rng.randint(0, 10**9) for s in range(1, 2049)}
    assert len(packing.plan(counts, 2048)) < 20_000
