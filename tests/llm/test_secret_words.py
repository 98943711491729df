"""Plain words of the documents are no secrets, in any language; random values stay secrets."""

import hashlib
import re
from collections import Counter
from math import log10

import pytest
from test_secret_segments import least, one

from tidewell.llm import secrets


def test_words_of_documents(spark):
    prose = ["something about an ingredient of authentication", "noch eine Zugangsberechtigung, Ingredient something", "Die ZUGANGSBERECHTIGUNG: something und authentication"]
    texts = [*prose, "secret: something", "token: authentication", "password: Zugangsberechtigung", "secret: 'ingredient'", "token = kqzvwpxjtmfh", "x token = kqzvwpxjtmfh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ranks = {r.word: r["rank"] for r in secrets.word_ranks(df).collect()}
    # by documents: something and token are in 3, then authentication, ingredient, zugangsberechtigung and secret in 2 each
    assert ranks == {"something": 1, "token": 1, "authentication": 3, "ingredient": 3, "zugangsberechtigung": 3, "secret": 3}
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert {i: r.secret for i, r in got.items()} == {3: False, 4: False, 5: False, 6: False, 7: True, 8: True}
    assert got[3].log10_guesses == 0 and abs(got[5].log10_guesses - log10(3) - log10(2)) < 1e-5


def test_guesses_with_ranks():
    assert secrets.guesses("something") > 12 and secrets.guesses("something9", {"something": 10}) == 1 + 1 + 1
    assert secrets.guesses("password", {"password": 50}) == 0
    assert secrets.parts("s0me-Xy") == {"me", "xy", "so", "som", "some", "om", "ome"}


def test_query_against_plain_python(spark, tmp_path):
    """op10_secret_scan over a table, by loops: nulls, repeated rows, a null doc_id, ties of words, long values; segments listed on their own."""
    prose = ["alpha beta gamma", "alpha beta delta", "ALPHA gamma eps", None, "", "beta"] * 2
    hits = ["password: alphabeta", "my api_key = 'kq9Z!vX2#pLw' and token=gammagamma", "secret: 20240101;", "pwd=" + "xkcd" * 40, "password is nothing", "token: betaqwerty7", "secret => ZQ" * 3]
    rows = [(i, t) for i, t in enumerate(prose + hits)] + [(12, hits[0]), (12, hits[0]), (None, hits[1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter(w for _, t in rows for w in set(re.findall(r"[^\W\d_]+", re.sub(secrets.CONTEXT, r"\1 ", t or "", flags=re.A).lower())) if 2 <= len(w) <= secrets.LONG)
    kept = {w: n for w, n in counts.items() if n >= secrets.MIN_DOCS}
    ranks = {w: 1 + sum(m > n for m in kept.values()) for w, n in kept.items()}
    all_ranks = {**secrets.RANK, **{w: min(r, secrets.RANK.get(w, r)) for w, r in ranks.items()}}
    want = []
    for i, t in rows:
        for m in re.finditer(secrets.CONTEXT, t or "", flags=re.A):
            v = next(x for x in m.groups()[1:] if x is not None)
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(secrets, "RANK", all_ranks)
                least.cache_clear(), one.cache_clear()
                g = least(v)
            want.append((i, m.group(1).lower(), hashlib.sha256(v.encode()).hexdigest()[:16], len(v), round(g, 6), g >= secrets.MIN_LOG10))
    least.cache_clear(), one.cache_clear()
    got = [tuple(r) for r in secrets.op10_secret_scan(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and {r[-1] for r in want} == {True, False}
