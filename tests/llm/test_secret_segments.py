"""The segmentation of secrets against one that lists its segments without the operator's help."""

import random
from functools import lru_cache
from math import log10

import pytest

from tidewell.llm import secrets


@lru_cache(None)
def least(v):
    """log10 of the fewest guesses of v, by trying each last segment."""
    best = [-secrets.SPLIT]
    for j in range(1, len(v) + 1):
        best.append(min(best[i] + secrets.SPLIT + one(v[i:j]) for i in range(j)))
    return best[-1]


@lru_cache(None)
def one(x):
    """log10 of the fewest guesses of x as a single segment."""
    costs = [len(x) * log10(sum(n for k, n in enumerate(secrets.CLASSES) if any(secrets.kind(c) == k for c in x)))]
    plain = x.lower()
    unleet = plain.translate(secrets.LEET)
    for word in {plain, unleet} & set(secrets.RANK):
        changed = sum(a != b for a, b in zip(plain, word, strict=True))
        costs.append(log10(secrets.RANK[word]) + log10(2) * (changed + (x != plain)))
    if secrets.DATE.fullmatch(x):
        costs.append(log10(119) if len(x) == 4 else log10(365 * 119) + (0 if x.isdigit() else 0.6))
    low = x.translate(secrets.SHIFTED).lower()
    if len(x) >= secrets.WALK and all(map(secrets.touch, low, low[1:])):
        costs.append(log10(94) + (len(x) - 1) * log10(4.6))
    costs += [least(x[:u]) + log10(len(x) // u) for u in range(1, len(x) // 2 + 1) if len(x) % u == 0 and x[:u] * (len(x) // u) == x]
    return min(costs)


@pytest.mark.parametrize("v", ["asdfghello", "zxcvbnmonkey", "kQ7#xZ2!vR5pLm9@tW4b" * 3, "20202020", "aaaaapple", "ababababbatman", "qwertyuiopassword", "x" * 60, "abcabcabcdabcd"])
def test_listed(v):
    assert abs(secrets.guesses(v) - least(v)) < 1e-9


def test_figures():
    assert secrets.guesses("asdfghello") < 7 and secrets.guesses("zxcvbnmonkey") < 7.5
    assert abs(secrets.guesses("kQ7#xZ2!vR5pLm9@tW4b" * 3) - secrets.guesses("kQ7#xZ2!vR5pLm9@tW4b") - log10(3)) < 1e-9


def test_random():
    rng = random.Random(7)
    parts = ["pass", "word", "qwerty", "asdfg", "hello", "one", "12", "2020", "ab", "z", "!", "aaa", "xK9#", "monkey", "P4ss"]
    for _ in range(300):
        v = "".join(rng.choices(parts, k=rng.randint(1, 5)))
        v = v * rng.choice([1, 1, 2, 3]) + rng.choice(["", "hello", v[:3]])
        assert abs(secrets.guesses(v) - least(v)) < 1e-9, v
    for _ in range(200):
        v = "".join(rng.choices("ab", k=rng.randint(1, 40)))
        assert abs(secrets.guesses(v) - least(v)) < 1e-9, v
