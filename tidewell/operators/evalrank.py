"""Relevance evaluation: result lists against judged ones, and tuning of score weights by numerical gradient."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import numbered

MISSING_RANK = 100


def ranked(results: DataFrame) -> DataFrame:
    """(query, url, actual) of results (query, url, score): rank from 1, best first, ties by URL."""
    return numbered(results, [F.col("query")], [F.desc("score"), F.asc("url")], "actual").select("query", "url", "actual")


def judged_and_crawled(qrels: DataFrame, crawled: DataFrame) -> DataFrame:
    """The judgments whose URL was crawled, with their ranks."""
    return qrels.join(crawled.select("url").distinct(), "url", "left_semi").select(*qrels.columns)


def rank_loss(qrels: DataFrame, actual: DataFrame, missing: int = MISSING_RANK) -> DataFrame:
    """(query, loss): squared differences of judged and actual rank, a URL without one counting as rank `missing`."""
    both = qrels.join(actual, ["query", "url"], "left")
    gap = (F.col("rank") - F.coalesce("actual", F.lit(missing))).cast("double")
    return both.groupBy("query").agg(F.sum(gap * gap).alias("loss"))


def descend(loss: Callable[[list[float]], float], start: list[float], rate: float = 0.01, step: float = 800.0, stop: float = 0.1, rounds: int = 100) -> list[float]:
    """Weights after descent along central differences, until no weight moves by more than `stop`. loss runs a Spark job a call:
    2 a weight a round, on the driver's order only."""
    at = list(start)
    for _ in range(rounds):
        slope = [(loss([*at[:i], w + step, *at[i + 1 :]]) - loss([*at[:i], w - step, *at[i + 1 :]])) / (2 * step) for i, w in enumerate(at)]
        after = [w - rate * g for w, g in zip(at, slope, strict=True)]
        moved, at = max(abs(a - b) for a, b in zip(at, after, strict=True)), after
        if moved < stop:
            break
    return at
