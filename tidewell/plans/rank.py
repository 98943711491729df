"""Proximity ranking as Columns.

A document's text score sums, over the occurrences r of the query's rarest word, what the nearest occurrence of each other
word adds: 1 (in query order) or 1/2 over the distance, the same for each pair of other words over the width of all
three, and 1 over the width of the whole query's span if every word was found; all divided by 1.05 ** r.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECAY, TITLE = 1.05, 30.0


def nearest(p: Column, x: Column) -> Column:
    """The value of a sorted array nearest to x, the earlier one on ties; null of an empty array."""
    before, after = F.array_max(F.filter(p, lambda y: y < x)), F.array_min(F.filter(p, lambda y: y >= x))
    return F.when(after.isNull() | (x - before <= after - x), before).otherwise(after)


def rarest(counts: list[Column]) -> Column:
    """The index of the least positive count, the first on ties; 0 if none is positive."""
    found = F.filter(F.array(*(F.struct(c.cast("long").alias("n"), F.lit(i).alias("i")) for i, c in enumerate(counts))), lambda s: s.getField("n") > 0)
    return F.coalesce(F.array_min(found).getField("i"), F.lit(0))


def score(places: list[np.ndarray], rare: int) -> float:
    """The sum for one document: sorted positions of the query's words, and the number of the rarest. Nearest occurrences come from
    binary search, so a document costs about its positions, not their square."""
    r, k = places[rare], len(places)
    if not len(r):
        return 0.0
    near = {}
    for i, p in enumerate(places):
        if len(p):
            j = np.searchsorted(p, r)
            before, after = p[np.maximum(j - 1, 0)], p[np.minimum(j, len(p) - 1)]
            near[i] = np.where((j > 0) & ((j == len(p)) | (r - before <= after - r)), before, after)
    met = [i for i in near if i != rare]
    fits = {i: near[i] <= r if i < rare else near[i] >= r for i in met}
    gain = np.zeros(len(r))
    for n, i in enumerate(met):
        gain += np.where(fits[i], 1.0, 0.5) / np.maximum(np.abs(near[i] - r), 1)
        for j in met[n + 1 :]:
            ordered = fits[j] & (near[i] <= near[j] if j < rare else fits[i])
            width = np.maximum(np.maximum(near[i], near[j]), r) - np.minimum(np.minimum(near[i], near[j]), r)
            gain += np.where(ordered, 1.0, 0.5) / np.maximum(width, 1)
    if len(met) == k - 1:
        all_ = np.stack(list(near.values()))
        width = all_.max(axis=0) - all_.min(axis=0)
        gain += np.where(width > 0, 1.0 / np.maximum(width, 1), 0.0)
    with np.errstate(over="ignore"):
        return float((gain / DECAY ** r.astype(float)).sum())


@F.arrow_udf(T.DoubleType())
def _scores(table: pa.Array, rare: pa.Array) -> pa.Array:
    """table: lists of as many position arrays a row. Positions are read where Arrow has them; none becomes a Python object."""
    rows = table.flatten()
    ends, places = rows.offsets.to_numpy(), rows.values.to_numpy()
    k = len(rows) // max(len(table), 1)
    arrays = lambda i: [places[ends[j] : ends[j + 1]] for j in range(i * k, (i + 1) * k)]
    return pa.array([score(arrays(i), r) for i, r in enumerate(rare.to_pylist())], pa.float64())


def text_score(places: list[Column], rare: Column) -> Column:
    """score() of the sorted position arrays of the query's words, repeats included. A column of documents goes to Python at once: built-in
    array functions have no binary search and would compare each occurrence with all of every word."""
    return _scores(F.array(*places), rare.cast("int")) if len(places) > 1 else F.lit(0.0)
