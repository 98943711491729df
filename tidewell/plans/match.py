"""Query trees as Columns over per-document position arrays."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import qlang
from .qlang import And, Node, Or, Phrase, Word


def term_pairs(words: list[str]) -> list[str]:
    """The terms that words stand for: each as body and as title term."""
    return list(dict.fromkeys(t for w in words for t in (w, w + "#")))


def positions(posts: DataFrame, words: list[str]) -> DataFrame:
    """(chunk_id, doc_id, b0, t0, b1, t1, ...): for each word its body and its title positions, in order, in the documents
    that have any. posts is postings or the stored index; one shuffle of the matching rows."""
    found = posts.where(F.col("term").isin(*term_pairs(words)))
    long_form = "pos" in posts.columns
    aggs = []
    for k, w in enumerate(words):
        for side, term in (("b", w), ("t", w + "#")):
            if long_form:
                aggs.append(F.sort_array(F.collect_list(F.when(F.col("term") == term, F.col("pos")))).alias(f"{side}{k}"))
            else:
                aggs.append(F.coalesce(F.max(F.when(F.col("term") == term, F.col("positions"))), F.array().cast("array<bigint>")).alias(f"{side}{k}"))
    return found.groupBy("chunk_id", "doc_id").agg(*aggs)


def condition(node: Node, words: list[str]) -> Column:
    """Whether a row of positions() satisfies the tree. words: those that positions() was given, in its order."""
    at = {w: k for k, w in enumerate(words)}
    has = lambda w: (F.size(f"b{at[w]}") > 0) | (F.size(f"t{at[w]}") > 0)
    everywhere = lambda w: F.concat(F.col(f"b{at[w]}"), F.col(f"t{at[w]}"))
    match node:
        case Word(text):
            return has(text)
        case Phrase(texts):
            rest = lambda x: reduce(and_, (F.array_contains(everywhere(w), x + i) for i, w in enumerate(texts) if i))
            return reduce(and_, map(has, texts)) & F.exists(everywhere(texts[0]), rest) if len(texts) > 1 else has(texts[0])
        case Or(parts):
            return reduce(or_, (condition(p, words) for p in parts))
        case And(parts, without):
            return reduce(and_, [condition(p, words) for p in parts] + [~condition(p, words) for p in without])
    return F.lit(False)


def matches(posts: DataFrame, query: str) -> DataFrame:
    """positions() of the documents that satisfy a query."""
    tree = qlang.parse(query)
    words = qlang.literals(tree)
    return positions(posts, words or [""]).where(condition(tree, words))
