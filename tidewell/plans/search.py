"""Search: query text -> the ten best documents, in one plan.

The postings of the query's terms are picked out at the scan, gathered by document (the one shuffle), tested, scored and cut to
the best ten, of which each task sends its own ten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded
from ..functions.urls import url_score
from . import qlang
from .match import condition, positions
from .rank import TITLE, rarest, text_score

TOP, GOOD_LENGTH = 10, (350, 2000)
RESULT = "chunk_id long, doc_id long, url string, score double"
SHORTCUTS = ("and", "is", "the")
REFERENCE_PAGES = (
    "https://en.wikipedia.org/wiki/", "https://www.dictionary.com/browse/", "https://www.merriam-webster.com/dictionary/",
    "https://en.wiktionary.org/wiki/", "https://dictionary.cambridge.org/us/dictionary/english/", "https://www.collinsdictionary.com/us/dictionary/english/",
)


def scored(posts: DataFrame, docs: DataFrame, query: str, stats: DataFrame | None = None, length_bonus: float = 0.0) -> DataFrame:
    """(chunk_id, doc_id, url, body_score, title_score, url_score, score) of every document that satisfies the query.
    docs: chunk_id, doc_id, url. Which word is rarest is decided by chunk, from the stored counts (chunk_id, term, cf) if there are
    any, else from the postings. length_bonus goes to documents (docs then with doc_len) of a GOOD_LENGTH."""
    tree = qlang.parse(query)
    words, ranked = qlang.literals(tree), qlang.rank_words(tree)
    at = {w: k for k, w in enumerate(words)}
    found = positions(posts, words or [""])
    rare = F.lit(0)
    if len(set(ranked)) > 1:
        once = F.col("cf") if stats is not None else F.lit(1) if "pos" in posts.columns else F.size("positions")
        rows = (posts if stats is None else stats).where(F.col("term").isin(*words))
        counts = rows.groupBy("chunk_id").agg(*(F.sum(F.when(F.col("term") == w, once).otherwise(0)).alias(f"n{k}") for w, k in at.items()))
        found = found.join(counts, "chunk_id", "left")
        rare = rarest([F.col(f"n{at[w]}") for w in ranked])
    hits = found.where(condition(tree, words)).withColumn("rare", rare)
    hits = hits.withColumn("body_score", text_score([F.col(f"b{at[w]}") for w in ranked], F.col("rare")))
    hits = hits.withColumn("title_score", text_score([F.col(f"t{at[w]}") for w in ranked], F.col("rare")))
    bonus = F.when(F.col("doc_len").between(*GOOD_LENGTH), length_bonus).otherwise(0.0) if length_bonus else F.lit(0.0)
    hits = hits.select("chunk_id", "doc_id", "body_score", "title_score").join(docs.select("chunk_id", "doc_id", "url", bonus.alias("bonus")), ["chunk_id", "doc_id"])
    hits = hits.withColumn("url_score", url_score(F.col("url"), ranked))
    return hits.withColumn("score", F.col("body_score") + F.col("title_score") * TITLE + F.col("url_score") + F.col("bonus")).drop("bonus")


def best(hits: DataFrame, k: int = TOP) -> DataFrame:
    """The k best with a positive score; ties go by chunk and document."""
    return hits.where("score > 0").orderBy(F.desc("score"), "chunk_id", "doc_id").limit(k).select("chunk_id", "doc_id", "url", "score")


def shortcut(spark: SparkSession, word: str) -> DataFrame:
    """(url) of six reference works' pages on a word that every document has."""
    return spark.createDataFrame([(p + word,) for p in REFERENCE_PAGES], "url string")


def search(posts: DataFrame, docs: DataFrame, query: str, k: int = TOP, stats: DataFrame | None = None) -> DataFrame:
    """The front door: a request as it comes in, to (chunk_id, doc_id, url, score), best first. A query that can't be read
    has no result; the words that every document has get reference pages."""
    spark, text = posts.sparkSession, decoded(query)
    if text in SHORTCUTS:
        return shortcut(spark, text).selectExpr("CAST(NULL AS long) AS chunk_id", "CAST(NULL AS long) AS doc_id", "url", "CAST(0 AS double) AS score")
    try:
        return best(scored(posts, docs, text, stats), k)
    except qlang.QueryError:
        return spark.createDataFrame([], RESULT)


def results_json(hits: DataFrame) -> DataFrame:
    """One row: the URLs as a JSON array, best first, empty ones left out."""
    rows = hits.where(F.length("url") > 0).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "doc_id", "url"))).alias("r"))
    return rows.select(F.to_json(F.transform("r", lambda x: x.getField("url"))).alias("json"))
