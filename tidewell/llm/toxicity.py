"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence s has p_s = sigmoid(b + w.x_s) over the words and word beginnings of its distinct tokens; a document is toxic with
1 - prod(1 - p_s) (noisy-or). A sentence without any feature of the model has p_s = 0, so that a document doesn't become
toxic by its length alone. w and b are fitted to document labels alone, and the fitted p_s then show which sentences
offend. Features are those more frequent in toxic documents, in MIN_DOCS and a MIN_SHARE of the toxic sample at least. The fit uses
a bounded sample of labelled rows, taken by hash of doc_id: at most MAX_TOXIC and MAX_CLEAN documents, of at most MAX_CHARS characters
in all of either kind and LONG_CHARS each, so that the driver's share is bounded in bytes too. The model is a dictionary of at most
FEATURES entries, whatever the input's size. Scoring covers every document whole, in one pass without a shuffle.

Defined cases: null and empty texts have no sentence and score 0; a null label is no label, and a document that is labelled
both ways counts as toxic; without labels of both kinds nothing is toxic; repeated rows score alike; of the texts of one doc_id
the least serves for the fit, and each is scored; ties in the sample's hash go by doc_id; very long texts are scored whole, though
beyond LONG_CHARS they aren't fitted on; doc_id is a number; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, read

MAX_TOXIC, MAX_CLEAN, FEATURES, MIN_DOCS, MIN_SHARE, HELD_OUT = 2000, 4000, 2048, 4, 0.01, 5
LEAST_CUT, MOST_CUT = 0.5, 0.8
MAX_CHARS, LONG_CHARS = 30_000_000, 300_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
SCHEMA = "doc_id long, toxicity double, sentence int, start int, end int, score double"


def features(token: str) -> list[str]:
    """The words of a token, and their beginnings of 4 to 7 letters."""
    out = []
    for w in LETTERS.findall(token.lower()):
        out.append(w)
        out += [w[:k] + "*" for k in PREFIXES if len(w) > k]
    return out


class Model:
    """Weights of features, a bias and the threshold on the noisy-or."""

    def __init__(self, weights: dict[str, float], bias: float, threshold: float) -> None:
        self.weights, self.bias, self.threshold = weights, bias, threshold
        self._starts = {f[: min(PREFIXES)] for f in weights}
        self._known: dict[str, float] = {}

    def __getstate__(self) -> tuple:
        return self.weights, self.bias, self.threshold

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def token(self, token: str) -> float:
        w = self._known.get(token)
        if w is None:
            if len(self._known) > 500_000:
                self._known.clear()
            low, get = token.lower(), self.weights.get
            some = any(x[: min(PREFIXES)] in self._starts for x in LETTERS.findall(low))
            w = self._known[token] = float(sum(get(f, 0.0) for f in features(low))) if some else 0.0
        return w

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence that has a word; -inf without a feature."""
        token, out, known = self.token, [], self._known
        for m in SENTENCE.finditer(text or ""):
            if parts := m.group().split():
                e, some = self.bias, False
                for t in dict.fromkeys(parts):
                    w = known.get(t)
                    if w is None:
                        w = token(t)
                    if w:
                        e, some = e + w, True
                out.append((m.start(), m.end(), e if some else -inf))
        return out

    def document(self, text: str | None) -> float:
        return noisy_or([z for _, _, z in self.sentences(text)])


def noisy_or(z: list[float]) -> float:
    """1 - prod(1 - sigmoid(z))."""
    return float(-np.expm1(-np.logaddexp(0.0, z).sum())) if len(z) else 0.0


class Bags:
    """Sentences as (feature, sentence, count) entries, and the document of each sentence."""

    def __init__(self, feat: np.ndarray, sent: np.ndarray, count: np.ndarray, doc: np.ndarray, features: int, docs: int) -> None:
        self.feat, self.sent, self.count, self.doc, self.features, self.docs = feat, sent, count, doc, features, docs

    def soft(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-odds of each sentence, and -log P(clean) of each document. w ends with the bias."""
        z = w[-1] + np.bincount(self.sent, w[self.feat] * self.count, minlength=len(self.doc))
        return z, np.bincount(self.doc, np.logaddexp(0, z), minlength=self.docs)

    def loss(self, w: np.ndarray, y: np.ndarray, weight: np.ndarray, noise: float, l2: float) -> float:
        """Weighted -log P(label) under noisy-or, a toxic label being wrong with the chance `noise`; and the l2 penalty."""
        soft = self.soft(w)[1]
        toxic = np.log(noise + (1 - noise) * -np.expm1(-soft))
        return float((weight * np.where(y > 0, -toxic, soft)).sum() + l2 / 2 * (w[:-1] ** 2).sum())

    def slope(self, w: np.ndarray, y: np.ndarray, weight: np.ndarray, noise: float, l2: float) -> np.ndarray:
        """The gradient of loss()."""
        z, soft = self.soft(w)
        clean = np.exp(-soft)
        d_soft = np.where(y > 0, -(1 - noise) * clean / (noise + (1 - noise) * (1 - clean)), 1.0) * weight
        d_z = d_soft[self.doc] / (1 + np.exp(-z))
        return np.append(np.bincount(self.feat, d_z[self.sent] * self.count, minlength=self.features) + l2 * w[:-1], d_z.sum())


def fit(texts: list[str], labels: list[int], ids: list[int], steps: int = 300, l2: float = 2e-4, l1: float = 2e-4, noise: float = 0.05) -> Model | None:
    """None without labels of both kinds. noise: the share of toxic labels expected to be wrong, which bounds their pull. A fifth of the documents, by id, is held out to choose the threshold by F1,
    between LEAST_CUT and MOST_CUT (few labels say little about it)."""
    y = np.array(labels, dtype=float)
    if not 0 < y.sum() < len(y):
        return None
    df = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        df[label].update({f for t in set((text or "").split()) for f in features(t)})
    a, b = y.sum(), len(y) - y.sum()

    def apart(f: str) -> float:
        p, q = (df[1][f] + 0.5) / (a + 1), (df[0][f] + 0.5) / (b + 1)
        return (p - q) / np.sqrt((p * (1 - p)) / a + (q * (1 - q)) / b)

    least = max(MIN_DOCS, MIN_SHARE * a)
    names = sorted((f for f in df[1] if df[1][f] >= least and apart(f) > 0), key=lambda f: (-apart(f), f))[:FEATURES]
    at_ = {f: i for i, f in enumerate(names)}
    del df
    # the texts are read a second time instead of being kept as features, which takes several times their memory
    known = lru_cache(100_000)(lambda t: tuple(at_[f] for f in features(t) if f in at_))
    feat, sent, count, doc = (array("q") for _ in range(4))
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text or ""):
            found = Counter(f for t in dict.fromkeys(m.group().split()) for f in known(t))
            for f, k in found.items():
                feat.append(f), sent.append(len(doc)), count.append(k)
            if found:
                doc.append(d)
    bags = Bags(*(np.array(x, dtype=np.int64) for x in (feat, sent, count, doc)), len(names), len(y))
    del feat, sent, count, doc
    held = np.array([hash(int(i)) % HELD_OUT == 0 for i in ids])
    if not 0 < y[~held].sum() < (~held).sum() or not 0 < y[held].sum() < held.sum():
        held[:] = False
    weight = np.where(held, 0.0, np.where(y > 0, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y[~held]).sum())))
    w, bias = np.zeros(len(names) + 1), -4.0
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)

    for step in range(1, steps + 1):
        g = bags.slope(w, y, weight, noise, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        move = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w = w - move * m / (1 - 0.9**step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - np.minimum(move[:-1], 100.0) * l1, 0)
    p = -np.expm1(-bags.soft(w)[1])
    on = held if held.any() else np.ones(len(y), bool)
    order = np.argsort(-p[on], kind="stable")
    hit = np.cumsum(y[on][order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + y[on].sum())
    best = int(np.argmax(f1))
    cut = p[on][order]
    threshold = (cut[best] + (cut[best + 1] if best + 1 < len(cut) else 0.0)) / 2
    threshold = min(max(threshold, LEAST_CUT), MOST_CUT)
    return Model({f: float(x) for f, x in zip(names, w, strict=False) if abs(x) > 1e-6}, float(w[-1]), float(threshold))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> pd.DataFrame:
    """At most max_toxic and max_clean labelled documents, those of the least hash of doc_id, as far as max_chars goes for each kind.
    Lengths are fetched and added up before any text is."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(at("doc_id").alias("id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    order = [F.xxhash64("id"), "id"]
    picked = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionAll(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    texts = docs.select(at("doc_id").alias("id"), at("text").alias("text"))
    sizes = texts.join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("n")).where(F.col("n") <= LONG_CHARS)
    sizes = sizes.withColumn("place", F.xxhash64("id")).toPandas().sort_values(["place", "id"])  # at most max_toxic + max_clean rows of four numbers
    kept = sizes[sizes.groupby("toxic")["n"].cumsum() <= max_chars][["id", "toxic"]]
    chosen = docs.sparkSession.createDataFrame(list(kept.itertuples(index=False, name=None)), f"id {picked.schema['id'].dataType.simpleString()}, toxic int")
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas().sort_values("id")


def train(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model | None:
    rows = sample(docs, labels, **bounds)
    return fit(rows["text"].tolist(), rows["toxic"].tolist(), rows["id"].tolist())


def offending_sentences(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, toxicity, sentence, start, end, score) of each toxic document's offending sentences: those whose own
    probability reaches half of the threshold, and its highest one in any case. start and end count characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True) if model else ():
                found = model.sentences(text)
                z = [x for _, _, x in found]
                if (p := noisy_or(z)) >= model.threshold and z:
                    own = np.exp(-np.logaddexp(0.0, -np.array(z)))
                    for k in np.flatnonzero((own >= model.threshold / 2) | (own == own.max())):
                        out.append((i, p, k, found[k][0], found[k][1], own[k]))
            yield pd.DataFrame(out, columns=["doc_id", "toxicity", "sentence", "start", "end", "score"])

    return docs.select(at("doc_id").cast("long").alias("doc_id"), at("text").alias("text")).mapInPandas(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that the model doesn't reject; only text goes to Python."""
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([model.document(t) < model.threshold for t in text], dtype=bool)

    return docs.where(clean(at("text")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return offending_sentences(docs, train(docs, read(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}
QUERIES = {"op1_toxicity": op1_toxicity}
