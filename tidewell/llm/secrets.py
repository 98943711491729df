"""Secret scan: how many guesses a credential's value would take.

Values are read where text assigns something to a credential word (password, secret, token, API key ...). Each value is
split into segments so that their guesses, multiplied, are fewest: words of a list (rank, capitals, look-alike digits),
dates, repeats of a short unit, keyboard walks, and brute-force spans; each further segment costs a factor of 10. The least
product over all segmentations comes from dynamic programming over the value's positions. A value that still needs
10 ** MIN_LOG10 guesses is a real secret; the rest are placeholders and weak words.

Words are those of a list of common passwords, and all words of 2 to LONG letters that MIN_DOCS documents have outside of such
values, ranked by how many documents have them (words of equal count share the first's rank); the lesser rank counts. The
documents' words aren't sent whole to any task: the parts of each distinct value that could be words are joined with them.

Segments from a position i: every listed word there; every date there; for each unit, of up to half the value, every number of
its repeats; every walk, of 3 characters at least, between keys that touch (or the same row's next); and brute force over
any span, where each character takes as many guesses as the character classes in the span have members. A unit of more than
UNIT characters that is a repeat itself is left out: no word or date is that long, so its own unit costs no more.

Defined cases: null and empty texts have no value; doc_id is a whole number; a value ends at its quote or at white space, comma or semicolon; values
of any length are scored whole; repeated rows are each reported; rows without a doc_id are reported with null; an empty table
gives an empty result; other columns are not read. Values are shown as a digest, never in clear.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from math import inf, log10
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at, read

MIN_LOG10, SPLIT, UNIT, WALK, LONG, MIN_DOCS = 12.0, 1.0, 16, 3, 40, 2
NAMES = "pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?"
CONTEXT = rf"""(?i)({NAMES})[a-z0-9_]*["']?[ \t]*(?:=>|:=|=(?!>)|:(?!=))[ \t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))"""
STEMS = ("pass", "pwd", "secret", "token", "key", "credential")  # each name of NAMES has one of them
WORDS = """password 123456 qwerty admin welcome login letmein monkey dragon master hello freedom whatever trustno shadow sunshine
princess football baseball superman batman iloveyou secret test guest root default changeme example sample dummy placeholder
your token key pass user name abc access private public server database mysql oracle system windows linux apple google
summer winter spring autumn monday friday january february march april june july august september october november december
love money jesus michael jordan jennifer thomas robert daniel charlie george andrew hunter ranger harley killer soccer
hockey tiger cookie cheese coffee banana orange purple silver golden ginger pepper summer flower internet computer
mustang corvette ferrari porsche mercedes yellow black white green blue red one two three four five six seven eight nine
the of and to in for with that from this home work office school family friend none null true false enter demo temp prod dev
staging value string here insert replace redacted hidden xxxx todo foo bar baz""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST = max(map(len, RANK))
LEET = str.maketrans("@4301!57$8", "aaeoiistsb")
DATE = re.compile(r"(?:19|20)\d\d|\d{1,2}([-/._])\d{1,2}\1(?:19|20)?\d\d|(?:19|20)\d\d([-/._])\d{1,2}\2\d{1,2}|(?:19|20)\d{2}(?:0\d|1[0-2])[0-3]\d|[0-3]\d(?:0\d|1[0-2])(?:19|20)?\d\d")
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
CLASSES = (10, 26, 26, 33)
SIZE = [sum(n for b, n in enumerate(CLASSES) if s >> b & 1) for s in range(16)]
LETTERS = re.compile(r"[^\W\d_]{2,}")


def kind(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def touch(a: str, b: str) -> bool:
    """Whether two keys lie side by side; each row is set off half a key to the right of the one above."""
    p, q = PLACE.get(a), PLACE.get(b)
    if not p or not q or p == q:
        return False
    down = q[0] - p[0]
    return (down == 0 and abs(q[1] - p[1]) == 1) or (down == 1 and q[1] - p[1] in (-1, 0)) or (down == -1 and q[1] - p[1] in (0, 1))


def repeats(v: str, longest: int = LONGEST) -> list[list[tuple[int, int]]]:
    """For each position the (length of unit, most repeats) of the units that are repeated there."""
    out: list[list[tuple[int, int]]] = [[] for _ in v]
    a = np.array([ord(c) for c in v], dtype=np.int64)
    for u in range(1, len(v) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.r_[False, a[:-u] == a[u:], False].astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= u and (u <= max(UNIT, longest) or (v[s : s + u] * 2).find(v[s : s + u], 1) == u):
                for i in range(s, e - u + 1):
                    out[i].append((u, (e - i) // u + 1))
    return out


def segments(v: str, memo: dict[str, float], ranks: dict[str, int]) -> Iterator[Iterator[tuple[int, int, np.ndarray]]]:
    """For each position i of v the segments that start there, but for brute-force ones: (end, step, costs), a segment to end,
    end + step ... for each of the costs (log10 of guesses)."""
    low = v.translate(SHIFTED).lower()
    walk = [1] * (len(v) + 1)
    for i in range(len(v) - 2, -1, -1):
        walk[i] = walk[i + 1] + 1 if touch(low[i], low[i + 1]) else 1
    longest = max(map(len, ranks), default=0)
    again = repeats(v, longest)
    logs = np.log10(np.arange(2, max(len(v), 2) + 1))
    steps = log10(94) + np.arange(len(v)) * log10(4.6)

    def starting(i: int) -> Iterator[tuple[int, int, np.ndarray]]:
        for n in range(2, min(longest, len(v) - i) + 1):
            raw = v[i : i + n]
            plain = raw.lower()
            for word, changed in ((plain, 0), (plain.translate(LEET), sum(a != b for a, b in zip(plain, plain.translate(LEET), strict=True)))):
                if word in ranks:
                    yield i + n, 1, np.array([log10(ranks[word]) + log10(2) * (changed + (raw != plain))])
        for n in range(4, min(10, len(v) - i) + 1):
            if DATE.fullmatch(v, i, i + n):
                yield i + n, 1, np.array([log10(119) if n == 4 else log10(365 * 119) + (0.6 if not v[i : i + n].isdigit() else 0)])
        for u, k in again[i]:
            yield i + 2 * u, u, _guesses(v[i : i + u], memo, ranks) + logs[: k - 1]
        if walk[i] >= WALK:
            yield i + WALK, 1, steps[WALK - 1 : walk[i]]

    return map(starting, range(len(v)))


def spans(v: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of all segments of v but the brute-force ones."""
    for i, found in enumerate(segments(v, {}, RANK)):
        for j, step, costs in found:
            for n, g in enumerate(costs.tolist()):
                yield i, j + n * step, g


def guesses(v: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the fewest guesses over all segmentations of v; ranks: of words besides the listed ones."""
    least = RANK
    if ranks:
        least = dict(RANK)
        for w, r in ranks.items():
            least[w] = min(r, least.get(w, r))
    return _guesses(v, {}, least)


def _guesses(v: str, memo: dict[str, float], ranks: dict[str, int]) -> float:
    if v in memo:
        return memo[v]
    best = np.full(len(v) + 1, inf)
    best[0] = -SPLIT
    brute = [inf] * 16  # the best cost of a brute-force span under way, by the classes it may use
    for i, (c, found) in enumerate(zip(v, segments(v, memo, ranks), strict=True)):
        here = float(best[i]) + SPLIT
        for j, step, costs in found:
            ends = best[j : j + step * len(costs) : step]
            np.minimum(ends, here + costs, out=ends)
        b = 1 << kind(c)
        for s in range(1, 16):
            brute[s] = min(brute[s], here) + log10(SIZE[s]) if s & b else inf
        best[i + 1] = min(best[i + 1], *brute)
    memo[v] = float(best[-1])
    return memo[v]


def has_place(text: Column) -> Column:
    """Whether CONTEXT is found; texts without any stem of its names, most of them, are spared the pattern."""
    low = F.lower(text)
    return reduce(or_, (F.contains(low, F.lit(s)) for s in STEMS)) & text.rlike(CONTEXT)


def word_ranks(docs: DataFrame) -> DataFrame:
    """(word, rank) of the words that MIN_DOCS documents have outside of credential values; rank 1 is in the most documents."""
    text = F.when(has_place(at("text")), F.regexp_replace(at("text"), CONTEXT, "$1 ")).otherwise(at("text"))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))).alias("word"))
    counts = words.where(F.length("word").between(2, LONG)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    levels = counts.groupBy("n").agg(F.count("*").alias("words"))
    above = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    return counts.join(levels.select("n", (F.coalesce(above, F.lit(0)) + 1).alias("rank")), "n").select("word", "rank")


def parts(v: str) -> set[str]:
    """All parts of v, lower-cased and with look-alike digits read as letters or not, that could be words of letters."""
    out = set()
    for t in {v.lower(), v.lower().translate(LEET)}:
        for run in LETTERS.finditer(t):
            r = run.group()
            out.update(r[i : i + n] for i in range(len(r)) for n in range(2, min(LONG, len(r) - i) + 1))
    return out


def scan(docs: DataFrame, min_log10: float = MIN_LOG10) -> DataFrame:
    """(doc_id, name, digest, length, log10_guesses, secret) of every value in a credential's place, over whole texts."""
    found = docs.where(has_place(at("text"))).select(at("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(at("text"), F.lit(CONTEXT), F.lit(0))).alias("hit"))
    pattern = re.compile(CONTEXT, re.ASCII)

    def read_hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, hit in zip(pdf["doc_id"], pdf["hit"], strict=True):
                m = pattern.match(hit)
                out.append((i, m.group(1).lower(), next(x for x in m.groups()[1:] if x is not None)))
            yield pd.DataFrame(out, columns=["doc_id", "name", "value"]).astype({"doc_id": "Int64"})

    def list_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for v in pdf["value"]:
                words = sorted(parts(v))
                yield pd.DataFrame({"value": [v] * len(words), "word": words}, dtype=object)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, words in zip(pdf["value"], pdf["words"], strict=True):
                g = guesses(v, {} if words is None else {w["word"]: w["rank"] for w in words})
                out.append((v, hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:16], len(v), round(g, 6), g >= min_log10))
            yield pd.DataFrame(out, columns=["value", "digest", "length", "log10_guesses", "secret"])

    values = found.mapInPandas(read_hits, "doc_id long, name string, value string")
    distinct = values.select("value").distinct()
    # Spark takes what Python returns for as small as what it was given and would broadcast it: these joins are by shuffle
    known = distinct.mapInPandas(list_parts, "value string, word string").hint("merge").join(word_ranks(docs), "word")
    known = known.groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("words"))
    scored = distinct.join(known, "value", "left").mapInPandas(score, "value string, digest string, length int, log10_guesses double, secret boolean")
    return values.join(scored.hint("merge"), "value").select("doc_id", "name", "digest", "length", "log10_guesses", "secret")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op10_secret_scan": op10_secret_scan}
