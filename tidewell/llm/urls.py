"""URL filter: all wildcard rules at once, as one bit-parallel automaton over each canonical URL.

A rule is a glob over the whole canonical URL: * stands for any run of characters, ? for one, all else for itself. A rule of
m characters other than * takes m + 1 bits, bit i for "i characters met"; * after i characters lets bit i stay set. With D
the set bits, a character c takes D to ((D << 1) & B[c]) | (D & S): one shift, two ands and an or on a few 64-bit words,
with a carry between words, for all rules together. A column of URLs is advanced character by character, all at once.

Canonical: trimmed; scheme and host in lower case; the port that the scheme implies, a trailing dot of the host and the
fragment dropped; an empty path is /. Other strings than scheme://host... only lose the fragment. Characters outside ASCII
are percent-encoded bytes before matching, so ? stands for one byte of those.

Defined cases: a null URL matches no rule and isn't blocked; an empty one is matched as the empty text; URLs of any length are
matched whole; repeated rows are each matched; no rule matches nothing; an empty table gives an empty result; extra columns
pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, fresh, others, read

#: Rules that block, and rules that let pass whatever is blocked.
BLOCK = (
    "*://*.cheap-pills.*/*", "*://cheap-pills.*/*", "*://*casino*/*", "*://*.free-bets.*/*", "*://free-bets.*/*", "*://ads-*.*/*",
    "*://*.ads.*/*", "*://*tracker*.*/*", "*://*/*.exe", "*://*/*.zip", "*://*/*?utm_source=*", "*://*/*&utm_source=*", "*/wp-login.php*",
    "*://*/*/login*", "*://m.*/*?page=?&ref=*", "*://*/tag/*/page/*", "*://*/search?q=*", "*://*/??/?.html", "ftp://*", "javascript:*",
)
ALLOW = ("https://*.example.org/en/*", "*://*/robots.txt")


class Automaton:
    """Multiword Shift-And masks of glob rules."""

    def __init__(self, rules: tuple[str, ...]) -> None:
        self.rules, bit, place = rules, 0, []
        for rule in rules:
            place.append(bit)
            bit += sum(c != "*" for c in encoded(rule).decode("ascii")) + 1
        self.words = max(1, -(-bit // 64))
        self.start, self.stay = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.on = np.zeros((256, self.words), np.uint64)
        self.end = []
        for rule, b in zip(rules, place, strict=True):
            self._set(self.start, b)
            for c in encoded(rule):
                if c == ord("*"):
                    self._set(self.stay, b)
                    continue
                b += 1
                if c == ord("?"):
                    self._set(self.on, b)
                else:
                    self._set(self.on[c], b)
            self.end.append((b // 64, np.uint64(1 << (b % 64))))

    @staticmethod
    def _set(mask: np.ndarray, b: int) -> None:
        mask[..., b // 64] |= np.uint64(1 << (b % 64))

    def match(self, urls: list[str | None]) -> np.ndarray:
        """(url, rule) -> whether the rule matches the whole URL."""
        raw = [encoded(u or "") for u in urls]
        n = np.array([len(x) for x in raw], dtype=np.int64)
        buf = np.frombuffer(b"".join(raw) + b"\0", dtype=np.uint8)
        place = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n
        order = np.argsort(-n, kind="stable")
        place, left = place[order], n[order]
        d = np.broadcast_to(self.start, (len(n), self.words)).copy()
        for j in range(int(n.max()) if len(n) else 0):
            live = int(np.searchsorted(-left, -j))  # those longer than j come first
            now = d[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:live] = (moved & self.on[buf[place[:live] + j]]) | (now & self.stay)
        out = np.zeros((len(n), len(self.rules)), dtype=bool)
        for k, (w, m) in enumerate(self.end):
            out[order, k] = (d[:, w] & m) != 0
        return out & np.array([u is not None for u in urls], dtype=bool)[:, None]


def encoded(url: str) -> bytes:
    return url.encode("ascii") if url.isascii() else re.sub(rb"[\x80-\xff]", lambda m: b"%%%02X" % m.group()[0], url.encode("utf-8", "replace"))


def canonical(url: Column) -> Column:
    u = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    part = lambda k: F.regexp_extract(u, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$", k)
    scheme = F.lower(part(1))
    port = F.when(scheme == "http", r":80$").when(scheme == "https", r":443$").otherwise(r"\b\B")
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), port, F.lit("")), F.lit(r"\.$"), F.lit(""))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(part(1) == "", u).otherwise(F.concat(scheme, F.lit("://"), host, path, part(4)))


def filter_urls(pages: DataFrame, block: tuple[str, ...] = BLOCK, allow: tuple[str, ...] = ALLOW, url_col: str = "url", canonical_col: str = "canonical", rules_col: str = "rules", blocked_col: str = "blocked") -> DataFrame:
    """pages with the canonical URL, the numbers of the rules that match it, as text with commas (block from 1, then
    allow), and whether it is blocked: a block rule matches and no allow rule does. Three columns of the given
    names are added, in place of any that had them."""
    machine, (url, hits) = Automaton((*block, *allow)), fresh(pages, "url", "hits")

    @F.pandas_udf("string")
    def rules(urls: pd.Series) -> pd.Series:
        found = machine.match([u if isinstance(u, str) else None for u in urls])
        out = np.full(len(urls), "", dtype=object)
        for i in np.flatnonzero(found.any(axis=1)):
            out[i] = ",".join(str(k + 1) for k in np.flatnonzero(found[i]))
        return pd.Series(out)

    out = pages.withColumn(url, canonical(at(url_col))).withColumn(hits, rules(at(url)))
    numbers = F.transform(F.split(at(hits), ","), lambda x: x.try_cast("int"))
    blocked = F.exists(numbers, lambda x: x <= len(block)) & ~F.exists(numbers, lambda x: x > len(block))
    return out.select(*(at(c) for c in others(pages, canonical_col, rules_col, blocked_col)), at(url).alias(canonical_col), at(hits).alias(rules_col), F.coalesce(blocked, F.lit(False)).alias(blocked_col))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))


_VALUES = ", ".join(f"({i}, '{r}')" for i, r in enumerate((*BLOCK, *ALLOW), 1))
SQL = {
    "op8_url_filter": rf"""
        WITH r(no, pat) AS (VALUES {_VALUES}),
        f AS (SELECT page_id, url, regexp_replace(trim(url), '#.*$', '', 's') AS u FROM pages),
        p AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$', ['s', 'h', 'p', 'q'], 's') AS x FROM f),
        c AS (SELECT page_id, url, CASE WHEN x.s = '' THEN u ELSE lower(x.s) || '://'
            || regexp_replace(CASE WHEN lower(x.s) = 'http' THEN regexp_replace(lower(x.h), ':80$', '') WHEN lower(x.s) = 'https' THEN regexp_replace(lower(x.h), ':443$', '') ELSE lower(x.h) END, '\.$', '')
            || CASE WHEN x.p = '' THEN '/' ELSE x.p END || x.q END AS canonical FROM p)
        SELECT page_id, any_value(url) AS url, any_value(canonical) AS canonical, coalesce(string_agg(no::VARCHAR, ',' ORDER BY no), '') AS rules,
            coalesce(bool_or(no <= {len(BLOCK)}) AND NOT bool_or(no > {len(BLOCK)}), false) AS blocked
        FROM c LEFT JOIN r ON c.canonical GLOB r.pat GROUP BY page_id"""
}
QUERIES = {"op8_url_filter": op8_url_filter}
