"""HTML as words, title words, links and base, by one state machine that jumps from tag to tag.

What it does not do is as fixed as what it does: entities stay undecoded, an unknown tag is dropped like a known one, a comment
is one only as <!-- followed by white space, / or >, the rest of a script, style or svg section goes up to its closing tag
in the same case, and a quoted attribute counts wherever it comes up before the tag's first >.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_lower

NAME = re.compile(r"[^ \n\t\r\f/>]*")
END = re.compile(r"(?:[^>&]|&.)*", re.S)
WORDS = re.compile(r"[^ \n\t\r\f]+")
SECTIONS = ("script", "style", "svg")
#: What a page is parsed to.
COLUMNS = {
    "words": T.ArrayType(T.StringType()), "title_words": T.ArrayType(T.StringType()),
    "links": T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor_text", T.ArrayType(T.StringType()))])), "base": T.StringType(),
}
_TEXTS = pa.list_(pa.string())
_KINDS = {"words": _TEXTS, "title_words": _TEXTS, "links": pa.list_(pa.struct([("url", pa.string()), ("anchor_text", _TEXTS)])), "base": pa.string()}
#: Bytes of HTML that are parsed before what came out leaves Python; one larger page is parsed alone.
PARSED_BYTES = 1 << 20


class Link(NamedTuple):
    url: str
    anchor_text: list[str]


class Parsed(NamedTuple):
    words: list[str]
    title_words: list[str]
    links: list[Link]
    base: str


def parse(html: str | None) -> Parsed:
    text, out = html or "", Parsed([], [], [], "")
    words, titles, links, _ = out
    base, size = None, len(text)
    in_title = in_anchor = False
    at = start = 0

    def tag_end(p: int) -> int:
        return min(size, END.match(text, p).end() + 1)

    def flush(to: int) -> None:
        found = WORDS.findall(text, start, to)
        (titles if in_title else words).extend(found)
        if in_anchor:
            links[-1].anchor_text.extend(found)

    def attribute(p: int, name: str) -> tuple[str | None, int]:
        """The value of name=" between p and the next >, and the place to go on from."""
        close = text.find(">", p)
        stop = size if close < 0 else close
        k = text.find(name, p, min(size - 1, stop + len(name)))
        if k < 0 or k >= stop:
            return None, stop
        quote = text.find('"', k + len(name))
        return (text[k + len(name) : quote], quote) if quote >= 0 else (None, size)

    while (at := text.find("<", at)) >= 0:
        closing = text.startswith("/", at + 1)
        if at + 1 + closing >= size:
            break
        flush(at)
        end = NAME.match(text, at + 1 + closing).end()
        raw = text[at + 1 + closing : end]
        name = raw.lower() if raw.isascii() else raw
        at = end
        if closing:
            in_anchor &= name != "a"
            in_title &= name != "title"
        elif name in SECTIONS:
            close = re.compile(r"</" + re.escape(raw) + r"(?=[ \n\t\r\f/>]|$)").search(text, end)
            at = close.start() if close else size
        elif name == "title":
            at = start = tag_end(at)
            in_title = True
            continue
        elif name == "base" and base is None:
            value, at = attribute(end, 'href="')
            if value is not None:
                base = value
            elif at >= size:
                start = size
                break
        elif name == "embed":
            value, at = attribute(end, 'src="')
            if value is not None:
                links.append(Link(value, []))
        elif name == "a":
            value, at = attribute(end, 'href="')
            if value is not None:
                links.append(Link(value, []))
                in_anchor = True
        elif name == "!--":
            close = text.find("-->", end)
            at = close if close >= 0 else size
        at = start = tag_end(at)
    if start < size:
        rest = WORDS.findall(text, start, size)
        last = rest[-1:] if text[-1] not in " \n\t\r\f" else []  # a word that the end cuts off is a body word everywhere
        found = rest[: len(rest) - len(last)]
        (titles if in_title else words).extend(found)
        if in_anchor:
            links[-1].anchor_text.extend(found)
        words.extend(last)
    return out._replace(base=base or "")


def parsed_batches(batches: Iterator[pa.RecordBatch], only: tuple[str, ...] = tuple(COLUMNS)) -> Iterator[pa.RecordBatch]:
    """Batches (page_id, url, html) -> (page_id, url, what is asked for) of a few pages each. Python holds what came of PARSED_BYTES at once,
    however many rows a batch has."""
    for b in batches:
        total, i = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(2)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False), 0
        while i < len(total):
            stop = max(i + 1, int(total.searchsorted((total[i - 1] if i else 0) + PARSED_BYTES, side="right")))
            part = b.slice(i, stop - i)
            found = [parse(h.as_py()) for h in part.column(2)]
            cols = [pa.array([[x._asdict() for x in p.links] for p in found] if c == "links" else [getattr(p, c) for p in found], _KINDS[c]) for c in only]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["page_id", "url", *only])
            i = stop


def parse_pages(pages: DataFrame, only: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """(page_id, url, words, title_words, links, base) of pages (page_id, url, html), or page_id, url and those asked for; one pass, no
    shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kinds = {"page_id": T.LongType(), "url": T.StringType(), **{c: COLUMNS[c] for c in only}}
    return rows.mapInArrow(lambda batches: parsed_batches(batches, only), T.StructType([T.StructField(k, t) for k, t in kinds.items()]))


def is_html(header: Column) -> Column:
    """Whether a response's header says that it is HTML."""
    return F.instr(ascii_lower(header), "content-type: text/html") > 0


def readable(responses: DataFrame) -> DataFrame:
    """The older page readers' gate over responses (status, content_type, html ...): answered with 200, as HTML, in English as far as
    the page's own tag says a language."""
    lang = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?\s*([^\"'\s>]*)", 1))
    return responses.where((F.col("status") == 200) & F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html")) & ((lang == "") | lang.startswith("en")))


def plain_text(html: Column) -> Column:
    """What the older page readers keep of a page: its text without scripts, styles, comments and tags."""
    return F.btrim(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "))


def is_english(html: Column) -> Column:
    return F.instr(ascii_lower(html), 'lang="en"') > 0


def page_links(parsed: DataFrame) -> DataFrame:
    """(page_id, page_url, no, url, anchor_text): a row per link, in page order."""
    return parsed.select("page_id", F.col("url").alias("page_url"), F.posexplode("links").alias("no", "link")).select("page_id", "page_url", "no", "link.url", "link.anchor_text")
