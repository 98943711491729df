"""Text functions as Columns. Case folding touches A to Z only, as in the C locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stripped from both ends of a word.
PUNCTUATION = ".!?,)(#'\";"
ESCAPES = (("%20", " "), ("%5B", "["), ("%5D", "]"), ("%22", '"'))
SPACES = "[ \\n\\t\\r\\f]+"
#: What lies between two terms: white space with the punctuation around it. A run of punctuation is tried from its start only.
BETWEEN = r"(?<![.!?,)(#'\";])[.!?,)(#'\";]*+[ \n\t\r\f][.!?,)(#'\"; \n\t\r\f]*+"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normalize(word: Column) -> Column:
    """ASCII lower case without punctuation at the ends; what is inside stays."""
    return F.btrim(ascii_lower(word), F.lit(PUNCTUATION))


def terms(text: Column) -> Column:
    """The normalized, non-empty words of a text, in order: those of terms_of(), by one fold and one split of the whole text."""
    return F.array_remove(F.split(F.btrim(ascii_lower(text), F.lit(PUNCTUATION + " \n\t\r\f")), BETWEEN), "")


def terms_of(words: Column) -> Column:
    return F.filter(F.transform(words, normalize), lambda w: w != "")


def contains(s: Column, part: str, strict: bool = False) -> Column:
    """Whether part lies in s. Unless strict, a match that ends with s itself doesn't count, as URL scoring expects."""
    return F.instr(s if strict else F.substring(s, F.lit(1), F.length(s) - 1), part) > 0


def decode_request(q: Column) -> Column:
    """The four escapes that a search request may hold, then lower case; all others stay as they are."""
    for code, c in ESCAPES:
        q = F.replace(q, F.lit(code), F.lit(c))
    return ascii_lower(q)


def decoded(q: str) -> str:
    """decode_request() of one string."""
    for code, c in ESCAPES:
        q = q.replace(code, c)
    return q.translate(str.maketrans(UPPER, LOWER))


def percent_decode(s: Column) -> Column:
    return F.try_url_decode(s)


def plain_words(text: Column) -> Column:
    """The older cleaner: punctuation dropped wherever it is, lower case, split at white space."""
    return F.filter(F.split(ascii_lower(F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")), r"\s+"), lambda w: w != "")


def query_of_file(name: Column) -> Column:
    """The query that a result file's name stands for: its letters and digits, word + word."""
    return F.array_join(F.filter(F.split(F.regexp_replace(name, "[^a-zA-Z0-9 ]", ""), " +"), lambda w: w != ""), " + ")


def any_of(query: Column) -> Column:
    """The query that asks for any of the words instead of all."""
    return F.replace(query, F.lit("+"), F.lit("|"))


def integer_sqrt(n: Column) -> Column:
    """floor(sqrt(n)) of a non-negative bigint, exact beyond what a double holds."""
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.when(r * r > n, r - 1).when((r + 1) * (r + 1) <= n, r + 1).otherwise(r)


def bit_width(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def round_up(n: Column, to: int) -> Column:
    """The least multiple of `to` that isn't below n."""
    return F.floor((n + (to - 1)) / to).cast("long") * to
