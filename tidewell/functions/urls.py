"""URL functions, filters and scores as Columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ascii_lower, contains

#: Tokens that bar a link. Those of one letter or with a dot can never equal a token and are kept for the record.
BARRED = frozenset(
    """
    account admin buy cart checkout login order password payment profile purchase register shop signin signup
    archive assets cache cdn content media page porn static q
    alipay allegro baidu bilibili coccoc daum dmm goo.ne.jp interia kakao line mail.ru mercadolibre mixi naver
    nicovideo onet pixiv qq qzone rambler renren sina sohu taobao tencent tudou vk wechat weibo weixin wp
    yahoo.co.jp yandex youku
    ae ar bg bn br bs ca cl cn cs cy da de el eo es et eu fa fi fr gl he hi hk hr hu hy il in ir is it ja jp ka kk
    km kn ko kr ky lo lt lv mk ml mn mr ms mt mx my ne nl no pe ph pk pl pt ro ru sa sg si sk sl sq sr sv sw ta te
    th tl tr tw ur uz ve vi vn za zh zu
    """.split()
)
MAX_LINK_BYTES = 400
SIGN_IN = ("login", "signin", "signup")
TRUSTED = ("bbc.com", "cnn.com", "en.wikipedia.org", "github.com", "nytimes.com")
MOST_SLOTS = 40
GOOD_TLD = ("com", "edu", "gov", "net", "org")
SCORED_TLD = (".com", ".edu", ".gov", ".org")


def strip_prefix(url: Column) -> Column:
    """Without http:// or https://, then without www."""
    return F.regexp_replace(url, r"^(https?://)?(www\.)?", "")


def url_key(url: Column) -> Column:
    """What makes two URLs the same one."""
    return ascii_lower(strip_prefix(url))


def hostname(url: Column) -> Column:
    """Up to the first / or #, without protocol and www. A query isn't cut off."""
    return F.regexp_extract(url, r"(?s)^(?:https?://)?(?:www\.)?([^/#]*)", 1)


def base_root(url: Column) -> Column:
    """Up to the third slash."""
    return F.substring_index(url, "/", 3)


def base_path(url: Column) -> Column:
    """From the third slash on, else /."""
    rest = F.regexp_extract(url, "(?s)^[^/]*/[^/]*/[^/]*(/.*)$", 1)
    return F.when(rest == "", "/").otherwise(rest)


def drop_last_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def split_url(url: Column) -> Column:
    """struct(service, host, port, path); without a colon all is path and host."""
    p = r"(?s)^([^:]*):/?/?([^/:]*)(?::([^/]*))?/?(.*)$"
    part = lambda k: F.regexp_extract(url, p, k)
    has = F.instr(url, ":") > 0
    return F.struct(
        F.when(has, part(1)).otherwise(url).alias("service"), F.when(has, part(2)).otherwise(F.lit("")).alias("host"),
        F.when(has, part(3)).otherwise(F.lit("")).alias("port"), F.when(has, part(4)).otherwise(F.lit("")).alias("path"),
    )


def fetchable(url: Column) -> Column:
    """Whether the host of a split URL starts with a letter or digit."""
    return split_url(url).getField("host").rlike("^[A-Za-z0-9]")


def tidy_path(path: str) -> str:
    """Takes out /./ and /../ as they come up from the left, then one full stop at the end."""
    if "/." not in path and not path.endswith("."):
        return path
    out = ""
    for part in re.split("(?<=/)", path):
        out += part
        if out.endswith("/../"):
            out = out[:-4]
            out = out[: out.rfind("/") + 1] or "/"
        elif out.endswith("/./"):
            out = out[:-2]
    return out[:-1] if out.endswith(".") else out


def join(base: str, link: str) -> str:
    """The URL that a link on the page base leads to."""
    if link.startswith(("http://", "https://")):
        return link
    if link.startswith("//"):
        head, slash, _ = base.partition("/")
        return (head if slash else "http://") + link
    parts = base.split("/", 3)
    root = "/".join(parts[:3])
    if link.startswith("/"):
        return root + tidy_path(link)
    path = "/" + parts[3] if len(parts) > 3 else "/"
    return root + tidy_path(path[: path.rfind("/") + 1] + link)


@F.arrow_udf(T.StringType())
def url_join(base: pa.Array, link: pa.Array) -> pa.Array:
    """join() over columns; null if either side is."""
    return pa.array((None if b is None or x is None else join(b, x) for b, x in ((b.as_py(), x.as_py()) for b, x in zip(base, link, strict=True))), pa.string())


def barred(url: Column) -> Column:
    """Whether the crawler refuses a link: empty, a print view, a URL inside a URL, a foreign encyclopedia, or a listed token."""
    tokens = F.filter(F.split(url, r"[/.#?&=_:\-]"), lambda t: F.length(t) > 1)
    inner = F.substring(url, F.lit(2), F.length(url) - 2)
    return (
        (url == "")
        | url.endswith("print.html")
        | (F.instr(inner, "http") > 0)
        | (contains(url, "wikipedia") & ~url.startswith("https://en.wikipedia"))
        | F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in sorted(BARRED))))
    )


def keep_link(link: Column) -> Column:
    """The crawler's test of a link as written, before it is joined to its page."""
    return (link != "") & ~link.startswith("#") & ~barred(link) & (F.octet_length(link) <= MAX_LINK_BYTES)


def sendable(url: Column) -> Column:
    return ~url.startswith("http://")


def slashes(url: Column) -> Column:
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))


def frontier_priority(url: Column) -> Column:
    """-1 refuses; else a point each for a host of at most 25 bytes, a known top-level domain, and at most 2 slashes beyond
    the protocol's."""
    host = hostname(url)
    tld = F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise(F.substring(host, 2, 1 << 30))
    short = F.when(F.octet_length(host) <= 25, 1).otherwise(0)
    sign_in = F.lit(False)
    for w in SIGN_IN:
        sign_in = sign_in | (F.instr(url, w) > 0)
    extra = slashes(url) - 2
    known = F.when(tld.isin(*GOOD_TLD), 1).otherwise(0)
    shallow = F.when(extra <= 2, 1).otherwise(0)
    return F.when(sign_in, -1).when(tld == "", short).when((extra < 0) | (extra > 7), -1).otherwise(short + known + shallow).cast("int")


def host_cap(host: Column) -> Column:
    """How many URLs of a host may be under way at once."""
    return F.when(host.isin(*TRUSTED), MOST_SLOTS).otherwise(5)


def old_policy(url: Column) -> Column:
    """The older crawler's test: no media, no session pages, four known domains, fewer than 5 path segments, no API hosts."""
    host = ascii_lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#;]*)", 1)
    low, inner = ascii_lower(path), F.btrim(path, F.lit("/"))
    depth = F.when(inner == "", 0).otherwise(F.size(F.split(inner, "/")))
    return (
        ~low.rlike(r"\.(gif|jpe?g|mp[34]|pdf|png|zip)$")
        & ~low.rlike("/(admin|login|logout|signup)")
        & host.rlike(r"\.(com|edu|gov|org)$")
        & (depth < 5)
        & ~host.rlike(r"api\.|cdn\.|drive\.google\.com")
    )


def refused(url: Column, strict: bool = False) -> Column:
    """URLs that ranking rules out. url in lower case."""
    out = url.rlike(r"\.(jpe?g|png|svg)$")
    for w in ("download", "sitemap", "updatestar", "whatlinkshere"):
        out = out | contains(url, w, strict)
    return out


def url_score(url: Column, words: list[str], strict: bool = False) -> Column:
    """The URL's part of a page's score for the query's words. strict counts matches at the URL's very end too."""
    u = ascii_lower(url)
    either = lambda parts: reduce(or_, (contains(u, p, strict) for p in parts))
    flag = lambda cond, points: F.when(cond, float(points)).otherwise(0.0)
    score = flag(either(TRUSTED), 78) + flag(either(SCORED_TLD), 75) + flag(contains(u, "?", strict), -55)
    score = score - F.greatest(slashes(u) - 2, F.lit(0)).cast("double") - F.floor(F.sqrt(F.octet_length(u).cast("double"))).cast("double") * 3.0
    place = [F.instr(u, w) - 1 for w in words]
    count, order = F.lit(0), F.lit(0)
    for i, p in enumerate(place):
        rank = F.lit(1)
        for q in place[:i]:
            rank = rank + F.when((q >= 0) & (q < p), 1).otherwise(0)
        count = count + F.when(p >= 0, 1).otherwise(0)
        order = F.greatest(order, F.when(p >= 0, rank).otherwise(0))
    score = score + (order * count * 800).cast("double")
    return F.when(url.isNull(), 0.0).when(refused(u, strict), -1e20).otherwise(score)
