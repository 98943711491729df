"""The crawl as rounds of joins: frontier -> pages -> links -> admission -> frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .html import page_links, parse_pages
from .robots import allowed
from .store import numbered, stored

LEVEL_CAP, PAGE_LINKS, SAME_DOMAIN_LINKS, OLD_QUEUE = 500_000, 8, 3, 500


def discovered(parsed: DataFrame) -> DataFrame:
    """(page_id, no, url): the links of parsed pages that the crawler keeps, joined to their page, without a last slash."""
    kept = page_links(parsed).where(U.keep_link(F.col("url")))
    joined = kept.withColumn("url", U.drop_last_slash(U.url_join(F.col("page_url"), F.col("url"))))
    return joined.where(U.sendable(F.col("url"))).select("page_id", "no", "url")


def by_peer(urls: DataFrame, peers: int) -> DataFrame:
    """urls hash-partitioned to peers by what makes them the same URL."""
    return urls.repartition(peers, U.url_key(F.col("url")))


def distinct_urls(urls: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each URL in the given order; which case, protocol or www it had doesn't matter. Taken by an
    aggregate, so each task sends a URL once."""
    row = F.struct(*(F.col(c) for c in urls.columns))
    return urls.groupBy(U.url_key(F.col("url")).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def unseen(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """urls that visited (url) doesn't hold."""
    return urls.withColumn("_key", U.url_key(F.col("url"))).join(visited.select(U.url_key(F.col("url")).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def capped_by_host(urls: DataFrame, order: list[Column], busy: DataFrame | None = None) -> DataFrame:
    """At most so many rows of a host as its cap leaves beside those under way in busy (host, n)."""
    hosted = urls.withColumn("_host", U.hostname(F.col("url")))
    place = F.row_number().over(Window.partitionBy("_host").orderBy(*order))
    room = U.host_cap(F.col("_host"))
    if busy is not None:
        hosted = hosted.join(busy.select(F.col("host").alias("_host"), F.col("n").alias("_busy")), "_host", "left")
        room = room - F.coalesce("_busy", F.lit(0))
    # no host has more room than the largest cap: a constant that each task can cut by before the shuffle
    return hosted.withColumn("_place", place).where(F.col("_place") <= U.MOST_SLOTS).where(F.col("_place") <= room).select(*urls.columns)


def prioritized(urls: DataFrame, seq: Column) -> DataFrame:
    """frontier rows (url, priority, seq) of the URLs that have a priority."""
    return urls.select("url", U.frontier_priority(F.col("url")).alias("priority"), seq.cast("long").alias("seq")).where("priority >= 0")


def capped_by_level(frontier: DataFrame, cap: int = LEVEL_CAP) -> DataFrame:
    """The first `cap` URLs of each priority."""
    return numbered(frontier, [F.col("priority")], [F.asc("seq"), F.asc("url")], "_place").where(F.col("_place") <= cap).drop("_place")


def pop(frontier: DataFrame, n: int, chance: float | None = None, seed: int = 0) -> DataFrame:
    """The n next URLs: by priority from the top, then in turn. With a chance, each URL is passed over once with 1 - chance,
    by a draw that the seed and the URL fix, as a lottery between levels."""
    keys = [F.desc("priority"), F.asc("seq"), F.asc("url")]
    if chance is not None:
        draw = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))
        keys.insert(0, (draw >= chance).asc())
    return frontier.orderBy(*keys).limit(n)


def old_link_limits(links: DataFrame, queued: int = 0, per_page: int = PAGE_LINKS, per_domain: int = SAME_DOMAIN_LINKS) -> DataFrame:
    """The older crawler's pick of links (page_id, page_url, no, url): of those its policy likes, at most 3 of the page's own
    domain and 8 in all a page, in page order; none while the queue is above 2000."""
    host = lambda c: F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    own = host(F.col("url")) == host(F.col("page_url"))
    liked = links.where(U.old_policy(F.col("url")) & (F.lit(queued) <= 2000)).withColumn("_own", own)
    liked = liked.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "_own").orderBy("no"))).where(~F.col("_own") | (F.col("_n") <= per_domain))
    return liked.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("no"))).where(F.col("_n") <= per_page).drop("_n", "_own")


def in_turn(urls: DataFrame, order: list[Column], after: DataFrame) -> DataFrame:
    """urls with seq: their turn by the given order, behind all of after (seq)."""
    last = after.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    return numbered(urls, [], order, "_place").select(*urls.columns, (F.col("_place") + last).alias("seq"))


def crawl_round(frontier: DataFrame, visited: DataFrame, pages: DataFrame, robots: DataFrame, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed pages, frontier, newly admitted (url)) of one round: the best of the frontier are looked up in pages (page_id, url,
    html), parsed, and their links admitted by host cap, visited set and robots. URLs that wait in the frontier hold their host's
    slots until they are taken; new ones queue up behind the older ones, in the order of their pages and links."""
    taken = pop(frontier, batch)
    parsed = parse_pages(pages.join(taken.select("url"), "url", "left_semi"))
    rest = frontier.join(taken.select("url"), "url", "left_anti")
    busy = rest.groupBy(U.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    order = [F.col("page_id"), F.col("no")]
    links = distinct_urls(discovered(parsed), order)
    fresh = allowed(unseen(links, visited), robots).where("allowed").drop("allowed")
    admitted = in_turn(capped_by_host(fresh, order, busy), order, frontier)
    return parsed, capped_by_level(rest.unionByName(prioritized(admitted, F.col("seq")))), admitted.select("url")


def crawl(seeds: DataFrame, pages: DataFrame, robots: DataFrame, rounds: int, batch: int, store=stored, on_round=None, stop=None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(page_id, round) of the pages met from seeds (url). store(df) cuts the lineage after each round: write it and
    read it back, or checkpoint(). on_round(k, parsed, frontier, visited) is called after each round with what was stored, as a hook
    for an index or a saved state; stop() is asked before each round and ends the crawl after whole rounds only. state is a
    (frontier, visited) to go on from instead of seeds."""
    empty = seeds.select(F.lit(0).cast("long").alias("seq")).limit(0)
    frontier, visited = state or (store(prioritized(in_turn(seeds.select("url"), [F.col("url")], empty), F.col("seq"))), seeds.select("url"))
    met = seeds.sparkSession.createDataFrame([], "page_id long, round int")
    for k in range(rounds):
        if stop is not None and stop():
            break
        parsed, frontier, new = map(store, crawl_round(frontier, visited, pages, robots, batch))
        visited = visited.unionByName(new)  # a round writes only what it adds
        met = met.unionByName(parsed.select("page_id", F.lit(k).alias("round")))
        if on_round is not None:
            on_round(k, parsed, frontier, visited)
    return met


def old_crawl(seeds: DataFrame, pages: DataFrame, rounds: int, batch: int, store=stored, queue_cap: int = OLD_QUEUE) -> DataFrame:
    """(page_id, round) of the older crawler's loop: a queue in turn without priorities, each URL once, its link limits by page, and
    no more than queue_cap URLs waiting."""
    empty = seeds.select(F.lit(0).cast("long").alias("seq")).limit(0)
    queue, seen = store(in_turn(seeds.select("url"), [F.col("url")], empty)), seeds.select("url")
    met = seeds.sparkSession.createDataFrame([], "page_id long, round int")
    for k in range(rounds):
        taken = queue.orderBy("seq").limit(batch)
        parsed = store(parse_pages(pages.join(taken.select("url"), "url", "left_semi")))
        rest = queue.join(taken.select("url"), "url", "left_anti")
        links = page_links(parsed).withColumn("url", U.drop_last_slash(U.url_join("page_url", "url")))
        order = [F.col("page_id"), F.col("no")]
        fresh = unseen(distinct_urls(old_link_limits(links).select("page_id", "no", "url"), order), seen)
        after = store(rest.select("url", "seq").unionByName(in_turn(fresh, order, queue).select("url", "seq")).orderBy("seq").limit(queue_cap))
        seen = seen.unionByName(store(after.join(rest.select("url"), "url", "left_anti").select("url")))
        queue, met = after, met.unionByName(parsed.select("page_id", F.lit(k).alias("round")))
    return met
