"""robots.txt as a table of rules, and the decision per URL as a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import strip_prefix


def parse_robots(files: DataFrame) -> DataFrame:
    """(host, rule_no, allow, pattern) of files (host, text): the Allow and Disallow lines with a value that stand under
    `User-agent: *`, up to the next User-agent line of another name."""
    lines = files.select("host", F.posexplode(F.split("text", "[\\r\\n]+")).alias("no", "line"))
    name, value = F.substring_index("line", ":", 1), F.regexp_extract("line", "(?s)^[^:]*:.(.*)$", 1)
    agent = F.when(name.startswith("User-agent"), F.col("line") == "User-agent: *")
    by = Window.partitionBy("host").orderBy("no")
    ours = lines.withColumn("ours", F.last(agent, ignorenulls=True).over(by))
    rules = ours.where(F.col("ours") & name.isin("Allow", "Disallow") & (value != ""))
    return rules.select("host", F.row_number().over(by).alias("rule_no"), (name == "Allow").alias("allow"), value.alias("pattern"))


def route(url: Column) -> Column:
    """From the first slash after the protocol on; null without one, or if it is the last character."""
    rest = F.regexp_extract(url, "(?s)^(?:https?://)?[^/]*(/.+)$", 1)
    return F.when(rest != "", rest)


def allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with `allowed`: the last rule of the URL's host that is its route, or a whole leading part of it, decides; else yes.
    Each URL keeps its row: its host's rules are folded before the join, so the join neither multiplies nor needs a second shuffle."""
    host = F.substring_index(strip_prefix(F.col(url_col)), "/", 1)
    per_host = rules.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list(F.struct("rule_no", "allow", "pattern"))).alias("_rules"))
    joined = urls.withColumn("_host", host).join(per_host, "_host", "left").withColumn("_route", route(F.col(url_col)))
    fits = lambda r: (F.col("_route") == r.getField("pattern")) | F.startswith(F.col("_route"), F.concat(r.getField("pattern"), F.lit("/")))
    last = F.try_element_at(F.filter("_rules", fits), F.lit(-1)).getField("allow")
    return joined.withColumn("allowed", F.coalesce(last, F.lit(True))).select(*urls.columns, "allowed")
