"""Shapes of results: items of markup, folders, presence, freshness, nearest lines, pages of rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.search import line_pattern
from loomwork.sources.tables import lines

#: Hours of a window literal's unit.
HOURS = {"h": 1, "d": 24, "w": 168, "m": 720}


def window_hours(text: str) -> int:
    """``36h``, ``7d``, ``2w`` or ``1m`` in hours; anything else is 0."""
    found = re.fullmatch(r"(\d+)([hdwm])", text)
    return int(found[1]) * HOURS[found[2]] if found else 0


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**`` crosses folders, ``*`` and ``?`` do not, ``{a,b}`` is a choice."""
    out, depth, k = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            out, k = out + ".*", k + 1
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.sub(r"([\\.^$|+()\[\]{}])", r"\\\1", c)
        k += 1
    return f"^{out}$" if not depth else "^" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", glob) + "$"


def url_path(url: Column) -> Column:
    """Host and path of an address, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")


def folder_counts(paths: DataFrame, depth: int) -> DataFrame:
    """``paths(path)``: ``folder, n`` under the first ``depth`` parts of each path."""
    folder = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    return paths.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def row_page(df: DataFrame, order: list, size: int, page: int) -> DataFrame:
    """One page of rows in a total order."""
    return df.orderBy(*order).offset(size * (page - 1)).limit(size)


def links(pages: DataFrame) -> DataFrame:
    """``page_id, k, link, title``: the first item for each link of a page, in order."""
    one = r'(?is)<a href="([^"]*)"[^>]*>(.*?)</a>'
    pair = F.arrays_zip(F.regexp_extract_all("html", F.lit(one), F.lit(1)).alias("link"), F.regexp_extract_all("html", F.lit(one), F.lit(2)).alias("title"))
    items = pages.select("page_id", F.posexplode(pair).alias("k", "item")).select("page_id", "k", "item.link", "item.title")
    first = items.groupBy("page_id", "link").agg(F.min(F.struct("k", "title")).alias("first"))
    return first.select("page_id", "first.k", "link", "first.title")


def presence(rows: DataFrame, owners: tuple[str, ...]) -> DataFrame:
    """``rows(owner, item, value)``: ``item, present_in, missing_in, conflict`` over the given owners."""
    own = rows.groupBy("item").agg(F.collect_set("owner").alias("have"), F.min("value").alias("low"), F.max("value").alias("high"))
    every = F.array(*map(F.lit, sorted(owners)))
    present = F.array_join(F.filter(every, lambda o: F.array_contains("have", o)), ",")
    missing = F.array_join(F.filter(every, lambda o: ~F.array_contains("have", o)), ",")
    return own.select("item", present.alias("present_in"), missing.alias("missing_in"), (F.col("low") < F.col("high")).alias("conflict"))


def freshness(items: DataFrame, now: str, window: str) -> DataFrame:
    """``items(feed, ts)``: ``feed, entries, dated, undated, recent, newest, mode``."""
    since = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(window_hours(window)))
    one = lambda c: F.count(F.when(c, 1))
    each = items.groupBy("feed").agg(
        F.count(F.lit(1)).alias("entries"), F.count("ts").alias("dated"), one(F.col("ts").isNull()).alias("undated"),
        one(F.col("ts") >= since).alias("recent"), F.max("ts").alias("newest"),
    )
    return each.withColumn("mode", F.when(F.col("dated") == 0, "undated").when(F.col("recent") > 0, "recent").otherwise("stale"))


def nearest_lines(docs: DataFrame, hint: str, pattern: str, reach: int = 5) -> DataFrame:
    """``doc_id, hint_line, line``: for each line with ``hint``, the line with ``pattern`` nearest to it; above wins ties.

    Hints ask for each line in reach, so this is an equi-join.
    """
    all_lines = lines(docs)
    asked = all_lines.where(F.col("content").rlike(line_pattern(hint))).select("doc_id", F.col("line").alias("hint_line"))
    asked = asked.withColumn("by", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("line", F.col("hint_line") + F.col("by"))
    hits = all_lines.where(F.col("content").rlike(line_pattern(pattern))).select("doc_id", "line")
    best = asked.join(hits, ["doc_id", "line"]).groupBy("doc_id", "hint_line").agg(F.min(F.struct(F.abs("by").alias("a"), "line")).alias("best"))
    return best.select("doc_id", "hint_line", "best.line")


def carried(docs: DataFrame, header: str) -> DataFrame:
    """``doc_id, line, section``: the nearest line at or above that matches ``header``; null before the first."""
    mark = F.when(F.col("content").rlike(header), F.col("line"))
    above = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines(docs).select("doc_id", "line", F.max(mark).over(above).alias("section"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line, shown``: each line behind its number."""
    return lines(docs).select("doc_id", "line", F.concat(F.col("line").cast("string"), F.lit(": "), F.col("content")).alias("shown"))
