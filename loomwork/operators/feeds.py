"""Items of feeds and their dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an item is, where its date and body stand, and how much of each text is kept.
ITEM = r"(?is)<(?:item|entry)(?:\s|>).*?</(?:item|entry)>"
DATE_TAGS = ("pubDate", "updated", "published", "dc:date")
BODY_TAGS = ("description", "summary", "content", "content:encoded")
TITLE_CHARS, BODY_CHARS = 300, 500
#: Date formats that are tried in turn; a weekday before a date is dropped.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy", "yyyy-MM-dd HH:mm:ss")


def plain(text: Column) -> Column:
    """A text without CDATA marks, tags and runs of space, with the five entities decoded."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tag_text(block: Column, tag: str) -> Column:
    """What the first ``tag`` of a block holds, as plain text; empty without one."""
    return plain(F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def first_filled(block: Column, tags: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(tag_text(block, t), F.lit("")) for t in tags], F.lit(""))


def link_of(block: Column) -> Column:
    """The link of an item: an alternate one or one without a kind, else one that is not the feed's own, else any, else a link or id that is an address."""
    tags = F.regexp_extract_all(block, F.lit(r"(?i)<link\b([^>]*)/?>"), F.lit(1))
    kinds = F.transform(
        tags,
        lambda t: F.struct(F.regexp_extract(t, r"""(?i)\bhref=["']([^"']+)["']""", 1).alias("href"), F.lower(F.regexp_extract(t, r"""(?i)\brel=["']([^"']+)["']""", 1)).alias("rel")),
    )
    linked = F.filter(kinds, lambda k: k["href"] != "")
    wanted = [F.get(F.filter(linked, test), F.lit(0))["href"] for test in (lambda k: k["rel"].isin("", "alternate"), lambda k: k["rel"] != "self", lambda k: F.lit(True))]
    address = [F.when(F.startswith(tag_text(block, t), F.lit("http")), tag_text(block, t)) for t in ("link", "guid")]
    return F.coalesce(*wanted, *address, F.lit(""))


def date_of(text: Column) -> Column:
    """A date as a timestamp in the first format that fits, or null."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS])


def feed_items(feeds: DataFrame) -> DataFrame:
    """``feed, k, title, link, ts, day, shown, description`` of each item with a title of ``feeds(feed, url, xml)``.

    ``day`` is the ISO day and ``shown`` the month and day; all are empty
    without a date.  An item without a link has the feed's.
    """
    blocks = feeds.select("feed", "url", F.posexplode(F.regexp_extract_all("xml", F.lit(ITEM), F.lit(0))).alias("k", "block"))
    block = F.col("block")
    rows = blocks.select(
        "feed", "k", F.substr(tag_text(block, "title"), F.lit(1), F.lit(TITLE_CHARS)).alias("title"), F.coalesce(F.nullif(link_of(block), F.lit("")), F.col("url")).alias("link"),
        date_of(first_filled(block, DATE_TAGS)).alias("ts"), F.substr(first_filled(block, BODY_TAGS), F.lit(1), F.lit(BODY_CHARS)).alias("description"),
    )
    day, shown = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("")), F.coalesce(F.date_format("ts", "MMM d"), F.lit(""))
    return rows.where("title <> ''").select("feed", "k", "title", "link", "ts", day.alias("day"), shown.alias("shown"), "description")


def newest(items: DataFrame, most: int) -> DataFrame:
    """Items from the newest; undated ones last, ties by feed and place."""
    return items.orderBy(F.desc_nulls_last("ts"), "feed", "k").limit(most)


def section_counts(items: DataFrame, heat: int = 70) -> DataFrame:
    """``items(section, source, day, heat)``: ``section, n, sources, newest, important``."""
    return items.groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.max("day").alias("newest"), F.count(F.when(F.col("heat") >= heat, 1)).alias("important")
    )
