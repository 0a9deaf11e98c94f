"""Boilerplate lines by their frequency within a site. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: A line is boilerplate if more than this share of the pages of its host have it, on at least MIN_PAGES pages.
#: A site with page templates of its sections shows the menu and footer of each on a part of its pages only;
#: this finds them with up to a hundred templates of equal use, and leaves what a few articles of a large site share.
RATIO = 0.01
MIN_PAGES = 3

#: Elements whose content is no text, tags that end a line, and other tags. Fixed values.
NO_TEXT = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|table|nav|article|section|header|footer|title|body|html)\b[^>]*>"
TAGS = r"(?s)<[^>]*>"
BLANK = r"[\x20\x09\x0B-\x0D]+"


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def text_lines(html: Column) -> Column:
    """The lines of a page's text: blanks squeezed, empty lines left out."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), NO_TEXT, "\n"), BREAKS, "\n"), TAGS, "")
    lines = F.transform(F.split(flat, "\n"), lambda s: F.trim(F.regexp_replace(s, BLANK, " ")))
    return F.filter(lines, lambda s: s != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: (page_id, host, n_lines, n_dropped, text), the text without boilerplate lines.

    Pages are counted by row, so repeated rows are pages of their own with equal results. A
    null page_id stays null; null url or html are empty; pages without a host form one group
    of that name. Other columns are not read; an empty table gives no rows.

    A line is counted once a page, before the shuffle as far as a task can. Hot hosts and
    lines are keys of an aggregate, or the small side of joins whose hot partitions adaptive
    execution splits; only the digests of lines travel there. Lines meet again by page.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), text_lines(F.col("html")).alias("lines"))
    # a key for each row that stays the same in every read, and lines with their digests
    stored = cut(source.withColumn("row", F.monotonically_increasing_id()).withColumn("keys", F.transform("lines", lambda s: F.unhex(F.md5(s)))))
    sizes = stored.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = stored.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    common = counted.where(F.col("n") >= min_pages).join(sizes, "host").where(F.col("n") > F.col("pages") * ratio).select("host", "key")
    common = cut(common)
    hit = stored.select("row", "host", F.explode(F.array_distinct("keys")).alias("key")).join(common, ["host", "key"], "left_semi")
    dropped = hit.groupBy("row").agg(F.collect_set("key").alias("bad"))  # bounded by the lines of one page
    out = stored.join(dropped, "row", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<binary>")))
    kept = F.filter("lines", lambda s, i: ~F.array_contains(F.col("bad"), F.col("keys")[i]))
    out = out.withColumn("kept", kept)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
