"""Line dedup by site-relative frequency.

Pages are grouped by host.  For each line the number of the host's pages that contain it is divided
by the host's page total; lines above a ratio are boilerplate of that site and are dropped.

A line of a host is known by the 128-bit MD5 of host and line, so texts don't move to be counted.  A
page contributes each of its lines once.  Pages are counted as distinct pairs of line and page, which go
by both, and only their sums go by line or host, so neither with a third of all rows is a burden.  Only lines over the ratio are joined back; the texts move
once, to meet the places of their dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE_CLASS, stored, text_of

#: Tags that end a line of a page.
BLOCK_TAGS = (
    "p div section article header footer nav aside main form ul ol li dl dt dd table thead tbody tr td th "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr br html head body title option"
).split()


def host_of(url: str | Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def page_lines(html: str | Column) -> Column:
    """The html as lines of text: comments, scripts and styles go, block tags end a line."""
    text = F.regexp_replace(text_of(html), r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>", "")
    text = F.regexp_replace(text, r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")(?:[\s/][^>]*)?>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def site_line_dedup(
    pages: DataFrame,
    id_col: str = "page_id",
    host: Column | None = None,
    text: Column | None = None,
    ratio: float = 0.2,
    min_pages: int = 3,
) -> DataFrame:
    """One row per page: id, host, n_lines, n_dropped, text.

    Lines are trimmed, inner white space becomes one space, empty lines do not count.  A line goes
    when at least min_pages pages of the host have it and they are more than ratio of the host's
    pages.  A page is an id: rows that repeat one are one page in both numbers, whatever they hold, and are
    returned as often as they come; rows with a null id count as no page but lose the same lines.  Null html
    is an empty text, a null or malformed URL gives the host ''.  An empty table gives an empty result, other
    columns are not read.
    """
    host = host_of("url") if host is None else host
    text = page_lines("html") if text is None else text
    squeezed = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE_CLASS + "+", " ")))
    rows = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), F.filter(squeezed, lambda x: x != "").alias("lines")
    )
    key = lambda x: F.unhex(F.md5(F.concat("host", F.lit("\n"), x)))
    rows = stored(rows.select("*", F.transform("lines", key).alias("keys"), F.xxhash64("host", "lines").alias("row")), "lines")
    # The sides without hot keys are stored, so that Spark broadcasts them if they are small and else splits the other side.
    totals = stored(rows.groupBy("host").agg(F.count_distinct("id").alias("host_pages")), "hosts")
    seen = (
        rows.select("id", "host", F.explode(F.array_distinct("keys")).alias("key"))
        .groupBy("key", "host")
        .agg(F.count_distinct("id").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    common = stored(seen.join(totals, "host").where(F.col("pages") > ratio * F.col("host_pages")).select("key"), "common")
    each = rows.select("id", "row", F.posexplode("keys").alias("idx", "key"))
    # A repeated row gives the same places again; the set takes them once.
    gone = each.join(common, "key").groupBy("id", "row").agg(F.collect_set("idx").alias("gone"))
    gone = gone.withColumnsRenamed({"id": "gone_id", "row": "gone_row"})
    match = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row"))
    judged = rows.drop("keys").join(gone, match, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )
