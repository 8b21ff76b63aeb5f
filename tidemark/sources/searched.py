"""Landed pages by what their searches have asked, so that a run opens only files that may hold its postings.

Pages are landed as Parquet in folders by what a search has asked and by the newest posting it has brought.  These are
partition columns: filters on them are settled when a scan is planned, from the names of the folders, and files that can't
have a row are never opened.  Queries that agree in both share a folder, named by the first of them, so that there are
no more folders than kinds of searches and days, however many queries are landed.

Filters are not pushed into a Python data source, which would know no more than the folders say: of Spark 4.1's, the reader
keeps the filters of one plan for all others that are made from the same DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import reference_data as ref
from tidemark.operators import html as H
from tidemark.plans import spec as SP
from tidemark.sources import landing

#: What a search asks, one column each: codes joined by commas, or ANY where it does not ask.
ASKED = ("work_type", "experience", "job_type", "company", "geo", "easy_apply")
ANY = "any"
SCHEMA = f"{landing.PAGE_SCHEMA}, " + ", ".join(f"{c} string" for c in ASKED) + ", newest string, query int"
#: Where no posting has a date there may be any.
UNDATED = "9999"
_CODES = {"work_type": ("workType", SP.WORK_TYPE), "experience": ("experienceLevel", SP.EXPERIENCE), "job_type": ("jobType", SP.JOB_TYPE)}


def _codes(asked: dict) -> dict[str, list[str]]:
    """The codes that a search or a spec asks for, by column; none where it does not ask."""
    out = {c: sorted(table[v] for v in asked.get(name) or () if v in table) for c, (name, table) in _CODES.items()}
    out["company"] = sorted(asked.get("companies") or ())
    out["geo"] = sorted(asked.get("geoIds") or ([asked["geoId"]] if asked.get("geoId") else []))
    out["easy_apply"] = ["true"] if asked.get("easyApply") else []
    return out


def searches_table(spark: SparkSession, searches: list[dict]) -> DataFrame:
    """(query_ordinal, what it asks) of the searches of a run, in their order."""
    rows = [(i, *(",".join(codes) or ANY for codes in _codes(s).values())) for i, s in enumerate(searches)]
    return spark.createDataFrame(rows, "query_ordinal int, " + ", ".join(f"{c} string" for c in ASKED))


def land(pages: DataFrame, searches: DataFrame, path: str) -> None:
    """Add pages to a folder, with what their searches ask.

    pages: columns of :data:`landing.PAGE_SCHEMA`; searches: (query_ordinal, columns of ASKED).  A page whose search is not
    known has asked for nothing.  A query's pages are sorted by their place; a folder with very many is split by Spark.
    """
    days = F.transform(F.regexp_extract_all("html", F.lit(H.STAMP), F.lit(1)), lambda s: F.left(s, F.lit(10)))
    # Of a query, not of a page: one that is undated hides what the others hold.
    newest = pages.groupBy("query_ordinal").agg(F.max(F.coalesce(F.array_max(days), F.lit(UNDATED))).alias("newest"))
    alike = (*ASKED, "newest")
    # A row for each query; html meets them once.
    queries = newest.join(searches.select("query_ordinal", *ASKED), "query_ordinal", "left").fillna(ANY, list(ASKED))
    first = queries.groupBy(*alike).agg(F.min(F.coalesce("query_ordinal", F.lit(-1))).alias("query"))
    queries = queries.join(first, list(alike)).withColumnRenamed("query_ordinal", "_query")
    rows = pages.join(queries, F.col("query_ordinal").eqNullSafe(F.col("_query"))).select(*_names(SCHEMA))
    by = (*alike, "query")
    rows.hint("rebalance", *by).sortWithinPartitions(*by, "query_ordinal", "start").write.mode("append").partitionBy(*by).parquet(path)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def pages(spark: SparkSession, path: str) -> DataFrame:
    """All landed pages, with what their searches ask."""
    return spark.read.schema(SCHEMA).parquet(path)


def _may_hold(column: str, codes: list[str]) -> Column:
    """Whether a search that asked for this can have brought a posting with one of the codes."""
    return (F.col(column) == ANY) | F.arrays_overlap(F.split(column, ","), F.array(*map(F.lit, codes)))


def for_search(spark: SparkSession, path: str, asked: dict, now: str, seconds: int | None = None) -> DataFrame:
    """The landed pages that may hold postings for what is asked (a search, or :func:`spec.asked_of`); other files are not opened.

    A page may, if its search has not asked about a matter, or for one of the values asked for.  What a page says of its
    postings is not looked at: hold them to the same with :func:`postings.as_searched`, as a run does with pages that
    are not its own.  seconds: how old a posting may be, if ``datePosted`` does not say.
    """
    rows, seconds = pages(spark, path), ref.DATE_POSTED_SECONDS.get(asked.get("datePosted") or "", seconds)
    for column, codes in _codes(asked).items():
        if codes:
            rows = rows.where(_may_hold(column, codes))
    if seconds:
        oldest = F.to_timestamp(F.lit(now)) - F.make_interval(secs=F.lit(seconds))
        rows = rows.where(F.col("newest") >= F.date_format(oldest, "yyyy-MM-dd"))
    return rows.select(*_names(landing.PAGE_SCHEMA))
