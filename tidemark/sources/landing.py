"""Landed pages as sources: what a crawler has stored, read as tables.

The crawl itself is not part of the library; pages come as parquet, JSON or any other Spark source
with the columns named here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.operators import html as H

PAGE_SCHEMA = "query_ordinal int, start int, http_status int, country_hint string, html string"
DETAIL_SCHEMA = "sourceJobId string, html string"
COMPANY_SCHEMA = "slug string, html string"
#: Lists of postings like another one; seed_id is the source's id of that one.
RELATED_SCHEMA = "seed_id string, html string"
#: Statuses that a crawler tries again, and that end a query.
RETRIED = (429, 502, 503, 504, 520, 521, 522, 523, 524, 590)
HARD_CAP = 1000
RELATED_ORDINAL = 2**31 - 1


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A landed table with a fixed schema, so that no file is opened to infer one."""
    return spark.read.format(kind).schema(schema).load(path)


def usable(pages: DataFrame) -> DataFrame:
    """Pages below the hard cap, up to the first failed one of each query; a 400 ends a query like an empty page."""
    pages = pages.where(F.col("start") < HARD_CAP)
    bad = pages.where(~F.coalesce(F.col("http_status"), F.lit(0)).between(200, 299))
    ends = bad.groupBy("query_ordinal").agg(F.min("start").alias("_end"))
    return pages.join(ends, "query_ordinal", "left").where(F.col("_end").isNull() | (F.col("start") < F.col("_end"))).drop("_end")


def query_outcomes(pages: DataFrame, cap: int = 0) -> DataFrame:
    """(query_ordinal, rows, capped, failed, drifted) of each query."""
    status = F.coalesce(F.col("http_status"), F.lit(0))
    failed = pages.groupBy("query_ordinal").agg(F.bool_or(~status.between(200, 299) & (status != 400)).alias("failed"))
    facts = H.page_facts(usable(pages)).groupBy("query_ordinal").agg(
        F.sum("n_cards").alias("rows"), F.bool_or("drifted").alias("drifted"),
        F.max_by("has_next", "start").alias("more"))
    capped = F.lit(cap > 0) & (F.col("rows") >= cap) & F.col("more")
    joined = failed.join(facts, "query_ordinal", "left")
    return joined.select("query_ordinal", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(capped, F.lit(False)).alias("capped"),
                         "failed", F.coalesce("drifted", F.lit(False)).alias("drifted"))


def scan_cards(pages: DataFrame, cap: int = 0, related: DataFrame | None = None, seeds: int | None = None) -> DataFrame:
    """Cards of all queries, the first of each id: by query, page and place; related ones come last.

    A card has countryHint and scan_ordinal, which orders the scan.  Of related pages with a seed_id those of the
    first seeds cards of the scan are taken, in the order of the seeds; None takes all.
    """
    rows = H.cards(usable(pages)).withColumnRenamed("country_hint", "countryHint")
    if cap > 0:
        rows = C.capped_per_query(rows, cap)
    order = F.col("query_ordinal").cast("long") * (HARD_CAP * 100) + F.col("start") * 100 + F.col("pos")
    rows = rows.withColumn("scan_ordinal", order)
    if related is not None and seeds != 0:
        start = F.lit(0)
        if seeds is not None and "seed_id" in related.columns:
            first = C.first_of(rows, ["sourceJobId"], "scan_ordinal").select(F.col("sourceJobId").alias("seed_id"), "scan_ordinal")
            # A few rows: their ranks are counted in one task.
            first = C.first_rows(first, seeds, "scan_ordinal")
            rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("scan_ordinal")) - 1
            related, start = related.join(first.select("seed_id", rank.alias("_rank")), "seed_id"), F.col("_rank")
        more = H.cards(related).withColumns({
            "query_ordinal": F.lit(RELATED_ORDINAL), "start": start, "http_status": F.lit(200),
            "countryHint": F.lit(None).cast("string"), "scan_ordinal": F.lit(RELATED_ORDINAL * HARD_CAP * 100) + start * 100 + F.col("pos"),
        })
        rows = rows.unionByName(more.select(rows.columns))
    return C.first_of(rows, ["sourceJobId"], "scan_ordinal")
