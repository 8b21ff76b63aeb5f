"""A log of runs: a table that each run adds one row to, whatever became of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import statistics as S

#: status: ok, busy, degraded (without a state) or failed; kind says of what sort a failure is.
RUN_SCHEMA = (
    "run_id string, state_key string, started_at string, status string, kind string, coverage_reason string, migrated_from string, emitted bigint, "
    "skipped bigint, new bigint, reappeared bigint, updated bigint, unchanged bigint, expired bigint, seconds double"
)
COUNTS = ("new", "reappeared", "updated", "unchanged", "expired")


def append(runs: DataFrame, path: str) -> None:
    """Add rows; days are folders, so that a report of some days opens no others."""
    rows = runs.withColumn("day", F.coalesce(F.left("started_at", F.lit(10)), F.lit("unknown")))
    rows.write.mode("append").partitionBy("day").parquet(path)


def record(spark: SparkSession, path: str, **values) -> None:
    """Add one run; what is not said is null."""
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    append(spark.createDataFrame([tuple(values.get(n) for n in names)], RUN_SCHEMA).coalesce(1), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RUN_SCHEMA}, day string").parquet(path)


def by_day(log: DataFrame) -> DataFrame:
    """(day, runs, ok, success_share, failures by kind, emitted, skipped, times): how the runs of each day went.

    A busy run has not begun, so it is counted in runs alone.  Times are those of runs that ended well.
    """
    kinds = log.where("status = 'failed'").groupBy("day", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
    # Some ten kinds a day.
    kinds = kinds.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), "n"))), ",").alias("failures"))
    begun, good = F.col("status") != "busy", F.col("status") == "ok"
    days = log.groupBy("day").agg(
        F.count("*").alias("runs"), F.count_if(good).alias("ok"), (F.count_if(good) / F.nullif(F.count_if(begun), F.lit(0))).alias("success_share"),
        F.coalesce(F.sum("emitted"), F.lit(0)).alias("emitted"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    times = S.nearest_rank(log.withColumn("_s", F.when(good, F.col("seconds"))), "_s", "day", prefix="seconds_")
    return days.join(times, "day").join(kinds, "day", "left").withColumn("failures", F.coalesce("failures", F.lit("")))
