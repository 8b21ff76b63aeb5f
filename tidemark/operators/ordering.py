"""Numbers for rows in an order, without passing them through one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are dealt to, unless the session has fewer shuffle partitions.
RANGES = 256


def _by_range(value: Column, bounds: list, leaves: list) -> Column:
    """The leaf of the range between bounds that a value is in, by halving: some log2 comparisons."""
    if len(leaves) == 1:
        return F.lit(leaves[0])
    middle = len(leaves) // 2
    below = _by_range(value, bounds[: middle - 1], leaves[:middle])
    return F.when(value <= F.lit(bounds[middle - 1]), below).otherwise(_by_range(value, bounds[middle:], leaves[middle:]))


def numbered(rows: DataFrame, order: str, name: str = "number", ranges: int | None = None) -> DataFrame:
    """The rows with their number from 0, dense, in the order of a column of distinct numbers or dates; nulls come last.

    Bounds of ranges of about equal size come from approximate quantiles, and the rows of each range are counted: two sums
    of fixed size, whose results go into the plan as literals.  A row's number is then the count of all ranges before its own
    and its place in it.  Bounds that are off only make ranges uneven.  The rows are read three times, so cheap or
    persisted ones should come in.  Of equal values the order is not fixed, and those of one value are numbered in one task.
    """
    spark = rows.sparkSession
    ranges = ranges or min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [(i + 1) / ranges for i in range(ranges - 1)]
    found = rows.agg(F.percentile_approx(order, F.array(*map(F.lit, cuts)), F.lit(10_000))).first()[0] if cuts else None
    bounds = sorted(set(found or ()))
    leaves = list(range(len(bounds) + 1))
    value, last = F.col(order), len(leaves)
    part = F.when(value.isNull(), last).otherwise(_by_range(value, bounds, leaves))
    counts = {r.part: r["count"] for r in rows.select(part.alias("part")).groupBy("part").count().collect()}
    before = [0, *accumulate(counts.get(i, 0) for i in leaves)]
    start = F.when(value.isNull(), before[-1]).otherwise(_by_range(value, bounds, before[:-1]))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(value.asc_nulls_last()))
    out = rows.withColumn("_range", part).withColumn("_place", place)
    return out.withColumn(name, (start + F.col("_place") - 1).cast("long")).drop("_range", "_place")
