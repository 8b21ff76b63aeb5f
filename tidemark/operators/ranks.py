"""Exact ranks of groups of any size, in memory of a fixed size.

The value at a rank is looked for by narrowing: approximate quantiles of a group (a sketch of a fixed size) give bounds
around it, exact counts say how many values are below and between them, and the next turn looks at the values in
between alone.  Each turn leaves some thousandth of a group, so there are two or three whatever its size; what is left in
the end is sorted.  Sums are made on the map side, so a group with most of the rows is no burden.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Values of a group that are sorted in one buffer.
FEW = 50_000
#: Bounds are this share of a group's values away from the rank that is looked for; the sketch is some times finer.
NEAR, ACCURACY = 0.001, 10_000
#: Bounds hold some steps of this share, so fewer values than so many steps are not narrowed further.
LEAST_STEPS = 5


def nearest(share: float, n: Column) -> Column:
    """The place, from 1, of the least value that at least this share of the values do not exceed."""
    return F.greatest(F.ceil(n * F.lit(share)).cast("long"), F.lit(1).cast("long"))


def floored(share: float, n: Column) -> Column:
    """The place, from 1, of the value at index floor(n * share), the last one at most."""
    return F.least(F.floor(n * F.lit(share)).cast("long") + 1, n)


def exact_ranks(rows: DataFrame, value: str, wanted: dict[str, Column], *keys: str, few: int = FEW, near: float = NEAR) -> DataFrame:
    """(keys, a column for each wanted rank): exact values at places of the sorted values of each group.

    wanted: name and place from 1, as a column over ``n``, the number of values of the group (see :func:`nearest`,
    :func:`floored`).  Nulls are no values; a group without any has nulls.  Values are numbers, NaN above all others.
    few: so many values are sorted at once (LEAST_STEPS / near at least).
    """
    few = max(few, math.ceil(LEAST_STEPS / near))
    rows = rows.select(*keys, F.col(value).alias("_v"))
    groups = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    places = F.array(*(F.struct(F.lit(name).alias("rank"), place.alias("place")) for name, place in wanted.items()))
    state = groups.select(*keys, F.inline(places), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = written(state.withColumns({c: F.when(F.col("inside") > 0, F.col(c)) for c in ("place", "low", "high")}))
    by = [*keys, "rank"]
    wide = (F.col("inside") > few) & (F.col("low") < F.col("high"))
    while state.where(wide).limit(1).count():
        state = written(state.where(~wide).unionByName(_narrowed(rows, state.where(wide), list(keys), by, near)))
    left = _within(rows, state.where(F.col("low") < F.col("high")), list(keys))
    # At most few values of each group and rank.
    found = left.groupBy(*by).agg(F.element_at(F.array_sort(F.collect_list("_v")), F.first(F.col("place") - F.col("below")).cast("int")).alias("found"))
    joined = state.join(found.withColumnsRenamed({c: f"_{c}" for c in by}), _pairs(by), "left")
    answer = joined.select(*by, F.coalesce("found", "low").alias("found"))
    return answer.groupBy(*keys).agg(*(F.max(F.when(F.col("rank") == name, F.col("found"))).alias(name) for name in wanted))


def _pairs(names: list[str]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return out


def _within(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each group that lie within the bounds of its ranks."""
    own = rows.withColumnsRenamed({k: f"_{k}" for k in keys})
    # The state has a row for each group and rank; Spark broadcasts it while it is small, and else splits what is large.
    return state.join(own, _pairs(keys) & F.col("_v").between(F.col("low"), F.col("high")))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], by: list[str], near: float) -> DataFrame:
    """The state with bounds within the former ones, on the side where the place is."""
    around = _within(rows, state, keys)
    share = (F.col("place") - F.col("below")) / F.col("inside")
    # The sketch takes literal shares, so it gives all bounds; those around the place are picked from them.
    steps = round(1 / near)
    cuts = around.groupBy(*by).agg(F.percentile_approx("_v", F.array(*(F.lit(i / steps) for i in range(steps + 1))), F.lit(ACCURACY)).alias("cuts"),
                                   F.first(share).alias("share"))
    at = lambda i: F.element_at("cuts", F.least(F.greatest(i, F.lit(1)), F.lit(steps + 1)).cast("int"))
    bounds = written(cuts.select(*(F.col(c).alias(f"_{c}") for c in by), at(F.floor(F.col("share") * steps)).alias("_low"),
                                 at(F.ceil(F.col("share") * steps) + 2).alias("_high")))
    both = state.join(bounds, _pairs(by)).drop(*(f"_{c}" for c in by))
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    counted = _within(rows, both, keys).groupBy(*by, "place", "low", "high", "below", "inside", "_low", "_high").agg(
        F.count_if(v < low).alias("less"), F.count_if(v == low).alias("lows"), F.count_if((v > low) & (v < high)).alias("middle"),
        F.count_if((v == high) & (high > low)).alias("highs"), F.max(F.when(v < low, v)).alias("under"), F.min(F.when(v > high, v)).alias("over"),
        F.min(F.when((v > low) & (v < high), v)).alias("first"), F.max(F.when((v > low) & (v < high), v)).alias("last"))
    # Where the place is: below the bounds, at the lower one, between, at the upper one, above.  Bounds with very many
    # equal values go with each turn, so that it always leaves less.
    place, c = F.col("place") - F.col("below"), F.col
    steps_up = [F.lit(0).cast("long"), c("less"), c("less") + c("lows"), c("less") + c("lows") + c("middle"),
                c("less") + c("lows") + c("middle") + c("highs"), c("inside")]
    lows, highs = [c("low"), low, c("first"), high, c("over")], [c("under"), low, c("last"), high, c("high")]

    def pick(values: list[Column]) -> Column:
        out = values[-1]
        for k in reversed(range(4)):
            out = F.when(place <= steps_up[k + 1], values[k]).otherwise(out)
        return out

    return counted.select(
        *by, "place", pick(lows).alias("low"), pick(highs).alias("high"), (c("below") + pick(steps_up[:5])).alias("below"),
        pick([b - a for a, b in zip(steps_up, steps_up[1:])]).alias("inside"))
