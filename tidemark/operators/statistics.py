"""Run statistics, schema drift and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ranks as R
from tidemark.operators.ordering import numbered
from tidemark.sources.shared import written

ERROR_CLASSES = ("rate_limit", "server_error", "timeout", "network", "parse_fail", "other")
MAX_NEW_FIELDS = 500
EARTH_KM = 6371.0


def nearest_rank(rows: DataFrame, value: str, *keys: str, prefix: str = "") -> DataFrame:
    """(keys, avg (rounded), p50, p95 (nearest rank), min and max) of the values of each group; zeros without values.

    Of groups of a bounded number of values Spark sorts them; of others the ranks are found by narrowing.
    """
    v = F.col(value)
    sums = [F.floor(F.avg(v) + 0.5).cast("double").alias("avg"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max")]
    shares = {"p50": 0.5, "p95": 0.95}
    most = rows.groupBy(*keys).agg(F.count(v).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= R.FEW:
        out = rows.groupBy(*keys).agg(*sums, *(F.expr(f"percentile_disc({p}) within group (order by `{value}`)").alias(name) for name, p in shares.items()))
    else:
        found = R.exact_ranks(rows, value, {name: R.nearest(p, F.col("n")) for name, p in shares.items()}, *keys)
        other = rows.groupBy(*keys).agg(*sums).withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = found.join(other, same)
    names = ("avg", "p50", "p95", "min", "max")
    return out.select(*keys, *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(prefix + n) for n in names))


def batch_statistics(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts by status and error class, and times of what did not fail: over all rows or by keys.

    outcomes: status (success, empty, error), error_class, fetch_ms.
    """
    ok = outcomes.withColumn("_ms", F.when(F.col("status") != "error", F.col("fetch_ms")))
    counts = ok.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("success", "empty", "error")),
        *(F.count_if((F.col("status") == "error") & (F.col("error_class") == c)).alias(c) for c in ERROR_CLASSES),
    )
    times = nearest_rank(ok, "_ms", *keys, prefix="fetch_").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return counts.join(times, same).drop(*(f"_{k}" for k in keys))


def with_error_class(log: DataFrame, message: str = "message") -> DataFrame:
    return log.withColumn("error_class", T.error_class(F.col(message)))


def run_figures(changes: DataFrame, *keys: str, price: float, emitted: tuple[str, ...] = ("NEW", "REAPPEARED", "UPDATED"),
                least: int = 20) -> DataFrame:
    """What :func:`run_summary` and :func:`savings` say of each group of changes, as columns; savings are null where there are none."""
    out = changes.groupBy(*keys).agg(
        F.count_if(F.col("change_type").isin(*emitted)).alias("emitted"), F.count_if(F.col("change_type") == "UNCHANGED").alias("unchanged"))
    seen = F.col("emitted") + F.col("unchanged")
    saving = (seen >= least) & (F.col("unchanged") > 0) & F.lit(price > 0)
    return out.select(
        *keys, "emitted", "unchanged", seen.alias("total"), F.when(seen == 0, "no_results").alias("reason"),
        F.when(saving, F.round(F.col("unchanged") * F.lit(price), 2)).alias("saved"),
        F.when(saving, F.floor(F.col("unchanged") / seen * 100 + 0.5).cast("long")).alias("saved_percent"),
    )


def savings(emitted: int, unchanged: int, price: float, least: int = 20) -> dict | None:
    """What skipping unchanged rows saves; None for a run of little activity or without such rows."""
    seen = emitted + unchanged
    if seen < least or unchanged <= 0 or price <= 0:
        return None
    return {"saved": round(unchanged * price, 2), "percent": int(unchanged / seen * 100 + 0.5), "skipped": unchanged}


def run_summary(emitted: int, unchanged: int, duration_ms: int) -> dict:
    total = emitted + unchanged
    out = {"emitted": emitted, "unchangedSkipped": unchanged, "totalReviews": total, "status": "success", "ok": True,
           "durationMs": duration_ms}
    return out | ({"reason": "no_results"} if total == 0 else {})


def field_census(records: DataFrame, layer: str | Column, json_column: str, nested: bool = False) -> DataFrame:
    """(layer, field, sample_count): how many JSON records have each key; with nested also parent.child."""
    layer = F.lit(layer) if isinstance(layer, str) else layer
    keys = F.json_object_keys(json_column)
    if nested:
        variant = F.try_parse_json(json_column)
        inner = F.map_filter(F.try_variant_get(variant, "$", "map<string,variant>"), lambda k, v: F.startswith(
            F.schema_of_variant(v), F.lit("OBJECT")))
        pairs = F.transform(F.map_entries(inner), lambda e: F.transform(
            F.map_keys(F.try_variant_get(e["value"], "$", "map<string,variant>")), lambda c: F.concat(e["key"], F.lit("."), c)))
        keys = F.concat(keys, F.coalesce(F.flatten(pairs), F.array().cast("array<string>")))
    rows = records.select(layer.alias("layer"), F.explode(keys).alias("field"))
    return rows.groupBy("layer", "field").agg(F.count("*").alias("sample_count"))


#: A stored baseline of another version, source or scope is not carried on.
BASELINE_VERSION, BASELINE_SCOPE = 1, "default"
BASELINE_FIELDS = "layer string, field string, first_seen_at string, last_seen_at string, sample_count long, status string"
BASELINE_SCHEMA = "version int, actor string, scope string, " + BASELINE_FIELDS


def stored_baseline(report: DataFrame, actor: str, scope: str = BASELINE_SCOPE) -> DataFrame:
    """A report of :func:`schema_drift` as it is kept for the next run."""
    names = [part.split()[0] for part in BASELINE_FIELDS.split(", ")]
    return report.select(F.lit(BASELINE_VERSION).alias("version"), F.lit(actor).alias("actor"), F.lit(scope).alias("scope"), *names)


def adopted_baseline(kept: DataFrame, actor: str, scope: str = BASELINE_SCOPE) -> DataFrame:
    """The fields of the stored baseline of this version, source and scope; none of any other."""
    own = kept.where((F.col("version") == BASELINE_VERSION) & (F.col("actor") == actor) & (F.col("scope") == scope))
    return own.drop("version", "actor", "scope")


def layer_fields(spark: SparkSession, layers: dict[str, tuple[str, ...]]) -> DataFrame:
    """(layer, field) rows of a catalog of layers."""
    return spark.createDataFrame([(layer, field) for layer, fields in layers.items() for field in fields], "layer string, field string")


def as_records(rows: DataFrame) -> DataFrame:
    """Rows as JSON records (column record) for :func:`field_census`, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("record"))


def schema_drift(census: DataFrame, baseline: DataFrame, mapped: DataFrame, ignored: DataFrame, now: str,
                 most: int = MAX_NEW_FIELDS) -> DataFrame:
    """The new baseline with a verdict on each field: (layer, field, first_seen_at, last_seen_at, sample_count, status,
    pending, disappeared).

    mapped and ignored: (layer, field).  A layer takes new fields up to most in all, in the order of
    their names; pending are unmapped fields that this run has seen, disappeared those it has not.
    """
    flag = lambda df, name: df.select("layer", "field", F.lit(True).alias(name)).distinct()
    both = baseline.withColumnRenamed("sample_count", "old").join(
        census.withColumnRenamed("sample_count", "new"), ["layer", "field"], "full_outer")
    # Fields number some hundreds a layer, so that a window by layer is small.
    known = F.count("first_seen_at").over(Window.partitionBy("layer"))
    place = F.row_number().over(Window.partitionBy("layer").orderBy(F.col("first_seen_at").isNull(), "field"))
    both = both.withColumn("_known", known).withColumn("_place", place)
    both = both.where(F.col("first_seen_at").isNotNull() | (F.col("_place") <= F.greatest(F.col("_known"), F.lit(most))))
    rows = both.join(flag(mapped, "_mapped"), ["layer", "field"], "left").join(flag(ignored, "_ignored"), ["layer", "field"], "left")
    seen = F.col("new").isNotNull()
    status = F.when(F.col("_mapped"), "mapped").when(F.col("_ignored"), "ignored").otherwise("pending")
    return rows.select(
        "layer", "field", F.coalesce("first_seen_at", F.lit(now)).alias("first_seen_at"),
        F.when(seen, F.lit(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("sample_count"), status.alias("status"),
        (seen & (status == "pending")).alias("pending"), (~seen).alias("disappeared"),
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_radius(points: DataFrame, lat: float, lon: float, km: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    return points.where(haversine_km(F.col(lat_col), F.col(lon_col), F.lit(lat), F.lit(lon)) <= km)


def slope(x: str, y: str) -> Column:
    """Least-squares slope of y over x; null for fewer than two points or a constant x."""
    return F.regr_slope(y, x)


def mean_step_slope(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Mean of the slopes between neighbours in the order of x: by keys (few points each: a sweep's), or over all points.

    Without keys points are numbered in order and meet their neighbours by number, so there may be any number of them.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(x)
        steps = points.select(*keys, (F.col(x) - F.lag(x).over(w)).alias("_dx"), (F.col(y) - F.lag(y).over(w)).alias("_dy"))
    else:
        # Neighbours must be the same points in both sides, so the numbers are written once.
        placed = written(numbered(points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null"), "_x", "_n"))
        before = placed.select((F.col("_n") + 1).alias("_n"), F.col("_x").alias("_px"), F.col("_y").alias("_py"))
        steps = placed.join(before, "_n").select((F.col("_x") - F.col("_px")).alias("_dx"), (F.col("_y") - F.col("_py")).alias("_dy"))
    return steps.groupBy(*keys).agg(F.avg(F.col("_dy") / F.nullif("_dx", F.lit(0))).alias("mean_step_slope"))


def floor_rank(points: DataFrame, value: str, share: float, *keys: str, name: str = "value") -> DataFrame:
    """(keys, name): the value at index floor(n * share) of the sorted values of each group."""
    return R.exact_ranks(points, value, {name: R.floored(share, F.col("n"))}, *keys)


def unit_verdict(tests: DataFrame, km: str = "km_ok", miles: str = "miles_ok", slope_col: str = "slope") -> DataFrame:
    """km or miles by the majority of boundary tests; a tie is decided by the slope (about 1 or about 1.6)."""
    votes = tests.agg(F.count_if(km).alias("km_votes"), F.count_if(miles).alias("mile_votes"), F.avg(slope_col).alias("slope"))
    by_slope = F.when(F.col("slope") > 1.3, "miles").when(F.col("slope").isNotNull(), "km").otherwise("unknown")
    verdict = F.when(F.col("km_votes") > F.col("mile_votes"), "km").when(
        F.col("mile_votes") > F.col("km_votes"), "miles").otherwise(by_slope)
    return votes.withColumn("unit", verdict)


def value_census(df: DataFrame, column: str) -> DataFrame:
    """One row: the distinct values of a column, sorted, and how many rows have none."""
    return df.agg(F.array_sort(F.collect_set(column)).alias("values"), F.count_if(F.col(column).isNull()).alias("nulls"))
