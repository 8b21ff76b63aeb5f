"""Exact ranks by narrowing, and what is made of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators import statistics as S

SHARES = (0.0, 0.013, 0.5, 1.0)


def groups():
    draw = random.Random(7)
    yield "distinct", [float(i) for i in range(9_000)]
    yield "skewed", [draw.paretovariate(0.3) for _ in range(4_000)]
    yield "ties", [float(draw.choice([1, 1, 1, 1, 2, 3, 5_000])) for _ in range(3_000)]
    yield "same", [4.0] * 500
    yield "few", [3.0, -1.0, 2.0]
    yield "one", [7.5]
    yield "signed", [draw.gauss(0, 1) * 10 ** draw.randint(-9, 9) for _ in range(2_000)]
    yield None, [draw.random() for _ in range(1_000)]
    yield "none", []


@pytest.mark.parametrize("near", [0.02, 0.2])
def test_ranks_equal_those_of_sorted_values(spark, near):
    made = dict(groups())
    rows = [(k, v, "x") for k, values in made.items() for v in values] + [("none", None, "x"), ("few", None, "x")]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "g string, v double, rank string").repartition(4)
    n = F.col("n")
    wanted = {f"near{i}": ranks.nearest(p, n) for i, p in enumerate(SHARES)} | {f"floor{i}": ranks.floored(p, n) for i, p in enumerate(SHARES)}
    found = {r.g: r for r in ranks.exact_ranks(table, "v", wanted, "g", few=1, near=near).collect()}
    assert set(found) == set(made)
    for g, values in made.items():
        values = sorted(values)
        for i, p in enumerate(SHARES):
            near, floor = found[g][f"near{i}"], found[g][f"floor{i}"]
            if not values:
                assert near is None and floor is None
                continue
            assert near == values[max(1, math.ceil(len(values) * p)) - 1]
            assert floor == values[min(len(values) - 1, math.floor(len(values) * p))]


def test_ranks_without_keys_and_as_many_values_as_rows(spark):
    rows = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(10**15)).alias("v"))
    values = sorted(r.v for r in rows.collect())
    found = ranks.exact_ranks(rows, "v", {"a": ranks.nearest(0.95, F.col("n")), "b": ranks.floored(0.5, F.col("n"))}, few=1, near=0.01).collect()
    assert [tuple(r) for r in found] == [(values[math.ceil(200_000 * 0.95) - 1], values[100_000])]
    assert ranks.exact_ranks(rows.limit(0), "v", {"a": ranks.nearest(0.5, F.col("n"))}).first().a is None


def test_statistics_by_both_ways(spark, monkeypatch):
    rows = [(f"k{i % 3}" if i % 11 else None, ("success", "empty", "error")[i % 3], "timeout" if i % 3 == 2 else None, float((i * 37) % 501)) for i in range(3_000)]
    table = spark.createDataFrame(rows, "k string, status string, error_class string, fetch_ms double")
    small = [sorted(map(repr, S.batch_statistics(table, *keys).collect())) for keys in ((), ("k",))]
    monkeypatch.setattr(ranks, "FEW", 10)
    monkeypatch.setattr(ranks.exact_ranks, "__kwdefaults__", {"few": 10, "near": 0.2})
    assert [sorted(map(repr, S.batch_statistics(table, *keys).collect())) for keys in ((), ("k",))] == small
    assert len(small[1]) == 4 and "total=3000" in small[0][0]


def test_steps_of_all_points(spark):
    draw = random.Random(3)
    points = [(float(i), draw.random()) for i in range(500)]
    steps = [b[1] - a[1] for a, b in zip(points, points[1:])]
    table = spark.createDataFrame(random.Random(4).sample(points, 500) + [(None, 1.0)], "x double, y double")
    found = S.mean_step_slope(table, "x", "y")
    assert abs(found.first().mean_step_slope - sum(steps) / len(steps)) < 1e-9
    assert "SinglePartition" not in S.mean_step_slope(table, "x", "y").select("mean_step_slope")._jdf.queryExecution().analyzed().toString()
    assert S.mean_step_slope(table.limit(0), "x", "y").first().mean_step_slope is None
