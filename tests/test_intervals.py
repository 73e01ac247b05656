"""Joins of values with ranges, against plain comparison."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators.intervals import interval_join
from tests.test_plans import plan

INF, NAN = float("inf"), float("nan")
POINTS, RANGES = "id bigint, k string, v double", "rid bigint, k string, lo double, hi double"


def brute(points, ranges, keyed):
    found = []
    for pid, k, v in points:
        fits = [
            rid for rid, rk, lo, hi in ranges
            if None not in (v, lo, hi) and v == v and lo == lo and hi == hi and lo < v <= hi
            and (not keyed or (k is not None and k == rk))
        ]
        found += [(pid, rid) for rid in fits] or [(pid, None)]
    return sorted(found, key=str)


def some(seed):
    rng = random.Random(seed)
    ends = [0.0, -0.0, 1.0, -3.5, 1e-9, 1e12, -1e12, INF, -INF, NAN, None]
    number = lambda: rng.choice(ends) if rng.random() < 0.3 else round(rng.uniform(-20, 20), 2)
    name = lambda: rng.choice(["a", "b", None])
    points = [(i, name(), number() if i % 3 else 7.5) for i in range(90)]
    ranges = [(i, name(), number(), number()) for i in range(80)]
    ranges += [(100 + i, "a", 7.0, 7.5) for i in range(3)] + [(200, "b", 3.0, 3.0), (201, "b", 4.0, 3.0)]
    return points, ranges


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_as_by_comparison(spark, seed, keyed):
    points, ranges = some(seed)
    found = interval_join(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), "v", "lo", "hi", ["k"] * keyed
    )
    assert found.columns == ["id", "k", "v", "range"]
    assert sorted(((r.id, r.range.rid if r.range else None) for r in found.collect()), key=str) == brute(points, ranges, keyed)


def test_nothing_to_join(spark):
    points, ranges = spark.createDataFrame([(1, "a", 2.0), (2, None, None)], POINTS), spark.createDataFrame([], RANGES)
    assert [r.range for r in interval_join(points, ranges, "v", "lo", "hi").collect()] == [None, None]
    one = spark.createDataFrame([(1, "a", 1.0, 3.0)], RANGES)
    assert interval_join(points.filter("id = 3"), one, "v", "lo", "hi").isEmpty()
    assert interval_join(points.filter("id = 2"), one, "v", "lo", "hi").first().range is None
    with pytest.raises(ValueError):
        interval_join(points, one, "v", "lo", "hi", name="k")


def test_own_columns_stay(spark):
    points = spark.createDataFrame([(5, 9, 1)], "_v int, _level int, _cell int")
    ranges = spark.createDataFrame([(4, 6, "x"), (5, 6, "y")], "_lo int, _hi int, _range string")
    found = interval_join(points, ranges, "_v", "_lo", "_hi").first()
    assert tuple(found)[:3] == (5, 9, 1) and tuple(found.range) == (4, 6, "x")


def test_a_million_ranges(spark):
    """Ranges of many widths, a third of the values one and the same; every fiftieth value compared with all ranges."""
    wide = "0.001D + (id % 7) * 0.0007D + CASE WHEN id % 50000 = 0 THEN 90.0D ELSE 0.0D END"
    ranges = spark.range(1_000_000).selectExpr("id AS rid", "id / 1000.0D AS lo", f"id / 1000.0D + ({wide}) AS hi")
    value = "CASE WHEN id % 3 = 0 THEN 500.0005D ELSE (id * 7919 % 1000003) / 1000.0D END"
    points = spark.range(60_000).selectExpr("id", f"{value} AS v")
    found = interval_join(points, ranges, "v", "lo", "hi")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    lists = found.filter("id % 50 = 0").groupBy("id", "v").agg(F.sort_array(F.collect_list("range.rid")).alias("rids"))
    rid = np.arange(1_000_000)
    lo = rid / 1000.0
    hi = lo + (0.001 + (rid % 7) * 0.0007 + np.where(rid % 50000 == 0, 90.0, 0.0))
    ours = lists.collect()
    assert len(ours) == 1200
    for row in ours:
        assert row.rids == np.flatnonzero((row.v > lo) & (row.v <= hi)).tolist()
