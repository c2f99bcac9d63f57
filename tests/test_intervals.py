"""Open intervals at points next to a plain count."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docsnap.operators import filters
from docsnap.operators.intervals import with_open_intervals

ZERO = datetime(2000, 1, 1)
POINTS = "k long, ts timestamp_ntz, _step string, start_ts long"
INTERVALS = "start_ts timestamp_ntz, end_ts timestamp_ntz"


def at(hours):
    return None if hours is None else ZERO + timedelta(hours=hours)


def data(seed):
    rng = random.Random(seed)
    points = [(k, rng.choice([rng.randrange(300_000), 77, 78, rng.randrange(60, 90)])) for k in range(800)] + [(900, None), (901, 77), (901, 77)]
    intervals = [(s, s + rng.choice([0, 1, 5, 200, 262_980, -3])) for s in (rng.randrange(300_000) for _ in range(15))]
    intervals += [(77, 78), (60, 77), (78, 300_000), (70, 90), (70, 90), (None, 5), (None, None)] + ([(250_000, None)] if seed else [])
    return points, intervals


def frames(spark, points, intervals):
    return (
        spark.createDataFrame([(k, at(p), "x", 1) for k, p in points], POINTS).repartition(3),
        spark.createDataFrame([(at(s), at(e)) for s, e in intervals], INTERVALS),
    )


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("slices", [1, 4, 40])
def test_like_a_plain_count(spark, seed, slices):
    points, intervals = data(seed)
    found = with_open_intervals(*frames(spark, points, intervals)[:1], "ts", frames(spark, points, intervals)[1], "start_ts", "end_ts", slices)
    assert found.columns == ["k", "ts", "_step", "start_ts", "open_intervals"]
    expected = sorted(
        (k, sum(s is not None and p is not None and s <= p and (e is None or (s < e and p < e)) for s, e in intervals)) for k, p in points
    )
    assert sorted((r.k, r.open_intervals) for r in found.collect()) == expected


def test_one_moment_is_not_one_task(spark):
    points = spark.range(20_000).select(F.col("id").alias("k"), F.lit(at(5)).alias("ts"))
    intervals = spark.createDataFrame([(at(0), at(5)), (at(5), at(6)), (at(1), at(9))], INTERVALS)
    found = with_open_intervals(points, "ts", intervals, "start_ts", "end_ts", 8)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 6_000
    assert {r.open_intervals for r in found.collect()} == {2}


def test_no_array_of_hours_is_made(spark):
    """Borders in place of hours: a pause of thirty years is two rows."""
    points, pauses = frames(spark, [(1, 5), (2, 300_000)], [(0, 262_980)])
    kept = filters.outside_pauses(points, pauses)
    plan = kept._jdf.queryExecution().toString()
    assert "sequence(" not in plan and "explode" not in plan
    assert [r.k for r in kept.collect()] == [2]


def test_empty_sides(spark):
    points, pauses = frames(spark, [(1, 5)], [(0, 10)])
    assert filters.outside_pauses(points.limit(0), pauses).collect() == []
    assert filters.outside_pauses(points, pauses.limit(0)).count() == 1
