"""The store along a sky curve: windows are whole, and most row groups stay unread."""

import random

import pytest
from pyspark.sql import functions as F

from nightgrid.functions import tiles
from nightgrid.sources import stars as src


@pytest.mark.parametrize("box", [(350.0, 10.0, -5.0, 5.0), (0.0, 360.0, 80.0, 90.0), (-20.0, 20.0, -90.0, 90.0), (10.0, 10.5, 3.0, 3.2), (-100.0, 300.0, -1.0, 1.0)])
def test_ranges_cover_the_box(spark, box):
    west, east, south, north = box
    if west > east:
        east += 360.0
    ranges = tiles.curve_ranges(west, east, south, north)
    assert ranges == sorted(ranges) and all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))
    rnd = random.Random(1)
    spots = [(rnd.uniform(west, east) % 360.0, rnd.uniform(south, north)) for _ in range(500)]
    places = spark.createDataFrame(spots, "ra double, dec double").select(tiles.curve_place("ra", "dec").alias("p")).collect()
    assert all(any(lo <= r.p <= hi for lo, hi in ranges) for r in places)


def scanned_rows(df) -> int:
    """Rows that the file scan handed on: those of the row groups that were read."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
            continue
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
        if not children.size() and node.metrics().contains("numOutputRows"):
            out += node.metrics().apply("numOutputRows").value()
    return out


def test_a_window_reads_few_row_groups(spark, tmp_path):
    sky = spark.range(120_000).select(
        F.col("id").alias("source_id"), (F.rand(1) * 360.0).alias("ra"), (F.degrees(F.asin(F.rand(2) * 2.0 - 1.0))).alias("dec"), (F.rand(3) * 2.0).alias("mag"), F.rand(4).alias("bp_rp")
    )
    path = str(tmp_path / "sky")
    src.write_sky_catalog(sky, path, partitions=4, group_bytes=64 << 10)
    window = (355.0, 12.0, 10.0, 8.0, 1.5)
    got = src.read_sky_window(spark, path, *window)
    near = (F.abs((F.col("ra") - 355.0 + 540.0) % 360.0 - 180.0) <= 10.0) & (F.abs(F.col("dec") - 12.0) <= 8.0) & (F.col("mag") <= 1.5)
    want = spark.read.parquet(path).where(near)
    assert {r.source_id for r in got.collect()} == {r.source_id for r in want.collect()}
    assert 0 < scanned_rows(got) < 120_000 / 8
