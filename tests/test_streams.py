"""Streams over several micro-batches: one file a trigger, late and repeated rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nightgrid.operators.radiance import convolve_cells, convolve_tiled, gaussian_kernel
from nightgrid.operators.terrain import Grid, band_table, cell_stencils, sample_elevation
from nightgrid.streaming import weather as stream

SF = "/root/testdata/sf0.001"


def several_files(spark, tmp_path, n=4):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("site", F.col("user_id") % 5)
    for k in range(n):  # in time order but for a fifth of the rows, which come a file late
        part = F.least(F.lit(n - 1), F.floor(F.percent_rank().over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("ts")) * n) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))
        ev.withColumn("p", part).where(F.col("p") == k).drop("p").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return ev, spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows_come_once(spark, tmp_path):
    ev, src = several_files(spark, tmp_path)
    win = stream.windowed_observations(src, "3 hours", "1 hour", late="4000 days")
    stream.write_windows(win, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert len(list((tmp_path / "out").glob("v=*"))) > 1
    got = stream.read_windows(spark, str(tmp_path / "out")).select("site", "win_start", "n").collect()
    want = stream.windowed_observations(ev, "3 hours", "1 hour").select("site", "win_start", "n").collect()
    assert sorted(got) == sorted(want)


def test_slots_keep_the_newest_and_touch_few_days(spark, tmp_path):
    path, ck = str(tmp_path / "slots"), str(tmp_path / "ck")
    schema = "fetch_id long, site long, fetched timestamp, slot_ts timestamp, v0 double"
    batches = [
        [(1, 1, "2024-01-01 00:00:00", "2024-01-01 05:00:00", 1.0), (2, 1, "2024-01-01 00:00:00", "2024-01-02 05:00:00", 2.0)],
        [(3, 1, "2024-01-01 01:00:00", "2024-01-01 05:00:00", 3.0), (4, 2, "2024-01-01 01:00:00", "2024-01-01 05:00:00", 4.0)],
        [(5, 1, "2024-01-01 00:30:00", "2024-01-01 05:00:00", 5.0)],
        [(6, 1, "2024-01-01 09:00:00", "2024-01-01 05:00:00", 6.0)],
    ]
    for k, rows in enumerate(batches):
        pdf = pd.DataFrame(rows, columns=["fetch_id", "site", "fetched", "slot_ts", "v0"])
        pdf[["fetched", "slot_ts"]] = pdf[["fetched", "slot_ts"]].apply(pd.to_datetime)
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.write_latest_slots(src, path, ck, availableNow=True).awaitTermination()
    got = {(r.site, r.slot_ts.day): r.v0 for r in stream.read_latest_slots(spark, path).collect()}
    assert got == {(1, 1): 6.0, (1, 2): 2.0, (2, 1): 4.0}
    assert stream.slot_versions(spark, path)["2024-01-02"] == 0  # never rewritten
    assert len(list((tmp_path / "slots" / "day=2024-01-01").glob("v=*"))) == 2  # older states are dropped


def test_a_missing_reading_keeps_the_state():
    t = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:00.2", "2024-01-01 01:00:00"], format="ISO8601")
    pdf = pd.DataFrame({"event_id": [1, 2, 3], "site": 1, "ts": t, "cloud_cover": [1.0, np.nan, 0.5], "wind_direction_deg": [350.0, 10.0, None]})
    out, state = stream.smooth_rows(pdf, ["cloud_cover", "wind_direction_deg"], None)
    assert out.notna().all().all() and out.cloud_cover[1] == out.cloud_cover[0]
    assert out.wind_direction_deg[2] == out.wind_direction_deg[1] and not np.isnan(state[2:]).any()


def test_convolution_paths_agree_on_repeats_and_gaps(spark):
    rows = [(r, c, float((r * 7 + c * 3) % 11)) for r in range(12) for c in range(14)] + [(0, 0, 5.0), (3, 4, float("nan")), (11, 13, None)]
    cells = spark.createDataFrame(rows, "r int, c int, v double")
    kernel = gaussian_kernel(1.0, 3.0, 1.0)
    a = {(r.r, r.c): r.v for r in convolve_cells(cells, kernel).collect()}
    b = {(r.r, r.c): r.v for r in convolve_tiled(cells, kernel, tile=5).collect()}
    assert len(a) == 12 * 14 and a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_no_height_outside_the_raster(spark):
    cells = spark.createDataFrame([(r, c, 100.0 + r + c) for r in range(3) for c in range(3)], "r int, c int, h double")
    pts = spark.createDataFrame([(0, 0.5, 0.5), (1, 2.5, 2.5), (2, 500.0, 500.0), (3, -0.1, 1.0)], "i int, x double, y double")
    got = {r.i: r.h for r in sample_elevation(pts, cell_stencils(cells), Grid(3, 3, 0.0, 0.0, 1.0)).collect()}
    assert got == {0: 101.0, 1: 104.0, 2: None, 3: None}


def test_band_ids():
    bands = band_table(20, 150_000.0)
    assert len(bands) == 20 and bands[0][0].startswith("gnd_0_") and bands[-1][0].endswith("_150k")
    assert all(a[2] == b[1] for a, b in zip(bands, bands[1:]))
