"""Smoothing in chunks and micro-batches against a plain loop over each site."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nightgrid.plans import load_all
from nightgrid.plans.registry import QUERIES
from nightgrid.streaming import weather as stream

SF = "/root/testdata/sf0.001"
NAMES = ["cloud_cover", "wind_direction_deg"]


def plain(rows):
    """event_id to (cloud, wind), a step at a time."""
    out, last, slot, cloud, wind = {}, None, None, 0.0, 0.0
    for eid, t, c, w in sorted(rows, key=lambda r: (r[1], r[0])):
        dt = min(max(t - last if last is not None else 0.01, 0.01), 0.5)
        hour = int(t // 3600)
        if c is not None:
            cloud += (c - cloud) * (1 - 0.95 ** (dt / 0.05))
            if hour != slot:
                cloud += (c - cloud) * 0.75
        if w is not None:
            wind = (wind + ((w - wind + 180) % 360 - 180) * (1 - 0.92 ** (dt / 0.05))) % 360
        out[eid], last, slot = (cloud, wind), t, hour
    return out


def readings(n=300):
    rng = np.random.default_rng(5)
    site = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 5, n))
    t = np.round(np.cumsum(rng.choice([0.0, 0.03, 0.2, 900.0], n)), 2)
    cloud = [None if x < 0.1 else float(x) for x in rng.random(n)]
    wind = [None if x < 20 else float(x) for x in rng.random(n) * 360]
    return [(i, None if s == 4 else int(s), float(a), c, w) for i, (s, a, c, w) in enumerate(zip(site, t, cloud, wind))]


def expected(rows):
    want = {}
    for s in {r[1] for r in rows}:
        want |= plain([(i, t, c, w) for i, x, t, c, w in rows if x == s])
    return want


def near(got, want):
    assert got.keys() == want.keys()
    for k, (c, w) in want.items():
        assert abs(got[k][0] - c) < 1e-6 and abs((got[k][1] - w + 180) % 360 - 180) < 1e-5, k


def test_chunks_hold_only_their_own_rows():
    rows = readings()
    pdf = pd.DataFrame([(1, str(s or ""), i, pd.Timestamp(t, unit="s"), c, w, 0.0, 0) for i, s, t, c, w in rows], columns=["kind", "key", "event_id", "ts", *NAMES, "last", "slot"])
    pdf = pdf.sort_values(["key", "kind", "ts", "event_id"]).astype({n: float for n in NAMES})
    for size in (1, 7, 1000):
        out = list(stream.smooth_chunks((pdf.iloc[a : a + size] for a in range(0, len(pdf), size)), NAMES))
        assert max(map(len, out)) <= size
        done = pd.concat(out)
        assert sorted(done.loc[done.kind == 2, "key"]) == sorted(set(pdf.key))
        done = done[done.kind == 1]
        near({e: (c, w) for e, c, w in zip(done.event_id, done.cloud_cover, done.wind_direction_deg)}, expected(rows))


def test_any_cut_into_batches_gives_the_same(spark, tmp_path):
    rows = readings(120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        for cut in (120, 50, 31):
            base = tmp_path / str(cut)
            for k in range(0, 120, cut):
                df = spark.createDataFrame(rows[k : k + cut], "event_id long, site long, t double, cloud_cover double, wind_direction_deg double")
                df.withColumn("ts", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long"))).withColumn("kind", F.lit("x")).coalesce(1).write.mode("append").parquet(str(base / "in"))
                src = spark.readStream.schema("event_id long, site long, t double, cloud_cover double, wind_direction_deg double, ts timestamp, kind string").parquet(str(base / "in"))
                stream.write_smoothed(src, NAMES, str(base / "out"), str(base / "ck"), availableNow=True).awaitTermination()
            got = stream.read_smoothed(spark, str(base / "out")).collect()
            near({r.event_id: (r.cloud_cover, r.wind_direction_deg) for r in got}, expected(rows))
            assert {r.event_id: r.site for r in got} == {r[0]: r[1] for r in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_silent_sites_start_anew_after_keep(spark, tmp_path):
    parts = [[(1, 1, "2024-01-01 00:00:00", 0.8, 10.0), (2, 2, "2024-01-01 05:00:00", 0.4, 20.0)], [(3, 1, "2024-01-01 05:00:10", 0.2, 30.0), (4, 2, "2024-01-01 05:00:10", 0.2, 30.0)]]
    for rows in parts:
        df = spark.createDataFrame(rows, "event_id long, site long, t string, cloud_cover double, wind_direction_deg double").withColumn("ts", F.col("t").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        stream.write_smoothed(src, NAMES, str(tmp_path / "out"), str(tmp_path / "ck"), keep="2 hours", availableNow=True).awaitTermination()
    got = {r.event_id: r.cloud_cover for r in stream.read_smoothed(spark, str(tmp_path / "out")).collect()}
    stamp = {i: pd.Timestamp(t).timestamp() for rows in parts for i, _, t, _, _ in rows}
    assert abs(got[3] - plain([(3, stamp[3], 0.2, None)])[3][0]) < 1e-9
    assert abs(got[4] - plain([(2, stamp[2], 0.4, None), (4, stamp[4], 0.2, None)])[4][0]) < 1e-9


def test_registered_query_equals_the_loop(spark):
    load_all()
    got = QUERIES["smooth_weather"](spark, SF).collect()
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", (F.col("user_id") % 5).alias("site"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value").collect()
    rows = [(r.event_id, r.site, r.t / 1e6, r.value % 100 / 100.0, r.value * 7 % 360) for r in ev]
    near({r.event_id: (r.cloud_cover, r.wind_direction_deg) for r in got}, expected(rows))
