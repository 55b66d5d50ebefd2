"""Gaps and stale readings on fixtures."""

from pyspark.sql import functions as F

from nightgrid.operators import weather as wx


def at(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def test_gaps_and_stale_readings(spark):
    slots = at(spark.createDataFrame([(1, "2024-01-01 05:00:00", 0.2, "rain"), (1, "2024-01-01 07:00:00", 0.6, "none")], "site long, slot_ts string, cloud_cover double, precipitation_type string"), "slot_ts")
    asks = at(spark.createDataFrame([(i, 1, f"2024-01-01 0{h}:30:00") for i, h in enumerate((4, 5, 6, 8))], "req_id long, site long, req_ts string"), "req_ts")
    got = {r.req_id: r.cloud_cover for r in wx.interpolate_weather(asks, slots, ["cloud_cover"]).collect()}
    assert got == {0: 0.2, 1: 0.2, 2: 0.6, 3: None}
    src = {r.req_id: r.source for r in wx.weather_or_fallback(asks, *[full(spark, slots)]).collect()}
    assert src == {0: "remote", 1: "remote", 2: "remote", 3: "fallback"}
    metrics = at(spark.createDataFrame([(1, "2024-01-01 01:00:00", 0.1, 900.0), (1, "2024-01-01 02:00:00", 0.3, 990.0)], "site long, ts string, aod double, pressure_hpa double"), "ts")
    obs = at(spark.createDataFrame([(1, 1, "2024-01-01 13:59:59"), (2, 1, "2024-01-01 14:00:00"), (3, 1, "2024-01-01 00:59:59"), (4, 1, "2024-01-01 01:30:00")], "obs_id long, site long, ts string"), "ts")
    seen = {r.obs_id: (r.aod, r.fallback_used) for r in wx.atmosphere_asof(obs, metrics).collect()}
    assert seen == {1: (0.3, False), 2: (None, True), 3: (None, True), 4: (0.1, False)}


def full(spark, slots):
    for name in wx.CLIMATE_FIELDS:
        if name not in slots.columns:
            slots = slots.withColumn(name, F.lit(0.0))
    return slots
