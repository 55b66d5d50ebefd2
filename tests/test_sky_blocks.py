"""Sums by observer equal those of all pairs, also on the meridian, at the horizon and with divided cells."""

import pytest
from pyspark.sql import functions as F

from nightgrid.operators import positions, sky_blocks

STARS = "source_id long, ra double, dec double, mag double"


@pytest.fixture()
def sky(spark, monkeypatch):
    monkeypatch.setattr(sky_blocks, "STARS_AT_ONCE", 7)
    monkeypatch.setattr(sky_blocks, "OBSERVERS_AT_ONCE", 2)
    rows = [(i, (i * 37.3) % 360.0, (i * 13.7) % 179.0 - 89.5, float(i % 40) / 8.0 if i % 11 else None) for i in range(400)]
    # on the meridian, at the zenith, on the horizon
    rows += [(1000 + k, ra, dec, 1.0) for k, (ra, dec) in enumerate([(100.0, 80.0), (100.0, -20.0), (280.0, 85.0), (100.0, 0.0), (190.0, 0.0), (10.0, 0.0)])]
    obs = [(1, 0.0, 0.0, 0.0, 0, 3.0), (2, 51.0, 30.0, 5.0, 100, 4.5), (3, -33.0, 10.0, 12.0, 7, 2.0), (4, 51.0, 31.0, 5.0, 100, 4.5)]
    cams = [(k, 1280.0, 720.0, 0.8 + 0.3 * k, 70.0 * k, 10.0, 0.3) for k, *_ in obs]
    return (
        spark.createDataFrame(rows, STARS),
        spark.createDataFrame(obs, "obs_id long, lat double, lon double, ut_hour double, doy int, limit double"),
        spark.createDataFrame(cams, "obs_id long, width double, height double, zoom double, azimuth double, elevation double, v_ratio double"),
    )


def same(got, want):
    got, want = (sorted((tuple(r) for r in df.collect()), key=repr) for df in (got, want))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-6), (a, b)


def test_sky_counts(sky):
    stars, obs, _ = sky
    want = positions.sky_positions(stars, obs).groupBy("obs_id", F.floor("mag").alias("k")).agg(F.count("*"), F.max("alt"), F.min("az"), F.max("az"))
    same(sky_blocks.sky_counts(stars, obs, F.floor("mag")), want)


def test_visible_counts(sky):
    stars, obs, _ = sky
    up = positions.sky_positions(stars, obs, min_alt=10.0, limit_col="limit")
    want = up.groupBy("obs_id", sky_blocks.tile_id("ra", "dec", 10.0).alias("tile")).agg(F.count("*"), F.min("mag"), F.max("alt"))
    same(sky_blocks.visible_counts(stars, obs, "limit", 10.0, 10.0), want)


def test_screen_counts(sky):
    stars, obs, cams = sky
    shown = positions.screen_positions(positions.sky_positions(stars, obs), cams)
    aggs = [f(c) for c in ("sx", "sy") for f in (F.min, F.max, F.avg)]
    same(sky_blocks.screen_counts(stars, obs, cams, F.floor("mag")), shown.groupBy("obs_id", F.floor("mag").alias("k")).agg(F.count("*"), *aggs))


def test_pixel_lines(sky):
    stars, obs, cams = sky
    stars = stars.where("mag is not null")
    shown = positions.screen_positions(positions.sky_positions(stars, obs), cams)
    coarse = shown.select("obs_id", "source_id", "mag", (F.col("sx") / 64.0).alias("sx"), (F.col("sy") / 64.0).alias("sy"))
    want = positions.pixel_buckets(coarse).groupBy("obs_id", "py").agg(F.count("*"), F.sum("source_id"), F.min("mag"), F.max("px"))
    same(sky_blocks.pixel_lines(stars, obs, cams, 64.0), want)


def test_pairs_make_no_rows(sky):
    stars, obs, _ = sky
    plan = sky_blocks.sky_counts(stars, obs, F.floor("mag"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
