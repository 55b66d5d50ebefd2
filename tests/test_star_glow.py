"""Sums of what is seen through air and domes equal those of all pairs; the query makes no row for a pair."""

import pytest
from pyspark.sql import functions as F

from nightgrid.operators import photometry, sky_blocks, star_glow
from tests.test_sky_blocks import same


@pytest.fixture()
def night(spark, monkeypatch):
    monkeypatch.setattr(sky_blocks, "STARS_AT_ONCE", 60)
    monkeypatch.setattr(star_glow, "AT_ONCE", 2)
    rows = [(i, (i * 37.31) % 360.0, (i * 13.77) % 179.0 - 89.5, (i * 7 % 83) / 12.0 - 0.4 if i % 19 else None) for i in range(1500)]
    # on the meridian, at the zenith, on the horizon
    rows += [(9000 + k, ra, dec, 1.0) for k, (ra, dec) in enumerate([(100.0, 80.0), (100.0, -20.0), (280.0, 85.0), (100.0, 0.0), (190.0, 0.0), (10.0, 0.0)])]
    stars = spark.createDataFrame(rows, "source_id long, ra double, dec double, mag double")
    obs = [(1, 0.0, 0.0, 0.0, 0, 7.6, 1.0), (2, 51.0, 30.0, 5.0, 100, 5.1, 6.0), (3, -33.0, 10.0, 12.0, 7, 3.6, 9.0), (4, 88.0, 31.0, 5.0, 100, 6.1, 4.0), (5, 20.0, 1.0, 3.0, 9, None, 4.0)]
    obs = spark.createDataFrame(obs, "obs_id long, lat double, lon double, ut_hour double, doy int, limit double, bortle double")
    domes = obs.selectExpr("obs_id", "explode(sequence(0, 719)) as az_idx").where("(az_idx + obs_id) % 3 <> 0 and obs_id <> 4")
    domes = domes.selectExpr("obs_id", "az_idx", "if(az_idx % 50 = 7, null, (az_idx * obs_id) % 97 * 1.5D) as dome", "2000D + (az_idx * 31) % 48 * 1000D as peak_dist")
    return stars, obs, domes


@pytest.mark.parametrize("min_alt", [0.0, 25.0])
def test_visible_star_counts(night, min_alt):
    seen = photometry.visible_stars(*night, 720, min_alt=min_alt)
    aggs = [F.count("*"), F.avg("alpha"), F.min("local_limit"), F.max("alt_refracted")]
    same(star_glow.visible_star_counts(*night, 720, F.floor("mag"), min_alt=min_alt), seen.groupBy("obs_id", F.floor("mag").alias("k")).agg(*aggs))


def test_query_makes_no_row_for_a_pair(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["visible_stars"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
