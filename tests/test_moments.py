"""What depends on the moment alone is computed once for each moment."""

import inspect

from nightgrid.operators import ephemeris, photometry


def test_sun_and_moon_by_moment_equal_those_by_row(spark):
    sites = spark.createDataFrame([(1, 40.0, 2.0), (2, -33.0, 151.0), (2, -33.0, 151.0)], "obs_id long, lat double, lon double")
    rows = ephemeris.time_grid(sites, "2024-04-08 00:00:00", "2024-04-08 05:00:00", "1 hour")
    plain = ephemeris.sun_moon_table(rows)
    shared = ephemeris.sun_moon_table(rows, rows.select("ts")).select(plain.columns)
    assert sorted(shared.collect()) == sorted(plain.collect()) and shared.count() == 18


def test_planets_that_carry_their_sun_need_no_join(spark):
    row = (1, "Venus", 20.0, 100.0, -4.0, -12.0, 280.0, 3.5)
    rows = spark.createDataFrame([row, row], "obs_id long, name string, alt double, az double, mag double, sun_alt double, sun_az double, limit double")
    seen = photometry.visible_planets(rows)
    assert seen.count() == 2 and "Join" not in seen._jdf.queryExecution().toString()
    assert inspect.signature(photometry.visible_planets).parameters["suns"].default is None
