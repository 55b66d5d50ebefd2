"""Measures of one shape do not repeat the work of each other."""

from pyspark.sql import functions as F

from nightgrid.operators import search

SHAPE = "measure_id long, tool string, a_alt double, a_az double, b_alt double, b_az double, rot_deg double"


def test_measures_of_one_shape_are_covered_once(spark, monkeypatch):
    rows = [(i, "circle", 10.0, 20.0, 14.0, 23.0, None) for i in range(40)] + [(99, "ruler", 0.0, 0.0, 1.0, 1.0, 5.0)]
    points = spark.range(400).select((F.col("id") % 20).cast("double").alias("alt"), (F.col("id") / 20 + 10).cast("double").alias("az"))
    met = []
    covered = search.inside_counts
    monkeypatch.setattr(search, "inside_counts", lambda flat, *a: met.append(flat.count()) or covered(flat, *a))
    got = {r.measure_id: r for r in search.region_stats(spark.createDataFrame(rows, SHAPE), points).collect()}
    assert met == [1]
    assert len(got) == 41 and got[99].n_inside == 0 and got[99].length > 0
    assert len({(got[i].n_inside, got[i].area) for i in range(40)}) == 1 and got[0].n_inside > 0
