"""Elevation tiles whose headers share a path."""

from nightgrid.operators import terrain
from nightgrid.plans import terrain_queries
from nightgrid.plans.registry import ORACLES, QUERIES
from tests.compare import compare, duck


def sites(spark, tmp_path):
    """Suppliers 4 and 1804 name the same file; so do 13 and 1813."""
    more = "select cast(id as bigint) as s_suppkey, 'S' as s_name, cast(0 as bigint) as s_nationkey, 0e0 as s_acctbal from range(20) union all select id + 1800, 'S', 0, 0e0 from range(20)"
    spark.sql(more).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(40).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_headers_that_share_a_path_are_not_multiplied(spark, tmp_path):
    sf = sites(spark, tmp_path)
    head = terrain_queries.tiles(spark, sf)
    assert head.count() == head.select("seq").distinct().count()
    con = duck("/root/testdata/sf0.001")
    for t in ("customer", "supplier"):
        con.execute(f"create or replace view {t} as select * from read_parquet('{sf}/{t}.parquet/*.parquet')")
    for name in ("tile_index", "global_bbox", "tiles_within", "locate_tiles"):
        rows, ok, why = compare(spark, con, QUERIES[name], ORACLES[name], sf)
        assert ok, f"{name}: {why}"


def test_tiles_of_one_box_are_met_once(spark):
    tiles = spark.range(400).selectExpr(
        "concat('t', 400 - id) as path", "id as seq", "cast(id % 2 as double) as xmin", "0e0 as ymin", "cast(id % 2 as double) + 3e0 as xmax", "3e0 as ymax"
    )
    assert sorted(r.seq for r in terrain.first_tiles(tiles).collect()) == [0, 1]
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 3.5, 1.0), (3, 0.5, 1.0), (4, 9.0, 1.0), (5, None, 1.0)], "point_id long, x double, y double")
    got = {r.point_id: r.path for r in terrain.locate_tiles(points, tiles, 2.0).collect()}
    assert got == {1: "t400", 2: "t399", 3: "t400", 4: None, 5: None}
