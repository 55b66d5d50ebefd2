"""Terrain queries over the elevation raster, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.functions.angles import rounded
from nightgrid.functions.scale import cut_lineage
from nightgrid.operators import horizon as hor
from nightgrid.operators import terrain as ter
from nightgrid.plans.adapters import table, view
from nightgrid.plans.catalog_queries import scratch_dir
from nightgrid.plans.registry import c6, oracle, query
from nightgrid.sources import grids

HEADERS = """select s_suppkey as seq, case when s_suppkey % 9 = 4 then 'Y_(' || cast((s_suppkey*7)%40 as varchar(9)) || '_' || cast((s_suppkey*7)%40+6 as varchar(9)) || ')X_(' || cast((s_suppkey*11)%50 as varchar(9)) || '_' || cast((s_suppkey*11)%50+8 as varchar(9)) || ').npy'
 else 'tile_' || cast(s_suppkey as varchar(9)) || '.asc' end as path,
 cast(case when s_suppkey % 9 <> 4 then 10+s_suppkey%5 end as double) as ncols, cast(case when s_suppkey % 9 <> 4 then 8+s_suppkey%3 end as double) as nrows,
 case when s_suppkey % 2 = 0 and s_suppkey % 10 <> 6 then cast((s_suppkey*13)%50 as double) end as xllcorner, case when s_suppkey % 2 = 0 then cast((s_suppkey*17)%40 as double) end as yllcorner,
 case when s_suppkey % 2 = 1 then cast((s_suppkey*13)%50 as double) end as xllcenter, case when s_suppkey % 2 = 1 then cast((s_suppkey*17)%40 as double) end as yllcenter, 0.5e0+0.25e0*cast(s_suppkey%4 as double) as cellsize from """


def tiles(spark, sf):
    head = spark.sql(HEADERS + "{supplier}", supplier=table(spark, sf, "supplier"))
    return ter.tile_index(head)


TILES = f"""hd as ({HEADERS} supplier), tl as (select seq, path,
 case when seq%9=4 then (seq*11)%50 else coalesce(xllcenter-cellsize/2e0, xllcorner) end as xmin, case when seq%9=4 then (seq*7)%40 else coalesce(yllcenter-cellsize/2e0, yllcorner) end as ymin,
 case when seq%9=4 then (seq*11)%50+8 else coalesce(xllcenter-cellsize/2e0, xllcorner)+ncols*cellsize end as xmax, case when seq%9=4 then (seq*7)%40+6 else coalesce(yllcenter-cellsize/2e0, yllcorner)+nrows*cellsize end as ymax from hd),
tiles as (select * from tl where xmin is not null and ymin is not null)"""


@query("tile_index")
def _(spark, sf):
    return rounded(tiles(spark, sf).select("path", "xmin", "ymin", "xmax", "ymax"))


oracle("tile_index", "", f"{TILES} select path, {c6('xmin','xmin')}, {c6('ymin','ymin')}, {c6('xmax','xmax')}, {c6('ymax','ymax')} from tiles")


@query("global_bbox")
def _(spark, sf):
    return rounded(ter.global_bbox(tiles(spark, sf)))


oracle("global_bbox", "", f"{TILES} select {c6('min(xmin)','xmin')}, {c6('min(ymin)','ymin')}, {c6('max(xmax)','xmax')}, {c6('max(ymax)','ymax')}, count(*) as n_tiles from tiles")


def spots(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as point_id", "cast((c_custkey*37) % 620 as double)/10e0-1.05e0 as x", "cast((c_custkey*71) % 520 as double)/10e0-1.05e0 as y"
    )


SPOTS = "pt as (select c_custkey as point_id, cast((c_custkey*37) % 620 as double)/10e0-1.05e0 as x, cast((c_custkey*71) % 520 as double)/10e0-1.05e0 as y from customer)"


@query("locate_tiles")
def _(spark, sf):
    return ter.locate_tiles(spots(spark, sf), tiles(spark, sf), 8.0).select("point_id", "path")


oracle(
    "locate_tiles",
    "",
    f"""{TILES}, {SPOTS}, h as (select point_id, min_by(path, seq) as path from pt join tiles on xmin <= x and x < xmax and ymin <= y and y < ymax group by 1)
select point_id, path from pt left join h using (point_id)""",
)


@query("tiles_within")
def _(spark, sf):
    return rounded(ter.tiles_within(spots(spark, sf), tiles(spark, sf), 3.0, 8.0).drop("seq"))


oracle(
    "tiles_within",
    "",
    f"""{TILES}, {SPOTS}, j as (select point_id, path, seq, pow(greatest(xmin-x,0e0,x-xmax),2e0)+pow(greatest(ymin-y,0e0,y-ymax),2e0) as d from pt, tiles)
select point_id, path, {c6('sqrt(d)','distance')}, cast(row_number() over (partition by point_id order by d, seq) as int) as rank from j where d <= 9e0""",
)


def dem_grid(spark, sf, cell=1.0):
    cells = view(spark, sf, "dem_cells")
    size = cells.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()  # raster metadata
    return cells, ter.Grid(size["r"] + 1, size["c"] + 1, 0.0, 0.0, cell)


DIM = "dim as (select max(r)+1 as nr, max(c)+1 as nc from dem_cells)"


def bilinear_sql(src: str, border: str) -> str:
    """CTE `smp` over `src` with gx, gy: height h."""
    edge = 1 if border == "null" else 0
    null = f"when not (gx >= 0 and gy >= 0 and gx < nc-{edge} and gy < nr-{edge}) then null"
    return f"""g1 as (select s.*, cast(greatest(0e0,least(nc-1,floor(gx))) as int) as ci, cast(greatest(0e0,least(nr-1,floor(gy))) as int) as ri, nr, nc from {src} s, dim),
smp as (select g1.*, case {null} when ri < nr-1 and ci < nc-1 then (a.h*(1e0-(gx-ci))+b.h*(gx-ci))*(1e0-(gy-ri))+(d.h*(1e0-(gx-ci))+e.h*(gx-ci))*(gy-ri) else a.h end as h
 from g1 join dem_cells a on a.r=ri and a.c=ci left join dem_cells b on b.r=ri and b.c=ci+1 left join dem_cells d on d.r=ri+1 and d.c=ci left join dem_cells e on e.r=ri+1 and e.c=ci+1)"""


@query("sample_elevation")
def _(spark, sf):
    cells, grid = dem_grid(spark, sf)
    st = ter.cell_stencils(cells)
    pts = spots(spark, sf)
    a = ter.sample_elevation(pts, st, grid).select("point_id", F.col("h").alias("h_clamp"))
    b = ter.sample_elevation(pts, st, grid, "null").select("point_id", F.col("h").alias("h_null"))
    return rounded(a.join(b, "point_id"))


oracle(
    "sample_elevation",
    "dem_cells",
    f"""{DIM}, {SPOTS}, q as (select point_id, x as gx, y as gy from pt), {bilinear_sql('q','clamp')}
select point_id, {c6('h','h_clamp')}, {c6('case when gx >= 0 and gy >= 0 and gx < nc-1 and gy < nr-1 then h end','h_null')} from smp""",
)

AZ, BANDS, STEP, REACH = 0.5, 20, 50.0, 150_000.0
N_AZ = 720


def posts(spark, sf):
    return view(spark, sf, "observers").selectExpr(
        "obs_id", "cast((obs_id*7) % 50 as double)*1000e0+250e0 as x", "cast((obs_id*11) % 40 as double)*1000e0+125e0 as y"
    )


def rays(spark, sf, observers=None):
    cells, grid = dem_grid(spark, sf, 1000.0)
    return hor.Rays(posts(spark, sf) if observers is None else observers, cells, grid, BANDS, REACH, STEP, AZ, eye=1.7, border="null", missing=0.0)


def place_rays(spark, sf):
    """The rays of each place that has observers, and the observers there."""
    places, members = hor.shared_places(posts(spark, sf))
    return rays(spark, sf, places), members


@query("horizon_profile")
def _(spark, sf):
    job, members = place_rays(spark, sf)
    return hor.for_members(rounded(hor.horizon_profile(job)), members)


def domes(spark, sf):
    """Written once: the peak rules read them several times, and the rays are cast for the first."""
    job, members = place_rays(spark, sf)
    return cut_lineage(hor.light_domes(job, view(spark, sf, "radiance_cells"))), members


@query("light_domes")
def _(spark, sf):
    d, members = domes(spark, sf)
    return hor.for_members(rounded(d), members)


@query("horizon_summary")
def _(spark, sf):
    job, members = place_rays(spark, sf)
    return hor.for_members(rounded(ter.horizon_summary(hor.horizon_profile(job), N_AZ)), members)


@query("dome_peaks")
def _(spark, sf):
    d, members = domes(spark, sf)
    both = ter.dome_peaks(d, N_AZ).withColumn("rule", F.lit("neighbour"))
    return hor.for_members(rounded(both.unionByName(ter.dome_peaks(d, N_AZ, "window").withColumn("rule", F.lit("window")))), members)


@query("cluster_peaks")
def _(spark, sf):
    d, members = domes(spark, sf)
    return hor.for_members(rounded(ter.cluster_peaks(ter.dome_peaks(d, N_AZ))), members)


@query("band_points")
def _(spark, sf):
    job, members = place_rays(spark, sf)
    return hor.for_members(rounded(ter.band_points(cut_lineage(hor.horizon_profile(job)), N_AZ, exaggeration=1.5)), members)


@query("profile_store")
def _(spark, sf):
    """Profiles are stored by place, beside the list of the observers there."""
    job, members = place_rays(spark, sf)
    path, own = scratch_dir(spark, "profiles"), scratch_dir(spark, "members")
    grids.write_profiles(hor.horizon_profile(job), path)
    members.write.parquet(own)
    return hor.for_members(rounded(grids.read_profiles(spark, path)), spark.read.parquet(own))


@query("ascii_grid")
def _(spark, sf):
    """The elevation raster as ASCII tiles of ten rows, written and read back."""
    cells, grid = dem_grid(spark, sf)
    path = scratch_dir(spark, "asc")
    cells = cells.withColumn("tile", F.floor(F.col("r") / 10).cast("int"))
    rows = cells.groupBy("tile", "r").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("a"))
    body = rows.select("tile", "r", F.array_join(F.transform("a", lambda q: q["h"].cast("string")), " ").alias("value"))
    size = cells.groupBy("tile").agg(F.countDistinct("r").cast("string").alias("n"))
    head = size.select(
        "tile",
        F.posexplode(
            F.array(
                F.lit(f"NCOLS {grid.ncols}"),
                F.concat(F.lit("NROWS "), F.col("n")),
                F.lit("XLLCORNER 0"),
                F.lit("YLLCORNER 0"),
                F.lit("CELLSIZE 1"),
                F.lit("NODATA_VALUE -9999"),
            )
        ).alias("i", "value"),
    ).select("tile", (F.col("i") - 6).alias("r"), "value")
    lines = head.unionByName(body).repartition("tile").sortWithinPartitions("tile", "r")
    lines.select("tile", "value").write.partitionBy("tile").text(path)
    back = grids.read_ascii_grid(spark, f"{path}/tile=*")
    tile = F.regexp_extract("path", r"tile=(\d+)", 1).cast("int")
    return rounded(back.select((tile * 10 + F.col("r")).alias("r"), "c", "h"))


oracle("ascii_grid", "dem_cells", f"select r, c, {c6('h','h')} from dem_cells")
