"""Catalogue and sky-table queries over the driver tables, with oracles."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nightgrid.functions.angles import rounded
from nightgrid.operators import catalog as cat
from nightgrid.plans.adapters import table, view
from nightgrid.plans.registry import c6, oracle, query
from nightgrid.sources import stars as src

COLS = ["source_id", "ra", "dec", "mag", "bp_rp"]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a written table: shared on a cluster, local in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/nightgrid-{name}-{os.urandom(6).hex()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), name)


def raw_stars(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("source_file", F.col("_metadata.file_name"))
    return li.selectExpr(
        "cast(l_orderkey*10+l_linenumber as string) as id",
        "cast(l_partkey % 360 as string) as raj2000",
        "case when l_quantity = 7e0 then 'bad' when l_quantity = 8e0 then '' else cast(l_suppkey % 90 as string) end as dej2000",
        "case when l_quantity = 9e0 then 'NaN' when l_quantity = 10e0 then '' else cast(l_linenumber as string) end as g_mag",
        "source_file",
    )


@query("star_table_roundtrip")
def _(spark, sf):
    path = scratch_dir(spark, "csv")
    raw_stars(spark, sf).drop("source_file").write.option("header", True).option("sep", ";").csv(path)
    df = cat.normalize_catalog(src.read_star_tables(spark, [path]))
    return rounded(df.select("source_id", "ra", "dec", F.col("mag").cast("double").alias("mag")))


GOOD = """good as (select cast(id as bigint) as source_id, cast(raj2000 as double) as ra, try_cast(dej2000 as double) as dec,
  try_cast(g_mag as double) as mag from raw_stars),
kept as (select * from good where dec is not null and mag is not null and not isnan(mag))"""
oracle("star_table_roundtrip", "raw_stars", f"{GOOD} select source_id, ra, dec, mag from kept")


@query("normalize_catalog")
def _(spark, sf):
    df = cat.normalize_catalog(raw_stars(spark, sf))
    return df.select("source_id", "ra", "dec", F.col("mag").cast("double").alias("mag"), F.round(F.col("bp_rp").cast("double"), 3).alias("bp_rp"))


oracle("normalize_catalog", "raw_stars", f"{GOOD} select source_id, ra, dec, mag, 0.8e0 as bp_rp from kept")


@query("ingest_report")
def _(spark, sf):
    return cat.ingest_report(raw_stars(spark, sf))


oracle(
    "ingest_report",
    "raw_stars",
    """t as (select *, case when try_cast(dej2000 as double) is null then 'dec'
       when try_cast(g_mag as double) is null or isnan(try_cast(g_mag as double)) then 'mag' end as why from raw_stars)
select 'lineitem.parquet' as source_file, count(*) as rows_read, count(*) filter (where why is null) as rows_kept,
 count(*) filter (where why='ra') as rejected_ra, count(*) filter (where why='dec') as rejected_dec,
 count(*) filter (where why='mag') as rejected_mag from t""",
)


@query("union_catalogs")
def _(spark, sf):
    a = cat.normalize_catalog(raw_stars(spark, sf)).select("source_id", "ra", "dec", F.col("mag").cast("double").alias("mag"))
    b = view(spark, sf, "stars").select(*COLS)
    both = cat.union_catalogs([a, b])
    return rounded(
        both.groupBy(F.col("bp_rp").isNull().alias("no_color"), F.floor("mag").alias("mag_floor")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("mag").alias("min_mag"), F.max("dec").alias("max_dec")
        )
    )


oracle(
    "union_catalogs",
    "raw_stars stars",
    f"""{GOOD}, u as (select source_id, ra, dec, mag, null::double as bp_rp from kept
  union all select source_id, ra, dec, mag, bp_rp from stars)
select bp_rp is null as no_color, cast(floor(mag) as bigint) as mag_floor, count(*) as n_rows,
 {c6('min(mag)', 'min_mag')}, {c6('max(dec)', 'max_dec')} from u group by 1, 2""",
)


def with_idless(stars):
    """Every 11th order loses its id, so that id-less rows are present."""
    sid = F.when(F.col("source_id") % 11 != 0, F.col("source_id"))
    return stars.withColumn("source_id", sid)


IDLESS = "s as (select case when source_id % 11 <> 0 then source_id end as source_id, ra, dec, mag, bp_rp, seq from stars)"


@query("dedupe_first")
def _(spark, sf):
    stars = with_idless(view(spark, sf, "stars"))
    return rounded(cat.dedupe_first(stars, [F.col("seq")]).select(*COLS))


oracle(
    "dedupe_first",
    "stars",
    f"""{IDLESS}, k as (select * from s where source_id is not null qualify row_number() over (partition by source_id order by seq)=1
  union all select * from s where source_id is null)
select source_id, {c6('ra','ra')}, {c6('dec','dec')}, {c6('mag','mag')}, {c6('bp_rp','bp_rp')} from k""",
)


def _halves(stars):
    """Even order keys are the base, odd ones (renumbered to collide) the supplement."""
    base = stars.where(F.col("seq.l_orderkey") % 2 == 0)
    extra = stars.where(F.col("seq.l_orderkey") % 2 == 1).withColumn("source_id", F.col("source_id") - 10)
    return base, extra


HALVES = """base as (select * from stars where cast(floor(source_id/10e0) as bigint) % 2 = 0),
extra as (select source_id-10 as source_id, ra, dec, mag, bp_rp, seq from stars where cast(floor(source_id/10e0) as bigint) % 2 = 1)"""


@query("fuse_brightest")
def _(spark, sf):
    return rounded(cat.fuse_brightest(*_halves(view(spark, sf, "stars"))).select(*COLS))


oracle(
    "fuse_brightest",
    "stars",
    f"""{HALVES}, u as (select *, 0 as src from base union all select *, 1 as src from extra),
k as (select * from u qualify source_id <= 0 or row_number() over (partition by source_id order by mag, src, seq)=1)
select source_id, {c6('ra','ra')}, {c6('dec','dec')}, {c6('mag','mag')}, {c6('bp_rp','bp_rp')} from k""",
)


@query("insert_supplement")
def _(spark, sf):
    return rounded(cat.insert_supplement(*_halves(view(spark, sf, "stars"))).select(*COLS, "is_base"))


oracle(
    "insert_supplement",
    "stars",
    f"""{HALVES}, u as (select *, 0 as is_base from extra where source_id > 0
   qualify row_number() over (partition by source_id order by mag, seq)=1
 union all select *, 0 from extra where not source_id > 0 union all select *, 1 from base)
select source_id, {c6('ra','ra')}, {c6('dec','dec')}, {c6('mag','mag')}, {c6('bp_rp','bp_rp')}, is_base from u""",
)


@query("magnitude_slice")
def _(spark, sf):
    return rounded(cat.magnitude_slice(view(spark, sf, "stars"), 4.0, 8.0).select(*COLS))


oracle(
    "magnitude_slice",
    "stars",
    f"""select source_id, {c6('ra','ra')}, {c6('dec','dec')}, {c6('mag','mag')}, {c6('bp_rp','bp_rp')}
 from stars where mag > 4e0 and mag <= 8e0""",
)


@query("magnitude_top")
def _(spark, sf):
    top = cat.magnitude_slice(view(spark, sf, "stars").select("source_id", "mag"), None, 30.0, limit=500)
    return rounded(top)


oracle("magnitude_top", "stars", f"select source_id, {c6('mag','mag')} from (select * from stars where mag <= 30e0 order by mag, source_id limit 500) t")


def _batches(spark, sf):
    return cat.plan_magnitude_batches(
        view(spark, sf, "stars"), lo=1.0, hi=12.0, step=0.5, max_rows=800, min_span=0.1, floor_rows=400
    )


@query("plan_magnitude_batches")
def _(spark, sf):
    return rounded(_batches(spark, sf))


# ranges of 0.5, halved while they hold more than 800 rows and span over 0.2
BATCHES = """n0 as (select 1e0+i*0.5e0 as lo, 1.5e0+i*0.5e0 as hi from range(22) t(i)),
leafs as (select lo + j*0.125e0 as lo, lo + (j+1)*0.125e0 as hi, lo as lo0, lo+0.25e0*floor(j/2e0) as lo1, lo+0.25e0*floor(j/2e0)+0.25e0 as hi1, hi as hi0 from n0, range(4) u(j)),
lc as (select l.lo, l.hi, any_value(lo0) as lo0, any_value(hi0) as hi0, any_value(lo1) as lo1, any_value(hi1) as hi1, count(s.mag) as n
  from leafs l left join stars s on s.mag > l.lo and s.mag <= l.hi group by 1, 2),
t as (select *, sum(n) over (partition by lo0) as n0, sum(n) over (partition by lo1) as n1 from lc),
b as (select case when n0 <= 800 then lo0 when n1 <= 800 then lo1 else lo end as a,
  case when n0 <= 800 then hi0 when n1 <= 800 then hi1 else hi end as z, n from t),
batches as (select a as mag_min_exclusive, z as mag_max, cast(sum(n) as bigint) as rows_estimate from b group by 1,2 having sum(n) > 0)"""
oracle("plan_magnitude_batches", "stars", f"{BATCHES} select {c6('mag_min_exclusive','mag_min_exclusive')}, {c6('mag_max','mag_max')}, rows_estimate from batches")


@query("batch_report")
def _(spark, sf):
    manifest = _batches(spark, sf)
    landed = view(spark, sf, "stars").where((F.col("mag") <= 7.0) | (F.col("dec") > -60.0))
    return rounded(cat.batch_report(manifest, cat.batch_counts(landed, manifest)))


oracle(
    "batch_report",
    "stars",
    f"""{BATCHES}, imp as (select b.*, (select count(*) from stars s where s.mag > b.mag_min_exclusive and s.mag <= b.mag_max and (s.mag <= 7e0 or s.dec > -60e0)) as imported_rows from batches b),
d as (select *, imported_rows >= rows_estimate*0.98e0 as completed from imp),
tot as (select *, cast(sum(rows_estimate) over () as bigint) as total_rows,
  cast(sum(case when completed then rows_estimate else 0 end) over () as bigint) as completed_rows, sum(imported_rows) over () as got from d)
select {c6('mag_min_exclusive','mag_min_exclusive')}, {c6('mag_max','mag_max')}, rows_estimate, imported_rows, completed, total_rows, completed_rows,
 {c6('round_even(100e0*completed_rows/total_rows,3)','progress_percent')}, {c6('got/total_rows','import_ratio')},
 got/total_rows < 0.98e0 as rejected from tot""",
)


@query("star_colors")
def _(spark, sf):
    stars = view(spark, sf, "stars").select("source_id", "seq", "bp_rp")
    df = cat.star_colors(stars, desaturate=0.30)
    return df.groupBy("bp_rp", "r", "g", "b", "nr", "ng", "nb").agg(F.count(F.lit(1)).alias("n_rows"))


def _node_sql(ch: int) -> str:
    parts = []
    for lo, hi in zip(cat.COLOR_NODES, cat.COLOR_NODES[1:]):
        parts.append(
            f"when v <= {hi[0]}e0 then round_even({lo[ch]}e0+({hi[ch]-lo[ch]}e0)*((v-({lo[0]}e0))/({hi[0]-lo[0]}e0)),0)"
        )
    base = f"case when v <= -0.5e0 then {cat.COLOR_NODES[0][ch]}e0 {' '.join(parts)} else {cat.COLOR_NODES[-1][ch]}e0 end"
    return f"cast(round_even({base}+({cat.PALE[ch-1]}e0-{base})*0.3e0,0) as int)"


oracle(
    "star_colors",
    "stars",
    f"""t as (select bp_rp, coalesce(bp_rp,0.8e0) as v from stars),
u as (select bp_rp, v, case when v <= 0e0 then 175 when v <= 0.5e0 then floor(175e0+60e0*(v/0.5e0)) else 255 end as r,
 case when v <= 0e0 then floor(greatest(187e0,least(223e0,205e0+v*36e0))) when v <= 0.5e0 then floor(205e0+33e0*(v/0.5e0))
  when v <= 1e0 then floor(238e0+6e0*((v-0.5e0)/0.5e0)) when v <= 1.6e0 then floor(244e0-32e0*((v-1e0)/0.6e0))
  else floor(212e0-38e0*least(1e0,(v-1.6e0)/0.9e0)) end as g,
 case when v <= 0.5e0 then 255 when v <= 1e0 then floor(255e0-41e0*((v-0.5e0)/0.5e0))
  when v <= 1.6e0 then floor(214e0-64e0*((v-1e0)/0.6e0)) else floor(150e0-30e0*least(1e0,(v-1.6e0)/0.9e0)) end as b from t)
select bp_rp, cast(r as int) as r, cast(g as int) as g, cast(b as int) as b, {_node_sql(1)} as nr, {_node_sql(2)} as ng, {_node_sql(3)} as nb,
 count(*) as n_rows from u group by all""",
)


@query("rank_by_magnitude")
def _(spark, sf):
    stars = view(spark, sf, "stars").select("source_id", "mag", "seq")
    return rounded(cat.rank_by_magnitude(stars, [F.col("seq")]).select("source_id", "mag", "position"))


oracle("rank_by_magnitude", "stars", f"select source_id, {c6('mag','mag')}, row_number() over (order by mag, source_id, seq)-1 as position from stars")

LIMITS = (3.0, 4.5, 6.0, 8.0, 10.0)


@query("limit_positions")
def _(spark, sf):
    return cat.limit_positions(view(spark, sf, "stars"), LIMITS)


oracle("limit_positions", "stars", "select l.x as mag_limit, count(*) filter (where mag <= l.x) as star_count from stars, (values (3e0),(4.5e0),(6e0),(8e0),(10e0)) l(x) group by 1")


@query("catalog_store")
def _(spark, sf):
    path = scratch_dir(spark, "catalog")
    src.write_catalog(view(spark, sf, "stars").select(*COLS), path)
    return rounded(src.read_catalog(spark, path, max_mag=8.0, min_mag_exclusive=4.5))


oracle(
    "catalog_store",
    "stars",
    f"""select source_id, {c6('ra','ra')}, {c6('dec','dec')}, {c6('mag','mag')}, {c6('bp_rp','bp_rp')} from stars
 where mag <= 8e0+1e-6 and mag > 4.5e0+1e-6""",
)


WINDOW = (355.0, 12.0, 14.0, 11.0, 11.0)  # right ascension, declination, half sizes, faintest magnitude


@query("sky_store")
def _(spark, sf):
    """A window over the circle's end from the store that is ordered along a sky curve."""
    path = scratch_dir(spark, "sky-store")
    src.write_sky_catalog(view(spark, sf, "stars").select(*COLS), path)
    return rounded(src.read_sky_window(spark, path, *WINDOW).select(*COLS))


oracle(
    "sky_store",
    "stars",
    f"""select source_id, {c6('ra','ra')}, {c6('dec','dec')}, {c6('mag','mag')}, {c6('bp_rp','bp_rp')} from stars
 where mag <= 11e0 and abs(dec-12e0) <= 11e0 and abs(ra-355e0+180e0-360e0*floor((ra-355e0+180e0)/360e0)-180e0) <= 14e0""",
)

JSON_ROWS = 20_000  # ids of one document


def write_star_json(stars, path: str) -> None:
    """Documents in three shapes by id: metadata and rows, a list of objects, a list of rows."""
    text = {c: F.col(c).cast("string") for c in COLS}
    none = F.lit(None).cast("string")
    shape, group = F.pmod("source_id", F.lit(3)), F.floor(F.col("source_id") / JSON_ROWS)
    objects = F.to_json(F.struct(*[v.alias({"mag": "phot_g_mean_mag"}.get(c, c)) for c, v in text.items()]))
    named = F.to_json(F.array(*[text[c] for c in COLS]))
    plain = F.to_json(F.array(text["source_id"], none, text["ra"], text["dec"], text["mag"], none, none, text["bp_rp"]))
    names = ", ".join(f'{{"name": "{c}"}}' for c in COLS)
    line = F.when(shape == 0, named).when(shape == 1, objects).otherwise(plain)
    lines = stars.select(shape.alias("shape"), group.alias("file"), F.struct("source_id", line.alias("line")).alias("row"))
    # at most JSON_ROWS ids meet in one document
    docs = lines.groupBy("shape", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"]), ",\n").alias("body"))
    head = F.when(F.col("shape") == 0, f'{{"metadata": [{names}], "data": [').otherwise("[")
    tail = F.when(F.col("shape") == 0, "]}").otherwise("]")
    docs.select("shape", "file", F.concat(head, "body", tail).alias("value")).write.partitionBy("shape", "file").text(path)


@query("star_json")
def _(spark, sf):
    """The stars written as JSON documents of all shapes and read back."""
    path = scratch_dir(spark, "star-json")
    write_star_json(view(spark, sf, "stars").select(*COLS), path)
    back = src.read_star_json(spark, [f"{path}/shape=*/file=*"])
    return rounded(back.select(F.col("source_id").cast("long").alias("source_id"), *[F.col(c).cast("double").alias(c) for c in COLS if c != "source_id"]))


oracle("star_json", "stars", f"select source_id, {c6('ra','ra')}, {c6('dec','dec')}, {c6('mag','mag')}, {c6('bp_rp','bp_rp')} from stars")


@query("catalog_manifest")
def _(spark, sf):
    scan = table(spark, sf, "lineitem").withColumn("mag", F.col("l_extendedprice"))
    return rounded(src.catalog_manifest(scan).select("file_name", "n_rows", "min_mag", "max_mag"))


oracle("catalog_manifest", "", f"select 'lineitem.parquet' as file_name, count(*) as n_rows, {c6('min(l_extendedprice)','min_mag')}, {c6('max(l_extendedprice)','max_mag')} from lineitem")
