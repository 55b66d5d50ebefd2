"""Views that give the driver tables the shape of the library's inputs.

Each view is one SQL text that Spark and DuckDB both run, so a query and its
oracle start from equal rows.  `stars` differs in one place: the ingest order
is a global row number in the oracle and a sortable struct in Spark, which
needs no single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STAR_COLUMNS = """source_id, raw - 360e0*floor(raw/360e0) as ra, dec, mag, bp_rp, seq from (
 select l_orderkey*10+l_linenumber as source_id,
  cast(l_partkey as double)*137.50776405e0 + cast(l_suppkey as double)*0.618034e0 + cast(l_linenumber as double)*0.01e0 as raw,
  degrees(asin(2e0*(cast((l_orderkey*7919+l_linenumber*104729) % 100003 as double)/100003e0)-1e0)) as dec,
  round(21e0-3.6e0*log10(l_extendedprice),3) as mag,
  case when l_quantity = 13e0 then null else round(l_discount*30e0-0.5e0,2) end as bp_rp,"""
_ORDER = "l_orderkey,l_linenumber,l_shipdate,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_discount,l_tax"

STARS_DUCK = f"select {_STAR_COLUMNS} row_number() over (order by {_ORDER}) as seq from lineitem) t"
STARS_SPARK = f"select {_STAR_COLUMNS} struct({_ORDER}) as seq from {{lineitem}}) t"

VIEWS = {
    "raw_stars": """select cast(l_orderkey*10+l_linenumber as varchar(20)) as id, cast(l_partkey % 360 as varchar(20)) as raj2000,
 case when l_quantity = 7e0 then 'bad' when l_quantity = 8e0 then '' else cast(l_suppkey % 90 as varchar(20)) end as dej2000,
 case when l_quantity = 9e0 then 'NaN' when l_quantity = 10e0 then '' else cast(l_linenumber as varchar(20)) end as g_mag from lineitem""",
    "observers": """select s_suppkey as obs_id, cast(s_nationkey as double)*5e0-60e0 as lat, cast((s_suppkey*37) % 360 as double)-180e0 as lon,
 cast(1+s_suppkey % 9 as double) as bortle, 2024 as year, cast((s_suppkey*11) % 365 as int) as doy, cast((s_suppkey*5) % 24 as double) as ut_hour from supplier""",
    "dem_cells": """select cast(floor(p_partkey/50e0) as int) as r, cast(p_partkey % 50 as int) as c, 200e0+p_size*20e0 as h from part""",
    "radiance_cells": """select cast(floor(o_orderkey/100e0) as int) as r, cast(o_orderkey % 100 as int) as c,
 case when o_orderpriority = '5-LOW' then -1e0 when o_orderstatus = 'P' then 2e10 else o_totalprice/1e4 end as v from orders""",
    "sqm_samples": """select c_custkey as sample_id, abs(c_acctbal)/100e0 as agg_dvnl, cast((c_custkey*13) % 3000 as double) as elevation_m,
 22e0-2.4e0*log10(abs(c_acctbal)/100e0+0.001e0)+0.05e0*cast((c_custkey*13) % 3000 as double)/1000e0 + (cast(c_nationkey as double)-12e0)*0.01e0 as sqm from customer""",
    "forecast_rows": """select event_id, user_id % 5 as site, date_trunc('hour', ts) as slot_ts, ts as fetched, value, event_type, props from events""",
    "deep_sky_raw": """select case when p_partkey % 7 = 0 then 'IC ' else 'NGC ' end || lpad(cast(p_partkey as varchar(10)),4,'0') as name,
 lpad(cast(p_partkey % 24 as varchar(4)),2,'0') || ':' || lpad(cast(p_partkey % 60 as varchar(4)),2,'0') || ':30.0' as ra_txt,
 case when p_partkey % 2 = 0 then '+' else '-' end || lpad(cast(p_partkey % 90 as varchar(4)),2,'0') || ':15:00' as dec_txt,
 p_type as obj_type, case when p_size % 5 = 0 then null else cast(p_size as double)/4e0 end as v_mag, cast(p_size as double) as maj_arcmin, p_name as common_names,
 case when p_partkey between 1 and 110 then p_partkey end as m from part""",
    "nodes": """select conv_id as group_id, turn as pos, cast((conv_id*53+turn*7) % 360 as double) as ra_deg, cast((conv_id*31+turn*11) % 180 as double)-90e0 as dec_deg, turn > 0 as connect_from_prev from conversations""",
    "forecast_payloads": """select event_id as fetch_id, user_id % 5 as site, '{"properties":{"timeseries":[{"time":"' || cast(date_trunc('hour', ts) as varchar(30)) || '","data":{"instant":{"details":{"cloud_area_fraction":' || cast(cast(json_k as int) as varchar(10)) || ',"air_temperature":' || cast(cast(floor(value) % 30 as int) - 10 as varchar(10)) || '}},' ||
 case when event_type = 'click' then '"next_1_hours":{"summary":{"symbol_code":"rainandthunder"},"details":{"precipitation_amount":2.5}}' when event_type = 'view' then '"next_6_hours":{"summary":{"symbol_code":"snow"},"details":{"precipitation_amount":3}}' else '"next_12_hours":{}' end || '}}]}}' as payload from (select *, replace(replace(props,'{"k": ',''),'}','') as json_k from events) e""",
    "measures": """select o_orderkey as measure_id, case when o_orderkey % 4 = 0 then 'ruler' when o_orderkey % 4 = 1 then 'circle' when o_orderkey % 4 = 2 then 'square' else 'rectangle' end as tool,
 cast(o_orderkey % 140 as double)-70e0 as a_alt, cast((o_orderkey*17) % 360 as double) as a_az, cast(o_orderkey % 140 as double)-70e0+1e0+cast(o_custkey % 8 as double) as b_alt, cast((o_orderkey*17) % 360 as double)+1e0+cast(o_custkey % 11 as double) as b_az, cast(o_orderkey % 45 as double) as rot_deg from orders""",
    "instruments": """select c_custkey as inst_id, 30e0+cast(c_custkey % 270 as double) as aperture_mm, 100e0+cast((c_custkey*7) % 2400 as double) as focal_mm, 4e0+cast(c_custkey % 28 as double) as eyepiece_mm,
 100e0*pow(2e0,cast(c_custkey % 8 as double)) as iso, 0.5e0*cast(1+c_custkey % 60 as double) as exposure_s, case when c_mktsegment='FURNITURE' then 'camera_full_frame' when c_mktsegment='BUILDING' then 'camera_aps_c' else 'telescope' end as profile from customer""",
}

MAP_SPARK = "select vec_id as r, pos as c, round(cast(x as double),6) as v from {embeddings} lateral view posexplode(embedding) t as pos, x"
MAP_DUCK = "select vec_id as r, unnest(range(64)) as c, round(cast(unnest(embedding) as double),6) as v from embeddings"

TABLES = (
    "lineitem supplier part orders customer events conversations embeddings nation region "
    "documents pages benchmark labels"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter view `name` as a DataFrame."""
    if name == "stars":
        return spark.sql(STARS_SPARK, lineitem=table(spark, sf_dir, "lineitem"))
    if name == "map_cells":
        return spark.sql(MAP_SPARK, embeddings=table(spark, sf_dir, "embeddings"))
    text = VIEWS[name]
    src = next(t for t in TABLES if f"from {t}" in text)
    # braces of JSON literals must survive the argument substitution
    safe = text.replace("{", "{{").replace("}", "}}").replace(f"from {src}", f"from {{{src}}}")
    return spark.sql(safe, **{src: table(spark, sf_dir, src)})


def oracle_ctes(*names: str) -> str:
    """`WITH` list for a DuckDB oracle (comma-terminated pieces joined)."""
    parts = []
    for n in names:
        text = STARS_DUCK if n == "stars" else MAP_DUCK if n == "map_cells" else VIEWS[n]
        parts.append(f"{n} as materialized ({text})")
    return ",\n".join(parts)
