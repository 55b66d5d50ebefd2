"""Weather queries, batch and streaming, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.functions.angles import rounded
from nightgrid.operators import weather as wx
from nightgrid.plans.adapters import view
from nightgrid.plans.catalog_queries import scratch_dir
from nightgrid.plans.registry import c6, oracle, query
from nightgrid.sources.forecast import flatten_forecast
from nightgrid.streaming import weather as stream


@query("flatten_forecast")
def _(spark, sf):
    return rounded(flatten_forecast(view(spark, sf, "forecast_payloads")).drop("time"))


FLAT = """j as (select fetch_id, site, json_extract(payload,'$.properties.timeseries[0]') as t from forecast_payloads),
f0 as (select fetch_id, site, cast(json_extract_string(t,'$.time') as timestamp) as ts, cast(json_extract_string(t,'$.data.instant.details.cloud_area_fraction') as double) as cc,
 cast(json_extract_string(t,'$.data.instant.details.air_temperature') as double) as temp,
 cast(json_extract_string(t,'$.data.next_1_hours.details.precipitation_amount') as double) as a1, cast(json_extract_string(t,'$.data.next_6_hours.details.precipitation_amount') as double)/6e0 as a6,
 coalesce(json_extract_string(t,'$.data.next_1_hours.summary.symbol_code'),'') as s1 from j),
f1 as (select *, coalesce(a1,a6,0e0) as rate, greatest(0e0,least(1e0,cc/100e0)) as cover from f0),
flat as (select fetch_id, site, date_trunc('hour',ts) as slot_ts, year(ts) as year, dayofyear(ts)-1 as day_index, hour(ts) as hour, cover as cloud_low, temp as temperature_c, rate as precip_rate_mm_h,
 case when rate > 0.03e0 then greatest(cover,0.65e0+0.25e0*least(1e0,rate/6e0)) else cover end as cloud_cover,
 case when rate > 0.03e0 then case when temp <= 0.5e0 then 'snow' else 'rain' end else 'none' end as precipitation_type, least(1e0,rate/6e0) as precipitation_intensity,
 case when contains(s1,'thunder') then 0.35e0 else 0e0 end as thunder_probability from f1)"""
oracle(
    "flatten_forecast",
    "forecast_payloads",
    f"""{FLAT} select fetch_id, site, slot_ts, cast(year as int) as year, cast(day_index as int) as day_index, cast(hour as int) as hour, {c6('cloud_cover','cloud_cover')},
 {c6('cloud_low','cloud_low')}, {c6('cloud_low','cloud_mid')}, {c6('cloud_low','cloud_high')}, 0e0 as fog_cover, 0.75e0 as humidity, 2e0 as wind_speed_ms, 0e0 as wind_direction_deg,
 cast(null as double) as pressure_hpa, {c6('temperature_c','temperature_c')}, {c6('precip_rate_mm_h','precip_rate_mm_h')}, precipitation_type,
 {c6('precipitation_intensity','precipitation_intensity')}, {c6('thunder_probability','thunder_probability')} from flat""",
)


def records(spark, sf):
    rows = flatten_forecast(view(spark, sf, "forecast_payloads"))
    return rows.withColumn("fetched", F.col("slot_ts"))


@query("forecast_coverage")
def _(spark, sf):
    rows = view(spark, sf, "forecast_rows").selectExpr(
        "site", "cast(floor(event_id/40) as bigint) as fetch_id", "slot_ts as time", "fetched",
        "case when site < 4 then site * 1.5e0 end as lat", "site * 2e0 as lon",
    )
    as_of, target = F.lit("2024-01-05 06:00:00").cast("timestamp"), F.lit("2024-01-05").cast("date")
    return wx.forecast_coverage(rows, as_of, target, (3.0, 4.0))


oracle(
    "forecast_coverage",
    "forecast_rows",
    """c as (select site, cast(floor(event_id/40) as bigint) as fetch_id, min(slot_ts) as coverage_start, max(slot_ts) as coverage_end, max(fetched) as fetched_at, count(*) as n_slots, bool_and(site = 2) as here from forecast_rows group by 1,2)
select *, abs(floor(epoch(fetched_at))-epoch(timestamp '2024-01-05 06:00:00')) < 43200 as fresh, cast(coverage_start as date) <= date '2024-01-05' and date '2024-01-05' <= cast(coverage_end as date) as covers from c""",
)


def latest(spark, sf):
    rows = flatten_forecast(view(spark, sf, "forecast_payloads")).drop("time", "year", "day_index", "hour")
    return wx.latest_slots(rows, [-F.col("fetch_id")])


def lookups(spark, sf):
    return view(spark, sf, "observers").selectExpr("obs_id", "explode(sequence(0,47)) as k").selectExpr(
        "obs_id*48+k as req_id", "cast((obs_id+k) % 7 as bigint) as site", "2024 as year", "cast((obs_id*3+k) % 50 as int) as day_index",
        "cast((obs_id*5+k*7) % 24 as int) as hour", "timestamp '2024-01-08 09:00:00' as now_ts",
    )


@query("forecast_lookup")
def _(spark, sf):
    hit = wx.forecast_lookup(lookups(spark, sf), latest(spark, sf))
    return rounded(hit.select("req_id", "site", "slot_ts", "status", "cloud_cover", "precipitation_type", "temperature_c"))


LATEST = "lat as (select * from flat qualify row_number() over (partition by site, slot_ts order by fetch_id desc)=1)"
oracle(
    "forecast_lookup",
    "forecast_payloads observers",
    f"""{FLAT}, {LATEST}, cov as (select site, min(cast(slot_ts as date)) as d0, max(cast(slot_ts as date)) as d1 from lat group by 1),
rq as (select obs_id*48+k as req_id, (obs_id+k) % 7 as site, date '2024-01-01' + cast((obs_id*3+k) % 50 as int) as d, (obs_id*5+k*7) % 24 as h from observers, range(48) t(k)),
r2 as (select *, cast(d as timestamp)+to_hours(cast(h as int)) as slot_ts from rq),
m as (select r2.req_id, r2.site, r2.slot_ts, d, d0, d1, lat.site as found, cloud_cover, precipitation_type, temperature_c from r2 left join cov using (site) left join lat on lat.site=r2.site and lat.slot_ts=r2.slot_ts),
s as (select *, case when d < date '2024-01-08' or d > date '2024-01-18' then 'out_of_range' when d0 is null then 'cache_miss' when d < d0 or d > d1 then 'coverage_miss' when found is null then 'slot_miss' else 'remote_ok' end as status from m)
select req_id, site, slot_ts, status, {c6("case when status='remote_ok' then cloud_cover end",'cloud_cover')}, case when status='remote_ok' then precipitation_type end as precipitation_type,
 {c6("case when status='remote_ok' then temperature_c end",'temperature_c')} from s""",
)


def asked(spark, sf):
    """Readings as requests: they reach past the sites that have forecasts."""
    ev = view(spark, sf, "forecast_rows")
    return ev.selectExpr("event_id as req_id", "event_id % 7 as site", "fetched as req_ts")


def windy(spark, sf):
    """One reading per slot with a wind direction."""
    rows = view(spark, sf, "forecast_rows").selectExpr(
        "site", "slot_ts", "event_id", "value % 100 / 100e0 as cloud_cover", "(value*7) % 360 as wind_direction_deg", "event_type as precipitation_type"
    )
    return wx.latest_slots(rows, [-F.col("event_id")])


@query("interpolate_weather")
def _(spark, sf):
    return rounded(wx.interpolate_weather(asked(spark, sf), windy(spark, sf), ["cloud_cover", "wind_direction_deg"]).drop("req_ts"), 5)


WINDY = """wd as (select site, slot_ts, value % 100 / 100e0 as cc, (value*7) % 360 as wdir, event_type as pt from forecast_rows qualify row_number() over (partition by site, slot_ts order by event_id desc)=1),
rq as (select event_id as req_id, event_id % 7 as site, fetched as ts, date_trunc('hour', fetched) as s0 from forecast_rows),
ip as (select req_id, rq.site, ts, s0, (epoch_us(ts)-epoch_us(s0))/3.6e9 as t, a.cc as ca, b.cc as cb, a.wdir as wa, b.wdir as wb, a.pt as pa, b.pt as pb
 from rq left join wd a on a.site=rq.site and a.slot_ts=s0 left join wd b on b.site=rq.site and b.slot_ts=s0+interval 1 hour)"""
oracle(
    "interpolate_weather",
    "forecast_rows",
    f"""{WINDY}, x as (select *, wb-wa+180e0-360e0*floor((wb-wa+180e0)/360e0)-180e0 as dw from ip), y as (select *, wa+dw*t as mix from x)
select req_id, site, {c6('case when ca is null then cb when cb is null then ca else ca+(cb-ca)*t end','cloud_cover',5)},
 {c6('case when wa is null then wb when wb is null then wa else mix-360e0*floor(mix/360e0) end','wind_direction_deg',5)},
 case when pa is null then pb when pb is null then pa when t >= 0.5e0 then pb else pa end as precipitation_type from y""",
)


@query("weather_or_fallback")
def _(spark, sf):
    return rounded(wx.weather_or_fallback(asked(spark, sf), latest(spark, sf)).drop("req_ts"), 5)


def _noise(x: str, n: int) -> str:
    amp, freq, norm, parts = 1.0, 1.0, 0.0, []
    for _ in range(n):
        parts.append(f"{amp}e0*(sin(({x})*{freq * 0.01!r}e0)*0.5e0+0.5e0)")
        norm, amp, freq = norm + amp, amp * 0.5, freq * 2
    return f"(({'+'.join(parts)})/{norm}e0)"


CLIMATE = f"""c0 as (select i, i//24 as day, i%24 as hour, greatest(0e0,-sin((i//24)/365e0*{6.283185307179586}e0)) as w, {_noise('i',4)} as bn, {_noise('i+1000e0',2)} as roll, {_noise('i+2000e0',3)} as sn, {_noise('i+3000e0',3)} as rn from range(8760) t(i)),
c1 as (select *, case when hour < 6 or hour > 20 then 0.3e0 else 0.4e0 end*bn as base, case when roll < 0.2e0 then case when w > 0.5e0 and roll < 0.1e0 then 'snow' else 'rain' end else 'none' end as pt from c0),
c2 as (select *, case when pt='snow' then w*sn when pt='rain' then rn else 0e0 end as p from c1),
clim as (select day, hour, least(1e0,case when pt <> 'none' and p > 0 then greatest(base,0.8e0+p*0.2e0) else base end) as cloud_cover, pt as precipitation_type, least(1e0,p) as precipitation_intensity,
 least(1e0,case when pt='rain' and p > 0.6e0 then (p-0.6e0)*2.5e0 else 0e0 end) as thunder_probability from c2)"""
_MIX = ", ".join(
    c6(
        f"case when a.site is null and b.site is null then p.{f}+(q.{f}-p.{f})*t when a.site is null then b.{f} when b.site is null then a.{f} else a.{f}+(b.{f}-a.{f})*t end",
        f,
        5,
    )
    for f in wx.CLIMATE_FIELDS
)
oracle(
    "weather_or_fallback",
    "forecast_payloads forecast_rows",
    f"""{FLAT}, {LATEST}, {CLIMATE},
rq as (select event_id as req_id, event_id % 7 as site, fetched as ts, date_trunc('hour', fetched) as s0 from forecast_rows),
r2 as (select *, s0+interval 1 hour as s1, (epoch_us(ts)-epoch_us(s0))/3.6e9 as t from rq)
select req_id, r2.site, {_MIX}, case when a.site is null and b.site is null then case when t >= 0.5e0 then q.precipitation_type else p.precipitation_type end
 when a.site is null then b.precipitation_type when b.site is null then a.precipitation_type when t >= 0.5e0 then b.precipitation_type else a.precipitation_type end as precipitation_type,
 case when a.site is null and b.site is null then 'fallback' else 'remote' end as source
from r2 left join lat a on a.site=r2.site and a.slot_ts=s0 left join lat b on b.site=r2.site and b.slot_ts=s1
 join clim p on p.day=(dayofyear(s0)-1)%365 and p.hour=hour(s0) join clim q on q.day=(dayofyear(s1)-1)%365 and q.hour=hour(s1)""",
)


@query("weather_derived")
def _(spark, sf):
    w = latest(spark, sf).select("site", "slot_ts", "cloud_cover", "cloud_low", "cloud_mid", "cloud_high", "fog_cover", "humidity", "precipitation_intensity")
    return rounded(wx.weather_derived(w).select("site", "slot_ts", "optical_depth", "sun_dim", "share_low", "share_mid", "share_high"))


oracle(
    "weather_derived",
    "forecast_payloads",
    f"""{FLAT}, {LATEST}, d as (select *, greatest(greatest(0e0,(cloud_cover-0.55e0)/0.45e0), precipitation_intensity*1.2e0, 0e0) as dim from lat)
select site, slot_ts, {c6('0.05e0+2.75e0*pow(cloud_cover,1.15e0)','optical_depth')}, {c6('least(1e0,pow(dim,1.15e0))','sun_dim')},
 {c6('case when 3e0*cloud_low > 1e-6 then cloud_low/(cloud_low+cloud_low+cloud_low) else 0.5e0 end','share_low')}, {c6('case when 3e0*cloud_low > 1e-6 then cloud_low/(cloud_low+cloud_low+cloud_low) else 0.32e0 end','share_mid')},
 {c6('case when 3e0*cloud_low > 1e-6 then cloud_low/(cloud_low+cloud_low+cloud_low) else 0.18e0 end','share_high')} from d""",
)


@query("atmosphere_asof")
def _(spark, sf):
    ev = view(spark, sf, "forecast_rows")
    obs = ev.where("event_type = 'view'").selectExpr("event_id as obs_id", "site", "fetched as ts")
    metrics = ev.where("event_type = 'error'").selectExpr(
        "site", "fetched as ts", "value % 50 / 100e0 - 0.02e0 as aod", "case when event_id % 3 = 0 then 101000e0 when event_id % 3 = 1 then 990e0 end as pressure_hpa"
    )
    return rounded(wx.atmosphere_asof(obs, metrics).drop("ts"))


oracle(
    "atmosphere_asof",
    "forecast_rows",
    f"""m as (select site, fetched as ts, value % 50 / 100e0 - 0.02e0 as aod, case when event_id % 3 = 0 then 101000e0 when event_id % 3 = 1 then 990e0 end as p from forecast_rows where event_type='error'),
o as (select event_id as obs_id, site, fetched as ts from forecast_rows where event_type='view'),
a as (select obs_id, o.site, case when floor(epoch(o.ts))-floor(epoch(m.ts)) < 43200 then aod end as aod, case when floor(epoch(o.ts))-floor(epoch(m.ts)) < 43200 then case when p > 2000e0 then p/100e0 else p end end as pr
 from o asof left join m on o.site=m.site and o.ts >= m.ts),
b as (select obs_id, site, case when aod < 0 then 0e0 else aod end as aod, pr from a)
select obs_id, site, {c6('aod','aod')}, {c6('pr','pressure_hpa')}, {c6('case when aod is null or pr is null then 0.2e0 else 1.086e0*(aod+0.00879e0*(pr/1013.25e0)) end','k')}, aod is null or pr is null as fallback_used from b""",
)

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, sf):
    """The events file as a stream (file source)."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return src.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("site", F.col("user_id") % 5)


@query("forecast_stream")
def _(spark, sf):
    ev = event_stream(spark, sf)
    pay = view_stream_payloads(ev)
    rows = stream.forecast_rows_stream(pay).drop("time")
    out, ckpt = scratch_dir(spark, "slots"), scratch_dir(spark, "slots-ckpt")
    q = stream.write_latest_slots(rows, out, ckpt, availableNow=True)
    q.awaitTermination()
    table = stream.read_latest_slots(spark, out)
    return rounded(table.select("site", "slot_ts", "fetch_id", "cloud_cover", "precipitation_type", "temperature_c"))


def view_stream_payloads(ev):
    """Payload documents of the event stream, as the batch adapter builds them."""
    k = F.get_json_object("props", "$.k").cast("int")
    block = (
        F.when(F.col("event_type") == "click", '"next_1_hours":{"summary":{"symbol_code":"rainandthunder"},"details":{"precipitation_amount":2.5}}')
        .when(F.col("event_type") == "view", '"next_6_hours":{"summary":{"symbol_code":"snow"},"details":{"precipitation_amount":3}}')
        .otherwise('"next_12_hours":{}')
    )
    text = F.concat(
        F.lit('{"properties":{"timeseries":[{"time":"'),
        F.date_trunc("hour", "ts").cast("string"),
        F.lit('","data":{"instant":{"details":{"cloud_area_fraction":'),
        k.cast("string"),
        F.lit(',"air_temperature":'),
        (F.floor("value") % 30 - 10).cast("string"),
        F.lit("}},"),
        block,
        F.lit("}}]}}"),
    )
    return ev.select(F.col("event_id").alias("fetch_id"), "site", F.col("ts").alias("fetched"), text.alias("payload"))


oracle(
    "forecast_stream",
    "forecast_payloads",
    f"""{FLAT}, {LATEST} select site, slot_ts, fetch_id, {c6('cloud_cover','cloud_cover')}, precipitation_type, {c6('temperature_c','temperature_c')} from lat""",
)


@query("smooth_weather")
def _(spark, sf):
    ev = event_stream(spark, sf)
    readings = ev.select(
        "event_id", "site", "ts", (F.col("value") % 100 / 100.0).alias("cloud_cover"), (F.col("value") * 7 % 360).alias("wind_direction_deg")
    )
    out, ckpt = scratch_dir(spark, "smooth"), scratch_dir(spark, "smooth-ckpt")
    stream.write_smoothed(readings, ["cloud_cover", "wind_direction_deg"], out, ckpt, availableNow=True).awaitTermination()
    return rounded(stream.read_smoothed(spark, out).select("event_id", "site", "ts", "cloud_cover", "wind_direction_deg"))


@query("windowed_observations_stream")
def _(spark, sf):
    win = stream.windowed_observations(event_stream(spark, sf), "3 hours", "1 hour")
    out, ckpt = scratch_dir(spark, "windows"), scratch_dir(spark, "windows-ckpt")
    stream.write_windows(win, out, ckpt, availableNow=True).awaitTermination()
    return rounded(stream.read_windows(spark, out))


@query("windowed_observations")
def _(spark, sf):
    rows = view(spark, sf, "forecast_rows").selectExpr("site", "cast(fetched as timestamp) as ts", "value")
    return rounded(stream.windowed_observations(rows, "3 hours", "1 hour"))


for _name in ("windowed_observations", "windowed_observations_stream"):
    oracle(
        _name,
        "forecast_rows",
        f"""w as (select site, date_trunc('hour', fetched)-to_hours(cast(k as int)) as win_start, value from forecast_rows, range(3) t(k))
select site, win_start, win_start+interval 3 hour as win_end, {c6('avg(value)','mean_value')}, count(*) as n from w group by 1,2""",
    )
