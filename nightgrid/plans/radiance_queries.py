"""Light-pollution queries over the radiance raster, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.functions.angles import rounded
from nightgrid.operators import radiance as rad
from nightgrid.plans.adapters import view
from nightgrid.plans.registry import c6, oracle, query
from nightgrid.plans.search_queries import K, cd, sd

GAUSS = rad.gaussian_kernel(1.5, 3.0, 1.0)
POWER = rad.power_law_kernel(2.0, 1.0, 50.0, 4.0, 1.0)
# the whole job: weights reach 200 cells, tiles of 1024
WIDE_GAUSS = (30.0, 200.0, 1.0)
WIDE_POWER = (2.0, 1.0, 50.0, 200.0, 1.0)
CLEAN = {
    "raster": "case when v = -1e0 or v > 1e10 then null else v end",
    "point": "case when v < 0e0 or v > 1e6 then null else v end",
    "region": "case when v < 0e0 or v > 1e10 then 0e0 else v end",
}


@query("clean_cells")
def _(spark, sf):
    cells = view(spark, sf, "radiance_cells")
    parts = [rad.clean_cells(cells, r, nodata=-1.0 if r == "raster" else None).withColumn("rule", F.lit(r)) for r in CLEAN]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(df)


oracle(
    "clean_cells",
    "radiance_cells",
    " union all ".join(f"select r, c, {c6(e,'v')}, '{n}' as rule from radiance_cells" for n, e in CLEAN.items()),
)


def clean(spark, sf):
    return rad.clean_cells(view(spark, sf, "radiance_cells"), "raster", nodata=-1.0)


def conv_sql(weight: str, reach: float) -> str:
    n = int(reach)
    return f"""z as (select r, c, {CLEAN['raster']} as v from radiance_cells),
k0 as (select a.i-{n} as dr, b.i-{n} as dc, sqrt((a.i-{n})*(a.i-{n})+(b.i-{n})*(b.i-{n})) as d from range({2*n+1}) a(i), range({2*n+1}) b(i)),
k1 as (select *, {weight} as w from k0 where d <= {reach}e0), k as (select dr, dc, w/sum(w) over () as w from k1),
cv as (select t.r, t.c, sum(k.w*coalesce(s.v,0e0)) as v from z t, k left join z s on s.r = t.r+k.dr and s.c = t.c+k.dc group by 1,2)"""


GAUSS_SQL = conv_sql("exp(-(d*d)/4.5e0)", 3.0)
POWER_SQL = conv_sql("pow(1e0/(d+1e0),2e0)*exp(-d/50e0)", 4.0)


@query("convolve_gaussian")
def _(spark, sf):
    return rounded(rad.convolve_cells(clean(spark, sf), GAUSS))


@query("convolve_power_law")
def _(spark, sf):
    return rounded(rad.convolve_cells(clean(spark, sf), POWER))


@query("convolve_tiled")
def _(spark, sf):
    return rounded(rad.convolve_tiled(clean(spark, sf), POWER, tile=32))


@query("convolve_gaussian_wide")
def _(spark, sf):
    return rounded(rad.convolve_cells(clean(spark, sf), rad.gaussian_kernel(*WIDE_GAUSS)))


@query("convolve_power_law_wide")
def _(spark, sf):
    return rounded(rad.convolve_cells(clean(spark, sf), rad.power_law_kernel(*WIDE_POWER)))


oracle("convolve_gaussian", "radiance_cells", f"{GAUSS_SQL} select r, c, {c6('v','v')} from cv")
oracle("convolve_power_law", "radiance_cells", f"{POWER_SQL} select r, c, {c6('v','v')} from cv")
oracle("convolve_tiled", "radiance_cells", f"{POWER_SQL} select r, c, {c6('v','v')} from cv")


def sites(spark, sf):
    return view(spark, sf, "observers").selectExpr(
        "obs_id as point_id", "cast((obs_id*37) % 110 as double)+0.25e0 as x", "cast((obs_id*53) % 160 as double)+0.75e0 as y"
    )


SITES = "p as (select obs_id as point_id, (obs_id*37) % 110 as pc, (obs_id*53) % 160 as pr from observers)"
SQM_CLASS = """case when sqm >= 21.99e0 then 1 when sqm >= 21.89e0 then 2 when sqm >= 21.69e0 then 3 when sqm >= 20.49e0 then 4 when sqm >= 19.5e0 then 5
 when sqm >= 18.94e0 then 6 when sqm >= 18.38e0 then 7 when sqm >= 17.8e0 then 8 else 9 end"""


@query("zenith_sqm")
def _(spark, sf):
    return rounded(rad.zenith_sqm(sites(spark, sf), view(spark, sf, "radiance_cells"), GAUSS))


oracle(
    "zenith_sqm",
    "radiance_cells observers",
    f"""{GAUSS_SQL}, {SITES}, zv as (select r, c, {CLEAN['point']} as v from radiance_cells),
j as (select point_id, k.w, zv.v from p, k join zv on zv.r = pr+dr and zv.c = pc+dc where zv.v is not null),
a as (select point_id, case when sum(w) < 1e-6 then avg(v) else sum(w*v)/sum(w) end as m from j group by 1),
q as (select point_id, greatest(16e0,least(22e0,22e0-2.5e0*log10(greatest(m,1e-5)+0.001e0))) as sqm from a)
select p.point_id, {c6('coalesce(sqm,21e0)','sqm')}, case when sqm is null then 4 else {SQM_CLASS} end as bortle from p left join q using (point_id)""",
)


@query("radiance_at")
def _(spark, sf):
    return rounded(rad.radiance_at(sites(spark, sf), view(spark, sf, "radiance_cells")).select("point_id", "radiance"))


oracle(
    "radiance_at",
    "radiance_cells observers",
    f"""{SITES}, z as (select r, c, {CLEAN['region']} as v from radiance_cells)
select point_id, {c6('coalesce(v,0e0)','radiance')} from p left join z on r = pr and c = pc""",
)


def modelled(spark, sf):
    """Convolved radiance with an elevation, turned into SQM by a fixed model."""
    agg = rad.convolve_cells(clean(spark, sf), GAUSS).withColumnRenamed("v", "agg_dvnl")
    agg = agg.withColumn("elevation_m", ((F.col("r") * 13 + F.col("c") * 7) % 3000).cast("double"))
    return rad.predict_sqm(agg, {"a": 22.0, "b": -2.4, "c": 0.05, "eps": 1e-3})


MODEL = f"""{GAUSS_SQL}, pr as (select r, c, 22e0-2.4e0*log10(v+0.001e0)+0.05e0*(cast((r*13+c*7) % 3000 as double)/1000e0) as sqm from cv)"""


@query("predict_sqm")
def _(spark, sf):
    return rounded(modelled(spark, sf).select("r", "c", "sqm_pred"))


oracle("predict_sqm", "radiance_cells", f"{MODEL} select r, c, {c6('sqm','sqm_pred')} from pr")


@query("bortle_classes")
def _(spark, sf):
    return rounded(rad.bortle_classes(modelled(spark, sf).withColumnRenamed("sqm_pred", "sqm")))


oracle("bortle_classes", "radiance_cells", f"{MODEL} select {SQM_CLASS} as bortle, count(*) as n_cells, {c6('count(*)/sum(count(*)) over ()','share')} from pr group by 1")


@query("mlim_map")
def _(spark, sf):
    m = rad.mlim_map(modelled(spark, sf).withColumnRenamed("sqm_pred", "sqm"), altitude=35.0, k=0.25)
    return rounded(m.select("r", "c", "bortle", "mlim"))


oracle(
    "mlim_map",
    "radiance_cells",
    f"""{MODEL}, b as (select r, c, {SQM_CLASS} as bortle from pr)
select r, c, bortle, {c6(f"7.6e0-0.5e0*(bortle-1)-0.25e0*(1e0/{sd('35e0')}-1e0)",'mlim')} from b""",
)


@query("fit_sqm_model")
def _(spark, sf):
    samples = view(spark, sf, "sqm_samples")
    m = rad.fit_sqm_model(samples)
    # the fitted numbers beside the sample range they come from
    return samples.agg(F.count(F.lit(1)).alias("n"), F.min("sqm").alias("min_sqm"), F.max("sqm").alias("max_sqm")).select(
        "n", "min_sqm", "max_sqm", F.lit(m["a"]).alias("a"), F.lit(m["b"]).alias("b"), F.lit(m["c"]).alias("c")
    )


@query("fit_metrics")
def _(spark, sf):
    pred = rad.predict_sqm(view(spark, sf, "sqm_samples"), {"a": 22.0, "b": -2.4, "c": 0.05, "eps": 1e-3})
    return rounded(rad.fit_metrics(pred))


oracle(
    "fit_metrics",
    "sqm_samples",
    f"""e as (select 22e0-2.4e0*log10(agg_dvnl+0.001e0)+0.05e0*(elevation_m/1000e0)-sqm as d from sqm_samples)
select {c6('avg(abs(d))','mae')}, {c6('sqrt(avg(d*d))','rmse')}, count(d) as n from e""",
)


@query("light_dome_scan")
def _(spark, sf):
    obs = sites(spark, sf).selectExpr("point_id as obs_id", "x*1000e0 as x", "y*1000e0 as y")
    return rounded(rad.light_dome_scan(obs, view(spark, sf, "radiance_cells")).select("obs_id", "az", "dist", "radiance", "rank"))


oracle(
    "light_dome_scan",
    "radiance_cells observers",
    f"""{SITES}, z as (select r, c, {CLEAN['region']} as v from radiance_cells),
ray as (select point_id as obs_id, a.i*10 as az, d.i*2000+2000 as dist, (pc+0.25e0)*1000e0+(d.i*2000+2000)*{sd('a.i*10e0')} as x, (pr+0.75e0)*1000e0+(d.i*2000+2000)*{cd('a.i*10e0')} as y from p, range(36) a(i), range(24) d(i)),
s as (select obs_id, az, dist, v from ray join z on r = cast(floor(y/1000e0) as int) and c = cast(floor(x/1000e0) as int)),
b as (select * from s where v > 0.1e0 qualify row_number() over (partition by obs_id, az order by v desc, dist)=1),
k as (select *, row_number() over (partition by obs_id order by v desc, az) as rank from b)
select obs_id, cast(az as int) as az, cast(dist as int) as dist, {c6('v','radiance')}, cast(rank as int) as rank from k where rank <= 8""",
)


def near_meridian(spark, sf):
    return view(spark, sf, "observers").selectExpr("obs_id", "lat", "lon/60e0+3e0 as lon")


@query("to_utm31")
def _(spark, sf):
    return rounded(rad.to_utm31(near_meridian(spark, sf)), 3)


_E2V = 2 / 298.257223563 - (1 / 298.257223563) ** 2
_EP = _E2V / (1 - _E2V)
oracle(
    "to_utm31",
    "observers",
    f"""o as (select obs_id, lat, lon/60e0+3e0 as lon, lat*{K} as phi, (lon/60e0)*{K} as lam from observers),
a as (select *, 6378137e0/sqrt(1e0-{_E2V!r}*sin(phi)*sin(phi)) as n, tan(phi)*tan(phi) as t, {_EP!r}*cos(phi)*cos(phi) as cc, lam*cos(phi) as a,
 6378137e0*({1-_E2V/4-3*_E2V**2/64-5*_E2V**3/256!r}*phi-{3*_E2V/8+3*_E2V**2/32+45*_E2V**3/1024!r}*sin(2e0*phi)+{15*_E2V**2/256+45*_E2V**3/1024!r}*sin(4e0*phi)-{35*_E2V**3/3072!r}*sin(6e0*phi)) as m from o)
select obs_id, {c6('lat','lat',3)}, {c6('lon','lon',3)},
 {c6(f'500000e0+0.9996e0*n*(a+(1e0-t+cc)*pow(a,3)/6e0+(5e0-18e0*t+t*t+72e0*cc-58e0*{_EP!r})*pow(a,5)/120e0)','utm_x',3)},
 {c6(f'0.9996e0*(m+n*tan(phi)*(a*a/2e0+(5e0-t+9e0*cc+4e0*cc*cc)*pow(a,4)/24e0+(61e0-58e0*t+t*t+600e0*cc-330e0*{_EP!r})*pow(a,6)/720e0))','utm_y',3)} from a""",
)


@query("from_utm31")
def _(spark, sf):
    there = rad.to_utm31(near_meridian(spark, sf)).drop("lat", "lon")
    return rounded(rad.from_utm31(there).drop("utm_x", "utm_y"))


# a round trip must give the starting point back
oracle("from_utm31", "observers", f"select obs_id, {c6('lat','lat')}, {c6('lon/60e0+3e0','lon')} from observers")
