"""Deep-sky, name-search, constellation and sky-map queries, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.functions.angles import rounded
from nightgrid.operators import deepsky as deep
from nightgrid.operators import skymap as sm
from nightgrid.plans.adapters import table, view
from nightgrid.plans.catalog_queries import scratch_dir
from nightgrid.plans.registry import c6, oracle, query
from nightgrid.plans.search_queries import D, LST, _ALT, _AZ, _GX, _GY, _GZ, clip1, sd, w360
from nightgrid.sources.objects import flatten_constellations, read_deep_sky


def raw_objects(spark, sf):
    v = view(spark, sf, "deep_sky_raw")
    names = {"name": "Name", "ra_txt": "RA", "dec_txt": "Dec", "obj_type": "Type", "v_mag": "V-Mag", "maj_arcmin": "MajAx", "common_names": "Common names", "m": "M"}
    return v.select(*[F.col(a).cast("string").alias(b) for a, b in names.items()])


def catalog(spark, sf):
    return deep.deep_sky_catalog(raw_objects(spark, sf))


COLS = ["name", "obj_type", "ra", "dec", "maj_deg", "min_deg", "mag_v", "messier", "common_name", "effective_mag"]


@query("deep_sky_catalog")
def _(spark, sf):
    return rounded(catalog(spark, sf).select(*COLS))


@query("deep_sky_files")
def _(spark, sf):
    path = scratch_dir(spark, "objects")
    raw_objects(spark, sf).write.option("header", True).option("sep", "|").csv(path)
    return rounded(read_deep_sky(spark, path).select(*COLS))


CAT = """cat as (select regexp_replace(split_part(name,' ',1)||cast(cast(split_part(name,' ',2) as int) as varchar),' ','') as name, obj_type,
 (cast(split_part(ra_txt,':',1) as double)+cast(split_part(ra_txt,':',2) as double)/60e0+cast(split_part(ra_txt,':',3) as double)/3600e0)*15e0 as ra0,
 case when dec_txt like '-%' then -1e0 else 1e0 end*(abs(cast(split_part(dec_txt,':',1) as double))+cast(split_part(dec_txt,':',2) as double)/60e0) as dec0,
 greatest(0.02e0,maj_arcmin/60e0) as maj, v_mag, m, common_names as cn, coalesce(v_mag,99e0) as em from deep_sky_raw),
ct as (select *, ra0-360e0*floor(ra0/360e0) as ra, greatest(-90e0,least(90e0,dec0)) as dec from cat)"""
for _n in ("deep_sky_catalog", "deep_sky_files"):
    oracle(
        _n,
        "deep_sky_raw",
        f"""{CAT} select name, obj_type, {c6('ra','ra')}, {c6('dec','dec')}, {c6('maj','maj_deg')}, {c6('maj','min_deg')}, {c6('v_mag','mag_v')}, cast(m as int) as messier, cn as common_name, {c6('em','effective_mag')} from ct""",
    )


@query("object_aliases")
def _(spark, sf):
    return deep.object_aliases(catalog(spark, sf)).select("name", "alias")


ALIAS = """al0 as (select name, em, m, cn, list_concat([name, regexp_extract(name,'^(NGC|IC)',1)||' '||regexp_extract(name,'([0-9]+)$',1)],
  case when m > 0 then ['M'||m, 'M '||m, 'Messier '||m] else [] end, case when cn is not null then list_concat([cn], list_filter(regexp_extract_all(cn,'[A-Za-z0-9'']+'), lambda x: len(x) >= 3)) else [] end) as l from ct),
al1 as (select name, em, unnest(l) as alias, generate_subscripts(l,1) as p from al0), al as (select name, em, alias, min(p) as p from al1 group by 1,2,3)"""
oracle("object_aliases", "deep_sky_raw", f"{CAT}, {ALIAS} select name, alias from al")

STARS = """case when s_suppkey % 10 = 0 then 'Gaia DR3 ' || cast(s_suppkey as varchar(9)) else replace(n_name,'A','Á') || ' ' || cast(s_suppkey % 40 as varchar(9)) end"""


def named_stars(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).selectExpr("s_suppkey as star_id", f"{STARS} as name", "s_suppkey as seq")


def index(spark, sf):
    regs = deep.registrations(spark, named_stars(spark, sf), deep.object_aliases(catalog(spark, sf)))
    return deep.search_index(regs)


@query("search_index")
def _(spark, sf):
    return index(spark, sf)


_PN = [(i, k, n) for i, (k, n) in enumerate((k, n) for k, names in deep.PLANET_NAMES for n in names)]
REGS = f"""{CAT}, {ALIAS}, pn(i,t,n) as (values {','.join(f"({i},'{k}','{n}')" for i, k, n in _PN)}),
rg as (select n as name, 'planet' as type, t as target, 0 as s, cast(i as double) as a, '' as b, 0 as c from pn
 union all select {STARS}, 'star', cast(s_suppkey as varchar), 1, 0e0, '', s_suppkey from supplier join nation on s_nationkey=n_nationkey where s_suppkey % 10 <> 0
 union all select alias, 'deep_sky', name, 2, em, name, p from al),
ix as (select 'exact' as kind, name as key, type, target from rg qualify row_number() over (partition by name order by s desc, a desc, b desc, c desc)=1
 union all (select 'key', strip_accents(lower(trim(name))) as k, type, target from rg qualify row_number() over (partition by k order by s, a, b, c)=1))"""
oracle("search_index", "deep_sky_raw", f"{REGS} select * from ix")

ASK = """case c_custkey % 5 when 0 then 'M ' || cast(c_custkey % 120 as varchar(9)) when 1 then ' ' || lower(c_mktsegment) when 2 then substr('small ring red widget blue gadget', cast(1+c_custkey % 20 as int), cast(2+c_custkey % 5 as int))
 when 3 then 'ngc' || cast(c_custkey % 500 as varchar(9)) else 'xyz' || cast(c_custkey as varchar(9)) end"""


@query("search_objects")
def _(spark, sf):
    asks = table(spark, sf, "customer").selectExpr("c_custkey as query_id", f"{ASK} as text")
    return deep.search_objects(asks, index(spark, sf))


oracle(
    "search_objects",
    "deep_sky_raw",
    f"""{REGS}, q as (select c_custkey as query_id, trim({ASK}) as text, strip_accents(lower(trim({ASK}))) as norm from customer),
e as (select q.*, ix.key as ek from q left join ix on kind='exact' and key=text), k as (select e.*, ix.key as kk from e left join ix on kind='key' and key=norm),
d as (select distinct norm from k where ek is null and kk is null), dc as (select norm, min(key) as ck from d, ix where kind='key' and contains(key,norm) group by 1),
r as (select query_id, text, case when ek is not null then 'exact' when kk is not null then 'key' else 'contains' end as match, coalesce(ek,kk,ck) as key, case when ek is not null then 'exact' else 'key' end as kind from k left join dc using (norm))
select query_id, text, match, r.key, ix.type, ix.target from r join ix on ix.kind=r.kind and ix.key=r.key""",
)


@query("overlay_selection")
def _(spark, sf):
    return rounded(deep.overlay_selection(catalog(spark, sf), view(spark, sf, "observers"), top=120), 5)


oracle(
    "overlay_selection",
    "deep_sky_raw observers",
    f"""{CAT}, o as (select *, {LST} as lst from observers), p as (select obs_id, name, obj_type, cn, m, em, {_ALT} as alt, {_AZ} as az from ct, o where coalesce(m,0) <> 0 or em <= 8.8e0 or maj >= 0.3e0),
k as (select *, row_number() over (partition by obs_id order by em, name) as rank from p where alt >= -2)
select obs_id, cast(rank as int) as rank, name, {c6('alt','alt',5)}, {c6('az','az',5)}, case when upper(obj_type) like 'G%' then 'galaxy' when contains(upper(obj_type),'GC') then 'globular' when contains(upper(obj_type),'N') or contains(upper(obj_type),'HII') then 'nebula'
 when contains(upper(obj_type),'CL') then 'cluster' else 'other' end as symbol, coalesce(cn, 'M'||m, name) as label, {c6('em','effective_mag',5)} from k where rank <= 120""",
)


@query("constellation_nodes")
def _(spark, sf):
    """Node documents, one per conversation turn pair, flattened again."""
    n = view(spark, sf, "nodes")
    node = F.struct(
        F.when(F.col("pos") % 7 != 5, (F.col("ra_deg") * 2.0 - 90.0).cast("string")).alias("ra_deg"),
        (F.col("dec_deg") * 1.2).cast("string").alias("dec_deg"),
        F.col("group_id").cast("string").alias("star_id"),
        F.lit(True).alias("connect_from_prev"),
    )
    first = n.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", node.alias("node")))).alias("a"))
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("g").alias("name"), F.transform("a", lambda x: x["node"]).alias("nodes"))).alias("constellations")))
    flat = flatten_constellations(first.select("group_id", doc.alias("doc")))
    return rounded(flat.select("group_id", "pos", "ra_deg", "dec_deg", "star_id", "connect_from_prev"))


oracle(
    "constellation_nodes",
    "nodes",
    f"""k as (select group_id, row_number() over (partition by group_id order by pos)-1 as pos, {w360('ra_deg*2e0-90e0')} as ra, greatest(-90e0,least(90e0,dec_deg*1.2e0)) as de from nodes where pos % 7 <> 5)
select group_id, cast(pos as int) as pos, {c6('ra','ra_deg')}, {c6('de','dec_deg')}, cast(group_id as varchar) as star_id, pos > 0 as connect_from_prev from k""",
)


def size(px):
    s = px.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()  # raster metadata
    return s["r"] + 1, s["c"] + 1


def rgb(spark, sf):
    return view(spark, sf, "map_cells").selectExpr(
        "cast(r as int) as r", "c", "greatest(0e0,least(1e0,v*2e0+0.5e0)) as red", "greatest(0e0,least(1e0,v+0.5e0)) as green", "greatest(0e0,least(1e0,0.6e0-v)) as blue"
    )


RGB = "rgb as (select r, c, greatest(0e0,least(1e0,v*2e0+0.5e0)) as red, greatest(0e0,least(1e0,v+0.5e0)) as green, greatest(0e0,least(1e0,0.6e0-v)) as blue from map_cells)"
LUM = "greatest(0e0,least(1e0,red*0.299e0+green*0.587e0+blue*0.114e0))"


@query("robust_normalize")
def _(spark, sf):
    px = view(spark, sf, "map_cells").withColumn("channel", F.col("c") % 3)
    return rounded(sm.robust_normalize(px))


oracle(
    "robust_normalize",
    "map_cells",
    f"""q as (select c%3 as channel, quantile_cont(v,0.01) as a, quantile_cont(v,0.99) as b from map_cells group by 1)
select r, c, {c6('greatest(0e0,least(1e0,(v-a)/(b-a)))','v')}, cast(c%3 as int) as channel from map_cells join q on channel=c%3""",
)


def blur_sql(src: str, cols: str, radius: int, name: str) -> str:
    def mirror(i: str, n: str) -> str:
        return f"case when {i} < 0 then -({i}) when {i} > {n}-1 then 2*({n}-1)-({i}) else {i} end"

    avgs = ", ".join(f"avg(q.{x}) as {x}" for x in cols.split())
    return f"""{name} as (select p.r, p.c, {avgs} from (select p0.r, p0.c, {mirror(f'p0.r+a.i-{radius}','dim.nr')} as rr, {mirror(f'p0.c+b.i-{radius}','dim.nc')} as cc
 from {src} p0, dim, range({2*radius+1}) a(i), range({2*radius+1}) b(i)) p join {src} q on q.r=p.rr and q.c=p.cc group by 1,2)"""


MDIM = "dim as (select max(r)+1 as nr, max(c)+1 as nc from map_cells)"


@query("box_blur")
def _(spark, sf):
    px = view(spark, sf, "map_cells")
    return rounded(sm.box_blur(px, ["v"], 2, *size(px)))


oracle("box_blur", "map_cells", f"{MDIM}, {blur_sql('map_cells','v',2,'b')} select r, c, {c6('v','v')} from b")


@query("remove_point_sources")
def _(spark, sf):
    px = rgb(spark, sf)
    out, _ = sm.remove_point_sources(px, *size(px), sigmas=1.2, radius=3, grow=1)
    return rounded(out, 7)


oracle(
    "remove_point_sources",
    "map_cells",
    f"""{MDIM}, {RGB}, l as (select *, {LUM} as lum from rgb), {blur_sql('l','lum red green blue',3,'bl')},
j as (select l.r, l.c, l.red, l.green, l.blue, l.lum, l.lum-bl.lum as res, bl.red as br, bl.green as bg, bl.blue as bb from l join bl using (r,c)),
m as (select quantile_cont(res,0.5) as med, quantile_cont(lum,0.68) as hi from j), s as (select med, hi, greatest(0.004e0,1.2e0*1.4826e0*quantile_cont(abs(res-med),0.5)) as lim from j, m group by 1,2),
k as (select j.*, case when res > lim and lum > hi then 1e0 else 0e0 end as mk from j, s), {blur_sql('k','mk',1,'g')}
select k.r, k.c, {c6('case when g.mk > 1e-4 then br else red end','red',7)}, {c6('case when g.mk > 1e-4 then bg else green end','green',7)}, {c6('case when g.mk > 1e-4 then bb else blue end','blue',7)}, g.mk > 1e-4 as masked from k join g using (r,c)""",
)


@query("luminance_alpha")
def _(spark, sf):
    return sm.luminance_alpha(rgb(spark, sf))


RGBA = f"""{RGB}, ra as (select r, c, cast(round_even(red*255e0,0) as int) as red, cast(round_even(green*255e0,0) as int) as green, cast(round_even(blue*255e0,0) as int) as blue,
 cast(round_even(pow(greatest(0e0,least(1e0,({LUM}-0.05e0)/(1e0-0.05e0))),0.85e0)*255e0,0) as int) as alpha from rgb)"""
oracle("luminance_alpha", "map_cells", f"{RGBA} select cast(r as int) as r, c, red, green, blue, alpha from ra".replace("cast(r as int) as r, c", "cast(r as int) as r, cast(c as int) as c"))


@query("alpha_report")
def _(spark, sf):
    return sm.alpha_report(sm.luminance_alpha(rgb(spark, sf)))


oracle("alpha_report", "map_cells", f"{RGBA} select min(alpha) as alpha_min, max(alpha) as alpha_max, count(*) as n_pixels from ra")

NSIDE = 8


def star_map(spark, sf, nest):
    stars = sm.healpix_pixel(view(spark, sf, "stars").select("ra", "dec", "mag"), NSIDE, nest)
    return stars.groupBy("pix").agg(F.sum(F.pow(F.lit(10.0), -0.4 * F.col("mag"))).alias("value"))


def _grid_query(nest):
    def run(spark, sf):
        return rounded(sm.healpix_to_grid(star_map(spark, sf, nest), NSIDE, 90, 45, nest))

    return run


def hp_sql(src: str, name: str, nest: bool) -> str:
    n = NSIDE
    base = f"""{name}1 as (select *, {sd('dec')} as z, {w360('ra')}/90e0 as tt from {src}),
{name}2 as (select *, abs(z) as za, floor({n}e0*(0.5e0+tt)-{n}e0*z*0.75e0) as jp, floor({n}e0*(0.5e0+tt)+{n}e0*z*0.75e0) as jm, least(3e0,floor(tt)) as nt, {n}e0*sqrt(3e0*(1e0-abs(z))) as tmp from {name}1),
{name}3 as (select *, floor((tt-nt)*tmp) as cp, floor((1e0-(tt-nt))*tmp) as cm from {name}2)"""
    if not nest:
        return base + f""", {name}4 as (select *, {n+1}+jp-jm as ir, cp+cm+1 as rg from {name}3),
{name} as (select *, cast(case when za <= 2e0/3e0 then {2*n*(n-1)}+(ir-1)*{4*n}+(floor((jp+jm-{n}+(1-(ir-2*floor(ir/2)))+1)/2)-{4*n}*floor(floor((jp+jm-{n}+(1-(ir-2*floor(ir/2)))+1)/2)/{4*n}))
 when z > 0 then 2*rg*(rg-1)+(floor(tt*rg)-4*rg*floor(floor(tt*rg)/(4*rg))) else {12*n*n}-2*rg*(rg+1)+(floor(tt*rg)-4*rg*floor(floor(tt*rg)/(4*rg))) end as bigint) as pix from {name}4)"""
    bits = "+".join(f"((x>>{b})&1)*{4**b}+((y>>{b})&1)*{2*4**b}" for b in range(3))
    return base + f""", {name}4 as (select *, floor(jp/{n}) as fp, floor(jm/{n}) as fm, least({n-1},cp) as p, least({n-1},cm) as q from {name}3),
{name}5 as (select *, cast(case when za <= 2e0/3e0 then case when fp=fm then case when fp=4 then 4 else fp+4 end when fp < fm then fp else fm+8 end when z >= 0 then nt else nt+8 end as bigint) as f,
 cast(case when za <= 2e0/3e0 then jm-{n}*floor(jm/{n}) when z >= 0 then {n}-q-1 else p end as bigint) as x, cast(case when za <= 2e0/3e0 then {n}-(jp-{n}*floor(jp/{n}))-1 when z >= 0 then {n}-p-1 else q end as bigint) as y from {name}4),
{name} as (select *, f*{n*n}+{bits} as pix from {name}5)"""


for _nest in (False, True):
    _q = f"healpix_to_grid_{'nest' if _nest else 'ring'}"
    query(_q)(_grid_query(_nest))
    oracle(
        _q,
        "stars",
        f"""{hp_sql('stars','hs',_nest)}, hv as (select pix, sum(pow(10e0,-0.4e0*mag)) as value from hs group by 1),
gg as (select a.i as r, b.i as c, b.i*4e0+2e0 as ra, 90e0-(a.i+0.5e0)/45e0*180e0 as dec from range(45) a(i), range(90) b(i)), {hp_sql('gg','hg',_nest)}
select cast(r as int) as r, cast(c as int) as c, {c6('coalesce(value,0e0)','value')} from hg left join hv using (pix)""",
    )


@query("quantize_u16")
def _(spark, sf):
    return sm.quantize_u16(view(spark, sf, "map_cells")).select("r", "c", "u16")


oracle(
    "quantize_u16",
    "map_cells",
    """q as (select quantile_cont(v,0.01) as a, quantile_cont(v,0.995) as b from map_cells)
select r, c, cast(round_even(greatest(0e0,least(1e0,(v-a)/(b-a)))*65535e0,0) as int) as u16 from map_cells, q""",
)


def sampled(spark, sf, **how):
    px = view(spark, sf, "map_cells").selectExpr("cast(r as int) as r", "c", "v")
    dust = sm.normalize_dust(px)
    n = size(px)
    stars = view(spark, sf, "stars").select("source_id", "ra", "dec")
    return sm.sample_map(stars, sm.map_stencils(dust, "v", *n), *n, out="dust", **how)


MAP = f"""{MDIM}, mn as (select min(v) as lo, max(v) as hi from map_cells), du as (select cast(r*64+c as bigint) as key, (v-lo)/(hi-lo) as v from map_cells, mn),
gl as (select source_id, {w360(f'atan2({_GY},{_GX})*{D}')} as lo, asin({clip1(_GZ)})*{D} as la from stars)"""


def _bil(lon: str, lat: str) -> str:
    return f"""xy as (select source_id, {w360(lon)}/360e0*nc as x, greatest(0e0,least(1e0,1e0-({lat}+90e0)/180e0))*(nr-1) as y, nr, nc from gl, dim),
xi as (select *, cast(floor(x) as bigint)%nc as c0, (cast(floor(x) as bigint)+1)%nc as c1, cast(floor(y) as bigint) as r0, least(nr-1,cast(floor(y) as bigint)+1) as r1, x-floor(x) as tx, y-floor(y) as ty from xy),
xk as (select *, r0*64+c0 as k0, r0*64+c1 as k1, r1*64+c0 as k2, r1*64+c1 as k3 from xi),
sa as (select source_id, (a.v*(1e0-tx)+b.v*tx)*(1e0-ty)+(d.v*(1e0-tx)+e.v*tx)*ty as dust from xk join du a on a.key=k0 join du b on b.key=k1 join du d on d.key=k2 join du e on e.key=k3)"""


@query("sample_map")
def _(spark, sf):
    return rounded(sampled(spark, sf, offset=12.5, lat_flip=True).select("source_id", "dust"))


oracle("sample_map", "map_cells stars", f"{MAP}, {_bil('lo+12.5e0','(-la)')} select source_id, {c6('dust','dust')} from sa")


@query("dust_modulation")
def _(spark, sf):
    return rounded(sm.dust_modulation(sampled(spark, sf), density=1.5, extinction=0.8).select("source_id", "density_gain", "extinction_gain"))


oracle(
    "dust_modulation",
    "map_cells stars",
    f"{MAP}, {_bil('lo','la')} select source_id, {c6('greatest(0e0,least(4e0,1e0+1.5e0*dust))','density_gain')}, {c6('greatest(0e0,least(1e0,1e0-0.8e0*dust))','extinction_gain')} from sa",
)


@query("map_gain")
def _(spark, sf):
    return rounded(sm.map_gain(rgb(spark, sf)))


oracle("map_gain", "map_cells", f"{RGB}, q as (select quantile_cont(greatest(red,green,blue),0.9999) as p from rgb) select {c6('p','p9999')}, {c6('greatest(1e0,least(4.5e0,0.62e0/p))','gain')} from q")
