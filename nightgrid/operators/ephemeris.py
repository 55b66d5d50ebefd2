"""Analytic Sun, Moon and planet tables, eclipses, day length, twilight.

Rows carry their own time and place (`ts`, `lat`, `lon`), so every job is a
plain projection; `time_grid` makes such rows.  The Moon's longitude uses the
published truncated series with its own arguments and no epoch shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid.functions.angles import (
    DEG,
    RAD,
    acos_d,
    asin_d,
    atan2_d,
    clamp,
    cos_d,
    dbl,
    sin_d,
    tan_d,
    wrap360,
)
from nightgrid.functions.scale import spread, staged
from nightgrid.operators.positions import alt_az

AU_KM, EARTH_KM = 149597870.7, 6378.14
SUN_KM, MOON_KM = 696340.0, 1737.4


def time_grid(observers: DataFrame, start: str, stop: str, step: str) -> DataFrame:
    """Observers repeated over a regular series of timestamps (UTC)."""
    span = F.sequence(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp"), F.expr(f"interval {step}"))
    return spread(observers).withColumn("ts", F.explode(span))


def julian_day(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c).cast("double") / 86400e6 + 2440587.5


def _century(jd: Column) -> Column:
    """Julian centuries of dynamical time with a fixed 72 s offset."""
    return (jd + 72.0 / 86400.0 - 2451545.0) / 36525.0


def _sun(df: DataFrame) -> DataFrame:
    t = F.col("_T")
    df = staged(df, _M=wrap360(357.52911 + 35999.05029 * t), _e=0.016708634 - 0.000042037 * t)
    m = F.col("_M")
    c = (1.914602 - 0.004817 * t) * sin_d(m) + (0.019993 - 0.000101 * t) * sin_d(2.0 * m) + 0.000289 * sin_d(3.0 * m)
    df = staged(df, _C=c)
    r = 1.000001018 * (1.0 - F.col("_e") * F.col("_e")) / (1.0 + F.col("_e") * cos_d(m + F.col("_C")))
    lon = wrap360(wrap360(280.46646 + 36000.76983 * t) + F.col("_C"))
    return staged(df, sun_lon=lon, sun_km=r * AU_KM).drop("_M", "_e", "_C")


# Fixed values: (coefficient, D, M, M', F) of the largest lunar terms,
# longitude and latitude in degrees, distance in kilometres.
MOON_LON = (
    (6.288774, 0, 0, 1, 0),
    (1.274027, 2, 0, -1, 0),
    (0.658314, 2, 0, 0, 0),
    (0.213618, 0, 0, 2, 0),
    (-0.185116, 0, 1, 0, 0),
    (-0.114332, 0, 0, 0, 2),
    (0.058793, 2, 0, -2, 0),
    (0.057066, 2, -1, -1, 0),
)
MOON_LAT = ((5.128122, 0, 0, 0, 1), (0.280602, 0, 0, 1, 1), (0.277693, 0, 0, 1, -1), (0.173237, 2, 0, 0, -1))
MOON_DIST = ((-20905.355, 0, 0, 1, 0), (-3699.111, 2, 0, -1, 0), (-2955.968, 2, 0, 0, 0), (-569.925, 0, 0, 2, 0))


def _moon(df: DataFrame) -> DataFrame:
    t = F.col("_T")
    df = staged(
        df,
        _L=wrap360(218.3164477 + 481267.8812542 * t),
        _D=wrap360(297.8501921 + 445267.1114034 * t),
        _S=wrap360(357.5291092 + 35999.0502909 * t),
        _N=wrap360(134.9633964 + 477198.8675055 * t),
        _F=wrap360(93.2720950 + 483202.0175381 * t),
    )

    def arg(row: tuple) -> Column:
        return sum((F.col(n) * float(k) for n, k in zip(("_D", "_S", "_N", "_F"), row[1:]) if k), F.lit(0.0))

    lon = F.col("_L") + sum((row[0] * sin_d(arg(row)) for row in MOON_LON), F.lit(0.0))
    lat = sum((row[0] * sin_d(arg(row)) for row in MOON_LAT), F.lit(0.0))
    dist = 385000.56 + sum((row[0] * cos_d(arg(row)) for row in MOON_DIST), F.lit(0.0))
    return staged(df, moon_lon=wrap360(lon), moon_lat=lat, moon_km=dist).drop("_L", "_D", "_S", "_N", "_F")


def _equatorial(lon: Column, lat: Column, eps: Column) -> tuple[Column, Column]:
    x = cos_d(lat) * cos_d(lon)
    y = cos_d(lat) * sin_d(lon) * cos_d(eps) - sin_d(lat) * sin_d(eps)
    z = cos_d(lat) * sin_d(lon) * sin_d(eps) + sin_d(lat) * cos_d(eps)
    return wrap360(atan2_d(y, x)), asin_d(z)


def _topocentric(ra: Column, dec: Column, km: Column) -> tuple[Column, Column]:
    h, sin_pi = F.col("lst") - ra, EARTH_KM / km
    rho_sin, rho_cos = 0.996647 * sin_d("lat"), cos_d("lat")
    den = cos_d(dec) - rho_cos * sin_pi * cos_d(h)
    d_ra = F.atan2(-rho_cos * sin_pi * sin_d(h), den)
    dec2 = F.atan2((sin_d(dec) - rho_sin * sin_pi) * F.cos(d_ra), den)
    return wrap360(ra + d_ra * DEG), dec2 * DEG


def _separation(ra1: str, dec1: str, ra2: str, dec2: str) -> Column:
    c = sin_d(dec1) * sin_d(dec2) + cos_d(dec1) * cos_d(dec2) * cos_d(F.col(ra1) - F.col(ra2))
    return acos_d(c)


def _geocentric(rows: DataFrame) -> DataFrame:
    """Sun and Moon from the Earth's centre and the sidereal angle of Greenwich: all that depends on `ts` alone."""
    df = staged(rows, jd=julian_day("ts"))
    d = F.col("jd") - 2451545.0
    tt = d / 36525.0
    gmst = 280.46061837 + 360.98564736629 * d + 0.000387933 * tt * tt
    df = _moon(_sun(staged(df, _T=_century(F.col("jd")), _gmst=gmst)))
    eps = 23.4392911 - 0.0130042 * F.col("_T")
    sun = _equatorial(F.col("sun_lon"), F.lit(0.0), eps)
    moon = _equatorial(F.col("moon_lon"), F.col("moon_lat"), eps)
    return staged(df, sun_gra=sun[0], sun_gdec=sun[1], moon_gra=moon[0], moon_gdec=moon[1])


def sun_moon_table(rows: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Geocentric and topocentric Sun and Moon of each row (`ts, lat, lon`).

    With `moments`, the few different `ts` of the rows, what depends on them
    alone is computed once for each and joined.
    """
    df = _geocentric(rows) if moments is None else rows.join(F.broadcast(_geocentric(moments.select("ts").distinct())), "ts")
    df = staged(df, lst=wrap360(F.col("_gmst") + dbl("lon")))
    sun = _topocentric(F.col("sun_gra"), F.col("sun_gdec"), F.col("sun_km"))
    moon = _topocentric(F.col("moon_gra"), F.col("moon_gdec"), F.col("moon_km"))
    df = staged(df, sun_ra=sun[0], sun_dec=sun[1], moon_ra=moon[0], moon_dec=moon[1])
    sun = alt_az("sun_ra", "sun_dec", "lat", "lst", 1e-10)
    moon = alt_az("moon_ra", "moon_dec", "lat", "lst", 1e-10)
    df = staged(
        df,
        sun_alt=sun[0],
        sun_az=sun[1],
        moon_alt=moon[0],
        moon_az=moon[1],
        separation=_separation("sun_ra", "sun_dec", "moon_ra", "moon_dec"),
        _elong=_separation("sun_gra", "sun_gdec", "moon_gra", "moon_gdec"),
    )
    lead = wrap360(F.col("moon_gra") - F.col("sun_gra"))
    size = 0.2725 * (384400.0 / F.col("moon_km")) * (1.0 + EARTH_KM / F.col("moon_km") * sin_d("moon_alt"))
    return df.select(
        *rows.columns,
        "jd",
        "lst",
        "sun_ra",
        "sun_dec",
        "sun_km",
        "sun_alt",
        "sun_az",
        "moon_ra",
        "moon_dec",
        "moon_km",
        "moon_alt",
        "moon_az",
        "separation",
        ((1.0 - cos_d("_elong")) / 2.0).alias("illumination"),
        ((lead > 0) & (lead < 180.0)).alias("waxing"),
        size.alias("moon_semidiameter"),
    )


# Name, base magnitude, then L, L rate, perihelion, rate,
# eccentricity, rate, inclination, rate, node, rate, semi-major axis.
PLANETS = (
    ("Mercury", -0.6, 252.250906, 149472.6746358, 77.456119, 0.16047689, 0.20563069, 0.00002527, 7.00487, -0.00595, 48.33167, -0.00361, 0.387098),
    ("Venus", -4.4, 181.979801, 58517.8156760, 131.563703, 0.0048746, 0.00677323, -0.00004938, 3.39471, -0.00288, 76.68069, -0.00280, 0.723332),
    ("Mars", -0.5, 355.432999, 19140.2993313, 336.060234, 0.1841330, 0.09340065, 0.00009048, 1.84973, -0.00223, 49.55747, -0.00772, 1.523679),
    ("Jupiter", -5.8, 34.351519, 3034.9056746, 14.331207, 0.2155525, 0.048498, 0.000163225, 1.3030, -0.005494, 100.4542, 0.076841, 5.20260),
    ("Saturn", -4.3, 50.077444, 1222.1137940, 93.057237, 0.5665496, 0.055546, -0.000346641, 2.4886, -0.003736, 113.6634, -0.038564, 9.554909),
)
_ELEMENTS = ("name", "base", "l0", "l1", "p0", "p1", "e0", "e1", "i0", "i1", "n0", "n1", "a")


def planet_table(rows: DataFrame, phase: bool = False) -> DataFrame:
    """Five planets per row (`ts`): position, distance and magnitude.

    The magnitude dims by 0.01 per degree of phase angle (Sun, planet, Earth).
    Without `phase` a planet counts as fully lit, as the sky view draws it; with
    it the angle is computed and returned as `phase_angle`.
    """
    elements = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(_ELEMENTS, p)]) for p in PLANETS])
    df = _sun(staged(rows, _T=_century(julian_day("ts"))))
    df = df.select("*", F.inline(elements))
    t = F.col("_T")
    df = staged(
        df,
        _pi=wrap360(F.col("p0") + F.col("p1") * t),
        _e=F.col("e0") + F.col("e1") * t,
        _i=(F.col("i0") + F.col("i1") * t) * RAD,
        _node=F.col("n0") + F.col("n1") * t,
    )
    df = staged(df, _M=wrap360(wrap360(F.col("l0") + F.col("l1") * t) - F.col("_pi")) * RAD)
    last = "_M"
    for name in ("_x1", "_x2", "_x3"):  # fixed-point steps of Kepler's equation
        df = staged(df, **{name: F.col("_M") + F.col("_e") * F.sin(last)})
        last = name
    v = F.atan2(F.sqrt(1.0 - F.col("_e") * F.col("_e")) * F.sin(last), F.cos(last) - F.col("_e"))
    df = staged(df, _r=F.col("a") * (1.0 - F.col("_e") * F.cos(last)), _u=v + (F.col("_pi") - F.col("_node")) * RAD)
    xo, yo = F.col("_r") * F.cos("_u"), F.col("_r") * F.sin("_u")
    node = F.col("_node") * RAD
    au = F.col("sun_km") / AU_KM
    earth = F.col("sun_lon") + 180.0
    df = staged(
        df,
        _x=xo * F.cos(node) - yo * F.cos("_i") * F.sin(node) - au * cos_d(earth),
        _y=xo * F.sin(node) + yo * F.cos("_i") * F.cos(node) - au * sin_d(earth),
        _z=yo * F.sin("_i"),
    )
    df = staged(df, distance_au=F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z")))
    df = staged(df, ecl_lon=wrap360(atan2_d(F.col("_y"), F.col("_x"))), ecl_lat=asin_d(F.col("_z") / F.col("distance_au")))
    ra, dec = _equatorial(F.col("ecl_lon"), F.col("ecl_lat"), 23.4392911 - 0.0130042 * t)
    r, d = F.col("_r"), F.col("distance_au")
    df = df.withColumn("phase_angle", F.acos(clamp((r * r + d * d - au * au) / (2.0 * r * d), -1.0, 1.0)) * DEG if phase else F.lit(0.0))
    mag = F.col("base") + 5.0 * F.log10("distance_au") + 0.01 * F.col("phase_angle")
    more = ["phase_angle"] if phase else []
    return df.select(*rows.columns, "name", "ecl_lon", "ecl_lat", "distance_au", ra.alias("ra"), dec.alias("dec"), mag.alias("mag"), *more)


def eclipse_factor(table: DataFrame) -> DataFrame:
    """Adds `sun_radius, moon_radius, dimming` to Sun-Moon rows: 1 is full light."""
    df = staged(table, sun_radius=F.atan(SUN_KM / F.col("sun_km")) * DEG, moon_radius=F.atan(MOON_KM / F.col("moon_km")) * DEG)
    rs, rm, sep = F.col("sun_radius"), F.col("moon_radius"), F.col("separation")
    dark = F.when(rm >= rs, 0.05).otherwise(1.0 - (rm * rm) / (rs * rs))
    t = (sep - F.abs(rs - rm)) / ((rs + rm) - F.abs(rs - rm))
    return staged(
        df,
        dimming=F.when(sep >= rs + rm, 1.0).when(sep <= F.abs(rs - rm), dark).otherwise(dark + (1.0 - dark) * t),
    )


def eclipse_events(table: DataFrame) -> DataFrame:
    """Deepest moment per observer and date of a Sun-Moon table."""
    df = eclipse_factor(table).withColumn("date", F.to_date("ts"))
    order = F.struct("dimming", "separation", "ts")
    best = df.groupBy("obs_id", "date").agg(
        F.min_by(F.struct("ts", "dimming", "separation", "sun_alt", "sun_radius", "moon_radius"), order).alias("b")
    )
    return best.select("obs_id", "date", "b.*", (F.col("b.dimming") < 1.0).alias("eclipse"))


def _quick_declination(day: Column) -> Column:
    return -23.44 * F.cos((360.0 / 365.0) * (day + 10.0) * RAD)


def sun_times(latitudes: DataFrame, first_day: int = 0, last_day: int = 364) -> DataFrame:
    """Sunrise and sunset hour per latitude row and day, clamped near poles."""
    df = spread(latitudes).withColumn("day", F.explode(F.sequence(F.lit(first_day), F.lit(last_day))))
    df = staged(df, _dec=_quick_declination(F.col("day").cast("double")))
    half = acos_d(-tan_d("lat") * tan_d("_dec")) / 15.0
    df = staged(df, _half=half)
    return df.withColumn("sunrise", 12.0 - F.col("_half")).withColumn("sunset", 12.0 + F.col("_half")).drop("_dec", "_half")


def quick_sun(rows: DataFrame) -> DataFrame:
    """Approximate Sun altitude and azimuth for `lat, lon, day, ut_hour`."""
    df = staged(rows, _dec=_quick_declination(dbl("day")), _ha=(dbl("ut_hour") + dbl("lon") / 15.0 - 12.0) * 15.0)
    sin_alt = clamp(sin_d("_dec") * sin_d("lat") + cos_d("_dec") * cos_d("lat") * cos_d("_ha"), -1.0, 1.0)
    df = staged(df, _sa=sin_alt)
    df = staged(df, sun_alt=F.asin("_sa") * DEG)
    cos_alt = cos_d("sun_alt")
    az = acos_d((sin_d("_dec") - F.col("_sa") * sin_d("lat")) / F.when(F.abs(cos_alt) < 1e-4, 1.0).otherwise(cos_alt * cos_d("lat")))
    df = staged(df, _az=az)
    az = F.when(F.abs(cos_d("sun_alt")) < 1e-4, 180.0).when(sin_d("_ha") > 0, 360.0 - F.col("_az")).otherwise(F.col("_az"))
    return df.withColumn("sun_az", az).drop("_dec", "_ha", "_sa", "_az")


def twilight_limits(rows: DataFrame) -> DataFrame:
    """Limiting magnitude and ambient light from the Sun's altitude.

    `rows`: `sun_alt, dimming, full_limit, view_limit, bortle`.
    """
    s, full = F.col("sun_alt"), F.col("full_limit")
    sky = (
        F.when(s > 0, -10.0)
        .when(s > -6.0, -10.0 + 10.0 * (s / -6.0))
        .when(s > -12.0, 3.0 * ((s + 6.0) / -6.0))
        .when(s > -18.0, 3.0 + (full - 3.0) * ((s + 12.0) / -6.0))
        .otherwise(full)
    )
    base = F.when(s > 0, 1.0).when(s < -18.0, 0.0).otherwise(clamp(1.0 - s / -18.0, 0.0, 1.0))
    limit = F.least(sky + (1.0 - F.col("dimming")) * 14.0, F.col("view_limit"))
    light = base * (1.0 + (clamp("bortle", 1.0, 9.0) - 1.0) * 0.04)
    return rows.withColumn("sun_limit", sky).withColumn("final_limit", limit).withColumn("ambient_light", light)


