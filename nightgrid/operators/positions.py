"""Local and galactic positions, screen projection, pixel thinning, trails.

Observer columns: `obs_id, lat, lon, ut_hour, doy` and, for the precise
sidereal angle, `year`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.angles import (
    DEG,
    RAD,
    acos_d,
    as_col,
    asin_d,
    atan2_d,
    clamp,
    cos_d,
    dbl,
    sin_d,
    tan_d,
    wrap360,
)
from nightgrid.functions.scale import first_per_key, sized_join, spread, staged
from nightgrid.functions.tiles import tile_id

CELL = 15.0


def cell_radius(size: float) -> float:
    """No point of a cell is farther from its centre than this."""
    return math.degrees(math.acos(math.cos(math.radians(size / 2)) ** 2)) + 0.05


def sidereal_angle(precise: bool = False) -> Column:
    """Local sidereal angle of observer rows: short form, or GMST by year."""
    if not precise:
        return wrap360(100.0 + dbl("doy") * 0.9856 + dbl("ut_hour") * 15.0 + dbl("lon"))
    start = F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1))
    days = F.datediff(start, F.lit("2000-01-01").cast("date")).cast("double")
    d = days + dbl("doy") + dbl("ut_hour") / 24.0 - 0.5
    t = d / 36525.0
    gmst = 280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0
    return wrap360(gmst + dbl("lon"))


def alt_az(ra, dec, lat, lst, eps: float = 1e-12) -> tuple[Column, Column]:
    """Altitude and azimuth (north 0, east 90) for an hour angle `lst - ra`."""
    ha = (as_col(lst) - as_col(ra)) * RAD
    sin_dec, cos_dec, sin_lat, cos_lat = sin_d(dec), cos_d(dec), sin_d(lat), cos_d(lat)
    sin_alt = clamp(sin_dec * sin_lat + cos_dec * cos_lat * F.cos(ha), -1.0, 1.0)
    alt = F.asin(sin_alt)
    cos_az = clamp((sin_dec - sin_alt * sin_lat) / (F.cos(alt) * cos_lat + eps), -1.0, 1.0)
    az = F.acos(cos_az) * DEG
    return alt * DEG, F.when(F.sin(ha) > 0, 360.0 - az).otherwise(az)


def ra_text(ra) -> Column:
    """`05h 34m 32s` with carries."""
    total = F.floor(wrap360(ra) / 15.0 * 3600.0 + 0.5).cast("long") % 86400
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    two = [F.lpad(x.cast("long").cast("string"), 2, "0") for x in (h, m, s)]
    return F.concat(two[0], F.lit("h "), two[1], F.lit("m "), two[2], F.lit("s"))


def dec_text(dec) -> Column:
    """`+22.015°` with three decimals."""
    c = dbl(dec)
    sign = F.when(c >= 0, "+").otherwise("-")
    return F.concat(sign, F.format_string("%.3f", F.abs(c)), F.lit("°"))


def reached_cells(observers: DataFrame, min_alt: float, size: float = CELL) -> DataFrame:
    """Observers (`lat, lst`) once for each sky `cell` of `size` degrees that can reach `min_alt`."""
    n_lon = int(360 / size)
    cells = F.sequence(F.lit(0), F.lit(n_lon * int(180 / size) - 1))
    obs = observers.withColumn("cell", F.explode(cells))
    c_dec = F.floor(F.col("cell") / n_lon) * size - 90.0 + size / 2
    c_ra = (F.col("cell") % n_lon) * size + size / 2
    c_alt = asin_d(sin_d(c_dec) * sin_d("lat") + cos_d(c_dec) * cos_d("lat") * cos_d(F.col("lst") - c_ra))
    return obs.where(c_alt >= min_alt - cell_radius(size))


def sky_positions(
    objects: DataFrame,
    observers: DataFrame,
    min_alt: float = 0.0,
    precise: bool = False,
    limit_col: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Objects above `min_alt` for each observer, with `alt, az, lst`.

    Observers list the 15-degree sky cells that can reach `min_alt` at their
    sidereal time; objects join on their cell.  Cells wholly below the limit
    never meet, and a magnitude limit per observer (`limit_col`) is applied
    before the trigonometry.  `few` objects (a bounded number) are sent to the
    observers instead.
    """
    obs = reached_cells(spread(observers).withColumn("lst", sidereal_angle(precise)), min_alt)
    keep = ["obs_id", "lat", "lst", "cell"] + ([limit_col] if limit_col else [])
    cell = tile_id("ra", "dec", CELL).alias("cell")
    if few:
        hit = obs.select(*keep).join(F.broadcast(objects.select("*", cell)), "cell").select("cell", *objects.columns, *[c for c in keep if c != "cell"])
    else:
        hit = sized_join(spread(objects, "ra", "dec").select("*", cell), obs.select(*keep), ["cell"])
    if limit_col:
        hit = hit.where(F.col("mag") <= F.col(limit_col))
    # altitude first: rows below the limit skip the azimuth work
    ha = (F.col("lst") - F.col("ra")) * RAD
    sin_alt = clamp(sin_d("dec") * sin_d("lat") + cos_d("dec") * cos_d("lat") * F.cos(ha), -1.0, 1.0)
    out = staged(hit, _sa=sin_alt).where(F.col("_sa") >= math.sin(math.radians(min_alt)) - 1e-9)
    out = staged(out, alt=F.asin("_sa") * DEG).where(F.col("alt") >= min_alt)
    cos_az = (sin_d("dec") - F.col("_sa") * sin_d("lat")) / (cos_d("alt") * cos_d("lat") + 1e-12)
    out = staged(out, _z=acos_d(cos_az))
    az = F.when(F.sin(ha) > 0, 360.0 - F.col("_z")).otherwise(F.col("_z"))
    return staged(out, az=az).drop("cell", "_sa", "_z")


def pointings_to_radec(pointings: DataFrame, precise: bool = False) -> DataFrame:
    """RA/Dec of alt/az pointings (observer columns on the same row)."""
    p = pointings.withColumn("lst", sidereal_angle(precise))
    sin_dec = clamp(sin_d("alt") * sin_d("lat") + cos_d("alt") * cos_d("lat") * cos_d("az"), -1.0, 1.0)
    cos_dec = F.greatest(F.lit(1e-10), F.cos(F.asin(sin_dec)))
    cos_ha = clamp((sin_d("alt") - sin_d("lat") * sin_dec) / (cos_d("lat") * cos_dec + 1e-10), -1.0, 1.0)
    sin_ha = -sin_d("az") * cos_d("alt") / (cos_dec + 1e-10)
    return p.withColumn("ra", wrap360(F.col("lst") - atan2_d(sin_ha, cos_ha))).withColumn("dec", F.asin(sin_dec) * DEG)


# Rotation from J2000 equatorial to galactic axes.
GALACTIC = (
    (-0.0548755604, -0.8734370902, -0.4838350155),
    (0.4941094279, -0.4448296300, 0.7469822445),
    (-0.8676661490, -0.1980763734, 0.4559837762),
)


def galactic_lon_lat(ra, dec) -> tuple[Column, Column]:
    dec = clamp(dec, -90.0, 90.0)
    eq = (cos_d(dec) * cos_d(ra), cos_d(dec) * sin_d(ra), sin_d(dec))
    x, y, z = (row[0] * eq[0] + row[1] * eq[1] + row[2] * eq[2] for row in GALACTIC)
    return wrap360(atan2_d(y, x)), asin_d(z)


def galactic_positions(df: DataFrame) -> DataFrame:
    """Adds `gal_l, gal_b` to rows with `ra, dec`."""
    lon, lat = galactic_lon_lat("ra", "dec")
    return df.withColumn("gal_l", lon).withColumn("gal_b", lat)


def _screen(alt, az) -> tuple[Column, Column, Column]:
    """Screen x, y and the projection denominator for camera columns."""
    rel = dbl(az) - F.col("azimuth")
    denom = 1.0 + cos_d(alt) * cos_d(rel)
    k = 2.0 / F.when(denom > 1e-6, denom).otherwise(1.0)
    scale = F.col("height") * 0.5 * F.col("zoom")
    base = F.col("height") * 0.5 + F.col("height") * F.col("v_ratio")
    y_mid = 2.0 * tan_d(F.col("elevation") * 0.5)
    sx = F.col("width") * 0.5 + k * cos_d(alt) * sin_d(rel) * scale
    sy = base - (k * sin_d(alt) - y_mid) * scale
    return sx, sy, denom


def screen_positions(
    positions: DataFrame, cameras: DataFrame, on: Sequence[str] = ("obs_id",), margin: float = 30.0
) -> DataFrame:
    """Screen coordinates of positions in front of each camera and in bounds.

    Camera columns: the keys of `on`, `width, height, zoom, azimuth,
    elevation, v_ratio`.
    """
    hit = sized_join(positions, cameras, on)
    sx, sy, denom = _screen("alt", "az")
    out = staged(staged(hit, _den=denom).where(F.col("_den") > 1e-6), sx=sx, sy=sy).drop("_den")
    return out.where(
        (F.col("sx") >= -margin)
        & (F.col("sx") <= F.col("width") + margin)
        & (F.col("sy") >= -margin)
        & (F.col("sy") <= F.col("height") + margin)
    )


def screen_to_sky(points: DataFrame, cameras: DataFrame, on: Sequence[str] = ("obs_id",)) -> DataFrame:
    """Alt/az of screen points `sx, sy`: inverse of `screen_positions`."""
    p = sized_join(points, cameras, on)
    scale = F.col("height") * 0.5 * F.col("zoom")
    base = F.col("height") * 0.5 + F.col("height") * F.col("v_ratio")
    x = (F.col("sx") - F.col("width") * 0.5) / scale
    y = -((F.col("sy") - base) / scale) + 2.0 * tan_d(F.col("elevation") * 0.5)
    p = p.withColumn("_x", x).withColumn("_y", y)
    p = p.withColumn("_rho", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))
    c = 2.0 * F.atan(F.col("_rho") / 2.0)
    safe = F.when(F.col("_rho") < 1e-6, 1.0).otherwise(F.col("_rho"))
    centre = F.col("_rho") < 1e-6
    alt = F.when(centre, 0.0).otherwise(asin_d(F.col("_y") * F.sin(c) / safe))
    az = F.when(centre, F.col("azimuth")).otherwise(
        F.col("azimuth") + atan2_d(F.col("_x") * F.sin(c), safe * F.cos(c))
    )
    return p.withColumn("alt", alt).withColumn("az", wrap360(az)).drop("_x", "_y", "_rho")


def pixel_buckets(screen: DataFrame, key: str = "obs_id", ties: Sequence[Column] = ()) -> DataFrame:
    """Brightest object per screen pixel and field (`key`)."""
    cols = screen.columns
    px = F.when(F.col("sx") < 0, F.ceil("sx")).otherwise(F.floor("sx")).cast("int")
    py = F.when(F.col("sy") < 0, F.ceil("sy")).otherwise(F.floor("sy")).cast("int")
    keyed = screen.withColumn("px", px).withColumn("py", py)
    order = [F.col("mag"), F.col("source_id"), *ties]
    return first_per_key(keyed, [key, "px", "py"], order).select(*cols, "px", "py")


SEGMENT = "seg bigint, n_points bigint, first_step int, last_step int, length_px double, min_sx double, max_sy double"
TRAIL_ROWS = 20_000  # trails that are computed at once


def _trail_points(col: dict[str, np.ndarray], own: np.ndarray, step: np.ndarray):
    """Screen x, y and whether it is in front of the camera, for step `step` of row `own`."""
    v = {k: x[own] for k, x in col.items()}
    hour = v["start_hour"] + v["_span"] * step / (v["n_steps"] - 1)
    ha = (100.0 + v["doy"] * 0.9856 + hour * 15.0 + v["lon"] - v["ra"]) * RAD
    dec, lat = v["dec"] * RAD, v["lat"] * RAD
    sin_alt = np.clip(np.sin(dec) * np.sin(lat) + np.cos(dec) * np.cos(lat) * np.cos(ha), -1.0, 1.0)
    alt = np.arcsin(sin_alt)
    z = np.arccos(np.clip((np.sin(dec) - sin_alt * np.sin(lat)) / (np.cos(alt) * np.cos(lat) + 1e-10), -1.0, 1.0)) * DEG
    rel = (np.where(np.sin(ha) > 0, 360.0 - z, z) - v["azimuth"]) * RAD
    denom = 1.0 + np.cos(alt) * np.cos(rel)
    k = 2.0 / np.where(denom > 1e-6, denom, 1.0)
    scale = v["height"] * 0.5 * v["zoom"]
    middle = 2.0 * np.tan(v["elevation"] * 0.5 * RAD)
    sx = v["width"] * 0.5 + k * np.cos(alt) * np.sin(rel) * scale
    sy = v["height"] * 0.5 + v["height"] * v["v_ratio"] - (k * np.sin(alt) - middle) * scale
    return sx, sy, denom >= 1e-6


def _trails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Islands of joined points of each trail; a batch is computed as one array of points."""
    for whole in batches:
        for lo in range(0, whole.num_rows, TRAIL_ROWS):
            batch = whole.slice(lo, TRAIL_ROWS)
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n not in ("session_id", "source_id")}
            n = col["n_steps"].astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            sx, sy, ok = _trail_points(col, own, step)
            joined, goes_on, gap = np.zeros(len(own), bool), np.zeros(len(own), bool), np.zeros(len(own))
            inner = own[1:] == own[:-1]
            joined[1:], goes_on[:-1] = ok[:-1] & inner, ok[1:] & inner
            gap[1:] = np.abs(np.diff(sx)) + np.abs(np.diff(sy))
            linked = joined & (gap <= np.minimum(col["width"], col["height"])[own] * 0.5)
            cuts = np.cumsum(~linked)
            seg = cuts - np.append(0, cuts)[np.cumsum(n) - n][own]
            kept = np.flatnonzero(ok & (joined | goes_on))
            if not len(kept):
                continue
            own, seg, step, sx, sy = own[kept], seg[kept], step[kept], sx[kept], sy[kept]
            fresh = np.ones(len(kept), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (seg[1:] != seg[:-1])
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(kept)) - 1
            length = np.add.reduceat(np.where(linked[kept], gap[kept], 0.0), at)
            rows = pa.array(own[at])
            cols = [batch.column("session_id").take(rows), batch.column("source_id").take(rows), pa.array(seg[at])]
            cols += [pa.array(last - at + 1), pa.array(step[at], pa.int32()), pa.array(step[last], pa.int32()), pa.array(length)]
            cols += [pa.array(np.minimum.reduceat(sx, at)), pa.array(np.maximum.reduceat(sy, at))]
            yield pa.RecordBatch.from_arrays(cols, ["session_id", "source_id", *[f.split()[0] for f in SEGMENT.split(", ")]])


def star_trails(
    stars: DataFrame, sessions: DataFrame, steps_per_hour: float = 4.0, mag_cap: float | None = None
) -> DataFrame:
    """Trail segments of each star in each session.

    `sessions`: `session_id, lat, lon, doy, start_hour, end_hour, mag_limit`
    plus the camera columns of `screen_positions`.  Stars meet sessions on
    whole-magnitude bins; the at most 50 steps of a trail are made from its row
    and its segments leave in its place, so nothing is exchanged after that join.  A trail breaks at points
    behind the camera and at jumps over half the shorter screen side.
    `mag_cap` drops fainter stars than it, whatever the session asks for.
    """
    span = F.col("end_hour") - F.col("start_hour")
    span = F.when(span < -12.0, span + 24.0).when(span > 12.0, span - 24.0).otherwise(span)
    ses = sessions.withColumn("_span", span).where(F.abs("_span") >= 0.001)
    ses = ses.withColumn(
        "n_steps", F.greatest(F.lit(2), F.least(F.lit(50), F.floor(F.abs("_span") * steps_per_hour).cast("int")))
    )
    limit = F.col("mag_limit") if mag_cap is None else F.least(F.col("mag_limit"), F.lit(float(mag_cap)))
    ses = ses.withColumn("_cut", limit + 1.0)
    top = F.floor("_cut").cast("int")
    ses = ses.withColumn("mag_bin", F.explode(F.sequence(F.lit(-30), top)))
    cat = stars.select("source_id", "ra", "dec", "mag", F.greatest(F.lit(-30), F.floor("mag").cast("int")).alias("mag_bin"))
    hit = sized_join(spread(cat, "source_id"), ses, ["mag_bin"]).where(F.col("mag") < F.col("_cut"))
    numbers = ["ra", "dec", "lat", "lon", "doy", "start_hour", "_span", "n_steps", "width", "height", "zoom", "azimuth", "elevation", "v_ratio"]
    hit = hit.select("session_id", "source_id", *[dbl(c).alias(c) for c in numbers]).dropna()
    kinds = ", ".join(f"{c} {hit.schema[c].dataType.simpleString()}" for c in ("session_id", "source_id"))
    return hit.mapInArrow(_trails, f"{kinds}, {SEGMENT}")
