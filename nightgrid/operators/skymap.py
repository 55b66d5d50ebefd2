"""Pixel jobs on sky maps: stretch, blur, point removal, HEALPix, sampling.

Pixels are rows `(r, c, value columns…)`; the raster size is metadata.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.angles import clamp, dbl, sin_d, wrap360
from nightgrid.functions.scale import cut_lineage, exact_quantiles, sized_join, staged
from nightgrid.operators.positions import galactic_lon_lat


def _finite_or_zero(c: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c) | (c == inf) | (c == -inf), 0.0).otherwise(c)


def _quantile_columns(pixels: DataFrame, value: str, probs: dict[str, float], by: Sequence[str]) -> DataFrame:
    q = exact_quantiles(pixels, value, list(probs.values()), by)
    aggs = [F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for n, p in probs.items()]
    return q.groupBy(*by).agg(*aggs)


def robust_normalize(pixels: DataFrame, channel: str = "channel") -> DataFrame:
    """Per channel stretch of `v` from percentile 1 to 99, else min to max."""
    px = pixels.withColumn("v", _finite_or_zero(dbl("v")))
    ends = px.groupBy(channel).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    cuts = _quantile_columns(px, "v", {"_a": 0.01, "_b": 0.99}, [channel]).join(ends, channel)
    use = F.col("_b") > F.col("_a")
    cuts = cuts.select(
        channel, F.when(use, F.col("_a")).otherwise(F.col("_lo")).alias("_a"), F.when(use, F.col("_b")).otherwise(F.col("_hi")).alias("_b")
    )
    out = sized_join(px, cuts, [channel])
    span = F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a"))
    return out.withColumn("v", F.coalesce(clamp((F.col("v") - F.col("_a")) / span, 0.0, 1.0), F.lit(0.0))).drop("_a", "_b")


def box_blur(pixels: DataFrame, columns: Sequence[str], radius: int, nrows: int, ncols: int) -> DataFrame:
    """Mean over (2 radius + 1)^2 with reflected borders, axis by axis.

    Each window holds one image row or column, whose length is the raster
    side; border rows are mirrored by repeating at most `2 radius` pixels.
    """
    if radius <= 0:
        return pixels
    keep = [c for c in pixels.columns if c not in columns]

    def along(df: DataFrame, axis: str, other: str, n: int) -> DataFrame:
        at = F.col(axis)
        spots = F.array(at, F.when((at >= 1) & (at <= radius), -at), F.when((at >= n - 1 - radius) & (at <= n - 2), 2 * (n - 1) - at))
        wide = df.withColumn("_at", F.explode(F.filter(spots, lambda x: x.isNotNull())))
        w = Window.partitionBy(other).orderBy("_at").rowsBetween(-radius, radius)
        wide = wide.select(*keep, "_at", *[F.avg(c).over(w).alias(c) for c in columns])
        return wide.where(F.col("_at") == at).drop("_at")

    return along(along(pixels, "c", "r", ncols), "r", "c", nrows)


def luminance() -> Column:
    return clamp(F.col("red") * 0.299 + F.col("green") * 0.587 + F.col("blue") * 0.114, 0.0, 1.0)


def remove_point_sources(
    pixels: DataFrame, nrows: int, ncols: int, sigmas: float = 3.8, radius: int = 5, grow: int = 2
) -> tuple[DataFrame, dict[str, float]]:
    """Star-free `red, green, blue` with a `masked` flag, and the statistics.

    The blurred image is used by several passes and is checkpointed; the four
    robust statistics are single numbers.
    """
    rgb = ["red", "green", "blue"]
    px = pixels.select("r", "c", *rgb).withColumn("lum", luminance())
    soft = px.select("*", F.col("lum").alias("b_lum"), *[F.col(c).alias(f"b_{c}") for c in rgb])
    soft = box_blur(soft, ["b_lum", "b_red", "b_green", "b_blue"], max(2, radius), nrows, ncols)
    soft = cut_lineage(soft.withColumn("res", F.col("lum") - F.col("b_lum")))
    med = exact_quantiles(soft, "res", [0.5]).first()["quantile"]
    dev = soft.select(F.abs(F.col("res") - med).alias("dev"))
    sigma = 1.4826 * exact_quantiles(dev, "dev", [0.5]).first()["quantile"]
    if sigma <= 1e-6:
        sigma = soft.agg(F.stddev_pop("res").alias("s")).first()["s"]
    if not sigma or sigma <= 1e-6:
        sigma = 1e-3
    limit = max(0.004, sigmas * sigma)
    high = exact_quantiles(soft, "lum", [0.68]).first()["quantile"]
    mask = F.when((F.col("res") > limit) & (F.col("lum") > high), 1.0).otherwise(0.0)
    soft = soft.withColumn("mask", mask)
    if grow > 0:
        soft = box_blur(soft, ["mask"], grow, nrows, ncols)
    hit = F.col("mask") > (1e-4 if grow > 0 else 0.5)
    out = soft.select(
        "r",
        "c",
        *[F.when(hit, clamp(f"b_{c}", 0.0, 1.0)).otherwise(clamp(c, 0.0, 1.0)).alias(c) for c in rgb],
        hit.alias("masked"),
    )
    return out, {"sigma": float(sigma), "threshold": float(limit), "p68": float(high)}


def luminance_alpha(pixels: DataFrame, floor: float = 0.05, gamma: float = 0.85) -> DataFrame:
    """8-bit colour and an alpha that grows with luminance."""
    part = clamp((luminance() - floor) / max(1e-6, 1.0 - floor), 0.0, 1.0)
    alpha = F.pow(part, F.lit(max(0.1, gamma)))

    def u8(c: Column) -> Column:
        return clamp(F.bround(c * 255.0), 0.0, 255.0).cast("int")

    return pixels.select("r", "c", *[u8(F.col(c)).alias(c) for c in ("red", "green", "blue")], u8(alpha).alias("alpha"))


def alpha_report(rgba: DataFrame) -> DataFrame:
    return rgba.agg(F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"), F.count(F.lit(1)).alias("n_pixels"))


def healpix_pixel(df: DataFrame, nside: int, nest: bool = False, lon: str = "ra", lat: str = "dec", out: str = "pix") -> DataFrame:
    """Adds the HEALPix pixel number (RING or NEST) of a position."""
    n = float(nside)
    df = staged(df, _z=sin_d(lat), _tt=wrap360(lon) / 90.0)
    df = staged(df, _za=F.abs("_z"), _t1=n * (0.5 + F.col("_tt")), _t2=n * F.col("_z") * 0.75, _nt=F.least(F.lit(3), F.floor("_tt")))
    df = staged(
        df,
        _belt=F.col("_za") <= 2.0 / 3.0,
        _tmp=n * F.sqrt(3.0 * (1.0 - F.col("_za"))),
        _tp=F.col("_tt") - F.col("_nt"),
        _jp=F.floor(F.col("_t1") - F.col("_t2")),
        _jm=F.floor(F.col("_t1") + F.col("_t2")),
    )
    df = staged(df, _cp=F.floor(F.col("_tp") * F.col("_tmp")), _cm=F.floor((1.0 - F.col("_tp")) * F.col("_tmp")))
    jp, jm, cp, cm, belt = (F.col(x) for x in ("_jp", "_jm", "_cp", "_cm", "_belt"))
    if nest:
        face_p, face_m = F.floor(jp / nside), F.floor(jm / nside)
        same = F.when(face_p == 4, F.lit(4)).otherwise(face_p + 4)
        belt_face = F.when(face_p == face_m, same).when(face_p < face_m, face_p).otherwise(face_m + 8)
        cp, cm = F.least(F.lit(nside - 1), cp), F.least(F.lit(nside - 1), cm)
        north = F.col("_z") >= 0
        face = F.when(belt, belt_face).when(north, F.col("_nt")).otherwise(F.col("_nt") + 8)
        x = F.when(belt, F.pmod(jm, F.lit(nside))).when(north, nside - cm - 1).otherwise(cp)
        y = F.when(belt, nside - F.pmod(jp, F.lit(nside)) - 1).when(north, nside - cp - 1).otherwise(cm)
        df = staged(df, _f=face.cast("long"), _x=x.cast("long"), _y=y.cast("long"))
        bits = F.lit(0).cast("long")
        for b in range(int(math.log2(nside))):
            for col, shift in (("_x", 2 * b), ("_y", 2 * b + 1)):
                bits = bits + F.shiftleft(F.shiftright(col, b).bitwiseAND(F.lit(1)), shift)
        pix = F.col("_f") * (nside * nside) + bits
        extra = ["_f", "_x", "_y"]
    else:
        ir = nside + 1 + jp - jm
        ip = F.pmod(F.floor((jp + jm - nside + (1 - F.pmod(ir, F.lit(2))) + 1) / 2), F.lit(4 * nside))
        belt_pix = 2 * nside * (nside - 1) + (ir - 1) * (4 * nside) + ip
        ring = cp + cm + 1
        around = F.pmod(F.floor(F.col("_tt") * ring), 4 * ring)
        cap = F.when(F.col("_z") > 0, 2 * ring * (ring - 1) + around).otherwise(
            12 * nside * nside - 2 * ring * (ring + 1) + around
        )
        pix = F.when(belt, belt_pix).otherwise(cap)
        extra = []
    temp = ["_z", "_tt", "_za", "_t1", "_t2", "_nt", "_belt", "_tmp", "_tp", "_jp", "_jm", "_cp", "_cm", *extra]
    return df.withColumn(out, pix.cast("long")).drop(*temp)


def nside_of(n_pixels: int) -> int:
    """NSIDE of a full map from its row count."""
    nside = int(round(math.sqrt(n_pixels / 12.0)))
    if nside <= 0 or 12 * nside * nside != n_pixels:
        raise ValueError(f"{n_pixels} rows are no full HEALPix map")
    return nside


def healpix_to_grid(hmap: DataFrame, nside: int, width: int, height: int, nest: bool = False) -> DataFrame:
    """Equirectangular grid: the map value under each cell centre.

    `hmap`: `pix, value`; pixels without a row and non-finite values give 0.
    """
    grid = hmap.sparkSession.range(width * height).select(
        F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c")
    )
    grid = grid.withColumn("ra", F.col("c") * (360.0 / width) + 180.0 / width).withColumn(
        "dec", 90.0 - (F.col("r") + 0.5) / float(height) * 180.0
    )
    grid = healpix_pixel(grid, nside, nest)
    out = sized_join(grid, hmap.select("pix", F.col("value").cast("double").alias("value")), ["pix"], "left")
    return out.select("r", "c", _finite_or_zero(F.col("value")).alias("value"))


def quantize_u16(pixels: DataFrame, low: float = 1.0, high: float = 99.5) -> DataFrame:
    """16-bit stretch of `v` between two percentiles; non-finite becomes 0."""
    v = dbl("v")
    inf = F.lit(float("inf"))
    px = pixels.withColumn("v", F.when(F.isnan(v) | (v == inf) | (v == -inf), None).otherwise(v))
    q = {r["prob"]: r["quantile"] for r in exact_quantiles(px, "v", [low / 100.0, high / 100.0]).collect()}
    a, b = q.get(low / 100.0, 0.0), q.get(high / 100.0, 1.0)
    b = b if b > a else a + 1e-6
    norm = clamp((F.col("v") - a) / (b - a), 0.0, 1.0)
    return px.withColumn("u16", F.coalesce(F.bround(norm * 65535.0), F.lit(0.0)).cast("int"))


def map_stencils(pixels: DataFrame, value: str, nrows: int, ncols: int) -> DataFrame:
    """Each pixel with its right, lower and diagonal neighbour; columns wrap."""
    spots = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))])
    put = pixels.select("r", "c", F.col(value).alias("_v"), F.explode(spots).alias("k"))
    put = put.select(
        (F.col("r") - F.col("k.dr")).alias("r"),
        F.pmod(F.col("c") - F.col("k.dc"), F.lit(ncols)).cast("int").alias("c"),
        "_v",
        (F.col("k.dr") * 2 + F.col("k.dc")).alias("k"),
    )
    out = put.groupBy("r", "c").agg(*[F.max(F.when(F.col("k") == i, F.col("_v"))).alias(f"h{i}") for i in range(4)])
    last = F.col("r") == nrows - 1
    return (
        out.where("r >= 0")
        .withColumn("h2", F.when(last, F.col("h0")).otherwise(F.col("h2")))
        .withColumn("h3", F.when(last, F.col("h1")).otherwise(F.col("h3")))
    )


def sample_map(
    points: DataFrame,
    stencils: DataFrame,
    nrows: int,
    ncols: int,
    frame: str = "galactic",
    offset: float = 0.0,
    lat_flip: bool = False,
    lon_flip: bool = False,
    out: str = "sample",
) -> DataFrame:
    """Bilinear map value at `ra, dec` of each point."""
    if frame == "galactic":
        lon, lat = galactic_lon_lat("ra", "dec")
    elif frame == "equatorial":
        lon, lat = wrap360("ra"), clamp("dec", -90.0, 90.0)
    else:
        raise ValueError(f"unknown frame {frame!r}")
    pts = staged(points, _lon=lon, _lat=-lat if lat_flip else lat)
    u = wrap360(F.col("_lon") + offset) / 360.0
    if lon_flip:
        u = (1.0 - u) - F.floor(1.0 - u)
    v = clamp(1.0 - (F.col("_lat") + 90.0) / 180.0, 0.0, 1.0)
    pts = staged(pts, _x=u * float(ncols), _y=v * float(max(1, nrows - 1)))
    pts = pts.withColumn("c", (F.floor("_x") % ncols).cast("int")).withColumn("r", F.floor("_y").cast("int"))
    hit = sized_join(pts, stencils, ["r", "c"], "left")
    tx, ty = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    top = F.col("h0") * (1.0 - tx) + F.col("h1") * tx
    low = F.col("h2") * (1.0 - tx) + F.col("h3") * tx
    return hit.withColumn(out, top * (1.0 - ty) + low * ty).select(*points.columns, out)


def normalize_dust(pixels: DataFrame, u16: bool = False) -> DataFrame:
    """Dust `v` to 0..1: 16-bit values by 65535, others by their extremes."""
    if u16:
        return pixels.withColumn("v", dbl("v") / 65535.0)
    e = pixels.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = e["lo"], e["hi"]
    if lo is None or hi <= lo + 1e-12:
        return pixels.withColumn("v", F.lit(0.0))
    return pixels.withColumn("v", (dbl("v") - lo) / (hi - lo))


def dust_modulation(points: DataFrame, density: float = 1.0, extinction: float = 0.5, dust: str = "dust") -> DataFrame:
    """Opacity gain and colour loss from a sampled dust value."""
    return points.withColumn("density_gain", clamp(1.0 + density * F.col(dust), 0.0, 4.0)).withColumn(
        "extinction_gain", clamp(1.0 - extinction * F.col(dust), 0.0, 1.0)
    )


def map_gain(pixels: DataFrame) -> DataFrame:
    """One row: brightness gain of a dark map from its top percentile."""
    top = pixels.select(F.greatest("red", "green", "blue").alias("m"))
    q = exact_quantiles(top, "m", [0.9999])
    p = F.col("quantile")
    return q.select(p.alias("p9999"), F.when(p <= 1e-6, 1.0).otherwise(clamp(0.62 / p, 1.0, 4.5)).alias("gain"))
