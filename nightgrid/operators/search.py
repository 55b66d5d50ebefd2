"""Sky search: tile counts, windows, fields of view, nearest match, regions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.angles import (
    DEG,
    RAD,
    acos_d,
    ang_sep,
    atan2_d,
    clamp,
    cos_d,
    dbl,
    r6,
    sin_d,
    wrap180,
    wrap360,
)
from nightgrid.functions.scale import chain, cut_lineage, shared_rows, sized_join, spread, staged
from nightgrid.functions.tiles import box_tiles, circle_lon_pad, tile_id
from nightgrid.operators.regions import CELL, inside_counts

# Sensor name, width and height in millimetres.
SENSORS = (("tiny", 5.37, 4.04), ("aps_c", 23.6, 15.7), ("full_frame", 36.0, 24.0))


def sky_tiles(stars: DataFrame, max_mag: float | None = None) -> DataFrame:
    """Rows per 1-degree tile and the running offset in tile order.

    At most 64,800 tiles remain after the aggregate, so the ordered window is
    bounded whatever the catalogue size.
    """
    ok = F.col("ra").isNotNull() & F.col("dec").isNotNull()
    if max_mag is not None:
        ok = ok & (F.col("mag") <= max_mag + 1e-6)
    dec = clamp(F.col("dec"), -90.0, 89.99999)
    tiles = stars.where(ok).groupBy(tile_id("ra", dec).alias("tile")).agg(F.count(F.lit(1)).alias("n_stars"))
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("offset", F.coalesce(F.sum("n_stars").over(before), F.lit(0)))


def search_pads(df: DataFrame) -> DataFrame:
    """Window pads from a field of view (`center_dec`, `fov_w`, `fov_h`)."""
    half_diag = 0.5 * F.sqrt(F.col("fov_w") * F.col("fov_w") + F.col("fov_h") * F.col("fov_h"))
    dec_pad = F.least(F.lit(90.0), F.greatest(F.lit(3.0), half_diag * 1.30 + 2.5))
    ra_pad = F.least(F.lit(180.0), dec_pad / F.greatest(F.lit(0.12), cos_d("center_dec")) + 2.0)
    return df.withColumn("dec_pad", dec_pad).withColumn("ra_pad", ra_pad)


def window_search(stars: DataFrame, windows: DataFrame) -> DataFrame:
    """Stars inside RA/Dec boxes with wrap-around and a magnitude limit.

    `windows`: `window_id, center_ra, center_dec, ra_pad, dec_pad, mag_limit`.
    Windows that are equal but for their id meet the stars once.
    """
    keyed = spread(shared_rows(windows, "window_id")).withColumn(
        "tile",
        F.explode(
            box_tiles(
                "center_ra",
                "center_dec",
                F.least(F.lit(180.0), F.col("ra_pad") + 1.5),
                F.least(F.lit(90.0), F.col("dec_pad") + 1.5),
            )
        ),
    )
    left = stars.withColumn("tile", tile_id("ra", "dec"))
    hit = sized_join(left, keyed, ["tile"])
    inside = (
        (F.abs(wrap180(F.col("ra") - F.col("center_ra"))) <= F.col("ra_pad"))
        & (F.abs(F.col("dec") - F.col("center_dec")) <= F.col("dec_pad"))
        & (F.col("mag") <= F.col("mag_limit"))
    )
    gone = ("tile", "ra_pad", "dec_pad", "center_ra", "center_dec", "mag_limit", "_keys")
    return hit.where(inside).select(*[c for c in hit.columns if c not in gone], F.inline("_keys"))


def field_sizes(df: DataFrame) -> DataFrame:
    """Field of view `fov_w, fov_h` (degrees) from sensor and focal length.

    Input columns: `sensor, focal_mm, shape` and optional `aspect`,
    `manual_w`, `manual_h`.  Unknown sensors fall back to the first preset.
    """

    def opt(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    width, height = F.lit(SENSORS[0][1]), F.lit(SENSORS[0][2])
    for key, w_mm, h_mm in SENSORS[1:]:
        width = F.when(F.col("sensor") == key, w_mm).otherwise(width)
        height = F.when(F.col("sensor") == key, h_mm).otherwise(height)
    focal = F.greatest(F.lit(1e-3), dbl("focal_mm"))
    manual = opt("manual_w").isNotNull()
    w0 = F.when(manual, F.greatest(F.lit(0.01), opt("manual_w"))).otherwise(2.0 * F.atan(width / (2.0 * focal)) * DEG)
    h0 = F.when(manual, F.greatest(F.lit(0.01), F.coalesce(opt("manual_h"), opt("manual_w")))).otherwise(
        2.0 * F.atan(height / (2.0 * focal)) * DEG
    )
    w0, h0 = F.greatest(F.lit(0.01), w0), F.greatest(F.lit(0.01), h0)
    ratio = clamp(opt("aspect"), 0.2, 5.0)
    shaped = (F.col("shape") == "rectangle") & ratio.isNotNull()
    w = F.when(shaped & (w0 < h0), F.greatest(F.lit(0.01), h0 * ratio)).otherwise(w0)
    h = F.when(shaped & (w0 >= h0), F.greatest(F.lit(0.01), w0 / ratio)).otherwise(h0)
    return df.withColumn("fov_w", w).withColumn("fov_h", h)


def fov_search(positions: DataFrame, fields: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Positions (`alt, az`) inside circular or rectangular fields.

    `fields`: `field_id, center_alt, center_az, fov_w, fov_h, shape`; `on`
    names further shared keys such as the observer.  Fields that are equal but
    for their id meet the positions once.
    """
    return _in_fields(positions, shared_rows(fields, "field_id"), on, F.inline("_keys"))


def _in_fields(positions: DataFrame, shapes: DataFrame, on: Sequence[str], key: Column) -> DataFrame:
    """`fov_search` for fields whose key is made by `key` after the filter."""
    half_w, half_h = F.col("fov_w") * 0.5, F.col("fov_h") * 0.5
    radius = F.least(half_w, half_h)
    rect = F.col("shape") == "rectangle"
    az_limit = half_w / F.greatest(F.lit(0.05), cos_d("center_alt"))
    lat_pad = F.when(rect, half_h).otherwise(radius) + 1e-6
    lon_pad = F.least(
        F.lit(180.0), F.when(rect, az_limit).otherwise(circle_lon_pad("center_alt", radius)) + 1e-6
    )
    tiles = box_tiles("center_az", "center_alt", lon_pad, lat_pad)
    # of the field alone, so computed before it meets positions
    sized = staged(spread(shapes), _az_limit=az_limit, _sin=sin_d("center_alt"), _cos=cos_d("center_alt"), _near=cos_d(radius), _tiles=tiles)
    keyed = sized.withColumn("tile", F.explode("_tiles")).drop("_tiles")
    hit = sized_join(positions.withColumn("tile", tile_id("az", "alt")), keyed, ["tile", *on])
    d_az = wrap180(F.col("az") - F.col("center_az"))
    in_rect = (F.abs(F.col("alt") - F.col("center_alt")) <= half_h) & (F.abs(d_az) <= F.col("_az_limit"))
    cos_dist = sin_d("alt") * F.col("_sin") + cos_d("alt") * F.col("_cos") * cos_d(d_az)
    in_circle = clamp(cos_dist, -1.0, 1.0) >= F.col("_near")
    gone = ("tile", "_az_limit", "_sin", "_cos", "_near", "_keys")
    return hit.where(F.when(rect, in_rect).otherwise(in_circle)).select(*[c for c in hit.columns if c not in gone], key)


def field_counts(
    positions: DataFrame, fields: DataFrame, pixels: int = 512, on: Sequence[str] = ()
) -> DataFrame:
    """Per field: objects in view, after its magnitude limit, after keeping
    one object per pixel, and the mean size bin of what is drawn.

    Fields that are equal but for their id are counted once, under the first of their ids.
    """
    shapes = shared_rows(fields, "field_id").withColumn("_shape", F.col("_keys")[0]["field_id"])
    hit = _in_fields(positions, shapes.drop("_keys"), on, F.lit(None).alias("_none"))
    x = wrap180(F.col("az") - F.col("center_az")) * cos_d("center_alt") / F.col("fov_w") + 0.5
    y = 0.5 - (F.col("alt") - F.col("center_alt")) / F.col("fov_h")
    hit = hit.withColumn("px", F.floor(x * float(pixels))).withColumn("py", F.floor(y * float(pixels)))
    lit_up = F.col("mag") <= F.col("mag_limit")
    per_pixel = hit.groupBy("_shape", "px", "py").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(lit_up).alias("n_lit"),
        F.min(F.when(lit_up, F.col("mag"))).alias("best"),
    )
    size = (
        F.when(F.col("best") <= -1.0, 5.0)
        .when(F.col("best") <= 0.0, 4.0)
        .when(F.col("best") <= 1.5, 3.0)
        .when(F.col("best") <= 3.0, 2.0)
        .when(F.col("best").isNotNull(), 1.0)
    )
    counted = per_pixel.groupBy("_shape").agg(
        F.sum("n").alias("in_view"),
        F.sum("n_lit").alias("after_mag_cut"),
        F.count("best").alias("after_bucket"),
        F.avg(size).alias("mean_radius"),
    )
    ids = shapes.select("_shape", F.inline("_keys")).distinct()
    return ids.join(counted.hint("merge"), "_shape").select("field_id", "in_view", "after_mag_cut", "after_bucket", "mean_radius")


def with_vector(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Adds the unit vector `_x, _y, _z` of a direction."""
    return staged(df, _x=cos_d(lat) * cos_d(lon), _y=cos_d(lat) * sin_d(lon), _z=sin_d(lat))


def cell_level(reach: float) -> int:
    """Level of the space cells for a reach in degrees: 2^level is at least the width of the ball."""
    return math.ceil(math.log2(4.0 * math.sin(math.radians(min(reach, 180.0)) / 2.0)))


def wide_cells(cat: DataFrame) -> DataFrame:
    """`cat` (ra, dec, reach) on the cells (level, cx, cy, cz) that its ball meets: at most eight, for any reach and place."""
    chord = 2.0 * F.sin(F.least(F.col("reach"), F.lit(180.0)) * (RAD / 2.0)) + 1e-9
    sized = staged(with_vector(cat, "ra", "dec"), _chord=chord)
    sized = staged(sized, level=F.least(F.ceil(F.log2(2.0 * F.col("_chord"))).cast("int"), F.lit(cell_level(180.0))))
    side = F.pow(F.lit(2.0), F.col("level"))
    for a in "xyz":
        lo, hi = (F.floor((F.col(f"_{a}") + s * F.col("_chord")) / side) for s in (-1.0, 1.0))
        sized = sized.withColumn(f"c{a}", F.explode(F.sequence(lo, hi)))
    return sized.drop("_x", "_y", "_z", "_chord")


def nearest_objects(
    targets: DataFrame, catalog: DataFrame, radius: float, pad: float = 0.05, tile_deg: float = 1.0
) -> DataFrame:
    """Best catalogue object per target on the sphere.

    Point objects reach `radius`; extended ones (`own_radius`, degrees) reach
    `max(radius, own_radius + pad)`.  The score is distance over reach, so a
    target inside a large object can prefer a close star.  Targets at one place
    are met once.
    `targets`: `target_id, t_ra, t_dec`; `catalog`: `object_id, ra, dec`.
    """
    own = F.coalesce(F.col("own_radius"), F.lit(0.0)) if "own_radius" in catalog.columns else F.lit(0.0)
    cat = catalog.select("object_id", "ra", "dec", F.greatest(F.lit(float(radius)), own + pad).alias("reach"))
    points = cat.where(F.col("reach") <= radius).withColumn("tile", tile_id("ra", "dec", tile_deg))
    # extended objects lie in space cells of a size that fits their own reach; a place probes one cell of each size
    wide = wide_cells(cat.where(F.col("reach") > radius))
    sizes = F.explode(F.sequence(F.lit(cell_level(radius)), F.lit(cell_level(180.0)))).alias("level")

    def scored(places: DataFrame) -> DataFrame:
        # points: the places spread over their neighbourhood, the catalogue stays put
        t_tiles = box_tiles("t_ra", "t_dec", circle_lon_pad("t_dec", F.lit(float(radius))), float(radius), tile_deg)
        places = spread(places)
        near = sized_join(points, places.withColumn("tile", F.explode(t_tiles)), ["tile"])
        probes = with_vector(places, "t_ra", "t_dec").select("*", sizes)
        cells = [F.floor(F.col(f"_{a}") / F.pow(F.lit(2.0), F.col("level"))).alias(f"c{a}") for a in "xyz"]
        met = sized_join(wide, probes.select(*places.columns, "level", *cells), ["level", "cx", "cy", "cz"]).drop("level", "cx", "cy", "cz")
        both = staged(near.drop("tile").unionByName(met), distance=ang_sep("t_ra", "t_dec", "ra", "dec"))
        both = both.where(F.col("distance") <= F.col("reach"))
        return staged(both, score=F.col("distance") / F.col("reach"))

    # the least score is a number, which is kept by hash: no pair is sorted or spilled.  Rows that reach it are then met again
    place = ["t_ra", "t_dec"]
    least = cut_lineage(scored(targets.select(*place).distinct()).groupBy(*place).agg(F.min(r6("score", 9)).alias("_least")))
    order = F.struct(r6("score", 9), "object_id")
    first = scored(least).where(r6("score", 9) == F.col("_least")).groupBy(*place).agg(F.min_by(F.struct("object_id", "distance", "score"), order).alias("b"))
    best = sized_join(targets.select("target_id", *place), first.select(*place, "b.*"), place)
    best = best.groupBy("target_id").agg(F.min_by(F.struct("object_id", "distance", "score"), order).alias("b"))
    return best.select("target_id", "b.object_id", "b.distance", "b.score")


def match_equivalent(a: DataFrame, b: DataFrame, eps: float = 1e-6, cell: float = 1e-3) -> DataFrame:
    """First equivalent row of `b` for each row of `a` (columns `a_id`, `b_seq`).

    Same object: equal ids when both have one, else RA (wrapped) and Dec within
    `eps`.  `a`: `a_id, sid, ra, dec`; `b`: `b_seq, sid, ra, dec`.  Copies in
    `b` collapse to their first row before any join, so a hot id or a pile of
    equal positions never multiplies.
    """

    def has(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""

    by_id = b.where(has("sid")).groupBy(F.trim(F.col("sid").cast("string")).alias("key")).agg(F.min("b_seq").alias("b_seq"))
    left_id = a.where(has("sid")).withColumn("key", F.trim(F.col("sid").cast("string")))
    on_id = sized_join(left_id, by_id, ["key"]).select("a_id", "b_seq")

    spots = b.groupBy(has("sid").alias("b_has"), "ra", "dec").agg(F.min("b_seq").alias("b_seq"))
    n = int(round(360.0 / cell))

    def span(x: Column) -> Column:
        return F.sequence(F.floor((x - eps) / cell).cast("int"), F.floor((x + eps) / cell).cast("int"))

    spots = (
        spots.withColumnRenamed("ra", "b_ra")
        .withColumnRenamed("dec", "b_dec")
        .withColumn("cy", F.explode(span(F.col("b_dec"))))
        .withColumn("cx", F.explode(span(wrap360("b_ra"))))
        .withColumn("cx", F.pmod("cx", F.lit(n)))
    )
    left = (
        a.select("a_id", has("sid").alias("a_has"), "ra", "dec")
        .withColumn("cy", F.floor(F.col("dec") / cell).cast("int"))
        .withColumn("cx", F.pmod(F.floor(wrap360("ra") / cell).cast("int"), F.lit(n)))
    )
    near = sized_join(left, spots, ["cx", "cy"]).where(
        ~(F.col("a_has") & F.col("b_has"))
        & (F.abs(wrap180(F.col("ra") - F.col("b_ra"))) <= eps)
        & (F.abs(F.col("dec") - F.col("b_dec")) <= eps)
    )
    pairs = on_id.unionByName(near.select("a_id", "b_seq"))
    return pairs.groupBy("a_id").agg(F.min("b_seq").alias("b_seq"))


def _arc_distance(alt1: Column, az1: Column, alt2: Column, az2: Column) -> Column:
    dot = sin_d(alt1) * sin_d(alt2) + cos_d(alt1) * cos_d(alt2) * cos_d(az2 - az1)
    return acos_d(dot)


def _side_columns(k: int) -> dict[str, Column]:
    """Unit vectors of corner `k` and the next one, and the angle between."""
    cols = {}
    for tag, p in (("a", F.col(f"_p{k}")), ("b", F.col(f"_p{(k + 1) % 4}"))):
        cols[f"_{tag}x{k}"] = cos_d(p["alt"]) * cos_d(p["az"])
        cols[f"_{tag}y{k}"] = cos_d(p["alt"]) * sin_d(p["az"])
        cols[f"_{tag}z{k}"] = sin_d(p["alt"])
    return cols


def _side_angle(k: int) -> Column:
    dot = sum((F.col(f"_a{c}{k}") * F.col(f"_b{c}{k}") for c in "xyz"), F.lit(0.0))
    return F.acos(clamp(dot, -1.0, 1.0))


def _side_points(k: int, n: int, first: int) -> Column:
    """(alt, az) structs along the great circle from corner `k` to the next."""
    omega = F.col(f"_o{k}")

    def weights(i: Column) -> Column:
        t = i.cast("double") / float(n - 1)
        return F.struct(
            (F.sin((1.0 - t) * omega) / F.sin(omega)).alias("a"), (F.sin(t * omega) / F.sin(omega)).alias("b")
        )

    def blend(w: Column) -> Column:
        return F.struct(*[(w["a"] * F.col(f"_a{c}{k}") + w["b"] * F.col(f"_b{c}{k}")).alias(c) for c in "xyz"])

    def to_sky(v: Column) -> Column:
        norm = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
        alt = F.asin(clamp(v["z"] / norm, -1.0, 1.0)) * DEG
        return F.struct(alt.alias("alt"), wrap360(atan2_d(v["y"], v["x"])).alias("az"))

    idx = F.sequence(F.lit(first), F.lit(n - 1))
    return F.when(omega < 1e-10, F.transform(idx, lambda i: F.col(f"_p{k}"))).otherwise(
        chain(idx, weights, blend, to_sky)
    )


def measure_shapes(measures: DataFrame) -> DataFrame:
    """Size columns and boundary outline of ruler, circle, square, rectangle.

    `measures`: `measure_id, tool, a_alt, a_az, b_alt, b_az, rot_deg`.  Adds
    `length, diameter, width, height, area`, the shape centre and `outline`, an
    array of (alt, az) structs (NULL for a ruler).
    """
    m = measures.select(
        "*",
        clamp("a_alt", -89.9, 89.9).alias("_a0"),
        wrap360("a_az").alias("_z0"),
        clamp("b_alt", -89.9, 89.9).alias("_a1"),
        wrap360("b_az").alias("_z1"),
    )
    circle, ruler = F.col("tool") == "circle", F.col("tool") == "ruler"
    square, rect = F.col("tool") == "square", F.col("tool") == "rectangle"
    a0, z0, a1, z1 = (F.col(c) for c in ("_a0", "_z0", "_a1", "_z1"))
    d_az = wrap180(z1 - z0)
    m = staged(
        m,
        _dist=_arc_distance(a0, z0, a1, z1),
        _w=_arc_distance(a0, z0, a0, z1),
        _h=_arc_distance(a0, z0, a1, z0),
        _sa=F.when(a1 - a0 >= 0, 1.0).otherwise(-1.0),
        _sz=F.when(d_az >= 0, 1.0).otherwise(-1.0),
        center_alt=F.when(circle, a0).otherwise(clamp((a0 + a1) * 0.5, -89.9, 89.9)),
        center_az=F.when(circle, z0).otherwise(wrap360(z0 + d_az * 0.5)),
    )
    side = F.greatest(F.col("_w"), F.col("_h"))
    m = staged(
        m,
        _width=F.greatest(F.lit(1e-6), F.when(square, side).otherwise(F.col("_w"))),
        _height=F.greatest(F.lit(1e-6), F.when(square, side).otherwise(F.col("_h"))),
        _r=F.greatest(F.lit(1e-6), F.col("_dist")),
        _rot=F.when(rect, dbl("rot_deg")).otherwise(0.0) * RAD,
        _cos=F.greatest(F.lit(0.05), cos_d("center_alt")),
    )

    def corner(sx: float, sy: float) -> Column:
        x = sx * F.col("_width") * 0.5 * F.col("_sz")
        y = sy * F.col("_height") * 0.5 * F.col("_sa")
        xr = x * F.cos("_rot") - y * F.sin("_rot")
        yr = x * F.sin("_rot") + y * F.cos("_rot")
        return F.struct(
            clamp(F.col("center_alt") + yr, -89.9, 89.9).alias("alt"),
            wrap360(F.col("center_az") + xr / F.col("_cos")).alias("az"),
        )

    m = staged(m, _p0=corner(-1, -1), _p1=corner(1, -1), _p2=corner(1, 1), _p3=corner(-1, 1))
    vectors: dict[str, Column] = {}
    for k in range(4):
        vectors.update(_side_columns(k))
    lat = clamp("center_alt", -89.9999, 89.9999)
    m = staged(m, **vectors, _sl=sin_d(lat), _cl=cos_d(lat), _sr=sin_d("_r"), _cr=cos_d("_r"))
    m = staged(m, **{f"_o{k}": _side_angle(k) for k in range(4)})

    def bearing(i: Column) -> Column:
        return i.cast("double") * (360.0 / 128.0 * RAD)

    def circle_lat(b: Column) -> Column:
        s = F.col("_sl") * F.col("_cr") + F.col("_cl") * F.col("_sr") * F.cos(b)
        return F.struct(b.alias("b"), clamp(s, -1.0, 1.0).alias("s"))

    def circle_sky(q: Column) -> Column:
        d = atan2_d(F.sin(q["b"]) * F.col("_sr") * F.col("_cl"), F.col("_cr") - F.col("_sl") * q["s"])
        return F.struct((F.asin(q["s"]) * DEG).alias("alt"), wrap360(F.col("center_az") + d).alias("az"))

    ring = chain(F.sequence(F.lit(0), F.lit(128)), bearing, circle_lat, circle_sky)
    box = F.concat(*[_side_points(k, 24, 0 if k == 0 else 1) for k in range(4)])
    m = staged(m, outline=F.when(circle, ring).when(square | rect, box))
    pi_r2 = F.col("_r") * F.col("_r") * F.lit(3.141592653589793)
    return m.select(
        *measures.columns,
        "center_alt",
        "center_az",
        F.when(ruler, F.col("_dist")).alias("length"),
        F.when(circle, 2.0 * F.col("_r")).alias("diameter"),
        F.when(square | rect, F.col("_width")).alias("width"),
        F.when(square | rect, F.col("_height")).alias("height"),
        F.when(circle, pi_r2).when(square | rect, F.col("_width") * F.col("_height")).alias("area"),
        "outline",
    )


def region_stats(measures: DataFrame, points: DataFrame, cell: float = CELL) -> DataFrame:
    """Sizes of each measured region and the even-odd count of points inside.

    `points`: `alt, az`.  Equal positions are counted once with a weight.
    Outlines are unwrapped around the shape centre and covered with cells
    (`inside_counts`): no row is made of a region and a point in its inner cells.
    Measures of one shape and place are met once and get the same result.
    """
    look = F.struct("tool", "a_alt", "a_az", "b_alt", "b_az", "rot_deg").alias("_look")
    alike = measures.select(look).distinct().select("_look", "_look.*", F.monotonically_increasing_id().alias("measure_id"))
    shapes = measure_shapes(spread(cut_lineage(alike), "measure_id"))
    flat = shapes.where(F.col("outline").isNotNull()).select(
        "measure_id",
        "center_az",
        F.transform("outline", lambda q: wrap180(q["az"] - F.col("center_az"))).alias("xs"),
        F.transform("outline", lambda q: q["alt"]).alias("ys"),
    )
    pts = points.groupBy("alt", "az").agg(F.count(F.lit(1)).alias("weight"))
    sizes = shapes.select("measure_id", "_look", "length", "diameter", "width", "height", "area")
    sizes = sizes.join(inside_counts(flat, pts, cell), "measure_id", "left").drop("measure_id")
    out = sized_join(measures.select("measure_id", "tool", look), sizes, ["_look"])
    columns = ["measure_id", "tool", "length", "diameter", "width", "height", "area"]
    return out.select(*columns, F.coalesce("n_inside", F.lit(0)).alias("n_inside"))


def constellation_edges(nodes: DataFrame) -> DataFrame:
    """Undirected distinct edges of consecutive connected nodes, with length.

    `nodes`: `group_id, pos, ra_deg, dec_deg, connect_from_prev` where `pos`
    counts 0, 1, 2… in a group.  The previous node comes from an equi-join on
    (group, pos), so one huge group spreads over all tasks.
    """
    prev = nodes.select(
        "group_id",
        (F.col("pos") + 1).alias("pos"),
        r6(wrap360("ra_deg")).alias("p_ra"),
        r6("dec_deg").alias("p_dec"),
    )
    cur = nodes.where("connect_from_prev").select(
        "group_id", "pos", r6(wrap360("ra_deg")).alias("c_ra"), r6("dec_deg").alias("c_dec")
    )
    pairs = cur.join(prev, ["group_id", "pos"])
    a, b = F.struct(F.col("p_ra").alias("ra"), F.col("p_dec").alias("dec")), F.struct(
        F.col("c_ra").alias("ra"), F.col("c_dec").alias("dec")
    )
    edges = pairs.select("group_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return edges.select(
        "group_id",
        F.col("a.ra").alias("ra1"),
        F.col("a.dec").alias("dec1"),
        F.col("b.ra").alias("ra2"),
        F.col("b.dec").alias("dec2"),
        ang_sep("a.ra", "a.dec", "b.ra", "b.dec").alias("length_deg"),
    )


