"""Light pollution on cell tables `(r, c, v)`: cleaning, convolution, sky
brightness, Bortle classes, limiting-magnitude maps, dome scans, UTM 31N."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.angles import DEG, RAD, clamp, cos_d, dbl, sin_d
from nightgrid.functions.scale import sized_join, spread, staged

Kernel = list[tuple[int, int, float]]


def clean_cells(cells: DataFrame, rule: str = "raster", nodata: float | None = None) -> DataFrame:
    """NULL or zero for unusable radiance.

    `raster`: the nodata marker and values over 1e10 become NULL;
    `point`: also values under 0 or over 1e6; `region`: values under 0 or
    over 1e10 become 0.
    """
    v = dbl("v")
    v = F.when(F.isnan(v), None).otherwise(v)
    if nodata is not None:
        v = F.when(v == float(nodata), None).otherwise(v)
    if rule == "raster":
        out = F.when(v > 1e10, None).otherwise(v)
    elif rule == "point":
        out = F.when((v < 0) | (v > 1e6), None).otherwise(v)
    elif rule == "region":
        out = F.when((v < 0) | (v > 1e10), 0.0).otherwise(v)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return cells.withColumn("v", out)


def _kernel(weight, max_radius: float, res: float) -> Kernel:
    halo = math.ceil(max_radius / res)
    cells = []
    for dr in range(-halo, halo + 1):
        for dc in range(-halo, halo + 1):
            r = math.sqrt(dr * dr + dc * dc) * res
            if r <= max_radius:
                cells.append((dr, dc, weight(r)))
    total = sum(w for _, _, w in cells)
    return [(a, b, w / total) for a, b, w in cells] if total > 0 else cells


def gaussian_kernel(sigma_km: float, max_radius_km: float, res_km: float) -> Kernel:
    """Normalised (dr, dc, weight) list cut at a radius."""
    return _kernel(lambda r: math.exp(-(r * r) / (2.0 * sigma_km * sigma_km)), max_radius_km, res_km)


def power_law_kernel(p: float, r0_km: float, lambda_km: float, max_radius_km: float, res_km: float) -> Kernel:
    """Scattering kernel `(r0/(r+r0))^p * exp(-r/lambda)`, normalised."""

    def weight(r: float) -> float:
        decay = math.exp(-r / lambda_km) if lambda_km > 0 else 1.0
        return (r0_km / (r + r0_km)) ** p * decay

    return _kernel(weight, max_radius_km, res_km)


def _offsets(kernel: Kernel) -> Column:
    """Literal array of kernel offsets: its size is set by the parameters."""
    rows = [F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(w).alias("w")) for a, b, w in kernel]
    return F.array(*rows)


SMALL_KERNEL = 1024
SCATTER_BLOCK = 32  # cells of a block side


def convolve_cells(cells: DataFrame, kernel: Kernel, tile: int = 1024) -> DataFrame:
    """Kernel sum per cell; nothing outside the raster.

    NULL and NaN count as 0 and several rows of one cell are summed first, so
    both ways below give the same rows.  Small kernels scatter each cell over its neighbours and sum with a map-side
    partial aggregate.  Large ones would multiply the table by the kernel area
    and go through tiles and FFTs instead.
    """
    cells = whole_cells(cells)
    if len(kernel) <= SMALL_KERNEL:
        return _convolve_scatter(cells, kernel)
    return convolve_tiled(cells, kernel, tile)


def whole_cells(cells: DataFrame) -> DataFrame:
    """One row per cell with a finite value: NULL and NaN are 0, repeated cells add up."""
    v = F.coalesce(F.nanvl(dbl("v"), F.lit(0.0)), F.lit(0.0))
    return cells.groupBy("r", "c").agg(F.sum(v).alias("v"))


def _convolve_scatter(cells: DataFrame, kernel: Kernel) -> DataFrame:
    # blocks of cells, so that most of what a cell hands on is added up before the exchange
    block = [F.floor(F.col(x) / SCATTER_BLOCK) for x in ("r", "c")]
    put = spread(cells, *block).select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"), F.explode(_offsets(kernel)).alias("k"))
    put = put.select(
        (F.col("r") + F.col("k.dr")).alias("r"),
        (F.col("c") + F.col("k.dc")).alias("c"),
        (F.col("v") * F.col("k.w")).alias("p"),
        ((F.col("k.dr") == 0) & (F.col("k.dc") == 0)).alias("home"),
    )
    out = put.groupBy("r", "c").agg(F.sum("p").alias("v"), F.max("home").alias("home"))
    return out.where("home").select("r", "c", "v")


def _fast_size(n: int) -> int:
    """The least length from n on whose only prime factors are 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def _spread_tile(kernel: Kernel, tile: int):
    """One tile to the parts of its padded result, a row for each tile that a part lies in."""
    halo = max(max(abs(a), abs(b)) for a, b, _ in kernel)
    drs, dcs, weights = (np.array(x) for x in zip(*kernel))
    made: dict[tuple, np.ndarray] = {}

    def transformed(shape: tuple) -> np.ndarray:
        if shape not in made:
            ker = np.zeros((2 * halo + 1, 2 * halo + 1))
            ker[drs + halo, dcs + halo] = weights
            made.clear()
            made[shape] = np.fft.rfft2(ker, shape)
        return made[shape]

    def run(cells: pa.Table) -> pa.Table:
        r, c, v = (cells[n].to_numpy() for n in ("r", "c", "v"))
        r0, c0 = int(r.min()), int(c.min())
        grid = np.zeros((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1))
        grid[r - r0, c - c0] = v
        full = tuple(n + 2 * halo for n in grid.shape)
        shape = tuple(_fast_size(n) for n in full)
        out = np.fft.irfft2(np.fft.rfft2(grid, shape) * transformed(shape), shape)[: full[0], : full[1]]
        rows, top, left = [], r0 - halo, c0 - halo
        for tr in range(top // tile, (top + full[0] - 1) // tile + 1):
            for tc in range(left // tile, (left + full[1] - 1) // tile + 1):
                y0, x0 = max(top, tr * tile), max(left, tc * tile)
                part = out[y0 - top : min(full[0], (tr + 1) * tile - top), x0 - left : min(full[1], (tc + 1) * tile - left)]
                own = tr == r0 // tile and tc == c0 // tile
                home = np.stack([r, c]).astype(np.int32).tobytes() if own else None
                rows.append((tr, tc, y0, x0, part.shape[0], part.shape[1], np.ascontiguousarray(part).tobytes(), home))
        return pa.table([pa.array(col, t) for col, t in zip(zip(*rows), (*[pa.int32()] * 6, pa.binary(), pa.binary()))], PART_NAMES)

    return run


PART_NAMES = ["tr", "tc", "r0", "c0", "height", "width", "sums", "home"]


def _add_parts(parts: pa.Table) -> pa.Table:
    """Overlapping parts of one tile added up, at the cells that the tile holds."""
    rows = parts.to_pylist()
    home = [p["home"] for p in rows if p["home"] is not None]
    if not home:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.float64())], ["r", "c", "v"])
    r, c = np.frombuffer(home[0], np.int32).reshape(2, -1)
    total = np.zeros(len(r))
    for p in rows:
        y, x = r - p["r0"], c - p["c0"]
        on = (y >= 0) & (x >= 0) & (y < p["height"]) & (x < p["width"])
        total[on] += np.frombuffer(p["sums"]).reshape(p["height"], p["width"])[y[on], x[on]]
    return pa.table([pa.array(r), pa.array(c), pa.array(total)], ["r", "c", "v"])


def convolve_tiled(cells: DataFrame, kernel: Kernel, tile: int = 1024) -> DataFrame:
    """Same result by overlap-add: each cell goes to one tile, each tile is one
    FFT of its cells and the margin that the kernel reaches.  What lies in
    other tiles goes there as one strip a tile, and a tile adds up the strips it
    gets: (1 + 2 halo / tile)^2 sums a cell are shuffled, and no cell twice.  A
    task holds one tile with its margin, whatever the raster's size."""
    tiled = whole_cells(cells).withColumn("tr", F.floor(F.col("r") / tile).cast("int")).withColumn("tc", F.floor(F.col("c") / tile).cast("int"))
    schema = "tr int, tc int, r0 int, c0 int, height int, width int, sums binary, home binary"
    parts = tiled.groupBy("tr", "tc").applyInArrow(_spread_tile(kernel, tile), schema)
    return parts.groupBy("tr", "tc").applyInArrow(_add_parts, "r int, c int, v double")


def sqm_class(sqm) -> Column:
    """Bortle class 1-9 of a zenith brightness column."""
    # Lower SQM bound of classes 1 to 8.
    bounds = (21.99, 21.89, 21.69, 20.49, 19.50, 18.94, 18.38, 17.80)
    c = sqm if isinstance(sqm, Column) else F.col(sqm)
    out = F.when(c.isNull(), None)
    for i, lo in enumerate(bounds):
        out = out.when(c >= lo, i + 1)
    return out.otherwise(9).cast("int")


def zenith_sqm(
    points: DataFrame,
    cells: DataFrame,
    kernel: Kernel,
    x0: float = 0.0,
    y0: float = 0.0,
    cell: float = 1.0,
    slope: float = 2.5,
) -> DataFrame:
    """Zenith brightness and class at points from valid cells around them.

    `points`: `point_id, x, y`; row = floor((y-y0)/cell), column likewise.
    Weighted mean over valid cells, plain mean when the weights vanish,
    21.0 / class 4 when no valid cell is in reach.
    """
    at = points.select(
        "point_id",
        F.floor((F.col("y") - y0) / cell).cast("int").alias("pr"),
        F.floor((F.col("x") - x0) / cell).cast("int").alias("pc"),
        F.explode(_offsets(kernel)).alias("k"),
    )
    at = at.select(
        "point_id", (F.col("pr") + F.col("k.dr")).alias("r"), (F.col("pc") + F.col("k.dc")).alias("c"), F.col("k.w").alias("w")
    )
    valid = clean_cells(cells, "point").where(F.col("v").isNotNull())
    sums = sized_join(valid, at, ["r", "c"]).groupBy("point_id").agg(
        F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"), F.avg("v").alias("mean")
    )
    mean = F.when(F.col("w") < 1e-6, F.col("mean")).otherwise(F.col("wv") / F.col("w"))
    sqm = clamp(22.0 - slope * F.log10(F.greatest(mean, F.lit(1e-5)) + 0.001), 16.0, 22.0)
    out = points.select("point_id").join(sums.withColumn("sqm", sqm), "point_id", "left")
    return out.select(
        "point_id",
        F.coalesce("sqm", F.lit(21.0)).alias("sqm"),
        F.when(F.col("sqm").isNull(), 4).otherwise(sqm_class("sqm")).cast("int").alias("bortle"),
    )


def radiance_at(
    points: DataFrame, cells: DataFrame, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0
) -> DataFrame:
    """Cell value under each point (`x, y`), 0 outside the raster."""
    keyed = points.withColumn("r", F.floor((F.col("y") - y0) / cell).cast("int")).withColumn(
        "c", F.floor((F.col("x") - x0) / cell).cast("int")
    )
    vals = clean_cells(cells, "region").select("r", "c", F.col("v").alias("radiance"))
    out = sized_join(keyed, vals, ["r", "c"], "left")
    return out.withColumn("radiance", F.coalesce("radiance", F.lit(0.0))).drop("r", "c")


def bortle_classes(df: DataFrame) -> DataFrame:
    """Cells and share of the area per class (rows with `sqm`); nine rows."""
    per = df.where(F.col("sqm").isNotNull()).groupBy(sqm_class("sqm").alias("bortle")).agg(F.count(F.lit(1)).alias("n_cells"))
    return per.withColumn("share", F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy()))


def with_model_features(df: DataFrame, eps: float = 1e-3) -> DataFrame:
    return df.withColumn("x1", F.log10(F.col("agg_dvnl") + eps)).withColumn("x2", F.col("elevation_m") / 1000.0)


def fit_sqm_model(samples: DataFrame, eps: float = 1e-3) -> dict[str, float]:
    """Huber fit of `sqm = a + b log10(agg_dvnl + eps) + c elevation/1000`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ok = with_model_features(samples, eps).where("sqm is not null and x1 is not null and x2 is not null")
    data = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(ok)
    fit = LinearRegression(
        featuresCol="features", labelCol="sqm", loss="huber", epsilon=1.35, regParam=0.0, maxIter=100, tol=1e-9
    ).fit(data)
    return {"a": float(fit.intercept), "b": float(fit.coefficients[0]), "c": float(fit.coefficients[1]), "eps": eps}


def predict_sqm(cells: DataFrame, model: dict[str, float]) -> DataFrame:
    """Adds `sqm_pred`; NULL where an input is NULL."""
    x1 = F.log10(F.col("agg_dvnl") + model["eps"])
    return cells.withColumn("sqm_pred", model["a"] + model["b"] * x1 + model["c"] * (F.col("elevation_m") / 1000.0))


def fit_metrics(pred: DataFrame) -> DataFrame:
    """Mean absolute and root mean square error of `sqm_pred`."""
    d = F.col("sqm_pred") - F.col("sqm")
    return pred.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(d).alias("n"))


def mlim_map(cells: DataFrame, altitude: float = 90.0, k: float = 0.25) -> DataFrame:
    """Limiting magnitude at an altitude from `sqm`; NULL stays NULL."""
    h = math.radians(min(90.0, max(10.0, altitude)))
    loss = k * (1.0 / math.sin(h) - 1.0)
    out = cells.withColumn("bortle", sqm_class("sqm"))
    return out.withColumn("mlim", 7.6 - 0.5 * (F.col("bortle") - 1).cast("double") - loss)


def light_dome_scan(
    observers: DataFrame,
    cells: DataFrame,
    x0: float = 0.0,
    y0: float = 0.0,
    cell: float = 1000.0,
    az_step: int = 10,
    reach_m: int = 50_000,
    step_m: int = 2_000,
    top: int = 8,
) -> DataFrame:
    """Strongest sample per azimuth around observers (`obs_id, x, y`, metres),
    the `top` azimuths of each."""
    rays = observers.select("obs_id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(az_step))).alias("az"))
    rays = rays.select("*", F.explode(F.sequence(F.lit(step_m), F.lit(reach_m - 1), F.lit(step_m))).alias("dist"))
    rays = rays.select(
        "obs_id",
        "az",
        "dist",
        (F.col("x") + F.col("dist") * sin_d("az")).alias("x"),
        (F.col("y") + F.col("dist") * cos_d("az")).alias("y"),
    )
    seen = radiance_at(rays, cells, x0, y0, cell)
    best = seen.groupBy("obs_id", "az").agg(
        F.max("radiance").alias("radiance"), F.min_by("dist", F.struct(-F.col("radiance"), F.col("dist"))).alias("dist")
    )
    w = Window.partitionBy("obs_id").orderBy(F.desc("radiance"), "az")  # at most 360 / az_step rows
    return best.where(F.col("radiance") > 0.1).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# WGS84 ellipsoid and zone 31N.
_A, _F, _K0, _LON0 = 6378137.0, 1 / 298.257223563, 0.9996, 3.0
_E2 = 2 * _F - _F * _F
_EP2 = _E2 / (1 - _E2)


def to_utm31(points: DataFrame) -> DataFrame:
    """Adds `utm_x, utm_y` (metres) to rows with `lat, lon`."""
    phi, lam = dbl("lat") * RAD, (dbl("lon") - _LON0) * RAD
    e4, e6 = _E2**2, _E2**3
    p = staged(points, _s=F.sin(phi), _c=F.cos(phi), _t=F.tan(phi), _l=lam)
    p = staged(
        p,
        _n=_A / F.sqrt(1.0 - _E2 * F.col("_s") * F.col("_s")),
        _tt=F.col("_t") * F.col("_t"),
        _cc=_EP2 * F.col("_c") * F.col("_c"),
        _a=F.col("_l") * F.col("_c"),
        _m=_A
        * (
            (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
            - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2.0 * phi)
            + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4.0 * phi)
            - (35 * e6 / 3072) * F.sin(6.0 * phi)
        ),
    )
    n, t, c, a = (F.col(x) for x in ("_n", "_tt", "_cc", "_a"))
    a2 = a * a
    x = 500000.0 + _K0 * n * (
        a + (1.0 - t + c) * a2 * a / 6.0 + (5.0 - 18.0 * t + t * t + 72.0 * c - 58.0 * _EP2) * a2 * a2 * a / 120.0
    )
    y = _K0 * (
        F.col("_m")
        + n
        * F.col("_t")
        * (
            a2 / 2.0
            + (5.0 - t + 9.0 * c + 4.0 * c * c) * a2 * a2 / 24.0
            + (61.0 - 58.0 * t + t * t + 600.0 * c - 330.0 * _EP2) * a2 * a2 * a2 / 720.0
        )
    )
    return p.select(*points.columns, x.alias("utm_x"), y.alias("utm_y"))


def from_utm31(points: DataFrame) -> DataFrame:
    """Adds `lat, lon` to rows with `utm_x, utm_y`: the standard footpoint series."""
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = F.col("utm_y") / _K0 / (_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    p = staged(points, _mu=mu)
    m = F.col("_mu")
    phi1 = (
        m
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2.0 * m)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4.0 * m)
        + (151 * e1**3 / 96) * F.sin(6.0 * m)
        + (1097 * e1**4 / 512) * F.sin(8.0 * m)
    )
    p = staged(p, _p=phi1)
    s, co = F.sin("_p"), F.cos("_p")
    root = F.sqrt(1.0 - _E2 * s * s)
    p = staged(
        p,
        _n=_A / root,
        _r=_A * (1 - _E2) / (root * root * root),
        _t=F.tan("_p"),
        _c=_EP2 * co * co,
        _co=co,
    )
    p = staged(p, _d=(F.col("utm_x") - 500000.0) / (F.col("_n") * _K0), _tt=F.col("_t") * F.col("_t"))
    d, t, c = F.col("_d"), F.col("_tt"), F.col("_c")
    d2 = d * d
    lat = F.col("_p") - F.col("_n") * F.col("_t") / F.col("_r") * (
        d2 / 2.0
        - (5.0 + 3.0 * t + 10.0 * c - 4.0 * c * c - 9.0 * _EP2) * d2 * d2 / 24.0
        + (61.0 + 90.0 * t + 298.0 * c + 45.0 * t * t - 252.0 * _EP2 - 3.0 * c * c) * d2 * d2 * d2 / 720.0
    )
    lon = (
        d
        - (1.0 + 2.0 * t + c) * d2 * d / 6.0
        + (5.0 - 2.0 * c + 28.0 * t - 3.0 * c * c + 8.0 * _EP2 + 24.0 * t * t) * d2 * d2 * d / 120.0
    ) / F.col("_co")
    return p.select(*points.columns, (lat * DEG).alias("lat"), (_LON0 + lon * DEG).alias("lon"))


