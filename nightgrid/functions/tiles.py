"""Sphere tiles used as join keys: 1-degree cells and coarse cells.

A search box is turned into the list of tiles it touches; the catalogue side
carries one tile per row, so every sky search is an equi-join plus a residual.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightgrid.functions.angles import as_col, asin_d, clamp, cos_d, sin_d, wrap360


def tile_id(lon, lat, size: float = 1.0) -> Column:
    """Row-major tile number; `size` must divide 360 and 180."""
    n_lon, n_lat = int(round(360 / size)), int(round(180 / size))
    row = F.least(F.lit(n_lat - 1), F.floor((clamp(lat, -90.0, 90.0) + 90.0) / size).cast("int"))
    col = F.least(F.lit(n_lon - 1), F.floor(wrap360(lon) / size).cast("int"))
    return (row * n_lon + col).cast("int")


def box_tiles(lon, lat, lon_pad, lat_pad, size: float = 1.0) -> Column:
    """Array of tile numbers covering `lon ± lon_pad`, `lat ± lat_pad`."""
    n_lon, n_lat = int(round(360 / size)), int(round(180 / size))
    lon, lat, lon_pad, lat_pad = map(as_col, (lon, lat, lon_pad, lat_pad))
    top = float(n_lat - 1)
    lo = clamp(F.floor((lat - lat_pad + 90.0) / size).cast("double"), 0.0, top).cast("int")
    hi = clamp(F.floor((lat + lat_pad + 90.0) / size).cast("double"), 0.0, top).cast("int")
    west = F.floor((lon - lon_pad) / size).cast("int")
    east = F.floor((lon + lon_pad) / size).cast("int")
    full = (2.0 * lon_pad >= 360.0 - 2.0 * size) | (east - west >= n_lon - 1)
    cols = F.when(full, F.sequence(F.lit(0), F.lit(n_lon - 1))).otherwise(
        F.transform(F.sequence(west, east), lambda c: F.pmod(c, F.lit(n_lon)))
    )
    rows = F.sequence(lo, hi)
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: (r * n_lon + c).cast("int"))))


CURVE_BITS = 8  # of each axis: 256 x 256 cells


def _curve_cells(lon, lat) -> tuple[Column, Column]:
    n = 1 << CURVE_BITS
    x = F.least(F.lit(n - 1), F.floor(wrap360(lon) * (n / 360.0)).cast("int"))
    y = F.least(F.lit(n - 1), F.floor((clamp(lat, -90.0, 90.0) + 90.0) * (n / 180.0)).cast("int"))
    return x, y


def curve_place(lon, lat) -> Column:
    """Place of a position on a Z-order curve over the sky: near places are mostly near positions."""
    x, y = _curve_cells(lon, lat)
    out = F.lit(0)
    for bit in range(CURVE_BITS):
        for axis, at in ((x, 2 * bit), (y, 2 * bit + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(axis, bit).bitwiseAND(F.lit(1)), at))
    return out


def curve_ranges(west: float, east: float, south: float, north: float, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of the curve that cover a box (degrees; `west` may be negative or `east` over 360).

    Quarters that the box holds whole, or that would make more than `most`
    ranges, are not divided further, so the ranges may reach past the box.
    """
    n = 1 << CURVE_BITS
    x0, x1 = math.floor(west * n / 360.0), math.floor(east * n / 360.0)
    y0, y1 = (min(n - 1, max(0, math.floor((v + 90.0) * n / 180.0))) for v in (south, north))
    spans = [(0, n - 1)] if x1 - x0 >= n - 1 else [(x0 % n, x1 % n)] if x0 % n <= x1 % n else [(x0 % n, n - 1), (0, x1 % n)]
    todo, done = [(0, 0, CURVE_BITS, 0)], []
    while todo:
        x, y, level, at = todo.pop(0)
        side = 1 << level
        if y > y1 or y + side - 1 < y0 or not any(x <= b and a <= x + side - 1 for a, b in spans):
            continue
        whole = y0 <= y and y + side - 1 <= y1 and any(a <= x and x + side - 1 <= b for a, b in spans)
        if whole or level == 0 or len(todo) + len(done) >= most:
            done.append((at, at + side * side - 1))
            continue
        half = side // 2
        for k in range(4):
            todo.append((x + (k & 1) * half, y + (k >> 1) * half, level - 1, at + k * half * half))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(done):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def circle_lon_pad(lat, radius) -> Column:
    """Longitude half-width of a spherical circle; 180 when it holds a pole."""
    lat, radius = as_col(lat), as_col(radius)
    ratio = sin_d(radius) / cos_d(lat)
    return F.when(F.abs(lat) + radius >= 89.999, F.lit(180.0)).otherwise(asin_d(ratio) + 1e-9)
