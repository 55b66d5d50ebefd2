"""Column helpers for angles, clamping and rounding shared by all jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RAD = math.pi / 180.0
DEG = 180.0 / math.pi


def as_col(x) -> Column:
    """Column for a name, a literal for a number, a Column as it is."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def dbl(x) -> Column:
    return as_col(x).cast("double")


def clamp(x, lo, hi) -> Column:
    """`x` limited to [lo, hi]; NULL stays NULL."""
    c = as_col(x)
    lo, hi = as_col(lo), as_col(hi)
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def wrap360(x) -> Column:
    c = dbl(x)
    return c - 360.0 * F.floor(c / 360.0)


def wrap180(x) -> Column:
    """Signed shortest form of an angle, in [-180, 180)."""
    c = dbl(x) + 180.0
    return c - 360.0 * F.floor(c / 360.0) - 180.0


def sin_d(x) -> Column:
    return F.sin(dbl(x) * RAD)


def cos_d(x) -> Column:
    return F.cos(dbl(x) * RAD)


def tan_d(x) -> Column:
    return F.tan(dbl(x) * RAD)


def asin_d(x) -> Column:
    return F.asin(clamp(x, -1.0, 1.0)) * DEG


def acos_d(x) -> Column:
    return F.acos(clamp(x, -1.0, 1.0)) * DEG


def atan2_d(y, x) -> Column:
    return F.atan2(as_col(y), as_col(x)) * DEG


def ang_sep(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance in degrees (haversine form, stable when small)."""
    a = F.pow(sin_d((as_col(dec2) - as_col(dec1)) / 2.0), F.lit(2.0))
    b = F.pow(sin_d((as_col(ra2) - as_col(ra1)) / 2.0), F.lit(2.0))
    h = a + cos_d(dec1) * cos_d(dec2) * b
    return 2.0 * F.asin(F.sqrt(clamp(h, 0.0, 1.0))) * DEG


def log10_safe(x) -> Column:
    """log10 that is NULL for values <= 0 in every engine."""
    c = as_col(x)
    return F.when(c > 0, F.log10(c))


def whole(x) -> Column:
    """floor as a long."""
    return F.floor(as_col(x)).cast("long")


def r6(x, digits: int = 6) -> Column:
    """Half-up rounding written as plain float arithmetic, so that two engines
    that agree on the input agree on the output bit by bit."""
    p = float(10**digits)
    return F.floor(as_col(x) * p + 0.5) / p


def rounded(df, digits: int = 6):
    """Round every double or float column of a frame."""
    out = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            out.append(r6(F.col(name).cast("double"), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
