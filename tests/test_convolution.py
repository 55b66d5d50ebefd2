"""Wide kernels by overlap-add against plain sums."""

import numpy as np
import pytest

import __spark_entry__ as entry
from nightgrid.operators import radiance as rad
from nightgrid.plans import radiance_queries as plans


def plain(cells, kernel):
    """Each cell's value at all offsets, added up on an open board."""
    reach = max(abs(a) for a, _, _ in kernel)
    rr, cc = [k[0] for k in cells], [k[1] for k in cells]
    r0, c0 = min(rr), min(cc)
    shape = (max(rr) - r0 + 1 + 2 * reach, max(cc) - c0 + 1 + 2 * reach)
    ker = np.zeros((2 * reach + 1, 2 * reach + 1))
    for a, b, w in kernel:
        ker[a + reach, b + reach] = w
    board = np.zeros(shape)
    for (r, c), v in cells.items():
        board[r - r0 : r - r0 + len(ker), c - c0 : c - c0 + len(ker)] += v * ker
    return {(r, c): board[r - r0 + reach, c - c0 + reach] for r, c in cells}


def frame(spark, cells):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells.items()], "r int, c int, v double").repartition(4)


@pytest.mark.parametrize("tile", [7, 16, 64, 1024])
def test_tiles_smaller_and_larger_than_the_reach(spark, tile):
    rng = np.random.default_rng(tile)
    cells = {(int(r), int(c)): float(rng.integers(0, 50)) for r, c in rng.integers(-40, 60, (300, 2))}
    kernel = rad.gaussian_kernel(4.0, 20.0, 1.0)
    got = {(r.r, r.c): r.v for r in rad.convolve_tiled(frame(spark, cells), kernel, tile).collect()}
    want = plain(cells, kernel)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_one_kernel_that_leans(spark):
    cells = {(0, 0): 1.0, (9, 9): 2.0, (-3, 4): 0.0}
    kernel = [(-2, 1, 0.5), (0, 0, 0.25), (9, 9, 0.25)]
    got = {(r.r, r.c): round(r.v, 12) for r in rad.convolve_tiled(frame(spark, cells), kernel, 4).collect()}
    assert got == {(0, 0): 0.25, (9, 9): 0.75, (-3, 4): 0.0}
    assert rad.convolve_tiled(frame(spark, cells).limit(0), kernel).count() == 0


@pytest.mark.parametrize("name", ["convolve_gaussian_wide", "convolve_power_law_wide"])
def test_wide_queries(spark, name):
    sf = "/root/testdata/sf0.001"
    cells = {(r.r, r.c): r.v or 0.0 for r in plans.clean(spark, sf).collect()}
    kernel = rad.gaussian_kernel(30.0, 200.0, 1.0) if "gauss" in name else rad.power_law_kernel(2.0, 1.0, 50.0, 200.0, 1.0)
    want = plain(cells, kernel)
    got = {(r.r, r.c): r.v for r in entry.queries()[name](spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 2e-6
