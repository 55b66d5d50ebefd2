"""Magnitude batches: the leaf of a row against a plain search."""

import bisect
import random

from nightgrid.operators import catalog as cat


def test_leaf_is_looked_up_once_a_row(spark):
    rnd = random.Random(5)
    edges = [1.0, 1.5, 1.55, 1.6, 2.6, 2.65, 4.0]
    mags = [rnd.uniform(0.5, 4.5) for _ in range(500)] + edges + [None, float("nan")]
    out = cat.leaf_histogram(spark.createDataFrame([(m,) for m in mags], "mag double"), edges)
    want = {}
    for m in mags:
        if m is not None and edges[0] < m <= edges[-1]:
            leaf = bisect.bisect_left(edges, m) - 1
            want[leaf] = want.get(leaf, 0) + 1
    assert {r.leaf: r.n_rows for r in out.collect()} == want
    # the guess is made once, not once for each way through nested choices
    assert out._jdf.queryExecution().optimizedPlan().toString().upper().count("FLOOR(") == 1
