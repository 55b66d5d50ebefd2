"""Last known values by range pieces against a plain loop."""

import random

from pyspark.sql import functions as F

from nightgrid.functions import asof


def test_hot_keys_gaps_and_nulls(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), t, rnd.choice([None, None, t])) for t in range(600)]
    rows += [("late", 1000 + t, None) for t in range(5)] + [("once", 5, 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "site string, ts long, v long, _end string").repartition(5)
    last, want = {}, []
    for site, t, v in sorted(rows, key=lambda r: r[1]):
        last[site] = last.get(site) if v is None else v
        want.append((site, t, last[site]))
    got = asof.last_known(df, ["site"], ["ts"], "v", pieces=16)
    assert got.columns == df.columns
    assert sorted(((r.site, r.ts, r.v) for r in got.collect()), key=str) == sorted(want, key=str)
    # no window holds a hot key: a piece is a sixteenth of all rows or not much more
    pieces = asof.range_pieces(df, ["site"], ["ts"], pieces=16).groupBy(asof.PIECE, "site").count()
    assert pieces.agg(F.max("count")).first()[0] < 120
    assert asof.last_known(df.limit(0), ["site"], ["ts"], "v").count() == 0
