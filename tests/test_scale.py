"""Skew-safe building blocks against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nightgrid.functions import scale


def skewed(spark, n=3000):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 1009 / 7.0).alias("v")
    )


def test_sized_join_splits_hot_keys(spark):
    big, small = skewed(spark), spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = big.join(small, "k").orderBy("id").toPandas()[["id", "w"]]
    split = scale.sized_join(big, small, ["k"], max_bytes=1, hot_rows=100).orderBy("id").toPandas()[["id", "w"]]
    pd.testing.assert_frame_equal(plain, split)


def test_global_rank_is_exact(spark):
    got = scale.global_rank(skewed(spark), [F.col("v"), F.col("id")]).toPandas().sort_values("position")
    want = skewed(spark).toPandas().sort_values(["v", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["position"].tolist() == list(range(len(want)))


def test_exact_quantiles(spark):
    df = skewed(spark)
    got = {(r.k, r.prob): r.quantile for r in scale.exact_quantiles(df, "v", [0.01, 0.5, 0.995], ["k"]).collect()}
    for k, g in df.toPandas().groupby("k"):
        for p in (0.01, 0.5, 0.995):
            assert abs(got[(k, p)] - np.quantile(g.v, p)) < 1e-9


def test_order_stats_keep_types_and_outliers(spark):
    base = 4_600_000_000_000_000_000
    rows = [(i % 3, base + i * 3, float(i)) for i in range(999)] + [(0, base - 1, 1e30), (1, base - 2, float("nan")), (2, base - 3, None)]
    df = spark.createDataFrame(rows, "k int, id long, v double")
    wanted = spark.createDataFrame([(0, 7), (1, 0), (2, 333)], "k int, nth long")
    got = {r.k: r.value for r in scale.exact_order_stats(df, "id", wanted, ["k"]).collect()}
    by_key = {k: sorted(r[1] for r in rows if r[0] == k) for k in range(3)}
    assert got == {0: by_key[0][7], 1: by_key[1][0], 2: by_key[2][333]}
    q = {r.prob: r.quantile for r in scale.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).collect()}
    values = [r[2] for r in rows if r[2] is not None and r[2] == r[2]]
    assert q == {0.0: 0.0, 0.5: np.quantile(values, 0.5), 1.0: 1e30}
    assert scale.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_quantiles_never_broadcast_the_data(spark):
    df = skewed(spark, 50_000)
    for frame in (scale.exact_quantiles(df, "v", [0.5]), scale.exact_quantiles(df, "v", [0.5], ["k"])):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_halo_rank_of_long_ids(spark):
    from nightgrid.operators.photometry import star_photometry

    rows = [(1, 4_600_000_000_000_000_000 + i, 1.0, 9.0) for i in range(200)]
    out = star_photometry(spark.createDataFrame(rows, "field_id int, source_id long, mag double, limit double"))
    assert out.where("halo_bin > 0").count() == 10


def test_sized_join_spreads_equal_rows_and_maps(spark):
    big = spark.range(2000).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    small = spark.createDataFrame([(1, "x")], "k int, w string")
    assert scale.sized_join(big, small, ["k"], max_bytes=1, hot_rows=100).count() == 2000


def test_spread_pieces_do_not_grow_with_the_input(spark):
    slots = spark.sparkContext.defaultParallelism
    pieces = [scale.spread(spark.range(n), "id").rdd.getNumPartitions() for n in (1000, 5_000_000, 10_000_000)]
    assert pieces[0] == slots and 8 * 10_000_000 / pieces[2] <= 8 * 5_000_000 / pieces[1] * 1.1 <= scale.SPREAD_BYTES * 1.1


def test_sized_join_never_broadcasts_an_exploded_side_over_the_limit(spark, tmp_path):
    # files of a few KB that explode to many rows: after an empty hot-key list their file size alone is left as estimate
    spark.range(200).write.parquet(f"{tmp_path}/small")
    small = spark.read.parquet(f"{tmp_path}/small").select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k"), F.col("id").alias("w"))
    spark.range(3000).withColumn("k", F.col("id") % 1000).write.parquet(f"{tmp_path}/big")
    out = scale.sized_join(spark.read.parquet(f"{tmp_path}/big"), small, ["k"], max_bytes=1 << 20)
    assert len(out.collect()) == 3000 * 200
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan


def test_shared_rows_keep_every_key_in_bounded_lists(spark):
    rows = [(i if i < 25 else None, 1.0, "a") for i in range(26)] + [(7, 2.0, None), (7, 2.0, None)]
    shared = scale.shared_rows(spark.createDataFrame(rows, "id int, v double, t string"), "id", most=10)
    got = shared.collect()
    assert len(got) == 4 and max(len(r["_keys"]) for r in got) == 10
    back = [(k["id"], r["v"], r["t"]) for r in got for k in r["_keys"]]
    assert sorted(back, key=str) == sorted(rows, key=str)


def test_first_per_key_leaves_columns_behind_that_only_order(spark):
    df = spark.createDataFrame([(1, 5, "b", 2.0), (1, 5, "a", 1.0), (2, 9, "c", 3.0)], "id int, n int, t string, v double")
    out = scale.first_per_key(df, ["id"], [F.col("n"), F.col("t")], keep=["id", "v"])
    assert out.columns == ["id", "v"] and sorted(map(tuple, out.collect())) == [(1, 1.0), (2, 3.0)]
