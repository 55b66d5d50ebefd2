"""Building blocks that keep jobs whole and balanced on skewed data.

* `first_per_key`   - keep one row per key by an order, map-side combined
* `sized_join`      - broadcast only after the small side was counted, salted shuffle join beyond
* `global_rank`     - exact total order position without a single-task window
* `exact_quantiles` - exact percentiles through counted range partitions, any row count and type
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BROADCAST_BYTES = 32 << 20
HOT_ROWS = 1_000_000
NULL_SALTS = 64  # keys that are NULL match nothing and may lie anywhere


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; set one only where none is set."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(schema: T.StructType) -> int:
    """Planning width of a row; variable-length fields count as 64 bytes,
    nested ones as 2 KB."""
    fixed = {"boolean": 1, "byte": 1, "short": 2, "int": 4, "integer": 4, "float": 4}
    total = 16
    for f in schema.fields:
        name = f.dataType.typeName()
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total += 2048
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total += 64
        else:
            total += fixed.get(name, 8)
    return total


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when a counted upper bound of the frame is under `max_bytes`."""
    cap = max(1, max_bytes // row_bytes(df.schema))
    return df.limit(cap + 1).count() <= cap


def sized_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join that survives a hot key on the `big` side.

    The small side is counted first and broadcast only under `max_bytes`.
    Beyond that, keys with more than `hot_rows` rows (there can be at most
    rows / hot_rows of them, which bounds that broadcast) are split into
    sub-keys on the big side and repeated once per sub-key on the small side;
    all other keys shuffle plainly.  The hint keeps Spark from broadcasting that
    side after all: it estimates an exploded frame by the size of its files.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"sized_join does not support how={how!r}")
    on = list(on)
    if fits_broadcast(small, max_bytes):
        return big.join(F.broadcast(small), on, how)
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = hot.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    # by row position: equal rows of a hot key spread as well, and any column type will do
    spread = F.monotonically_increasing_id()
    left = big.join(F.broadcast(hot), on, "left")
    left = left.withColumn(
        "_salt",
        F.when(no_key, F.pmod(spread, F.lit(NULL_SALTS)))
        .when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
        .otherwise(0)
        .cast("int"),
    ).drop("_salts")
    right = small.join(F.broadcast(hot), on, "left")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = right.withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


SHARED_KEYS = 1000  # of one row of `shared_rows`


def shared_rows(df: DataFrame, key: str, most: int = SHARED_KEYS) -> DataFrame:
    """Rows that are equal in all but `key` once, with their keys in `_keys` (structs, as `inline` takes them).

    A list holds at most `most` keys; more of them make further rows.
    """
    rest = [c for c in df.columns if c != key]
    place = F.row_number().over(Window.partitionBy(*rest).orderBy(key)) - 1
    parts = df.withColumn("_part", F.floor(place / most))
    return parts.groupBy(*rest, "_part").agg(F.collect_list(F.struct(key)).alias("_keys")).drop("_part")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by `order`, with the columns `keep` (all if None).

    Columns that only make the order need not be kept; they would travel twice.

    An aggregate, not a window: a key that holds a third of all rows is
    reduced on the map side before anything is shuffled.
    """
    columns = list(df.columns if keep is None else keep)
    rest = [c for c in columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*columns)


def global_rank(
    df: DataFrame, order: Sequence[Column], out: str = "position", partitions: int | None = None
) -> DataFrame:
    """Exact 0-based position in a total order.

    Range partitions are sorted, written once (so the partition of each row is
    fixed even if executors are lost), counted, and the small per-partition
    counts become start offsets.  No task ever sees more than its own range.
    """
    spark = df.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id())
    stored = cut_lineage(ranged)
    pid, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    stored = stored.withColumn("_pid", pid).withColumn("_local", local)
    # one row per range partition: bounded by the partition count
    starts = (
        stored.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select("_pid", "_start")
    )
    joined = stored.join(F.broadcast(starts), "_pid")
    return joined.withColumn(out, F.col("_start") + F.col("_local")).drop("_id", "_pid", "_local", "_start")


def exact_order_stats(df: DataFrame, value: str, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The nth smallest `value` per group: `targets` plus `value`, `rest`.

    `targets` has the columns `by`, anything else, and `nth` (0-based).  `rest`
    is the index of the nth row among rows of equal value.  The value keeps its
    type, so long ids and structs are ordered as they are; NULL and NaN do not
    count.

    Equal values are counted first.  Distinct ones are range partitioned by
    (group, value), so neither an outlier nor a large group lands in one task;
    the row counts of the pieces (one per partition and group in it) say in which
    piece a wanted row lies, and only that piece is joined, on its own number.
    """
    by = list(by)
    if {"nth", "value", "rest"} & set(by):
        raise ValueError("group columns may not be named nth, value or rest")
    spark = df.sparkSession
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_os_v"))
    if isinstance(base.schema["_os_v"].dataType, (T.DoubleType, T.FloatType)):
        base = base.where(~F.isnan("_os_v"))
    counts = base.groupBy(*by, "_os_v").agg(F.count(F.lit(1)).alias("_os_c"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut_lineage(counts.repartitionByRange(n, *by, "_os_v").withColumn("_os_p", F.spark_partition_id()))
    sizes = pieces.groupBy(*by, "_os_p").agg(F.sum("_os_c").alias("_os_n"))
    wanted = targets.withColumn("_os_k", F.col("nth").cast("long"))
    if by:
        before = Window.partitionBy(*by).orderBy("_os_p").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("_os_start", F.coalesce(F.sum("_os_n").over(before), F.lit(0)))
        located = wanted.join(starts, by)
    else:  # one row per partition
        rows, at, spots = sorted(sizes.collect(), key=lambda r: r["_os_p"]), 0, []
        for r in rows:
            spots.append(F.struct(F.lit(r["_os_p"]).alias("_os_p"), F.lit(r["_os_n"]).alias("_os_n"), F.lit(at).cast("long").alias("_os_start")))
            at += r["_os_n"]
        spots = spots or [F.struct(F.lit(-1).alias("_os_p"), F.lit(0).cast("long").alias("_os_n"), F.lit(0).cast("long").alias("_os_start"))]
        located = wanted.select("*", F.inline(F.array(*spots)))
    located = located.where((F.col("_os_k") >= F.col("_os_start")) & (F.col("_os_k") < F.col("_os_start") + F.col("_os_n")))
    located = located.withColumn("_os_k", F.col("_os_k") - F.col("_os_start")).drop("_os_start", "_os_n")
    upto = Window.partitionBy("_os_p", *by).orderBy("_os_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = pieces.withColumn("_os_cum", F.sum("_os_c").over(upto))
    hit = ranked.join(located, [*by, "_os_p"]).where((F.col("_os_k") >= F.col("_os_cum") - F.col("_os_c")) & (F.col("_os_k") < F.col("_os_cum")))
    return hit.select(*targets.columns, F.col("_os_v").alias("value"), (F.col("_os_k") - F.col("_os_cum") + F.col("_os_c")).alias("rest"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles: rows `(by…, prob, quantile)`."""
    base = df.select(*by, F.col(value).cast("double").alias(value))
    base = base.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = base.groupBy(*by).agg(F.count(value).alias("_n")).where("_n > 0")
    t = n.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    t = t.withColumn("_pos", F.col("prob") * (F.col("_n") - 1).cast("double"))
    t = t.withColumn("nth", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    hit = exact_order_stats(base, value, t, by)
    out = hit.groupBy(*by, "prob", "_pos").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    frac = F.col("_pos") - F.floor("_pos")
    out = out.withColumn("quantile", F.col("_a") + (F.col("_b") - F.col("_a")) * frac)
    return out.select(*by, "prob", "quantile")


def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Catalyst copies a computed column into every filter that uses it, which
    multiplies trigonometry.  A one-row generator is a boundary it does not
    copy across; the row is neither shuffled nor serialised.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def chain(array: Column, *steps) -> Column:
    """Apply several element functions in turn, each result computed once."""
    for step in steps:
        array = F.transform(array, step)
    return array


SPREAD_BYTES = 2 << 20  # of the scanned files, for each task of a spread frame


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deal a small parameter side to all task slots before each of its rows
    expands to much work.

    Only a frame whose scans hold less than one split per slot is dealt anew;
    whatever has more data than that already comes in enough partitions, and
    files are judged by their bytes, not by their number.  The pieces have one
    size, so that what a task holds does not grow with the input.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if size >= slots * split:
        return df
    return df.repartition(max(slots, -(-size // SPREAD_BYTES)), *keys)
