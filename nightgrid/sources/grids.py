"""ASCII elevation grids and stored horizon profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADER_KEYS = "NCOLS|NROWS|XLLCORNER|YLLCORNER|XLLCENTER|YLLCENTER|CELLSIZE|NODATA_VALUE|DX|DY"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a per-file order: an id that grows along each file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.trim("value").alias("value"),
    ).where("value <> ''")


def read_grid_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with the header values in lower-case columns."""
    lines = _lines(spark, path).where(F.upper("value").rlike(rf"^({HEADER_KEYS})\s"))
    kv = lines.select("path", F.split("value", r"\s+").alias("kv"))
    names = [k for k in HEADER_KEYS.split("|") if k not in ("DX", "DY")]
    aggs = [
        F.max(F.when(F.upper(F.col("kv")[0]) == k, F.get("kv", F.lit(1)).try_cast("double"))).alias(k.lower()) for k in names
    ]
    return kv.groupBy("path").agg(*aggs)


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells `(path, r, c, h)`; missing trailing values become nodata.

    A file may have any number of blocks (splits).  Counts of values place each
    block in its file and each line in its block, so a task orders the lines of
    one block at most.  Row 0 is the first (northern) line of the grid.
    """
    head = read_grid_headers(spark, path).where("ncols is not null and nrows is not null")
    body = _lines(spark, path).where(~F.upper("value").rlike(rf"^({HEADER_KEYS})\s"))
    body = body.withColumn("cells", F.split("value", r"\s+"))
    blocks = body.groupBy("path", "block").agg(F.sum(F.size("cells")).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    above = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    starts = body.withColumn("start", F.coalesce(F.sum(F.size("cells")).over(above), F.lit(0)))
    starts = starts.join(blocks, ["path", "block"]).withColumn("start", F.col("start") + F.col("base"))
    cells = starts.select("path", "start", F.posexplode("cells").alias("pos", "text"))
    cells = cells.join(head, "path").withColumn("idx", (F.col("start") + F.col("pos")).cast("long"))
    nodata = F.coalesce("nodata_value", F.lit(-9999.0))
    have = cells.where(F.col("idx") < F.col("ncols") * F.col("nrows")).select(
        "path", "idx", "ncols", F.coalesce(F.col("text").try_cast("float").cast("double"), nodata).alias("h")
    )
    counts = cells.groupBy("path").agg(F.max("idx").alias("last"))
    pad = head.join(counts, "path", "left").where(F.coalesce("last", F.lit(-1)) + 1 < F.col("ncols") * F.col("nrows"))
    pad = pad.select(
        "path",
        "ncols",
        nodata.alias("h"),
        F.explode(
            F.sequence((F.coalesce("last", F.lit(-1)) + 1).cast("long"), (F.col("ncols") * F.col("nrows") - 1).cast("long"))
        ).alias("idx"),
    )
    both = have.unionByName(pad)
    return both.select(
        "path", F.floor(F.col("idx") / F.col("ncols")).cast("int").alias("r"), (F.col("idx") % F.col("ncols")).cast("int").alias("c"), "h"
    )


def write_profiles(profile: DataFrame, path: str) -> None:
    """One row per observer and band with arrays sorted by azimuth."""
    point = F.struct("az_idx", "angle", "dist", "height")
    arrays = profile.groupBy("obs_id", "band").agg(F.array_sort(F.collect_list(point)).alias("points"))
    arrays.write.mode("overwrite").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The long form of stored profiles."""
    return spark.read.parquet(path).select("obs_id", "band", F.inline("points"))
