"""Files in the folder that the whole cluster shares."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.functions.scale import ensure_checkpoint_dir

PART_CHARS = 8_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder under the session's checkpoint folder; the writer makes it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again: lineage ends here."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts_for(docs: DataFrame, text_col: str = "text", chars: int = PART_CHARS) -> int:
    """Partitions of about `chars` characters each, counted over all rows."""
    total = docs.agg(F.sum(F.length(text_col).cast("long") + 1).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / chars))


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Written as a table of hash buckets of `key` in the shared folder: a join or co-group on `key` does not shuffle it again."""
    folder = shared_folder(df.sparkSession, name)
    table = folder.rsplit("/", 1)[-1].replace("-", "_")
    df.write.option("path", folder).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return df.sparkSession.table(table)
