"""Last known value per key in time order, for keys of any size.

Rows are range partitioned over (key, order), so a key that holds a third of
all rows lies in many pieces.  A window covers one piece of one key; what a
piece ends with is carried to the next pieces of its key, one value a piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.scale import cut_lineage, sized_join

PIECE = "_piece"


def range_pieces(rows: DataFrame, key: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """`rows` with the number of their range piece, written once so that it stays."""
    n = pieces or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(rows.repartitionByRange(n, *key, *order).withColumn(PIECE, F.spark_partition_id()))


def last_known(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, pieces: int | None = None) -> DataFrame:
    """`value` of each row as the last one of its key that is not NULL, up to the row itself.

    Rows of one key that are equal in `order` are in no particular order.  A
    NULL key is a key like others.
    """
    key, order = list(key), list(order)
    names = [f"_key{i}" for i in range(len(key))]
    kept = range_pieces(rows, key, order, pieces).withColumns({n: F.struct(k) for n, k in zip(names, key)})  # a struct joins NULLs as well
    inside = Window.partitionBy(PIECE, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    when = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = kept.groupBy(PIECE, *names).agg(F.max_by(value, when).alias("_end"))
    before = Window.partitionBy(*names).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    carried = ends.select(PIECE, *names, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    seen = kept.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    out = sized_join(seen, carried, [PIECE, *names])
    return out.withColumn(value, F.coalesce(value, "_carried")).select(*rows.columns)
