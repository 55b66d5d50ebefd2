"""Deep-sky CSV files and constellation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightgrid.functions.angles import clamp, wrap360
from nightgrid.operators.deepsky import deep_sky_catalog


def read_deep_sky(spark: SparkSession, path: str) -> DataFrame:
    """Deep-sky objects of CSV files separated by comma, semicolon, bar or tab."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None:
        raise ValueError("the deep-sky table is empty")
    header = first["value"]
    sep = max(",;|\t", key=header.count)
    names = [h.strip().strip('"') for h in header.split(sep)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return deep_sky_catalog(spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=True))


NODE = "struct<ra_deg: string, dec_deg: string, star_id: string, star_name: string, connect_from_prev: string>"
DOCUMENT = f"struct<constellations: array<struct<name: string, nodes: array<{NODE}>>>>"


def flatten_constellations(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Node rows of constellation documents; other columns are carried along.

    Nodes without readable coordinates drop out before they are numbered, the
    first node of a group never connects, groups without nodes vanish.
    """
    keep = [c for c in docs.columns if c != doc]
    groups = docs.select(*keep, F.posexplode(F.from_json(doc, DOCUMENT)["constellations"]).alias("group_no", "g"))
    ok = F.filter(
        "g.nodes",
        lambda n: n["ra_deg"].try_cast("double").isNotNull() & n["dec_deg"].try_cast("double").isNotNull(),
    )
    rows = groups.select(*keep, "group_no", F.trim(F.col("g.name")).alias("name"), F.posexplode(ok).alias("pos", "n"))
    linked = F.lower(F.coalesce(F.col("n.connect_from_prev"), F.lit("true"))).isin("true", "1")
    return rows.select(
        *keep,
        "group_no",
        "name",
        "pos",
        wrap360(F.col("n.ra_deg").try_cast("double")).alias("ra_deg"),
        clamp(F.col("n.dec_deg").try_cast("double"), -90.0, 90.0).alias("dec_deg"),
        F.coalesce(F.col("n.star_id"), F.lit("")).alias("star_id"),
        F.coalesce(F.col("n.star_name"), F.lit("")).alias("star_name"),
        (linked & (F.col("pos") > 0)).alias("connect_from_prev"),
    )


def read_constellations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return flatten_constellations(raw.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("doc")))
