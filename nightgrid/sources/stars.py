"""Star table readers and the magnitude-sliced catalogue store."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightgrid.functions.angles import wrap180
from nightgrid.functions.scale import staged
from nightgrid.functions.tiles import curve_place, curve_ranges
from nightgrid.operators.catalog import ALIASES, REQUIRED, resolve_columns, union_catalogs

# Column order of headerless JSON rows.
JSON_COLUMNS = (
    "source_id",
    "designation",
    "ra",
    "dec",
    "phot_g_mean_mag",
    "phot_bp_mean_mag",
    "phot_rp_mean_mag",
    "bp_rp",
    "pmra",
    "pmdec",
    "parallax",
)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of the lines that follow each other in one block of a file."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block")
        ends = [(file[i].as_py(), block[i].as_py()) for i in (0, -1)]
        moved = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        yield batch.filter(pa.array(np.append(ends[0] != last, moved.to_numpy(zero_copy_only=False))))
        last = ends[1]


def _headers(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(file, first line that is no comment) of every file: one short row a file, like a listing.

    A task holds one batch of lines; an aggregate of texts would sort all its lines.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    first = lines.mapInArrow(_first_lines, "file string, block long, value string").groupBy("file").agg(F.min_by("value", "block").alias("value"))
    return sorted((r["file"], r["value"]) for r in first.collect())


def _cells(line: str, sep: str) -> list[str]:
    cells = line.strip().split() if sep == " " else line.split(sep)
    return [c.strip().lstrip("\ufeff").strip('"') for c in cells]


def star_table_files(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[tuple[str, tuple[str, ...]], list[str]], list[tuple[str, str]]]:
    """Readable files by (separator, header), and (file, reason) of the others."""
    good: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    bad = []
    for file, line in _headers(spark, paths):
        # the ECSV default is white space
        sep = next((x for x in (",", ";", "\t") if x in line), " ")
        names = tuple(_cells(line, sep))
        known = {n.lower().replace(" ", "_") for n in names}
        missing = [c for c in REQUIRED if not known & set(ALIASES[c])]
        if missing or len(set(names)) < len(names):
            bad.append((file, f"missing required column: {missing[0]}" if missing else "repeated column name"))
        else:
            good.setdefault((sep, names), []).append(file)
    return good, bad


def read_star_tables(spark: SparkSession, paths: Sequence[str], skipped: list[tuple[str, str]] | None = None) -> DataFrame:
    """CSV / ECSV tables as text columns plus `source_file`.

    `#` lines are comments; the header's separator is a comma, a semicolon, a
    tab or else white space.  Files are read together with those of the same
    header, so a different column order is never mixed up.  A file without the
    required columns is left out; `skipped` receives (file, reason).
    """
    good, bad = star_table_files(spark, paths)
    if skipped is not None:
        skipped.extend(bad)
    frames = []
    for (sep, names), files in sorted(good.items()):
        if sep == " ":
            lines = spark.read.text(files).withColumn("source_file", F.col("_metadata.file_name"))
            lines = lines.where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
            cells = F.transform(F.split(F.trim("value"), r"\s+"), lambda c: F.btrim(c, F.lit('"')))
            lines = staged(lines, cells=cells).where(F.col("cells") != F.array(*[F.lit(n) for n in names]))
            df = lines.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], "source_file")
        else:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            df = spark.read.csv(files, schema=schema, header=True, sep=sep, comment="#", enforceSchema=True)
            df = df.withColumn("source_file", F.col("_metadata.file_name"))
        frames.append(resolve_columns(df))
    if not frames:
        raise ValueError(f"no readable star table: {bad[:3]}")
    return union_catalogs(frames)


def read_star_json(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSON catalogues (column metadata + rows, list of objects, list of rows).

    A JSON document cannot be split, so one file is one task; large catalogues
    belong in many files or in Parquet.  Short rows give NULL cells.
    """
    raw = spark.read.text(list(paths), wholetext=True).withColumn("source_file", F.col("_metadata.file_name"))
    body = F.trim("value")
    table = F.from_json(body, "struct<metadata: array<struct<name: string>>, data: array<array<string>>>")
    objects_in = F.from_json(body, "struct<data: array<map<string,string>>>")
    is_obj = body.startswith("{")
    # a boundary: each form is parsed once per document, whatever reads it later
    kinds = staged(
        raw,
        t=F.when(is_obj, table),
        to=F.when(is_obj, objects_in)["data"],
        la=F.when(~is_obj, F.from_json(body, "array<array<string>>")),
        lm=F.when(~is_obj, F.from_json(body, "array<map<string,string>>")),
    )
    default_names = F.array(*[F.lit(n) for n in JSON_COLUMNS])
    kinds = kinds.select("source_file", F.transform("t.metadata", lambda m: m["name"]).alias("_named"), F.coalesce("t.data", "la").alias("_lists"), F.coalesce("to", "lm").alias("_maps"))
    kinds = staged(kinds, names=F.when(F.size("_named") > 0, F.col("_named")).otherwise(default_names))
    places = {n: f"_at{i}" for i, n in enumerate(dict.fromkeys(n for names in ALIASES.values() for n in names))}

    def place(name: str):
        at = F.array_position("names", name)
        return F.when(at > 0, (at - 1).cast("int"))

    kinds = staged(kinds, **{col: place(n) for n, col in places.items()})
    no_list, no_map = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    lists = F.transform("_lists", lambda r: F.struct(r.alias("row"), no_map.alias("map")))
    maps = F.transform("_maps", lambda r: F.struct(no_list.alias("row"), r.alias("map")))
    empty = F.array().cast("array<struct<row: array<string>, map: map<string,string>>>")
    rows = kinds.select("source_file", *places.values(), F.inline(F.concat(F.coalesce(lists, empty), F.coalesce(maps, empty))))
    rows = rows.where(F.col("row").isNotNull() | (F.size("map") > 0))

    def value(names: Sequence[str]):
        by_key = [F.try_element_at("map", F.lit(n)) for n in names]
        return F.when(F.col("row").isNotNull(), F.coalesce(*[F.get("row", F.col(places[n])) for n in names])).otherwise(F.coalesce(*by_key))

    return rows.select(*[value(names).alias(target) for target, names in ALIASES.items()], "source_file")


GROUP_BYTES = 1 << 20


def write_sky_catalog(df: DataFrame, path: str, partitions: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Parquet partitioned by whole magnitude, inside that in the order of a curve over the sky.

    Range partitions over (magnitude bin, curve place), so a crowded field or
    bin is split over many tasks; row groups of about `group_bytes` cover small
    parts of the sky and are skipped by their least and greatest place.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.where("mag is not null and ra is not null and dec is not null")
    placed = placed.withColumn("mag_bin", F.floor("mag").cast("int")).withColumn("place", curve_place("ra", "dec"))
    ranged = placed.repartitionByRange(n, "mag_bin", "place").sortWithinPartitions("mag_bin", "place")
    ranged.write.mode("overwrite").option("parquet.block.size", str(group_bytes)).partitionBy("mag_bin").parquet(path)


def read_sky_window(spark: SparkSession, path: str, ra: float, dec: float, ra_pad: float, dec_pad: float, max_mag: float) -> DataFrame:
    """Stars of `write_sky_catalog` in a box up to a magnitude: other folders and row groups are not read.

    The box is `ra` ± `ra_pad` around the circle, `dec` ± `dec_pad`.
    """
    df = spark.read.parquet(path).where((F.col("mag_bin") <= F.lit(math.floor(max_mag))) & (F.col("mag") <= max_mag))
    ranges = curve_ranges(ra - ra_pad, ra + ra_pad, dec - dec_pad, dec + dec_pad)
    near = F.lit(False)
    for lo, hi in ranges:
        near = near | F.col("place").between(lo, hi)
    inside = (F.abs(wrap180(F.col("ra") - ra)) <= ra_pad) & (F.abs(F.col("dec") - dec) <= dec_pad)
    return df.where(near).where(inside).drop("mag_bin", "place")


def write_catalog(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet partitioned by whole magnitude, each file sorted by magnitude.

    Rows are range-partitioned on (mag, source_id): the faint bins hold most
    of a catalogue and are split over many tasks instead of one per bin.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.where(F.col("mag").isNotNull())
        .withColumn("mag_bin", F.floor("mag").cast("int"))
        .repartitionByRange(n, "mag", "source_id")
        .sortWithinPartitions("mag_bin", "mag", "source_id")
        .write.mode("overwrite")
        .partitionBy("mag_bin")
        .parquet(path)
    )


def read_catalog(
    spark: SparkSession, path: str, max_mag: float | None = None, min_mag_exclusive: float | None = None
) -> DataFrame:
    """Only the magnitude folders and row groups that a request overlaps."""
    df = spark.read.parquet(path)
    eps = 1e-6
    if max_mag is not None:
        df = df.where((F.col("mag_bin") <= F.lit(int(-(-(max_mag + eps) // 1)))) & (F.col("mag") <= max_mag + eps))
    if min_mag_exclusive is not None:
        low = int((min_mag_exclusive + eps) // 1)
        df = df.where((F.col("mag_bin") >= F.lit(low)) & (F.col("mag") > min_mag_exclusive + eps))
    return df.drop("mag_bin")


def catalog_manifest(df: DataFrame) -> DataFrame:
    """One row per stored file; `df` is a file scan (it must have `_metadata`)."""
    meta = F.col("_metadata")
    return (
        df.select(
            meta["file_name"].alias("file_name"),
            meta["file_size"].alias("file_size"),
            meta["file_modification_time"].alias("modified"),
            "mag",
        )
        .groupBy("file_name", "file_size", "modified")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("mag").alias("min_mag"), F.max("mag").alias("max_mag"))
    )
