"""Structured Streaming forms of the weather jobs."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nightgrid.functions.scale import first_per_key
from nightgrid.operators.weather import TTL_HOURS, latest_slots
from nightgrid.sources.forecast import flatten_forecast


def forecast_rows_stream(payloads: DataFrame) -> DataFrame:
    """Flat forecast rows of a payload stream (`fetch_id, site, fetched,
    payload`), each fetch taken once within the 12-hour watermark."""
    unique = payloads.withWatermark("fetched", f"{TTL_HOURS} hours").dropDuplicatesWithinWatermark(["fetch_id"])
    return flatten_forecast(unique)


def write_latest_slots(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the newest fetch per (site, slot) under `path`.

    The table is partitioned by slot day; `day=<d>/v=<batch>` is the state of a
    day after a batch.  A micro-batch reads and writes only the days it
    touches.  A repeated batch after a failure starts from the versions before
    it and replaces its own; versions older than those are dropped.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            fresh = batch.withColumn("day", F.to_date("slot_ts").cast("string"))
            days = [r["day"] for r in fresh.select("day").distinct().collect()]  # slot days of one micro-batch
            if not days:
                return
            before = {d: v for d, v in slot_versions(spark, path, batch_id).items() if d in days}
            merged = fresh
            if before:
                old = [spark.read.parquet(f"{path}/day={d}/v={v}").withColumn("day", F.lit(d)) for d, v in sorted(before.items())]
                merged = functools.reduce(DataFrame.unionByName, old, fresh)
            newest = [-F.unix_micros("fetched"), -F.col("fetch_id")]
            out = latest_slots(merged, newest).withColumn("v", F.lit(batch_id))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "v").parquet(path)
            _drop_versions(spark, path, before)
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str, key: str) -> list[str]:
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(n.removeprefix(f"{key}=") for n in names if n.startswith(f"{key}="))


def slot_versions(spark: SparkSession, path: str, below: int | None = None) -> dict[str, int]:
    """Newest version of each slot day, from folder names; with `below` only earlier batches."""
    out = {}
    for day in _children(spark, path, "day"):
        known = [int(v) for v in _children(spark, f"{path}/day={day}", "v")]
        known = [v for v in known if below is None or v < below]
        if known:
            out[day] = max(known)
    return out


def _drop_versions(spark: SparkSession, path: str, before: dict[str, int]) -> None:
    for day, last in before.items():
        for v in _children(spark, f"{path}/day={day}", "v"):
            if int(v) < last:
                files, where = _folder(spark, f"{path}/day={day}/v={v}")
                files.delete(where, True)


def read_latest_slots(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every slot day."""
    table = spark.read.parquet(path)
    last = table.groupBy("day").agg(F.max("v").alias("v"))  # partition columns only
    return table.join(last, ["day", "v"], "left_semi").drop("day", "v")


def write_windows(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Updated windows of each micro-batch in a folder `v=<batch>` of their own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    query = windows.writeStream.foreachBatch(put).outputMode("update")
    return query.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_windows(spark: SparkSession, path: str, keys: Sequence[str] = ("site", "win_start")) -> DataFrame:
    """Each window once, as its last micro-batch left it."""
    return first_per_key(spark.read.parquet(path), list(keys), [-F.col("v")]).drop("v")


# Smoothing gain per 50 ms of each field and the slot pull.
GAINS = {
    "cloud_cover": 0.05,
    "cloud_low": 0.05,
    "cloud_mid": 0.05,
    "cloud_high": 0.05,
    "fog_cover": 0.04,
    "humidity": 0.04,
    "precip_rate_mm_h": 0.06,
    "precipitation_intensity": 0.06,
    "wind_speed_ms": 0.08,
    "wind_direction_deg": 0.08,
}
PULLED = {"cloud_cover", "cloud_low", "cloud_mid", "cloud_high", "precip_rate_mm_h", "precipitation_intensity"}
SLOT_PULL = 0.75


def shares(dt: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Smoothing share of each step (row) and field (column): the gain per 50 ms, carried over the step.

    Steps count as 10 ms at least and half a second at most.
    """
    per_step = np.clip([GAINS[n] for n in names], 1e-4, 0.9999)
    return 1.0 - np.power(1.0 - per_step[None, :], np.clip(dt, 0.01, 0.50)[:, None] / 0.05)


def smooth_rows(pdf: pd.DataFrame, names: list[str], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Smooth rows in time order from `state` = (last time, slot, *values).

    A NULL or NaN reading leaves its field as it is.
    """
    pdf = pdf.sort_values(["ts", "event_id"])
    last, slot, *vals = state or (None, None, *[0.0] * len(names))
    # nanoseconds of the column's own clock, whatever unit pandas chose
    now = pdf["ts"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9
    hour = np.floor(now / 3600).astype(np.int64)
    dt = np.diff(now, prepend=now[0] - 0.01 if last is None else last)
    share = shares(dt, names)
    moved = np.append(slot != hour[0], hour[1:] != hour[:-1])
    targets = pdf[names].to_numpy(np.float64)
    round_trip = np.array([n == "wind_direction_deg" for n in names])
    pull = np.where([n in PULLED for n in names], SLOT_PULL, 0.0)
    at, out = np.array(vals, np.float64), np.empty_like(targets)
    for i, (target, a, new) in enumerate(zip(targets, share, moved)):
        gap = target - at
        gap = np.where(round_trip, np.mod(gap + 180.0, 360.0) - 180.0, gap)
        gap = np.where(np.isnan(target), 0.0, gap)
        at = at + gap * a
        if new:
            at = at + np.where(np.isnan(target), 0.0, target - at) * pull
        at = np.where(round_trip, np.mod(at, 360.0), at)
        out[i] = at
    done = pdf[["event_id", "site", "ts"]].assign(**{n: out[:, k] for k, n in enumerate(names)})
    return done, (float(now[-1]), int(hour[-1]), *at.tolist())


def smooth_chunks(chunks: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Smooth rows that come ordered by (key, kind, ts, event_id), a chunk at a time.

    A row of kind 0 holds what an earlier batch left of its key; the last state
    of each key follows its readings as a row of kind 2.  Nothing but the state
    of the key at hand is kept between chunks.
    """
    at: tuple[str, tuple | None, pd.Timestamp | None] | None = None

    def left() -> pd.DataFrame:
        key, (last, slot, *vals), ts = at
        return pd.DataFrame({"kind": [2], "key": [key], "event_id": [0], "ts": [ts], **{n: [v] for n, v in zip(names, vals)}, "last": [last], "slot": [slot]})

    for chunk in chunks:
        for key, rows in chunk.groupby("key", sort=False):
            if at is None or at[0] != key:
                if at is not None:
                    yield left()
                at = (key, None, None)
            kept = rows[rows["kind"] == 0]
            if len(kept):
                first = kept.iloc[0]
                at = (key, (float(first["last"]), int(first["slot"]), *[float(first[n]) for n in names]), first["ts"])
            fresh = rows[rows["kind"] == 1]
            if len(fresh):
                out, state = smooth_rows(fresh.assign(site=0), names, at[1])
                at = (key, state, out["ts"].iloc[-1])
                yield out.drop(columns="site").assign(kind=1, key=key, last=0.0, slot=0)[["kind", "key", "event_id", "ts", *names, "last", "slot"]]
    if at is not None:
        yield left()


def write_smoothed(stream: DataFrame, names: list[str], path: str, checkpoint: str, keep: str | None = None, **trigger) -> StreamingQuery:
    """Per-site exponential smoothing of a reading stream, one folder `v=<batch>` a micro-batch.

    `stream`: `event_id, site, ts` and the fields `names`; other columns are left
    out.  Rows of a micro-batch are ordered by (site, ts, event_id) in Spark and
    smoothed chunk by chunk, so a site with a third of all rows needs no more
    memory than another.  What a site's last row left is read from the batch
    before; with `keep` (an interval) sites silent for longer than that before
    the batch's newest reading start anew.  A repeated batch starts from the
    same state and replaces its own folder.  A NULL site is a site of its own;
    repeated rows count each; rows without a time are left out.
    """
    fields = ", ".join(f"{n} double" for n in names)
    schema = f"kind int, key string, event_id long, ts timestamp, {fields}, last double, slot long"
    order = ["key", "kind", "ts", "event_id"]

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col("ts").isNotNull()).select(
            F.lit(1).alias("kind"), F.coalesce(F.col("site").cast("string"), F.lit("")).alias("key"), F.col("event_id").cast("long"), "ts",
            *[F.col(n).cast("double").alias(n) for n in names], F.lit(0.0).alias("last"), F.lit(0).cast("long").alias("slot"),
        )
        rows, before = fresh, [int(v) for v in _children(spark, path, "v") if int(v) < batch_id]
        if before:
            state = spark.read.schema(schema).parquet(f"{path}/v={max(before)}").where("kind = 2").withColumn("kind", F.lit(0))
            if keep:
                newest = fresh.agg(F.max("ts").alias("t")).first()["t"]
                if newest is not None:
                    state = state.where(F.col("ts") >= F.lit(newest) - F.expr(f"interval {keep}"))
            rows = fresh.unionByName(state.select(*fresh.columns))
        ordered = rows.repartition("key").sortWithinPartitions(*order)
        ordered.mapInPandas(lambda chunks: smooth_chunks(chunks, names), schema).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_smoothed(spark: SparkSession, path: str) -> DataFrame:
    """All smoothed readings: event_id, site, ts and the fields."""
    site = F.when(F.col("key") != "", F.col("key").cast("long"))
    return spark.read.parquet(path).where("kind = 1").withColumn("site", site).drop("v", "kind", "key", "last", "slot")


def windowed_observations(
    rows: DataFrame, size: str = "3 hours", slide: str | None = None, late: str = "12 hours"
) -> DataFrame:
    """Mean reading per site and time window; rows later than `late` drop out
    of a stream (a batch keeps all)."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        rows.withWatermark("ts", late)
        .groupBy("site", win.alias("w"))
        .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
        .select("site", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "mean_value", "n")
    )
