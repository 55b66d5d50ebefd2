"""Forecast payloads (hourly JSON) as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.functions.angles import clamp

_DETAILS = (
    "cloud_area_fraction string, cloud_area_fraction_low string, cloud_area_fraction_medium string, "
    "cloud_area_fraction_high string, fog_area_fraction string, relative_humidity string, wind_speed string, "
    "wind_from_direction string, air_pressure_at_sea_level string, air_temperature string"
)
_BLOCK = "struct<summary: struct<symbol_code: string>, details: struct<precipitation_amount: string>>"
PAYLOAD = (
    "struct<properties: struct<timeseries: array<struct<time: string, data: struct<instant: struct<details: struct<"
    + _DETAILS.replace(" string", ": string")
    + f">>, next_1_hours: {_BLOCK}, next_6_hours: {_BLOCK}, next_12_hours: {_BLOCK}>>>>>"
)
FIELDS = (
    "cloud_cover cloud_low cloud_mid cloud_high fog_cover humidity wind_speed_ms wind_direction_deg pressure_hpa "
    "temperature_c precip_rate_mm_h precipitation_intensity thunder_probability"
).split()


def flatten_forecast(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per forecast time with the fourteen derived fields.

    All columns but the payload are carried along; unreadable times drop out.
    """
    keep = [c for c in payloads.columns if c != payload]
    doc = payloads.select(*keep, F.from_json(payload, PAYLOAD).alias("_doc"))
    rows = doc.select(*keep, F.explode("_doc.properties.timeseries").alias("_t"))
    stamp = F.regexp_replace(F.col("_t.time"), "Z$", "+00:00").try_cast("timestamp")
    rows = rows.select(*keep, stamp.alias("time"), F.col("_t.data").alias("_d")).where("time is not null")

    def detail(name: str) -> Column:
        return F.col(f"_d.instant.details.{name}").try_cast("double")

    def fraction(name: str, default: Column) -> Column:
        return clamp(F.coalesce(detail(name), default) / 100.0, 0.0, 1.0)

    total = F.coalesce(detail("cloud_area_fraction"), F.lit(0.0))
    rate, symbol = F.lit(None).cast("double"), F.lit(None).cast("string")
    for hours in (1, 6, 12):
        block = f"_d.next_{hours}_hours"
        amount = F.col(f"{block}.details.precipitation_amount").try_cast("double")
        use = rate.isNull() & amount.isNotNull()
        symbol = F.when(use, F.lower(F.coalesce(F.col(f"{block}.summary.symbol_code"), F.lit("")))).otherwise(symbol)
        rate = F.coalesce(rate, F.when(amount >= 0, amount / float(hours)).when(amount < 0, 0.0))
    flat = rows.select(
        *keep,
        "time",
        fraction("cloud_area_fraction", F.lit(0.0)).alias("_cover"),
        fraction("cloud_area_fraction_low", total).alias("cloud_low"),
        fraction("cloud_area_fraction_medium", total).alias("cloud_mid"),
        fraction("cloud_area_fraction_high", total).alias("cloud_high"),
        fraction("fog_area_fraction", F.lit(0.0)).alias("fog_cover"),
        fraction("relative_humidity", F.lit(75.0)).alias("humidity"),
        clamp(F.coalesce(detail("wind_speed"), F.lit(2.0)), 0.0, 60.0).alias("wind_speed_ms"),
        clamp(F.coalesce(detail("wind_from_direction"), F.lit(0.0)), 0.0, 360.0).alias("wind_direction_deg"),
        detail("air_pressure_at_sea_level").alias("pressure_hpa"),
        detail("air_temperature").alias("temperature_c"),
        F.coalesce(rate, F.lit(0.0)).alias("precip_rate_mm_h"),
        F.coalesce(symbol, F.lit("")).alias("_symbol"),
    )
    falls = F.col("precip_rate_mm_h") > 0.03
    kind = F.when(falls & (F.col("temperature_c") <= 0.5), "snow").when(falls, "rain").otherwise("none")
    strength = clamp(F.col("precip_rate_mm_h") / 6.0, 0.0, 1.0)
    cover = F.when(falls, F.greatest(F.col("_cover"), 0.65 + 0.25 * strength)).otherwise(F.col("_cover"))
    return flat.select(
        *keep,
        F.date_trunc("hour", "time").alias("slot_ts"),
        "time",
        F.year("time").alias("year"),
        (F.dayofyear("time") - 1).alias("day_index"),
        F.hour("time").alias("hour"),
        cover.alias("cloud_cover"),
        "cloud_low",
        "cloud_mid",
        "cloud_high",
        "fog_cover",
        "humidity",
        "wind_speed_ms",
        "wind_direction_deg",
        "pressure_hpa",
        "temperature_c",
        "precip_rate_mm_h",
        kind.alias("precipitation_type"),
        strength.alias("precipitation_intensity"),
        F.when(F.col("_symbol").contains("thunder"), 0.35).otherwise(0.0).alias("thunder_probability"),
    )


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Forecast files, one JSON document each, as flat rows with `source_file`."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("payload")
    )
    return flatten_forecast(raw)
