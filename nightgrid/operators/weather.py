"""Forecast look-up, hourly interpolation, climatology fallback, as-of join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.functions.angles import clamp, wrap180, wrap360
from nightgrid.functions.asof import last_known
from nightgrid.functions.scale import first_per_key, sized_join
from nightgrid.operators.photometry import clean_atmosphere, extinction_k
from nightgrid.sources.forecast import FIELDS

FORECAST_DAYS = 10
TTL_HOURS = 12


def latest_slots(records: DataFrame, newest: Sequence[Column]) -> DataFrame:
    """Newest record per `(site, slot_ts)`; `newest` sorts newest first."""
    return first_per_key(records, ["site", "slot_ts"], newest)


def _at_place(place: tuple[float, float]) -> Column:
    near = (F.abs(F.col("lat") - place[0]) < 1e-6) & (F.abs(F.col("lon") - place[1]) < 1e-6)
    return F.coalesce(near, F.lit(False))


def forecast_coverage(records: DataFrame, as_of, target=None, place: tuple[float, float] | None = None) -> DataFrame:
    """Covered time per `(site, fetch_id)`, freshness, date coverage and location match.

    `records` has `site, fetch_id, fetched, time`; `as_of` is a timestamp and
    `target` a date, both Columns.  With `place` (latitude, longitude) they also
    have `lat, lon`, and `here` says whether the whole fetch is for that place;
    a fetch with a missing coordinate is not.
    """
    age = F.abs(F.unix_timestamp(as_of) - F.unix_timestamp("fetched_at"))
    out = records.groupBy("site", "fetch_id").agg(
        F.min("time").alias("coverage_start"),
        F.max("time").alias("coverage_end"),
        F.max("fetched").alias("fetched_at"),
        F.count(F.lit(1)).alias("n_slots"),
        *([F.bool_and(_at_place(place)).alias("here")] if place else []),
    )
    out = out.withColumn("fresh", age < TTL_HOURS * 3600)
    if target is not None:
        inside = (F.to_date("coverage_start") <= target) & (target <= F.to_date("coverage_end"))
        out = out.withColumn("covers", inside)
    return out


def forecast_lookup(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Record of each request slot with a status.

    `requests`: `req_id, site, year, day_index, hour, now_ts`; `records`: one
    row per `(site, slot_ts)` (see `latest_slots`).
    """
    cover = records.groupBy("site").agg(
        F.to_date(F.min("slot_ts")).alias("_first"), F.to_date(F.max("slot_ts")).alias("_last")
    )
    day = F.date_add(F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1)), F.col("day_index").cast("int"))
    req = requests.withColumn("_day", day)
    hours = F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.pmod(F.col("hour").cast("int"), F.lit(24)))
    req = req.withColumn("slot_ts", F.col("_day").cast("timestamp") + hours)
    req = sized_join(req, cover, ["site"], "left")
    hit = sized_join(req, records.withColumn("_found", F.lit(True)), ["site", "slot_ts"], "left")
    today = F.to_date("now_ts")
    status = (
        F.when((F.col("_day") < today) | (F.col("_day") > F.date_add(today, FORECAST_DAYS)), "out_of_range")
        .when(F.col("_first").isNull(), "cache_miss")
        .when((F.col("_day") < F.col("_first")) | (F.col("_day") > F.col("_last")), "coverage_miss")
        .when(F.col("_found").isNull(), "slot_miss")
        .otherwise("remote_ok")
    )
    hit = hit.withColumn("status", status).drop("_day", "_first", "_last", "_found")
    values = [c for c in records.columns if c not in ("site", "slot_ts")]
    for c in values:
        hit = hit.withColumn(c, F.when(F.col("status") == "remote_ok", F.col(c)))
    return hit


def _blend(fields: Sequence[str], categories: Sequence[str], t: Column) -> list[Column]:
    """Columns from structs `w0` and `w1`; one side alone stands for both."""
    only1, only0 = F.col("w0").isNull(), F.col("w1").isNull()
    out = []
    for f in fields:
        a, b = F.col(f"w0.{f}"), F.col(f"w1.{f}")
        if f == "wind_direction_deg":
            mix = wrap360(a + wrap180(b - a) * t)
        else:
            mix = a + (b - a) * t
        out.append(F.when(only1, b).when(only0, a).otherwise(mix).alias(f))
    for f in categories:
        a, b = F.col(f"w0.{f}"), F.col(f"w1.{f}")
        out.append(F.when(only1, b).when(only0, a).when(t >= 0.5, b).otherwise(a).alias(f))
    return out


def _hour_parts(ts: str) -> tuple[Column, Column]:
    at = F.col(ts).cast("timestamp")
    start = F.date_trunc("hour", at)
    frac = (F.unix_micros(at) - F.unix_micros(start)).cast("double") / 3.6e9
    return start, frac


def interpolate_weather(
    requests: DataFrame,
    records: DataFrame,
    fields: Sequence[str] = FIELDS,
    categories: Sequence[str] = ("precipitation_type",),
) -> DataFrame:
    """Weather at `req_ts` between the two neighbouring hourly slots.

    Numbers are linear, wind direction takes the shortest arc, categories the
    nearest slot; all fields are NULL when neither slot exists.
    """
    start, frac = _hour_parts("req_ts")
    body = records.select("site", F.col("slot_ts").cast("timestamp").alias("slot_ts"), F.struct(*fields, *categories).alias("w"))
    req = requests.withColumn("_s0", start).withColumn("_t", frac)
    req = req.withColumn("_s1", F.col("_s0") + F.expr("interval 1 hour"))
    left = body.withColumnRenamed("slot_ts", "_s0").withColumnRenamed("w", "w0")
    right = body.withColumnRenamed("slot_ts", "_s1").withColumnRenamed("w", "w1")
    hit = sized_join(sized_join(req, left, ["site", "_s0"], "left"), right, ["site", "_s1"], "left")
    return hit.select(*requests.columns, *_blend(fields, categories, F.col("_t")))


def _noise(x: Column, octaves: int) -> Column:
    total, norm, amp, freq = F.lit(0.0), 0.0, 1.0, 1.0
    for _ in range(octaves):
        total = total + amp * (F.sin(x * (freq * 0.01)) * 0.5 + 0.5)
        norm += amp
        amp, freq = amp * 0.5, freq * 2.0
    return total / norm


CLIMATE_FIELDS = ("cloud_cover", "precipitation_intensity", "thunder_probability")


def climatology_table(
    spark: SparkSession, clear_nights: float = 0.7, clear_days: float = 0.6, rainy: float = 0.2, snowy: float = 0.1
) -> DataFrame:
    """Deterministic fallback year: 365 days x 24 hours."""
    t = spark.range(365 * 24).select(
        F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"), F.col("id").cast("double").alias("i")
    )
    winter = F.greatest(F.lit(0.0), -F.sin(F.col("day") / 365.0 * (2.0 * math.pi)))
    night = (F.col("hour") < 6) | (F.col("hour") > 20)
    base = F.when(night, 1.0 - clear_nights).otherwise(1.0 - clear_days) * _noise(F.col("i"), 4)
    roll = _noise(F.col("i") + 1000.0, 2)
    t = t.withColumn("_w", winter).withColumn("_base", base).withColumn("_roll", roll)
    snow = (F.col("_roll") < rainy) & (F.col("_w") > 0.5) & (F.col("_roll") < snowy)
    kind = F.when(snow, "snow").when(F.col("_roll") < rainy, "rain").otherwise("none")
    power = (
        F.when(kind == "snow", F.col("_w") * _noise(F.col("i") + 2000.0, 3))
        .when(kind == "rain", _noise(F.col("i") + 3000.0, 3))
        .otherwise(0.0)
    )
    t = t.withColumn("precipitation_type", kind).withColumn("_p", power)
    thunder = F.when((F.col("precipitation_type") == "rain") & (F.col("_p") > 0.6), (F.col("_p") - 0.6) * 2.5).otherwise(0.0)
    wet = (F.col("precipitation_type") != "none") & (F.col("_p") > 0)
    cover = F.when(wet, F.greatest(F.col("_base"), 0.8 + F.col("_p") * 0.2)).otherwise(F.col("_base"))
    one = F.lit(1.0)
    return t.select(
        "day",
        "hour",
        F.least(one, cover).alias("cloud_cover"),
        "precipitation_type",
        F.least(one, F.col("_p")).alias("precipitation_intensity"),
        F.least(one, thunder).alias("thunder_probability"),
    )


def weather_or_fallback(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Interpolated forecast, or the climatology of the same hour where no
    neighbouring slot exists; `source` says which."""
    spark = requests.sparkSession
    cats = ("precipitation_type",)
    remote = interpolate_weather(requests, records, CLIMATE_FIELDS, cats)
    remote = remote.withColumn("source", F.when(F.col("precipitation_type").isNull(), "fallback").otherwise("remote"))
    start, frac = _hour_parts("req_ts")
    nxt = start + F.expr("interval 1 hour")
    keyed = remote.withColumn("_t", frac)
    for i, ts in enumerate((start, nxt)):
        keyed = keyed.withColumn(f"_d{i}", (F.dayofyear(ts) - 1) % 365).withColumn(f"_h{i}", F.hour(ts))
    year = climatology_table(spark)  # 8,760 rows whatever the input
    body = F.struct(*CLIMATE_FIELDS, *cats)
    for i in range(2):
        side = year.select(F.col("day").alias(f"_d{i}"), F.col("hour").alias(f"_h{i}"), body.alias(f"w{i}"))
        keyed = keyed.join(F.broadcast(side), [f"_d{i}", f"_h{i}"], "left")
    fallback = {c: b for c, b in zip((*CLIMATE_FIELDS, *cats), _blend(CLIMATE_FIELDS, cats, F.col("_t")))}
    cols = [F.coalesce(F.col(c), fallback[c]).alias(c) for c in (*CLIMATE_FIELDS, *cats)]
    return keyed.select(*requests.columns, *cols, "source")


def weather_derived(w: DataFrame) -> DataFrame:
    """Cloud optical depth, sun dimming and layer shares.

    Reads `cloud_cover` and, where present, the layer clouds, fog, humidity
    and precipitation; without layers the shares are 50, 32 and 18 percent.
    """

    def has(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in w.columns else F.lit(default)

    c = clamp(has("cloud_cover", 0.0), 0.0, 1.0)
    depth = 0.05 + 2.75 * F.pow(c, F.lit(1.15))
    rain = clamp(has("precipitation_intensity", 0.0), 0.0, 1.0)
    fog, damp = clamp(has("fog_cover", 0.0), 0.0, 1.0), clamp(has("humidity", 0.0), 0.0, 1.0)
    zero = F.lit(0.0)
    dim_fog = F.least(F.lit(1.0), fog * 1.10 + F.greatest(zero, damp - 0.80) * 0.85)
    dim = F.greatest(F.greatest(zero, (c - 0.55) / 0.45), rain * 1.20, dim_fog)
    out = w.withColumn("optical_depth", depth).withColumn("sun_dim", clamp(F.pow(dim, F.lit(1.15)), 0.0, 1.0))
    names = ("cloud_low", "cloud_mid", "cloud_high")
    layered = all(n in w.columns for n in names)
    total = sum((F.greatest(zero, F.col(n)) for n in names), F.lit(0.0)) if layered else F.lit(None).cast("double")
    for n, share in zip(names, (0.50, 0.32, 0.18)):
        known = F.greatest(zero, F.col(n)) / total if layered else F.lit(share)
        out = out.withColumn(n.replace("cloud", "share"), F.when(total > 1e-6, known).otherwise(share))
    return out


def atmosphere_asof(obs: DataFrame, metrics: DataFrame, k_fallback: float = 0.20) -> DataFrame:
    """Latest aerosol/pressure record of the site within 12 hours before each
    observation, as an extinction coefficient.

    `obs`: `obs_id, site, ts`; `metrics`: `site, ts, aod, pressure_hpa`.  Both
    sides are cut into ranges of (site, ts) and each range carries its last
    record on (`last_known`), so a site that holds a third of all rows spreads.
    """
    m = metrics.select(
        "site", "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("obs_id"), F.struct("ts", "aod", "pressure_hpa").alias("rec")
    )
    o = obs.select(
        "site", "ts", F.lit(1).alias("kind"), F.col("obs_id").cast("long").alias("obs_id"), F.lit(None).cast(m.schema["rec"].dataType).alias("rec")
    )
    both = last_known(m.unionByName(o), ["site"], ["ts", "kind"], "rec").where("kind = 1")
    age = F.unix_timestamp("ts") - F.unix_timestamp(F.col("rec.ts"))
    fresh = F.col("rec").isNotNull() & (age < TTL_HOURS * 3600)
    both = both.select(
        "obs_id",
        "site",
        "ts",
        F.when(fresh, F.col("rec.aod")).alias("aod"),
        F.when(fresh, F.col("rec.pressure_hpa")).alias("pressure_hpa"),
    )
    cleaned = clean_atmosphere(both)
    used = F.col("aod").isNull() | F.col("pressure_hpa").isNull()
    return cleaned.withColumn("k", extinction_k("aod", "pressure_hpa", k_fallback)).withColumn("fallback_used", used)
