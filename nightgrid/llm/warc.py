"""Not-modified revisits resolved to the full response that they stand for.

A revisit takes the latest strictly earlier full response of its canonical URL.
It is resolved if their validators agree: entity tags when the revisit has one,
else the last-modified dates.  The stored headers are then updated by those of
the revisit, except for the fields that describe a body or a connection.

The as-of join runs over distinct (URL, time) moments that a range exchange
cuts and sorts, so a URL with a third of all records spreads over many tasks;
what each piece of a URL ends with is carried to the next pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightgrid.llm.storage import stored

MOMENTS = 500_000  # (URL, time) moments in a range partition
#: Fields of a 304 that never replace stored ones.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host without `www.` and default port, path without closing slash and `.html`, query without tracking.

    Null, or a text without `://`, has no canonical URL.
    """
    at = F.instr(url, "://")
    rest = F.regexp_replace(F.substring(url, at + 3, F.length(url)), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", ""), "[.]html$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "[?](.*)$", 1), "(^|&)(utm_[a-z]+|ref)=[^&]*", ""), "^&", "")
    return F.when(at > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def latest_before(records: DataFrame, key: str, time: str, full: Column, value: Column, moments: int = MOMENTS) -> DataFrame:
    """For each distinct (key, time): the greatest `value` of the latest full row strictly before.

    `time` is a long.  Rows without key or time take no part.
    """
    seen = records.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    best = F.max(F.when(full, F.struct(F.col(time).alias("at"), value.alias("value")))).alias("own")
    points = seen.groupBy(F.col(key).alias("k"), F.col(time).cast("long").alias("t")).agg(best)
    points = stored(points, "asof-moments")
    n = max(1, math.ceil(points.count() / moments))
    cut = points.repartitionByRange(n, "k", "t").withColumn("p", F.spark_partition_id())
    cut = stored(cut, "asof-ranges")
    within = Window.partitionBy("p", "k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("here", F.max("own").over(within))
    # a range partition shares at most its first and last key with others, so there are few of these
    spread = cut.groupBy("k").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a < b").select("k")
    ends = cut.join(spread, "k", "left_semi").groupBy("k", "p").agg(F.max("own").alias("end"))
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("k", "p", F.max("end").over(before).alias("carried"))
    got = inner.join(ends, ["k", "p"], "left")
    return got.select(F.col("k").alias(key), F.col("t").alias(time), F.coalesce("here", "carried").alias("latest"))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merge_headers(stored_headers: Column, fresh: Column) -> Column:
    """Stored fields, replaced and extended by the permitted ones of a 304; names are in lower case."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(F.coalesce(stored_headers, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """`records` (record_id, url, at long, revisit boolean, headers map, body_id) resolved.

    Returns a row per record: record_id, canonical, status, source_id, body_id,
    headers.  status is full, resolved, mismatch (validators differ), unverified
    (the revisit has none) or missing (no earlier full response, or no URL or
    time).  Only a resolved revisit takes the body and merged headers of its
    source; the others keep their own.  Repeated rows are resolved each.  Of several full
    responses at one time the greatest record_id counts; a null revisit flag reads as full.
    """
    base = records.select("record_id", "url", F.col("at").cast("long").alias("at"), F.coalesce("revisit", F.lit(False)).alias("revisit"), "headers", "body_id")
    base = base.withColumn("canonical", canonical_url(F.col("url")))
    sortable = F.struct("record_id", "body_id", F.array_sort(F.map_entries("headers")).alias("entries"))
    found = latest_before(base, "canonical", "at", ~F.col("revisit"), sortable)
    joined = base.join(found, ["canonical", "at"], "left")
    source, got = F.col("latest.value"), F.col("headers")
    there = F.map_from_entries(source["entries"])
    tag, date = got["etag"], got["last-modified"]
    agrees = F.when(tag.isNotNull(), weak(tag).eqNullSafe(weak(there["etag"]))).otherwise(date.eqNullSafe(there["last-modified"]))
    status = (
        F.when(~F.col("revisit"), "full").when(source.isNull(), "missing").when(tag.isNull() & date.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    )
    out = joined.withColumn("status", status)
    done = F.col("status") == "resolved"
    return out.select(
        "record_id", "canonical", "status",
        F.when(done, source["record_id"]).alias("source_id"),
        F.when(done, source["body_id"]).otherwise(F.col("body_id")).alias("body_id"),
        F.when(done, merge_headers(there, got)).otherwise(got).alias("headers"),
    )
