"""Star catalogue curation: typing, stacking, de-duplication, slicing, batches.

Canonical columns: `source_id` long, `ra`, `dec` double, `mag` float-like,
`bp_rp`, `pmra`, `pmdec`, `parallax`.  Missing values are NULL, never NaN.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.angles import clamp
from nightgrid.functions.scale import first_per_key, global_rank, staged

# Accepted header names per column, in priority order.
ALIASES = {
    "ra": ("ra", "raj2000", "ra_deg"),
    "dec": ("dec", "dej2000", "dec_deg"),
    "mag": ("phot_g_mean_mag", "mag", "g_mag", "phot_g"),
    "bp_rp": ("bp_rp", "bprp", "bp-rp", "bp_rp_color"),
    "pmra": ("pmra",),
    "pmdec": ("pmdec",),
    "parallax": ("parallax",),
    "source_id": ("source_id", "sourceid", "id"),
}
REQUIRED = ("ra", "dec", "mag")
OPTIONAL = ("bp_rp", "pmra", "pmdec", "parallax", "source_id")
DEFAULT_BP_RP = 0.8


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename the first known alias of each column; drop unknown columns
    except `source_file`.  Missing required columns raise ValueError."""
    by_norm: dict[str, str] = {}
    for name in df.columns:
        by_norm[name.strip().lower().replace(" ", "_")] = name
    out = []
    for target, names in ALIASES.items():
        hit = next((by_norm[n] for n in names if n in by_norm), None)
        if hit is not None:
            out.append(F.col(f"`{hit}`").alias(target))
        elif target in REQUIRED:
            raise ValueError(f"missing required column: {target}")
    for extra in ("source_file",):
        if extra in df.columns:
            out.append(F.col(extra))
    return df.select(*out)


def _number(name: str, kind: str) -> Column:
    text = F.trim(F.col(name).cast("string"))
    return F.when(text == "", None).otherwise(text).try_cast(kind)


def _finite(c: Column) -> Column:
    inf = F.lit(float("inf"))
    return c.isNotNull() & ~F.isnan(c) & (c != inf) & (c != -inf)


def _with_parsed(df: DataFrame) -> DataFrame:
    """Typed columns from tolerant casts; unreadable text becomes NULL.

    Every text is read once: filters on the results are not pushed into it.
    """
    keep = [c for c in df.columns if c not in ALIASES]
    kinds = {"ra": "double", "dec": "double", "mag": "float", "bp_rp": "float", "pmra": "float", "pmdec": "float", "parallax": "float"}
    read = {f"_{n}": _number(n, k) for n, k in kinds.items() if n in df.columns}
    if "source_id" in df.columns:
        read |= {"_id": _number("source_id", "long"), "_id_real": _number("source_id", "double")}
    present = set(df.columns)
    df = staged(df, **read)
    cols = [F.col(f"_{name}").alias(name) for name in REQUIRED]
    if "bp_rp" in present:
        b = F.col("_bp_rp")
        inf = F.lit(float("inf"))
        filled = (
            F.when(b.isNull() | F.isnan(b), DEFAULT_BP_RP).when(b == inf, 2.5).when(b == -inf, -0.5).otherwise(b)
        )
        cols.append(filled.cast("float").alias("bp_rp"))
    else:
        cols.append(F.lit(DEFAULT_BP_RP).cast("float").alias("bp_rp"))
    for name in ("pmra", "pmdec", "parallax"):
        if name in present:
            v = F.col(f"_{name}")
            cols.append(F.when(_finite(v), v).alias(name))
        else:
            cols.append(F.lit(None).cast("float").alias(name))
    if "source_id" in present:
        f = F.col("_id_real")
        through_float = F.when(_finite(f), F.when(f < 0, F.ceil(f)).otherwise(F.floor(f))).cast("string").try_cast("long")
        sid = F.coalesce("_id", through_float)
        cols.append(F.when(sid >= 0, sid).alias("source_id"))
    else:
        cols.append(F.lit(None).cast("long").alias("source_id"))
    return df.select(*cols, *keep)


def normalize_catalog(df: DataFrame) -> DataFrame:
    """Typed rows with finite position and magnitude; bp_rp defaults filled."""
    typed = _with_parsed(resolve_columns(df))
    return typed.where(_finite(F.col("ra")) & _finite(F.col("dec")) & _finite(F.col("mag")))


def ingest_report(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows read, kept and rejected (first failing column) per input file."""
    typed = _with_parsed(resolve_columns(df))
    bad_ra, bad_dec, bad_mag = (~_finite(F.col(c)) for c in REQUIRED)
    reason = F.when(bad_ra, "ra").when(bad_dec, "dec").when(bad_mag, "mag")
    return (
        typed.withColumn("_reason", reason)
        .groupBy(source)
        .agg(
            F.count(F.lit(1)).alias("rows_read"),
            F.count_if(F.col("_reason").isNull()).alias("rows_kept"),
            F.count_if(F.col("_reason") == "ra").alias("rejected_ra"),
            F.count_if(F.col("_reason") == "dec").alias("rejected_dec"),
            F.count_if(F.col("_reason") == "mag").alias("rejected_mag"),
        )
    )


def require_rows(report: DataFrame) -> DataFrame:
    """Raise ValueError when no file of an ingest report kept a row."""
    kept = report.agg(F.sum("rows_kept").alias("n")).first()["n"]
    if not kept:
        raise ValueError("no usable star rows in the input")
    return report


def union_catalogs(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack catalogues; columns absent from a source are NULL there."""
    if not frames:
        raise ValueError("nothing to union")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, order: Sequence[Column], valid: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """First row per `source_id` by `order`; rows without a valid id all stay.  `keep` names the columns to return."""
    ok = (F.col("source_id") >= 0) if valid is None else valid
    ok = F.coalesce(ok, F.lit(False))
    kept = first_per_key(df.where(ok), ["source_id"], order, keep)
    return kept.unionByName(df.where(~ok).select(*kept.columns))


def fuse_brightest(base: DataFrame, supplement: DataFrame, seq: str = "seq") -> DataFrame:
    """Brightest row per positive id over both sources; base wins ties."""
    both = base.withColumn("_src", F.lit(0)).unionByName(supplement.withColumn("_src", F.lit(1)))
    order = [F.col("mag"), F.col("_src"), F.col(seq)]
    return dedupe_first(both, order, F.col("source_id") > 0).drop("_src")


def insert_supplement(base: DataFrame, supplement: DataFrame, seq: str = "seq") -> DataFrame:
    """Add a supplement that is de-duplicated within itself only.

    Rows come back unsorted with the merge order in (`mag`, `is_base`, `seq`);
    a writer that needs it sorts once at the end.
    """
    extra = dedupe_first(supplement, [F.col("mag"), F.col(seq)], F.col("source_id") > 0)
    return extra.withColumn("is_base", F.lit(0)).unionByName(base.withColumn("is_base", F.lit(1)))


def magnitude_slice(df: DataFrame, lo: float | None, hi: float, limit: int | None = None) -> DataFrame:
    """`lo < mag <= hi`; with `limit` the brightest rows (ties by id)."""
    cond = F.col("mag").isNotNull() & (F.col("mag") <= float(hi))
    if lo is not None:
        cond = cond & (F.col("mag") > float(lo))
    out = df.where(cond)
    if limit:
        out = out.orderBy("mag", "source_id").limit(int(limit))
    return out


def _seed_ranges(lo: float, hi: float, step: float) -> list[tuple[float, float]]:
    """Equal ranges of `step` (0.05 at least) from `lo`, the last one cut at `hi`."""
    width = max(0.05, step)
    n = max(0, math.ceil((hi - lo - 1e-9) / width))
    cuts = [lo + i * width for i in range(n)] + [hi]
    return list(zip(cuts, cuts[1:]))


def _leaf_edges(ranges: list[tuple[float, float]], min_span: float) -> list[float]:
    """All cut points that repeated halving can reach, ascending."""
    edges = [ranges[0][0]]

    def halve(a: float, b: float) -> None:
        if b - a > 2.0 * min_span:
            m = (a + b) * 0.5
            halve(a, m)
            halve(m, b)
        else:
            edges.append(b)

    for a, b in ranges:
        halve(a, b)
    return edges


def leaf_histogram(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Rows per interval `(edges[i], edges[i+1]]` in one aggregation pass.

    The interval is guessed by division on the smallest width and moved with
    a short literal lookup table, so the pass stays a plain projection.
    """
    n = len(edges) - 1
    width = min(b - a for a, b in zip(edges, edges[1:]))
    slots = int((edges[-1] - edges[0]) / width) + 2
    # first interval that can hold values of each uniform slot
    start, at = [], 0
    for s in range(slots):
        left = edges[0] + s * width
        while at < n - 1 and edges[at + 1] < left - 1e-12:
            at += 1
        start.append(at)
    table = F.lit(start).cast("array<int>")
    upper = F.lit([float(e) for e in edges[1:]]).cast("array<double>")
    # boundaries: magnitude and guess are computed once per row, whatever reads them
    inside = staged(df, _mag=F.col("mag").cast("double")).where((F.col("_mag") > float(edges[0])) & (F.col("_mag") <= float(edges[-1])))
    mag, guess = F.col("_mag"), F.col("_guess")
    slot = F.least(F.lit(slots - 1), F.greatest(F.lit(0), F.floor((mag - edges[0]) / width).cast("int")))
    inside = staged(inside, _guess=F.get(table, slot))
    # a slot is as wide as the narrowest interval, so it meets two edges at most
    leaf = guess
    for step in range(3):
        leaf = leaf + F.when((guess + step < n - 1) & (mag > F.get(upper, guess + step)), 1).otherwise(0)
    return inside.groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n_rows"))


def plan_magnitude_batches(
    df: DataFrame,
    lo: float,
    hi: float,
    step: float = 0.5,
    max_rows: int = 2_000_000,
    min_span: float = 0.02,
    floor_rows: int = 50_000,
) -> DataFrame:
    """Magnitude ranges of at most `max_rows` rows, halved until narrow.

    One pass counts every reachable leaf; the leaf histogram (its length
    depends on the range and span only) is folded into batches.
    """
    ranges = _seed_ranges(lo, hi, step)
    span, cap = max(0.02, min_span), max(floor_rows, int(max_rows))
    edges = _leaf_edges(ranges, span)
    counts = {r["leaf"]: r["n_rows"] for r in leaf_histogram(df, edges).collect()}
    index = {e: i for i, e in enumerate(edges)}
    rows: list[tuple[float, float, int]] = []

    def fold(a: float, b: float) -> None:
        total = sum(counts.get(i, 0) for i in range(index[a], index[b]))
        if total <= 0:
            return
        if total > cap and b - a > 2.0 * span:
            m = (a + b) * 0.5
            fold(a, m)
            fold(m, b)
        else:
            rows.append((a, b, total))

    for a, b in ranges:
        fold(a, b)
    schema = "mag_min_exclusive double, mag_max double, rows_estimate long"
    return df.sparkSession.createDataFrame(rows, schema)


def batch_counts(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Imported rows per manifest batch.

    The manifest is a plan whose length depends on the magnitude range and the
    span only; its disjoint ranges become the leaves of one counting pass, and
    counts meet their batch by leaf number.
    """
    spans = sorted((r["mag_min_exclusive"], r["mag_max"]) for r in manifest.select("mag_min_exclusive", "mag_max").distinct().collect())
    leaves = "leaf int, mag_min_exclusive double, mag_max double"
    if not spans:
        return df.sparkSession.createDataFrame([], "mag_min_exclusive double, mag_max double, imported_rows long")
    edges = sorted({e for s in spans for e in s})
    at = {e: i for i, e in enumerate(edges)}
    rows = [(i, a, b) for a, b in spans for i in range(at[a], at[b])]
    counted = leaf_histogram(df, edges).join(df.sparkSession.createDataFrame(rows, leaves), "leaf")
    return counted.groupBy("mag_min_exclusive", "mag_max").agg(F.sum("n_rows").alias("imported_rows"))


def batch_report(manifest: DataFrame, imported: DataFrame, min_ratio: float = 0.98) -> DataFrame:
    """Per-batch progress with the overall figures repeated on every row."""
    joined = manifest.join(imported, ["mag_min_exclusive", "mag_max"], "left")
    joined = joined.withColumn("imported_rows", F.coalesce("imported_rows", F.lit(0)).cast("long"))
    est = F.col("rows_estimate")
    joined = joined.withColumn("completed", F.col("imported_rows") >= est * F.lit(min_ratio))
    whole = Window.partitionBy()  # one row per batch: bounded by the plan
    total = F.sum(est).over(whole)
    done = F.sum(F.when(F.col("completed"), est).otherwise(0)).over(whole)
    got = F.sum("imported_rows").over(whole)
    pct = F.when(total > 0, clamp(100.0 * done / total, 0.0, 100.0)).otherwise(0.0)
    return joined.select(
        "mag_min_exclusive",
        "mag_max",
        "rows_estimate",
        "imported_rows",
        "completed",
        total.alias("total_rows"),
        done.alias("completed_rows"),
        F.bround(pct, 3).alias("progress_percent"),
        F.when(total > 0, got / total).otherwise(1.0).alias("import_ratio"),
        (F.when(total > 0, got / total).otherwise(1.0) < min_ratio).alias("rejected"),
    )


def require_complete(report: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Raise ValueError on a report whose import ratio is under the gate."""
    if not allow_partial and report.where("rejected").limit(1).count():
        raise ValueError("imported rows are below the expected count")
    return report


# Colour nodes (index, r, g, b) and the desaturation target.
COLOR_NODES = (
    (-0.5, 155, 187, 255),
    (0.0, 175, 205, 255),
    (0.5, 235, 238, 255),
    (1.0, 255, 244, 214),
    (1.6, 255, 212, 150),
    (2.5, 255, 174, 120),
)
PALE = (230, 232, 240)


def star_colors(df: DataFrame, desaturate: float | None = None) -> DataFrame:
    """Integer-map colour (`r,g,b`) and node-interpolated colour (`nr,ng,nb`)."""
    v = F.col("bp_rp").cast("double")
    v = F.when(v.isNull() | F.isnan(v), DEFAULT_BP_RP).otherwise(v)
    fast = clamp(v, -1e9, 1e9)

    def trunc(x: Column, lo: float, hi: float) -> Column:
        return F.floor(clamp(x, lo, hi)).cast("int")

    t2, t3, t4 = fast / 0.5, (fast - 0.5) / 0.5, (fast - 1.0) / 0.6
    t5 = clamp((fast - 1.6) / 0.9, 0.0, 1.0)
    r = F.when(fast <= 0, 175).when(fast <= 0.5, trunc(175.0 + 60.0 * t2, 0, 255)).otherwise(255)
    g = (
        F.when(fast <= 0, trunc(205.0 + fast * 36.0, 187, 223))
        .when(fast <= 0.5, trunc(205.0 + 33.0 * t2, 0, 255))
        .when(fast <= 1.0, trunc(238.0 + 6.0 * t3, 0, 255))
        .when(fast <= 1.6, trunc(244.0 - 32.0 * t4, 0, 255))
        .otherwise(trunc(212.0 - 38.0 * t5, 0, 255))
    )
    b = (
        F.when(fast <= 0.5, 255)
        .when(fast <= 1.0, trunc(255.0 - 41.0 * t3, 0, 255))
        .when(fast <= 1.6, trunc(214.0 - 64.0 * t4, 0, 255))
        .otherwise(trunc(150.0 - 30.0 * t5, 0, 255))
    )

    def along_nodes(channel: int) -> Column:
        out = F.when(v <= COLOR_NODES[0][0], float(COLOR_NODES[0][channel]))
        for lo, hi in zip(COLOR_NODES, COLOR_NODES[1:]):
            t = clamp((v - lo[0]) / (hi[0] - lo[0]), 0.0, 1.0)
            mixed = F.bround(lo[channel] + (hi[channel] - lo[channel]) * t)
            out = out.when((v > lo[0]) & (v <= hi[0]), mixed)
        out = out.otherwise(float(COLOR_NODES[-1][channel]))
        if desaturate is not None:
            w = min(1.0, max(0.0, desaturate))
            out = F.bround(out + (PALE[channel - 1] - out) * w)
        return clamp(out, 0.0, 255.0).cast("int")

    return df.select(
        "*",
        r.cast("int").alias("r"),
        g.cast("int").alias("g"),
        b.cast("int").alias("b"),
        along_nodes(1).alias("nr"),
        along_nodes(2).alias("ng"),
        along_nodes(3).alias("nb"),
    )


def rank_by_magnitude(df: DataFrame, ties: Sequence[Column] = ()) -> DataFrame:
    """Position of every star in magnitude order (exact, range-partitioned)."""
    order = [F.col("mag"), F.col("source_id"), *ties]
    return global_rank(df.where(F.col("mag").isNotNull()), order, "position")


def limit_positions(df: DataFrame, limits: Sequence[float]) -> DataFrame:
    """How many stars are at or above each limiting magnitude: one pass."""
    aggs = [F.count_if(F.col("mag") <= float(x)).alias(f"c{i}") for i, x in enumerate(limits)]
    wide = df.agg(*aggs)
    pairs = F.array(
        *[
            F.struct(F.lit(float(x)).alias("mag_limit"), F.col(f"c{i}").alias("star_count"))
            for i, x in enumerate(limits)
        ]
    )
    return wide.select(F.explode(pairs).alias("p")).select("p.mag_limit", "p.star_count")
