"""Horizon profiles and light domes by bounds from a maximum pyramid of the raster.

A ray is cut into stretches no longer than a block of the pyramid.  The block
maximum bounds the elevation angle of all samples of a stretch, so a stretch
is taken apart (into stretches one level down, then into samples) only where
its bound can still beat what an exact sample has shown.  The result is that
of sampling every step.

A ray stays in one partition from the first level to the result: with the
pyramid and the raster broadcast (their counted size allows it) nothing but
the rays is exchanged.  A row carries the number of its stretch; parts and
steps are looked up by it.  Observers at one place see one horizon, so a job
may cast the rays of `shared_places` and hand its result to all their members.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.angles import cos_d, dbl, sin_d
from nightgrid.functions.scale import first_per_key, sized_join, spread, staged
from nightgrid.operators.radiance import radiance_at
from nightgrid.operators.terrain import EARTH_RADIUS, Grid, band_table, cell_stencils, sample_elevation, step_table

LEVELS = (8, 1)  # cells of a block side, coarse first
SLACK = 1e-9  # rounding of bounds and probes
RAY = ["obs_id", "az_idx"]


def max_pyramid(cells: DataFrame, blocks: Sequence[int] = LEVELS) -> dict[int, DataFrame]:
    """(r, c, top) per level: the greatest height that a box of one block's size, starting in block (r, c), can meet.

    Such a box reaches into the next block, and interpolation into one cell more.
    """
    out = {}
    for b in blocks:

        def hosts(x: str) -> Column:
            return F.explode(F.sequence(F.ceil(F.col(x) / b).cast("int") - 2, F.floor(F.col(x) / b).cast("int")))

        put = cells.select("c", "h", hosts("r").alias("br")).select("br", "h", hosts("c").alias("bc"))
        out[b] = put.groupBy(F.col("br").alias("r"), F.col("bc").alias("c")).agg(F.max("h").alias("top"))
    return out


def cut_steps(steps: Sequence[tuple], split, lengths: Sequence[float]) -> list[dict]:
    """Nested stretches of consecutive steps with one `split` value: at most lengths[0] long, their parts lengths[1], and so on."""
    out: list[dict] = []
    for step in steps:
        key = split(step)
        if out and out[-1]["key"] == key and step[1] - out[-1]["steps"][0][1] <= lengths[0]:
            out[-1]["steps"].append(step)
        else:
            out.append({"key": key, "steps": [step]})
    for s in out:
        s["d0"], s["d1"] = s["steps"][0][1], s["steps"][-1][1]
        s["parts"] = cut_steps(s["steps"], lambda _, own=s["key"]: own, lengths[1:]) if len(lengths) > 1 else []
    return out


class Cut:
    """Nested stretches as literals: `top`, the parts of each stretch by its number `at`, and the steps of each of the last level."""

    def __init__(self, stretches: list[dict], deep: int):
        levels = [stretches]
        for _ in range(deep - 1):
            levels.append([p for s in levels[-1] for p in s["parts"]])
        for level in levels:
            for i, s in enumerate(level):
                s["at"] = i
        self.top = F.array(*[F.struct(F.lit(s["key"]).cast("int").alias("band"), *self._ends(s)) for s in stretches])
        self.parts = [F.array(*[F.array(*[F.struct(*self._ends(p)) for p in s["parts"]]) for s in level]) for level in levels[:-1]]
        self.steps = F.array(*[F.array(*[F.lit(float(d)) for _, d, *_ in s["steps"]]) for s in levels[-1]])

    @staticmethod
    def _ends(s: dict) -> list[Column]:
        return [F.lit(s["at"]).alias("at"), F.lit(float(s["d0"])).alias("d0"), F.lit(float(s["d1"])).alias("d1")]


def shared_places(observers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One observer per place (the smallest `obs_id`), and `member, obs_id`: the observer that stands for each."""
    at = F.array(*[dbl(c) for c in ("x", "y", "ground") if c in observers.columns])
    keyed = observers.withColumn("_at", at)
    places = first_per_key(keyed, ["_at"], [F.col("obs_id")])
    members = sized_join(keyed.select(F.col("obs_id").alias("member"), "_at"), places.select("_at", "obs_id"), ["_at"])
    return places.drop("_at"), members.select("member", "obs_id").distinct()


def for_members(result: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of each place for every observer there, in the columns of `result`."""
    hit = sized_join(result, members, ["obs_id"])
    return hit.drop("obs_id").withColumnRenamed("member", "obs_id").select(*result.columns)


@dataclass
class Rays:
    """Observers, raster and ray parameters of one job; `missing` is the height outside the raster."""

    observers: DataFrame
    cells: DataFrame
    grid: Grid
    n_bands: int = 20
    max_dist: float = 150_000.0
    step_m: float = 50.0
    az_step: float = 0.5
    eye: float = 1.7
    border: str = "clamp"
    missing: float = 0.0
    levels: tuple[int, ...] = LEVELS

    def __post_init__(self):
        self.stencils = cell_stencils(self.cells)
        self.pyramid = max_pyramid(self.cells, self.levels)
        self.steps = step_table(self.step_m, self.max_dist, band_table(self.n_bands, self.max_dist))

    def rays(self) -> DataFrame:
        """A row per observer and azimuth, dealt by ray: everything after keeps that partitioning."""
        obs = self.observers
        if "ground" not in obs.columns:
            obs = sample_elevation(obs, self.stencils, self.grid, self.border).withColumnRenamed("h", "ground")
        obs = spread(obs, "obs_id").select("obs_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.coalesce("ground", F.lit(0.0)) + self.eye).alias("eye_h"))
        n_az = int(round(360.0 / self.az_step))
        rays = obs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_az - 1))).alias("az_idx")).repartition(*RAY)
        return staged(rays, _sin=sin_d(F.col("az_idx") * self.az_step), _cos=cos_d(F.col("az_idx") * self.az_step))

    def bounded(self, stretches: DataFrame, block: int) -> DataFrame:
        """Adds `bound`: no sample of the stretch has a greater slope."""

        def key(at: str, along: str, origin: float) -> Column:
            near = F.col(at) + F.least(F.col("d0") * F.col(along), F.col("d1") * F.col(along))
            return F.floor((near - origin) / (self.grid.cell * block)).cast("int")

        hit = stretches.withColumn("r", key("y0", "_cos", self.grid.y0)).withColumn("c", key("x0", "_sin", self.grid.x0))
        hit = sized_join(hit, self.pyramid[block], ["r", "c"], "left")
        hit = hit.withColumn("_over", F.greatest(F.coalesce("top", F.lit(self.missing)), F.lit(self.missing)) - F.col("eye_h"))
        # over / d - d / 2R is greatest at the near end, or below the eye where the two terms are equal
        equal = F.least(F.col("d1"), F.greatest(F.col("d0"), F.sqrt(-F.col("_over") * (2.0 * EARTH_RADIUS))))
        hit = hit.withColumn("_at", F.when(F.col("_over") >= 0, F.col("d0")).otherwise(equal))
        slope = F.col("_over") / F.col("_at") - F.col("_at") / (2.0 * EARTH_RADIUS)
        return hit.withColumn("bound", slope + SLACK).drop("r", "c", "top", "_over", "_at")

    def sampled(self, points: DataFrame) -> DataFrame:
        """Adds position, height and rise at `dist`."""
        pts = points.withColumn("x", F.col("x0") + F.col("dist") * F.col("_sin")).withColumn("y", F.col("y0") + F.col("dist") * F.col("_cos"))
        hit = sample_elevation(pts, self.stencils, self.grid, self.border).withColumn("h", F.coalesce("h", F.lit(self.missing)))
        return hit.withColumn("rise", F.col("h") - F.col("dist") * F.col("dist") / (2.0 * EARTH_RADIUS) - F.col("eye_h"))

    def cut(self, split) -> Cut:
        steps = [s for s in self.steps if split(s) is not None]
        return Cut(cut_steps(steps, split, [self.grid.cell * b for b in self.levels]), len(self.levels))

    def stretches(self, split) -> DataFrame:
        return self.started(self.cut(split))

    def started(self, cut: Cut) -> DataFrame:
        """The stretches of the first level of every ray, with their bounds."""
        return self.bounded(self.rays().select("*", F.inline(cut.top)), self.levels[0])

    def parts(self, stretches: DataFrame, cut: Cut, level: int) -> DataFrame:
        """The stretches one level down, with their own bounds."""
        keep = [c for c in stretches.columns if c not in ("at", "d0", "d1", "bound")]
        return self.bounded(stretches.select(*keep, F.inline(F.get(cut.parts[level - 1], F.col("at")))), self.levels[level])

    def all_samples(self, stretches: DataFrame, cut: Cut) -> DataFrame:
        """Every step of the stretches, with its angle."""
        pts = stretches.drop("d0", "d1", "bound").withColumn("dist", F.explode(F.get(cut.steps, F.col("at")))).drop("at")
        return staged(self.sampled(pts), angle=F.atan2(F.col("rise"), F.col("dist")))

    def promising(self, stretches: DataFrame) -> DataFrame:
        """The stretches that can beat the first samples of all stretches of their band."""
        probes = self.sampled(stretches.withColumn("dist", F.col("d0")))
        probes = probes.withColumn("_slope", F.col("rise") / F.col("dist")).drop("x", "y", "h", "rise", "dist")
        shown = F.max("_slope").over(Window.partitionBy(*RAY, "band")) - SLACK
        return probes.withColumn("_shown", shown).where(F.col("bound") >= F.col("_shown")).drop("_slope", "_shown")


def profile_samples(job: Rays) -> DataFrame:
    """The samples that can be the best of their band."""
    cut = job.cut(lambda s: s[2])
    live = job.promising(job.started(cut))
    for level in range(1, len(job.levels)):
        live = job.promising(job.parts(live, cut, level))
    return job.all_samples(live, cut)


def horizon_profile(job: Rays) -> DataFrame:
    """Best angle, its distance and height per observer, azimuth and band, as over all samples."""
    first = F.struct(-F.col("angle"), F.col("dist"))
    best = profile_samples(job).groupBy(*RAY, "band").agg(F.max("angle").alias("angle"), F.min_by(F.struct("dist", "h"), first).alias("p"))
    return best.select(*RAY, "band", "angle", "p.dist", F.col("p.h").alias("height"))


def light_samples(job: Rays) -> DataFrame:
    """Flagged light samples: (obs_id, az_idx, sid, dist, x, y, angle); `sid` is the stretch that each one ends."""
    dists, sid = [], 0
    for _, d, _, light in job.steps:
        if light:
            dists.append((sid, d))
            sid += 1
    spots = F.array(*[F.struct(F.lit(i).alias("sid"), F.lit(float(d)).alias("dist")) for i, d in dists])
    lit = job.sampled(job.rays().select("*", F.inline(spots)))
    return staged(lit, angle=F.atan2(F.col("rise"), F.col("dist"))).select(*RAY, "sid", "dist", "x", "y", "angle")


def blocking_samples(job: Rays, lit: DataFrame, tolerance: float) -> DataFrame:
    """Samples that can hide a light of their ray: `sid` is the first light at or behind them."""
    number, sid = {}, 0
    for i, _, _, light in job.steps:
        number[i] = sid
        sid += light
    lowest = F.min("angle") + tolerance  # nothing rises to a right angle
    floor = lit.groupBy(*RAY).agg(F.when(lowest < 1.5707, F.tan(lowest) - SLACK).otherwise(float("inf")).alias("_floor"))
    cut = job.cut(lambda s: number[s[0]] if number[s[0]] < sid else None)
    live = job.started(cut).withColumnRenamed("band", "sid").join(floor, RAY).where(F.col("bound") >= F.col("_floor"))
    for level in range(1, len(job.levels)):
        live = job.parts(live, cut, level).where(F.col("bound") >= F.col("_floor"))
    return job.all_samples(live, cut)


def light_domes(job: Rays, radiance: DataFrame, x0: float = 0.0, y0: float = 0.0, cell: float = 1000.0, tolerance: float = 0.17) -> DataFrame:
    """Light gathered per observer and azimuth, and the strongest source, as over all samples.

    A light counts unless something before it rises `tolerance` above it; only
    stretches that could do so for some light of the ray are taken apart.
    """
    lit = radiance_at(light_samples(job), radiance, x0, y0, cell).where("radiance > 0.1")
    top = blocking_samples(job, lit, tolerance).groupBy(*RAY, "sid").agg(F.max("angle").alias("top"))
    both = lit.select(*RAY, "sid", "dist", "angle", "radiance", F.col("angle").alias("top")).unionByName(top, allowMissingColumns=True)
    upto = Window.partitionBy(*RAY).orderBy("sid").rangeBetween(Window.unboundedPreceding, 0)  # a ray's light steps at most twice
    seen = both.withColumn("_top", F.max("top").over(upto)).where(F.col("radiance").isNotNull() & (F.col("angle") > F.col("_top") - tolerance))
    gain = F.col("radiance") * 20.0 / F.greatest(F.lit(1.0), F.col("dist") / 1000.0)
    return seen.groupBy(*RAY).agg(F.sum(gain).alias("dome"), F.min_by("dist", F.struct(-F.col("radiance"), F.col("dist"))).alias("peak_dist"))
