"""Terrain queries against brute force: 720 azimuths, 20 bands, steps of 50 m, 150 km, two observers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nightgrid.operators import horizon, terrain
from nightgrid.plans import terrain_queries as plans

ROWS, COLS, N = 100, 50, 720


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("terrain"))
    spark.createDataFrame([(1, 3), (2, 4)], "s_suppkey long, s_nationkey long").write.parquet(f"{sf}/supplier.parquet")
    # a ridge 60 km north, a single peak between the rays of 15 degrees
    part = [(k, 300 if k // COLS == 71 else 250 if (k // COLS, k % COLS) == (15, 8) else k * 7 % 11) for k in range(ROWS * COLS)]
    spark.createDataFrame(part, "p_partkey long, p_size long").write.parquet(f"{sf}/part.parquet")
    orders = [(r * 100 + c, "1-URGENT", "O", 1e4 * (1 + (r * 37 + c * 11) % 23)) for r in range(ROWS) for c in range(COLS)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{sf}/orders.parquet")
    h = np.zeros((ROWS, COLS))
    for k, size in part:
        h[k // COLS, k % COLS] = 200 + size * 20
    v = np.array([o[3] / 1e4 for o in orders]).reshape(ROWS, COLS)
    profile, domes = {}, {}
    for obs, x0, y0 in ((1, 7250.0, 11125.0), (2, 14250.0, 22125.0)):
        cast(h, v, obs, x0, y0, profile, domes)
    return sf, profile, domes


def height(h, x, y):
    gx, gy = x / 1000, y / 1000
    ok = (gx >= 0) & (gy >= 0) & (gx < COLS - 1) & (gy < ROWS - 1)
    c, r = np.clip(np.floor(gx), 0, COLS - 2).astype(int), np.clip(np.floor(gy), 0, ROWS - 2).astype(int)
    low, top = h[r, c] * (1 - gx + c) + h[r, c + 1] * (gx - c), h[r + 1, c] * (1 - gx + c) + h[r + 1, c + 1] * (gx - c)
    return np.where(ok, low * (1 - gy + r) + top * (gy - r), 0.0)


def cast(h, v, obs, x0, y0, profile, domes):
    d = [0.5]
    while (far := min(d[-1] * 1.5, 50) if d[-1] < 50 else d[-1] + 50 * (1 if d[-1] < 3e3 else 2 if d[-1] < 15e3 else 4)) < 150e3:
        d.append(far)
    light, last = [], 0.0
    for q in d:
        light.append(q - last >= 2000)
        last = q if light[-1] else last
    cuts = [math.exp(math.log(5000) * i / 13) for i in range(1, 13)] + [5000 * 30 ** (i / 7) for i in range(7)]
    d, light = np.array(d), np.array(light)
    band = np.searchsorted(cuts, d, "right")
    eye = float(height(h, np.array(x0), np.array(y0))) + 1.7
    for i in range(N):
        az = math.radians(i * 0.5)
        x, y = x0 + d * math.sin(az), y0 + d * math.cos(az)
        up = height(h, x, y)
        ang = np.arctan2(up - d * d / (2 * 6371000.0) - eye, d)
        for b in range(20):
            at = np.flatnonzero(band == b)
            if len(at):
                k = at[np.argmax(ang[at])]
                profile[obs, i, b] = ang[k], d[k], up[k]
        r, c = np.floor(y / 1000).astype(int), np.floor(x / 1000).astype(int)
        inside = (r >= 0) & (c >= 0) & (r < ROWS) & (c < COLS)
        lit = np.flatnonzero(light & inside & (ang > np.maximum.accumulate(ang) - 0.17))
        if len(lit):
            shine = v[r[lit], c[lit]]
            domes[obs, i] = (shine * 20 / np.maximum(1, d[lit] / 1000)).sum(), d[lit][np.argmax(shine)]


def peak_rows(domes):
    out = []
    for obs in (1, 2):
        at = [domes.get((obs, i % N), (0.0, None))[0] for i in range(2 * N)]
        for i in range(N):
            if (obs, i) in domes:
                dome, dist = domes[obs, i]
                row = (obs, i, i * 0.5, dome, dist, math.log10(1 + dome) * math.exp(-dist / 35000))
                if at[i] >= 0.2 and at[i] >= at[i + N - 1] and at[i] > at[i + 1]:
                    out.append((*row, "neighbour"))
                if at[i] > 10 and at[i] >= max(at[(i + k) % N] for k in range(-20, 21) if k):
                    out.append((*row, "window"))
    return out


def close(got, want):
    """Same keys (strings and integers) and nearly the same floats."""
    split = lambda rows: sorted((tuple(x for x in r if not isinstance(x, float)), tuple(x for x in r if isinstance(x, float))) for r in rows)
    got, want = split(got), split(want)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([x for g in got for x in g[1]], [x for w in want for x in w[1]], rtol=1e-9, atol=2e-6)


def run(spark, name, sf):
    return [tuple(r) for r in entry.queries()[name](spark, sf).collect()]


@pytest.mark.parametrize("name", ["horizon_profile", "profile_store"])
def test_profiles(spark, made, name):
    sf, profile, _ = made
    rows = entry.queries()[name](spark, sf).select("obs_id", "az_idx", "band", "angle", "dist", "height").collect()
    close(map(tuple, rows), [(*k, *map(float, v)) for k, v in profile.items()])
    assert max(v[0] for (o, _, b), v in profile.items() if o == 1 and b == 18) > 0.05  # the ridge past 40 km


def test_horizon_summary(spark, made):
    sf, profile, _ = made
    want = []
    for obs in (1, 2):
        line = np.degrees([max(profile[obs, i, b][0] for b in range(20) if (obs, i, b) in profile) for i in range(N)])
        want.append((obs, *map(float, (line.max(), line.mean(), line[0], line[180], line[360], line[540]))))
    close(run(spark, "horizon_summary", sf), want)


def test_band_points(spark, made):
    sf, profile, _ = made
    want = []
    for (obs, i, b), (angle, _, _) in profile.items():
        deg = float(np.degrees(angle))
        up = -20.0 if deg < -80 else deg * 1.5
        want += [(obs, b, i, i * 0.5, deg, up)] + [(obs, b, N, 360.0, deg, up)] * (i == 0)
    rows = entry.queries()["band_points"](spark, sf).select("obs_id", "band", "az_idx", "az", "elev", "height").collect()
    close(map(tuple, rows), want)


def test_domes_and_peaks(spark, made):
    sf, _, domes = made
    rows = entry.queries()["light_domes"](spark, sf).select("obs_id", "az_idx", "dome", "peak_dist").collect()
    close(map(tuple, rows), [(*k, *map(float, v)) for k, v in domes.items()])
    close(run(spark, "dome_peaks", sf), [tuple(map(lambda x: float(x) if isinstance(x, np.floating) else x, r)) for r in peak_rows(domes)])


def test_cluster_peaks(spark, made):
    sf, _, domes = made
    want = []
    for obs in (1, 2):
        kept = []
        mine = [r for r in peak_rows(domes) if r[0] == obs and r[6] == "neighbour"]
        for r in sorted(mine, key=lambda r: (-round(r[3], 9), r[1])):
            if all(abs((r[2] - k[2] + 180) % 360 - 180) >= 15 for k in kept):
                kept.append(r)
        want += [(obs, r[1], k + 1) for k, r in enumerate(sorted(kept, key=lambda r: (-r[4], r[1])))]
    rows = entry.queries()["cluster_peaks"](spark, sf).select("obs_id", "az_idx", "draw_order").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_pruned_rays_equal_full_sampling_with_fewer_samples(spark, made):
    sf, _, _ = made
    job = plans.rays(spark, sf)
    full = terrain.ray_samples(plans.posts(spark, sf), job.stencils, job.grid, border="null").cache()
    sampled, kept = full.count(), horizon.profile_samples(job).count()
    stretches = job.stretches(lambda s: s[2]).count()
    print(f"{sampled} samples in all, {kept} taken, {stretches} stretches")
    assert 3 * kept < sampled
    rounded = lambda df, *keys: {tuple(r[k] for k in keys): tuple(r) for r in df.collect()}
    assert rounded(horizon.horizon_profile(job), "obs_id", "az_idx", "band") == rounded(terrain.horizon_profile(full), "obs_id", "az_idx", "band")
    light = horizon.light_samples(job)
    lit = plans.view(spark, sf, "radiance_cells")
    dome = {(r.obs_id, r.az_idx): (round(r.dome, 9), r.peak_dist) for r in horizon.light_domes(job, lit).collect()}
    assert dome == {(r.obs_id, r.az_idx): (round(r.dome, 9), r.peak_dist) for r in terrain.light_domes(full, lit).collect()}
    blockers = horizon.blocking_samples(job, light.withColumn("radiance", F.lit(1.0)), 0.17)
    assert 5 * blockers.count() < sampled
    full.unpersist()


def test_coarse_and_fine_levels_agree(spark, made):
    sf, _, _ = made
    post = plans.posts(spark, sf).where("obs_id = 1")
    job = plans.rays(spark, sf)
    jobs = [horizon.Rays(post, job.cells, job.grid, az_step=10.0, border=b, levels=lv) for b, lv in (("null", (1,)), ("null", (16, 2)), ("clamp", (8, 1)))]
    got = [sorted(tuple(r) for r in horizon.horizon_profile(j).collect()) for j in jobs]
    full = [
        sorted(tuple(r) for r in terrain.horizon_profile(terrain.ray_samples(post, job.stencils, job.grid, az_step=10.0, border=b)).collect())
        for b in ("null", "null", "clamp")
    ]
    assert got == full


def test_observers_of_one_place_share_its_rays(spark, made):
    sf, _, _ = made
    post = plans.posts(spark, sf)
    more = post.unionByName(post.withColumn("obs_id", F.col("obs_id") + 10)).unionByName(post.withColumn("obs_id", F.col("obs_id") + 20).withColumn("x", F.lit(None).cast("double")))
    places, members = horizon.shared_places(more)
    assert sorted(r.obs_id for r in places.collect()) == [1, 2, 21, 22]
    job = plans.rays(spark, sf, places)
    job.az_step = 30.0
    got = horizon.for_members(horizon.horizon_profile(job), members)
    plain = plans.rays(spark, sf, more)
    plain.az_step = 30.0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, horizon.horizon_profile(plain).collect()))
