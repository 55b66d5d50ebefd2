"""Nearest objects with reaches from minutes to half the sky against a plain search."""

import math
import random

from pyspark.sql import functions as F

from nightgrid.operators import search


def separation(a, b, c, d):
    a, b, c, d = (math.radians(v) for v in (a, b, c, d))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))


def test_any_reach_at_any_place(spark):
    rnd = random.Random(2)
    spot = lambda: (rnd.uniform(0, 360), rnd.choice([rnd.uniform(-90, 90), 89.9, -89.95, 90.0]))
    objects = [(i, *spot(), rnd.choice([None, 0.2, 1.4, 3.0, 20.0, 80.0, 170.0, 200.0])) for i in range(120)]
    targets = [(i, *spot()) for i in range(80)]
    cat = spark.createDataFrame(objects, "object_id long, ra double, dec double, own_radius double")
    got = search.nearest_objects(spark.createDataFrame(targets, "target_id long, t_ra double, t_dec double"), cat, radius=1.0)
    want = {}
    for t, ra, dec in targets:
        found = []
        for o, x, y, own in objects:
            reach, far = max(1.0, (own or 0.0) + 0.05), separation(ra, dec, x, y)
            if far <= reach:
                found.append((math.floor(far / reach * 1e9 + 0.5), o))
        if found:
            want[t] = min(found)[1]
    assert {r.target_id: r.object_id for r in got.collect()} == want
    wide = search.wide_cells(cat.select("object_id", "ra", "dec", (F.coalesce("own_radius", F.lit(0.0)) + 0.05).alias("reach")))
    assert wide.groupBy("object_id").count().agg(F.max("count")).first()[0] <= 8


def met(monkeypatch, make):
    """Rows of the smaller sides that `make` joins by tile or cell, in all."""
    rows, plain = [], search.sized_join

    def counted(big, small, on, *rest):
        if set(on) & {"tile", "level"}:
            rows.append(small.count())
        return plain(big, small, on, *rest)

    monkeypatch.setattr(search, "sized_join", counted)
    return make(), sum(rows)


def test_targets_at_one_place_are_met_once(spark, monkeypatch):
    cat = spark.createDataFrame([(1, 10.2, 5.0, None), (2, 10.1, 5.0, None), (3, 14.0, 5.0, 4.5)], "object_id long, ra double, dec double, own_radius double")
    one, many = (spark.createDataFrame([(i, 10.0, 5.0) for i in range(n)] + [(999, 200.0, 0.0)], "target_id long, t_ra double, t_dec double") for n in (1, 300))
    _, few = met(monkeypatch, lambda: search.nearest_objects(one, cat, 1.5))
    got, all_rows = met(monkeypatch, lambda: search.nearest_objects(many, cat, 1.5))
    assert all_rows == few
    assert sorted((r.target_id, r.object_id) for r in got.collect()) == [(i, 2) for i in range(300)]


def test_equal_fields_are_met_once(spark, monkeypatch):
    sky = spark.createDataFrame([(i, 4.0 + i % 3, 20.0 + i * 0.01, 30.0 + i * 0.02) for i in range(50)], "source_id long, mag double, alt double, az double")
    row = (20.2, 30.4, 1.0, 0.8)
    kinds = "field_id long, center_alt double, center_az double, fov_w double, fov_h double, shape string, mag_limit double"
    one, many = (spark.createDataFrame([(i, *row, s, 5.0) for i in range(n) for s in (["circle"] if i % 2 else ["rectangle"])], kinds) for n in (2, 200))
    _, few = met(monkeypatch, lambda: search.fov_search(sky, one))
    got, all_rows = met(monkeypatch, lambda: search.fov_search(sky, many))
    assert all_rows == few and got.columns[-1] == "field_id"
    pairs = {}
    for r in got.collect():
        pairs.setdefault(r.field_id, set()).add(r.source_id)
    assert len(pairs) == 200 and all(pairs[i] == pairs[i % 2] for i in pairs)
    counts, all_rows = met(monkeypatch, lambda: search.field_counts(sky, many, 16))
    rows = {r.field_id: (r.in_view, r.after_mag_cut) for r in counts.collect()}
    assert all_rows == few and len(rows) == 200
    assert all(rows[i] == (len(pairs[i]), sum(4 + s % 3 <= 5 for s in pairs[i])) for i in rows)
