"""Readers on small written files."""

import json

import pytest

from nightgrid.operators import catalog as cat
from nightgrid.sources import stars as src


def test_star_tables_with_comments_bom_and_semicolons(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.ecsv"
    a.write_bytes("﻿RA_deg;Dec deg;G mag;id\n10.5;-3;4.2;7\nbad;1;2;8\n".encode())
    b.write_text("# %ECSV 1.0\n# comment\nra,dec,phot_g_mean_mag,bp_rp\n1,2,3,inf\n4,5,NaN,\n")
    df = cat.normalize_catalog(src.read_star_tables(spark, [str(a), str(b)]))
    rows = {(r.source_id, r.ra, r.dec, round(r.mag, 3), round(r.bp_rp, 3)) for r in df.collect()}
    assert rows == {(7, 10.5, -3.0, 4.2, 0.8), (None, 1.0, 2.0, 3.0, 2.5)}


def test_missing_required_column(spark):
    with pytest.raises(ValueError):
        cat.resolve_columns(spark.createDataFrame([(1.0, 2.0)], "ra double, dec double"))


def test_three_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": [{"name": "ra"}, {"name": "dec"}, {"name": "phot_g_mean_mag"}], "data": [[1, 2, 3], [4, 5]]}))
    (tmp_path / "b.json").write_text(json.dumps([{"ra": 7, "dec": 8, "phot_g_mean_mag": 9, "source_id": 11}]))
    (tmp_path / "c.json").write_text(json.dumps([[12, "x", 13, 14, 15]]))
    rows = {r.source_file: [] for r in src.read_star_json(spark, [str(tmp_path)]).select("source_file").collect()}
    for r in src.read_star_json(spark, [str(tmp_path)]).collect():
        rows[r.source_file].append((r.source_id, r.ra, r.dec, r.mag))
    assert sorted(rows["a.json"], key=str) == sorted([(None, "1", "2", "3"), (None, "4", "5", None)], key=str)
    assert rows["b.json"] == [("11", "7", "8", "9")]
    assert rows["c.json"] == [("12", "13", "14", "15")]


def test_mixed_headers_white_space_and_bad_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ra,dec,mag\n1,2,3\n")
    (tmp_path / "b.csv").write_text("mag,ra,dec\n1,2,3\n")
    (tmp_path / "c.ecsv").write_text("# %ECSV 1.0\n# ---\nra dec phot_g_mean_mag source_id\n10 20  5 77\n30 40 6 78\n")
    (tmp_path / "d.csv").write_text("x,y\n1,2\n")
    (tmp_path / "e.csv").write_text("# nothing\n")
    skipped = []
    rows = {(r.source_file, r.ra, r.dec, r.mag) for r in src.read_star_tables(spark, [str(tmp_path)], skipped).collect()}
    assert rows == {("a.csv", "1", "2", "3"), ("b.csv", "2", "3", "1"), ("c.ecsv", "10", "20", "5"), ("c.ecsv", "30", "40", "6")}
    assert len(skipped) == 1 and skipped[0][0].endswith("d.csv") and "ra" in skipped[0][1]
    with pytest.raises(ValueError):
        src.read_star_tables(spark, [str(tmp_path / "d.csv")])


def test_a_json_document_is_parsed_once_for_all_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"ra": 7, "dec": 8, "phot_g_mean_mag": 9, "source_id": 11}, {}, None]))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"ra": 1, "dec": 2, "mag": 3}]}))
    got = src.read_star_json(spark, [str(tmp_path)])
    assert sorted(map(str, got.select("ra", "dec", "source_file").collect())) == ["Row(ra='1', dec='2', source_file='b.json')", "Row(ra='7', dec='8', source_file='a.json')"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 4 and plan.count("Relation") == 1


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path):
    from nightgrid.sources import stars as src

    texts = {"a.csv": "# note\n\n#x\nra,dec,mag\n1,2,3\n", "b.csv": "ra;dec;mag\n" + "4;5;6\n" * 30_000, "c.csv": "# only\n", "d.csv": "mag,ra,dec\n7,8,9\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        seen = []
        plain = type(spark.range(1)).collect
        type(spark.range(1)).collect = lambda df: (seen.append(df), plain(df))[1]
        try:
            got = [(f.rsplit("/", 1)[1], v) for f, v in src._headers(spark, [str(tmp_path)])]
        finally:
            type(spark.range(1)).collect = plain
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a.csv", "ra,dec,mag"), ("b.csv", "ra;dec;mag"), ("d.csv", "mag,ra,dec")]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan or "MapInPandas" in plan
