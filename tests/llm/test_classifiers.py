"""Toxicity and quality models on held-out rows and small tables."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightgrid.llm import quality, toxicity
from nightgrid.llm.ngrams import byte_grams, outline_grams
from nightgrid.llm.queries import QUERIES
from nightgrid.llm.text import slices

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def held_out_scores(spark, name, label):
    df = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    pdf = df.select("held_out", "score", "predicted", F.col(label).alias("y")).toPandas()
    return pdf[pdf.held_out]


def test_op2_separates_held_out_rows(spark):
    t = held_out_scores(spark, "op2_toxicity", "toxic")
    caught, clean = t[t.y == 1].predicted.mean(), 1 - t[t.y == 0].predicted.mean()
    assert caught > 0.9 and clean > 0.99, (caught, clean)


def test_op3_separates_held_out_rows(spark):
    t = held_out_scores(spark, "op3_quality_classifier", "quality")
    assert (t.predicted == t.y).mean() > 0.98


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_quality_classifier"])
def test_query_returns_every_document(spark, name):
    got = QUERIES[name](spark, SMALL)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == 200 and got.where("score < 0 or score > 1 or score is null").count() == 0


def test_byte_grams_match_a_plain_loop():
    texts = ["Ab cd,\tEF", "", None, "x", "é a  b "]
    keys, rows = byte_grams(5, pa.array(texts))
    want = []
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").replace("A", "a").replace("E", "e").replace("F", "f"))
        b = (" " + " ".join(w) + " ").encode() if w else b""
        want += [(i, int.from_bytes(b[k : k + 5], "big")) for k in range(len(b) - 4)]
    assert list(zip(rows.tolist(), keys.tolist())) == want


def test_slices_read_like_whole_batches():
    texts = pa.array([f"Word{i} ÄB c{i % 7} " * (i % 40) for i in range(900)] + [None])
    for extract in (lambda t: byte_grams(5, t), lambda t: outline_grams(3, t)):
        keys, rows = extract(texts)
        at, n = [], 0
        for part in slices([pa.record_batch({"text": texts})], max_bytes=20_000):
            k, r = extract(part.column(0))
            at.append((k, r + n))
            n += part.num_rows
        assert n == 901 and len(at) > 5
        assert sorted(zip(np.concatenate([a[1] for a in at]).tolist(), np.concatenate([a[0] for a in at]).tolist())) == sorted(zip(rows.tolist(), keys.tolist()))


def test_outline_grams_see_shape_and_repeats():
    def grams(t):
        return set(outline_grams(3, pa.array([t]))[0].tolist())

    assert grams("Abc$$$ xy") & grams("Qrs$$$ uv")
    plain, repeated = grams("ab cd ef gh"), grams("ab ab ab ab")
    assert len(repeated - plain) > 1 and not grams("") and not grams(" \n")


def toy(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_swapping_lowers_false_positives(spark):
    """Group names that come with insults in training stay neutral under the penalty."""
    rng = np.random.default_rng(0)
    filler = "river stone music garden window paper engine winter market bridge".split()

    def sentence(*extra):
        return " ".join([*rng.choice(filler, 6).tolist(), *extra])

    rows = [(sentence("muslims", "zorgs"), 1) for _ in range(60)] + [(sentence("zorgs"), 1) for _ in range(30)] + [(sentence(), 0) for _ in range(150)] + [(sentence("christians"), 0) for _ in range(30)]
    docs, labels = toy(spark, rows)
    probe = spark.createDataFrame([(0, "winter garden muslims bridge"), (1, "winter garden zorgs bridge"), (2, None), (3, ""), (None, "x" * 9000)], "doc_id long, text string")
    scores = {}
    for swap in (0.0, 5.0):
        model = toxicity.fit_toxicity(docs, labels, F.lit(True), swap=swap)
        scores[swap] = {r.doc_id: r.score for r in toxicity.score_toxicity(probe, model).collect()}
    assert scores[5.0][0] < 0.5 * scores[0.0][0] and scores[5.0][0] < 0.3
    assert scores[5.0][1] > 0.5 and scores[5.0][2] == scores[5.0][3] < 0.5


def test_swapped_texts():
    got = toxicity.swapped(pa.array(["Women and blind mice", "none", None])).to_pylist()
    assert got == ["men and disabled mice", "", ""]


def test_edges(spark):
    rows = [(None, 1), ("", 0), ("good words here", 1), ("good words here", None), ("*** %%% $$$", 0), ("w " * 30000, 1)]
    docs, labels = toy(spark, rows)
    twice = docs.unionByName(docs)
    for fit, score in ((toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)):
        model = fit(twice, labels.unionByName(labels), F.lit(True))
        assert score(twice, model).count() == 12
        assert score(docs.limit(0), model).count() == 0
        for sub in (labels.limit(0), labels.where("toxic = 1")):
            flat = fit(docs, sub, F.lit(True))
            assert score(docs, flat).select("score").distinct().count() == 1
    kept = quality.keep_quality(docs, quality.fit_quality(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns


def test_dual_coordinate_descent_is_optimal():
    """The primal value is within a hundredth of the dual one."""
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    y = np.array([int((v < 12).sum() > 2) for v in x])
    w, b = quality.dual_coordinate_descent(y, x, np.ones(30), cost=0.5, epochs=400)
    sign = np.where(y == 1, 1, -1)
    loss = np.maximum(0, 1 - sign * (np.array([w[v].sum() for v in x]) + b)).sum()
    best = 0.5 * (w @ w + b * b) + 0.5 * loss
    for _ in range(200):
        d, e = rng.normal(0, 0.05, 30), rng.normal(0, 0.05)
        alt = 0.5 * ((w + d) @ (w + d) + (b + e) ** 2) + 0.5 * np.maximum(0, 1 - sign * (np.array([(w + d)[v].sum() for v in x]) + b + e)).sum()
        assert alt > best - 1e-2
