"""Base counts against plain Python; expectation-maximisation on drawn votes."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nightgrid.llm import rules
from nightgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
REPEAT = "a b c d e f g h "
TEXTS = [None, "", " \n\t", "word", "x y\nx y\n\n \nx y", REPEAT * 2, REPEAT + "z " + REPEAT, "one two " * 30, "é#*$ ÄB|<> 　 9%", "a b c d e f g\nh a b c d e f g h", "w" * 50000, "p q " * 5000]


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = {}
    for i in range(len(w) - 7):
        wins.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_counts_match_plain_python():
    for texts in (TEXTS, TEXTS[::-1], TEXTS[1:2], []):
        m = rules.measures(pa.array(texts, pa.string()))
        got = [tuple(int(m[c][i]) for c in rules.BASE) for i in range(len(texts))]
        assert got == [plain(t) for t in texts]


def test_op1_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_quality_rules"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, chars, sym, dup, rep = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_quality_rules"](spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.02


def test_em_recovers_drawn_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20000) < 0.7
    right = np.array([0.9, 0.85, 0.8, 0.75, 0.9])
    votes = np.where(rng.random((20000, 5)) < right, good[:, None] * 2, (1 - good[:, None]) * 2)
    votes[rng.random(votes.shape) < 0.1] = 1
    pattern, count = np.unique(votes @ 3 ** np.arange(4, -1, -1), return_counts=True)
    post, share, by_class = rules.expectation_maximisation(rules.votes_of(pattern, 5), count.astype(float))
    assert abs(share - 0.7) < 0.02
    assert np.abs(by_class[:, 1, 2] / (1 - by_class[:, 1, 1]) - right).max() < 0.03
    assert post[pattern == 242][0] > 0.99 and post[pattern == 0][0] < 0.01


def test_edge_tables(spark):
    docs = spark.createDataFrame([(i // 2, t, 1, "p") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_words int, pattern string")
    assert rules.judge(docs).count() == len(TEXTS) * 2
    assert rules.judge(docs.limit(0)).count() == 0 and rules.keep_good(docs.limit(0)).count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = rules.judge(docs).where("kept").count()
    assert kept.count() == want
