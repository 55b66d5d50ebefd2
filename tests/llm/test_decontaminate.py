"""Benchmark windows against a plain search."""

import hashlib
import re

from nightgrid.llm import decontaminate as dc
from nightgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, bench):
    out = []
    for d, t in docs:
        w = words(t)
        hit, items = [False] * len(w), set()
        text = " " + " ".join(w) + " "
        for i, b in bench:
            v = words(b)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                win = v[k : k + n]
                if " " + " ".join(win) + " " not in text:
                    continue
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == win:
                        hit[at : at + n] = [True] * n
                        items.add("" if i is None else str(i))
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), sum(hit), len(items), sha, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


def tuples(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


BENCH = [(1, "Alpha beta, gamma"), (2, "one"), (3, None), (4, ""), (None, "é é é"), (10, " ".join(f"w{i}" for i in range(20))), (11, " ".join(f"w{i}" for i in range(5, 20)))]
DOCS = [(1, None), (2, ""), (3, "ALPHA-beta gamma x"), (3, "ALPHA-beta gamma x"), (None, "one " * 50), (5, "é É é é é é"), (6, "x " * 400 + " ".join(f"w{i}" for i in range(20))), (7, " ".join(f"w{i}" for i in range(12))), (8, "... !!"), (9, "z" * 20000)]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in DOCS], "doc_id long, text string, hit string, n_words int")
    return docs, spark.createDataFrame(BENCH, "item_id long, text string")


def test_edges_and_split_benchmarks(spark):
    docs, bench = frames(spark)
    assert tuples(dc.contamination(docs, bench)) == plain(DOCS, BENCH)
    assert tuples(dc.contamination(docs, bench, max_words=3)) == plain(DOCS, BENCH)
    assert tuples(dc.contamination(docs, bench.limit(0))) == plain(DOCS, [])
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_removal_keeps_other_rows_and_columns(spark):
    docs, bench = frames(spark)
    for limit in (3, 1000):
        kept = dc.decontaminate(docs, bench, max_words=limit)
        assert kept.columns == docs.columns
        dirty = {r[0] for r in plain(DOCS, BENCH) if r[5]}
        assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(d) for d, _ in DOCS if d not in dirty)
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[3] == " x" and cut[1] is None and cut[7] == DOCS[7][1] and set(cut) == {d for d, _ in DOCS}


def test_op7_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert tuples(QUERIES["op7_decontamination"](spark, SF).drop("spans")) == plain(docs, bench)
