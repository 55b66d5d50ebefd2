"""Repeated passages against a dictionary of all strings of 100 bytes."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from nightgrid.llm import repeats
from nightgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SIZE = repeats.SIZE


def plain(rows):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        keep = np.ones(len(data), bool)
        for i in range(len(data) - SIZE + 1):
            s = data[i : i + SIZE]
            if s in seen:
                keep[i : i + SIZE] = False
            seen.add(s)
        edge = np.diff(np.concatenate([[True], keep, [True]]).astype(int))
        kept = bytes(np.frombuffer(data, np.uint8)[keep])
        out.append((d, len(data), int((~keep).sum()), int((edge < 0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_repeats(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghé", k=rnd.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(14, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            lo = rnd.randint(0, len(p) // 2)
            parts.insert(rnd.randint(0, len(parts)), p[lo : rnd.randint(lo, len(p))])
        rows.append((i * 3 - 50, " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "short"), (1003, "z" * 3000), (1004, "y" + "z" * 900), (1005, "ab" * 700), (1006, "x" * 100), (1007, "x" * 99)]
    rows += [(1008 + k, rows[5][1]) for k in range(4)] + [(None, rows[7][1] + " tail")]
    line = "a line of sixty bytes that stands in very many texts ......."
    rows += [(2000 + k, " ".join(word() for _ in range(20)) + line + " ".join(word() for _ in range(20))) for k in range(30)]
    return rows


def cut(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, block int, row string").repartition(5)
    return sorted((tuple(r) for r in repeats.cut_repeats(docs, **how).drop("kept").collect()), key=str)


def test_matches_all_strings(spark, monkeypatch):
    rows = rows_with_repeats(1)
    assert cut(spark, rows, block_bytes=3000) == plain(rows)
    assert cut(spark, rows, hot=6, block_bytes=2000) == plain(rows)
    monkeypatch.setattr(repeats, "BUCKET_CHARS", 2000)
    monkeypatch.setattr(repeats, "STARTS", 257)
    monkeypatch.setattr(repeats, "RUN", 100)
    assert cut(spark, rows) == plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats.cut_repeats(docs.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in repeats.cut_repeats(docs).collect()}
    assert kept[1002] == b"short" and kept[1001] == b""


def test_rows_that_repeat_an_id_are_documents(spark):
    text = "".join(random.Random(4).choices("abcdefgh ", k=150))
    got = cut(spark, [(1, text), (1, text), (1, text)])
    assert sorted(r[2] for r in got) == [0, 150, 150]


def test_op13_matches_all_strings(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op13_repeat_groups"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_groups_hold_every_occurrence(spark):
    rows = rows_with_repeats(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    data = {d: (t or "").encode() for d, t in rows}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(docs, block_bytes=3000).collect():
        groups[r.first_doc, r.first_start, r.length].add((r.doc_id, r.start))
    where = defaultdict(set)
    for d, b in data.items():
        for i in range(len(b) - SIZE + 1):
            where[b[i : i + SIZE]].add((d, i))
    covered = set()
    for (d, s, n), found in groups.items():
        string = data[d][s : s + n]
        assert n >= SIZE and len(found) > 1
        assert found == {(x, i) for x, i in where[string[:SIZE]] if data[x][i : i + n] == string}
        covered |= {string[i : i + SIZE] for i in range(n - SIZE + 1)}
    assert covered == {s for s, at in where.items() if len(at) > 1}


def test_suffix_array_and_intervals():
    rnd = random.Random(3)
    for _ in range(40):
        text = bytes(rnd.choices(b"ab\0", k=120))
        data = np.frombuffer(text, np.uint8)
        start = np.arange(100)
        size = np.minimum(len(text) - start, 20)
        sa, common = repeats.suffix_array(data, start, size, np.zeros(100, np.int64))
        strings = [text[s : s + 20] for s in sa]
        assert strings == sorted(strings)
        for i in range(1, 100):
            n = next((k for k in range(20) if strings[i][k : k + 1] != strings[i - 1][k : k + 1]), 20)
            assert common[i] == n
        left = np.full(100, -1)
        found = repeats.intervals(common, left, sa, least=3)
        want = {(text[s : s + n]) for n in range(3, 21) for s in range(100) if s + n <= 120}
        for lo, hi, n, lost in found:
            string = strings[lo][:n]
            assert [s[:n] for s in strings].count(string) == hi - lo + 1 and string in want
        lost = [x for f in found for x in f[3]]
        assert len(lost) == len(set(lost))
        seen = {s[:3] for s in strings}
        assert len(lost) == 100 - len(seen)
