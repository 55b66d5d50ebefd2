"""Context-tree weighting against a recursive version on whole trees."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nightgrid.llm import ctw
from nightgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def stream(text):
    return (" ".join(tokens(text)) + "\n").encode()


class Plain:
    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for ctx, byte in self.steps(t):
                for node, bit in self.path(byte):
                    for d in range(depth + 1):
                        c = ctx[depth - d :]
                        self.n[c, node][bit] += 1
                        if d:
                            self.kids[c[1:], node].add(c)
        self.memo = {}

    def steps(self, text):
        s = b"\n" * self.depth + stream(text)
        return [(s[i - self.depth : i], s[i]) for i in range(self.depth, len(s))]

    @staticmethod
    def path(byte):
        return [((1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1) for i in range(8)]

    def own(self, c, node):
        a, b = self.n.get((c, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, node):
        if (c, node) not in self.memo:
            w = self.own(c, node)
            if len(c) < self.depth:
                k = sum(self.weighted(x, node) for x in self.kids.get((c, node), ()))
                w = math.log(0.5) + max(w, k) + math.log1p(math.exp(-abs(w - k)))
            self.memo[c, node] = w
        return self.memo[c, node]

    def p(self, c, node, ctx):
        a, b = self.n.get((c, node), (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if len(c) == self.depth:
            return kt
        k = sum(self.weighted(x, node) for x in self.kids.get((c, node), ()))
        stop = 1 / (1 + math.exp(min(700, k - self.own(c, node))))
        child = ctx[len(ctx) - len(c) - 1 :]
        if sum(self.n.get((child, node), (0, 0))) == 0:
            return kt
        return stop * kt + (1 - stop) * self.p(child, node, ctx)

    def score(self, text):
        out = 0.0
        for ctx, byte in self.steps(text):
            for node, bit in self.path(byte):
                q = self.p(b"", node, ctx)
                out += math.log10(q if bit else 1 - q)
        return out


def plain(rows, held, depth):
    train = [t for d, t in rows if not held(d)]
    tree = Plain(train, depth)
    count = Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()) + len(train), len(count) + bool(train)
    out = []
    for d, t in rows:
        c = [count[w] for w in tokens(t)] + [len(train)]
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in c)
        out.append((d, held(d), len(c), sum(x > 0 for x in c), n, base, tree.score(t)))
    return out


def held7(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def same(got, want):
    def key(r):
        return str(r[:5]), round(r[6], 4)

    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * max(1, abs(w[6])), (g, w)


ROWS = [(1, "The cat, the CAT"), (1, "The cat, the CAT"), (2, None), (3, ""), (None, " \n\t"), (4, "é 　x the"), (5, "zzz"), (8, "w" * 700), (9, "the the cat"), (12, "unseen qqq"), (16, "a b c d e f")]


def test_scores_match_a_recursive_tree(spark):
    docs = spark.createDataFrame([(d, t, 1.0, 2) for d, t in ROWS], "doc_id long, text string, score double, block int")
    for depth in (0, 2, 4):
        for size in (20, 1 << 20):
            got = ctw.score_texts(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2, depth=depth, block_bytes=size)
            same(got.collect(), plain(ROWS, held7, depth))
    nothing = ctw.score_texts(docs, F.lit(True), depth=1).collect()
    same(nothing, plain(ROWS, lambda d: True, 1))
    assert ctw.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_ranges_do_not_change_scores(spark):
    rows = ROWS + [(100 + i, f"{'xy'[i % 2]}abcd{'uv'[i % 3 % 2]} tail {i % 3} the cat") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for depth, grams in ((3, 8), (5, 40)):
        got = ctw.score_texts(docs, ctw_held(), depth=depth, block_bytes=200, range_grams=grams)
        same(got.collect(), plain(rows, held7, depth))


def ctw_held():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def test_large_counts_and_packing():
    n = np.array([0, 1, ctw.SMALL - 1, ctw.SMALL, 10**6], np.float64)
    for m in (0.0, 7.0, 1e6):
        want = [math.lgamma(a + 0.5) + math.lgamma(m + 0.5) - math.lgamma(a + m + 1) - math.log(math.pi) for a in n]
        assert np.allclose(ctw._np_log_kt(n, np.full(5, m)), want, rtol=1e-9, atol=1e-6)
    for v in (np.array([], np.float64), np.array([-1.5, 0.0, 1e300])):
        assert ctw.unpacked(ctw.packed(v), len(v), np.float64).tolist() == v.tolist()


def test_op5_matches_brute_force_and_uses_contexts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op5_context_tree"](spark, SF).collect()
    assert len(got) == len(rows)
    short = {d for d, t in rows if len(t) < 400}
    want = {w[0]: w for w in plain(rows, held7, 0)}
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5] and abs(r.base_score - w[5]) < 1e-6 * max(1, abs(w[5]))
    tree = Plain([t for d, t in rows if not held7(d)], ctw.DEPTH)
    texts = dict(rows)
    for r in got:
        if r.doc_id in short:
            assert abs(r.score - tree.score(texts[r.doc_id])) < 1e-6 * max(1, abs(r.score))
    held = [r for r in got if r.held_out]
    # contexts pay: a quarter shorter than without any, on texts not learnt from
    assert sum(r.score for r in held) > 0.75 * sum(want[r.doc_id][6] for r in held)


def test_op5_takes_five_bytes_of_context(spark, tmp_path):
    rows = [(i, f"{'xy'[i % 2]}abcd{'uv'[i % 2]} tail {i % 3}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["op5_context_tree"](spark, str(tmp_path)).collect(), plain(rows, held7, 5))


def test_byte_stream_of_edge_texts():
    texts = ["ab c", "", None, " ", "Q"]
    keys, at, _, _ = ctw.byte_stream(pa.array(texts), 2)
    want = []
    for t in texts:
        s = b"\n\n" + stream(t)
        want.append([int.from_bytes(s[i - 2 : i + 1], "big") for i in range(2, len(s))])
    assert [keys[a:b].tolist() for a, b in zip(at, at[1:])] == want
