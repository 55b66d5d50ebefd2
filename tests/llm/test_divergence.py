"""Source divergence against a plain count of all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from nightgrid.llm import divergence

WORDS = ["a", "Zwei", "eight888", "abcdefgh", "abcdefghi", "sixteenlettersab", "seventeenlettersx", "Ünïcödé", "你好世界你好世界", "x" * 40, "x" * 41, "don't", "É"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))) for lang, source, text in rows]
    df, groups = Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in {k[0] for k in groups}:
        kept = sorted(t for (k, t), n in df.items() if k == lang and n >= min_docs)

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = Counter()
        for (k, _), c in groups.items():
            if k == lang:
                whole.update(c)
        q, p = shares(whole), {s: shares(c) for (k, s), c in groups.items() if k == lang}
        for s in p:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(ranked)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, source string, text string, term string, p int")


def test_matches_plain_counts(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice("stuv"), " ".join(rnd.choices(WORDS, k=rnd.randint(0, 30)))) for _ in range(160)]
    rows += [("en", None, None), ("xx", "only", ""), ("yy", "a", "once"), ("yy", "b", "1 2"), ("en", "s", "q" * 30000), *[("en", "s", "same row")] * 5]
    rows += [("zz", f"s{i}", f"common rare{i}") for i in range(8)]
    docs = table(spark, rows).repartition(4)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    got = divergence.source_divergence(docs)
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)
    monkeypatch.setattr(divergence, "PAIRS", 3)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 20)
    assert sorted(tuple(r) for r in divergence.source_divergence(docs, top=2).collect()) == plain(rows, top=2)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_tasks_merge_and_flush(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = [("en", "s", " ".join(rnd.choices(WORDS, k=20))) for _ in range(60)]
    batches = [pa.record_batch([pa.array(list(c)) for c in zip(*rows[i : i + 7])], ["lang", "source", "text"]) for i in range(0, 60, 7)]
    n, docs = Counter(), Counter()
    for b in divergence._count(iter(batches)):
        for r in b.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t)) for _, _, t in rows]
    assert n == Counter(t for ts in terms for t in ts)
    assert docs == Counter(t for ts in terms for t in set(ts))


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    low, high = rng.integers(0, 1 << 63, 500, dtype=np.uint64) % np.uint64(7), rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(40)
    assert divergence.radix_order([low, high]).tolist() == np.lexsort((np.arange(500), low, high)).tolist()
