"""Links and classes against all pairs on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from nightgrid.llm import jaccard
from nightgrid.llm.components import components
from nightgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def grams(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        r = find(at[t or ""])
        if d is not None:
            least[r] = min(least.get(r, d), d)
    copies = [0] * len(texts)
    for _, t in rows:
        copies[at[t or ""]] += 1
    return sorted(((d, least.get(find(at[t or ""])), links[at[t or ""]], copies[at[t or ""]]) for d, t in rows), key=str)


def near_rows(seed=1, bases=12, copies=14):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for b in range(bases):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 60, 200]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 40))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows + [(None, None), (None, ""), (900, ""), (901, " \n"), (901, " \n"), (902, "one"), (903, "ONE"), (904, "x " * 9000)]


def test_classes_match_all_pairs(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "k", b"r", 1) for d, t in rows], "doc_id long, text string, key string, row binary, turn int")
    assert sorted((tuple(r) for r in jaccard.jaccard_classes(docs).collect()), key=str) == plain(rows)
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {}
    for d, c, *_ in plain(rows):
        want.setdefault(c, d)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    rows = near_rows(seed=3, bases=3, copies=60)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    texts = texts.select(jaccard.text_key(texts.text).alias("key"), "text")
    whole = {r.key: (r.root, r.n_links) for r in jaccard.linked_texts(texts).collect()}
    assert {r.key: (r.root, r.n_links) for r in jaccard.linked_texts(texts, tile=16).collect()} == whole


def test_op8_matches_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op8_jaccard_join"](spark, SF).collect()), key=str) == plain(rows)


def test_copies_collapse_before_their_texts_are_joined(spark):
    texts = spark.range(900).selectExpr("cast(cast(id % 3 as string) as binary) as key", "concat('text ', id % 3) as text")
    sized = spark.range(2).selectExpr("cast(cast(id as string) as binary) as key", "id as group", "2L as n")
    got = jaccard.wanted_texts(texts, sized)
    assert sorted((r.group, r.text) for r in got.collect()) == [(0, "text 0"), (1, "text 1")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_prefixes_shorten_to_the_recall():
    assert jaccard.prefix_length(recall=0.5) > jaccard.prefix_length(recall=0.99) > jaccard.prefix_length(recall=0.9999999)
    d = jaccard.prefix_length()
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.RECALL


def test_trie_keeps_labels_with_a_neighbour(spark):
    rows = near_rows(seed=5)
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = jaccard._signed(texts.select(jaccard.text_key(texts.text).alias("key"), "text"))
    trie = {(r.tree, r.key): r.deep for r in jaccard.prefix_trie(signed, 4).collect()}
    labels = {}
    for r in signed.collect():
        for tree, label in enumerate(r.labels):
            labels.setdefault(tree, []).append((bytes(label), r.key))
    for tree, found in labels.items():
        for label, key in found:
            best = max((next((i for i in range(8) if a[4 * i : 4 * i + 4] != label[4 * i : 4 * i + 4]), 8) for a, k in found if k != key), default=0)
            if best >= 4:
                assert trie[tree, key] >= best
            else:
                assert trie.get((tree, key), 8) == 8  # the edge of a partition, or dropped


def test_deep_prefixes_leave_less_to_compare(spark):
    rows = near_rows(seed=6, bases=4, copies=40)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    signed = jaccard.stored(jaccard._signed(texts.select(jaccard.text_key(texts.text).alias("key"), "text")), "signed")
    report = []
    found = jaccard.forest_components(signed, report=report)
    assert [r[0] for r in report] == jaccard.prefix_steps(jaccard.prefix_length())
    trie = jaccard.prefix_trie(signed, jaccard.prefix_length())
    _, nodes = jaccard.open_nodes(trie, None, jaccard.prefix_length())
    flat = sum(r.n * (r.n - 1) // 2 for r in nodes.collect())
    print("pairs by step", report, "at the shortest prefix alone", flat)
    assert sum(r[3] or 0 for r in report) < flat
    # recall against all pairs: linked texts lie in one component
    root = {r.node: r.root for r in found.collect()}
    keys = {r.text or "": r.key for r in texts.select(jaccard.text_key(texts.text).alias("key"), "text").collect()}
    names = sorted(keys)
    sets = [grams(t) for t in names]
    pairs = [(a, b) for a in range(len(names)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    hit = sum(root.get(keys[names[a]], a) == root.get(keys[names[b]], b) for a, b in pairs)
    assert pairs and hit >= 0.999 * len(pairs)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in rng.integers(0, 10**6, 3000)]
    other = base[:2700] + [f"u{i}" for i in range(300)]
    sig = jaccard.signatures(*jaccard.shingles(pa.array([" ".join(base), " ".join(other)])))
    a, b = grams(" ".join(base)), grams(" ".join(other))
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.12


@pytest.mark.parametrize("n", [40])
def test_components_of_chains_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(n)] + [(2000, 2000)] + [(5, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
