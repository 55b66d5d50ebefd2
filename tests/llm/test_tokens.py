"""Token ids, packed files and sequence packing against plain versions."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightgrid.llm import bitpack, packing
from nightgrid.llm.queries import QUERIES
from nightgrid.llm.tokens import encoder, vocab_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string, length string"
EDGES = [(5, None), (5, None), (1, ""), (None, "a b"), (2, "one, two\n three"), (2, "one, two\n three"), (9, "word " * 3000), (7, "　x  y"), (8, "z" * 30000)]


def edge_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "n") for i, t in EDGES], SCHEMA)


def plain(text, end):
    return encoder(vocab_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_whole_text_encoding():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab 'é\n.,9\t…ß S　 ×s\x1d|<|endoftext|>") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    ids, off = encoder(vocab_path()).encode(pa.array(texts + [None]))
    for i, t in enumerate(texts + [None]):
        assert ids[off[i] : off[i + 1]].tolist() == plain(t, 0)[:-1], repr(t)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_pack_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    sizes = [1, 0, 700, 5000, 64, 63]
    ids = rng.integers(0, 1 << bits, sum(sizes), dtype=np.uint64).astype(np.uint32)
    file = io.BytesIO()
    out = bitpack.Writer(file, bits, block=256)
    out.add([1, None, 3], sizes[:3], ids[: sum(sizes[:3])])
    out.add([4, 5, 6], sizes[3:], ids[sum(sizes[:3]) :])
    out.close()
    r = bitpack.Reader(file)
    ends = np.cumsum(sizes)
    for k in range(6):
        assert r.document(k).tolist() == ids[ends[k] - sizes[k] : ends[k]].tolist()
    for a, b in [(0, 0), (0, 1), (255, 257), (1000, 4000), (0, len(ids))]:
        assert r.ids(a, b).tolist() == ids[a:b].tolist()
    assert r.doc_ids[~r.gone].tolist() == [1, 3, 4, 5, 6]


def want_packed(rows):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(t, 0)
        out.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_op10_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op10_packed_ids"](spark, SF).orderBy("start").collect()]
    assert got == want_packed(rows)


def test_packed_ids_edge_rows_and_small_files(spark):
    files = bitpack.write_ids(edge_docs(spark), vocab_path(), file_ids=500)
    assert files.count() > 1
    got = sorted((tuple(r) for r in bitpack.read_ids(files).collect()), key=lambda r: r[1])
    assert [(d, n, c) for d, _, n, c in got] == [(d, n, c) for d, _, n, c in want_packed(EDGES)]
    assert [r[1] for r in got] == [r[1] for r in want_packed(EDGES)]
    assert bitpack.id_files(edge_docs(spark).limit(0), vocab_path()).count() == 0


def check_packing(rows, out, end=2, cap=1024):
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, t in rows:
        ids = plain(t, end)
        first = (len(ids) - 1) % cap + 1
        cuts = [0, *range(first, len(ids) + 1, cap)]
        want.setdefault(d, []).extend((k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for d, v in by_doc.items()}
    assert got == {d: sorted(v) for d, v in want.items()}
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= cap
    # never fewer than the bound, never more than best fit over all pieces at once
    size = np.array([r["length"] for r in out])
    assert packing.lower_bound(size, cap) <= len(seqs) <= packing.best_fit_decreasing(size, cap)[2]


def test_op9_places_every_piece(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(rows, QUERIES["op9_best_fit_packing"](spark, SF).collect())


def test_packing_edge_rows_and_exchange(spark):
    out = packing.pack_sequences(packing.pieces(edge_docs(spark), vocab_path())).collect()
    check_packing(EDGES, out)
    assert packing.pack_sequences(packing.pieces(edge_docs(spark).limit(0), vocab_path())).count() == 0
    parts = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 400 + 1).alias("length"))
    one = packing.pack_sequences(parts, deal=400)
    assert one.count() == 4000
    bins, volume = one.select("sequence_id").distinct().count(), parts.agg(F.sum("length")).first()[0]
    assert bins <= -(-volume // 1024) + 1


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        cap = 20
        size = rng.integers(1, cap + 1, rng.integers(0, 40))
        low, used = packing.lower_bound(size, cap), packing.best_fit_decreasing(size, cap)[2]
        assert -(-size.sum() // cap) <= low <= used
    assert packing.lower_bound(np.array([11] * 6), 20) == 6
