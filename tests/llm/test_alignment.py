"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import pyarrow as pa

from nightgrid.llm import alignment
from nightgrid.llm.queries import QUERIES
from nightgrid.llm.tokens import encoder, vocab_path

SF = "/root/testdata/sf0.001"
A, B = vocab_path(), vocab_path("piece_bpe_32k.model")
ODD = [
    (1, None),
    (1, None),
    (2, ""),
    (3, " "),
    (4, "  two  spaces "),
    (5, "a▁b is not a space"),
    (6, "<s> </s> <|endoftext|> <0x41> <unk>"),
    (7, "line\n\nfeeds\t tabs \n"),
    (8, "你好世界 café ﬁ \U0001f600‍　x"),
    (None, "null id"),
    (9, "same text"),
    (9, "same text"),
    (10, "word " * 4000),
    (11, "z" * 20000),
    (12, "nul \x00 byte"),
]


def plain(rows):
    tool, pieces = encoder(A).tokenizer, alignment.PieceEncoder(B)
    byte_of = {c: i for i, c in enumerate(encoder(A)._alphabet())}
    docs, total = [], Counter()
    for d, text in rows:
        a = tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.model.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in tool.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if pieces.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.model.id_to_piece(i)) for i in b)
        ]
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a = b = a_bytes = b_bytes = []
        spans = []
        for side in (a_bytes, b_bytes):
            at, out = 0, []
            for t in side:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while j and spans[1][j - 1][1] > lo:
                j -= 1
            while j < len(b) and spans[1][j][0] < hi:
                if spans[1][j][1] > lo:
                    links.append((a[i], b[j]))
                j += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        for e in ends:
            sides = [",".join(str(t) for t, (x, y) in zip(ids, span) if lo <= x and y <= e) for ids, span in ((a, spans[0]), (b, spans[1]))] if len(a) < 3000 else None
            groups.append("|".join(sides) if sides else None)
            lo = e
        if len(a) >= 3000:
            groups, x, y = [], 0, 0
            for e in ends:
                i, j = x, y
                while i < len(a) and spans[0][i][1] <= e:
                    i += 1
                while j < len(b) and spans[1][j][1] <= e:
                    j += 1
                groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
                x, y = i, j
        total.update(links)
        text = ";".join(groups)
        docs.append((d, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    top = Counter()
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    return sorted(
        ((d, na, nb, ng, len(ls), sum(total[x] == top[x[1]] for x in ls), sum(total[x] for x in ls), sha) for d, na, nb, ng, ls, sha in docs),
        key=str,
    )


def test_piece_ids_equal_whole_text_encoding():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab  \n\t.,9…é你　\x00<s>") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    tool = alignment.PieceEncoder(B)
    ids, off = tool.encode(pa.array(texts + [None]))
    for i, t in enumerate(texts + [""]):
        assert ids[off[i] : off[i + 1]].tolist() == tool.model.encode(t), repr(t)


def test_edge_texts_and_small_blocks(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, block string, windows string")
    got = alignment.align_documents(docs.repartition(3), A, B, block_bytes=64).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(ODD)
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0


def test_op11_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_windows_are_aligned_once():
    tool = alignment.Aligner(A, B)
    tool.windows(pa.array(["the cat and the cat and the dog"] * 50))
    assert len(tool.known) == 4
