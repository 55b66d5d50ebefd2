"""Alignment of two tokenizers over whole texts, by windows between white-space anchors.

Both tokenizers encode every text in full.  Where a token of either side ends
at the same byte and the next token of both sides is marked with a space, the
document is split; the piece between two such anchors is a window of token
ids.  Windows repeat as words do, so each distinct pair of id tuples is
aligned once per worker and its alignment looked up afterwards.

    1  texts are encoded in blocks of bounded size; each document keeps the
       numbers of its windows, each block its distinct windows and the counts
       of its distinct id pairs
    2  id pairs are counted over all blocks; the highest count of each B id is
       an aggregate of at most one row per B id
    3  each block gets back the counts of its own pairs, sums them by distinct
       window and adds up its documents

Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.storage import stored
from nightgrid.llm.text import from_raw, id_text, raw, raw_bytes, slices
from nightgrid.llm.tokens import encoder

BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
CACHED = 120_000  # chunks and windows that a Python worker keeps for its next block
APART = b"\xff\xff\xff\xff"  # no id
MARK = "▁"
SPACE = 32


def gather(data: np.ndarray, off: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The listed pieces of `data` end to end, and where each starts."""
    size = np.diff(off)[items]
    ends = np.append(0, np.cumsum(size))
    return data[np.arange(ends[-1]) + np.repeat(off[items] - ends[:-1], size)], ends


class PieceEncoder:
    """Ids of a piece model with a leading space, each distinct chunk encoded once.

    A text is cut before a run of spaces that follows anything else.  No piece
    of the vocabulary reaches over such a place (checked when it is loaded; a
    model with such a piece is not cut), so the ids are those of the whole text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.blank = self.model.piece_to_id(MARK)
        coded = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.data = np.frombuffer(b"".join(coded), np.uint8)
        self.off = np.append(0, np.cumsum([len(c) for c in coded])).astype(np.int64)
        self.size = np.diff(self.off)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 18, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, chunks: list[str]) -> np.ndarray:
        got = self.model.encode(chunks, num_threads=1)
        ends = self.starts[-1] + np.cumsum([len(g) for g in got])
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.starts[-1] : ends[-1]] = np.concatenate([np.array(g, np.uint32) for g in got])
        first = len(self.starts) - 1
        self.starts = np.append(self.starts, ends)
        number = np.arange(first, first + len(chunks))
        self.known.update(zip(chunks, number.tolist()))
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start."""
        data, off = raw(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cut = np.zeros(len(data), bool)
        if self.cuts:
            cut[1:] = (data[1:] == SPACE) & (data[:-1] != SPACE)
        first = off[:-1][np.diff(off) > 0]
        cut[first] = False
        # the space that opens a chunk is the one the model adds by itself
        keep = ~cut
        cut[first] = True
        at = np.append(np.flatnonzero(cut), len(data))
        place = np.append(0, np.cumsum(keep))
        coded = from_raw(data[keep], place[at]).dictionary_encode()
        where, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > CACHED:
            self._reset()
        code = np.fromiter((self.known.get(c, -1) for c in names), np.int64, len(names))
        fresh = np.flatnonzero(code < 0)
        if len(fresh):
            code[fresh] = self._learn([names[i] for i in fresh.tolist()])
        ids, ends = gather(self.ids, self.starts, code[where])
        lone = np.flatnonzero(names == "")
        if len(lone):  # an opening space with nothing behind it is a token of its own
            blank = where == lone[0]
            ids, ends = np.insert(ids, ends[:-1][blank], self.blank), ends + np.append(0, np.cumsum(blank))
        return ids, ends[np.searchsorted(at, off)]


class ByteTokens:
    """Bytes of each id of a byte-level vocabulary."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        byte_of = {c: i for i, c in enumerate(self.encoder._alphabet())}
        coded = [b""] * self.encoder.vocab_size
        for token, i in self.encoder.tokenizer.get_vocab(with_added_tokens=True).items():
            coded[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.data = np.frombuffer(b"".join(coded), np.uint8)
        self.off = np.append(0, np.cumsum([len(c) for c in coded])).astype(np.int64)
        self.size = np.diff(self.off)


def _joined(texts: pa.Array, off: np.ndarray, by: str) -> pa.Array:
    """Each run of texts as one."""
    lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), texts)
    return pc.binary_join(lists, pa.scalar(by, texts.type))


def align(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, a_off: np.ndarray, b_off: np.ndarray):
    """Groups of each window as text, their number, and its overlapping pairs (a * 2^32 + b) with where they start.

    Windows lie end to end, and both sides of one have equal bytes: `a_off` and
    `b_off` are their first tokens, `a_end` and `b_end` the bytes where tokens end.
    """
    i = np.flatnonzero(np.isin(a_end, b_end, assume_unique=True))
    j = np.searchsorted(b_end, a_end[i])
    sides = [
        _joined(pa.array(ids).cast(pa.large_string()), np.append(0, last + 1), ",")
        for ids, last in ((a, i), (b, j))
    ]
    groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    at = np.searchsorted(i, a_off)
    # the B tokens of each A token: from the first that ends after its start to the first that ends at or after its end
    first = np.searchsorted(b_end, np.append(0, a_end[:-1]), "right")
    n = np.searchsorted(b_end, a_end) - first + 1
    ends = np.append(0, np.cumsum(n))
    partner = np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)
    links = np.repeat(a.astype(np.uint64), n) << np.uint64(32) | b[partner].astype(np.uint64)
    return _joined(groups, at, ";"), np.diff(at), links, ends[a_off]


class Rows:
    """Runs of values that grow at the end."""

    def __init__(self, dtype):
        self.data, self.off = np.zeros(1 << 16, dtype), np.zeros(1, np.int64)

    def add(self, data: np.ndarray, off: np.ndarray) -> None:
        end = self.off[-1] + len(data)
        while end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.off[-1] : end] = data
        self.off = np.append(self.off, self.off[-1] + off[1:])


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run of `values`, empty runs too."""
    total = np.append(0, np.cumsum(values))
    return total[off[1:]] - total[off[:-1]]


class Aligner:
    """Windows of a worker: each distinct pair of id tuples is aligned once."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceEncoder(b_path)
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups = np.zeros(0, np.int64)
        self.text, self.links = Rows(np.uint8), Rows(np.uint64)

    def _same(self, side, ids: np.ndarray, off: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """True for each text whose token bytes are its own bytes."""
        even = sums(side.size[ids], off) == np.diff(at)
        keep = np.repeat(even, np.diff(off))
        got, _ = gather(side.data, side.off, ids[keep])
        want = data[np.repeat(even, np.diff(at))]
        wrong = np.zeros(len(data), np.int64)
        wrong[np.flatnonzero(np.repeat(even, np.diff(at)))[got != want]] = 1
        return even & (sums(wrong, at) == 0)

    def _number(self, a: pa.Array, b: pa.Array) -> np.ndarray:
        """Number of each window; new ones are aligned together."""
        a, b = a.dictionary_encode(), b.dictionary_encode()
        both = a.indices.to_numpy().astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy()
        pairs, where = np.unique(both, return_inverse=True)
        i, j = np.divmod(pairs, max(1, len(b.dictionary)))
        keys = pc.binary_join_element_wise(a.dictionary.take(pa.array(i)), b.dictionary.take(pa.array(j)), pa.scalar(APART, pa.large_binary())).to_pylist()
        number = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = np.arange(len(self.groups), len(self.groups) + len(fresh))
            self.known.update(zip([keys[k] for k in fresh.tolist()], number[fresh].tolist()))
            self._learn(a.dictionary.take(pa.array(i[fresh])), b.dictionary.take(pa.array(j[fresh])))
        return number[where]

    def _learn(self, a: pa.Array, b: pa.Array) -> None:
        sides = []
        for side, windows in ((self.a, a), (self.b, b)):
            data, off = raw_bytes(windows)
            ids = data.view(np.uint32)
            sides.append((ids, np.cumsum(side.size[ids]), off // 4))
        (a, a_end, a_off), (b, b_end, b_off) = sides
        text, groups, links, off = align(a, b, a_end, b_end, a_off, b_off)
        self.text.add(*raw(text))
        self.links.add(links, off)
        self.groups = np.append(self.groups, groups)

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and of B in each text (0 where it has none), its windows, and where they start."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        data, at = raw(spaced)
        a, a_off = self.a.encoder.encode(spaced)
        b, b_off = self.b.encode(texts)
        good = (np.diff(at) > 1) & self._same(self.a, a, a_off, data, at) & self._same(self.b, b, b_off, data, at)
        n_a, n_b = np.where(good, np.diff(a_off), 0), np.where(good, np.diff(b_off), 0)
        a, b = a[np.repeat(good, np.diff(a_off))], b[np.repeat(good, np.diff(b_off))]
        if not len(a):
            return n_a, n_b, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        i = np.flatnonzero(np.isin(a_end, b_end, assume_unique=True))
        j = np.searchsorted(b_end, a_end[i])
        opens_a = np.append(self.a.data[self.a.off[a[1:]]] == SPACE, True)
        opens_b = np.append(self.b.data[self.b.off[b[1:]]] == SPACE, True)
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a)[n_a > 0] - 1] = True
        anchor = (opens_a[i] & opens_b[j]) | last[i]
        i, j = np.append(0, i[anchor] + 1), np.append(0, j[anchor] + 1)
        keys = [
            pa.Array.from_buffers(pa.large_binary(), len(k) - 1, [None, pa.py_buffer(k * 4), pa.py_buffer(ids)])
            for k, ids in ((i, np.ascontiguousarray(a, np.uint32)), (j, np.ascontiguousarray(b, np.uint32)))
        ]
        return n_a, n_b, self._number(*keys), np.searchsorted(i, np.append(0, np.cumsum(n_a)))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, kept between tasks."""
    return Aligner(a_path, b_path)


PARTS = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "windows", "freq", "pairs", "pair_n", "window_pairs", "window_off"]


class Block:
    """Documents of one block and what they have in common."""

    def __init__(self, tool: Aligner):
        self.tool, self.rows, self.bytes = tool, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        n_a, n_b, number, off = self.tool.windows(batch.column("text"))
        self.rows.append((batch.column("doc_id"), n_a, n_b, number, off))
        self.bytes += batch.column("text").nbytes

    def batch(self, ids: pa.DataType) -> pa.RecordBatch:
        """One row per document, and a last one with the windows and pairs of the block."""
        tool, name = self.tool, uuid.uuid4().hex
        numbers, where = np.unique(np.concatenate([r[3] for r in self.rows]), return_inverse=True)
        links, link_off = gather(tool.links.data, tool.links.off, numbers)
        size = np.diff(link_off)
        freq = np.bincount(where, minlength=len(numbers)).astype(np.int64)
        pairs, pair_of = np.unique(links, return_inverse=True)
        pair_n = np.zeros(len(pairs), np.int64)
        np.add.at(pair_n, pair_of, np.repeat(freq, size))
        groups = tool.groups[numbers]
        text = from_raw(*gather(tool.text.data, tool.text.off, numbers))
        out = {c: [] for c in PARTS[2:8]}
        at = 0
        for _, n_a, n_b, number, off in self.rows:
            here = where[at : at + len(number)]
            at += len(number)
            out["n_a"].append(n_a)
            out["n_b"].append(n_b)
            out["n_groups"].append(sums(groups[here], off))
            out["n_links"].append(sums(size[here], off))
            for whole in _joined(text.take(pa.array(here)), off, ";").cast(pa.large_binary()):
                whole = whole.as_buffer()
                out["groups_sha256"].append(hashlib.sha256(whole).hexdigest() if whole.size else "")
            coded = here.astype("<u4")
            out["windows"] += [coded[lo:hi].tobytes() for lo, hi in zip(off[:-1].tolist(), off[1:].tolist())]
        docs = pa.concat_arrays([r[0] for r in self.rows])
        n = len(docs)
        shared = [freq, pairs, pair_n, pair_of.astype("<u4"), link_off]
        nulls = pa.nulls(1, pa.int64())
        cols = [pa.array([name] * (n + 1)), pa.concat_arrays([docs, pa.nulls(1, ids)])]
        cols += [pa.concat_arrays([pa.array(np.concatenate(out[c]), pa.int64()), nulls]) for c in PARTS[2:6]]
        cols += [pa.array(out["groups_sha256"] + [None], pa.string()), pa.array(out["windows"] + [None], pa.binary())]
        cols += [pa.array([None] * n + [np.ascontiguousarray(x).tobytes()], pa.binary()) for x in shared]
        return pa.RecordBatch.from_arrays(cols, PARTS)


def _blocks(a_path: str, b_path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tool = None, aligner(a_path, b_path)
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            if block is None:
                if len(tool.known) > CACHED:
                    tool.reset()
                block = Block(tool)
            block.add(batch)
            if block.bytes >= block_bytes:
                yield block.batch(batch.schema.field("doc_id").type)
                block = None
        if block is not None:
            yield block.batch(batch.schema.field("doc_id").type)

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each block as rows, with their place in its list."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs = np.frombuffer(row["pairs"], np.uint64)
            cols = [pa.array([row["block"]] * len(pairs), pa.string()), pa.array(np.arange(len(pairs), dtype=np.int32))]
            cols += [pa.array((pairs >> np.uint64(32)).astype(np.int32)), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32))]
            cols.append(pa.array(np.frombuffer(row["pair_n"], np.int64)))
            yield pa.RecordBatch.from_arrays(cols, ["block", "place", "a_id", "b_id", "n"])


def _finish(parts: pa.Table, replies: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links."""
    shared = parts.filter(pc.is_valid(parts["freq"])).to_pylist()[0]
    docs = parts.filter(pc.is_null(parts["freq"]))
    size = len(shared["pairs"]) // 8
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    place = replies["place"].to_numpy()
    count[place], best[place] = replies["n"].to_numpy(), replies["best"].to_numpy()
    pair_of, off = np.frombuffer(shared["window_pairs"], "<u4"), np.frombuffer(shared["window_off"], np.int64)
    by_window = [sums(x[pair_of], off) for x in (best, count)]
    windows = docs["windows"].combine_chunks()
    windows = windows.cast(pa.large_binary()) if not isinstance(windows, pa.ChunkedArray) else pa.concat_arrays(windows.chunks).cast(pa.large_binary())
    at = np.frombuffer(windows.buffers()[1], np.int64)[windows.offset : windows.offset + len(windows) + 1]
    held = windows.buffers()[2]
    codes = np.frombuffer(held, np.uint8)[at[0] : at[-1]].view("<u4") if held is not None else np.zeros(0, "<u4")
    n_best, count_sum = [pa.array(sums(x[codes], (at - at[0]) // 4), pa.int64()) for x in by_window]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([docs[c] for c in names] + [n_best, count_sum, docs["groups_sha256"]], [*names, "n_best", "count_sum", "groups_sha256"])


def encode_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored rows of all documents with the windows they consist of, and one row per block with its windows and id pairs."""
    texts = id_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"block string, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, windows binary"
    schema += ", freq binary, pairs binary, pair_n binary, window_pairs binary, window_off binary"
    return stored(texts.mapInArrow(_blocks(a_path, b_path, block_bytes), schema), "alignment")


def block_pairs(parts: DataFrame) -> DataFrame:
    """(block, place, a_id, b_id, n): links of each id pair in each block."""
    shared = parts.where("freq is not null").select("block", "pairs", "pair_n")
    return shared.mapInArrow(_pair_rows, "block string, place int, a_id int, b_id int, n long")


def link_table(parts: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): the links of each id pair over all documents; best is 1 where no pair of the B id has more."""
    totals = block_pairs(parts).groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    top = totals.groupBy("b_id").agg(F.max("n").alias("top"))  # at most a row per id of B's vocabulary
    return totals.join(F.broadcast(top), "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token alignment of each document, with sums over its linked id pairs.

    A (a byte-level vocabulary) encodes a space and the text, B (a piece model)
    the text, to which it adds the space itself.  Rows: doc_id, n_a, n_b,
    n_groups (groups between bytes where both sides end a token), n_links
    (overlapping token pairs), n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose joined tokens are not a space and the
    text (a literal U+2581, for one), have no tokens: zeros and ''.  Repeated
    rows give a row each and count each; null ids stay.  An empty table gives no
    rows.  Only the id and the text are read, so no other column can clash.  A
    text is encoded whole however long it is; one longer than a block is a block.
    """
    parts = encode_blocks(docs, a_path, b_path, id_col, text_col, block_bytes)
    replies = block_pairs(parts).drop("n").join(link_table(parts), ["a_id", "b_id"]).select("block", "place", "n", "best")
    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return parts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_finish, schema)
