"""Benchmark decontamination by broadcast sets of normalised n-grams.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z.
Each benchmark item gives its windows of 13 words; an item of fewer words, but
not none, is one window.  Documents are scanned once: words outside the
benchmark's vocabulary become 0, window hashes are looked up in a sorted array,
and every hit is verified word by word.

What is broadcast is bounded by `max_words` benchmark words.  A larger
benchmark is cut into groups of whole items and the documents are scanned once
for each group, so nothing is dropped.  Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.storage import stored
from nightgrid.llm.text import codes, from_raw, mix, raw, slices, split_words, windows

SIZE = 13
MAX_WORDS = 1_000_000  # of the benchmark in one broadcast: under 100 MB
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _spaced() -> np.ndarray:
    """Lower case for word bytes, a space for all others."""
    to = np.full(256, 32, np.uint8)
    for lo, hi, shift in ((48, 58, 0), (65, 91, 32), (97, 123, 0), (128, 256, 0)):
        to[lo:hi] = np.arange(lo, hi) + shift
    return to


SPACED = _spaced()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Normalised words of all texts, and where each text's words start."""
    data, off = raw(texts)
    return split_words(from_raw(SPACED[data], off))


class Windows:
    """The windows of a group of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int = SIZE):
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        spans: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = [item for item, _ in items]
        for k, (_, ws) in enumerate(items):
            ids = [self.vocab[w] for w in ws]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                spans.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(k)
        self.tables = []
        for n, found in sorted(spans.items()):
            grams = np.array(list(found), np.int64).reshape(-1, n)
            hashes, _ = windows(mix(grams.reshape(-1)), np.arange(0, grams.size + 1, n), n)
            order = np.argsort(hashes, kind="stable")
            self.tables.append((n, hashes[order], grams[order], [sorted(found[tuple(grams[i].tolist())]) for i in order.tolist()]))
        self.words = pa.array([w.decode("utf-8", "surrogatepass") for w in self.vocab], pa.large_string())

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """Which words are hit, where each text's words start, and the items found in each text."""
        flat, off = words_of(texts)
        hit, found = np.zeros(len(flat), bool), [set() for _ in range(len(texts))]
        if not self.tables or not len(flat):
            return hit, off, found
        number, distinct = codes(flat)
        known = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy() + 1
        ids = known[number].astype(np.int64)
        for n, hashes, grams, owners in self.tables:
            got, first = windows(mix(ids), off, n)
            at = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            like = np.flatnonzero(hashes[at] == got)
            # two different windows of one hash would stand next to each other
            for shift in range(int(np.unique(hashes, return_counts=True)[1].max())):
                row = np.minimum(at[like] + shift, len(hashes) - 1)
                same = (grams[row] == ids[first[like][:, None] + np.arange(n)]).all(axis=1)
                begin = first[like[same]]
                hit[(begin[:, None] + np.arange(n)).reshape(-1)] = True
                text = np.searchsorted(off, begin, "right") - 1
                for t, r in set(zip(text.tolist(), row[same].tolist())):
                    found[t].update(self.items[k] for k in owners[r])
        return hit, off, found


def item_words(text: str | None) -> list[bytes]:
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode("utf-8", "surrogatepass"))
    return WORD.findall(low)


def groups(benchmark: DataFrame, max_words: int = MAX_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in groups of at most `max_words` words (one item at least), one group at a time on the driver."""
    held: list[tuple[object, list[bytes]]] = []
    n = 0
    rows = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].alias("text"))
    for row in rows.toLocalIterator():
        ws = item_words(row["text"])
        if held and n + len(ws) > max_words:
            yield held
            held, n = [], 0
        held.append((row["item"] if row["item"] is not None else "", ws))
        n += len(ws)
    if held:
        yield held


def _scanned(docs: DataFrame, benchmark: DataFrame, size: int, max_words: int, last: Callable, out: str, columns: list[str]) -> DataFrame:
    """Scan `docs` for each group in turn; `last` makes the output batch of the final scan.

    Between groups the hit words and items travel with the rows and the
    lineage is cut, so one broadcast is alive at a time.
    """
    spark = docs.sparkSession
    todo = groups(benchmark, max_words)
    now, carry = next(todo, []), False
    while True:
        after = next(todo, None)
        shared = spark.sparkContext.broadcast((now, size))

        def scan(batches, shared=shared, carry=carry, final=after is None):
            finder = Windows(*shared.value)
            for batch in slices(batches, "text"):
                hit, off, found = finder.scan(batch.column(batch.schema.get_field_index("text")))
                if carry:
                    before = batch.column(batch.num_columns - 1).field(0).to_pylist()
                    for i, b in enumerate(before):
                        hit[off[i] : off[i + 1]] |= np.unpackbits(np.frombuffer(b, np.uint8), count=off[i + 1] - off[i]).astype(bool)
                    for i, b in enumerate(batch.column(batch.num_columns - 1).field(1).to_pylist()):
                        found[i].update(b)
                    batch = batch.select(list(range(batch.num_columns - 1)))
                if final:
                    yield last(batch, hit, off, found)
                else:
                    bits = [np.packbits(hit[off[i] : off[i + 1]]).tobytes() for i in range(batch.num_rows)]
                    kind = pa.struct([("hit", pa.binary()), ("items", pa.list_(pa.string()))])
                    state = pa.array([{"hit": b, "items": sorted(f)} for b, f in zip(bits, found)], kind)
                    yield pa.RecordBatch.from_arrays([*batch.columns, state], names=[*batch.schema.names, "_state"])

        if after is None:
            return docs.mapInArrow(scan, out)
        plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(columns)])
        docs = stored(docs.mapInArrow(scan, f"{plain}, _state struct<hit binary, items array<string>>"), "decontaminate")
        now, carry = after, True


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for every document.

    A word inside any occurrence of a window is hit; a document is contaminated
    when hit words are a twentieth of its words or more.  spans are the runs of
    hit words as [first, past last].  Null and empty texts have no words and are
    clean; with no item found the digest is that of an empty text.  Repeated
    rows are reported each, repeated items count as one name, empty tables give
    no rows or no hits.  Only the id and the text are read.
    """

    def report(batch, hit, off, found):
        n, n_hit = np.diff(off), np.diff(np.append(0, np.cumsum(hit))[off])
        sha = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
        spans = []
        for i in range(len(n)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[off[i] : off[i + 1]].astype(np.int8), [0]])))
            spans.append(edge.reshape(-1, 2).tolist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(n_hit), pa.array([len(f) for f in found], pa.int64()), pa.array(sha), pa.array((n_hit > 0) & (20 * n_hit >= n)), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )

    base = docs.select(docs["doc_id"], docs["text"])
    kind = base.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>"
    return _scanned(base, benchmark, size, max_words, report, out, base.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of `docs` without contaminated documents, or with their hit spans cut out.

    With remove="spans" the words of a hit span and what stands between them
    leave the text of contaminated documents; other rows stay as they are.
    All columns are kept.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")

    def kept(batch, hit, off, found):
        n, n_hit = np.diff(off), np.diff(np.append(0, np.cumsum(hit))[off])
        dirty = (n_hit > 0) & (20 * n_hit >= n)
        if remove == "documents":
            return batch.filter(pa.array(~dirty))
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        for i in np.flatnonzero(dirty).tolist():
            texts[i] = cut_spans(texts[i], hit[off[i] : off[i + 1]])
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return _scanned(docs, benchmark, size, max_words, kept, docs.schema, docs.columns)


def cut_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and the characters between two of them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(bytes(SPACED[np.frombuffer(data, np.uint8)]))]
    out, at = [], 0
    for i, (lo, hi) in enumerate(places):
        if hit[i]:
            if not (i and hit[i - 1]):
                out.append(data[at:lo])
            at = hi
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
