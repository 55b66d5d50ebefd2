"""Arrow and NumPy helpers shared by the text operators.

All of them work on one Arrow batch inside a Spark task; Spark partitions the
work.  Texts are taken whole and null reads as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id reads as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Only the id and the text, so that no extra column can clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[c.alias(n) for n, c in more.items()])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `max_bytes` of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + max_bytes, "right"))
            end = max(at + 1, end)
            yield batch.slice(at, end - at)
            at = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each starts."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all binary values end to end, and where each starts."""
    values = values.cast(pa.large_binary())
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    held = values.buffers()[2]
    held = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return (held[off[0] : off[-1]], off - off[0]) if len(off) else (held[:0], np.zeros(1, np.int64))


def from_raw(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts over bytes that are known to be UTF-8."""
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts, and where each text's words start."""
    arr = from_raw(*raw(texts))  # starts at 0: ascii_lower misreads slices
    if lower:
        arr = pc.ascii_lower(arr)
    lists = pc.ascii_split_whitespace(arr)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(full), parent[full.to_numpy(zero_copy_only=False)]
    return flat, np.searchsorted(parent, np.arange(len(arr) + 1))


def codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as a number, and the distinct words."""
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def hash_texts(words: pa.Array) -> np.ndarray:
    """64-bit hash of each text, the same in every process."""
    data, off = raw(words)
    n = np.diff(off)
    out = mix(n.astype(np.uint64) + np.uint64(1))
    for i in np.flatnonzero(n > 64):
        digest = hashlib.blake2b(data[off[i] : off[i + 1]], digest_size=8).digest()
        out[i], n[i] = int.from_bytes(digest, "little"), 0
    at = off[:-1].copy()
    live = np.flatnonzero(n > 0)
    while len(live):
        take = np.minimum(n[live], 4)
        val = np.zeros(len(live), np.uint64)
        for i in range(4):
            on = take > i
            val[on] |= data[at[live[on]] + i].astype(np.uint64) << np.uint64(8 * i)
        out[live] = mix(out[live] ^ val) + np.uint64(0x9E3779B97F4A7C15)
        at[live] += take
        n[live] -= take
        live = live[n[live] > 0]
    return out


def windows(values: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of k values inside a text, and the first index of each."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += values[i : n + i]
    owner_end = np.repeat(off[1:], np.diff(off))
    whole = np.arange(n) + k <= owner_end[:n]
    return mix(h[whole]), np.flatnonzero(whole)
