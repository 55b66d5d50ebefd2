"""Token ids in fixed-width bit-packed files with block offsets.

A file holds whole documents in ascending id order:

    magic      8 bytes  NGIDS\\0\\0\\1
    payload    blocks of ids; 64 ids take `bits` little-endian 64-bit words
    doc_id     i64 each, then one u8 each that is 1 for a null doc_id
    doc_end    u64 each, ids of this file up to the document's end
    block_at   u64 each, and one more: byte offset of each block in the file
    tail       6 x u64  documents, ids, bits an id, ids a block, blocks, offset of doc_id

Every id has the smallest width that holds the vocabulary.  Unpacking runs over
64 lanes with NumPy, and any range of ids is read from the blocks it touches.
Blocks are written as they fill up, so a task holds one block and the index.
Files go to a folder that pyarrow's file systems reach from every executor.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightgrid.llm.storage import parts_for, shared_folder, stored
from nightgrid.llm.text import id_text, slices
from nightgrid.llm.tokens import encoder

MAGIC = b"NGIDS\0\0\1"
BLOCK = 4096
FILE_IDS = 64_000_000  # a file is closed when it has so many; 128 MB at 16 bits
READ_IDS = 1_000_000  # ids unpacked at once
TAIL = struct.Struct("<6Q")
LANES = 64


def width_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids in `bits` bits each; 64 of them fill `bits` words."""
    lanes = np.zeros((-(-len(ids) // LANES), LANES), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint64)
    for j in range(LANES):
        w, s = divmod(j * bits, 64)
        out[:, w] |= lanes[:, j] << np.uint64(s)
        if s + bits > 64:
            out[:, w + 1] |= lanes[:, j] >> np.uint64(64 - s)
    return out.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    rows = words.reshape(-1, bits)
    out = np.empty((len(rows), LANES), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(LANES):
        w, s = divmod(j * bits, 64)
        v = rows[:, w] >> np.uint64(s)
        if s + bits > 64:
            v |= rows[:, w + 1] << np.uint64(64 - s)
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


class Writer:
    """Appends documents to an open binary stream."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        if block % LANES:
            raise ValueError("a block holds a multiple of 64 ids")
        self.out, self.bits, self.block = out, bits, block
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.n_ids, self.at, self.block_at = 0, len(MAGIC), []
        self.rest = np.zeros(0, np.uint32)
        out.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits).astype("<u8").tobytes()
        per = self.block // LANES * self.bits * 8
        self.block_at += range(self.at, self.at + len(data), per)
        self.at += len(data)
        self.out.write(data)

    def add(self, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.doc_ids += doc_ids
        self.ends += (self.n_ids + np.cumsum(np.array(sizes, np.int64))).tolist()
        self.n_ids += len(ids)
        self.rest = np.append(self.rest, ids)
        full = len(self.rest) // self.block * self.block
        if full:
            self._put(self.rest[:full])
            self.rest = self.rest[full:]

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        keys = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        gone = np.array([d is None for d in self.doc_ids], np.uint8)
        for part in (keys, gone, np.array(self.ends, "<u8"), np.array([*self.block_at, self.at], "<u8")):
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(len(keys), self.n_ids, self.bits, self.block, len(self.block_at), self.at))


class Reader:
    """One file, opened for reading at any place."""

    def __init__(self, src):
        self.src = src
        size = src.seek(0, 2) or src.tell()
        if self._at(0, 8) != MAGIC:
            raise ValueError("not a packed id file")
        n, self.n_ids, self.bits, self.block, blocks, index = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        view = self._at(index, 17 * n + 8 * (blocks + 1))
        self.doc_ids = np.frombuffer(view, "<i8", n)
        self.gone = np.frombuffer(view, np.uint8, n, 8 * n).astype(bool)
        self.ends = np.frombuffer(view[9 * n : 17 * n], "<u8").astype(np.int64)
        self.block_at = np.frombuffer(view[17 * n :], "<u8").astype(np.int64)

    def _at(self, start: int, size: int) -> bytes:
        self.src.seek(start)
        return bytes(self.src.read(size))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.block, (stop - 1) // self.block + 1
        first = int(self.block_at[lo])
        words = np.frombuffer(self._at(first, int(self.block_at[hi]) - first), "<u8")
        got = unpack(words, self.bits, min(self.n_ids, hi * self.block) - lo * self.block)
        return got[start - lo * self.block : stop - lo * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Part:
    """A file of one task: written aside and renamed when whole, so a rerun replaces its own."""

    def __init__(self, uri: str, bits: int):
        self.files, self.path = _open(uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.aside = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.files.open_output_stream(self.aside)
        self.writer = Writer(self.out, bits)

    def close(self) -> None:
        self.writer.close()
        self.out.close()
        self.files.move(self.aside, self.path)


def write_ids(docs: DataFrame, vocab: str, end_id: int = 0, folder: str | None = None, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, pack and write all texts in ascending id order; returns the manifest.

    Null texts are empty, null ids come first, equal ids are ordered by text;
    ids must be integers (text that is none fails).  Repeated rows are documents
    of their own, an empty table gives no file, other columns are not read.
    The range key ends with a hash of the text, so one id that many rows share
    is split over tasks.  The manifest has a row per file: part, seq, path,
    n_docs, n_ids, start (ids in all files before it).
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "packed-ids")
    base = id_text(docs, id_col, text_col)
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    n = parts_for(base)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        enc = encoder(vocab)
        bits = width_for(max(enc.vocab_size, end_id + 1))
        part: Part | None = None
        path = ""

        def finished() -> pa.RecordBatch:
            part.close()
            w = part.writer
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((task, pa.int32()), (seq, pa.int32()), (path, pa.string()), (len(w.ends), pa.int64()), (w.n_ids, pa.int64()))], names=["part", "seq", "path", "n_docs", "n_ids"])

        for batch in slices(batches):
            ids, off = enc.encode(batch.column(1))
            ids = np.insert(ids, off[1:], end_id)
            off = off + np.arange(len(off))
            doc_ids, at = batch.column(0).to_pylist(), 0
            while at < len(doc_ids):
                if part is None:
                    path = f"{folder}/ids-{task:06d}-{seq:05d}.ngids"
                    part = Part(path, bits)
                room = max(1, file_ids - part.writer.n_ids)
                end = max(at + 1, int(np.searchsorted(off, off[at] + room, "right")) - 1)
                part.writer.add(doc_ids[at:end], np.diff(off[at : end + 1]).tolist(), ids[off[at] : off[end]])
                at = end
                if part.writer.n_ids >= file_ids:
                    yield finished()
                    part, seq = None, seq + 1
        if part is not None:
            yield finished()

    ordered = base.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    files = ordered.drop("tie").mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long")
    files = stored(files, "packed-ids-manifest")
    # one row per file, so the window is as long as the manifest
    before: Column = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Each document from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _open(row["path"])
                with files.open_input_file(path) as src:
                    r = Reader(src)
                    begin = np.append(0, r.ends[:-1]).astype(np.int64)
                    at = 0
                    while at < len(begin):
                        end = max(at + 1, int(np.searchsorted(r.ends, begin[at] + READ_IDS, "right")))
                        lo = int(begin[at])
                        data = memoryview(r.ids(lo, int(r.ends[end - 1])).astype("<u4").tobytes())
                        crc = [zlib.crc32(data[4 * (a - lo) : 4 * (b - lo)]) for a, b in zip(begin[at:end].tolist(), r.ends[at:end].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.doc_ids[at:end], mask=r.gone[at:end]), pa.array(begin[at:end] + row["start"]), pa.array(r.ends[at:end] - begin[at:end]), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = end

    tasks = manifest.select("path", "start")
    n = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return tasks.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_files(docs: DataFrame, vocab: str, end_id: int = 0) -> DataFrame:
    """Write all texts as packed ids and report each document as read back."""
    return read_ids(write_ids(docs, vocab, end_id))
