"""Context-tree weighting over byte contexts, trained on a whole corpus.

A text is modelled as its lower-cased words with one space between them and one
line feed as its end.  Each byte is eight binary decisions; every context of 0
to DEPTH preceding bytes holds, for each decision, Krichevsky-Trofimov counts.
The weighted probability of a node is half its own estimate and half the
product of its children's, so all depths are mixed by what the training texts
say about them; what a context never seen would get stays with the longest one
that was.  The score is the log10 probability of the text under the
mixture after training.

n-grams are kept with their context newest byte first: in that order every
context is one stretch, and so is every subtree.

    1  documents are written in blocks of bounded size; each block lists its
       distinct words and n-grams with their training counts, and tells every
       so many n-grams where the list stands
    2  these marks cut the order into ranges; each block's list goes to the
       ranges in packed pieces, and words are counted over all blocks
    3  a range builds the contexts that lie inside it alone; of those that reach
       over its ends it gives partial sums, at most 255 nodes a depth and end
    4  the few contexts over range ends are finished by one aggregate or join a
       depth; then each range passes the mixture down and packs the
       probabilities of each block's n-grams
    5  each block scores its documents

Nothing that grows with the corpus is broadcast or collected but the range ends:
eight bytes for each RANGE_GRAMS n-grams of the lists.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.llm.storage import shared_folder, stored
from nightgrid.llm.text import codes, id_text, raw, slices, split_words

DEPTH = 5
BLOCK_BYTES = 4 << 20
END = 10
STATS = ["block", "pos", "word", "gram", "n"]
#: n-grams of block lists in a range
RANGE_GRAMS = 1 << 19
#: marks that a range's worth of n-grams gives
MARKS = 64
#: words whose counts a task holds before it packs them by block
LIST_WORDS = 1 << 20
#: counts whose log-gamma values come from a table
SMALL = 4096
LOG_HALF = np.append(0.0, np.cumsum(np.log(np.arange(SMALL - 1) + 0.5))) + 0.5 * math.log(math.pi)
LOG_WHOLE = np.append(0.0, np.cumsum(np.log(np.arange(1.0, SMALL))))
PIECES = "range long, block long, size int, gram binary, n binary"
REPLIES = "block long, range long, size int, logs binary"


def byte_stream(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """n-grams of depth + 1 bytes, one for each byte of each text; where each text's start; the words; where each text's start."""
    flat, off = split_words(texts, lower=True)
    data, at = raw(flat)
    n = np.diff(off)
    # what follows each word: a space, or the end after a text's last one
    after = np.full(len(flat), 32, np.uint8)
    after[off[1:][n > 0] - 1] = END
    bare = at[off[:-1][n == 0]]  # texts without words are their end alone
    heads = np.repeat(at[off[:-1]], depth)
    place = np.concatenate([at[1:], bare, heads])
    value = np.concatenate([after, np.full(len(bare) + len(heads), END, np.uint8)])
    # inserted bytes by text, then heads before words before ends
    owner = np.concatenate([np.repeat(np.arange(len(n)), n), np.flatnonzero(n == 0), np.repeat(np.arange(len(n)), depth)])
    kind = np.concatenate([np.ones(len(flat) + len(bare), np.int8), np.zeros(len(heads), np.int8)])
    order = np.lexsort((kind, place, owner))
    stream = np.insert(data, place[order], value[order]).astype(np.uint64)
    size = np.diff(at[off]) + np.maximum(n, 1)
    begin = np.append(0, np.cumsum(size + depth))
    m = len(stream) - depth
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), flat, off
    keys = np.zeros(m, np.uint64)
    for i in range(depth + 1):
        keys = (keys << np.uint64(8)) | stream[i : m + i]
    real = np.ones(m, bool)  # windows that end on a byte of a text, not on the bytes before one
    heads = (begin[1:-1, None] + np.arange(depth) - depth).reshape(-1)
    real[heads] = False
    return keys[real], np.append(0, np.cumsum(size)), flat, off


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def newest_first(keys: np.ndarray, depth: int) -> np.ndarray:
    """n-grams with the bytes of their context in reverse, the last byte still last."""
    out = keys & np.uint64(255)
    for i in range(depth):
        out |= ((keys >> np.uint64(8 * i + 8)) & np.uint64(255)) << np.uint64(8 * (depth - i))
    return out


def packed(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind=np.uint64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view(kind).reshape(-1)


def _block_stats(rows: pa.Table, depth: int, block: int, folder: str, step: int) -> Iterator[pa.RecordBatch]:
    """Words of a block with their counts in its training texts, and every `step`th of its n-grams as a mark.

    `pos` is the place in the block's list, which the scorer builds again: words
    in order of appearance, n-grams in ascending order.  The whole list of
    n-grams is written beside the block.
    """
    held = rows.column("held_out").to_numpy()
    keys, at, flat, off = byte_stream(rows.column("text").combine_chunks(), depth)
    taught = ~np.repeat(held, np.diff(off))
    if len(flat):
        number, words = codes(flat)
        n = np.bincount(number[taught], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), words.cast(pa.string()), pa.nulls(len(words), pa.int64()), pa.array(n)], names=STATS)
    keys = newest_first(keys, depth)
    grams = distinct(keys)
    taught = np.sort(keys[~np.repeat(held, np.diff(at))])
    n = np.searchsorted(taught, grams, "right") - np.searchsorted(taught, grams, "left")
    _put(folder, f"grams-{block}", pa.table({"gram": np.diff(grams, prepend=np.uint64(0)), "n": n}))
    marks = grams[::step]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(marks), block)), pa.array(np.arange(len(marks), dtype=np.int32)), pa.nulls(len(marks), pa.string()), pa.array(marks.view(np.int64)), pa.nulls(len(marks), pa.int64())], names=STATS)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, rows: pa.Table) -> None:
    files, path = _open(f"{folder}/{name}.arrow")
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(aside) as out, pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
        sink.write_table(rows)
    files.move(aside, path)


def _get(folder: str, name: str) -> pa.Table:
    files, path = _open(f"{folder}/{name}.arrow")
    with files.open_input_file(path) as src:
        return pa.ipc.open_file(src).read_all()


def write_blocks(docs: DataFrame, folder: str, depth: int, block_bytes: int, step: int) -> DataFrame:
    """Write (doc_id, text, held_out) in blocks of about `block_bytes`; rows block, pos, word and n or a mark's gram."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            _put(folder, f"block-{block}", rows)
            yield from _block_stats(rows, depth, block, folder, step)

        for batch in slices(batches, max_bytes=min(block_bytes, 2 << 20)):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if size >= block_bytes:
                yield from full()
                held, size, block = [], 0, block + 1
        if held:
            yield from full()

    return docs.mapInArrow(work, "block long, pos int, word string, gram long, n long")


def word_counts(words: DataFrame) -> DataFrame:
    """(block, pos, word, n) to packed lists (block, size, pos, c) where c, the count over all blocks, isn't n.

    Rows of block -1 hold sums by task in `sums`: distinct words in training and all of them.
    """
    over = Window.partitionBy("word")
    rows = words.withColumn("c", F.sum("n").over(over)).withColumn("first", F.row_number().over(over.orderBy("block")) == 1)

    def lists(told: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, pos, c = (np.concatenate(x).astype(np.int64) for x in zip(*told))
        order = np.argsort(block, kind="stable")
        block, pos, c = block[order], pos[order], c[order]
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        cuts = list(zip(first, np.append(first[1:], len(block))))
        cols = [pa.array([packed(x[a:b]) for a, b in cuts], pa.binary()) for x in (pos, c)]
        sizes = np.array([b - a for a, b in cuts], np.int32)
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(sizes), *cols, pa.nulls(len(cuts), pa.list_(pa.int64()))], names=["block", "size", "pos", "c", "sums"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct_words = total = held = 0
        told: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            block, pos, n, c = (batch.column(i).to_numpy() for i in range(4))
            first = batch.column(4).to_numpy(zero_copy_only=False)
            distinct_words += int((first & (c > 0)).sum())
            total += int(n.sum())
            new = n != c
            told.append((block[new], pos[new], c[new]))
            held += int(new.sum())
            if held >= LIST_WORDS:
                yield lists(told)
                told, held = [], 0
        if held:
            yield lists(told)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0], pa.int32()), pa.array([b""]), pa.array([b""]), pa.array([[distinct_words, total]])], names=["block", "size", "pos", "c", "sums"])

    return rows.select("block", "pos", "n", "c", "first").mapInArrow(work, "block long, size int, pos binary, c binary, sums array<long>")


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1/2: Stirling's series from x + 7 on."""
    z = x + 7.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    rise = x
    for i in range(1, 7):
        rise = rise * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(rise)


def log_kt(n0: Column, n1: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def range_ends(marks: DataFrame, ranges: int) -> np.ndarray:
    """Where to cut the order of n-grams into about `ranges` equal parts; a whole context stays on one side."""
    if ranges < 2:
        return np.zeros(0, np.uint64)
    cuts = marks.agg(F.percentile_approx("gram", [i / ranges for i in range(1, ranges)], max(10_000, 8 * ranges)).alias("cuts")).first()["cuts"]
    return distinct(np.array([c >> 8 << 8 for c in cuts if c >> 8], np.uint64))


def list_pieces(blocks: DataFrame, folder: str, ends: np.ndarray) -> DataFrame:
    """Each block's list cut at the range ends: differences and counts, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                rows = _get(folder, f"grams-{block}")
                grams, n = np.cumsum(rows.column("gram").to_numpy(), dtype=np.uint64), rows.column("n").to_numpy()
                cuts = np.concatenate([[0], np.searchsorted(grams, ends), [len(grams)]])
                out = [(r, block, b - a, packed(np.diff(grams[a:b], prepend=np.uint64(0))), packed(n[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["range", "block", "size", "gram", "n"])

    return blocks.mapInArrow(work, PIECES)


def _np_log_gamma(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    """Natural logarithm of the gamma function of n + more, `table` holding it for n < SMALL."""
    out = table[np.minimum(n, SMALL - 1).astype(np.int64)]
    big = np.flatnonzero(n >= SMALL)
    z = n[big] + more
    out[big] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    return out


def _np_log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _np_log_gamma(n0, LOG_HALF, 0.5) + _np_log_gamma(n1, LOG_HALF, 0.5) - _np_log_gamma(n0 + n1, LOG_WHOLE, 1.0) - math.log(math.pi)


class Stretch:
    """The contexts of one range of sorted n-grams with counts, from `depth` bytes to none.

    Level d holds the distinct pairs of a context of d bytes and a last byte.
    All pairs of a tree node lie side by side, for every one of the eight
    decisions.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, lo: int, hi: int):
        self.depth, self.lo, self.hi = depth, lo, hi
        self.keys, self.n, self.up = [grams], [n], []
        for _ in range(depth):
            k = self.keys[-1]
            short, up = np.unique((k >> np.uint64(16) << np.uint64(8)) | (k & np.uint64(255)), return_inverse=True)
            self.keys.append(short)
            self.up.append(up)
            self.n.append(np.bincount(up, weights=self.n[-1], minlength=len(short)))

    def nodes(self, i: int) -> list[dict[str, np.ndarray]]:
        """Nodes of decision i, deepest level first; `over` marks those whose context reaches over an end of the range.

        For these `below` sums only children inside.
        """
        levels: list[dict[str, np.ndarray]] = []
        below = None
        for at in range(self.depth + 1):
            d = self.depth - at
            keys, n = self.keys[at], self.n[at]
            head = keys >> np.uint64(8 - i)
            new = np.append(True, head[1:] != head[:-1])
            first, run = np.flatnonzero(new), np.cumsum(new) - 1
            n1 = np.add.reduceat(n * ((keys >> np.uint64(7 - i)) & np.uint64(1)), first)
            n0 = np.add.reduceat(n, first) - n1
            head = head[first]
            context, shift = head >> np.uint64(i), np.uint64(8 * (self.depth - d) + 8)
            over = ((context << shift) < np.uint64(self.lo)) | (((context + np.uint64(1)) << shift) > np.uint64(self.hi))
            own = _np_log_kt(n0, n1)
            if at:
                prior = levels[-1]
                prior["parent"] = run[self.up[at - 1][prior["first"]]]
                below = np.bincount(prior["parent"], weights=np.where(prior["over"], 0.0, prior["weighted"]), minlength=len(first))
                gap = below - own
                weighted = math.log(0.5) + np.maximum(own, below) + np.log1p(np.exp(-np.abs(gap)))
                stop = 1 / (1 + np.exp(np.minimum(gap, 700.0)))
            else:
                below, weighted, stop = np.zeros(len(first)), own, np.ones(len(first))
            pos = np.uint64(1 << i) | (head & np.uint64((1 << i) - 1))
            levels.append({"first": first, "run": run, "node": (context << np.uint64(8)) | pos, "n0": n0, "n1": n1, "below": below, "weighted": weighted, "stop": stop, "over": over})
        return levels

    def open_nodes(self) -> list[tuple]:
        """(level, node, n0, n1, below) of all nodes over an end."""
        out = []
        for i in range(8):
            for at, level in enumerate(self.nodes(i)):
                o = np.flatnonzero(level["over"])
                out.extend(zip([self.depth - at] * len(o), *(level[c][o].tolist() for c in ("node", "n0", "n1", "below"))))
        return out

    def logs(self, mixed: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
        """log10 of the mixture's probability of each n-gram's last byte; `mixed` has node, p, rest, last of nodes over an end by level."""
        out = np.zeros(len(self.keys[0]))
        for i in range(8):
            p = rest = last = None
            levels = self.nodes(i)
            for at in range(self.depth, -1, -1):
                level = levels[at]
                total = level["n0"] + level["n1"]
                kt, stop = (level["n1"] + 0.5) / (total + 1), level["stop"]
                if at == self.depth:
                    p, rest, last = stop * kt, 1 - stop, kt
                else:
                    up, seen = level["parent"], total > 0
                    p, rest, last = p[up], rest[up], last[up]
                    p, rest, last = p + rest * np.where(seen, stop * kt, last), np.where(seen, rest * (1 - stop), 0.0), np.where(seen, kt, last)
                o = np.flatnonzero(level["over"])
                if len(o):
                    node, *values = mixed[self.depth - at]
                    found = np.searchsorted(node, level["node"][o])
                    p[o], rest[o], last[o] = (v[found] for v in values)
            each = p[levels[0]["run"]]
            bit = (self.keys[0] >> np.uint64(7 - i)) & np.uint64(1)
            out += np.log10(np.where(bit == 1, each, 1 - each))
        return out


def _limits(ends: np.ndarray, r: int, depth: int) -> tuple[int, int]:
    return int(ends[r - 1]) if r else 0, int(ends[r]) if r < len(ends) else 1 << (8 * depth + 8)


def build_ranges(pieces: DataFrame, folder: str, ends: np.ndarray, depth: int) -> DataFrame:
    """Merge each range's pieces, write them with the counts; rows of nodes over its ends and one of level -1."""

    def work(rows: pa.Table) -> pa.Table:
        r = rows.column("range")[0].as_py()
        sizes = rows.column("size").to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(g.as_py(), s), dtype=np.uint64) for g, s in zip(rows.column("gram"), sizes)])
        n = np.concatenate([unpacked(c.as_py(), s, np.int64) for c, s in zip(rows.column("n"), sizes)])
        grams, where = np.unique(keys, return_inverse=True)
        n = np.bincount(where, weights=n, minlength=len(grams))
        _put(folder, f"pieces-{r}", rows.select(["block", "size", "gram"]))
        _put(folder, f"range-{r}", pa.table({"gram": np.diff(grams, prepend=np.uint64(0)), "n": n}))
        out = [(-1, 0, 0.0, 0.0, 0.0), *Stretch(grams, n, depth, *_limits(ends, r, depth)).open_nodes()]
        level, node, n0, n1, below = zip(*out)
        return pa.table({"range": pa.array([r] * len(out), pa.int64()), "level": pa.array(level, pa.int32()), "node": pa.array(node, pa.int64()), "n0": n0, "n1": n1, "below": below})

    return pieces.repartition(len(ends) + 1, "range").groupBy("range").applyInArrow(work, "range long, level int, node long, n0 double, n1 double, below double")


def mix_open_nodes(parts: DataFrame, depth: int) -> DataFrame:
    """(level, node, p, rest, last) of the nodes over range ends: sums from the deepest level up, then the mixture down."""
    parent = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
    total = stored(parts.where("level >= 0").groupBy("level", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")), "ctw-open")
    own = log_kt(F.col("n0"), F.col("n1"))
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    gap = F.col("below") - F.col("own")
    half = math.log(0.5) + F.greatest("own", "below") + F.log1p(F.exp(-F.abs(gap)))
    levels: dict[int, DataFrame] = {}
    for d in range(depth - 1, -1, -1):
        here = total.where(F.col("level") == d)
        if d + 1 in levels:
            more = levels[d + 1].groupBy(parent.alias("node")).agg(F.sum("weighted").alias("more"))
            here = here.join(more, "node", "left").withColumn("below", F.col("below") + F.coalesce("more", F.lit(0.0)))
        stop = 1 / (1 + F.exp(F.least(gap, F.lit(700.0))))
        levels[d] = stored(here.withColumn("own", own).select("level", "node", half.alias("weighted"), stop.alias("stop"), kt.alias("kt"), (F.col("n0") + F.col("n1") > 0).alias("seen")), "ctw-level")
    p, rest, last = F.col("p"), F.col("rest"), F.col("last")
    mixed = levels[0].select("level", "node", (F.col("stop") * F.col("kt")).alias("p"), (1 - F.col("stop")).alias("rest"), F.col("kt").alias("last"))
    out = mixed
    for d in range(1, depth):
        up = mixed.select(F.col("node").alias("parent"), "p", "rest", "last")
        mixed = stored(
            levels[d].withColumn("parent", parent).join(up, "parent").select(
                "level", "node",
                (p + rest * F.when(F.col("seen"), F.col("stop") * F.col("kt")).otherwise(last)).alias("p"),
                F.when(F.col("seen"), rest * (1 - F.col("stop"))).otherwise(0.0).alias("rest"),
                F.when(F.col("seen"), F.col("kt")).otherwise(last).alias("last"),
            ),
            "ctw-mixed",
        )
        out = out.unionByName(mixed)
    return out


def range_logs(mixed: DataFrame, folder: str, ends: np.ndarray, depth: int) -> DataFrame:
    """The logarithms of each range's n-grams, packed for each block in the order of its list."""

    def work(rows: pa.Table) -> pa.Table:
        r = rows.column("range")[0].as_py()
        level, *values = (rows.column(c).to_numpy() for c in ("level", "node", "p", "rest", "last"))
        given = {}
        for d in range(depth):
            mine = np.flatnonzero(level == d)
            mine = mine[np.argsort(values[0][mine])]
            given[d] = (values[0][mine].astype(np.uint64), *(v[mine] for v in values[1:]))
        tree = _get(folder, f"range-{r}")
        grams = np.cumsum(tree.column("gram").to_numpy(), dtype=np.uint64)
        logs = Stretch(grams, tree.column("n").to_numpy(), depth, *_limits(ends, r, depth)).logs(given)
        pieces = _get(folder, f"pieces-{r}")
        told = [packed(logs[np.searchsorted(grams, np.cumsum(unpacked(g.as_py(), s.as_py()), dtype=np.uint64))]) for g, s in zip(pieces.column("gram"), pieces.column("size"))]
        return pa.table({"block": pieces.column("block"), "range": pa.array([r] * len(told), pa.int64()), "size": pieces.column("size"), "logs": pa.array(told, pa.binary())})

    return mixed.repartition(len(ends) + 1, "range").groupBy("range").applyInArrow(work, REPLIES)


def _scorer(folder: str, depth: int):
    def score(reply: pa.Table) -> pa.Table:
        block = reply.column("block")[0].as_py()
        rows = _get(folder, f"block-{block}")
        held = rows.column("held_out").to_numpy()
        keys, at, flat, off = byte_stream(rows.column("text").combine_chunks(), depth)
        keys = newest_first(keys, depth)
        is_word = pc.is_null(reply.column("logs"))
        told = reply.filter(pc.invert(is_word)).sort_by("range")
        logs = np.concatenate([unpacked(x.as_py(), s.as_py(), np.float64) for x, s in zip(told.column("logs"), told.column("size"))])
        order = np.argsort(keys)
        known = keys[order]
        each = np.empty(len(keys))
        each[order] = logs[np.cumsum(np.append(False, known[1:] != known[:-1]))]
        total = np.add.reduceat(each, at[:-1])
        n, logc, seen = np.diff(off), np.zeros(len(held)), np.zeros(len(held), np.int64)
        if len(flat):
            number, words = codes(flat)
            count = np.bincount(number[~np.repeat(held, n)], minlength=len(words))
            for size, pos, c in zip(*(reply.filter(is_word).column(x).to_pylist() for x in ("size", "pos", "c"))):
                count[unpacked(pos, size, np.int64)] = unpacked(c, size, np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            logc = np.bincount(owner, weights=np.log10(count + 1.0)[number], minlength=len(n))
            seen = np.bincount(owner, weights=(count > 0)[number], minlength=len(n)).astype(np.int64)
        return pa.table([rows.column("doc_id"), rows.column("held_out"), pa.array(n), pa.array(seen), pa.array(logc), pa.array(total), pa.array(np.diff(at))], names=["doc_id", "held_out", "words", "seen", "logc", "score", "bytes"])

    return score


def score_texts(docs: DataFrame, held_out: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_grams: int = RANGE_GRAMS) -> DataFrame:
    """Score all whole texts, learning from those where `held_out` (over doc_id) is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    word model), score (log10 probability) and bits_per_byte (code length).  A null
    text is empty: its end alone.  Rows of one id are scored each; an empty table
    gives no rows.  `depth` is at most 6.
    """
    base = id_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    kind = base.schema["doc_id"].dataType.simpleString()
    folder = shared_folder(base.sparkSession, "ctw-blocks")
    step = max(1, range_grams // MARKS)
    stats = stored(write_blocks(base, folder, depth, block_bytes, step), "ctw-stats")
    words = stored(word_counts(stats.where("word is not null").select("block", "pos", "word", "n")), "ctw-words")
    taught = base.where(~F.col("held_out")).count()
    sums = words.where("block = -1").agg(F.sum(F.col("sums")[0]).alias("c"), F.sum(F.col("sums")[1]).alias("n")).first()
    n = (sums["n"] or 0) + taught
    v = (sums["c"] or 0) + (1 if taught else 0)
    marks = stats.where("gram is not null").select("block", "pos", "gram")
    size = marks.agg(F.count(F.lit(1)).alias("marks"), F.count_distinct("block").alias("blocks")).first()
    ends = range_ends(marks, math.ceil(size["marks"] * step / range_grams))
    blocks = marks.where("pos = 0").select("block").repartition(max(1, size["blocks"] // 2), "block")
    parts = stored(build_ranges(list_pieces(blocks, folder, ends), folder, ends, depth), "ctw-parts")
    given = parts.where("level < 0").select("range", "level", "node", *[F.lit(0.0).alias(c) for c in ("p", "rest", "last")])
    if len(ends):
        given = given.unionByName(parts.where("level >= 0").select("range", "level", "node").join(mix_open_nodes(parts, depth), ["level", "node"]))
    told = range_logs(given, folder, ends, depth)
    told = told.unionByName(words.where("block >= 0").select("block", "size", "pos", "c"), allowMissingColumns=True)
    out = f"doc_id {kind}, held_out boolean, words long, seen long, logc double, score double, bytes long"
    got = told.groupBy("block").applyInArrow(_scorer(folder, depth), out)
    tokens = F.col("words") + 1  # the end of a text is a token
    return got.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("seen") + (1 if taught else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logc") + math.log10(taught + 1) - tokens * math.log10(n + v + 1)).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )
