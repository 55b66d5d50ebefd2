"""Passages of 100 bytes and more that occur again, found on enhanced suffix arrays.

Every start of 100 bytes has an anchor: the least hash of the 40-byte strings
in it.  Equal passages have equal anchors, so suffixes only need sorting
beside those of the same anchor, and an anchor that occurs once needs nothing.

    1  texts are stored in blocks; each lists its anchors, which are counted
    2  each block gets back its anchors that occur again and sends the windows
       around them (the starts with that anchor and their bytes): equal windows
       of a block go as one
    3  windows meet by anchor.  Equal ones are occurrences of one string; over
       the distinct ones a suffix array with its common prefixes is built, and
       one stack scan walks the tree of common-prefix intervals.  An interval
       whose strings are all preceded by the same byte is left to the longer
       one that starts there; the others are repeat groups, with all occurrences
    4  each block gets back what is to be removed and cuts its texts

An anchor with more than `HOT` windows is dealt out by the whole 100 bytes, of
which a block sends one each, so no task holds more than its share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.llm.storage import parts_for, stored_by
from nightgrid.llm.text import id_text, mix, raw, raw_bytes, slices

SIZE = 100  # bytes of a passage
GRAM = 40  # bytes of an anchor
REACH = SIZE - GRAM + 1
RUN = 512  # starts of one window at most
DEEP = 160  # bytes of a suffix that are compared
BLOCK_BYTES = 8 << 20
STARTS = 1 << 18
HOT = 20_000
BUCKET_CHARS = 8_000_000  # characters of all texts for each bucket of windows
FIRST = np.iinfo(np.int64).min  # place of null ids


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … of each piece, end to end."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _bytes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int = 20_000) -> np.ndarray:
    """The bytes of all pieces end to end, gathered some pieces at a time."""
    parts = [data[_ranges(begin[i : i + step], size[i : i + step])] for i in range(0, len(begin), step)]
    return np.concatenate([data[:0], *parts])


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out += b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 40 bytes and of the 100 bytes from each place."""
    h = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[data]
    width, gram = 1, None
    while width < 64:
        h = _join(h[:-width], h[width:])
        width *= 2
        if width == 32:
            gram = _join(h[: -(GRAM - 32)], h[GRAM - 32 :])
    return gram, _join(h[: -(SIZE - 64)], h[SIZE - 64 :])


def _best(values: np.ndarray, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of each REACH consecutive values."""
    width = 1
    while 2 * width <= REACH:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = REACH - width
    return pick(values[:-rest], values[rest:]) if rest else values


def _loops(gram: np.ndarray, anchor: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True for each run of starts whose anchor lies in it twice."""
    # no window around a place has a greater least than its value, and one has that value if it is the least there
    none = np.zeros(REACH - 1, np.uint64)
    least = np.flatnonzero(_best(np.concatenate([none, anchor, none]), np.maximum) == gram)
    lo, hi = np.searchsorted(least, start), np.searchsorted(least, start + size + REACH - 1)
    n = hi - lo
    ends = np.append(0, np.cumsum(n))
    at = least[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], n)]
    found = np.append(0, np.cumsum(gram[at] == np.repeat(anchor[start], n)))
    return found[ends[1:]] - found[ends[:-1]] > 1


class Windows:
    """Runs of starts with one anchor in a block: anchor, first start (in the block), starts, further starts whose bytes
    belong to it (where a long run was cut), a hash of all its bytes, and whether the anchor lies in it twice, so that
    it may repeat itself."""

    def __init__(self, data: np.ndarray, off: np.ndarray, gram_hashes: bool = False):
        parts, grams = [], []
        for lo in range(0, max(0, len(data) - SIZE + 1), STARTS):
            hi = min(lo + STARTS, len(data) - SIZE + 1)
            gram, whole = _grams(data[lo : hi + SIZE - 1])
            anchor = _best(gram)
            # starts whose bytes all lie in one text
            texts = np.arange(np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi))
            begin = np.maximum(off[texts], lo)
            at = _ranges(begin, np.maximum(np.minimum(off[texts + 1] - SIZE + 1, hi) - begin, 0)) - lo
            if not len(at):
                continue
            key = anchor[at]
            first = np.ones(len(at), bool)
            first[1:] = (key[1:] != key[:-1]) | (np.diff(at) > 1)
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, len(at)))
            # long runs (of one repeated byte, say) are cut
            pieces = -(-size // RUN)
            more = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            stop = np.repeat(begin + size, pieces)
            begin = np.repeat(begin, pieces) + more * RUN
            size = np.diff(np.append(begin, len(at)))
            more = np.minimum(stop - begin - size, DEEP - SIZE)
            spread = mix(whole[at])
            turn = np.arange(len(at), dtype=np.uint64)
            one, two = (np.append(np.uint64(0), np.cumsum(x)) for x in (spread, spread * turn))
            end = begin + size + more
            hashed = two[end] - two[begin] - begin.astype(np.uint64) * (one[end] - one[begin])
            hashed = mix(np.uint64(2) * hashed + (one[end] - one[begin]) + (size + np.int64(RUN) * more).astype(np.uint64))
            parts.append((key[begin], at[begin] + lo, size, more, hashed, _loops(gram, anchor, at[begin], size)))
            if gram_hashes:
                grams.append((at + lo, whole[at]))
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint64, bool)
        cols = (np.concatenate([np.zeros(0, kind), *[p[i] for p in parts]]) for i, kind in enumerate(kinds))
        self.anchor, self.start, self.size, self.more, self.hash, self.loop = cols
        if gram_hashes:
            self.gram_at, self.gram = (np.concatenate([g[i] for g in grams]) if grams else np.zeros(0, np.int64) for i in (0, 1))


def _firsts(columns: list[np.ndarray]) -> np.ndarray:
    """True where a run of equal rows starts."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _in_blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in slices(batches, max_bytes=1 << 20):
            n = batch.num_rows
            if size >= block_bytes:
                block, row, size = block + 1, 0, 0
            cols = [pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(np.arange(row, row + n), pa.int64()), *batch.columns]
            yield pa.RecordBatch.from_arrays(cols, ["block", "row", *batch.schema.names])
            row, size = row + n, size + batch.column("text").nbytes

    return run


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct anchors and the number of their distinct windows."""
    for batch in slices(batches):
        blocks = batch.column("block").to_numpy()
        edges = np.append(np.flatnonzero(_firsts([blocks])), len(blocks))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            w = Windows(*raw(batch.column("text").slice(lo, hi - lo)))
            order = np.lexsort((w.hash, w.anchor))
            anchor = w.anchor[order]
            # equal windows count twice at most: twice is enough to be sent, and as one of the block
            begin = np.flatnonzero(_firsts([anchor]))
            fresh = np.append(0, np.cumsum(_firsts([anchor, w.hash[order]])))
            end = np.append(begin[1:], len(anchor)) if len(begin) else begin
            n = np.minimum(end - begin, np.maximum(2, fresh[end] - fresh[begin]))
            n = np.maximum(n, 1 + np.logical_or.reduceat(w.loop[order], begin)) if len(begin) else n
            cols = [pa.array(anchor[begin].view(np.int64)), pa.repeat(pa.scalar(int(blocks[lo]), pa.int64()), len(begin)), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "block", "n"])


SENT = ["anchor", "hash", "doc_id", "block", "row", "start", "size", "more", "loop", "text"]
SENT_TYPES = [*[pa.int64()] * 8, pa.bool_(), pa.binary()]
SENT_SCHEMA = "anchor long, hash long, doc_id long, block long, row long, start long, size long, more long, loop boolean, text binary"


def _send(docs: pa.Table, replies: pa.Table, copies: bool) -> pa.Table:
    """Windows of one block whose anchors occur again.

    Equal ones after the first go without their bytes (`copies`), or joined to
    spans that the block is to lose (`more` is -1 there, `size` the length).
    """
    docs = docs.combine_chunks().sort_by("row")
    texts = docs["text"].combine_chunks() if isinstance(docs["text"], pa.ChunkedArray) else docs["text"]
    data, off = raw(texts)
    ids = pc.fill_null(docs["doc_id"], int(FIRST)).to_numpy().astype(np.int64)
    order = np.argsort(replies["anchor"].to_numpy())
    wanted, hot = replies["anchor"].to_numpy()[order], replies["hot"].to_numpy(zero_copy_only=False)[order]
    w = Windows(data, off, gram_hashes=bool(hot.any()))
    anchor = w.anchor.view(np.int64)
    place = np.minimum(np.searchsorted(wanted, anchor), max(0, len(wanted) - 1))
    known = wanted[place] == anchor if len(wanted) else np.zeros(len(anchor), bool)
    cold = known & ~hot[place] if len(wanted) else known
    cols = [anchor[cold], w.hash.view(np.int64)[cold], w.start[cold], w.size[cold], w.more[cold], w.loop[cold]]
    if hot.any():  # one window per start, found by the whole passage
        runs = np.flatnonzero(known & hot[place])
        at = _ranges(w.start[runs], w.size[runs])
        gram = w.gram[np.searchsorted(w.gram_at, at)]
        more = [gram.view(np.int64), mix(gram ^ np.uint64(SIZE)).view(np.int64), at, np.ones(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)]
        cols = [np.concatenate(x) for x in zip(cols, more)]
    key, hashed, start, size, more, loop = cols
    row = np.searchsorted(off, start, "right") - 1
    order = np.lexsort((start, row, ids[row], hashed, key))
    key, hashed, start, size, more, loop, row = (x[order] for x in (key, hashed, start, size, more, loop, row))
    lead = _firsts([key, hashed])
    if not copies:
        lost = merge_spans(0 * row[~lead], row[~lead], (start - off[row])[~lead], (start - off[row] + size + SIZE - 1)[~lead])
        at, begin, end = (lost[c].to_numpy() for c in ("row", "begin", "end"))
        none = 0 * at
        spans = [mix(at.astype(np.uint64)).view(np.int64), none, off[at] + begin, end - begin, none - 1, none.astype(bool), at]
        key, hashed, start, size, more, loop, row = (np.concatenate(x) for x in zip((x[lead] for x in (key, hashed, start, size, more, loop, row)), spans))
        lead = more >= 0
    length = np.where(lead, size + more + SIZE - 1, 0)
    ends = np.append(0, np.cumsum(length))
    held = _bytes_of(data, start, length)
    text = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(held)])
    text = pc.if_else(pa.array(lead), text.cast(pa.binary()), pa.scalar(None, pa.binary()))
    block = pa.repeat(docs["block"][0], len(key)) if docs.num_rows else pa.array([], pa.int64())
    cols = [key, hashed, ids[row], block, row, start - off[row], size, more, loop, text]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], SENT).cast(pa.schema(list(zip(SENT, SENT_TYPES))))


def suffix_array(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (of `size` bytes from `start`) inside each group, and the common prefix of each with the one before it (-1 at a group's first).

    Suffixes are sorted by big-endian words of 8 bytes; only those still tied go on to the next word.
    """
    order = np.argsort(group, kind="stable")
    start, size, group = start[order], size[order], group[order]
    first = _firsts([group])
    common = np.where(first, -1, 0).astype(np.int64)
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    inside = np.append(np.uint64(0), ~np.uint64(0) << np.arange(56, -1, -8, dtype=np.uint64))  # the first n bytes of a word
    live, depth = np.arange(len(order)), 0
    tie = np.cumsum(first) - 1
    while len(live):
        more = np.bincount(tie)[tie] > 1  # ties of one are done
        live, tie = live[more], np.cumsum(_firsts([tie[more]])) - 1
        if not len(live) or depth >= size[live].max():
            break
        left = np.clip(size[live] - depth, 0, 8)
        word = words[np.where(left > 0, start[live] + depth, 0)] & inside[left]
        head = np.flatnonzero(_firsts([tie]))
        mixed = np.zeros(len(head), bool)
        mixed[tie[word != word[head][tie]]] = True
        part = np.flatnonzero(mixed[tie])  # only ties that come apart are sorted
        by = part[np.lexsort((word[part], tie[part]))]
        for x in (order, start, size):
            x[live[part]] = x[live[by]]
        word[part] = word[by]
        fresh = _firsts([tie])
        split = ~fresh
        split[1:] &= word[1:] != word[:-1]
        at = np.flatnonzero(split)
        apart = word[at] ^ word[at - 1]
        equal = np.zeros(len(at), np.int64)
        for i in range(1, 8):
            equal[apart >> np.uint64(64 - 8 * i) == 0] = i
        common[live[~fresh]] = depth + 8
        common[live[at]] = depth + equal
        tie = np.cumsum(fresh | split) - 1
        depth += 8
    near = np.flatnonzero(common >= 0)
    common[near] = np.minimum(common[near], np.minimum(size[near], size[near - 1]))
    return order, common


def intervals(common: np.ndarray, left: np.ndarray, rank: np.ndarray, least: int = SIZE):
    """Tree of common-prefix intervals by one stack scan: (first, last, length, losers) of each whose left extensions differ.

    `left` holds the byte before each suffix, -1 where none can be shared;
    `losers` are the members that come after another one of the interval and
    after none in a longer interval, so each member is in at most one such list.
    """
    out, stack = [], []  # of [length, first, left, best, losers]
    deep = np.append(common >= least, False)
    steps = np.flatnonzero(deep | np.append(False, deep[:-1]))  # all others start and end nothing
    before = np.maximum(steps - 1, 0)
    depths = np.append(common, -1)[steps].tolist()
    sides, rank = left[before].tolist(), rank.tolist()
    for i, depth, side in zip(steps.tolist(), depths, sides):
        first = best = i - 1
        while stack and stack[-1][0] > depth:
            length, first, other, old, lost = stack.pop()
            worse, best = (best, old) if rank[old] < rank[best] else (old, best)
            lost.append(worse)
            side = other if other == side else -1
            if side < 0:
                out.append((first, i - 1, length, lost))
        if depth >= least:
            if stack and stack[-1][0] == depth:
                top = stack[-1]
                worse, top[3] = (best, top[3]) if rank[top[3]] < rank[best] else (top[3], best)
                top[4].append(worse)
                top[2] = top[2] if top[2] == side else -1
            else:
                stack.append([depth, first, side, best, []])
    return out


def _resolve(groups: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        spans = table.filter(pc.less(table["more"], 0))
        table = table.filter(pc.greater_equal(table["more"], 0)).combine_chunks()
        key, hashed, ids, block, row, start, size, more, loop = (table[c].to_numpy(zero_copy_only=False) for c in SENT[:9])
        order = np.lexsort((start, row, block, ids, hashed, key))
        key, hashed, ids, block, row, start, size, more, loop = (x[order] for x in (key, hashed, ids, block, row, start, size, more, loop))
        lead = _firsts([key, hashed])
        member = np.cumsum(lead) - 1  # which distinct window each row is
        lead = np.flatnonzero(lead)
        copies = np.diff(np.append(lead, len(key)))
        # the bytes of a distinct window lie with one of its rows at least
        text = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
        held = pc.is_valid(text).to_numpy(zero_copy_only=False)[order]
        having = np.full(len(lead), -1)
        rows = np.flatnonzero(held)[::-1]
        having[member[rows]] = rows
        # suffixes of the windows that share an anchor with a different one, or may repeat themselves
        number = np.cumsum(_firsts([key[lead]])) - 1
        pick = np.flatnonzero((np.bincount(number)[number] > 1) | loop[lead])
        data, off = raw_bytes(text.take(pa.array(order[having[pick]])))
        count = size[lead[pick]]
        owner = np.repeat(pick, count)
        shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(off[:-1], count) + shift
        length = np.repeat(off[1:], count) - at
        sa, common = suffix_array(data, at, np.minimum(length, DEEP), number[owner])
        owner, shift, at, length = owner[sa], shift[sa], at[sa], length[sa]
        # nothing longer starts further left at the edge of a window, or where the suffix there is not compared to its end
        edge = (shift == 0) | (length >= DEEP)
        left = np.full(len(at), -1, np.int64)
        left[~edge] = data[at[~edge] - 1]
        rank = np.empty(len(sa), np.int64)
        rank[np.lexsort((start[lead[owner]] + shift, row[lead[owner]], block[lead[owner]], ids[lead[owner]]))] = np.arange(len(sa))
        found = intervals(common, left, rank)
        if groups:
            # equal windows, unless a group of the tree holds all of the string
            deepest = np.maximum(common, np.append(common[1:], -1))
            leaf = np.flatnonzero(edge & (copies[owner] > 1) & (deepest < np.minimum(length, DEEP)))
            rest = np.setdiff1d(np.flatnonzero(copies > 1), pick)
            leaves = [(owner[leaf], shift[leaf], np.minimum(length[leaf], DEEP)), (rest, 0 * rest, (size + more)[lead[rest]] + SIZE - 1)]
            return _group_rows(found, [np.concatenate(x) for x in zip(*leaves)], lead, copies, owner, shift, ids, start)
        lose = np.array([x for f in found for x in f[3]], np.int64)
        span = np.array([f[2] for f in found for _ in f[3]], np.int64)
        later = np.ones(len(key), bool)
        later[lead] = False  # every copy of a window but the first
        who = np.concatenate([np.flatnonzero(later), lead[owner[lose]]])
        begin = np.concatenate([start[later], start[lead[owner[lose]]] + shift[lose]])
        end = begin + np.concatenate([size[later] + SIZE - 1, span])
        lost = [spans[c].to_numpy() for c in ("block", "row", "start", "size")]
        parts = zip((block[who], row[who], begin, end), (*lost[:3], lost[2] + lost[3]))
        return merge_spans(*(np.concatenate(p) for p in parts))

    return run


def _group_rows(found, leaves, lead, copies, owner, shift, ids, start) -> pa.Table:
    """Every occurrence of every group: its string is named by its first occurrence and its length."""
    out = {c: [] for c in ("first_doc", "first_start", "length", "doc_id", "start")}
    sets = [(lead[k] + np.arange(copies[k]), np.full(copies[k], move), length) for k, move, length in zip(*(x.tolist() for x in leaves))]
    for lo, hi, length, _ in found:
        own = owner[lo : hi + 1]
        n = copies[own]
        rows = np.repeat(lead[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sets.append((rows, np.repeat(shift[lo : hi + 1], n), length))
    for rows, move, length in sets:
        begin = start[rows] + move
        first = np.lexsort((begin, ids[rows]))[0]
        for c, v in zip(out, (ids[rows][first], begin[first], length)):
            out[c].append(np.full(len(rows), v))
        out["doc_id"].append(ids[rows])
        out["start"].append(begin)
    return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for c, v in out.items()})


def merge_spans(block: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """Union of spans of each document; spans that touch are one."""
    order = np.lexsort((begin, row, block))
    block, row, begin, end = (x[order] for x in (block, row, begin, end))
    doc = np.cumsum(_firsts([block, row])) if len(block) else block
    # ends of one document never reach into the next
    reach = np.int64(1) << np.int64(40)
    top = np.maximum.accumulate(end + doc * reach) if len(end) else end
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] + doc[1:] * reach > top[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(begin)) - 1 if len(at) else at
    return pa.table([pa.array(x, pa.int64()) for x in (block[at], row[at], begin[at], top[last] - doc[last] * reach)], ["block", "row", "begin", "end"])


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Documents of one block without their spans."""
    docs, spans = docs.combine_chunks().sort_by("row"), spans.combine_chunks()
    spans = merge_spans(*(spans[c].to_numpy() for c in ("block", "row", "begin", "end")))
    row, begin, end = (spans[c].to_numpy() for c in ("row", "begin", "end"))
    data, off = raw(docs["text"].combine_chunks() if isinstance(docs["text"], pa.ChunkedArray) else docs["text"])
    edge = np.searchsorted(row, np.arange(docs.num_rows + 1))
    removed, texts, shas = [], [], []
    for d, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        text = data[off[d] : off[d + 1]]
        if hi > lo:
            keep = np.ones(len(text), bool)
            for x, y in zip(begin[lo:hi].tolist(), end[lo:hi].tolist()):
                keep[x:y] = False
            removed.append(int((~keep).sum()))
            text = text[keep]
        else:
            removed.append(0)
        texts.append(text.tobytes())
        shas.append(hashlib.sha256(texts[-1]).hexdigest())
    cols = [docs["doc_id"], pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(np.diff(edge), pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary())]
    return pa.table(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Documents in numbered blocks, stored by block: (block, row, doc_id, text); and the buckets their windows need."""
    texts = id_text(docs, id_col, text_col)
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = parts_for(texts, chars=BUCKET_CHARS)
    slots = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored_by(texts.mapInArrow(_in_blocks(block_bytes), "block long, row long, doc_id long, text string"), "repeats", "block", slots), buckets


def windows_by_anchor(blocks: DataFrame, buckets: int, hot: int, copies: bool):
    """Windows of all anchors that occur again, grouped by anchor."""
    anchors = blocks.select("block", "text").mapInArrow(_anchor_rows, "anchor long, block long, n int")
    total = F.sum("n").over(Window.partitionBy("anchor"))  # a row per block and anchor
    again = anchors.withColumn("total", total).where(F.col("total") > 1)
    again = again.select("block", "anchor", (F.col("total") > hot).alias("hot"))

    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return _send(docs, replies, copies)

    sent = blocks.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(send, SENT_SCHEMA)
    return sent.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Maximal repeat groups with all their occurrences: (first_doc, first_start, length, doc_id, start).

    A group is a string of 100 bytes or more that occurs twice or more, named
    by its first occurrence and its length.  It cannot be extended to the left
    or right inside its anchor windows; a repeat longer than a window comes as
    groups that overlap by 99 bytes.
    """
    sent = windows_by_anchor(*in_blocks(docs, id_col, text_col, block_bytes), hot, copies=True)
    schema = "first_doc long, first_start long, length long, doc_id long, start long"
    rows = sent.applyInArrow(_resolve(True), schema)
    return rows.select(*[F.nullif(F.col(c), F.lit(int(FIRST))).alias(c) if c.endswith("doc") or c == "doc_id" else c for c in rows.columns])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without the passages that occur earlier: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    A byte goes if a string of 100 bytes that covers it also starts earlier: in
    a smaller doc_id, or in the same document further left.  Texts are UTF-8
    bytes; what is left need not be UTF-8.  Null and empty texts stay empty;
    null ids come before all others, and ids must be integers.  Rows that
    repeat an id are documents of their own, in the order in which they were
    stored.  An empty table gives no rows.  Only the id and the text are read,
    so no other column can clash.  Texts may be of any length; long ones are
    hashed piece by piece.
    """
    blocks, buckets = in_blocks(docs, id_col, text_col, block_bytes)
    spans = windows_by_anchor(blocks, buckets, hot, copies=False).applyInArrow(_resolve(False), "block long, row long, begin long, end long")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut, schema)
