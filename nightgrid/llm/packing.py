"""Best-fit-decreasing packing whose bin counts are certified by lower bounds.

Pieces are dealt to partitions and packed there.  A dual-feasible function
turns the piece lengths into a lower bound on any packing.  A partition whose
bin count equals its bound is certified and offers only its unfilled bins.  The
others have a gap and exchange more of their documents.  Best-fit decreasing
runs again on what is exchanged, over ever fewer partitions, down to one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.storage import stored
from nightgrid.llm.text import id_text, slices
from nightgrid.llm.tokens import encoder

CAPACITY = 1024
DEAL_PIECES = 50_000  # pieces in one packing task
ROUNDS = 6


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs.

    With threshold e the dual-feasible function sends lengths above
    capacity - e to capacity, those under e to 0, and keeps the rest; the best
    threshold counts.  e = 0 is the plain volume bound.
    """
    count = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1).astype(np.int64)
    n_above = np.append(np.cumsum(count[::-1])[::-1], 0)  # n_above[v]: lengths >= v
    s_above = np.append(np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1], 0)
    e = np.arange(capacity // 2 + 1)
    big = n_above[capacity - e + 1]
    middle = s_above[e] - s_above[capacity - e + 1]
    return int((big - (-middle // capacity)).max(initial=0))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins."""
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set while some bin has r tokens free
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    order = np.argsort(-np.asarray(lengths), kind="stable")
    for i, size in zip(order.tolist(), np.asarray(lengths)[order].tolist()):
        fit = mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = free_bins[free].pop()
            if not free_bins[free]:
                mask ^= 1 << free
        else:
            b, free, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            free_bins[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def pieces(docs: DataFrame, vocab: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all texts: doc_id, piece, start, length, ids_crc32.

    Null texts are empty and give the end id alone.  A longer document has
    pieces of `capacity` ids; only its first one may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in slices(batches):
            ids, off = enc.encode(batch.column(1))
            ids = np.insert(ids, off[1:], end_id).astype("<u4")
            off = off + np.arange(len(off))
            size = np.diff(off)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = size - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            data, lo = memoryview(ids.tobytes()), off[row] + start
            crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(lo.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    base = id_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def settled(bins: np.ndarray, size: np.ndarray, used: int, capacity: int, certified: bool) -> np.ndarray:
    """Bins that a partition keeps when others are still to be filled.

    The fullest stay, as long as they waste a quarter of a bin together.  A
    certified partition gives up only the rest, whose room others can use.
    One with a gap gives up as many again, those of the smallest pieces: small
    pieces are what the next best fit closes its bins with.
    """
    filled = np.bincount(bins, weights=size, minlength=used).astype(np.int64)
    order = np.argsort(-filled, kind="stable")
    keep = np.zeros(used, bool)
    keep[order[np.cumsum(capacity - filled[order]) <= capacity // 4]] = True
    if certified:
        return keep
    pieces_of = np.bincount(bins, minlength=used) * keep
    keep[np.argsort(-pieces_of, kind="stable")[: used - int(keep.sum())]] = False
    return keep


def _fitter(capacity: int, turn: int, last: bool):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        size = frame["size"].to_numpy()
        b, offset, used = best_fit_decreasing(size, capacity)
        certified = used == lower_bound(size, capacity)
        keep = np.ones(used, bool) if last else settled(b, size, used, capacity, certified)
        seq = (turn << 56) + (int(frame["deal"].iloc[0]) << 28) + b
        return pd.DataFrame({"uid": frame["uid"], "size": frame["size"], "seq": seq, "place": offset, "kept": keep[b]})

    return fit


def pack_sequences(parts: DataFrame, capacity: int = CAPACITY, deal: int = DEAL_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """`parts` (with a column length of 1..capacity) plus sequence_id and offset.

    Every piece gets one place; a sequence is gapless from 0.  Rounds end when
    nothing is exchanged or one task held all that remained; after the last of
    `rounds` some partitions may stand without a certificate.  Repeated rows are
    pieces of their own and an empty table gives no rows.  `parts` may not have
    columns named _uid, uid, seq, place, sequence_id or offset.
    """
    fixed = stored(parts, "packing-pieces").withColumn("_uid", F.monotonically_increasing_id())
    fixed = stored(fixed, "packing-numbered")
    full = fixed.where(F.col("length") == capacity)
    full = full.select(*parts.columns, (F.lit(-1) - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = fixed.where(F.col("length") < capacity).select(F.col("_uid").alias("uid"), F.col("length").cast("int").alias("size"))
    n = math.ceil(todo.count() / deal)
    placed = None
    for turn in range(rounds if n else 0):
        last = turn == rounds - 1 or n == 1

        dealt = todo.withColumn("deal", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(n)).cast("long"))
        done = dealt.groupBy("deal").applyInPandas(_fitter(capacity, turn, last), "uid long, size int, seq long, place long, kept boolean")
        done = stored(done, f"packing-round-{turn}")
        won = done.where("kept").select("uid", "seq", "place")
        placed = won if placed is None else placed.unionByName(won)
        todo = done.where("not kept").select("uid", "size")
        left = 0 if last else todo.count()
        if not left:
            break
        n = max(1, min(n // 2, math.ceil(left / deal)))
    if placed is None:
        return full
    fitted = fixed.join(placed, fixed["_uid"] == placed["uid"])
    return full.unionByName(fitted.select(*parts.columns, F.col("seq").alias("sequence_id"), F.col("place").alias("offset")))
