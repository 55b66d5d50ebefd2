"""Exact n-gram indicators for linear text models fitted on a bounded sample.

An extractor turns texts into 64-bit feature keys with the row of each.  The
features of a model are chosen by Spark over the sample; a document is then
scored by its distinct features that the model has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.storage import stored
from nightgrid.llm.text import codes, from_raw, hash_texts, id_text, mix, raw, slices, split_words, windows

Extract = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
SIEVE = 20  # bits of the table that sorts out most features at once


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, bound: int) -> DataFrame:
    """At most `bound` labelled texts of the rows where `fold` holds: text, label.

    The rows are the first by a hash of doc_id, so the choice doesn't depend on
    partitions.  A doc_id with several texts or labels counts once, with the
    least text and the larger label.
    """
    want = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(fold & F.col("label").isNotNull())
    want = want.groupBy("doc_id").agg(F.max("label").alias("label"))
    want = want.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # bounded, so it may be broadcast
    found = id_text(docs).join(F.broadcast(want), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return stored(found.select("text", "label"), "labelled-sample")


def byte_grams(n: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of bytes (at most 7) over lower-cased words with one space around each."""
    flat, off = split_words(texts, lower=True)
    data, at = raw(flat)
    spaced = np.insert(data, at[:-1], 32)
    ends = np.append(at[1:] + np.arange(1, len(at)), 0)[off[1:] - 1]
    ends = np.where(off[1:] > 0, ends, 0)
    full = np.diff(off) > 0
    spaced = np.insert(spaced, ends[full], 32)  # one more after the last word of each text
    size = np.where(full, np.diff(np.append(0, ends)) + 1, 0)
    m = len(spaced) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.zeros(m, np.uint64)
    for i in range(n):
        keys = (keys << np.uint64(8)) | spaced[i : m + i]
    row, stop = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
    whole = np.arange(m) + n <= stop[:m]
    return keys[whole], row[:m][whole]


def _shapes(words: pa.Array) -> np.ndarray:
    """Hash of each word's outline: runs of lower or other letters, capitals and digits become one sign, the rest stays."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91], to[97:123], to[48:58], to[128:] = 65, 97, 48, 97
    data, off = raw(words)
    kind = to[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~np.isin(kind[1:], (65, 97, 48))
    keep[off[:-1]] = True
    return hash_texts(from_raw(kind[keep], np.append(0, np.cumsum(keep))[off]))


def outline_grams(n: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """1- to n-grams of word outlines, where a word equal to the one before is a sign of its own, and the words."""
    flat, off = split_words(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    number, distinct = codes(flat)
    shape = _shapes(distinct)[number]
    again = np.append(False, number[1:] == number[:-1])
    again[off[:-1][off[:-1] < len(number)]] = False
    shape[again] = np.uint64(0x3D)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keys, rows = [mix(hash_texts(distinct) ^ np.uint64(0x77))[number]], [row]
    for k in range(1, n + 1):
        h, at = windows(shape, off, k)
        keys.append(mix(h + np.uint64(k)))
        rows.append(row[at])
    return np.concatenate(keys), np.concatenate(rows)


def counted_pairs(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, row) pairs and how often each occurs."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return keys[at], rows[at], np.diff(np.append(at, len(keys)))


def at_levels(keys: np.ndarray, rows: np.ndarray, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs; "so often or more" is an indicator of its own, marked in the key's top byte."""
    keys, rows, n = counted_pairs(keys, rows)
    parts = [(keys[n >= least] | np.uint64(i << 56), rows[n >= least]) for i, least in enumerate(levels)]
    return np.concatenate([k for k, _ in parts]), np.concatenate([r for _, r in parts])


class Lookup:
    """Positions of keys in a sorted set, with a small table that drops most others first.

    With more than one level, keys have 56 bits and a level in the top byte.
    """

    def __init__(self, keys: np.ndarray, levels: tuple[int, ...] = (1,)):
        self.keys, self.levels = np.sort(keys.astype(np.uint64)), levels
        self.low = np.uint64((1 << 56) - 1 if len(levels) > 1 else (1 << 64) - 1)
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self._slot(self.keys & self.low)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)

    def present(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature number) of the keys that are in the set, by row."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        on = np.flatnonzero(self.sieve[self._slot(keys)])
        keys, rows = at_levels(keys[on], rows[on], self.levels)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        pair = np.sort(rows[hit] * len(self.keys) + at[hit])
        return pair // len(self.keys), pair % len(self.keys)


def choose_features(sample: DataFrame, extract: Extract, most: int, least_docs: int, least_chi: float = 0.0, levels: tuple[int, ...] = (1,)) -> np.ndarray:
    """Keys of the `most` features by chi-square among those in `least_docs` texts or more."""

    def count(batches):
        for batch in slices(batches):
            keys, rows = at_levels(*extract(batch.column(0)), levels)
            good = batch.column(1).to_numpy()[rows] == 1
            uniq, inv = np.unique(keys, return_inverse=True)
            pos = np.bincount(inv[good], minlength=len(uniq))
            neg = np.bincount(inv[~good], minlength=len(uniq))
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(pos), pa.array(neg)], names=["key", "pos", "neg"])

    total = sample.agg(F.sum("label").alias("p"), F.count("label").alias("n")).first()
    p, n = float(total["p"] or 0), float(total["n"] or 0)
    if not 0 < p < n:
        return np.zeros(0, np.uint64)
    grams = sample.mapInArrow(count, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    seen = F.col("a") + F.col("b")
    gap = F.col("a") * (n - p) - F.col("b") * p
    chi = gap * gap * n / (seen * (n - seen + 0.5) * p * (n - p))
    best = grams.where((seen >= least_docs) & (chi >= least_chi)).orderBy(chi.desc(), "key").limit(most).select("key").collect()
    return np.sort(np.array([r["key"] for r in best], np.int64).view(np.uint64))


def sample_matrix(sample: DataFrame, extract: Extract, keys: np.ndarray, also: Callable[[pa.Array], pa.Array] | None = None, levels: tuple[int, ...] = (1,)):
    """Label, features and (with `also`) features of a changed text of each sampled row; the sample's bound bounds it."""
    look = Lookup(keys, levels)

    def rows_of(texts: pa.Array) -> list[bytes]:
        row, feature = look.present(*extract(texts))
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        return [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])]

    def build(batches):
        for batch in slices(batches):
            texts = batch.column(0)
            other = rows_of(also(texts)) if also else [b""] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows_of(texts), pa.binary()), pa.array(other, pa.binary())], names=["label", "x", "y"])

    got = sample.mapInArrow(build, "label int, x binary, y binary").orderBy(F.xxhash64("x"), "label").collect()
    take = lambda c: [np.frombuffer(r[c], "<i4") for r in got]
    return np.array([r["label"] for r in got]), take("x"), take("y")


def score_texts(docs: DataFrame, extract: Extract, keys: np.ndarray, weights: np.ndarray, link: Callable[[np.ndarray], np.ndarray], levels: tuple[int, ...] = (1,)) -> DataFrame:
    """doc_id and the link of the summed weights of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, weights))  # as many features as the model may have
    base = id_text(docs)

    def score(batches):
        keys, weights = shared.value
        look = Lookup(keys, levels)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(link(row_sums(look, extract, weights, batch.column(1))))], names=["doc_id", "score"])

    return base.mapInArrow(score, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")


def row_sums(look: Lookup, extract: Extract, weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    row, feature = look.present(*extract(texts))
    return np.bincount(row, weights=weights[feature], minlength=len(texts))
