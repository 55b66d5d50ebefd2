"""n-gram Jaccard join with a MinHash LSH forest and exact verification.

Equal texts are one class from the start.  Each distinct text has one label of
8 MinHash values in each of 16 trees.  The labels of a tree are sorted, which
makes them a prefix trie: the values that a label shares with its neighbours
say how deep it is matched.

    1  labels are range partitioned and sorted; those that share too short a
       prefix with both neighbours leave
    2  the search starts at whole labels and shortens the prefix step by step
       to the one that gives the target recall for pairs at the threshold.  At
       each step only the nodes that join texts which deeper ones have not yet
       connected are searched; sketches of whole signatures say which texts are
       worth connecting, and a spanning forest of these is kept
    3  connected components of the forest gather what has to be compared
    4  inside a component every pair is verified on its exact shingle sets;
       each text keeps its number of links, and links become classes

Large nodes and components are cut into tiles of bounded size, so no task
holds a whole group and no pair is written down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.llm.components import components
from nightgrid.llm.storage import stored
from nightgrid.llm.text import codes, hash_texts, mix, slices, split_words, windows

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.999
STEP = 2  # values that a prefix loses at a time
TILE = 256
COLUMNS = 8192  # shingles in one block of the exact comparison


def prefix_length(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Shortest prefix needed: the longest under which `trees` trees find a pair at the threshold with the target recall."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def text_key(text: Column) -> Column:
    """128-bit key of a text; null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and where each text's start.

    Words are lower-cased A-Z.  A text of fewer words, but not none, is one shingle.
    """
    flat, off = split_words(texts, lower=True)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    number, distinct = codes(flat)
    value = hash_texts(distinct)[number]
    n = np.diff(off)
    found, owner = windows(value, off, size)
    owner = np.searchsorted(off, owner, "right") - 1
    for k in range(1, size):
        h, at = windows(value, off, k)
        row = np.searchsorted(off, at, "right") - 1
        whole = n[row] == k
        found, owner = np.append(found, mix(h[whole] + np.uint64(k))), np.append(owner, row[whole])
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def distinct_shingles(texts: pa.Array) -> list[np.ndarray]:
    h, off = shingles(texts)
    return [np.unique(h[a:b]) for a, b in zip(off, off[1:])]


def signatures(h: np.ndarray, off: np.ndarray, n: int = TREES * DEPTH) -> np.ndarray:
    """n MinHash values of 32 bits for each text that has shingles."""
    full = np.diff(off) > 0
    begin = off[:-1][full]
    out = np.empty((len(begin), n), np.uint32)
    if not len(begin):
        return out
    rng = np.random.default_rng(20)
    a, b = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(((h * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def prefix_steps(shortest: int, depth: int = DEPTH, step: int = STEP) -> list[int]:
    """Prefix lengths from whole labels down to the shortest."""
    return [*range(depth, shortest, -step), shortest]


def _signed(texts: DataFrame) -> DataFrame:
    """key, labels (one for each tree, in an order that sorts as the values do) and sketch of each distinct text with words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 20):
            h, off = shingles(batch.column(1))
            sig = signatures(h, off)
            data = pa.py_buffer(sig.astype(">u4").tobytes())
            label = pa.Array.from_buffers(pa.binary(4 * DEPTH), sig.size // DEPTH, [None, data]).cast(pa.binary())
            labels = pa.ListArray.from_arrays(pa.array(np.arange(0, len(label) + 1, TREES), pa.int32()), label)
            sketch = pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())
            keys = batch.column(0).filter(pa.array(np.diff(off) > 0))
            yield pa.RecordBatch.from_arrays([keys, labels, sketch], names=["key", "labels", "sketch"])

    return texts.mapInArrow(work, "key binary, labels array<binary>, sketch binary").dropDuplicates(["key"])


def shared_values(labels: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Leading values that each label (a row of values) shares with the one before it; 0 at the first of a tree."""
    out = np.zeros(len(labels), np.int32)
    if len(labels) > 1:
        same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)
        out[1:] = np.where(tree[1:] == tree[:-1], same, 0)
    return out


def _matched(shortest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose next neighbour is yet to come

        def deep(rows: pa.Table, first: bool, last: bool) -> pa.RecordBatch | None:
            values = np.frombuffer(b"".join(rows.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)
            before = shared_values(values, rows.column("tree").to_numpy())
            after = np.append(before[1:], DEPTH)
            if first:  # the neighbour is in another partition
                before[0] = DEPTH
            length = np.maximum(before, after).astype(np.int32)
            done = rows.append_column("deep", pa.array(length))
            done = done.slice(0 if first else 1, rows.num_rows - (0 if first else 1) - (0 if last else 1))
            done = done.filter(pa.array(done.column("deep").to_numpy() >= shortest)).combine_chunks()
            return done.to_batches()[0] if done.num_rows else None

        first, rows = True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # two rows of context: one whose result is out already, one whose next neighbour is known now
            rows = pa.Table.from_batches([batch] if held is None else [*held, batch]).combine_chunks()
            out = deep(rows, first, False)
            if out is not None:
                yield out
            first = first and rows.num_rows < 2
            held = rows.slice(max(0, rows.num_rows - 2)).to_batches()
        if rows is not None:
            out = deep(rows.slice(max(0, rows.num_rows - 2)), first or rows.num_rows < 2, True)
            if out is not None:
                yield out

    return run


def prefix_trie(signed: DataFrame, shortest: int) -> DataFrame:
    """(tree, label, key, deep): sorted labels that share `shortest` values or more with a neighbour; `deep` is how many.

    The first and last label of a partition, whose neighbours lie elsewhere, count as matched in full.
    """
    entries = signed.select("key", F.posexplode("labels").alias("tree", "label"))
    n = max(1, int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = entries.select("tree", "label", "key").repartitionByRange(n, "tree", "label").sortWithinPartitions("tree", "label")
    return ranged.mapInArrow(_matched(shortest), "tree int, label binary, key binary, deep int")


def open_nodes(trie: DataFrame, roots: DataFrame | None, length: int) -> tuple[DataFrame, DataFrame]:
    """Labels by node at one prefix length, and the nodes (node, n) that hold texts not yet connected."""
    rows = trie.where(F.col("deep") >= length).select("key", F.xxhash64("tree", F.substring("label", 1, 4 * length)).alias("node"))
    rows = rows.withColumn("root", F.col("key")) if roots is None else rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    marks = [F.sum(F.xxhash64("key") % (1 << 40)).alias("f"), F.sum(F.xxhash64("key", F.lit(1)) % (1 << 40)).alias("g")]
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), *marks).where("lo <> hi")
    # nodes over the same texts say the same: one of them is enough
    return rows, nodes.groupBy("n", "f", "g").agg(F.min("node").alias("node")).select("node", "n")


def _tiled(rows: DataFrame, group: str, size: str, tile: int) -> DataFrame:
    """Rows dealt to tiles (lo, hi) of their group: a group of up to `tile` rows is one, a larger one
    is cut into parts and every two parts, and each part alone, make a tile."""
    parts = F.ceil(F.col(size) / tile).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    rows = rows.select("*", other).withColumn("lo", F.least("part", "other").cast("int")).withColumn("hi", F.greatest("part", "other").cast("int"))
    return rows.drop("other", size).repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "key")


def _by_tile(work: Callable[[pa.Table, bool], pa.RecordBatch | None]) -> Callable:
    """Call `work` with each tile's rows; the first columns are group, lo, hi.  Only the tile at hand is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            cuts = _edges(held)
            yield from _each(held, cuts, work)
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from _each(held, np.append(_edges(held), held.num_rows), work)

    return run


def _edges(rows: pa.Table) -> np.ndarray:
    """Where tiles start."""
    cols = [rows.column(i).to_numpy() for i in range(3)]
    new = np.ones(rows.num_rows, bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
    return np.flatnonzero(new)


def _each(rows: pa.Table, cuts: np.ndarray, work: Callable) -> Iterator[pa.RecordBatch]:
    out = [work(rows.slice(a, b - a)) for a, b in zip(cuts.tolist(), cuts[1:].tolist()) if b - a > 1]
    out = [o for o in out if o is not None and o.num_rows]
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _across(rows: pa.Table) -> np.ndarray:
    """Pairs that belong to this tile: two parts meet, or one part alone."""
    part = rows.column("part").to_numpy()
    if rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py():
        return np.triu(np.ones((len(part), len(part)), bool), 1)
    return np.triu(part[:, None] != part[None, :], 1)


def leaders(near: np.ndarray) -> np.ndarray:
    """Least member of each one's component in a symmetric relation."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        low = np.where(near, label[None, :], len(label)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _forest(least: float) -> Callable:
    def work(rows: pa.Table) -> pa.RecordBatch | None:
        root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        pairs = _across(rows) & (root[:, None] != root[None, :])
        if not pairs.any():
            return None
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        if rows.num_rows == 2:
            same = np.array([[0.0, (sketch[0] == sketch[1]).mean()], [0, 0]])
        else:
            same = np.array([(sketch == s).mean(axis=1) for s in sketch])
        near = (same >= least) & pairs
        lead = leaders(near | near.T)
        on = np.flatnonzero(lead != np.arange(len(lead)))
        keys = rows.column("key").combine_chunks()
        return pa.RecordBatch.from_arrays([keys.take(pa.array(on)), keys.take(pa.array(lead[on]))], names=["a", "b"])

    return work


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, in blocks of columns of the incidence matrix."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)))
    for lo in range(0, len(value), COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        block = np.zeros((len(sets), min(COLUMNS, len(value) - lo)), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        out += block @ block.T  # counts under 2 ** 24 are exact
    return out


def _verify(threshold: float) -> Callable:
    def work(rows: pa.Table) -> pa.RecordBatch | None:
        sets = [np.frombuffer(b, np.uint64) for b in rows.column("grams").to_pylist()]
        both = intersections(sets)
        size = np.array([len(s) for s in sets], np.float64)
        near = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9) & _across(rows)
        near |= near.T
        links = near.sum(axis=1)
        lead = leaders(near)
        on = np.flatnonzero(links)
        keys = rows.column("key").combine_chunks()
        return pa.RecordBatch.from_arrays([keys.take(pa.array(on)), keys.take(pa.array(lead[on])), pa.array(links[on])], names=["a", "b", "links"])

    return work


def wanted_texts(texts: DataFrame, sized: DataFrame) -> DataFrame:
    """key, group, n and text of each key of `sized`: copies collapse before any text is shuffled."""
    # the same plan at every size: a table of components that happens to be small is not broadcast
    return texts.dropDuplicates(["key"]).join(sized.hint("merge"), "key").select("key", "group", "n", "text")


def forest_components(signed: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, report: list | None = None) -> DataFrame:
    """(node, root) of texts that the forest connects, stored.

    With `report`, a row (prefix length, nodes, labels, pairs) of what each step searches is added to it.
    """
    shortest = prefix_length(threshold=threshold, recall=recall)
    trie = stored(prefix_trie(signed, shortest), "jaccard-trie")
    spread = 4 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5  # four standard errors of the estimate
    found, roots = None, None
    for length in prefix_steps(shortest):
        rows, nodes = open_nodes(trie, roots, length)
        if report is not None:
            pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")
            report.append((length, *nodes.agg(F.count("n"), F.sum("n"), pairs).first()))
        inside = rows.join(nodes, "node").join(signed.select("key", "sketch"), "key")
        tiles = _tiled(inside, "node", "n", tile).select("node", "lo", "hi", "part", "key", "root", "sketch")
        edges = tiles.mapInArrow(_by_tile(_forest(threshold - spread)), "a binary, b binary")
        if found is not None:  # stars of what is connected already
            edges = edges.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = stored(components(edges), "jaccard-components")
        roots = found.withColumnRenamed("node", "key")
    return found


def linked_texts(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """`texts` (key, text), any number of rows a key, to (key, root, n_links) of every text with a link."""
    signed = stored(_signed(texts), "jaccard-signatures")
    found = forest_components(signed, threshold, recall, tile)
    sized = found.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select(F.col("node").alias("key"), F.xxhash64("root").alias("group"), "n")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 20):
            sets = pa.array([s.tobytes() for s in distinct_shingles(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["key", "group", "n", "grams"])

    shingled = wanted_texts(texts, sized).mapInArrow(grams, "key binary, group long, n long, grams binary")
    rows = _tiled(shingled, "group", "n", tile).select("group", "lo", "hi", "part", "key", "grams")
    exact = stored(rows.mapInArrow(_by_tile(_verify(threshold)), "a binary, b binary, links long"), "jaccard-links")
    links = exact.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    roots = components(exact.select("a", "b"))
    return links.join(roots.withColumnRenamed("node", "key"), "key").select("key", "root", "n_links")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id, n_links, n_copies.

    class_id is the least doc_id of all texts connected by links of `threshold`
    or more (null if they have none).  n_links counts other texts linked to this
    one, n_copies the documents of the same text, this one included.  Texts
    without words have no shingles and are linked only to their copies.
    """
    keyed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), text_key(docs[text_col]).alias("key"))
    linked = stored(linked_texts(keyed.select("key", "text"), threshold, recall), "jaccard-classes")
    copies = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"))
    texts = copies.join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    texts = texts.join(least, "root").select("key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return keyed.select("doc_id", "key").join(texts, "key").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` with one document of each class: its least doc_id (null last), then by a hash of the row."""
    names = {c: c for c in ("key", "row", "turn")}
    for c in names:
        while names[c] in docs.columns:
            names[c] += "_"
    key, row, turn = names["key"], names["row"], names["turn"]
    keyed = docs.withColumn(key, text_key(docs["text"])).withColumn(row, F.xxhash64(*[docs[c] for c in docs.columns]))
    linked = stored(linked_texts(docs.select(text_key(docs["text"]).alias("key"), docs["text"].alias("text")), threshold, recall), "jaccard-classes")
    ids = keyed.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col("doc_id"))
    grouped = ids.join(linked.select("key", "root"), "key", "left").groupBy(F.coalesce("root", "key").alias("root"))
    chosen = grouped.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "key")).alias("c")).select(F.col("c.key").alias(key), F.col("c.row").alias(row))
    kept = keyed.join(chosen.hint("merge"), [key, row], "left_semi")
    order = Window.partitionBy(key, row).orderBy(row)  # rows that are equal in every column
    return kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(*docs.columns)
