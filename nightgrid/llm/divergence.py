"""Which terms set the sources of a language apart, and how far sources are from each other.

Terms are runs of letters (any character beyond ASCII counts as one).  Inside
a task they are counted in buckets by length: up to 8 bytes make one uint64
word and up to 16 bytes two, sorted by radix passes of 16 bits and counted by
runs; longer terms lie in a bucket of their own, sorted as bytes.  Equal words
order as their bytes do, so a run is one term.

Only counts are shuffled: (lang, source, term) rows that every task has added
up.  A pair of sources needs the terms that both hold; what one side alone
holds depends on its count and the other's share of an absent term, so a
histogram of counts stands in for those terms, and terms neither holds share
one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.llm.storage import stored
from nightgrid.llm.text import from_raw, raw, slices

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
HELD = 400_000  # counts a task holds before it sends them on
PAIRS = 1 << 21
BUCKET_ROWS = 500_000


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by uint64 columns, the last one first in rank: one counting pass for each 16 bits that differ."""
    order = np.arange(len(columns[0]))
    for col in columns:
        varied = np.bitwise_or.reduce(col ^ col[:1]) if len(col) else 0
        for shift in range(0, 64, 16):
            if int(varied) >> shift & 0xFFFF:
                digit = (col[order] >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit, kind="stable")]
    return order


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where each run of equal rows starts."""
    fresh = np.ones(len(columns[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def pack(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as one word that orders as the bytes do."""
    word = np.zeros(len(at), np.uint64)
    for i in range(8):
        on = size > i
        byte = np.zeros(len(at), np.uint64)
        byte[on] = data[at[on] + i]
        word = word << np.uint64(8) | byte
    return word


def unpack(words: list[np.ndarray]) -> pa.Array:
    """The texts that were packed; no term holds a zero byte."""
    raw_bytes = np.stack(words, 1).astype(">u8").view(np.uint8).reshape(len(words[0]), -1)
    full = raw_bytes != 0
    return from_raw(raw_bytes[full], np.append(0, np.cumsum(full.sum(1))))


def find_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, length and text of each term."""
    data, off = raw(texts)
    data = data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    part = np.zeros(len(data) + 2, bool)
    part[1:-1] = (data >= 128) | ((data >= 97) & (data <= 122))
    edge = part[1:] != part[:-1]
    # a text that ends inside a run of letters ends the term
    inner = off[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[part[inner] & part[inner + 1]]
    at = np.sort(np.concatenate([np.flatnonzero(edge), np.repeat(inner, 2)]))
    start, end = at[::2], at[1::2]
    return data, start, end - start, np.searchsorted(off, start, "right") - 1


def _changes(texts: pa.Array) -> np.ndarray:
    """Number of each run of equal texts."""
    return np.cumsum(np.append(0, pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)))


class Counts:
    """Counts of one bucket: columns that make the key (group last), occurrences and documents."""

    def __init__(self, words: int):
        self.words, self.parts, self.size = words, [], 0

    def add(self, key: list, n: np.ndarray, docs: np.ndarray) -> None:
        if len(n):
            self.parts.append((key, n, docs))
            self.size += len(n)

    def merged(self):
        """One row per key."""
        if not self.parts:
            return None
        group = np.concatenate([p[0][-1] for p in self.parts])
        n, docs = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2))
        if self.words:
            key = [np.concatenate([p[0][i] for p in self.parts]) for i in range(self.words)]
            order = radix_order([group, *key[::-1]])
            key = [k[order] for k in key]
            marks = key
        else:  # long terms, as bytes
            texts = pa.concat_arrays([p[0][0] for p in self.parts])
            order = pc.sort_indices(pa.table({"t": texts.cast(pa.large_binary()), "g": group}), [("t", "ascending"), ("g", "ascending")]).to_numpy()
            key = [texts.take(pa.array(order))]
            marks = [_changes(key[0])]
        group = group[order]
        at = runs([*marks, group])
        n, docs = np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)
        key = [k[at] for k in key] if self.words else [key[0].take(pa.array(at))]
        self.parts, self.size = [([*key, group[at]], n, docs)], len(n)
        return key, group[at], n, docs


class TermCounter:
    """Terms of one task, by length bucket."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.buckets = [Counts(1), Counts(2), Counts(0)]

    def add(self, batch: pa.RecordBatch) -> None:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        group = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.uint64)
        by_group = np.argsort(group, kind="stable")  # then each run of a term keeps group and document order
        group = group[by_group]
        data, start, size, text = find_terms(pc.fill_null(batch.column("text"), "").take(pa.array(by_group)))
        for bucket, lo, hi in zip(self.buckets, (0, 8, 16), (8, 16, None)):
            on = (size > lo) & (size <= hi) if hi else size > lo
            at, n, doc = start[on], size[on], text[on]
            if not len(at):
                continue
            if hi:
                key = [pack(data, at + 8 * i, n - 8 * i) for i in range(bucket.words)]
                order = radix_order(key[::-1])
                key = marks = [k[order] for k in key]
            else:
                ends = np.append(0, np.cumsum(n))
                long = from_raw(data[np.arange(ends[-1]) + np.repeat(at - ends[:-1], n)], ends)
                order = pc.array_sort_indices(long.cast(pa.large_binary())).to_numpy().astype(np.int64)
                key = [long.take(pa.array(order))]
                marks = [_changes(key[0])]
                order = order[np.lexsort((order, marks[0]))]  # the text order inside a run
            doc = doc[order]
            first = runs([*marks, group[doc]])
            fresh = np.zeros(len(doc), np.int64)
            fresh[runs([*marks, doc])] = 1
            key = [k[first] for k in key] if hi else [key[0].take(pa.array(first))]
            bucket.add([*key, group[doc[first]]], np.diff(np.append(first, len(doc))), np.add.reduceat(fresh, first))

    def held(self) -> int:
        return sum(b.size for b in self.buckets)

    def merge(self) -> None:
        for b in self.buckets:
            b.merged()

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = list(self.groups)
        langs, sources = pa.array([p[0] for p in names], pa.string()), pa.array([p[1] for p in names], pa.string())
        for b in self.buckets:
            got = b.merged()
            if got:
                key, group, n, docs = got
                group = pa.array(group.astype(np.int64))
                term = unpack(key) if b.words else key[0]
                cols = [langs.take(group), sources.take(group), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
                whole = pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
                for lo in range(0, len(n), 20_000):
                    yield whole.slice(lo, 20_000)
            b.parts, b.size = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = TermCounter()
    for batch in slices(batches):
        counter.add(batch)
        if counter.held() > 2 * HELD:
            counter.merge()
            if counter.held() > HELD:
                yield from counter.flush()
    yield from counter.flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, for every source that holds it."""
    texts = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / total), exact beyond 64 bits."""
    top = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, total.cast("decimal(19,0)")).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums over the terms that both sources of a pair hold, of what their values exceed the histograms'."""
    table = table.combine_chunks().sort_by("term")
    coded = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    source = table["source"].combine_chunks().dictionary_encode()
    s, names = source.indices.to_numpy().astype(np.int64), source.dictionary
    p, p0 = table["p"].to_numpy(), table["p0"].to_numpy()
    start = np.searchsorted(coded, coded)
    size = np.searchsorted(coded, coded, "right") - start
    ends = np.append(0, np.cumsum(size))
    keys, values, at = [], [], 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(at, to), size[at:to])
        b = start[a] + np.arange(len(a)) - (ends[a] - ends[at])
        other = a != b
        a, b = a[other], b[other]
        v = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
        key, where = np.unique(s[a] * len(names) + s[b], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, v)
        keys.append(key)
        values.append(total)
        at = to
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, where, np.concatenate(values))
    a, b = (names.take(pa.array(x)) for x in np.divmod(key, len(names)))
    return pa.table([pa.repeat(table["lang"][0], len(key)).cast(pa.string()), a, b, pa.array(total)], ["lang", "source", "item", "v"])


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Divergence of each (lang, source) group from the other sources and from its language.

    A language keeps the terms that at least `min_docs` of its documents hold.
    Part `pair`: each other source of the language with the sum over all kept
    terms; part `term`: the kept terms that the group holds more of than its
    language, the first `top` by value.  Rows: lang, source, part, item, value,
    rank (from 1, value descending, item ascending by bytes).

    Null text, lang and source read as ''.  Groups without terms and languages
    without kept terms are compared as well (value 0 if no term is kept).
    Repeated rows are documents of their own.  An empty table gives no rows.
    Only the three columns are read, so no other column can clash.  A term may
    be as long as its text.
    """
    counts = stored(term_counts(docs), "terms")
    groups = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d")).where(F.col("d") >= min_docs).drop("d")
    cells = stored(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    # a row per term and source; one per term survives below
    terms = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = groups.select("lang").distinct().join(terms.groupBy("lang").agg(F.count("term").alias("v"), F.sum("lang_n").alias("all_n")), "lang", "left")
    sizes = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang")
    sizes = sizes.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "all_n", "group_n")])
    total = F.when(F.col("v") > 0, F.col("group_n") + F.col("v")).otherwise(F.lit(1))
    none = F.lit(0).cast("long")
    sizes = stored(sizes.withColumn("total", total).withColumn("p0", share(none, F.col("total"))), "group-sizes")
    shares = cells.join(sizes, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total")))
    return _pairs(shares, sizes).unionByName(_top_terms(shares, top))


def _top_terms(shares: DataFrame, top: int) -> DataFrame:
    rows = shares.withColumn("q", share(F.col("lang_n"), F.col("all_n") + F.col("v"))).where(F.col("p") > F.col("q"))
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # cut on the map side first
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pairs(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    held = shares.select("lang", "term", "source", "p", "p0")
    buckets = max(1, -(-held.count() // BUCKET_ROWS))
    held = held.groupBy("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    both = held.applyInArrow(_pair_sums, "lang string, source string, item string, v long").groupBy("lang", "source", "item").agg(F.sum("v").alias("both"))
    other = sizes.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = sizes.select("lang", "source", "v", "p0").join(other, "lang").where(F.col("source") != F.col("item"))
    apart = distance(F.col("p0"), F.col("q0"))
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    mine = levels.join(other, "lang").where(F.col("source") != F.col("item"))
    mine = mine.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (distance(F.col("p"), F.col("q0")) - apart)).alias("mine"))
    theirs = levels.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), "terms")
    theirs = theirs.join(sizes.select("lang", "source", "p0"), "lang").where(F.col("source") != F.col("item"))
    theirs = theirs.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (distance(F.col("p0"), F.col("q")) - apart)).alias("theirs"))
    for part in (both, mine, theirs):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    value = F.col("v") * apart
    for c in ("both", "mine", "theirs"):
        value = value + F.coalesce(c, F.lit(0).cast("long"))
    rows = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # a row per source of the language
    return rows.withColumn("rank", F.row_number().over(order))


#: Dense form of the same: a cell for each group and kept term.
ORACLE = """
with d as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') ts
  from documents),
t as (select r, lang, source, unnest(ts) term from d),
k as (select lang, term from t group by 1, 2 having count(distinct r) >= 3),
g as (select distinct lang, source from d),
v as (select lang, count(term) v from (select distinct lang from g) left join k using (lang) group by 1),
c as (select lang, source, term, count(*) c from t join k using (lang, term) group by 1, 2, 3),
cells as (
  select g.lang, g.source, k.term, coalesce(c.c, 0)::hugeint c
  from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
n as (select lang, source, sum(c) n from cells group by 1, 2),
p as (select lang, source, term, c, 1 + (1000000000::hugeint * (c + 1)) // (n + v)::hugeint p from cells join n using (lang, source) join v using (lang)),
q as (
  select lang, term, 1 + (1000000000::hugeint * (c + 1)) // (n + v)::hugeint q
  from (select lang, term, sum(c)::hugeint c from cells group by 1, 2)
  join (select lang, sum(c)::hugeint n from cells group by 1) using (lang) join v using (lang)),
pairs as (
  select a.lang, a.source, b.source item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by 1, 2, 3),
terms as (
  select p.lang, p.source, p.term item, (((p.p - q.q) * (p.p - q.q)) // q.q)::bigint as value
  from p join q on p.lang = q.lang and p.term = q.term where p.c > 0 and p.p > q.q)
select lang, source, 'pair' part, item, value, (row_number() over (partition by lang, source order by value desc, item))::integer as rank from pairs
union all
select * from (
  select lang, source, 'term' part, item, value, (row_number() over (partition by lang, source order by value desc, item))::integer as rank from terms)
where rank <= 200
"""
