"""Weak supervision over quality rules.

Each rule votes good, bad or abstains on a document.  The votes of all
documents are counted by pattern, and expectation-maximisation fits how often
each rule votes what on good and on bad documents and how common good ones
are.  A document stays when its posterior probability of being good does, in
place of demanding that every rule passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.text import codes, id_text, raw, slices, split_words

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
KEEP = 0.5
SYMBOLS = b"#*$%&|<>"
CAPITAL = slice(65, 91)
ORDINARY = b".,;:!?'\"()-"  # marks that plain words may carry
#: Rule, its measure a word, good at or below, bad at or above.
RULES = (
    ("symbols", 0.1, 0.3),
    ("odd_words", 0.1, 0.3),
    ("dup_lines", 0.02, 0.05),
    ("repeats", 0.1, 0.3),
    ("capitals", 0.35, 1.0),
    ("short_lines", 0.15, 0.4),
    ("same_word", 0.05, 0.2),
)
#: Share of good documents, and share of votes (bad, abstain, good) of any rule on bad and on good documents, before the first step.
PRIOR, ON_BAD, ON_GOOD = 0.8, (0.35, 0.15, 0.5), (0.02, 0.08, 0.9)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[off])


def repeated_words(number: np.ndarray, off: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """True for words inside a window of `size` words that its text has twice or more.

    Windows get exact numbers by doubling: numbers of pairs, of pairs of pairs,
    and so on; `size` is a power of two.
    """
    ids, n, k = number, len(number), 1
    while k < size:
        if n - 2 * k + 1 <= 0:
            return np.zeros(n, bool)
        pair = ids[: n - 2 * k + 1] * (int(ids.max()) + 1) + ids[k : n - k + 1]
        ids, k = np.unique(pair, return_inverse=True)[1], 2 * k
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = np.flatnonzero(np.arange(len(ids)) + size <= off[owner[: len(ids)] + 1])
    key = owner[first] * (int(ids.max()) + 1) + ids[first]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    begin = first[twice]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + size, -1)
    return np.cumsum(cover[:-1]) > 0


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold a word: text of each, whether it equals an earlier one of its text, and its words."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    words = np.diff(split_words(flat)[1])
    full = np.flatnonzero(words > 0)
    coded = flat.take(pa.array(full)).dictionary_encode()
    key = owner[full] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    return owner[full], again, words[full]


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts of each whole text and the measure of each rule; null reads as empty."""
    flat, off = split_words(texts)
    n_texts, n = len(off) - 1, np.diff(off)
    data, at = raw(flat)
    lead = (data & 0xC0) != 0x80
    word_at = np.append(0, np.cumsum(lead))[at]
    chars = np.diff(word_at[off])
    bytes_off = at[off]
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    capital = np.zeros(256, bool)
    capital[CAPITAL] = True
    odd = np.zeros(256, bool)
    odd[33:48] = odd[58:65] = odd[91:97] = odd[123:127] = True
    odd[np.frombuffer(ORDINARY, np.uint8)] = False
    marked = np.diff(np.append(0, np.cumsum(odd[data]))[at]) > 0
    number, _ = codes(flat) if len(flat) else (np.zeros(0, np.int64), None)
    owner, again, words = lines_of(texts)
    same = np.append(False, number[1:] == number[:-1])[: len(number)]
    same[off[:-1][n > 0]] = False
    some = np.maximum(n, 1)
    out = {
        "n_words": n, "word_chars": chars, "n_symbols": _per_text(symbol, bytes_off),
        "n_dup_lines": np.bincount(owner[again], minlength=n_texts), "n_repeat_words": _per_text(repeated_words(number, off), off) if len(number) else n,
    }
    out |= {
        "symbols": out["n_symbols"] / some, "odd_words": _per_text(marked, off) / some, "dup_lines": out["n_dup_lines"] / some, "repeats": out["n_repeat_words"] / some,
        "capitals": _per_text(capital[data], bytes_off) / some, "short_lines": np.bincount(owner[words < 3], minlength=n_texts) / some, "same_word": _per_text(same, off) / some,
    }
    return out


def failed_base(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def pattern_of(m: dict[str, np.ndarray], rules=RULES) -> np.ndarray:
    """Votes of all rules as one number in base 3: 0 bad, 1 abstain, 2 good."""
    out = np.zeros(len(m["n_words"]), np.int64)
    for name, good, bad in rules:
        vote = np.where(m[name] <= good, 2, np.where(m[name] >= bad, 0, 1))
        out = out * 3 + np.where(m["n_words"] == 0, 1, vote)  # without words a rule has nothing to judge
    return out


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n_rules - 1, -1, -1) % 3


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, steps: int = 200, smooth: float = 0.5) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each vote pattern, the share of good documents, and each rule's vote shares by class.

    The start names the classes: every rule is believed to be right more often than not.
    """
    rules = votes.shape[1]
    share, good = np.tile(np.array([ON_BAD, ON_GOOD]), (rules, 1, 1)), PRIOR
    one = (votes[:, :, None] == np.arange(3)).astype(float)
    post = np.full(len(count), good)
    for _ in range(steps):
        like = np.einsum("prv,rcv->pc", one, np.log(share)) + np.log([1 - good, good])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -700, 700)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
        weight = np.stack([count * (1 - post), count * post], 1)
        got = np.einsum("pc,prv->rcv", weight, one) + smooth
        share = got / got.sum(axis=2, keepdims=True)
        good = float(np.clip((weight[:, 1].sum() + smooth) / (weight.sum() + 2 * smooth), 1e-6, 1 - 1e-6))
    return post, good, share


def fit_rules(measured: DataFrame, rules=RULES) -> dict[int, float]:
    """Posterior of every vote pattern that occurs, from counts over all rows; there are at most 3 ** rules."""
    rows = measured.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns = np.array([r["pattern"] for r in rows], np.int64)
    post, _, _ = expectation_maximisation(votes_of(patterns, len(rules)), np.array([float(r["n"]) for r in rows]))
    return dict(zip(patterns.tolist(), post.tolist()))


def measure(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and the vote pattern of every whole text."""
    base = id_text(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = measures(batch.column(1))
            cols = [pa.array(m[c].astype(np.int64)) for c in BASE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(failed_base(m)), pa.array(pattern_of(m, rules))], names=["doc_id", *BASE, "base_failed", "pattern"])

    counts = ", ".join(f"{c} long" for c in BASE)
    return base.mapInArrow(work, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {counts}, base_failed boolean, pattern long")


def judge(docs: DataFrame, rules=RULES, keep: float = KEEP) -> DataFrame:
    """Base counts, base_failed, posterior and kept of every document.

    Null and empty texts have no words, so they fail the base.  Repeated rows
    vote and are judged each; an empty table gives no rows.  Only the id and
    the text are read, so no other column can clash.  The small table of
    measures is stored, so texts are read once.
    """
    from nightgrid.llm.storage import stored

    measured = stored(measure(docs, rules), "quality-rules")
    post = fit_rules(measured, rules)
    known = [F.lit(x) for kv in sorted(post.items()) for x in kv]
    posterior = F.create_map(*known)[F.col("pattern")] if known else F.lit(None).cast("double")
    out = measured.withColumn("posterior", posterior)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def keep_good(docs: DataFrame, rules=RULES, keep: float = KEEP) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; texts are read twice and never shuffled."""
    post = fit_rules(measure(docs, rules), rules)
    good = np.array(sorted(p for p, v in post.items() if v >= keep), np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = measures(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(~failed_base(m) & np.isin(pattern_of(m, rules), good)))

    return docs.mapInArrow(work, docs.schema)
