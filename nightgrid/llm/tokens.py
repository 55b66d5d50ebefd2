"""Byte-level BPE ids of whole texts, each distinct chunk encoded once per task.

A text is cut only where the vocabulary's pattern must end a match whatever
stands around: before a single space between two non-space characters, between
letters, digits and punctuation (never at an apostrophe), and around a single
line feed.  Equal chunks then share one encoding.  A text with white space
beyond ASCII is encoded whole.  The ids are exactly those of `encode` on the
whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nightgrid.llm.text import from_raw, raw

VOCAB_FILE = "byte_bpe_50k.json"
CACHED_CHUNKS = 250_000  # bounds the memory of a Python worker
OTHER, LETTER, DIGIT, PUNCT, SPACE, LINE, BLANK, QUOTE, HIGH = range(9)
WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]"


def vocab_path(name: str = VOCAB_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[33:127] = PUNCT
    for lo, hi, k in ((48, 58, DIGIT), (65, 91, LETTER), (97, 123, LETTER), (128, 256, HIGH), (9, 14, BLANK)):
        kind[lo:hi] = k
    kind[[32, 10, 39]] = SPACE, LINE, QUOTE
    return kind


KINDS = _kinds()


def _classes(data: np.ndarray) -> np.ndarray:
    """Kind of each byte; both bytes of a Latin-1 letter count as letters."""
    kind = KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def _cuts(kind: np.ndarray) -> np.ndarray:
    """True before each byte where a match must end; the ends of texts are not known here."""
    cut = np.zeros(len(kind), bool)
    if len(kind) < 3:
        return cut
    a, b = kind[:-1], kind[1:]
    plain = (kind == LETTER) | (kind == DIGIT) | (kind == PUNCT)
    solid = plain | (kind == QUOTE) | (kind == HIGH)
    cut[1:] = plain[:-1] & plain[1:] & (a != b)
    gap = np.flatnonzero((kind[1:-1] == SPACE) | (kind[1:-1] == LINE)) + 1
    gap = gap[solid[gap - 1] & solid[gap + 1]]
    cut[gap] = True
    cut[gap[kind[gap] == LINE] + 1] = True
    return cut


class Encoder:
    """Ids of texts without special tokens; strings that look like one are text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.single = Tokenizer.from_file(path)  # the same merges for chunks that are one match each
        self.single.encode_special_tokens = True
        self.single.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        byte_char = {c: i for i, c in enumerate(self._alphabet())}
        self.chars = np.array([ord(c) for c in byte_char], np.uint32)
        self.width = np.zeros(self.vocab_size, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self._reset()

    @staticmethod
    def _alphabet() -> list[str]:
        """The printable character that stands for each byte: itself if it has one, else the next from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(spare)) for b in range(256)]

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of one match each, with the space that may open them."""
        ids, ends = [], []
        for lo in range(0, len(off) - 1, 20_000):
            part = off[lo : lo + 20_001]
            here, gaps = self.chars[data[part[0] : part[-1]]], part[1:-1] - part[0]
            got = self.single.encode_batch_fast([np.insert(here, gaps, 32).tobytes().decode("utf-32-le")], add_special_tokens=False)
            ids.append(np.array(got[0].ids, np.uint32))
            ends.append(np.searchsorted(np.cumsum(self.width[ids[-1]]), part[1:] - part[0]) + 1)
        shift = np.cumsum([0] + [len(i) for i in ids])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *[e + s for e, s in zip(ends, shift)]])

    def _learn(self, chunks: pa.Array, texts: np.ndarray) -> np.ndarray:
        """Encode chunks that are new, and number them."""
        data, off = raw(chunks)
        kind = _classes(data) if len(data) else np.zeros(0, np.uint8)
        begin = off[:-1] + (data[off[:-1]] == 32)  # chunks are never empty
        bad = np.append(0, np.cumsum(kind != LETTER))
        one = (bad[off[1:]] == bad[begin]) & (off[1:] > begin)
        order = np.append(np.flatnonzero(one), np.flatnonzero(~one))
        keep = np.repeat(one, np.diff(off))
        ids, ends = self._together(data[keep], np.append(0, np.cumsum(np.diff(off)[one])))
        rest = self._plain([texts[i] for i in np.flatnonzero(~one).tolist()])
        ids = np.concatenate([ids, *rest])
        ends = np.append(ends, (ends[-1] if len(ends) else 0) + np.cumsum([len(r) for r in rest]).astype(np.int64))
        top, first = self.starts[-1], len(self.starts) - 1
        while top + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[top : top + len(ids)] = ids
        self.starts = np.append(self.starts, top + ends)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(first, first + len(order))
        self.known.update(zip(texts, number.tolist()))
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
        data, off = raw(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        full = np.diff(off) > 0
        kind = _classes(data)
        kind[off[:-1][full]] = np.where(kind[off[:-1][full]] == SPACE, BLANK, kind[off[:-1][full]])
        last = off[1:][full] - 1  # white space at either end of a text is never cut off
        kind[last] = np.where((kind[last] == SPACE) | (kind[last] == LINE), BLANK, kind[last])
        cut = _cuts(kind)
        for t in np.flatnonzero(wide).tolist():
            cut[off[t] : off[t + 1]] = False
        cut[off[:-1][full]] = True
        at = np.append(np.flatnonzero(cut), len(data))
        coded = from_raw(data, at).dictionary_encode()
        where, chunks = coded.indices.to_numpy(), coded.dictionary
        if len(self.known) > CACHED_CHUNKS:
            self._reset()
        names, known = chunks.to_numpy(zero_copy_only=False), self.known
        code = np.fromiter((known.get(c, -1) for c in names), np.int64, len(names))
        fresh = np.flatnonzero(code < 0)
        if len(fresh):
            code[fresh] = self._learn(chunks.take(pa.array(fresh)), names[fresh])
        begin, size = self.starts[code][where], np.diff(self.starts)[code][where]
        ends = np.append(0, np.cumsum(size))
        take = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
        return self.ids[take], ends[np.searchsorted(at, off)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    return Encoder(path)
