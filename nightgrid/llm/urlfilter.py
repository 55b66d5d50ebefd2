"""URL verdicts by a bit-parallel wildcard automaton.

Glob rules are packed side by side into multiword Shift-And masks.  One step
per byte moves all rules over all URLs of a batch at once:

    state = ((state << 1) & step[byte]) | (state & stay[byte])

A bit stands for "this rule has matched so far up to here"; a wildcard is a
state that stays.  `*` stands for any run without a slash, `**` for any run, `?`
for one byte but a slash.  Rules match whole canonical URLs: host and path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.text import raw, slices

SLASH = ord("/")
#: Host and path rules: the longest that fits decides.
SITE_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs for all other URLs: the first that matches decides.
GLOBS = (
    ("allow", "**/robots.txt"),
    ("block", "*casino*/**"),
    ("block", "*cheap-pills*/**"),
    ("block", "*free-bets*/**"),
    ("block", "*adult-*/**"),
    ("block", "spam-*/**"),
    ("block", "*.spam-*/**"),
    ("block", "ads-*/**"),
    ("block", "*.ads-*/**"),
    ("block", "**/wp-admin/**"),
    ("block", "**.exe"),
)
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case A-Z, and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


@dataclass(frozen=True)
class Rule:
    glob: str
    verdict: str
    name: str | None  # reported, for site rules
    rank: int  # the greatest of all matching rules decides


def compile_rules(sites: Sequence[tuple[str, str]] = SITE_RULES, globs: Sequence[tuple[str, str]] = GLOBS) -> list[Rule]:
    """A site rule fits its host and all subdomains, so it gives two globs.  So does a glob of hosts: a host can come without a path."""
    out = [Rule(g, v, None, -i) for i, (v, g) in enumerate(globs)]
    out += [Rule(g[:-3], v, None, -i) for i, (v, g) in enumerate(globs) if g.endswith("/**") and "/" not in g[:-3] and "**" not in g[:-3]]
    for verdict, site in sites:
        out += [Rule(head + site + "**", verdict, site, 1 + len(site)) for head in ("", "*.")]
    return out


class Automaton:
    def __init__(self, globs: Sequence[str]):
        parts = [self._parse(g.encode()) for g in globs]
        self.last = np.cumsum([len(p) for p, _ in parts]) - 1 if parts else np.zeros(0, np.int64)
        bits = int(self.last[-1]) + 1 if parts else 1
        step, stay = np.zeros((256, bits), bool), np.zeros((256, bits), bool)
        start = np.zeros(bits, bool)
        for (items, loops), end in zip(parts, self.last):
            at = end - len(items) + 1
            start[at] = True
            for i, (item, loop) in enumerate(zip(items, loops)):
                if i:
                    step[:, at + i] = item
                stay[:, at + i] = loop
        self.step, self.stay, self.start = self._pack(step), self._pack(stay), self._pack(start[None])[0]

    @staticmethod
    def _parse(glob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Bytes that lead into each state and bytes that stay in it; state 0 is the start."""
        none, wide = np.zeros(256, bool), np.ones(256, bool)
        narrow = wide.copy()
        narrow[SLASH] = False
        items, loops, i = [none], [none], 0
        while i < len(glob):
            if glob[i : i + 1] == b"*":
                double = glob[i : i + 2] == b"**"
                loops[-1] = loops[-1] | (wide if double else narrow)
                i += 1 + double
                continue
            one = narrow if glob[i : i + 1] == b"?" else none.copy()
            if one is not narrow:
                one[glob[i]] = True
            items.append(one)
            loops.append(none)
            i += 1
        return items, loops

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def matches(self, texts: pa.Array) -> np.ndarray:
        """Which rules match each whole text: a row of booleans for each."""
        data, off = raw(texts)
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")  # the longest first: those still running stand in front
        begin, size = off[:-1][order], size[order]
        state = np.tile(self.start, (len(order), 1))
        running = len(order)
        for j in range(int(size[0]) if len(size) else 0):
            while running and size[running - 1] <= j:
                running -= 1
            byte = data[begin[:running] + j]
            now = state[:running]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:running] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.zeros((len(order), len(self.last)), bool)
        out[order] = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1)
        return out


def judge(pages: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """id, host, path, rule and verdict of every page; other columns are left out.

    rule names the site rule that decided, and is null where a glob or the
    default did.  A null URL, or one without `://`, has an empty host and path
    and matches nothing.  Equal URLs of a batch run through the automaton once;
    repeated rows give a row each and an empty table none.  Only the id and the
    URL are read, so no other column can clash.
    """
    rules = list(compile_rules() if rules is None else rules)
    host, path = host_and_path(pages[url_col])
    base = pages.select(pages[id_col].alias(id_col), host.alias("host"), path.alias("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton([r.glob for r in rules])
        ranked = np.argsort([-r.rank for r in rules], kind="stable")
        names = pa.array([rules[i].name for i in ranked] + [None], pa.string())
        verdicts = pa.array([rules[i].verdict for i in ranked] + [default], pa.string())
        for batch in slices(batches, "path", 1 << 20):
            url = pc.binary_join_element_wise(batch.column(1), batch.column(2), "").dictionary_encode()
            hit = auto.matches(url.dictionary)[:, ranked]
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(rules)) if len(rules) else np.zeros(len(url.dictionary), np.int64)
            take = pa.array(first[url.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(take), verdicts.take(take)], names=[id_col, "host", "path", "rule", "verdict"])

    kind = base.schema[id_col].dataType.simpleString()
    return base.mapInArrow(work, f"{id_col} {kind}, host string, path string, rule string, verdict string")
