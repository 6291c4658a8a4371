"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, A-Z lower-cased. A passage and a document that share a seed of
``min_match`` tokens are tiled: the longest common stretch whose tokens are all unmarked is marked, again
and again, until none of ``min_match`` tokens is left. The length of the next tiles is found by bisection over running Karp-Rabin
hashes of the unmarked stretches; all tiles of that length are marked in one sweep, first by place, each place of a stretch
being taken once. So time and memory grow with the tokens of both, however often they repeat themselves. A tile's tokens are
compared themselves, not only by the hash of the stretch. Tiles may lie in any order, so passages whose sentences were moved are caught. A
document is contaminated if tiles cover at least ``threshold`` of a passage's tokens.

The passages are a stated query set: they are held against all documents in blocks of at most about
``BLOCK_BYTES`` of passage text, each block in one pass over the documents without a shuffle. One block is on the driver and is what is
broadcast at a time: where there are several, the state of the documents is written after each. Documents are
independent, so skew among them does not matter.

Defined results: null and empty texts match nothing; passages of fewer than ``min_match`` tokens cannot
match; equal passages each count; among passages with equal coverage the smallest item_id is the best (of any type that has an
order); rows with the same doc_id are judged one by one; a very long or repetitive text is tiled whole; other columns pass as they are,
whatever their names; without passages nothing is contaminated; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from .common import discard, free_name, materialise, mix64, pieces, string_bytes
from .hashing import LOWER, NOT_ALNUM, bounds_of, grams, strings

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
ADDED = ("n_items", "best_item", "best_coverage", "contaminated")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """Hashes of all stretches of some tokens, of any length, from those of half the length."""

    def __init__(self, words: np.ndarray):
        self.powers = [words]

    def of(self, size: int) -> np.ndarray:
        n = len(self.powers[0]) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        k = size.bit_length() - 1
        while len(self.powers) <= k:
            h, half = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(mix64(h[:-half] * _ODD + h[half:]) if len(h) > half else h[:0])
        h, rest = self.powers[k], size - (1 << k)
        return mix64(h[:n] * _ODD + h[rest : rest + n] + np.uint64(size)) if rest else h[:n]


def tile(passage: np.ndarray, text: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in passage, start in text, length) of two arrays of tokens: the longest unmarked match first, then by place."""
    runs = Runs(passage), Runs(text)
    marked = np.zeros(len(passage), bool), np.zeros(len(text), bool)

    def unmarked(side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of unmarked stretches of a size, and their hashes."""
        h = runs[side].of(size)
        sums = np.append(0, np.cumsum(marked[side]))
        at = np.flatnonzero(sums[size:] == sums[:-size]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def common(size: int) -> bool:
        a, b = unmarked(0, size)[1], unmarked(1, size)[1]
        return bool(len(a) and len(b) and np.isin(a, b).any())

    out, most = [], min(len(passage), len(text))
    while most >= k and common(k):
        low, high = k, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        most, here = low, len(out)
        (left, a), (right, b) = unmarked(0, most), unmarked(1, most)
        order = np.argsort(b, kind="stable")  # places of one hash stay in order
        right, b = right[order], b[order]
        first, last = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        taken: dict[int, int] = {}  # how far the places of a hash are used up
        for i, lo, hi in zip(left.tolist(), first.tolist(), last.tolist(), strict=True):
            if lo == hi or marked[0][i : i + most].any():
                continue
            at = taken.get(lo, lo)
            while at < hi:
                j = int(right[at])
                at += 1
                if not marked[1][j : j + most].any() and np.array_equal(passage[i : i + most], text[j : j + most]):
                    out.append((i, j, most))
                    marked[0][i : i + most] = marked[1][j : j + most] = True
                    break
            taken[lo] = at
        if len(out) == here:  # hashes that agree by chance
            most -= 1
    return out


class Tokens:
    """The tokens of some texts, their hashes and the bounds of each text's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end, self.bounds = bounds_of(data, offsets, NOT_ALNUM)
        self.words = strings(self.data, self.start, self.end)

    def bytes(self, at: int, size: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[at : at + size].tolist(), self.end[at : at + size].tolist(), strict=True)]


class Passages:
    """A block of passages, ready to be held against documents."""

    def __init__(self, ids: list, texts: list[str], k: int):
        self.ids, self.k = ids, k
        self.tokens = Tokens(*string_bytes(pa.array(texts, pa.string())))
        words, bounds = self.tokens.words, self.tokens.bounds
        self.sizes = np.diff(bounds)
        h = grams(words, k)
        item = np.repeat(np.arange(len(ids)), self.sizes)
        place = np.arange(len(words)) - bounds[item] if len(words) else np.zeros(0, np.int64)
        whole = np.flatnonzero(place[: len(h)] + k <= self.sizes[item[: len(h)]]) if len(h) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([h[whole], item[whole].astype(np.uint64)], 1), axis=0)  # a seed counts once in a passage
        self.hash, self.item = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)

    def best(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[int, object, float]]:
        """For documents with a tile: passages with one, the best of them and its coverage."""
        k, mine = self.k, Tokens(data, offsets)
        h = grams(mine.words, k)
        if not len(h) or not len(self.hash):
            return {}
        low = np.searchsorted(self.hash, h)
        hits = np.flatnonzero(self.hash[np.minimum(low, len(self.hash) - 1)] == h)
        doc = np.searchsorted(mine.bounds, hits, "right") - 1
        inside = hits + k <= mine.bounds[doc + 1]
        hits, doc = hits[inside], doc[inside]
        low, n = low[hits], np.searchsorted(self.hash, h[hits], "right") - low[hits]
        # distinct (document, passage): a seed that many passages share is one row for each of them
        asked: dict[int, set[int]] = {}
        for d, a, m in zip(doc.tolist(), low.tolist(), n.tolist(), strict=True):
            asked.setdefault(d, set()).update(self.item[a : a + m].tolist())
        out = {}
        for d, passages in asked.items():
            text = mine.words[mine.bounds[d] : mine.bounds[d + 1]]
            found = []
            for p in passages:
                at, size = int(self.tokens.bounds[p]), int(self.sizes[p])
                tiles = tile(self.tokens.words[at : at + size], text, k)
                covered = sum(m for i, j, m in tiles if self.tokens.bytes(at + i, m) == mine.bytes(int(mine.bounds[d]) + j, m))
                if covered:
                    found.append((covered / size, self.ids[p]))
            if found:
                coverage = max(c for c, _ in found)
                out[d] = (len(found), min(i for c, i in found if c == coverage), coverage)
        return out


def passage_blocks(items: DataFrame):
    """The query set in blocks of bounded size, one at a time."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-size // (BLOCK_BYTES // 2))) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        got = (rows.where(part == b) if blocks > 1 else rows).orderBy("item_id", "text").collect()
        yield b == blocks - 1, [r[0] for r in got], [r[1] for r in got]


def added(columns: list[str]) -> list[str]:
    """The names of what ``screen`` adds."""
    return [free_name(columns, c) for c in ADDED]


def screen(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` and, after its columns, n_items, best_item, best_coverage, contaminated (``_`` behind a name that is taken)."""
    columns, new, kind = docs.columns, added(docs.columns), items.schema["item_id"].dataType
    schema = StructType([docs.schema[c] for c in columns])
    for name, of in zip(new, (LongType(), kind, DoubleType(), BooleanType()), strict=True):
        schema = schema.add(name, of)
    start = (F.lit(0).cast("long"), F.lit(None).cast(kind), F.lit(0.0), F.lit(False))
    state, before = docs.select(*columns, *[x.alias(c) for x, c in zip(start, new, strict=True)]), None
    for last, ids, texts in passage_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches, shared=shared):
            block = Passages(*shared.value, min_match)
            for batch in batches:
                data, offsets = string_bytes(batch.column(columns.index("text")))
                old = batch.columns[len(columns) :]
                n, item, cover, _ = (c.to_pylist() for c in old)
                for a, b in pieces(offsets, CHUNK_BYTES):
                    for d, (count, best, c) in block.best(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).items():
                        d += a
                        n[d] += count
                        if c > cover[d] or (c == cover[d] and (item[d] is None or best < item[d])):
                            item[d], cover[d] = best, c
                found = [pa.array(x, o.type) for x, o in zip((n, item, cover, [c >= threshold for c in cover]), old, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *found], names=[*columns, *new])

        state = state.mapInArrow(run, schema)
        if not last:
            state = materialise(state, "screened")
            shared.unpersist()
            if before is not None:
                discard(before)
            before = state
    return state


def op8(docs: DataFrame, items: DataFrame) -> DataFrame:
    return screen(docs.select("doc_id", "text"), items).drop("text")
