"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if it lies in a string of ``length`` (50) bytes that also starts in a document with a smaller
id. Texts are dealt into blocks; every step reads a block and exchanges packed, sorted hashes with buckets.

1. *Parse.* A rolling hash over the first bytes of strings of ``length - 1`` bytes triggers about every ``PERIOD`` bytes; a phrase runs from
   one trigger to the end of the next one's string, so phrases are prefix-free and overlap by length - 1 bytes,
   and every window lies in exactly one phrase. Blocks send the phrases' hashes with their smallest document,
   buckets answer with smaller documents elsewhere: a phrase in any later document is wholly a repeat, whatever
   the number of its copies. This is what makes highly repetitive text cheap: only the dictionary is left.
2. *Where else can repeats be?* The least hash of the ``KMER``-byte strings inside a 50-byte window is the
   window's anchor; equal windows have equal anchors. Of the dictionary's windows blocks send the distinct anchors
   (5 bytes each, sorted), buckets answer with those that several documents hold. A window's smallest document
   never loses it to step 1, so no repeat is missed; copies that step 1 has settled ask for nothing.
3. *Grouping in place of suffix arrays.* No suffix array of the dictionary or of the parse is built. The hashes of
   the dictionary's windows of 50 bytes behind such anchors are grouped: buckets sort the hashes (which is not suffix
   order) and give each window its smallest document. The answer asks only which windows are equal, not their order.

Anchors only say where to look; phrases and windows are compared by 64-bit hashes without algebraic structure and 16 bits of another
hash of all their bytes (pairs / 2^80 are false). Each block sends a hash once however often it holds it, so hot passages are not
hot keys. Texts are shuffled once: the steps share the exchange. Texts longer than ``CHUNK_BYTES`` are cut, with the bytes that windows
across the cut need on both sides.

Defined results: a null text has no bytes; a null doc_id is smaller than all others; rows with the same doc_id are
one document (they do not repeat each other); strings never cross rows; a very long text is taken whole; other columns are not read, so
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, planes, string_bytes, words
from .hashing import Spans

LENGTH = 50
KMER = 32
PERIOD_BITS = 6
BLOCK_BYTES = 8 << 20
BLOCKS_A_BUCKET = 4
CHUNK_BYTES = 1 << 15  # of text: its arrays of words stay in a core's cache
ANCHORS, PHRASES, WINDOWS = 0, 1, 2
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGN = np.uint64(1 << 63)


#: Hashes with their further bits.
Keys = tuple[np.ndarray, np.ndarray]
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(5).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of the places in a phrase; the other hash tells places apart that lie so far from each other that they share a number.
_PLACES = np.random.default_rng(6).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pack(keys: Keys, doc: np.ndarray) -> bytes:
    return planes(keys[0]) + planes(doc) + planes(keys[1].astype(np.uint64), 2)


def unpack(raw: bytes) -> tuple[Keys, np.ndarray]:
    n = len(raw) // 18
    return (words(raw[: 8 * n]), words(raw[16 * n :], 2).astype(np.uint16)), words(raw[8 * n : 16 * n])


def pick(keys: Keys, at) -> Keys:
    return keys[0][at], keys[1][at]


def none() -> Keys:
    return np.zeros(0, np.uint64), np.zeros(0, np.uint16)


def joined(parts: list[Keys]) -> Keys:
    return tuple(np.concatenate([x, *(p[k] for p in parts)]) for k, x in enumerate(none()))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == w else np.minimum(out[: len(x) - w + 1], out[w - have : len(x) - have + 1])


class Chunk:
    """Some texts of a block: their windows, anchors and phrases. ``doc``: ids as unsigned words that keep order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, length: int):
        self.length, self.size, n = length, len(data), len(data)
        self.spans = Spans(data)
        count = max(n - length + 1, 0)
        sizes = np.diff(offsets)
        self.of, self.doc = np.repeat(np.arange(len(sizes)), sizes)[:count], doc
        at = np.arange(count)
        self.valid = at <= np.repeat(offsets[1:] - length, sizes)[:count]  # windows that cross no text's end
        if not count:
            self.phrase_start = self.phrase = np.zeros(0, np.int64)
            self.phrases, self.phrase_doc = none(), np.zeros(0, np.uint64)
            return
        # triggers: starts of (length - 1)-byte strings whose first bytes hash so, and the first window of each text
        inner = self.spans.of(min(KMER, length - 1))[:count]
        first = np.zeros(count, bool)
        first[offsets[:-1][offsets[:-1] < count]] = True
        self.phrase_start = np.flatnonzero(self.valid & (first | (inner >> np.uint64(64 - PERIOD_BITS) == 0)))
        starts, lasts = self.phrase_start, np.append(self.phrase_start[1:], count)
        self.phrase = np.repeat(np.arange(len(starts)), lasts - starts)  # of each window: a text's first one starts one
        self.phrase = np.append(np.zeros(count - len(self.phrase), np.int64), self.phrase)
        self.windows = self.spans.of(length)
        self.phrase_doc = doc[self.of[self.phrase_start]]
        self.phrases = none()
        if len(self.phrase_start):
            place = at - self.phrase_start[self.phrase]
            # its windows times random numbers of their places: all of its bytes in their order
            each = self.windows * _PLACES[place & (len(_PLACES) - 1)]
            each *= self.valid
            total = mix64(np.add.reduceat(each, self.phrase_start))
            # and of every eighth window's bytes, and the last one's, by another hash
            some = np.flatnonzero(self.valid & ((place & 7 == 0) | ~np.append(self.valid[1:], False)))
            other = np.zeros(count, np.uint64)
            other[some] = mix64(self.bytes_of(some) + place[some].astype(np.uint64) * _GOLD)
            self.phrases = total, (np.add.reduceat(other, self.phrase_start) >> np.uint64(48)).astype(np.uint16)

    def bytes_of(self, at: np.ndarray) -> np.ndarray:
        """A sum over the words of 8 bytes of windows."""
        out = np.zeros(len(at), np.uint64)
        for k, place in enumerate([*range(0, self.length - 8, 8), max(self.length - 8, 0)]):
            out += self.spans.words[at + place] * _ODD[k % 8]
        return out

    def anchors(self) -> np.ndarray:
        k, count = min(KMER, self.length), len(self.valid)
        return sliding_min(self.spans.of(k), self.length - k + 1)[:count] if count else np.zeros(0, np.uint64)

    def keys(self, at: np.ndarray) -> Keys:
        return self.windows[at] if len(at) else none()[0], (mix64(self.bytes_of(at)) >> np.uint64(48)).astype(np.uint16)


def chunks(table: pa.Table, length: int):
    """(Chunk, first row, end row, data, offsets of its rows in data) of a block; a text beyond the limit comes in parts that overlap."""
    col = table.column("text").combine_chunks()
    data, offsets = string_bytes(col if isinstance(col, pa.Array) else pa.array([], pa.string()))
    ids = table.column("id").fill_null(-(1 << 63)).to_numpy().astype(np.int64)
    doc = ids.view(np.uint64) ^ _SIGN
    for a, b in pieces(offsets, CHUNK_BYTES):
        start, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - start <= CHUNK_BYTES:
            yield Chunk(data[start:end], offsets[a : b + 1] - start, doc[a:b], length), start
            continue
        for at in range(start, end, CHUNK_BYTES):
            part = data[at : min(at + CHUNK_BYTES + length - 1, end)]
            yield Chunk(part, np.array([0, len(part)]), doc[a:b], length), at


def least(keys: Keys, doc: np.ndarray) -> tuple[Keys, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest and largest document."""
    h, c = keys
    if not len(h):
        return keys, doc, doc
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if (same & (c[order[1:]] != c[order[:-1]])).any():  # different keys with one hash
        order = np.lexsort((c, h))
        same = h[order[1:]] == h[order[:-1]]
    h, c, doc = h[order], c[order], doc[order]
    at = np.flatnonzero(np.append(True, ~(same & (c[1:] == c[:-1]))))
    return (h[at], c[at]), np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)


def lookup(keys: Keys, values: np.ndarray, ask: Keys) -> np.ndarray:
    """The value of each asked key, ``_NONE`` without one; ``keys`` are in the order of their hashes."""
    h, c = keys
    out = np.full(len(ask[0]), _NONE, np.uint64)
    if not len(h):
        return out
    at = np.searchsorted(h, ask[0])
    rest = np.arange(len(at))
    while len(rest):  # again only for different keys with one hash
        rest = rest[at[rest] < len(h)]
        rest = rest[h[at[rest]] == ask[0][rest]]
        hit = c[at[rest]] == ask[1][rest]
        out[rest[hit]] = values[at[rest[hit]]]
        rest = rest[~hit]
        at[rest] += 1
    return out


class Block:
    """What a block knows: the smallest document of its phrases, and what it was told."""

    def __init__(self, table: pa.Table, length: int):
        found = [(c.phrases, c.phrase_doc) for c, _ in chunks(table, length)]
        self.phrases, self.phrase_doc, _ = least(joined([k for k, _ in found]), np.concatenate([np.zeros(0, np.uint64), *(d for _, d in found)]))

    def hear(self, answers: pa.Table) -> None:
        kinds, raw = answers.column("kind").to_pylist(), answers.column("payload").to_pylist()
        tags, pairs = [], {PHRASES: [], WINDOWS: []}
        for kind, x, bucket in zip(kinds, raw, answers.column("bucket").to_pylist(), strict=True):
            if kind == ANCHORS:
                tags.append(tag(bucket, words(x, 5)))
            else:
                pairs[kind].append(unpack(x))
        self.multi = np.unique(np.concatenate([*tags, np.zeros(0, np.uint64)]))
        for kind, found in pairs.items():
            keys, doc = joined([k for k, _ in found]), np.concatenate([np.zeros(0, np.uint64), *(d for _, d in found)])
            order = np.argsort(keys[0], kind="stable")
            pairs[kind] = pick(keys, order), doc[order]
        self.elsewhere, self.window_elsewhere = pairs[PHRASES], pairs[WINDOWS]

    def settled(self, c: Chunk) -> np.ndarray:
        """For each window: is it a repeat by its phrase."""
        smallest = np.minimum(lookup(self.phrases, self.phrase_doc, c.phrases), lookup(*self.elsewhere, c.phrases))
        later = smallest < c.phrase_doc
        out = np.zeros(len(c.valid), bool)
        out[c.valid] = later[c.phrase[c.valid]]
        return out

    def open_anchors(self, table: pa.Table, length: int) -> np.ndarray:
        """The sorted anchors of the windows that are not settled; those of several documents stand twice."""
        found = []
        for c, _ in chunks(table, length):
            rest = np.flatnonzero(c.valid & ~self.settled(c))
            a, d = c.anchors()[rest], c.doc[c.of[rest]]
            new = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])) if len(a) else np.zeros(0, bool)
            found.append((a[new], d[new]))
        a, d = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        (a, _), low, high = least((a, np.zeros(len(a), np.uint16)), d)
        return np.repeat(a, 1 + (low != high))

    def split(self, c: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window: is it a repeat by its phrase; the windows that must be looked up by themselves."""
        settled = self.settled(c)
        rest = np.flatnonzero(c.valid & ~settled)
        if not len(rest) or not len(self.multi):
            return settled, rest[:0]
        a = c.anchors()[rest]
        run = np.flatnonzero(np.append(True, a[1:] != a[:-1]))  # neighbours share their anchor
        asked = tag(bucket_of(a[run], buckets), a[run] & np.uint64((1 << 40) - 1))
        hot = self.multi[np.minimum(np.searchsorted(self.multi, asked), len(self.multi) - 1)] == asked
        return settled, rest[np.repeat(hot, np.diff(np.append(run, len(a))))]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64)


def tag(bucket, low: np.ndarray) -> np.ndarray:
    """What is known of an anchor at its bucket: the bucket and 40 bits."""
    return (np.asarray(bucket).astype(np.uint64) << np.uint64(40)) | low


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
SENT = "bucket int, block int, kind int, payload binary"


def send(block: int, buckets: int, kind: int, keys: Keys, doc: np.ndarray | None = None) -> list[tuple[int, int, int, bytes]]:
    b = bucket_of(keys[0], buckets)
    order = np.argsort(b, kind="stable")  # the hashes stay sorted in each bucket
    b, keys = b[order], pick(keys, order)
    cuts = [*np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)] if len(b) else []
    raw = lambda i, j: planes(keys[0][i:j], 5) if kind == ANCHORS else pack(pick(keys, slice(i, j)), doc[order[i:j]])
    return [(int(b[i]), block, kind, raw(i, j)) for i, j in pairwise(cuts)]


def rows(sent: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*sent, strict=True)) or [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT, strict=True)], schema=_SENT)


def answer(table: pa.Table) -> pa.Table:
    """A bucket's answers to the blocks that sent it hashes."""
    out = []
    bucket = table.column("bucket")[0].as_py() if len(table) else 0
    blocks, kinds, raw = (table.column(c).to_pylist() for c in ("block", "kind", "payload"))
    for kind in sorted(set(kinds)):
        mine = [i for i, k in enumerate(kinds) if k == kind]
        if kind == ANCHORS:
            tags = [words(raw[i], 5) for i in mine]
            sizes, keys = [len(x) for x in tags], (np.concatenate(tags), None)
            order = np.argsort(keys[0], kind="stable")
            s = keys[0][order]
            first = np.append(True, s[1:] != s[:-1])
            told = np.empty(len(s), bool)
            told[order] = ~first | np.append(s[1:] == s[:-1], False)
        else:
            got = [unpack(raw[i]) for i in mine]
            sizes, keys, doc = [len(d) for _, d in got], joined([k for k, _ in got]), np.concatenate([d for _, d in got])
            all_keys, low, _ = least(keys, doc)
            best = lookup(all_keys, low, keys)
            told = best < doc
        ends = np.cumsum(sizes)
        for i, e, n in zip(mine, ends, sizes, strict=True):
            part = np.flatnonzero(told[e - n : e]) + e - n
            if len(part):
                out.append((bucket, blocks[i], kind, planes(keys[0][part], 5) if kind == ANCHORS else pack(pick(keys, part), best[part])))
    return rows(out)


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) for every row."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(-(-size // block_bytes)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = -(-blocks // BLOCKS_A_BUCKET)
    dealt = src.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")

    def number(table: pa.Table) -> int:
        return table.column("block")[0].as_py()

    def ask_phrases(table: pa.Table) -> pa.Table:
        b = Block(table, length)
        return rows(send(number(table), buckets, PHRASES, b.phrases, b.phrase_doc))

    def ask_anchors(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return rows([])
        b = Block(table, length)
        b.hear(answers)
        open_ = b.open_anchors(table, length)
        return rows(send(number(table), buckets, ANCHORS, (open_, np.zeros(len(open_), np.uint16))))

    def looked_up(b: Block, table: pa.Table):
        """For each chunk: its settled windows; place, key and document of those to look up; and where it lies."""
        for c, where in chunks(table, length):
            settled, at = b.split(c, buckets)
            yield settled, at, c.keys(at), c.doc[c.of[at]], where

    def smallest_of(parts) -> tuple[Keys, np.ndarray]:
        found = [least(keys, doc)[:2] for _, _, keys, doc, _ in parts]
        return least(joined([k for k, _ in found]), np.concatenate([np.zeros(0, np.uint64), *(d for _, d in found)]))[:2]

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return rows([])
        b = Block(table, length)
        b.hear(answers)
        return rows(send(number(table), buckets, WINDOWS, *smallest_of(looked_up(b, table))))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        n_removed, n_spans, kept = [], [], []
        if len(table):
            b = Block(table, length)
            b.hear(answers)
            parts = list(looked_up(b, table))
            own = smallest_of(parts)
            data, offsets = string_bytes(table.column("text").combine_chunks())
            cover = np.zeros(len(data), bool)
            for gone, at, keys, doc, where in parts:
                smallest = np.minimum(lookup(*own, keys), lookup(*b.window_elsewhere, keys))
                gone[at[smallest < doc]] = True
                step = np.zeros(len(gone) + length, np.int32)
                hit = np.flatnonzero(gone)
                step[hit] += 1
                step[hit + length] -= 1
                some = np.cumsum(step)[: len(gone) + length - 1] > 0
                cover[where : where + len(some)] |= some[: len(cover) - where]
            for x, y in pairwise(offsets.tolist()):
                mask = cover[x:y]
                n_removed.append(int(mask.sum()))
                n_spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                kept.append(data[x:y][~mask].tobytes())
        lens = pa.array([len(k) + r for k, r in zip(kept, n_removed, strict=True)], pa.int64())
        return pa.Table.from_arrays(
            [table.column("id").combine_chunks() if len(table) else pa.array([], pa.int64()), lens, pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    by_block = dealt.groupBy("block")
    answered = lambda asked: asked.groupBy("bucket").applyInArrow(answer, SENT)
    phrases = answered(by_block.applyInArrow(ask_phrases, SENT))
    anchors = answered(by_block.cogroup(phrases.groupBy("block")).applyInArrow(ask_anchors, SENT))
    known = phrases.union(anchors)
    windows = answered(by_block.cogroup(known.groupBy("block")).applyInArrow(ask_windows, SENT))
    every = known.union(windows)
    return by_block.cogroup(every.groupBy("block")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6(docs: DataFrame) -> DataFrame:
    out = remove(docs)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: What ``op6`` returns, in DuckDB SQL: every 50-byte string with the smallest doc_id that it starts in, as 100 hex digits.
OP6_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
edge AS (SELECT *, (i > lag(i, 1, -51) OVER (PARTITION BY doc_id ORDER BY i) + 50)::INT AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, run),
gap AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM span),
kept AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last,
  string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
