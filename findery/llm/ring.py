"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``CELLS`` cells; every shard owns the cells up to each of its virtual nodes. A document's
cell is the upper bits of the hash of its id and its text, so rows that share an id, or have none, spread out. Shards have a capacity; documents of a cell whose shard is
full continue clockwise to the next shard with room. With ``slack`` 0 the capacities add up to the number
of documents and differ by one at most (law ``rows``: counts at most one apart, for any data). With more
slack fewer documents overflow and fewer move when a shard is added.

Scale: the only facts that leave the cluster are the counts of the cells, at most ``CELLS`` numbers for
any input. The driver walks the ring over these counts and gets, for each cell, which ranks of its
documents go to which shard (at most CELLS + 2 * shards + virtual nodes ranges); that bounded table is
broadcast and joined by cell. Documents get their rank from one window by cell: a shuffle of the narrow
columns only, and even, as ids are hashed.

Groups: documents with equal texts are placed by their ids, each by itself, as sizes would be uneven if a large group
stayed together; law ``rows`` holds whatever the groups.

Defined results: a null text has no bytes; a null doc_id is hashed like any value; repeated rows are
placed one by one, in one cell; a very long text counts with all its bytes; ties are broken by all columns that count; other columns
are not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

CELL_BITS = 14
CELLS = 1 << CELL_BITS
VNODES = 64


def virtual_nodes(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard), in ring order; a shard's places do not depend on the other shards."""
    out = []
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
            out.append((at >> (64 - CELL_BITS), at, s))
    return [(cell, s) for cell, _, s in sorted(out)]


def capacities(n: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [-(-int(n * (1 + slack)) // shards) + 1] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for the documents of all cells."""
    ring = virtual_nodes(shards, vnodes)
    cells = [c for c, _ in ring]
    left = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    jump = list(range(len(ring) + 1))  # to the next virtual node that may have room

    def find(i: int) -> int:
        while jump[i] != i:
            jump[i] = jump[jump[i]]
            i = jump[i]
        return i

    out = []
    for cell in sorted(counts):
        rank, todo = 0, counts[cell]
        i = bisect.bisect_left(cells, cell)
        while todo:
            i = find(i if i < len(ring) else 0)
            if i == len(ring):
                i = 0
                continue
            shard = ring[i][1]
            if not left[shard]:
                jump[i] = i + 1
                continue
            take = min(todo, left[shard])
            out.append((cell, rank, rank + take, shard, used[shard]))
            rank, todo = rank + take, todo - take
            left[shard] -= take
            used[shard] += take
    return out


def assign(docs: DataFrame, shards: int = 40, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    cell = F.shiftrightunsigned(F.xxhash64("doc_id", text_or_empty()), 64 - CELL_BITS).cast("int")
    counts = {r[0]: r[1] for r in docs.groupBy(cell.alias("cell")).count().collect()}  # CELLS rows at most
    parts = spark.createDataFrame(
        walk(counts, shards, vnodes, slack), "at int, first long, until long, shard int, first_slot long"
    )
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        cell.alias("cell"),
    )
    by_cell = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "text_crc32")
    rows = rows.withColumn("rank", F.row_number().over(by_cell).cast("long") - 1)
    on = (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until"))
    return rows.join(F.broadcast(parts), on).select(  # bounded by the ring, not by the data
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot")
    )


def op4(docs: DataFrame) -> DataFrame:
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
