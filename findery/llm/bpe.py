"""Byte-level BPE encoding and decoding with a local rank file (tiktoken).

Every match of the split pattern is encoded separately, as the library does by itself; no
special tokens. A text longer than ``CHUNK`` code points is first cut at *safe boundaries*:
places that no match of the pattern can cross and whose two sides do not influence each
other, so the ids are those of the whole text:

* before white space that follows something else (a match holds white space only at its start),
* between a letter and a digit in either order, and
* before a sign that follows a letter or digit.

A stretch without any such place stays whole. Matches of more than ``LONG_PIECE`` bytes (one
run of letters, say) go through a heap-based merge in O(n log n) with the same result.

Defined results: null and empty texts have no tokens; rows are independent, so ties, repeated
rows and nulls in other columns do not matter; an empty table gives an empty result. Columns
of the input named like an output are not carried.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
LONG_PIECE = 2_000
#: Rows of about so many bytes are put out at once.
OUT_BYTES = 4 << 20

_SAFE = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"
    r"|(?<=[\p{L}\p{N}])(?=[^\p{White_Space}\p{L}\p{N}])"
)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encodes and decodes one text at a time; one per Python worker."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the library's \s is Unicode's White_Space; Python's also has U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.library = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}
        )
        #: A run that long may hold a match which the library merges in quadratic time.
        self.long_run = regex.compile(
            r"\p{L}{%d}|\p{N}{%d}|[^\p{White_Space}\p{L}\p{N}]{%d}|\p{White_Space}{%d}" % ((LONG_PIECE // 4,) * 4)
        )

    def encode(self, text: str) -> list[int]:
        if len(text) <= CHUNK and len(text) < LONG_PIECE // 4:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for part in cut(text):
            if self.long_run.search(part):
                for m in self.split.finditer(part):
                    ids += self.encode_match(m.group().encode())
            else:
                ids += self.library.encode_ordinary(part)
        return ids

    def encode_match(self, piece: bytes) -> list[int]:
        if len(piece) <= LONG_PIECE:
            return self.library._core_bpe.encode_single_piece(piece)
        return merge(piece, self.ranks)

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def cut(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of at least ``size`` code points that end at safe boundaries."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None or m.start() >= len(text):
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one long match: lowest rank first, leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has grown since
        end[i] = stop
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode_decode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_file: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """``id_col``, ``token_ids array<int>``, ``decoded binary``: the ids and the bytes they stand for."""
    rank_file, pattern = rank_file or default_ranks(), pattern or default_pattern()
    src = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("row_text"))
    kind = src.schema["row_id"].dataType.simpleString()

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, ids, raw, held = 0, [], [], 0
            for i, t in enumerate(texts):
                t = t.as_py() or ""
                ids.append(c.encode(t))
                raw.append(c.decode(ids[-1]))
                held += 4 * len(ids[-1]) + len(raw[-1])
                if held >= OUT_BYTES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(start, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())],
                        names=["row_id", "token_ids", "decoded"],
                    )
                    start, ids, raw, held = i + 1, [], [], 0

    out = src.mapInArrow(run, f"row_id {kind}, token_ids array<int>, decoded binary")
    return out.withColumnRenamed("row_id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col``, ``decoded binary`` for rows that hold ids; null ids decode to no bytes."""
    rank_file, pattern = rank_file or default_ranks(), pattern or default_pattern()
    src = df.select(F.col(id_col).alias("row_id"), F.col(ids_col).cast("array<int>").alias("row_ids"))
    kind = src.schema["row_id"].dataType.simpleString()

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            raw = [c.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["row_id", "decoded"])

    return src.mapInArrow(run, f"row_id {kind}, decoded binary").withColumnRenamed("row_id", id_col)


def op10(docs: DataFrame) -> DataFrame:
    """The digests of the contract, from the operator's ids and bytes."""
    made = encode_decode(docs)
    return made.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
