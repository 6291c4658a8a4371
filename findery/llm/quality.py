"""Quality classifier of supervised subword embeddings.

A document is the average of learned vectors: one for each hashed word, word pair and character
n-gram (3 to 5 bytes of UTF-8, white space counting as a word's edge). A softmax layer over that
average gives the classes. Trained on the driver by numpy stochastic gradient descent over a bounded
sample of the labelled rows (``MAX_TRAIN_DOCS`` and ``MAX_TRAIN_BYTES``, those with the smallest hash of the id; whole texts);
featurised on the executors and sent as counts of buckets.

With two classes the layers collapse: a document's log odds are the average of one number for each
bucket, so what is broadcast for scoring is ``BUCKETS`` floats whatever the corpus.

Defined results: null and empty texts have the end feature alone and get its score; labels that are
null or belong to no document are ignored; a doc_id that is labelled twice counts once, with the larger
label; of the texts of a labelled doc_id that repeats the least one is learned; rows with the same doc_id are scored one by one; a very
long text or word is taken whole; other columns pass as they are, whatever their names; without both classes among the training labels
every score is the share of label 1 (0.5 with no label at all); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, is_space_table, materialise, pieces, planes, string_bytes, words
from .hashing import strings

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIM = 16
EPOCHS = 6
RATE = 0.5
MAX_TRAIN_DOCS = 3000
MAX_TRAIN_BYTES = 24 << 20
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 19

_SPACE = is_space_table()
_CODE = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)
_CODE[_SPACE] = _CODE[32]
_P = np.uint32(0x01000193)
_END = np.uint32(0xE0D)  # the feature that every text has


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)


def features(data: np.ndarray, offsets: np.ndarray):
    """Yields (document, bucket) arrays, in parts; the documents of a part do not fall."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    # white space around and between documents, so that none runs into the next
    at = offsets[:-1] + np.arange(1, n + 1)
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int32), lens)
    padded[np.arange(len(data)) + doc + 1] = data
    owner = np.repeat(np.arange(n, dtype=np.int32), lens + 1)
    owner = np.append(owner, np.int32(max(n - 1, 0)))  # the position of a document's leading space is its own
    space = _SPACE[padded]
    code = _CODE[padded]
    yield np.arange(n, dtype=np.int32), np.repeat(_bucket(np.array([_END]), 0), n)
    size = len(padded)
    solid = ~space
    h = code[: size - 1] * _P + code[1:]
    inner = solid[1 : size - 1]
    for k in (3, 4, 5):
        if size < k:
            break
        h = h[: size - k + 1] * _P + code[k - 1 :]
        if k > 3:
            inner = inner[: size - k + 1] & solid[k - 2 : size - 1]
        ok = np.flatnonzero(inner[: size - k + 1])
        yield owner[ok], _bucket(h[ok], k)
    starts = np.flatnonzero(solid[1:] & space[:-1]) + 1
    if not len(starts):
        return
    ends = np.flatnonzero(solid[:-1] & space[1:]) + 1  # white space ends every document, so every word
    words = (strings(padded, starts, ends) >> np.uint64(32)).astype(np.uint32)
    of = owner[starts]
    yield of, _bucket(words, 1)
    pair = of[1:] == of[:-1]
    yield of[1:][pair], _bucket(words[:-1][pair] * _P + words[1:][pair], 2)


def counts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its buckets and how often each occurs."""
    n = len(offsets) - 1
    keys = np.concatenate([d.astype(np.int64) * BUCKETS + b for d, b in features(data, offsets)]) if n else np.zeros(0, np.int64)
    keys, times = np.unique(keys, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(1, n) * BUCKETS)
    return list(zip(np.split((keys % BUCKETS).astype(np.int32), cuts), np.split(times.astype(np.float32), cuts), strict=True))


def packed(buckets: np.ndarray, times: np.ndarray) -> bytes:
    """A document's counts, small enough for the driver to hold all of the sample: steps between buckets, then times."""
    return zlib.compress(planes(np.concatenate([np.diff(buckets, prepend=np.int32(0)), times.astype(np.int64)]).astype(np.int64), 4), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = words(zlib.decompress(raw), 4)
    steps, times = both[: len(both) // 2], both[len(both) // 2 :]
    return np.cumsum(steps).astype(np.int32), times.astype(np.float32)


def train(docs: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number a bucket and a bias: the log odds of label 1 of the trained network. ``docs`` are ``packed``."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0 if not labels else (20.0 if y[0] else -20.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            idx, times = unpacked(docs[i])
            share = times / times.sum()
            v = vectors[idx]
            mean = share @ v
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            lr = rate * (1 - step / steps)
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            # shares are small; the factor lets a document of any length move its vectors alike
            vectors[idx] -= (lr / np.sqrt(share @ share)) * np.minimum(share, 0.1)[:, None] * back[None, :]
            step += 1
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int) -> DataFrame:
    """doc_id, text, label of at most ``limit`` labelled documents."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most ``limit`` short rows
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, float]:
    def featurise(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            rows = []
            for a, b in pieces(offsets, CHUNK_BYTES):
                rows += counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([packed(x, n) for x, n in rows], pa.binary())], names=["doc_id", "label", "counts"]
            )

    rows = training_rows(docs, labels, usable, max_docs)
    rows = materialise(rows.withColumn("text", F.coalesce("text", F.lit(""))), "labelled")
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("size"))  # at most ``max_docs`` rows
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("size")
    few = sizes.withColumn("before", before).where(F.col("before") < MAX_TRAIN_BYTES).select("doc_id")
    rows = rows.join(F.broadcast(few), "doc_id", "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "label").mapInArrow(featurise, f"doc_id {kind}, label int, counts binary").collect()
    got.sort(key=lambda r: r[0])
    return train([bytes(r[2]) for r in got], [r[1] for r in got])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with a last column ``quality_score`` (``_`` behind it where that name is taken): the probability of label 1."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    columns, last, first = docs.columns, free_name(docs.columns, "quality_score"), free_name(docs.columns, "scored_text")
    src = docs.select(F.col("text").cast("string").alias(first), *columns)

    def run(batches):
        w, b0 = shared.value
        for batch in batches:
            data, offsets = string_bytes(batch.column(0))
            out = np.zeros(len(offsets) - 1)
            for a, b in pieces(offsets, CHUNK_BYTES):
                total, times = np.zeros(b - a), np.zeros(b - a)
                for doc, bucket in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    total += np.bincount(doc, w[bucket], b - a)
                    times += np.bincount(doc, minlength=b - a)
                out[a:b] = 1 / (1 + np.exp(-(total / times + b0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names=[*columns, last])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*(src.schema[c] for c in columns)]).add(last, DoubleType())
    return src.mapInArrow(run, schema)


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, fold(5) != 0)
    held = F.coalesce(fold(5) == 0, F.lit(False))
    out = score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    model = fit(docs, labels, fold(5) != 0)
    columns = docs.columns
    return score(docs, model).where(F.col(free_name(columns, "quality_score")) >= THRESHOLD).select(*columns)
