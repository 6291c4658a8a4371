"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the contracts, in the pattern language of both engines.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder, in folders by a last column ``by``, and read it back, which cuts its lineage.

    The table survives lost executors; it goes when the driver ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/findery/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path, partitionBy=by)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._findery_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``; its readers must be done."""
    path = getattr(df, "_findery_path", None)
    if path:
        _delete(df.sparkSession, path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan needs any more; else it does when the driver happens to collect its garbage."""
    for _ in range(2):  # the gateway lets go of the last plan in the first
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


def free_name(columns: list[str], base: str) -> str:
    """``base``, with ``_`` behind it as long as a column has that name (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else (``lower`` folds all of Unicode)."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as one byte array and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offsets: np.ndarray, limit: int):
    """Ranges of rows of about ``limit`` bytes each; one row may exceed it alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    moved = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=moved)
        x ^= moved
        x *= np.uint64(factor)
    np.right_shift(x, np.uint64(31), out=moved)
    x ^= moved
    return x


def planes(x: np.ndarray, width: int = 8) -> bytes:
    """The bytes of whole numbers, place by place: the upper places compress to little."""
    return np.ascontiguousarray(x.astype("<i8" if x.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def words(raw: bytes, width: int = 8) -> np.ndarray:
    """``planes`` back, without a sign."""
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def is_space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table
