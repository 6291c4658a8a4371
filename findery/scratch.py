"""Intermediate tables in the folder that the cluster shares, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: Parquet readers take at most this many values of one IN list as they are; of more they take the range alone.
IN_LIST = 10


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/findery/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the table has at most ``rows`` rows and ``size`` bytes; as it is (a shuffled join) beyond."""
    wide = [f.name for f in df.schema if not isinstance(f.dataType, NumericType | BooleanType)]
    width = F.lit(8 * len(df.columns)) + (F.coalesce(F.octet_length(F.to_json(F.struct(*wide))), F.lit(0)) if wide else F.lit(0))
    n, held = df.select(width.alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def one_of(c: Column, values: Sequence) -> Column:
    """``c`` in a list, put so that a scan of sorted Parquet skips what holds none of the values, however many they are."""
    values = sorted(values)
    parts = [c.isin(values[i : i + IN_LIST]) for i in range(0, len(values), IN_LIST)]
    while len(parts) > 1:  # a balanced tree
        parts = [a | b for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) & ~1 :]
    return c.isin(values) & parts[0] if parts else F.lit(False)
