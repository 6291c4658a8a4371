"""Text formats: query files, judgments and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES, MAX_QUERY_CHARS = 1_000_000, 300


class FormatError(ValueError):
    """A file that does not keep its format."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line: non-empty lines that are no comments, without a byte-order mark."""
    raw = spark.read.option("wholetext", True).text(path)  # one file keeps its line order
    rows = raw.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", "^﻿", "")))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def parse_queries(rows: DataFrame) -> DataFrame:
    """ord, qid, query: split at the first tab, else at the first white space."""
    at_tab = F.col("line").contains("\t")
    cut = lambda g: F.when(at_tab, F.regexp_extract("line", r"^([^\t]*)\t(.*)$", g)).otherwise(F.regexp_extract("line", r"^(\S+)\s+(.*)$", g))
    return rows.select(F.col("line_no").alias("ord"), F.trim(cut(1)).alias("qid"), F.trim(cut(2)).alias("query"))


def query_faults(queries: DataFrame) -> DataFrame:
    """qid, fault: incomplete lines and repeated ids."""
    bad = queries.where((F.col("qid") == "") | (F.col("query") == "")).select("qid", F.lit("incomplete line").alias("fault"))
    twice = queries.where("qid <> ''").groupBy("qid").count().where("count > 1").select("qid", F.lit("repeated id").alias("fault"))
    return bad.union(twice)


def read_queries(spark: SparkSession, path: str, upload: bool = False) -> DataFrame:
    """A checked query file. ``upload`` adds the limits for uploaded files."""
    rows = lines(spark, path)
    out = parse_queries(rows)
    if (first := query_faults(out).first()) is not None:
        raise FormatError(f"{path}: {first['fault']} ({first['qid']!r})")
    if upload:
        size = rows.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
        if not size or size > MAX_UPLOAD_BYTES:
            raise FormatError(f"{path}: {'empty' if not size else 'too large'}")
        if (long := out.where(F.length("query") > MAX_QUERY_CHARS).first()) is not None:
            raise FormatError(f"{path}: query {long['qid']!r} is too long")
    return out


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, url, rel; the last line about a pair holds."""
    p = F.split("line", "\t")
    rows = lines(spark, path).select("line_no", p.alias("p"))
    if rows.where(F.size("p") != 3).first() is not None or rows.where(F.expr("try_cast(p[2] as double)").isNull()).first() is not None:
        raise FormatError(f"{path}: lines must be qid, url, relevance")
    rows = rows.select("line_no", F.trim(F.get("p", F.lit(0))).alias("qid"), F.trim(F.get("p", F.lit(1))).alias("url"), F.get("p", F.lit(2)).cast("double").alias("rel"))
    return rows.groupBy("qid", "url").agg(F.max_by("rel", "line_no").alias("rel"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, rank, url, score; a pair may occur once."""
    p = F.split("line", "\t")
    rows = lines(spark, path).select(p.alias("p"))
    if rows.where(F.size("p") != 4).first() is not None:
        raise FormatError(f"{path}: lines must be qid, rank, url, score")
    rows = rows.select(F.trim(F.get("p", F.lit(0))).alias("qid"), F.expr("try_cast(p[1] as int)").alias("rank"), F.trim(F.get("p", F.lit(2))).alias("url"), F.expr("try_cast(p[3] as double)").alias("score"))
    if rows.where("rank is null or score is null").first() is not None or rows.groupBy("qid", "url").count().where("count > 1").first() is not None:
        raise FormatError(f"{path}: bad number or repeated url")
    return rows
