"""Rank evaluation: runs, judgments, nDCG, and checks of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 20)


def run_positions(run: DataFrame) -> DataFrame:
    """qid, url, position: by given rank, then url; the rank's value itself does not matter."""
    w = Window.partitionBy("qid").orderBy(F.col("rank").cast("int"), "url")
    return run.select("qid", "url", F.row_number().over(w).alias("position"))


def gain(rel: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(position + 1)


def dcg(rels: Column, k: int = 10) -> Column:
    """Of an array of relevances in ranked order."""
    return F.aggregate(F.transform(F.slice(rels, 1, k), lambda r, i: gain(r, i + 1)), F.lit(0.0), lambda a, x: a + x)


def ndcg(rels: Column, k: int = 10) -> Column:
    """Against the ideal order of the same list; 0 where that is 0."""
    best = dcg(F.sort_array(rels, asc=False), k)
    return F.when(best > 0, dcg(rels, k) / best).otherwise(0.0)


def ndcg_by_query(run: DataFrame, qrels: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """qid, cutoff, ndcg for every judged query; unretrieved judgments count in the ideal."""
    ks = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("cutoff")
    ranked = qrels.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "url")))
    ideal = ranked.select("*", ks).where(F.col("position") <= F.col("cutoff")).groupBy("qid", "cutoff").agg(F.sum(gain(F.col("rel"), F.col("position"))).alias("ideal"))
    got = run_positions(run).join(qrels, ["qid", "url"]).select("*", ks).where(F.col("position") <= F.col("cutoff"))
    got = got.groupBy("qid", "cutoff").agg(F.sum(gain(F.col("rel"), F.col("position"))).alias("dcg"))
    share = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return ideal.join(got, ["qid", "cutoff"], "left").select("qid", "cutoff", share.alias("ndcg"))


def evaluate(run: DataFrame, qrels: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """cutoff, ndcg, queries: the mean over judged queries."""
    return ndcg_by_query(run, qrels, cutoffs).groupBy("cutoff").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("queries"))


def validate(results: DataFrame, expected: int = 100) -> DataFrame:
    """qid, too_few, repeated_urls, rising_scores: the warnings of a batch."""
    w = Window.partitionBy("qid").orderBy("rank")
    rises = F.col("score") > F.lag("score").over(w)
    return results.withColumn("rises", rises).groupBy("qid").agg(
        (F.count("*") < expected).alias("too_few"), (F.countDistinct("url") < F.count("*")).alias("repeated_urls"), F.coalesce(F.max("rises"), F.lit(False)).alias("rising_scores")
    )
