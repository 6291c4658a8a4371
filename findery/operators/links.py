"""The link graph: resolving addresses and authority by PageRank."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

DAMPING, ITERATIONS, CUT_EVERY = 0.85, 25, 2


def resolve(docs: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst: distinct links between documents. An address that several documents have is the largest id's."""
    by_url = docs.select(F.col("url").alias("u"), "doc_id").union(docs.where("canonical_url <> ''").select("canonical_url", "doc_id")).groupBy("u").agg(F.max("doc_id").alias("id"))
    a = links.join(by_url.withColumnsRenamed({"u": "source_url", "id": "src"}), "source_url")
    b = a.join(by_url.withColumnsRenamed({"u": "target_url", "id": "dst"}), "target_url")
    return b.where("src <> dst").select("src", "dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, pagerank: a fixed number of rounds; the mass of nodes without links goes to all. Ranks sum to 1.

    Edges and nodes are dealt by source once and kept so (a lost part is dealt again from the stored table); a round shuffles
    the shares by target alone, summed before. The dangling mass stays in the plan (one row), and every second round the ranks go to
    the shared folder.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.select("doc_id").distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    out = stored(edges.join(degree, "src"), "edges").repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    nodes = stored(nodes.join(degree.withColumnRenamed("src", "doc_id"), "doc_id", "left").select("doc_id", F.col("degree").isNull().alias("dangling")), "nodes")
    nodes = nodes.repartition(parts, "doc_id").persist(StorageLevel.DISK_ONLY)
    n = nodes.count()
    if not n:
        return nodes.select("doc_id", F.lit(0.0).alias("pagerank"))
    ranks = nodes.select("doc_id", "dangling", F.lit(1.0 / n).alias("r"))
    for i in range(1, iterations + 1):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)).alias("loose"))
        given = out.join(ranks.select(F.col("doc_id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.col("r") / F.col("degree")).alias("got"))
        after = nodes.join(given, "doc_id", "left").crossJoin(F.broadcast(loose))  # one row
        r = (1 - damping) / n + damping * F.col("loose") / n + damping * F.coalesce("got", F.lit(0.0))
        ranks = after.select("doc_id", "dangling", r.alias("r"))
        if i % CUT_EVERY == 0 or i == iterations:
            ranks = stored(ranks, "ranks")
    out.unpersist()
    nodes.unpersist()
    return ranks.select("doc_id", F.col("r").alias("pagerank"))


def with_pagerank(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    return docs.drop("pagerank").join(ranks, "doc_id", "left").na.fill(0.0, ["pagerank"])
