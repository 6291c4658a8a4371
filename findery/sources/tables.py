"""Views of the given tables in the shapes that the engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import Intent
from ..operators.index import Index, collection_stats, postings, terms
from ..scratch import stored

QUERIES = (("q1", "estion ndtion"), ("q2", "ersch enlich"), ("q3", "src3 inging inging"), ("q4", "the of and"), ("q5", "zzzzunknown"))
LEXICON = (
    Intent("a", "Topic A", ("estion", "ndtion", "ingor"), ("tionre", "ortion")),
    Intent("b", "Topic B", ("ersch", "enlich", "ensch"), ("inging",)),
    Intent("c", "Topic C", ("onbleea", "ntble"), ("esing",)),
)
_indexes: dict[tuple[str, str], Index] = {}


#: Bytes of files that one part of a table that is dealt out holds.
PART_BYTES = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where its files make fewer splits than there are cores; larger tables stay as they are read.

    Rows are dealt by ``key``: dealt in turn they would be sorted before, texts and all.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // PART_BYTES)), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(QUERIES)], "ord int, qid string, query string")


def corpus(spark: SparkSession, sf_dir: str, by_language: bool = False) -> DataFrame:
    """Documents with a title (the first line's first 200 characters) and an address by source or language."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    host, path = ("lang", F.concat(F.lit("doc/"), F.col("doc_id"))) if by_language else ("source", F.concat("lang", F.lit("/"), F.col("doc_id")))
    url = F.concat(F.lit("https://"), F.col(host), F.lit(".example.org/"), path)
    return d.select(
        "doc_id", url.alias("url"), F.lit("").alias("canonical_url"), F.substring(F.substring_index("text", "\n", 1), 1, 200).alias("title"), F.lit("").alias("description"), "text", F.col("lang").alias("language")
    )


def corpus_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of ``corpus``, built once a session and folder, and stored."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        built = Index.build(corpus(spark, sf_dir), intents=LEXICON)
        docs = stored(built.documents, "documents")
        post = stored(postings(docs), "postings")
        _indexes[key] = Index(docs, post, stored(terms(post), "terms"), stats=stored(collection_stats(docs), "stats"))
    return _indexes[key]


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (suppliers) and links between them from all order lines; every seventh supplier has none of its own, so that some nodes dangle."""
    s, line = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    n = s.count()
    e = line.where("l_suppkey % 7 <> 0").select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") % n).cast("long").alias("dst"))
    return s.select(F.col("s_suppkey").cast("long").alias("doc_id")), e.where("src <> dst").distinct()


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl frontier from the pages: status, attempts and age follow from page_id."""
    from ..functions import web

    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    status = F.get(F.array(F.lit("queued"), F.lit("visited"), F.lit("error"), F.lit("skipped")), (i % 4).cast("int"))
    error = F.when(i % 4 == 2, F.when(i % 3 == 0, "read timed out").otherwise("404"))
    return p.select(
        "page_id", "url", status.alias("status"), F.timestamp_seconds(F.lit(1_700_000_000) + i % 97).alias("discovered_at"), F.lit(None).cast("timestamp").alias("last_attempt_at"),
        (i % 5).cast("int").alias("attempts"), web.priority(F.col("url")).alias("priority"), error.alias("error"), F.lit(0).alias("depth"), F.lit(0).alias("bridge_steps"),
        F.lit(False).alias("context_relevant"), web.host(F.col("url")).alias("source_host"), (i % 2 == 1).alias("retryable"), F.lit(None).cast("int").alias("http_status"),
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, url, rel: graded judgments that follow from doc_id, for the queries with hits."""
    d = corpus(spark, sf_dir).where("doc_id % 7 = 0").select("url", (F.col("doc_id") % 4).cast("double").alias("rel"))
    return d.crossJoin(F.broadcast(queries(spark).where("ord < 3").select("qid")))  # three fixed queries
