"""The fielded inverted index: documents, postings, terms and collection statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import language, text, web, words

FIELDS = ("title", "body", "url")
LENGTHS = tuple(f"{f}_token_count" for f in FIELDS)
#: Columns of a document and what stands for a missing one.
DEFAULTS: dict[str, tuple[str, object]] = {
    "doc_id": ("long", None), "url": ("string", ""), "canonical_url": ("string", ""), "title": ("string", ""), "description": ("string", ""),
    "text": ("string", ""), "html": ("string", ""), "fetched_at": ("timestamp", None), "content_type": ("string", "text/html"),
    "status_code": ("int", 200), "language": ("string", ""), "pagerank": ("double", 0.0),
}


def with_defaults(docs: DataFrame, defaults: dict[str, tuple[str, object]] = DEFAULTS) -> DataFrame:
    """Missing columns and nulls get their defaults (additive schema migration)."""
    out = []
    for name, (kind, value) in defaults.items():
        c = F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(c, F.lit(value).cast(kind)) if value is not None else c).alias(name))
    return docs.select(*out)


def documents(docs: DataFrame, spellings: dict[str, str] | None = None, intents: Sequence = language.CITY_GUIDE) -> DataFrame:
    """The stored documents: defaults, token counts by field, topic, digests."""
    d = with_defaults(docs)
    d = d.withColumn("canonical_url", F.coalesce(F.nullif("canonical_url", F.lit("")), "url"))
    size = lambda c: words.count(F.col(c), spellings)
    d = d.withColumns({"title_token_count": size("title"), "body_token_count": size("text"), "url_token_count": size("url")})
    d = d.withColumn("__topic", language.classify(F.col("url"), F.col("title"), F.col("text"), intents))
    return d.withColumns(
        {
            "token_count": F.col("title_token_count") + F.col("body_token_count") + F.col("url_token_count"),
            "length": F.length("text"),
            "topic": F.col("__topic.topic"),
            "topic_confidence": F.col("__topic.confidence"),
            "sha256": F.sha2("html", 256),
            "content_fingerprint": text.fingerprint(F.col("title"), F.col("text")),
        }
    ).drop("__topic")


def postings(docs: DataFrame, spellings: dict[str, str] | None = None) -> DataFrame:
    """term, doc_id, and the term's frequency in title, body, url and all, in runs sorted by term.

    A document's postings are made where it is read, so nothing is shuffled unless ids are repeated, which is looked up first.
    Field lengths that ``docs`` has go along, so that ranking needs no join with the documents.
    """
    known = [c for c in LENGTHS if c in docs.columns]
    whole = lambda c: text.lowered(F.coalesce(F.col(c), F.lit("")), spellings).alias(f"__{c}")
    rows = docs.select("doc_id", *known, *map(whole, ("title", "text", "url")))
    counts = ["term_frequency", *[f"{f}_frequency" for f in FIELDS]]
    schema = StructType([StructField("term", StringType()), rows.schema["doc_id"], *[StructField(c, IntegerType()) for c in counts], *[rows.schema[c] for c in known]])

    def run(batches):
        for batch in batches:
            for at, term, by_field in words.postings(batch, ("__title", "__text", "__url")):
                frequencies = [pa.array(x.astype(np.int32)) for x in (sum(by_field), *by_field)]
                took = batch.select(["doc_id", *known]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([term, took.column(0), *frequencies, *took.columns[1:]], names=schema.names)

    out = rows.mapInArrow(run, schema)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out
    return out.groupBy("term", "doc_id").agg(*[F.sum(c).cast("int").alias(c) for c in counts], *[F.max(c).alias(c) for c in known])


def terms(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("document_frequency"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs and the mean field lengths, at least 1."""
    mean = lambda c: F.greatest(F.coalesce(F.avg(c), F.lit(0.0)), F.lit(1.0))
    return docs.agg(F.count("*").alias("n_docs"), *[mean(f"{f}_token_count").alias(f"avg_{f}") for f in FIELDS])


@dataclass
class Index:
    """The tables of a collection."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    links: DataFrame | None = None
    spellings: dict[str, str] | None = None
    stats: DataFrame | None = None

    def collection(self) -> DataFrame:
        """The stored row of collection statistics, or a new one."""
        return self.stats if self.stats is not None else collection_stats(self.documents)

    @classmethod
    def build(cls, docs: DataFrame, spellings: dict[str, str] | None = None, links: DataFrame | None = None, intents: Sequence = language.CITY_GUIDE) -> Index:
        d = documents(docs, spellings, intents)
        post = postings(d, spellings)
        return cls(d, post, terms(post), links, spellings)

    def save(self, path: str) -> None:
        """Postings are range-partitioned and sorted by term, so that a literal term list skips row groups."""
        self.documents.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/documents")
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.documents.sparkSession
        terms(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
        collection_stats(spark.read.parquet(f"{path}/documents")).write.mode("overwrite").parquet(f"{path}/stats")
        if self.links is not None:
            self.links.write.mode("overwrite").parquet(f"{path}/links")

    @classmethod
    def load(cls, spark: SparkSession, path: str, spellings: dict[str, str] | None = None, links: bool = False) -> Index:
        read = lambda t: spark.read.option("mergeSchema", True).parquet(f"{path}/{t}")
        return cls(read("documents"), read("postings"), read("terms"), read("links") if links else None, spellings, read("stats"))

    def register(self, prefix: str = "") -> None:
        """The tables as temporary views, for SQL."""
        for name in ("documents", "postings", "terms", "links"):
            if (df := getattr(self, name)) is not None:
                df.createOrReplaceTempView(prefix + name)


def latest(docs: DataFrame) -> DataFrame:
    """One row for each url: the last fetched, then the largest id."""
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("doc_id"))
    return docs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace documents by url: ``new`` wins, the rest stays."""
    return old.join(new.select("url").distinct(), "url", "left_anti").unionByName(latest(new), allowMissingColumns=True)


def record_links(links: DataFrame) -> DataFrame:
    """source_url, target_url, anchor_text (500), discovered_at: no empty and self links; the last anchor wins."""
    ok = (F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("target_url", F.lit("")) != "") & (F.col("source_url") != F.col("target_url"))
    cut = links.where(ok).withColumn("anchor_text", F.substring(F.coalesce("anchor_text", F.lit("")), 1, 500))
    return cut.groupBy("source_url", "target_url").agg(F.max_by("anchor_text", F.struct("discovered_at", "anchor_text")).alias("anchor_text"), F.max("discovered_at").alias("discovered_at"))


def statistics(docs: DataFrame, term_table: DataFrame, frontier: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts: documents, mean tokens, terms, queued, links, domains."""
    one = docs.agg(F.count("*").alias("documents"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_tokens"), F.countDistinct(domain(F.col("url"))).alias("domains"))
    more = (term_table.agg(F.count("*").alias("unique_terms")), frontier.where("status = 'queued'").agg(F.count("*").alias("queued")), links.agg(F.count("*").alias("links")))
    for m in more:
        one = one.crossJoin(m)  # of single rows
    return one


def domain(url: Column) -> Column:
    return web.between_slashes(url)


def export_rows(docs: DataFrame) -> DataFrame:
    """The columns of the JSON lines export, ordered by id."""
    cols = "doc_id url canonical_url title description text fetched_at content_type status_code language topic pagerank".split()
    return docs.select(*cols).orderBy("doc_id")


def export_jsonl(docs: DataFrame, path: str) -> None:
    """JSON lines in id order (parts sort by name); nulls are written."""
    export_rows(docs).write.mode("overwrite").option("ignoreNullFields", False).json(path)
