"""A stream of page files becomes an index: parse, keep the last version of each address, rebuild what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as ix
from ..sources import html

PAGES = "page_id long, url string, html string, fetched_at timestamp"


def read_pages(spark: SparkSession, path: str, watermark: str = "1 day", per_trigger: int = 100) -> DataFrame:
    """Arriving pages; a page that comes again unchanged within the watermark is dropped."""
    src = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(path)
    new = src.withColumn("digest", F.sha2("html", 256)).withWatermark("fetched_at", watermark)
    return new.dropDuplicatesWithinWatermark(["url", "digest"]).drop("digest")


def index_stream(pages: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch appends documents and postings as a version; ``current`` resolves versions by url.

    A batch writes to a folder of its own number, so a repeated batch overwrites itself (exactly once).
    """

    def add(batch: DataFrame, number: int) -> None:
        docs = ix.documents(ix.latest(html.page_documents(batch)).drop("html_lang", "links"))
        docs.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/documents/version={number}")
        ix.postings(docs).write.mode("overwrite").parquet(f"{out}/postings/version={number}")

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str) -> ix.Index:
    """The index of the last version of every address."""
    docs = spark.read.parquet(f"{out}/documents")
    last = docs.groupBy("url").agg(F.max("version").alias("version"))
    docs = docs.join(last, ["url", "version"])
    post = spark.read.parquet(f"{out}/postings").join(docs.select("doc_id", "version"), ["doc_id", "version"]).drop("version")
    return ix.Index(docs.drop("version"), post, ix.terms(post))
