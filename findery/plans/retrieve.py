"""End-to-end retrieval for a table of queries: one plan, keyed by query id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, text, web
from ..operators import duplicates, ranking, results, semantic
from ..operators.index import Index
from ..scratch import stored
from ..sources import files


def two_stages(index: Index, queries: DataFrame, intents: Sequence = language.CITY_GUIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first pool, second pool, expansion): BM25F, feedback and intents, BM25F again."""
    original = ranking.term_weights(queries, index.spellings)
    first = stored(ranking.bm25f(index, original), "first")
    more = stored(ranking.expansion(ranking.feedback_terms(index, queries, first), language.expansion_terms(queries, intents)), "expansion")
    with_hits = more.join(first.select("qid").distinct(), "qid", "left_semi")
    second = stored(ranking.bm25f(index, ranking.expanded(original, with_hits)), "second")
    return first, second.join(first.select("qid").distinct(), "qid", "left_semi"), more


def score(index: Index, queries: DataFrame, intents: Sequence = language.CITY_GUIDE) -> tuple[DataFrame, DataFrame]:
    """(all candidates with every component and the fused ``score``, expansion)."""
    first, second, more = two_stages(index, queries, intents)
    rows = stored(ranking.signals(index, queries, ranking.candidates(first, second), intents), "signals")
    pool = ranking.top(rows.withColumn("score", ranking.fuse(ranking.FIRST_CUT)), ranking.SEMANTIC_POOL)
    meaning = ranking.minmax(semantic.semantic_scores(pool), "semantic_raw", "semantic").select("qid", "doc_id", "semantic")
    rows = rows.join(meaning, ["qid", "doc_id"], "left").na.fill(0.0, ["semantic"])
    return rows.withColumn("score", ranking.fuse(ranking.FINAL)), more


def retrieve(index: Index, queries: DataFrame, top_k: int = 100, intents: Sequence = language.CITY_GUIDE) -> DataFrame:
    """The result records of all queries, at most 100 each; queries without terms or hits have none."""
    top_k = max(1, min(int(top_k), 100))
    rows, more = score(index, queries, intents)
    rows = stored(duplicates.signature(rows.withColumn("domain", web.authority(F.col("canonical_url"))), index.spellings), "fused")
    chosen = ranking.minmax(duplicates.select_results(rows, top_k), "adjusted", "final")
    words = more.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), 1, ranking.FEEDBACK_TERMS).alias("e"))
    out = chosen.join(rows.drop("score"), ["qid", "doc_id"]).join(words.select("qid", F.transform("e", lambda x: x["term"]).alias("expansion_terms")), "qid", "left")
    seen = results.matched_terms(F.col("terms"), F.col("title"), F.col("description"), F.substring("text", 1, 15_000), F.col("canonical_url"))
    out = out.withColumn("matched_terms", seen)
    out = text.with_snippet(out, F.coalesce(F.nullif("description", F.lit("")), "text"), F.col("terms"))
    r = lambda c, d=6: F.round(F.col(c), d)
    parts = F.create_map(*[v for k in (*ranking.FINAL, "diversity_penalty") for v in (F.lit(k), r(k, 4))])
    return out.select(
        "qid", "rank", "doc_id", F.col("canonical_url").alias("url"), "title", r("final").alias("score"),
        "snippet",
        text.reading_minutes(F.col("text")).alias("reading_time_mins"), r("bm25_score").alias("bm25_score"), r("expanded_score").alias("expanded_score"),
        r("semantic").alias("semantic_score"), r("authority").alias("authority_score"), F.col("topic").alias("intent"), language.label_of(F.col("topic"), intents).alias("intent_label"),
        F.col("domain").alias("source_domain"), "matched_terms", F.coalesce("expansion_terms", F.array().cast("array<string>")).alias("expansion_terms"), parts.alias("score_components"),
        results.why(F.col("terms"), F.col("matched_terms"), F.col("topic"), F.col("semantic"), F.col("intent"), F.col("authority")).alias("why"),
    )


def run_batch_file(spark: SparkSession, index: Index, query_file: str, out: str, top_k: int = 100) -> DataFrame:
    """Answer a query file and write its lines; returns the results."""
    queries = files.read_queries(spark, query_file)
    found = stored(retrieve(index, queries, top_k), "batch")
    results.write_batch(found, queries, out)
    return found


def lucky(index: Index, queries: DataFrame) -> DataFrame:
    """qid, url of the best result."""
    return retrieve(index, queries, 1).where("rank = 1").select("qid", "url")


def analyse(queries: DataFrame, intents: Sequence = language.CITY_GUIDE) -> DataFrame:
    """qid, terms, intents: how queries are understood."""
    found = language.query_intents(queries, intents).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "intent", "label", "strength"))).alias("intents"))
    return queries.select("qid", text.query_terms(F.col("query")).alias("terms")).join(found, "qid")
