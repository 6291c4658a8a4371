"""Set-at-a-time ranking: every stage is keyed by query id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language, stopwords, text, words
from ..scratch import broadcast_if_small, one_of, stored
from .index import FIELDS, LENGTHS, Index
from .index import postings as postings_of

K1 = 1.2
WEIGHTS = {"title": 2.6, "body": 1.0, "url": 1.8}
B = {"title": 0.35, "body": 0.75, "url": 0.20}
POOL = 750
FEEDBACK_DOCS, FEEDBACK_TERMS, FEEDBACK_TOP = 10, 12, 0.30
SEMANTIC_POOL = 250
FINAL = {"bm25f": 0.18, "feedback": 0.54, "semantic": 0.12, "intent": 0.08, "metadata": 0.06, "authority": 0.02}
FIRST_CUT = {"bm25f": 0.25, "feedback": 0.60, "metadata": 0.10, "intent": 0.05}
#: Query terms up to this number are also given to the scan as a literal list.
PUSHED_TERMS = 2_000


def term_weights(queries: DataFrame, spellings: dict[str, str] | None = None) -> DataFrame:
    """qid, term, weight (how often the query has it)."""
    return queries.select("qid", F.explode(text.query_terms(F.col("query"), spellings)).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("weight"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top(df: DataFrame, n: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The n best of each query, ties by key, with their ``rank`` (Spark prunes groups before the sort).

    Scores that differ by less than 1e-9 tie: sums of the same parts depend on their order by that much.
    """
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def bm25f(index: Index, weights: DataFrame, limit: int | None = POOL) -> DataFrame:
    """qid, doc_id, score, rank: one saturation over weighted, length-normalised fields."""
    weights = weights.where("weight > 0")
    asked = [r[0] for r in weights.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    post = index.postings
    if len(asked) <= PUSHED_TERMS:
        post = post.where(one_of(F.col("term"), asked))  # reaches the scan; a join does not
    if not set(LENGTHS) <= set(post.columns):
        post = post.join(index.documents.select("doc_id", *LENGTHS), "doc_id")
    rows = post.join(broadcast_if_small(weights), "term").join(broadcast_if_small(index.terms.join(broadcast_if_small(weights.select("term").distinct()), "term", "left_semi")), "term")
    rows = rows.crossJoin(F.broadcast(index.collection()))  # one row
    tf = F.lit(0.0)
    for f in FIELDS:
        norm = F.greatest(F.lit(0.05), (1 - B[f]) + B[f] * F.col(f"{f}_token_count") / F.col(f"avg_{f}"))
        tf = tf + WEIGHTS[f] * F.col(f"{f}_frequency") / norm
    rows = rows.withColumn("tf", tf).where("tf > 0")
    part = F.col("weight") * idf(F.col("n_docs"), F.col("document_frequency")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1)
    scores = rows.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
    return scores if limit is None else top(scores, limit)


def fetched(index: Index, ids: DataFrame, *columns: str) -> DataFrame:
    """doc_id and ``columns`` of some documents: by literal ids, where they are few, or by a join."""
    ids = ids.select("doc_id").distinct()
    some = [r[0] for r in ids.limit(PUSHED_TERMS + 1).collect()]
    docs = index.documents.select("doc_id", *columns)
    return docs.where(one_of(F.col("doc_id"), some)) if len(some) <= PUSHED_TERMS else docs.join(broadcast_if_small(ids), "doc_id", "left_semi")


def feedback_terms(index: Index, queries: DataFrame, scores: DataFrame, docs: int = FEEDBACK_DOCS, limit: int = FEEDBACK_TERMS) -> DataFrame:
    """qid, term, weight: pseudo-relevance feedback from the best documents, scaled to ``FEEDBACK_TOP``.

    Postings are sorted by term, so the few documents are read by id and their postings made anew.
    """
    best = top(scores.select("qid", "doc_id", "score"), docs).select("qid", "doc_id", (1 / F.log(F.col("rank") + 2)).alias("rank_weight"))
    best = stored(best, "feedback")
    own = queries.select("qid", F.explode(text.query_terms(F.col("query"), index.spellings)).alias("term")).distinct()
    rows = postings_of(fetched(index, best, "title", "text", "url", *LENGTHS), index.spellings)
    rows = rows.where((F.length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$") & ~text.in_words(F.col("term"), stopwords.ALL))
    rows = stored(rows, "feedback_postings")
    known = index.terms.join(broadcast_if_small(rows.select("term").distinct()), "term", "left_semi")
    rows = rows.join(broadcast_if_small(best), "doc_id").join(broadcast_if_small(own), ["qid", "term"], "left_anti")
    rows = rows.join(broadcast_if_small(known), "term").crossJoin(F.broadcast(index.collection().select("n_docs"))).where(F.col("document_frequency") / F.col("n_docs") <= 0.40)
    part = F.col("body_frequency") / F.greatest("body_token_count", F.lit(1)) * idf(F.col("n_docs"), F.col("document_frequency")) * F.col("rank_weight")
    got = top(rows.groupBy("qid", "term").agg(F.sum(part).alias("score")), limit, key="term")
    most = F.max("score").over(Window.partitionBy("qid"))
    return got.select("qid", "term", F.when(most > 0, FEEDBACK_TOP * F.col("score") / most).otherwise(0.0).alias("weight"))


def expansion(feedback: DataFrame, intent: DataFrame) -> DataFrame:
    """qid, term, weight: the larger of both."""
    return feedback.unionByName(intent).groupBy("qid", "term").agg(F.max("weight").alias("weight"))


def expanded(original: DataFrame, more: DataFrame) -> DataFrame:
    return original.unionByName(more).groupBy("qid", "term").agg(F.sum("weight").alias("weight"))


def minmax(df: DataFrame, value: str, out: str, key: str = "qid") -> DataFrame:
    """``value`` scaled to 0..1 within a query; a constant becomes 1 if positive, else 0."""
    w = Window.partitionBy(key)
    lo, hi, x = F.min(value).over(w), F.max(value).over(w), F.col(value)
    flat = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return df.withColumn(out, F.when(flat, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((x - lo) / (hi - lo)))


def candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of both pools with raw and scaled scores, 0 where a document is in one only."""
    a = minmax(first.select("qid", "doc_id", F.col("score").alias("bm25_score")), "bm25_score", "bm25f")
    b = minmax(second.select("qid", "doc_id", F.col("score").alias("expanded_score")), "expanded_score", "feedback")
    return a.join(b, ["qid", "doc_id"], "full").na.fill(0.0, ["bm25_score", "bm25f", "expanded_score", "feedback"])


VISIBLE = ("seen_title", "seen_url", "seen_body", "flat_title", "flat_body")


def visible(rows: DataFrame, wanted: str, spellings: dict[str, str] | None = None) -> DataFrame:
    """``rows`` and the columns of ``VISIBLE``: which terms of the array ``wanted`` a document has where, and its folded title and text."""
    title, url, body = F.col("title"), F.col("canonical_url"), F.substring("text", 1, 15_000)
    seen = {f"seen_{n}": words.present(c, F.col(wanted), spellings) for n, c in (("title", title), ("url", url), ("body", body))}
    return rows.withColumns(seen | {"flat_title": words.folded(title, spellings), "flat_body": words.folded(F.substring("text", 1, 20_000), spellings)})


def metadata_signal(spellings: dict[str, str] | None = None) -> Column:
    """Agreement of ``terms``/``query`` with title, url and text of the same row (``VISIBLE``)."""
    want = F.array_distinct("terms")
    share = lambda *c: F.size(F.array_intersect(want, F.concat(*c))) / F.size(want)
    phrase = text.normalize(F.col("query"), spellings)
    has = lambda c: F.when((phrase != "") & F.col(c).contains(phrase), 1.0).otherwise(0.0)
    total = 0.35 * share("seen_title", "seen_url", "seen_body") + 0.30 * share("seen_title") + 0.10 * share("seen_url") + 0.15 * has("flat_title") + 0.10 * has("flat_body")
    return F.when(F.size("terms") == 0, 0.0).otherwise(F.least(F.lit(1.0), total))


def fuse(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * F.col(name)
    return out


def signals(index: Index, queries: DataFrame, pool: DataFrame, intents: Sequence = language.CITY_GUIDE) -> DataFrame:
    """``pool`` with metadata, intent and authority scores, and the documents' columns.

    The pool is what is broadcast (where it is small), so the texts are read once and not shuffled before they are few.
    """
    asked = queries.select("qid", "query", text.query_terms(F.col("query"), index.spellings).alias("terms"))
    cols = ["doc_id", "canonical_url", "title", "description", "text", "topic", "content_fingerprint", "pagerank"]
    pool = stored(pool.join(broadcast_if_small(asked), "qid"), "pool")
    rows = index.documents.select(*cols).join(broadcast_if_small(pool), "doc_id")
    rows = visible(rows, "terms", index.spellings).withColumn("metadata", metadata_signal(index.spellings)).drop(*VISIBLE)
    rows = minmax(rows, "pagerank", "authority")
    names = rows.columns
    seen = rows.withColumn("keyword_hits", language.keyword_hits(F.col("canonical_url"), F.col("title"), F.col("text"), intents, index.spellings))
    match = language.intent_match(seen, language.query_intents(queries, intents), intents, names)
    return match.withColumnRenamed("intent_score", "intent")
