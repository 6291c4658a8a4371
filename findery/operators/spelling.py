"""Spelling vocabulary and corrections by symmetric deletes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..scratch import broadcast_if_small

MIN_FREQUENCY, PREFIX, BUILD_EDITS, MAX_EDITS = 3, 7, 3, 2
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def counts(docs: DataFrame) -> DataFrame:
    """word, n: surface words of title, description and text, lower case."""
    cols = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "text") if c in docs.columns]
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *cols)), F.lit(WORD_PATTERN), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(word_counts: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    return word_counts.where((F.col("n") >= min_frequency) & (F.length("word") >= 2))


def deletes(words: DataFrame, edits: int = BUILD_EDITS, prefix: int = PREFIX) -> DataFrame:
    """form and the columns of ``words`` (distinct): what is left of a word's prefix after up to ``edits`` deletions.

    A word's forms are made where it is read; nothing is shuffled.
    """
    one = lambda f: F.transform(F.sequence(F.lit(1), F.length(f)), lambda i: F.concat(F.substring(f, F.lit(1), i - 1), F.substring(f, i + 1, F.length(f))))
    shorter = lambda forms: F.array_distinct(F.flatten(F.transform(F.filter(forms, lambda f: F.length(f) > 0), one)))
    rows, levels = words.withColumn("__0", F.array(F.substring("word", 1, prefix))), ["__0"]
    for k in range(1, edits + 1):
        rows = rows.withColumn(f"__{k}", shorter(F.col(levels[-1])))
        levels.append(f"__{k}")
    return rows.select(F.explode(F.concat(*levels)).alias("form"), *words.columns)


def candidates(queries: DataFrame, vocab: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """token, word, distance, n: vocabulary words within ``max_edits`` of the tokens (rows: token).

    Words whose distance is at most k share a form after k deletions in each, so the vocabulary needs no more.
    """
    asked = queries.select(F.col("token").alias("word")).distinct()
    forms = broadcast_if_small(deletes(asked, max_edits).withColumnRenamed("word", "token"))
    hits = deletes(vocab.select("word", "n"), max_edits).join(forms, "form").select("token", "word", "n").distinct()
    near = hits.withColumn("distance", F.levenshtein("token", "word")).where(F.col("distance") <= max_edits)
    return near.select("token", "word", "distance", "n")


def best_words(queries: DataFrame, vocab: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """token, suggestion: the nearest word, the more frequent on ties, then alphabetically."""
    found = candidates(queries, vocab, max_edits)
    return found.groupBy("token").agg(F.min_by("word", F.struct("distance", -F.col("n"), "word")).alias("suggestion"))


def osa(a: str, b: str) -> int:
    """Edits with transpositions of neighbours."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


def suggest(queries: DataFrame, vocab: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """qid, suggestion: the corrected query, null where nothing changes.

    A token becomes its nearest word (optimal string alignment); two neighbours that are unknown become
    one word, and an unknown token becomes two, where that word or both parts are in the vocabulary.
    Lookups are joins; only a query's own candidates meet in Python.
    """
    tokens = queries.select("qid", F.split(F.lower(F.trim("query")), r"\s+").alias("ts")).select("qid", "ts", F.posexplode("ts").alias("i", "token"))
    after = F.get("ts", F.col("i") + 1)
    joined = tokens.where(after.isNotNull()).select("qid", F.concat("token", after).alias("token"))
    sizes = F.sequence(F.lit(2), F.length("token") - 2)
    parts = tokens.where(F.length("token") >= 4).select("qid", "token", F.explode(sizes).alias("k"))
    parts = parts.select("qid", F.explode(F.array(F.substring(F.col("token"), F.lit(1), F.col("k")), F.substring(F.col("token"), F.col("k") + 1, F.length("token")))).alias("token"))
    exact = parts.union(joined).distinct().join(vocab, F.col("token") == F.col("word")).select("qid", "token", "word", F.lit(0).alias("distance"), "n")
    near = tokens.select("qid", "token").distinct().join(broadcast_if_small(candidates(tokens, vocab, max_edits)), "token").select("qid", "token", "word", "distance", "n")
    hits = near.union(exact).groupBy("qid").agg(F.collect_list(F.struct("token", "word", "n")).alias("hits"))
    rows = queries.select("qid", F.lower(F.trim("query")).alias("query")).join(hits, "qid", "left")

    @F.pandas_udf(StringType())
    def correct(query: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_correct(q, h if h is not None else [], max_edits) for q, h in zip(query, found, strict=True)], dtype=object)

    return rows.select("qid", correct("query", "hits").alias("suggestion"))


def _correct(query: str, hits, max_edits: int) -> str | None:
    known = {h["word"]: h["n"] for h in hits}
    near: dict[str, list[tuple[int, int, str]]] = {}
    for h in hits:
        if (d := osa(h["token"], h["word"])) <= max_edits:
            near.setdefault(h["token"], []).append((d, -h["n"], h["word"]))
    tokens, out, i = query.split(), [], 0
    while i < len(tokens):
        t = tokens[i]
        if t not in known and i + 1 < len(tokens) and tokens[i + 1] not in known and t + tokens[i + 1] in known:
            out.append(t + tokens[i + 1])
            i += 2
            continue
        best = min(near.get(t, [(9, 0, t)]))
        split = max(((min(known[t[:k]], known[t[k:]]), t[:k], t[k:]) for k in range(2, len(t) - 1) if t[:k] in known and t[k:] in known), default=None)
        if t not in known and split and best[0] > 1:
            out += split[1:]
        else:
            out.append(best[2])
        i += 1
    fixed = " ".join(out)
    return fixed if fixed != query else None


def describe(vocab: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """One row about a vocabulary."""
    return vocab.agg(F.count("*").alias("word_count"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("word_bytes")).withColumns(
        {"min_frequency": F.lit(min_frequency), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}
    )
