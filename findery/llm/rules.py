"""Quality rules with adaptive thresholds from mergeable quantile sketches, per language and source.

Each document gets counts from array functions over its own text (no shuffle, no Python). Four
ratios of them are put into a *relative-error histogram sketch*: bin ``ceil(ln(x) / ln(GAMMA))``
with a counter, so a quantile is known to within a factor GAMMA. Sketches of one group merge by
adding counters, which is a plain ``groupBy(lang, source, metric, bin).count()`` with map-side
combine: a source with a third of all rows adds a bounded number of rows per task. A group has at
most a few hundred bins whatever its size.

A group's fences are Q1 - K * spread and Q3 + K * spread, the spread being the larger of Q3 - Q1 and
a floor, so a group without variation does not reject its own noise. A group's quartiles are drawn towards its
language's, and these towards everyone's, by the weight of ``PRIOR`` documents: n own documents count n / (n + PRIOR), so
small groups lean on the larger ones without a size at which the rule changes. Fences are a written table with a row a group; Spark
broadcasts it where its size allows and else joins by (lang, source), where it may split a hot group's rows.

Defined results: a null text is empty; null lang or source is a group of its own; repeated rows are
judged one by one (and counted one by one); a very long text is counted whole; an empty table gives an empty result;
further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, materialise, text_or_empty, words_of

GAMMA = 1.02
PRIOR = 200
K = 4.0
#: metric: the least spread that counts.
METRICS = {"chars_per_word": 1.0, "symbols_per_word": 0.05, "dup_line_share": 0.10, "repeat_share": 0.10}
#: Added to each ratio before the logarithm, so zero has a bin.
OFFSET = 0.01


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the contract."""
    text = text_or_empty()
    words = words_of(text)
    has_word = lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0
    lines = F.filter(F.split(text, "\n"), has_word)
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"), words.alias("w"), lines.alias("lines"))
    n = F.size("w")
    window_hash = lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")
    )
    grams = F.when(n >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), window_hash)))
    base = base.withColumn("g", grams)
    m = F.size("g")

    def twin(x: Column, i: Column) -> Column:
        h = lambda j: F.get("g", j)["h"]
        return ((i > 0) & (h(i - 1) == x["h"])) | ((i + 1 < m) & (h(i + 1) == x["h"]))

    starts = F.array_sort(F.transform(F.filter("g", twin), lambda x: x["i"]))
    base = base.withColumn("p", F.when(m >= 2, starts))
    # words in windows: each start adds what the next one does not cover
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1), x + 3) - x)),
        F.lit(0),
        lambda a, x: a + x,
    )
    return base.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
    }


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: the mergeable sketches of all groups."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in ratios().items()]))
    rows = counts.select("lang", "source", values.alias("v")).select("lang", "source", "v.metric", F.col("v.x").alias("x"))
    place = F.ceil(F.log(F.col("x") + OFFSET) / F.log(F.lit(GAMMA))).cast("int")
    return rows.groupBy("lang", "source", "metric", place.alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, total, q1, q3 of sketches merged to ``keys``."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    value = 2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1) - OFFSET
    at = lambda q: F.min(F.when(F.col("cum") >= F.col("total") * q, value))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(sketch: DataFrame, prior: int = PRIOR, k: float = K) -> DataFrame:
    """lang, source, metric, lo, hi: own quartiles, drawn towards the language's and everyone's."""
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(sketch, ["lang"]).select(
        F.col("lang").alias("l2"), F.col("metric").alias("m2"), F.col("total").alias("t2"), F.col("q1").alias("a2"), F.col("q3").alias("b2")
    )
    every = quantiles(sketch, []).select(F.col("metric").alias("m3"), F.col("q1").alias("a3"), F.col("q3").alias("b3"))
    j = own.join(lang, own.lang.eqNullSafe(F.col("l2")) & (own.metric == F.col("m2"))).join(
        F.broadcast(every), F.col("metric") == F.col("m3")  # one row a metric
    )
    drawn = lambda n, x, to: (F.col(n) * F.col(x) + prior * to) / (F.col(n) + prior)
    quartile = lambda x, by_lang, by_all: drawn("total", x, drawn("t2", by_lang, F.col(by_all)))
    floor = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in METRICS.items()])
    j = j.select("lang", "source", "metric", quartile("q1", "a2", "a3").alias("q1"), quartile("q3", "b2", "b3").alias("q3"), floor.alias("floor"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.col("floor"))
    return j.select("lang", "source", "metric", (F.col("q1") - k * spread).alias("lo"), (F.col("q3") + k * spread).alias("hi"))


def judge(counts: DataFrame, prior: int = PRIOR, k: float = K) -> DataFrame:
    """``counts`` with ``base_failed``, the failing metric (or null) and ``kept``."""
    limits = fences(sketches(counts), prior, k).groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in METRICS for side in ("lo", "hi")]
    )
    limits = materialise(limits, "fences")
    on = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    value = ratios()
    broken = F.coalesce(*[F.when((value[m] < F.col(f"lo_{m}")) | (value[m] > F.col(f"hi_{m}")), F.lit(m)) for m in METRICS])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.join(limits, on).select(*counts.columns, base.alias("base_failed"), broken.alias("broken"), (~base & broken.isNull()).alias("kept"))


def op9(docs: DataFrame) -> DataFrame:
    counts = materialise(document_counts(docs), "rules")
    return judge(counts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _quartiles_sql(name: str, keys: str) -> str:
    ranked = f"(SELECT {keys}metric, bin, sum(n) AS n FROM b GROUP BY ALL)"
    at = lambda q: f"min(CASE WHEN cum >= total * {q} THEN 2 * pow({GAMMA}::DOUBLE, bin) / {GAMMA + 1} - {OFFSET} END)"
    return (
        f"{name} AS (SELECT {keys}metric, max(total) AS total, {at(0.25)} AS q1, {at(0.75)} AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY bin) AS cum,"
        f" sum(n) OVER (PARTITION BY {keys}metric) AS total FROM {ranked}) GROUP BY ALL)"
    )


def _drawn_sql(q: str) -> str:
    by_lang = f"(l.total * l.{q} + {PRIOR} * e.{q}) / (l.total + {PRIOR})"
    return f"(o.total * o.{q} + {PRIOR} * {by_lang}) / (o.total + {PRIOR}) AS {q}"


#: What ``op9`` returns, in DuckDB SQL.
OP9_SQL = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT row, s FROM g GROUP BY row, s HAVING count(*) > 1),
rep AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, i + unnest([0, 1, 2]) AS place FROM g JOIN twice USING (row, s)) GROUP BY row),
c AS (SELECT row, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines FROM w LEFT JOIN rep USING (row)),
v AS (SELECT row, lang, source, unnest({list(METRICS)}) AS metric, unnest({list(METRICS.values())}::DOUBLE[]) AS least,
  unnest([word_chars / greatest(n_words, 1)::DOUBLE, n_symbols / greatest(n_words, 1)::DOUBLE, n_dup_lines / greatest(n_lines, 1)::DOUBLE, n_repeat_words / greatest(n_words, 1)::DOUBLE]) AS x FROM c),
b AS (SELECT lang, source, metric, ceil(ln(x + {OFFSET}::DOUBLE) / ln({GAMMA}::DOUBLE)) AS bin, count(*) AS n FROM v GROUP BY ALL),
{_quartiles_sql("own", "lang, source, ")}, {_quartiles_sql("bylang", "lang, ")}, {_quartiles_sql("everyone", "")},
q AS (SELECT o.lang, o.source, o.metric, {_drawn_sql("q1")}, {_drawn_sql("q3")} FROM own o JOIN bylang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.metric = o.metric JOIN everyone e ON e.metric = o.metric),
bad AS (SELECT row FROM v JOIN q ON q.metric = v.metric AND q.lang IS NOT DISTINCT FROM v.lang AND q.source IS NOT DISTINCT FROM v.source
  WHERE x < q1 - {K} * greatest(q3 - q1, least) OR x > q3 + {K} * greatest(q3 - q1, least)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row NOT IN (SELECT row FROM bad) AS kept FROM f"""
