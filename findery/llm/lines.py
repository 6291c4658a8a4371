"""Line deduplication by levelled sorted runs of line hashes (DataFrame functions only).

A *run* is a table (h1, h2, n_docs, max_doc, known) sorted by the hash of the line's key, in the shared folder. The hash is two
64-bit words with different seeds. A batch of documents is merge-anti-joined with all runs, which tells its fresh keys from known ones
(``known``), and becomes a run of level 0; when a level holds ``fanout`` runs they are merged into one run of the next level and
deleted, so a hash is rewritten once a level: O(log batches) times.

* ``LineRuns.add(keys)`` - adds a batch's own run.
* ``LineRuns.fresh(keys)`` - the keys that no run has: incremental use.
* ``LineRuns.repeated(min_docs)`` - the merged view: keys of at least ``min_docs`` documents.
* ``drop_repeated(docs, ...)`` - all of it for one table: every repeated key loses its lines, except
  in the document with the largest id that holds it.

Documents are read twice: once for the hashes of their lines, which are stored by batch, and once for the texts that stay. A line that
a third of the documents share is one row per map task in the counting (partial aggregation) and is spread over tasks in the join,
which is a sort-merge join that AQE may split. What a document loses is a set of places, so a text of many lines is
filtered in time that grows with its lines.

Key of a line: white space stripped at both ends, A-Z lower-cased. Defined results: a null or empty
text is one empty line; keys shorter than ``min_chars`` code points never count; rows with the same
doc_id are one document when documents are counted and each loses its lines by itself; a null doc_id
is one document, below all others; an empty table gives an empty result; a text may end up empty; other columns
pass as they are, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, discard, free_name, lower_ascii, materialise, text_or_empty, union_all

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def key_hash(key: Column) -> Column:
    """Two words: the second has the hash of 1 as its seed, not the first word."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def row_key(text: str = "text") -> Column:
    """What tells rows of one doc_id apart; equal rows lose the same lines."""
    return F.xxhash64(F.col(text))


def long_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row, place): the hashed long keys of every document and where they stand."""
    keys = F.transform(F.split(text_or_empty(), "\n"), line_key)
    lines = docs.select("doc_id", row_key().alias("row"), F.posexplode(keys).alias("place", "key")).where(F.length("key") >= min_chars)
    return lines.select("doc_id", "row", "place", key_hash(F.col("key")).alias("h")).select("h.h1", "h.h2", "doc_id", "row", "place")


def merge(runs: list[DataFrame]) -> DataFrame:
    """One sorted run of several."""
    merged = union_all(runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.min("known").alias("known"))
    return merged.sortWithinPartitions("h1", "h2")


class LineRuns:
    """Levels of sorted runs; batches must not share a doc_id."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, max(2, fanout)
        self.levels: dict[int, list[DataFrame]] = defaultdict(list)

    def add(self, keys: DataFrame) -> DataFrame:
        """Add the run of a batch's (h1, h2, doc_id, ...) rows; returns it."""
        run = keys.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if self.runs():
            old = union_all([r.select("h1", "h2") for r in self.runs()]).distinct().withColumn("known", F.lit(True))
            run = run.join(old.hint("merge"), ["h1", "h2"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        else:
            run = run.withColumn("known", F.lit(False))
        run = materialise(run.sortWithinPartitions("h1", "h2"), "run0")
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels.pop(level)
            level += 1
            self.levels[level].append(materialise(merge(old), f"run{level}"))
            for done in old:
                discard(done)
        return run

    def runs(self) -> list[DataFrame]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run has."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        found = self.runs()
        merged = found[0] if len(found) == 1 else merge(found)
        return merged.where(F.col("n_docs") >= min_docs)


def places_lost(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """doc_id, row, places: the lines that a document loses (documents that lose none are absent)."""
    store = LineRuns(docs.sparkSession, fanout)
    keys = long_keys(docs.select("doc_id", "text"), min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    keys = materialise(keys, "line-keys", by="batch")
    for b in range(batches):
        store.add(keys.where(F.col("batch") == b))
    repeated = store.repeated(min_docs).select("h1", "h2", "max_doc")
    lost = keys.join(repeated.hint("merge"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    return lost.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"))


def _without(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the lines that stay in place of the text, the number of all lines, and the names of both columns."""
    names = [*docs.columns]
    own = {}
    for base in ("lost_id", "lost_row", "lost_places", "row_key", "stay", "lines"):
        own[base] = free_name(names, base)
        names.append(own[base])
    lost = places_lost(docs, min_chars, min_docs, batches, fanout)
    lost = lost.select(F.col("doc_id").alias(own["lost_id"]), F.col("row").alias(own["lost_row"]), F.col("places").alias(own["lost_places"]))
    on = F.col("doc_id").eqNullSafe(F.col(own["lost_id"])) & F.col(own["row_key"]).eqNullSafe(F.col(own["lost_row"]))
    joined = docs.withColumn(own["row_key"], row_key()).join(lost.hint("merge"), on, "left")
    lines, places = F.split(text_or_empty(), "\n"), F.col(own["lost_places"])
    both = F.struct(lines.alias("all"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places).alias("left"))
    # one element, so that the lines are split once, not for each place
    stay = F.flatten(F.transform(F.array(both), lambda x: F.transform(x["left"], lambda i: F.get(x["all"], i))))
    return joined.select(*docs.columns, F.when(places.isNull(), lines).otherwise(stay).alias(own["stay"]), F.size(lines).cast("long").alias(own["lines"])), own["stay"], own["lines"]


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with its columns and the text without repeated lines."""
    out, stay, _ = _without(docs, min_chars, min_docs, batches, fanout)
    return out.select(*[F.array_join(stay, "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def drop_repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``deduplicated`` with n_lines, n_dropped as last columns; where ``docs`` has such names, with ``_`` behind them."""
    out, stay, lines = _without(docs, min_chars, min_docs, batches, fanout)
    return out.select(
        *[F.array_join(stay, "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.col(lines).alias(free_name(docs.columns, "n_lines")),
        (F.col(lines) - F.size(stay)).alias(free_name(docs.columns, "n_dropped")),
    )


def op2(docs: DataFrame) -> DataFrame:
    out = drop_repeated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, ls[i] AS line, i AS pos,
         translate(trim(ls[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), many AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, m.keeper IS NOT NULL AND m.keeper <> l.doc_id AS gone
  FROM lines l LEFT JOIN many m ON l.key = m.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
