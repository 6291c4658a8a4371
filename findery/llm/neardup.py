"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): round i of the first T throws every shingle into a random one
of T bins with a value in [i, i+1); rounds T to 2T-1 put all of them into bin i-T. A bin keeps its least
value and rounds end when all are filled, so every coordinate is filled after O(T log T + shingles) steps
and the share of equal coordinates estimates the Jaccard similarity with concentration bounds.

1. One pass: a document's distinct shingles give its size, a 128-bit hash of the whole set, the sketch and
   ``BANDS`` band hashes. Documents with equal sets are one *class*, represented by its smallest doc_id.
2. Banding: classes that share a band hash are candidates. At 0.8, 32 bands of 4 miss a pair with
   probability (1 - 0.8^4)^32 < 5e-8.
3. Every member of a bucket is verified, on full sets, against the bucket's most central member (the one whose
   buckets hold the most documents: in a group of near copies that is what they are copies of). A bucket of n costs
   n - 1 pairs, not n^2. Confirmed links give components.
4. Buckets that share members form a *cluster*. Where a cluster still has several components, its members outside the
   largest one are searched, on full sets, against all members of other components: blocks of at most ``SEARCH_BLOCK`` rows
   a side meet by (cluster, block, block) and an inverted index of shingles counts the intersections, so pairs are not made
   and only confirmed links come out, one for each component. After this every candidate pair is either in one component
   or was checked.

Shingles are compared by 64-bit hashes of their words, which are mixed without algebraic structure: two sets of n and m shingles
share a false one with a chance below (n + m)^2 / 2^65. So no bucket is capped and no link is lost but by the chance in 2. No groups are collected: buckets, clusters and components
are aggregated with map-side combine and joined by sort-merge joins that AQE may split.

Defined results: null, empty or wordless texts have no shingles and are linked with nothing; a text with
fewer words than a shingle has one shingle of all its words; rows with the same doc_id are one node; a null
doc_id is a copy if its class has an id and stays by itself otherwise; a very long text or word is taken whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, discard, free_name, materialise, mix64, pieces, string_bytes
from .components import components
from .hashing import grams, tokens

T = 128
BANDS = 32
ROWS = T // BANDS
WIDTH = 5
PERCENT = 80
SEARCH_BLOCK = 1024
CHUNK_BYTES = 1 << 20
_GOLD = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = tokens(data, offsets)
    h = grams(words, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            out.append(grams(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """T coordinates for each set (``_EMPTY`` for those of an empty set)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    out = np.full(n * T, _EMPTY, np.uint64)
    for i in range(2 * T):
        if not len(h):
            break
        x = mix64(h + np.uint64((i + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        at = doc * T + ((x & np.uint64(T - 1)).astype(np.int64) if i < T else i - T)
        free = out[at] == _EMPTY
        np.minimum.at(out, at[free], (np.uint64(i) << np.uint64(48)) | (x[free] >> np.uint64(16)))
        more = (out.reshape(n, T) == _EMPTY).any(1)
        if i % 8 == 0 or i < 8:
            left = more[doc]
            h, doc = h[left], doc[left]
    return out.reshape(n, T)


def band_hashes(sk: np.ndarray) -> np.ndarray:
    x = sk.reshape(len(sk), BANDS, ROWS)
    h = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sk), BANDS))
    for r in range(ROWS):
        h = mix64(h * np.uint64(_GOLD) + x[:, :, r])
    return h


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def signatures(src: DataFrame, width: int) -> DataFrame:
    """id, n, set_a, set_b, sketch, bands."""

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for a, b in pieces(offsets, CHUNK_BYTES):
                sets = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                sk = sketch(sets)
                short = (mix64(sk) >> np.uint64(48)).astype(np.uint16)
                bands = band_hashes(sk).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(np.bitwise_xor.reduce(mix64(s))) - (1 << 63) for s in sets], pa.int64()),
                        pa.array([int(np.add.reduce(mix64(s ^ np.uint64(_GOLD)))) - (1 << 63) for s in sets], pa.int64()),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                        pa.array([x.tolist() if len(s) else [] for x, s in zip(bands, sets, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "set_a", "set_b", "sketch", "bands"],
                )

    return src.mapInArrow(run, "id long, n long, set_a long, set_b long, sketch binary, bands array<long>")


def full_sets(src: DataFrame, width: int) -> DataFrame:
    """id, items: the distinct shingles."""

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for a, b in pieces(offsets, CHUNK_BYTES):
                sets = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), items], names=["id", "items"])

    return src.mapInArrow(run, "id long, items array<long>")


def search(percent: int):
    """Cogrouped blocks of (id, comp, items) -> confirmed links (u, v) between different components."""

    def run(asks: pa.Table, members: pa.Table) -> pa.Table:
        u, v = [], []
        if len(asks) and len(members):
            ids, comps = (members.column(c).to_numpy() for c in ("m_id", "m_comp"))
            col = members.column("m_items").combine_chunks()
            flat, sizes = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
            owner = np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i, comp, items in zip(asks.column("id").to_pylist(), asks.column("comp").to_pylist(), asks.column("items"), strict=True):
                mine = np.asarray(items.values)
                low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                n = high - low
                place = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[place], minlength=len(ids))
                near = np.flatnonzero((100 * common >= percent * (len(mine) + sizes - common)) & (comps != comp))
                _, first = np.unique(comps[near], return_index=True)
                u += [i] * len(first)
                v += ids[near[first]].tolist()
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("u"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("items").alias("y"))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(100 * small >= percent * large)
    both = both.select("u", "v", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("u", "v")


def between(pairs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 4: the links that join different components of one cluster."""
    of = lambda r, name: r.select(F.col("node").alias("id"), F.col("root").alias(name)).hint("merge")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    placed = ids.join(of(components(pairs), "c"), "id", "left").join(of(roots, "r"), "id", "left")
    placed = materialise(placed.select("id", F.coalesce("c", "id").alias("cluster"), F.coalesce("r", "id").alias("comp")), "placed")
    sizes = placed.groupBy("cluster", "comp").agg(F.count("*").alias("size"))
    split = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("size", "comp")).alias("major"), F.count("*").alias("comps"), F.sum("size").alias("all"), F.max("size").alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(SEARCH_BLOCK)).cast("int")
    split = split.where("comps > 1").select("cluster", "major", blocks(F.col("all")).alias("n_all"), blocks(F.col("all") - F.col("most")).alias("n_asks"))
    split = materialise(split, "split")  # read from a table, so that the join below can deal out a large cluster anew
    members = placed.join(split.hint("merge"), "cluster").join(sets.hint("merge"), "id")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = members.where("comp <> major").select("cluster", own("n_asks").alias("a"), every("n_all").alias("b"), "id", "comp", "items")
    new = lambda *names: [F.col(c).alias(f"m_{c}") for c in names]
    held = members.select(*new("cluster"), every("n_asks").alias("m_a"), own("n_all").alias("m_b"), *new("id", "comp", "items"))
    return asks.groupBy("cluster", "a", "b").cogroup(held.groupBy("m_cluster", "m_a", "m_b")).applyInArrow(search(percent), "u long, v long").distinct()


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row."""
    src = _source(docs, id_col, text_col)
    sig = materialise(signatures(src, width), "signatures")
    same = ["set_a", "set_b", "n"]
    classes = sig.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"))
    in_class = sig.select("id", *same).where("n > 0").join(classes.hint("merge"), same)
    reps = sig.where("n > 0").join(classes.where("rep is not null").withColumnRenamed("rep", "id").hint("merge"), [*same, "id"])
    rows = reps.select("id", F.explode("bands").alias("band")).distinct()
    crowded = rows.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1")
    rows = materialise(rows.join(crowded.hint("merge"), "band"), "rows")
    central = rows.groupBy("id").agg(F.sum("crowd").alias("central"))
    placed = rows.join(central.hint("merge"), "id")
    leads = placed.groupBy("band").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("lead"))
    pairs = rows.join(leads.hint("merge"), "band").where("id <> lead").select(F.col("id").alias("u"), F.col("lead").alias("v")).distinct()
    pairs = materialise(pairs, "pairs")
    asked = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = materialise(full_sets(src.join(asked.hint("merge"), "id", "left_semi"), width), "sets")
    first = materialise(verify(pairs, sets, percent).distinct(), "links")
    roots = components(first)
    second = materialise(between(pairs, roots, sets, percent), "links")
    if second.limit(1).count():
        roots = components(first.union(second))
    for done in (rows, pairs, sets):
        discard(done)

    known = in_class.select("id", "n", "rep").join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    known = known.select("id", "n", F.coalesce("root", "rep").alias("component_id"))
    every = known.union(sig.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op7(docs: DataFrame) -> DataFrame:
    return link(docs.select("doc_id", "text"), width=4)


#: What ``op7`` returns, in DuckDB SQL: all pairs of texts that share a shingle, on their shingles themselves.
OP7_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
c AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS e FROM c),
p AS (SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.e = b.e AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
b AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(root, doc_id)::BIGINT AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN m ON m.node = c.rep"""


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (null comes last).

    Rows are told apart by a key in a written table, so rows that share a doc_id or have none are judged one by one. Columns
    pass as they are, whatever their names.
    """
    columns = docs.columns
    row, gone_row = free_name(columns, "row"), free_name(columns, "gone_row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    plain = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("own"), "text")
    linked = materialise(link(plain, width, percent, id_col="row").select("row", F.col("component_id").alias("of")), "linked")
    crowds = linked.groupBy("of").agg(F.count("*").alias("n")).where("n > 1").select("of")
    members = materialise(linked.join(crowds.hint("merge"), "of").join(plain.select("row", "own").hint("merge"), "row"), "members")
    first = members.groupBy("of").agg(F.min(F.struct(F.col("own").isNull(), "own", "row")).getField("row").alias("row"))
    gone = members.join(first.select("row").hint("merge"), "row", "left_anti").select(F.col("row").alias(gone_row))
    return rows.join(gone.hint("merge"), F.col(row) == F.col(gone_row), "left_anti").select(*columns)
