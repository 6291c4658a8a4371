"""Suffix-array dedup (6), near-dedup (7), decontamination (8) and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findery.llm import components, decontam, neardup, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- 6 ---


def brute_repeats(rows, length=50):
    first = {}
    for d, t in rows:
        raw, key = (t or "").encode(), -(1 << 63) if d is None else d
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for d, t in rows:
        raw, key = (t or "").encode(), -(1 << 63) if d is None else d
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((str(d), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(30), text(14)
    rows = [(i, text(40)) for i in range(20)]
    rows += [(30 + i, f"{text(10)} {passage} {text(10)}") for i in range(6)]
    rows += [(40, passage[:49]), (41, passage[:50]), (42, passage[10:61]), (43, other + other), (44, f"{other} {other}"), (45, "a" * 300), (46, "a" * 120), (46, "a" * 60)]
    rows += [(50, None), (51, ""), (52, rows[3][1]), (53, rows[3][1] + rows[4][1]), (3, passage), (None, other), (60, text(3000) + passage)]
    return rows


@pytest.mark.parametrize("block_bytes", [500, 1 << 20])
def test_repeats(spark, block_bytes):
    rows = repeat_rows()
    out = repeats.remove(docs(spark, rows), block_bytes=block_bytes).collect()
    got = sorted((str(r.doc_id if "doc_id" in r else r.id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)
    assert got == brute_repeats(rows)


def test_repeats_of_very_long_texts(spark, monkeypatch):
    """Texts longer than a chunk are cut, with what windows across the cut need on both sides."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 300)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    long = text(4000)
    rows = [(1, long), (2, text(500) + long[700:2900] + text(300)), (3, "z" * 2000), (4, "z" * 700), (5, long[:49] + long), (0, None)]
    out = repeats.remove(docs(spark, rows), block_bytes=1 << 20).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == brute_repeats(rows)


def test_repeats_tell_equal_hashes_apart(monkeypatch):
    """Two keys with one hash and different checks stay two."""
    h, c, doc = (np.array(x, t) for x, t in (([5, 5, 5, 9], np.uint64), ([1, 2, 1, 7], np.uint16), ([4, 3, 2, 8], np.uint64)))
    (hash_, check), low, high = repeats.least((h, c), doc)
    assert hash_.tolist() == [5, 5, 9] and check.tolist() == [1, 2, 7] and low.tolist() == [2, 3, 8] and high.tolist() == [4, 3, 8]
    got = repeats.lookup((hash_, check), low, (np.array([5, 5, 5, 9, 6], np.uint64), np.array([2, 1, 3, 7, 7], np.uint16)))
    assert [None if x == repeats._NONE else int(x) for x in got] == [3, 2, None, 8, None]


def test_repeats_edges(spark):
    df = docs(spark, [(1, "x" * 60)]).withColumn("block", F.lit(1)).withColumn("id", F.lit(5))
    assert repeats.op6(df).first().n_removed == 0
    assert repeats.op6(df.limit(0)).count() == 0


# --- 7 ---


def shingle_set(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_near(rows, width, percent=80):
    sets = defaultdict(list)
    for d, t in rows:
        sets[d].append(shingle_set(t, width))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(shingle_set(t, width)), find(d), find(d) == d) for d, t in rows)


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 200))] for _ in range(12)]
    rows, i = [], 0
    for b in base:
        rows.append((i, " ".join(b)))
        i += 1
        for edits in (0, 1, 2, 4, 8):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append((i, " ".join(c).upper() if edits == 1 else "\t".join(c)))
            i += 1
    chain = list(base[0])
    for _ in range(30):  # a chain whose ends are far apart
        chain = chain[max(1, len(chain) // 30) :] + [rng.choice(words) for _ in range(max(1, len(chain) // 30))]
        rows.append((i, " ".join(chain)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one two"), (i + 4, "ONE  two"), (i + 5, "one two three"), (i + 6, "é É")]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_rows()
    out = neardup.link(docs(spark, rows).withColumn("band", F.lit(1)).withColumn("rep", F.lit(1)), width).collect()
    assert sorted(tuple(r) for r in out) == brute_near(rows, width)


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(300):
        c = list(base)
        for _ in range(2):
            c[rng.randrange(len(c))] = f"x{i}"
        rows.append((i, " ".join(c)))
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + [(7, rows[7][1])]
    out = neardup.link(docs(spark, rows), 4).collect()
    assert sorted(tuple(r) for r in out) == brute_near(rows, 4)


def test_keep_one(spark):
    rows = near_rows()
    df = docs(spark, rows)
    for c in ("lang", "component_id", "row", "Gone_row", "own", "of", "n"):
        df = df.withColumn(c, F.lit("en"))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, _, k in brute_near(rows, 5) if k]
    assert neardup.op7(df.limit(0)).count() == 0


def test_keep_one_judges_rows_not_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (2, text("a")), (2, text("d"))]
    rows += [(3, text("e")), (3, text("e")), (None, text("f")), (None, text("f")), (None, None), (4, ""), (4, "")]
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(docs(spark, rows)).collect()]
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("d")), (3, text("e")), (None, text("f")), (None, None), (4, ""), (4, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    one = np.array([5], np.uint64)
    sk = neardup.sketch([np.unique(np.r_[common, a]), np.unique(np.r_[common, b]), one])
    assert (sk != neardup._EMPTY).all()
    assert abs((sk[0] == sk[1]).mean() - 0.8) < 0.13


def test_components_of_a_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(100)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{2000 + i: 1000 for i in range(50)}}


# --- 8 ---


def brute_tiles(passage, text, k):
    """Greedy tiling by definition: again and again the longest unmarked match, first by place."""
    gone_p, gone_t, covered = [False] * len(passage), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(passage)):
            for j in range(len(text)):
                n = 0
                while i + n < len(passage) and j + n < len(text) and passage[i + n] == text[j + n] and not gone_p[i + n] and not gone_t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return covered
        covered += n
        gone_p[i : i + n] = [True] * n
        gone_t[j : j + n] = [True] * n


@settings(max_examples=80, deadline=None)
@given(p=st.lists(st.sampled_from("abc"), max_size=24), t=st.lists(st.sampled_from("abc"), max_size=30))
def test_tiles(p, t):
    as_hashes = lambda x: np.array([ord(c) for c in x], np.uint64)
    assert sum(x[2] for x in decontam.tile(as_hashes(p), as_hashes(t), 3)) == brute_tiles(p, t, 3)


def test_tiles_of_repetitive_texts_take_time_in_proportion():
    import time

    one = np.zeros(20_000, np.uint64)
    began = time.time()
    assert sum(x[2] for x in decontam.tile(one[:3000], one, 5)) == 3000
    assert sum(x[2] for x in decontam.tile(np.tile(np.arange(7, dtype=np.uint64), 400), np.tile(np.arange(6, dtype=np.uint64), 4000), 5)) == 2400
    assert time.time() - began < 20


def test_decontamination(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = {i: words(40) for i in range(5)}
    parts = [passages[1][a : a + 10] for a in (30, 0, 20, 10)]
    rows = [
        (1, " ".join(words(100))),
        (2, " ".join([*words(50), *passages[0], *words(50)])),
        (3, " ".join(words(9) + sum(([*p, *words(5)] for p in parts), []))),  # reordered
        (4, " ".join([*words(50), *passages[2][:12], *words(50)])),
        (5, " ".join([*words(10), *passages[3][:20], *words(10)]).upper().replace(" ", ", ")),
        (6, None),
        (7, ""),
        (2, " ".join(words(30))),
    ]
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in passages.items()] + [(9, None), (10, "too short"), (None, "x")], "item_id long, text string")
    df = docs(spark, rows).withColumn("contaminated", F.lit("old")).withColumn("N_items", F.lit(7))
    out = decontam.screen(df, items).collect()
    assert {(r.contaminated, r.N_items) for r in out} == {("old", 7)}
    got = sorted((r.doc_id, r.contaminated_, r.best_item) for r in out)
    assert got == [(1, False, None), (2, False, None), (2, True, 0), (3, True, 1), (4, False, 2), (5, True, 3), (6, False, None), (7, False, None)]
    assert not any(r.contaminated for r in decontam.op8(df, items.limit(0)).collect())
    assert decontam.op8(df.limit(0), items).count() == 0
    named = items.where("item_id is not null").withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    assert {r.doc_id: r.best_item for r in decontam.op8(df, named).collect() if r.doc_id != 2} == {1: None, 3: "i1", 4: "i2", 5: "i3", 6: None, 7: None}


def brute_contaminated(rows, items, k=5, threshold=0.5):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in rows:
        found = [(brute_tiles(split(p), split(t), k) / len(split(p)), -i) for i, p in items if p and split(p)]
        found = [x for x in found if x[0]]
        cover, item = max(found, default=(0.0, None))
        out.append((str(d), len(found), -item if item is not None else None, cover, cover >= threshold))
    return sorted(out)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh")  # noqa: E731  few words, so that many stretches agree
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.randint(3, 16))) for i in range(8)] + [(8, "a " * 30), (9, None), (10, "")]
    items += [(11, items[0][1])]
    rows = [(i, line(rng.randint(0, 60))) for i in range(25)] + [(None, items[3][1]), (30, None), (31, ""), (4, items[2][1].upper()), (32, "a, " * 50), (33, f"{items[5][1]} {items[1][1]}")]
    want = brute_contaminated(rows, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 100):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.op8(docs(spark, rows), table).select("doc_id", *decontam.ADDED).collect()
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want


def thue_morse(n):
    """Two texts of n letters that a polynomial modulo 2^64 cannot tell apart."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])


@pytest.mark.parametrize("n", [1024, 2048])
def test_texts_made_to_collide_are_told_apart(spark, n):
    one, other = thue_morse(n)
    rows = [(1, one), (2, other)]
    assert {r.component_id for r in neardup.op7(docs(spark, rows)).collect()} == {1, 2}
    letters = [(i, " ".join(t)) for i, t in rows]
    assert sorted(tuple(r) for r in neardup.op7(docs(spark, letters)).collect()) == brute_near(letters, 4)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op6(docs(spark, rows)).collect())
    assert got == brute_repeats(rows)
    passage = lambda t: " ".join([t] * 6)
    items = spark.createDataFrame([(1, passage(one))], "item_id long, text string")
    out = {r.doc_id: r.contaminated for r in decontam.op8(docs(spark, [(1, passage(one)), (2, passage(other))]), items).collect()}
    assert out == {1: True, 2: False}


def test_passage_blocks_do_not_change_results(spark, monkeypatch, data_dir):
    read = lambda t: spark.read.parquet(f"{data_dir}/{t}.parquet")
    whole = sorted(map(tuple, decontam.op8(read("documents"), read("benchmark")).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, decontam.op8(read("documents"), read("benchmark")).collect())) == whole


# --- the pipeline ---


def test_pipeline(spark, data_dir):
    cp = pytest.importorskip("corpus_pipeline")
    documents = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = cp.run(spark, data_dir).collect()
    ids = [r.doc_id for r in rows]
    assert 0 < len(ids) == len(set(ids)) < documents.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, documents, data_dir)
        assert out.columns == documents.columns, name
        assert out.schema == documents.schema or [f.dataType for f in out.schema] == [f.dataType for f in documents.schema], name
        assert stage(spark, documents.limit(0), data_dir).count() == 0


def test_stages_handle_odd_rows(spark, data_dir):
    """Nulls, empty and very long texts, repeated rows and names that operators use themselves."""
    cp = pytest.importorskip("corpus_pipeline")
    plain = spark.read.parquet(f"{data_dir}/documents.parquet").limit(30)
    long = "a sentence of its own kind, number " + " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    extra = [(None, None, None, None, None), (5000, "", "en", "s", 0), (5001, long, None, "s", len(long)), (None, long[:3000], "en", None, 3000), (5001, long, None, "s", len(long))]
    docs_ = plain.unionByName(spark.createDataFrame(extra, plain.schema))
    names = ["N_lines", "n_dropped", "quality_score", "scored_text", "n_items", "best_item", "best_coverage", "contaminated", "row", "gone_row", "lost_id", "stay", "token_ids", "decoded", "row_id"]
    for c in names:
        docs_ = docs_.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs_, data_dir)
        assert out.schema == docs_.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs_.schema], name
        assert out.columns == docs_.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= docs_.count(), name
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in names), name
    out = cp.STAGES[-1][1](spark, docs_, data_dir)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "decoded_sha256"] and out.count() == docs_.count()


def test_pipeline_equals_its_stages_by_brute_force(spark, data_dir):
    """Line dedup, near-dedup and decontamination, each against brute force on what its predecessor kept."""
    cp = pytest.importorskip("corpus_pipeline")
    stages = dict(cp.STAGES)
    docs_ = stages["quality_classifier"](spark, spark.read.parquet(f"{data_dir}/documents.parquet"), data_dir).cache()
    before = [(r.doc_id, r.text) for r in docs_.collect()]
    holders = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for d, t in before:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    stays = lambda d, x: len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d
    want = sorted((d, "\n".join(x for x in (t or "").split("\n") if stays(d, x))) for d, t in before)
    lines_ = stages["line_dedup"](spark, docs_, data_dir).cache()
    assert sorted((r.doc_id, r.text) for r in lines_.collect()) == want
    near = stages["minhash_dedup"](spark, lines_, data_dir).cache()
    want = sorted(d for d, _, _, kept in brute_near(want, 5) if kept)
    assert sorted(r.doc_id for r in near.collect()) == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sure = set()
    passages = [split(t) for _, t in items]
    for r in near.collect():
        text = split(r.text)
        own = grams(text)
        if any(len(p) >= 5 and grams(p) & own and 2 * brute_tiles(p, [w if w in set(p) else None for w in text], 5) >= len(p) for p in passages):
            sure.add(r.doc_id)
    kept = {r.doc_id for r in stages["decontamination"](spark, near, data_dir).collect()}
    assert kept == set(want) - sure
