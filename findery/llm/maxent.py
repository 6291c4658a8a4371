"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

q(word | history) = (1 - unseen) * p(class | history) * p(slot | class, history) * p(word | slot). Both softmaxes are maximum-entropy
models, relative to the frequencies of classes and slots, over hashed features of the history: the last word, the last two words, the
word before the last (skipping one), and for the class the last two classes and the two before them. The class of a word is a hash of its last bytes, its slot in the class a hash of
all of it; the end of a text has a class of its own. p(word | slot) is the word's share of its slot's training tokens.
Words that training has not seen get ``unseen`` (Good and Turing: the share of tokens whose word occurs once) in equal shares, as many
as Chao's estimate of the words that are still to come, once * (once - 1) / (2 * (twice + 1)). So the probabilities of the known
words and of that many others add up to one after any history.

p(word | history) = (n(last, word) + strength * q(word | history)) / (n(last) + strength): the counts of all words and of all pairs
of neighbours are tables that grow with the corpus. One strength holds for all words; it is the one at which the model expects as
many new pairs as the corpus has pairs seen once.

1. One pass encodes the corpus into blocks of about ``BLOCK_BYTES`` of text: one row a block with its vocabulary, the
   vocabulary's training counts, and each text as indices into it. Everything later reads blocks, not texts.
2. Training: in each round every block, from the current weights, goes over all its training texts by mini-batch gradient steps; the
   changes are averaged by how often each block saw each feature, as whole numbers, so that neither the order nor the dealing of
   blocks matters: the same input in the same partitions gives the same model. Rounds go on, at every size, until one takes less than
   ``LEAST_GAIN`` bits a token off the loss (``gains``). The batch (``batch_for``) and the buckets of the features (``bits_for``) follow
   the number of training tokens. Weights are what is broadcast; at most 2^``MAX_BITS`` rows of each softmax.
3. Counts: a block's distinct words and pairs of neighbours go as sorted 64-bit keys with their counts to the parts of the key range,
   one message for each block and part; a part adds the counts and sends each message's sums back. A frequent key is one
   entry a block. There is a part for every ``BLOCKS_PER_PART`` blocks; a task that is dealt several parts holds one at a time. Words of up to 8 bytes have keys of their own
   among words of their length; longer ones share a key with a chance of about distinct^2 / 2^65.
4. Scoring: a block and its sums meet (cogroup by block) and its texts are scored in sparse batches.

Defined results: null and empty texts are the end token alone; a null doc_id is never held out; rows that repeat are scored
and counted one by one; a very long text is one row of one block and is scored whole; other columns are not read, so
their names cannot clash; a corpus without training rows gives n_known 0 and N 0 and the score 0 (one word is all there is); an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_shuffles, materialise, mix64, planes, words
from .hashing import SPACE, strings

BLOCK_BYTES = 6 << 20
CLASSES = 16
SLOTS = 16
MIN_BITS, MAX_BITS = 14, 18
RATE = 0.3
MAX_BATCH = 16384
STEPS = 64  # a block's steps in a round, at least, unless batches would have fewer than 256 tokens
MIN_ROUNDS, MAX_ROUNDS = 2, 8
LEAST_GAIN = 0.05  # bits a token
RANGES = 16
BLOCKS_PER_PART = 2
_ONE = 1 << 20  # changes are whole numbers of this fraction
_FINE, _NEXT = 1 << 12, 1 << 27  # gradients too, so that two share a double
_LOG10E = 1 / np.log(10)
_START = np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

BLOCK = "block long, doc_ids binary, held binary, lens binary, tokens binary, vocab binary, n_train binary, n_tokens long, leaves array<long>"
NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def encode(batches):
    """(id, held, text) rows -> block rows; index 0 of the vocabulary is the end of a text."""
    task = TaskContext.get()
    number = count((task.partitionId() if task else 0) << 32)
    index: dict[bytes, int] = {}
    ids, held, lens, parts, size = [], [], [], [], 0

    def fresh():
        nonlocal index, ids, held, lens, parts, size
        index = defaultdict(count(1).__next__)
        ids, held, lens, parts, size = [], [], [], [], 0

    def flush():
        tokens = np.concatenate(parts)
        train = np.repeat(~np.array(held, bool), lens)
        n = np.bincount(tokens[train], minlength=len(index) + 1).astype(np.int32)
        row = [
            next(number), np.array(ids, np.int64).tobytes(), np.array(held, bool).tobytes(), np.array(lens, np.int32).tobytes(),
            planes(tokens, 4), b"\n".join(index), n.tobytes(), int(train.sum()),
        ]
        _, cls, slot = classified(row[5], len(n))
        row.append(np.bincount(cls * SLOTS + slot, n, CLASSES * SLOTS).astype(np.int64).tolist())
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=NAMES)

    fresh()
    for batch in batches:
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = (t.as_py() or "").encode().lower()  # of bytes: A-Z alone
            split = text.split()  # of bytes: the six kinds of white space alone
            one = np.fromiter(map(index.__getitem__, split), np.int32, len(split))
            ids.append(-(1 << 63) if i is None else i)
            held.append(bool(h))
            lens.append(len(split) + 1)
            parts.append(np.append(one, np.int32(0)))
            size += len(text) + 8
            if size >= BLOCK_BYTES:
                yield flush()
                fresh()
    if ids:
        yield flush()


def each(batch):
    """The rows of a batch one at a time: a block is large, and a batch may hold many."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def classified(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class and slot of the words of a vocabulary."""
    data = np.frombuffer(raw, np.uint8)
    hashes, cls = np.full(n, 0x5DEECE66D, np.uint64), np.zeros(n, np.int64)
    if len(data):
        gap = np.flatnonzero(SPACE[data])
        start, end = np.append(0, gap + 1), np.append(gap, len(data))
        hashes[1:] = strings(data, start, end)
        tail = strings(data, np.maximum(start, end - 4), end)
        cls[1:] = 1 + (tail >> np.uint64(20)).astype(np.int64) % (CLASSES - 1)
    slot = (mix64(hashes) >> np.uint64(33)).astype(np.int64) % SLOTS
    slot[0] = 0
    return hashes, cls, slot


class Block:
    def __init__(self, row: dict):
        self.name = row["block"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.held = np.frombuffer(row["held"], bool)
        self.lens = np.frombuffer(row["lens"], np.int32)
        self.tokens = words(row["tokens"], 4).astype(np.int64)
        self.n_train = np.frombuffer(row["n_train"], np.int32)
        self.raw = row["vocab"]
        self.hash, self.cls, self.slot = classified(self.raw, len(self.n_train))
        begin = np.cumsum(self.lens) - self.lens
        self.since = np.repeat(begin, self.lens)  # for each token the start of its text
        self.begin = begin

    def back(self, at: np.ndarray, k: int, table: np.ndarray, start) -> np.ndarray:
        """What ``table`` has of the k-th token before each of ``at``; ``start`` before the start of its text."""
        j = at - k
        return np.where(j >= self.since[at], table[self.tokens[np.maximum(j, 0)]], start)

    def pairs(self) -> np.ndarray:
        """A key for each token and the one before it (a text's first token follows its start)."""
        at = np.arange(len(self.tokens))
        return mix64(self.back(at, 1, self.hash, _START) * _GOLD + self.hash[self.tokens])

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of words and how to get each word's; the same of pairs; their training counts."""
        word, at_word = np.unique(self.hash, return_inverse=True)
        pair, at_pair = np.unique(self.pairs(), return_inverse=True)
        n_word = np.bincount(at_word, self.n_train, len(word)).astype(np.int64)
        n_pair = np.bincount(at_pair[np.repeat(~self.held, self.lens)], minlength=len(pair))
        return (word, at_word, n_word), (pair, at_pair, n_pair)

    def vocabulary(self) -> list[bytes]:
        return [b"", *(self.raw.split(b"\n") if self.raw else [])]

    def features(self, at: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Bucket numbers of the tokens at ``at``: for their class, and for their slot, which know the class."""
        w1, w2 = self.back(at, 1, self.hash, _START), self.back(at, 2, self.hash, _START)
        c = [self.back(at, k, self.cls, CLASSES).astype(np.uint64) for k in (1, 2, 3, 4)]
        pair = np.uint64(CLASSES + 1)
        both = w1 * _GOLD + w2
        down = np.uint64(64 - bits)
        place = lambda x, k: (mix64(x + np.uint64((k + 1) << 56)) >> down).astype(np.int64)
        own = self.cls[self.tokens[at]].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        of_class = [place(x, k) for k, x in enumerate((w1, both, w2, c[0] * pair + c[1], c[2] * pair + c[3]))]
        return of_class, [place(x + own, k + 8) for k, x in enumerate((w1, both, w2))]


def shares(weights: np.ndarray, f: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """The softmax of each row of features over the logarithms ``prior``; scores are bounded, so that none overflows."""
    z = np.take(weights, f[0], axis=0)
    for one in f[1:]:
        z += np.take(weights, one, axis=0)
    z += prior
    np.clip(z, -40, 40, out=z)
    np.exp(z, out=z)
    z /= z.dot(np.ones(z.shape[1], z.dtype))[:, None]
    return z


def priors(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the shares of classes, and of the slots in each class."""
    by_class = leaves.sum(1)
    log = lambda x, total: np.log(np.maximum(x, 1e-12) / np.maximum(total, 1)).astype(np.float32)
    return log(by_class, by_class.sum()), log(leaves, by_class[:, None])


class Step:
    """A block's own copy of one softmax's weights while it trains."""

    def __init__(self, start: np.ndarray):
        self.w, self.scale, self.seen = start.copy(), np.zeros(len(start), np.float32), np.zeros(len(start), np.int64)
        self.loss = 0  # -log2 of the answers before each step, a whole number of 1 / _ONE

    def learn(self, f: list[np.ndarray], prior: np.ndarray, answer: np.ndarray) -> None:
        """One step; a row's rate falls with its own gradients."""
        z, n = shares(self.w, f, prior), len(self.w)
        at, flat = np.arange(len(answer)) * z.shape[1] + answer, z.reshape(-1)
        right = flat[at]
        self.loss -= int(np.rint(np.log2(right).sum(dtype=np.float64) * _ONE))
        flat[at] = right - 1
        every = np.concatenate(f)
        self.seen += np.bincount(every, minlength=n)
        z *= np.float32(_FINE)
        np.rint(z, out=z)
        whole = z[:, 1::2].astype(np.float64)
        whole *= _NEXT
        whole += z[:, 0::2]
        g, column = np.empty((z.shape[1], n), np.float32), np.empty((len(f), len(z)))
        for c in range(whole.shape[1]):
            column[:] = whole[:, c]
            total = np.bincount(every, column.reshape(-1), n)
            upper = total * (1.0 / _NEXT)
            np.rint(upper, out=upper)
            g[2 * c + 1] = upper
            upper *= _NEXT
            total -= upper
            g[2 * c] = total
        g *= np.float32(1.0 / _FINE)
        self.scale += np.einsum("ij,ij->j", g, g)
        self.w -= (g * (RATE / np.sqrt(1e-8 + self.scale))).T


def batch_for(tokens: int) -> int:
    return int(min(MAX_BATCH, max(256, tokens // STEPS)))


def rounds_for(tokens: int) -> int:
    """The rounds that training took when they followed the size. Only a test still calls this; ``gains`` decides now."""
    return int(min(MAX_ROUNDS, max(MIN_ROUNDS, 6_000_000 // max(tokens, 1))))


def gains(losses: list[float]) -> bool:
    """Whether to go on after rounds of these losses: until one takes off less than ``LEAST_GAIN``, as one must, for losses are not negative."""
    return len(losses) < 2 or losses[-2] - losses[-1] >= LEAST_GAIN


def bits_for(tokens: int) -> int:
    """Twice the buckets for four times the tokens."""
    return int(min(MAX_BITS, MIN_BITS + max(0, math.ceil(math.log2(max(tokens, 1) / 2e8) / 2))))


def learn(b: Block, start: tuple[np.ndarray, np.ndarray], prior: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[Step, Step]:
    steps = tuple(Step(w) for w in start)
    mine = np.flatnonzero(np.repeat(~b.held, b.lens))
    size = batch_for(len(mine))
    for a in range(0, len(mine), size):
        at = mine[a : a + size]
        of_class, of_slot = b.features(at, bits)
        own = b.tokens[at]
        steps[0].learn(of_class, prior[0], b.cls[own])
        some = np.flatnonzero(own > 0)
        if len(some):
            steps[1].learn([f[some] for f in of_slot], prior[1][b.cls[own[some]]], b.slot[own[some]])
    return steps


def train(blocks: DataFrame, tokens: int, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both softmaxes."""
    spark = blocks.sparkSession
    bits = bits_for(tokens)
    size, width = 1 << bits, (1 << bits) // RANGES
    weights, prior = tuple(np.zeros((size, n), np.float32) for n in (CLASSES, SLOTS)), priors(leaves)
    losses: list[float] = []
    while gains(losses):
        shared = spark.sparkContext.broadcast(weights)

        def step(batches, shared=shared):
            start = shared.value
            total = [np.zeros(w.shape, np.int64) for w in start]
            seen = [np.zeros(len(w), np.int64) for w in start]
            loss = 0
            for batch in batches:
                for row in each(batch):
                    for k, own in enumerate(learn(Block(row), start, prior, bits)):
                        total[k] += np.rint((own.w - start[k]) * np.float32(_ONE)).astype(np.int64) * own.seen[:, None]
                        seen[k] += own.seen
                        loss += own.loss
            for k, i in ((k, i) for k in range(len(start)) for i in range(RANGES)):
                part = slice(i * width, (i + 1) * width)
                hit = np.flatnonzero(seen[k][part])
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k * RANGES + i], pa.int32()), pa.array([hit.astype(np.int32).tobytes()]), pa.array([planes(seen[k][part][hit])]),
                            pa.array([planes(total[k][part][hit].reshape(-1))]), pa.array([loss], pa.int64()),
                        ],
                        names=["range", "hit", "seen", "change", "loss"],
                    )
                    loss = 0  # once a task

        def add(batches):
            total: dict[int, np.ndarray] = {}
            weight: dict[int, np.ndarray] = {}
            loss = 0
            for batch in batches:
                for row in each(batch):
                    i, hit = row["range"], np.frombuffer(row["hit"], np.int32)
                    if i not in total:
                        total[i], weight[i] = np.zeros((width, (CLASSES, SLOTS)[i // RANGES]), np.int64), np.zeros(width, np.int64)
                    total[i][hit] += words(row["change"]).view(np.int64).reshape(len(hit), -1)
                    weight[i][hit] += words(row["seen"]).view(np.int64)
                    loss += row["loss"]
            for i in total:
                mean = (total[i] / np.maximum(weight[i], 1)[:, None] / _ONE).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([mean.tobytes()]), pa.array([loss], pa.int64())], names=["range", "mean", "loss"])
                loss = 0

        changes = blocks.select(*NAMES).mapInArrow(step, "range int, hit binary, seen binary, change binary, loss long").repartition(2 * RANGES, "range")
        whole = 0
        for at, mean, loss in changes.mapInArrow(add, "range int, mean binary, loss long").collect():  # one number a weight
            k, i = divmod(at, RANGES)
            weights[k][i * width : (i + 1) * width] += np.frombuffer(mean, np.float32).reshape(width, -1)
            whole += loss
        losses.append(whole / _ONE / max(int(leaves.sum()), 1))
        shared.unpersist()
    return weights


def messages(parts: int):
    """Block rows -> a message for each block and part with the block's words and pairs there."""

    def run(batches):
        for batch in batches:
            for row in each(batch):
                b = Block(row)
                cut, sent = [], []
                for keys, _, n in b.keys():
                    own = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                    cut.append(np.searchsorted(own, np.arange(parts + 1)))
                    sent.append((keys, n))
                full = np.flatnonzero(np.diff(cut[0]) + np.diff(cut[1])).tolist()
                cols = [[planes(x[c[i] : c[i + 1]], size) for i in full] for c, pair in zip(cut, sent, strict=True) for x, size in zip(pair, (8, 4), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.name] * len(full), pa.int64()), pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in cols)],
                    names=["block", "part", "words", "n_words", "pairs", "n_pairs"],
                )

    return run


MESSAGE = "block long, part int, words binary, n_words binary, pairs binary, n_pairs binary"
SUMS = "block long, part int, words binary, pairs binary, size int, n long, total long, once long"


def add_up(batches):
    """The messages of whole parts -> each with its keys' counts in the corpus. Rows without a block tell how many words have a count of
    1, of 2, and of each power of two beyond, what their counts add up to, and how many pairs occur once."""
    names, got = [], [[], [], [], []]
    for batch in batches:
        for row in each(batch):
            names.append((row["block"], row["part"]))
            for x, c in zip(got, ("words", "n_words", "pairs", "n_pairs"), strict=True):
                x.append(words(row[c], 4 if c.startswith("n_") else 8))
    if not names:
        return
    sums, facts = [], []
    for keys, n in ((got[0], got[1]), (got[2], got[3])):
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(n).astype(np.float64), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        sums.append([planes(total[at[end - len(k) : end]]) for k, end in zip(keys, ends, strict=True)])
        facts.append(total[total > 0])
    for (block, part), a, b in zip(names, *sums, strict=True):
        row = [block, part, a, b, None, None, None, None]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SUM_TYPES, strict=True)], names=_SUM_NAMES)
    size = np.minimum(facts[0] - 1, np.floor(np.log2(np.maximum(facts[0], 1))).astype(np.int64) + (facts[0] > 2))
    n, total = np.bincount(size, minlength=1), np.bincount(size, facts[0].astype(np.float64), minlength=1)
    once = [int((facts[1] == 1).sum())] + [0] * (len(n) - 1)
    cols = [[None] * len(n)] * 4 + [list(range(len(n))), n.tolist(), total.astype(np.int64).tolist(), once]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _SUM_TYPES, strict=True)], names=_SUM_NAMES)


def part_by_part(batches):
    """``add_up`` of each part alone: rows come in the order of their parts, and a task may hold several."""
    rows = (batch.slice(i, 1) for batch in batches for i in range(len(batch)))
    for _, own in groupby(rows, key=lambda row: row["part"][0].as_py()):
        yield from add_up(own)


_SUM_NAMES = [c.split()[0] for c in SUMS.split(", ")]
_SUM_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in SUMS.split(", ")]


def strength_of(sizes: list[tuple[float, float]], once: float) -> float:
    """The s at which the sum of c * s / (c + s) over (c, number of words with c) is ``once``."""
    low, high = 1e-3, 1e9
    for _ in range(100):
        s = (low * high) ** 0.5
        if sum(k * c * s / (c + s) for c, k in sizes) < once:
            low = s
        else:
            high = s
    return low


class Model:
    """All that scoring needs beside a block and its sums: numbers of a fixed size."""

    def __init__(self, weights, bits: int, total: int, distinct: int, once: int, twice: int, strength: float, leaves: np.ndarray):
        self.weights, self.bits, self.total, self.distinct, self.strength = weights, bits, total, distinct, strength
        self.unseen = min(0.5, (once + 1) / (total + 2)) if total else 1.0
        self.to_come = max(1.0, once * (once - 1) / (2.0 * (twice + 1)))
        self.leaves, self.prior = leaves.astype(np.float64), priors(leaves)

    def softmax(self, k: int, f: list[np.ndarray] | None, prior: np.ndarray, full: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 of the probability of ``own`` among the outputs that have words (``full``); without weights by frequency."""
        p = shares(self.weights[k], f, prior) if self.weights else np.exp(prior)
        return np.log10(p[np.arange(len(own)), own].astype(np.float64) / np.einsum("...j,...j->...", p, full, dtype=np.float64))

    def logs(self, b: Block, c: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 p(token | history) of each token; ``c``: the vocabulary's counts, ``pair``: each token's with the one before."""
        known = c > 0
        leaf = self.leaves[b.cls, b.slot]
        share = np.log10(np.maximum(c, 1)) - np.log10(np.maximum(leaf, 1)) + np.log10(max(1 - self.unseen, 1e-12))
        word = np.where(known, share, np.log10(self.unseen / self.to_come))
        model = word[b.tokens]
        by_class = self.leaves.sum(1)
        for a in range(0, len(b.tokens), MAX_BATCH):
            at = np.arange(a, min(a + MAX_BATCH, len(b.tokens)))
            at = at[known[b.tokens[at]]]
            if not len(at):
                continue
            own = b.tokens[at]
            cls = b.cls[own]
            f = b.features(at, self.bits) if self.weights else (None, None)
            model[at] += self.softmax(0, f[0], np.broadcast_to(self.prior[0], (len(at), CLASSES)), by_class > 0, cls)
            model[at] += self.softmax(1, f[1], self.prior[1][cls], self.leaves[cls] > 0, b.slot[own])
        if self.weights:
            last = b.back(np.arange(len(b.tokens)), 1, c, c[0])  # as many starts as ends
            model = np.log10(pair + self.strength * 10**model) - np.log10(last + self.strength)
        return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", history: bool = True) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_score for every row; learns from rows not held out.

    ``known_score`` is the part of ``score`` that known tokens have. Without ``history`` classes, slots and words follow
    their frequencies alone, for comparison.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = materialise(src.mapInArrow(encode, BLOCK), "blocks")
    n_blocks, tokens = blocks.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    counted = blocks.select(F.posexplode("leaves").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect()  # a row a slot
    leaves = np.zeros(CLASSES * SLOTS, np.int64)
    for at, n in counted:
        leaves[at] = n
    leaves = leaves.reshape(CLASSES, SLOTS)
    weights = train(blocks, tokens, leaves) if history else None
    forget_shuffles(spark)

    parts = max(12, -(-n_blocks // BLOCKS_PER_PART))
    sent = blocks.select(*NAMES).mapInArrow(messages(parts), MESSAGE).repartition(parts, "part").sortWithinPartitions("part")
    sums = materialise(sent.mapInArrow(part_by_part, SUMS), "sums")
    del sent
    forget_shuffles(spark)
    facts = sums.where("block is null").groupBy("size").agg(F.sum("n"), F.sum("total"), F.sum("once")).collect()  # a row a power of two
    total, distinct = sum(r[2] for r in facts), sum(r[1] for r in facts)
    once, twice = (next((r[1] for r in facts if r[0] == k), 0) for k in (0, 1))
    strength = strength_of([(r[2] / r[1], r[1]) for r in facts if r[1]], sum(r[3] for r in facts)) if total else 1.0
    model = Model(weights, bits_for(tokens), total, distinct, once, twice, strength, leaves)
    shared = spark.sparkContext.broadcast(model)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        m, out = shared.value, [[] for _ in range(7)]
        right = right.sort_by("part")
        for row in left.to_pylist():
            b = Block(row)
            (_, at_word, _), (_, at_pair, _) = b.keys()
            gather = lambda name: np.concatenate([words(x) for x in right.column(name).to_pylist()]).astype(np.int64)
            c = gather("words")[at_word]
            known = c > 0
            base = np.log10(c + 1.0) - np.log10(m.total + m.distinct + 1.0)
            logs = m.logs(b, c, gather("pairs")[at_pair])
            add = lambda x: np.add.reduceat(x, b.begin).tolist()
            out[0] += [None if i == -(1 << 63) else i for i in b.ids.tolist()]
            out[1] += b.held.tolist()
            out[2] += b.lens.tolist()
            out[3] += add(known[b.tokens].astype(np.int64))
            out[4] += add(base[b.tokens])
            out[5] += add(logs)
            out[6] += add(np.where(known[b.tokens], logs, 0.0))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *(pa.float64(),) * 3)
        names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "known_score"]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    found = sums.where("block is not null").select("block", "part", "words", "pairs")
    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, known_score double"
    done = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, schema)
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "known_score")


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), fold(7) == 2)
