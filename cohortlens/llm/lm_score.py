"""Scoring texts with a hashed maximum-entropy language model.

Features of a token are the word before it, the word before that (a skip
feature) and the hashed pair of both.  The softmax is factored: first over word
classes, then over the words of the class.  The most frequent words are modelled
one by one; the last class stands for all other words, which a tree of 16-way
softmaxes tells apart: a hash of the word names its leaf, and the words of a leaf
share its mass by their counts plus one, with one more share for words never
seen, so that the probabilities of all words (and one unseen a leaf) sum to one.

Nothing learned has a fixed size beyond the head classes: the leaves grow with
the distinct words (about ``LEAF_WORDS`` to a leaf), the rows of hashed contexts,
pairs and tree features with the root of the training tokens.  The tasks that
train grow with that root too, so that what they send grows with the input.

Counts come from all training documents.  The weights are trained by distributed
gradient updates: in each of ``ROUNDS`` rounds every task starts from the same
weights, takes AdaGrad steps over its own documents, and sends the rows that it
moved with the number of their visits; rows are averaged by visits.  Every
training document is used in exactly one round, over its whole length.

The counts of the ``HEAD`` most frequent words travel to the tasks (a fixed
number of words); the others are joined by the word, one row for each document
and word, with the document's own sums in rows of unique keys, so that no join
key is hot.

Defined cases: null text counts as empty and has the end token only; a token
equal to no training token has count 0; an empty table gives an empty result;
without training documents the model is uniform over one class; every row is
scored: rows of one doc_id (null included) are told apart by a hash of their
texts, and those of equal texts, which score alike, are summed, divided by their
number and given back as often; a row without doc_id is not held out and not
learned from; a text is held whole by the task that reads it; equal counts (ties)
are ranked by the word; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, grouped, kept_columns, small_batches, table, texts, unfolded

END = ""  # no word is empty
CLASSES, PER_CLASS = 16, 32
MODELLED = CLASSES * PER_CLASS
HEAD = 200_000
BITS = 4  # of a leaf's number, for each level of the tree
LEAF_WORDS = 100
LEAST_ROWS = 1 << 12
#: Root of the training tokens for each task that trains, and the least tasks.
_TASK_ROOT, _LEAST_TASKS = 350, 12
ROUNDS = 2
RATE = 0.15
BATCH = 1 << 14
#: Occurrences in a batch beyond which a row's gradients are summed by themselves.
LONG = 24
_CHUNK = 256
#: Words that a task counts before it sends them on.
_COUNTED = 300_000
FOLDS, HELD_OUT = 7, 2


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()  # on bytes both touch ASCII only


def word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts of a column, one after the other, and how many each text has; null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string())))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    return flat.filter(full), np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(lists))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: tokens of all documents, the end token as the empty word."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in own], pa.string()), pa.array(list(own.values()), pa.int64())], schema=schema)

        for b in batches:
            for t in texts(b.column(0)):
                own.update(tokens(t))
            own[b""] += b.num_rows
            if len(own) > _COUNTED:
                yield sent()
                own.clear()
        if own:
            yield sent()

    return kept_columns(docs, "text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the head words by rank, and the totals of all words."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    shares: np.ndarray  # by leaf: the counts of its words that aren't modelled plus one each, and one share for the unseen
    known: pa.Array | None = None
    hashes: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": None, "hashes": None}

    @property
    def rows(self) -> int:
        """Rows of each hashed table: a power of two that grows with the root of the tokens."""
        return max(LEAST_ROWS, 1 << math.ceil(math.log2(math.sqrt(self.total + 1))))

    def ids(self, words: pa.Array) -> np.ndarray:
        """Rank of each word, -1 if it isn't in the head."""
        if self.known is None:
            self.known = pa.array([w.decode() for w in self.words], pa.string())
        return pc.index_in(words, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)

    def hash(self, ids: np.ndarray, tail: list[str]) -> np.ndarray:
        """A hash of each word; tail has those that aren't in the head."""
        if self.hashes is None:
            self.hashes = np.array([zlib.crc32(w) for w in self.words], dtype=np.int64)
        out = np.empty(len(ids), dtype=np.int64)
        head = ids >= 0
        out[head] = self.hashes[ids[head]]
        out[~head] = [zlib.crc32(w.encode()) for w in tail]
        return out


class MaxEnt:
    """The weights, as tables of rows: cb c1 c2 cp for the classes, wb w1 w2 for the words of a class, tb t1 t2 for the nodes of the tree."""

    def __init__(self, vocabulary: Vocabulary):
        """Start from the counts: the biases make the unigram model."""
        leaves, n = len(vocabulary.shares), vocabulary.rows
        self.depth, self.n = (leaves.bit_length() - 1) // BITS, n
        wide, branch = CLASSES + 1, 1 << BITS
        contexts = MODELLED + n + 1
        self.shapes = {"cb": (1, wide), "c1": (contexts, wide), "c2": (contexts, wide), "cp": (n, wide), "wb": (CLASSES, PER_CLASS), "w1": (n, PER_CLASS), "w2": (n, PER_CLASS), "tb": ((leaves - 1) // (branch - 1), branch), "t1": (n, branch), "t2": (n, branch)}
        self.t = {k: np.zeros(s, dtype=np.float32) for k, s in self.shapes.items()}
        c = np.zeros(MODELLED)
        k = min(len(vocabulary.counts), MODELLED)
        c[:k] = vocabulary.counts[:k]
        by = c.reshape(CLASSES, PER_CLASS)
        shares = lambda x: np.log(x / x.sum(axis=1, keepdims=True))
        self.t["cb"][:] = shares(np.r_[by.sum(axis=1), vocabulary.total - c.sum()][None, :] + 0.5)
        self.t["wb"][:] = np.where(by > 0, shares(by + 1e-9), -30.0)
        levels = [shares(vocabulary.shares.reshape(branch ** (x + 1), -1).sum(axis=1).reshape(-1, branch)) for x in range(self.depth)]
        self.t["tb"][:] = np.concatenate(levels)

    def examples(self, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token, its hash, the context before and the one before that, over documents that begin at starts."""
        ctx = np.where((ids >= 0) & (ids < MODELLED), ids, MODELLED + (hashes >> 8) % self.n).astype(np.int32)
        one, two = np.empty_like(ctx), np.empty_like(ctx)
        one[1:], two[2:] = ctx[:-1], ctx[:-2]
        one[starts] = two[starts] = MODELLED + self.n
        second = starts[starts + 1 < len(ids)] + 1
        two[second] = MODELLED + self.n
        return ids, hashes, one, two

    @staticmethod
    def _softmax(z):
        """Of log-odds that start as log shares; what training adds is far from the bounds of single precision, which the clip and the floor keep."""
        np.minimum(z, 80, out=z)
        np.exp(z, out=z)
        z /= np.maximum(z @ np.ones(z.shape[1], np.float32), 1e-30)[:, None]
        return z

    def _sum(self, *parts: tuple[str, np.ndarray]) -> np.ndarray:
        """The rows of some tables, added up."""
        (name, rows), *more = parts
        z = self.t[name].take(rows, axis=0)
        for name, rows in more:
            z += self.t[name].take(rows, axis=0)
        return z

    def _forward(self, one, two, cls):
        pair = ((one.astype(np.int64) * 7919 + two) * 2654435761 >> 7) % self.n
        z = self._softmax(self._sum(("c1", one), ("c2", two), ("cp", pair)) + self.t["cb"])
        some = np.flatnonzero(cls < CLASSES)
        k = cls[some].astype(np.int64)
        a = ((one[some] * np.int64(CLASSES) + k) * 2654435761 >> 9) % self.n
        b = ((two[some] * np.int64(CLASSES) + k) * 2246822519 >> 9) % self.n
        y = self._softmax(self._sum(("w1", a), ("w2", b), ("wb", k)))
        return z, pair, some, k, a, b, y

    def _descend(self, one, two, hashes):
        """The tree's part for tokens that aren't modelled: rows and probabilities, all tokens level by level, and the branches that they take."""
        leaf = hashes % (1 << BITS * self.depth)
        down = [BITS * (self.depth - x) for x in range(self.depth)]
        node = np.concatenate([((1 << BITS * x) - 1) // ((1 << BITS) - 1) + (leaf >> d) for x, d in enumerate(down)])
        branch = np.concatenate([(leaf >> d - BITS) % (1 << BITS) for d in down])
        a = ((np.tile(one.astype(np.int64), self.depth) * 1000003 + node) * 2654435761 >> 9) % self.n
        b = ((np.tile(two.astype(np.int64), self.depth) * 1000003 + node) * 2246822519 >> 9) % self.n
        return node, branch, a, b, self._softmax(self._sum(("t1", a), ("t2", b), ("tb", node)))

    def log_probs(self, ids, hashes, one, two) -> np.ndarray:
        """log10 of the model's probability of each token; for a word that isn't modelled, of its leaf."""
        out = np.empty(len(ids))
        for at in range(0, len(ids), BATCH):
            s = slice(at, at + BATCH)
            i = ids[s]
            cls = np.where((i >= 0) & (i < MODELLED), i // PER_CLASS, CLASSES)
            z, _, some, _, _, _, y = self._forward(one[s], two[s], cls)
            p = np.log10(np.maximum(z[np.arange(len(i)), cls], 1e-30, dtype=np.float64))
            p[some] += np.log10(np.maximum(y[np.arange(len(some)), i[some] % PER_CLASS], 1e-30, dtype=np.float64))
            rest = np.flatnonzero(cls == CLASSES)
            _, branch, _, _, q = self._descend(one[s][rest], two[s][rest], hashes[s][rest])
            p[rest] += np.log10(np.maximum(q[np.arange(len(branch)), branch], 1e-30, dtype=np.float64)).reshape(self.depth, -1).sum(axis=0)
            out[s] = p
        return out

    def step(self, ids, hashes, one, two, squares, visits) -> None:
        """One AdaGrad step over a batch of tokens."""
        cls = np.where((ids >= 0) & (ids < MODELLED), ids // PER_CLASS, CLASSES)
        z, pair, some, k, a, b, y = self._forward(one, two, cls)
        z[np.arange(len(ids)), cls] -= 1
        y[np.arange(len(some)), ids[some] % PER_CLASS] -= 1
        rest = np.flatnonzero(cls == CLASSES)
        node, branch, ta, tb, q = self._descend(one[rest], two[rest], hashes[rest])
        q[np.arange(len(branch)), branch] -= 1
        bias = z.sum(axis=0)
        squares["cb"] += (bias**2).mean()
        self.t["cb"][0] -= RATE * bias / np.sqrt(squares["cb"] + 1)
        visits["cb"] += len(ids)
        for name, rows, grad in (("c1", one, z), ("c2", two, z), ("cp", pair, z), ("w1", a, y), ("w2", b, y), ("wb", k, y), ("t1", ta, q), ("t2", tb, q), ("tb", node, q)):
            if len(rows):
                which, sizes, sums = _row_sums(rows, grad, self.shapes[name][0])
                square = squares[name].take(which)
                square += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
                squares[name][which] = square
                visits[name][which] += sizes
                sums *= (RATE / np.sqrt(square + 1e-2))[:, None]
                moved = self.t[name].take(which, axis=0)
                moved -= sums
                whole = np.dtype((np.void, moved.itemsize * moved.shape[1]))  # a row is written back as one piece
                self.t[name].view(whole)[:, 0][which] = moved.view(whole)[:, 0]


def _row_sums(rows: np.ndarray, grad: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (numbers below n) that occur, how often, and the sum of grad over each.

    Most hashed rows occur once or a few times in a batch: they are summed occurrence by occurrence,
    all rows at once.  Only rows that occur more than LONG times are summed one after the other.
    """
    narrow = rows.astype(np.uint16) if n <= 1 << 16 else rows
    order = np.argsort(narrow, kind="stable" if narrow is not rows else None)
    sorted_rows = rows[order]
    first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    sizes = np.diff(np.r_[first, len(rows)])
    capped = np.minimum(sizes, LONG + 1)
    by = np.argsort((LONG + 1 - capped).astype(np.uint8), kind="stable")  # the most frequent first
    first, sizes = first[by], sizes[by]
    above = len(sizes) - np.cumsum(np.bincount(capped, minlength=LONG + 2))  # how many rows occur more than so many times
    long = above[LONG]
    sums = grad.take(order[first], axis=0)
    for r in range(1, LONG):
        if above[r] == long:
            break
        sums[long : above[r]] += grad.take(order[first[long : above[r]] + r], axis=0)
    if long:
        many = sizes[:long]
        starts = np.cumsum(many) - many
        of_long = np.arange(many.sum()) + np.repeat(first[:long] - starts, many)
        sums[:long] = np.add.reduceat(grad.take(order[of_long], axis=0), starts, axis=0)
    return sorted_rows[first], sizes, sums


def _arrays(vocabulary: Vocabulary, column: pa.Array):
    """Of all texts with their end tokens: the words that aren't in the head, ids and hashes of all, and where each text begins."""
    words, sizes = word_lists(column)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    found = vocabulary.ids(words)
    tail = words.filter(pa.array(found < 0))
    ids = np.full(starts[-1], -1 if not vocabulary.words else 0, dtype=np.int32)  # the end token is the first word
    at = np.ones(len(ids), bool)
    at[starts[1:] - 1] = False
    ids[at] = found
    hashes = np.zeros(len(ids), np.int64)
    hashes[at] = vocabulary.hash(found, tail.to_pylist())
    return tail, at & (ids < 0), ids, hashes, starts[:-1]


def train(docs: DataFrame, vocabulary: Vocabulary) -> MaxEnt:
    """Weights after ROUNDS rounds of gradient updates over the documents, each of which is used in one round."""
    spark = docs.sparkSession
    model = MaxEnt(vocabulary)
    src = kept_columns(docs, "doc_id", "text").coalesce(max(_LEAST_TASKS, math.ceil(math.sqrt(vocabulary.total) / _TASK_ROOT)))
    schema = pa.schema([("key", pa.string()), ("sums", pa.binary()), ("visits", pa.binary())])
    words_sent = spark.sparkContext.broadcast(vocabulary)
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = MaxEnt.__new__(MaxEnt)
            own.__dict__ |= sent.value.__dict__ | {"t": {k: v.copy() for k, v in sent.value.t.items()}}
            squares = {k: np.zeros(s[0], dtype=np.float32) for k, s in own.shapes.items()}
            visits = {k: np.zeros(s[0], dtype=np.float64) for k, s in own.shapes.items()}
            for b in grouped(batches):
                ids, hashes, one, two = own.examples(*_arrays(words_sent.value, b.column(0))[2:])
                for at in range(0, len(ids), BATCH):
                    s = slice(at, at + BATCH)
                    own.step(ids[s], hashes[s], one[s], two[s], squares, visits)
            for name, v in visits.items():
                for at in range(0, len(v), _CHUNK):
                    part = v[at : at + _CHUNK]
                    if part.any():
                        sums = (own.t[name][at : at + _CHUNK] * part[:, None]).astype(np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name}:{at}"]), pa.array([sums.tobytes()]), pa.array([part.tobytes()])], schema=schema)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, list[np.ndarray]] = {}
            for b in batches:
                for key, s, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    s, v = np.frombuffer(s, np.float32).astype(np.float64), np.frombuffer(v, np.float64)
                    if key in total:
                        total[key][0] += s
                        total[key][1] += v
                    else:
                        total[key] = [s, v.copy()]
            for key, (s, v) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([s.astype(np.float32).tobytes()]), pa.array([v.tobytes()])], schema=schema)

        ddl = "key string, sums binary, visits binary"
        moved = src.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ROUNDS)) == r).select("text").mapInArrow(run, ddl)
        # the result has as many bytes as the weights, however many tasks there were
        for row in moved.repartition("key").mapInArrow(add, ddl).toLocalIterator():
            name, at = row["key"].split(":")
            v = np.frombuffer(row["visits"], np.float64)
            s = np.frombuffer(row["sums"], np.float32).reshape(len(v), -1)
            hit = np.flatnonzero(v)
            model.t[name][int(at) + hit] = s[hit] / v[hit, None]
        sent.unpersist()
    return model


def _pairs(of: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The different pairs of a document's place and a word, as places, words and how often each occurs."""
    coded = words.dictionary_encode()
    n = max(len(coded.dictionary), 1)
    pairs, tf = np.unique(of * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // n, coded.dictionary.take(pa.array(pairs % n)), tf


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: MaxEnt) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score; a row for each row of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, model))
    base_total = vocabulary.total + vocabulary.distinct + 1
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("word", pa.string()), ("tf", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, net = sent.value
        base_of = np.log10((voc.counts + 1) / base_total)
        share_of = np.log10(voc.shares)
        other_of = np.log10(voc.counts + 1.0)
        for b in grouped(batches):
            rare, is_rare, ids, hashes, starts = _arrays(voc, b.column(2))
            logp = net.log_probs(*net.examples(ids, hashes, starts))
            head = ids >= 0
            rest = ~head | (ids >= MODELLED)
            logp[rest] -= share_of[hashes[rest] % len(share_of)]
            at = np.maximum(ids, 0)
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
            sizes, n = np.diff(np.r_[starts, len(ids)]), b.num_rows
            base = total(np.where(head, base_of[at], 0.0) if len(base_of) else np.zeros(len(ids)))
            own = total(logp + np.where(head & rest, other_of[at], 0.0) if len(base_of) else logp)
            keys = [f" {d}:{h}:{i}" for i, (d, h) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))]
            of, word, tf = _pairs(np.repeat(np.arange(n), sizes)[is_rare], rare)
            if not voc.words:  # nothing learned: the end tokens are as unknown as all words
                of, word, tf = np.r_[of, np.arange(n)], pa.concat_arrays([word, pa.array([END] * n, pa.string())]), np.r_[tf, np.ones(n, np.int64)]
            which, none = pa.array(np.r_[np.arange(n), of]), np.zeros(len(of), np.int64)
            columns = [b.column(0).take(which), b.column(1).take(which), pa.concat_arrays([pa.array(keys, pa.string()), word])]
            columns += [pa.array(np.r_[x, y]).cast(f.type) for x, y, f in zip((sizes, total(head.astype(np.int64)), base, own), (tf, none, none, none), list(schema)[3:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id bigint, h bigint, word string, tf bigint, known bigint, base double, score double"
    src = kept_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = src.mapInArrow(run, ddl)
    joined = rows.join(counts, "word", "left")
    own = F.substring("word", 1, 1) == " "
    plus = F.coalesce("c", F.lit(0)) + 1.0
    by = (
        joined.select(
            "doc_id",
            "h",
            F.when(own, F.col("tf")).otherwise(0).alias("tf"),
            F.when(own, 1).otherwise(0).alias("rows"),
            F.when(own, F.col("known")).otherwise(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
            F.when(own, F.col("base")).otherwise(F.col("tf") * F.log10(plus / base_total)).alias("base"),
            F.when(own, F.col("score")).otherwise(F.col("tf") * F.log10(plus)).alias("score"),
        )
        .groupBy("doc_id", "h")
        .agg(*[F.sum(c).alias(c) for c in ("tf", "rows", "known", "base", "score")])
    )
    return unfolded(by, F.col("rows"), "nth").select(
        "doc_id",
        (F.col("tf") / F.col("rows")).cast("bigint").alias("n_tokens"),
        (F.col("known") / F.col("rows")).cast("bigint").alias("n_known"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
    )


def _frequent(counts: DataFrame) -> DataFrame:
    """Words over a count that fewer than HEAD words exceed; found from a histogram of a fixed number of classes of counts."""
    level = F.when(F.col("c") < 1000, F.col("c").cast("double")).otherwise(1000 + F.floor(16 * F.log2(F.col("c") / 1000)))
    room, least = HEAD, float("inf")
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 1:
            break
        least = row["level"]
    return counts.where(level >= least)


def learn(docs: DataFrame) -> tuple[DataFrame, Vocabulary, MaxEnt]:
    """Counts of all words, the vocabulary and the trained weights, from training documents."""
    small_batches(docs.sparkSession)
    counts = cut(word_counts(docs))
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = sorted(_frequent(counts.where(F.col("word") != END)).collect(), key=lambda r: (-r["c"], r["word"]))
    ends = counts.where(F.col("word") == END).first()
    words = ([b""] if ends else []) + [r["word"].encode() for r in top]
    c = ([ends["c"]] if ends else []) + [r["c"] for r in top]
    leaves = 1 << BITS * max(1, math.ceil(math.log2(distinct / LEAF_WORDS + 1) / BITS))
    shares = np.ones(leaves)
    leaf = F.crc32(F.col("word").cast("binary")) % leaves
    found = counts.groupBy(leaf.alias("leaf")).agg(F.sum(F.col("c") + 1).alias("n")).toArrow()
    shares[found["leaf"].to_numpy()] += found["n"].to_numpy()
    for w, n in zip(words[:MODELLED], c[:MODELLED], strict=True):
        shares[zlib.crc32(w) % leaves] -= n + 1
    vocabulary = Vocabulary(words, np.array(c, dtype=np.int64), int(total or 0), int(distinct), shares)
    return counts, vocabulary, train(docs, vocabulary) if words else MaxEnt(vocabulary)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kept_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    counts, vocabulary, model = learn(docs.where(fold != HELD_OUT))
    return score(docs, counts, vocabulary, model).select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express; the trained score is tested on held-out documents."""
    return op7_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: CRC-32 of the decimal doc_id bit by bit; words from lower-cased texts, one end a text.
BASE_SQL = rf"""
with b as (select doc_id, list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch) >> i::int) & 1))),
    lambda c, x: xor(c >> 1, case when xor(c, x::bigint) & 1 = 1 then 3988292384::bigint else 0 end), 4294967295::bigint) as c, text from documents),
d as (select doc_id, xor(c, 4294967295::bigint) % {FOLDS} = {HELD_OUT} as held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') as w from b),
t as (select doc_id, held_out, unnest(w) as w from d),
c as (select w, count(*) as c from t where not held_out group by w),
n as (select sum(c)::bigint as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::double)), 4) as base_score
from t left join c using (w), n group by doc_id, held_out
"""

QUERIES = {"op7_lm_score": op7_lm_score, "lm_base_scores": lm_base_scores}
ORACLES = {"lm_base_scores": BASE_SQL}
