"""Language identification with interpolated Kneser-Ney character models.

For every language an order-4 character model is counted over a bounded sample
of labelled documents (``SAMPLE_DOCS`` a language, chosen by a hash of doc_id).
Letters are lower-cased, everything between them is one gap.  Kneser-Ney
probabilities are worked out once for every n-gram that any language has, and
kept as arrays sorted by a hash of the n-gram (a bijection, so no collisions),
with a column for each language; a text is scored over its whole length with one
search a character, shorter contexts being looked up for the misses only.

The language with the least cross-entropy per character wins.  The score is a
posterior whose temperature is fitted on labelled documents that were not
counted; a text is rejected if its least cross-entropy lies above what those
documents and pieces of them, by length, show, or the posterior is under
``MIN_SCORE``.

Defined cases: text that is null or has no letter is ``und`` with score 0 and
rejected; with no labelled rows at all everything is ``und``; ties go to the
first language in code point order; rows with null doc_id or lang are scored but
not learned from (such a doc_id is not held out), nor are texts of more than
``SAMPLE_CHARS`` code points, which bounds what the sample holds; a text is scored
over its whole length, a block at a time; rows that repeat a doc_id are scored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept_columns, small_batches, table, texts

ORDER = 4
#: Labelled documents a language to learn from, whatever the size of the corpus: counted, and held back to calibrate.
SAMPLE_DOCS = 400
CALIBRATION_DOCS = 200
SAMPLE_CHARS = 1_000_000
MIN_SCORE = 0.3
#: The limit of a long text's nats per character is MARGIN times the 99 % quantile of the held-back documents.  A text of n characters
#: may lie higher by a spread over the root of n: SHORT_MARGIN times the 99 % quantile of what their pieces of these lengths lie above the
#: median (rarer pieces are keys and other junk inside documents, not texts of a language).
MARGIN, SHORT_MARGIN = 1.5, 2.5
PIECES, PER_LENGTH = (20, 40, 80, 160, 320), 8
SPLIT = 5
UND = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18

_lower: np.ndarray | None = None


def lower_table() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else 0."""
    global _lower
    if _lower is None:
        t = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _lower = t
    return _lower


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, each run of anything else as one 0, a 0 first; empty if it has no letter."""
    cp = lower_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = cp != 0
    if not keep.any():
        return cp[:0]
    keep[1:] |= cp[:-1] != 0
    out = cp[keep]
    return out if out[0] == 0 else np.concatenate([np.zeros(1, np.int32), out])


def count_grams(text: str, into: Counter) -> None:
    cp = letters(text)
    if len(cp):
        s = " " * (ORDER - 1) + "".join(map(chr, cp.tolist())).replace("\0", " ")[1:]
        into.update([s[i : i + ORDER] for i in range(len(s) - ORDER + 1)])


@dataclass
class KneserNey:
    """Models of all languages: for each order, hashed n-grams with log10-free (natural) log probabilities and back-off weights."""

    languages: list[str]
    alphabet: np.ndarray
    grams: list[np.ndarray] = field(default_factory=list)  # [n - 1]: sorted hashes of n-grams
    logp: list[np.ndarray] = field(default_factory=list)  # [n - 1]: n-grams x languages
    contexts: list[np.ndarray] = field(default_factory=list)  # [n - 1]: sorted hashes of the contexts of order n + 1
    backoff: list[np.ndarray] = field(default_factory=list)  # [n - 1]: contexts x languages
    temperature: tuple[float, float] = (1.0, 0.0)
    limit: tuple[float, float] = (np.inf, 0.0)

    @staticmethod
    def fit(counts: dict[str, dict[str, int]]) -> KneserNey:
        """counts: language -> {ORDER-gram: count}."""
        languages = sorted(counts)
        common = Counter()
        for c in counts.values():
            for g in c:
                common.update(g)
        common.pop(" ", None)
        chars = sorted(ord(c) for c, _ in common.most_common(65_000))
        model = KneserNey(languages, np.array([0, *chars], dtype=np.int32))
        own = {" ": 1} | {chr(c): i + 2 for i, c in enumerate(chars)}
        base = len(own) + 1
        levels: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
        for n in range(ORDER, 0, -1):
            level = {}
            for lang in languages:
                if n == ORDER:
                    keys = np.array([sum(own.get(ch, 0) << (16 * (ORDER - 1 - i)) for i, ch in enumerate(g)) for g in counts[lang]], dtype=np.uint64)
                    c = np.array(list(counts[lang].values()), dtype=np.float64)
                    keys, at = np.unique(keys, return_inverse=True)
                    level[lang] = keys, np.bincount(at, weights=c, minlength=len(keys))
                else:  # how many different characters stand before: continuation counts
                    k = levels[-1][lang][0] & np.uint64((1 << (16 * n)) - 1)
                    u, c = np.unique(k, return_counts=True)
                    level[lang] = u, c.astype(np.float64)
            levels.append(level)
        levels.reverse()
        lower_p: np.ndarray | None = None
        lower_k = np.zeros(0, np.uint64)
        for n, level in enumerate(levels, start=1):
            keys = np.unique(np.concatenate([level[x][0] for x in languages]))
            heads = np.unique(keys >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
            below = np.full((len(keys), len(languages)), 1.0 / base) if n == 1 else lower_p[np.searchsorted(lower_k, keys & np.uint64((1 << (16 * (n - 1))) - 1))]
            p, weight = below.copy(), np.ones((len(heads), len(languages)))
            of = np.searchsorted(heads, keys >> np.uint64(16)) if n > 1 else np.zeros(len(keys), np.int64)
            for j, lang in enumerate(languages):
                k, c = level[lang]
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                at = np.searchsorted(keys, k)
                total = np.bincount(of[at], weights=c, minlength=len(heads))
                kinds = np.bincount(of[at], minlength=len(heads))
                seen = total > 0
                weight[seen, j] = d * kinds[seen] / total[seen]
                p[:, j] = weight[of, j] * below[:, j]
                p[at, j] += (c - d) / total[of[at]]
            model._store(keys, np.log(p), heads, np.log(weight))
            lower_p, lower_k = p, keys
        model.floor = np.log(np.full(len(languages), 1.0 / base)) + model.backoff[0][0]
        return model

    floor: np.ndarray | None = None

    def _store(self, keys, logp, heads, weight) -> None:
        for k, v, ks, vs in ((keys, logp, self.grams, self.logp), (heads, weight, self.contexts, self.backoff)):
            h = k * _MIX
            order = np.argsort(h)
            ks.append(h[order])
            vs.append(v[order].astype(np.float32))

    @staticmethod
    def _find(sorted_hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys * _MIX
        at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
        return at, sorted_hashes[at] == h

    def _log_probs(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log probability of the last character of each n-gram, for every language."""
        if n == 0:
            return np.tile(self.floor.astype(np.float32), (len(keys), 1))
        at, hit = self._find(self.grams[n - 1], keys)
        out = self.logp[n - 1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            k = keys[miss]
            lower = self._log_probs(k & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)
            if n > 1:
                at, hit = self._find(self.contexts[n - 1], k >> np.uint64(16))
                lower = lower + np.where(hit[:, None], self.backoff[n - 1][at], np.float32(0))
            out[miss] = lower
        return out

    def _keys(self, cp: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, cp), len(self.alphabet) - 1)
        ids = np.where(self.alphabet[at] == cp, at + 1, 0).astype(np.uint64)
        ids = np.concatenate([np.ones(ORDER - 1, np.uint64), ids[1:]])
        n = len(ids) - ORDER + 1
        keys = np.zeros(n, np.uint64)
        for i in range(ORDER):
            keys = (keys << np.uint64(16)) | ids[i : i + n]
        return keys

    def entropies(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: characters scored, and cross-entropy per character (nats) in every language."""
        n, total = np.zeros(len(docs), np.int64), np.zeros((len(docs), len(self.languages)))
        waiting: list[tuple[int, np.ndarray]] = []

        def flush():
            keys = np.concatenate([k for _, k in waiting])
            ends = np.cumsum([len(k) for _, k in waiting])
            sums = np.add.reduceat(self._log_probs(keys, ORDER), np.r_[0, ends[:-1]], axis=0, dtype=np.float64)
            np.add.at(total, [i for i, _ in waiting], sums)
            waiting.clear()

        size = 0
        for i, text in enumerate(docs):
            cp = letters(text)
            if not len(cp):
                continue
            keys = self._keys(cp)
            n[i] = len(keys)
            for at in range(0, len(keys), _BLOCK):
                waiting.append((i, keys[at : at + _BLOCK]))
                size += len(waiting[-1][1])
                if size >= _BLOCK:
                    flush()
                    size = 0
        if waiting:
            flush()
        return n, -total / np.maximum(n, 1)[:, None]

    def posterior(self, n: np.ndarray, h: np.ndarray) -> np.ndarray:
        scale, power = self.temperature
        z = -h * (scale * np.maximum(n, 1) ** power)[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def pieces(self, text: str, language: int) -> list[tuple[int, float]]:
        """(length, cross-entropy per character in a language) of evenly spaced pieces of a text."""
        cp = letters(text)
        if not len(cp):
            return []
        total = np.r_[0, np.cumsum(-self._log_probs(self._keys(cp), ORDER)[:, language].astype(np.float64))]
        out = []
        for n in PIECES:
            if n < len(total):
                at = np.unique(np.linspace(0, len(total) - 1 - n, PER_LENGTH).astype(np.int64))
                out += [(n, float(x)) for x in (total[at + n] - total[at]) / n]
        return out

    def calibrate(self, n: np.ndarray, h: np.ndarray, truth: np.ndarray, pieces: np.ndarray) -> None:
        """Temperature by least log loss over a grid; limit of the least cross-entropy from what labelled texts and pieces (length, cross-entropy) show."""
        if not len(n):
            return
        best = (np.inf, (1.0, 0.0))
        for power in (0.0, 0.25, 0.5, 0.75, 1.0):
            for scale in (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
                self.temperature = (scale, power)
                loss = -np.log(np.maximum(self.posterior(n, h)[np.arange(len(n)), truth], 1e-12)).mean()
                best = min(best, (loss, self.temperature))
        self.temperature = best[1]
        own = h[np.arange(len(n)), truth]
        above = (pieces[:, 1] - np.median(own)) * np.sqrt(pieces[:, 0]) if len(pieces) else np.zeros(1)
        self.limit = (float(np.quantile(own, 0.99)) * MARGIN, max(float(np.quantile(above, 0.99)), 0.0) * SHORT_MARGIN)

    def decide(self, docs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, of each text."""
        n, h = self.entropies(docs)
        p = self.posterior(n, h)
        best = h.argmin(axis=1)
        score = np.where(n > 0, p[np.arange(len(docs)), best], 0.0)
        odd = h.min(axis=1) > self.limit[0] + self.limit[1] / np.sqrt(np.maximum(n, 1))
        return [self.languages[b] if k else UND for b, k in zip(best, n, strict=True)], score, (n == 0) | odd | (score < MIN_SCORE)


def learn(docs: DataFrame, *, exclude_fold: int | None = 0) -> KneserNey | None:
    """Fit and calibrate on a bounded sample of labelled rows; the rows of the fold left out are never touched."""
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % SPLIT
    rows = kept_columns(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if exclude_fold is not None:
        rows = rows.where(fold != exclude_fold)
    # one row a language comes to the driver; texts aren't read for it
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, c in sorted(sizes.items()) for x in (k, min(1.0, 1.25 * (SAMPLE_DOCS + CALIBRATION_DOCS) / c))])
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / F.lit(float(1 << 53))
    counted = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(SAMPLE_DOCS + CALIBRATION_DOCS)) < SAMPLE_DOCS
    rows = rows.where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    sample = cut(rows.where(u < F.element_at(share, F.col("lang"))).select("lang", counted.alias("counted"), "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                count_grams(text, own.setdefault(lang, Counter()))
        for lang, c in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    grams = sample.where("counted").select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint")
    table_ = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in zip(*(table_.column(i).to_pylist() for i in range(3)), strict=True):
        counts.setdefault(lang, {})[gram] = n
    if not counts:
        return None
    model = KneserNey.fit(counts)
    sent = spark.sparkContext.broadcast(model)
    place = {x: i for i, x in enumerate(model.languages)}
    floats = pa.list_(pa.float64())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(place[x], t) for x, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True) if x in place]
            n, h = sent.value.entropies([t for _, t in own])
            parts = [[v for p in sent.value.pieces(t, i) for v in p] for i, t in own]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array(n), pa.array(list(h), floats), pa.array(parts, floats)], names=["lang", "n", "h", "pieces"])

    held = sample.where("not counted").select("lang", "text").mapInArrow(measure, "lang bigint, n bigint, h array<double>, pieces array<double>").toArrow()
    if rows_ := [r for r in zip(*(c.to_pylist() for c in held.columns), strict=True) if r[1]]:
        truth, n, h, parts = zip(*rows_, strict=True)
        model.calibrate(np.array(n), np.array(h), np.array(truth), np.array([v for p in parts for v in p]).reshape(-1, 2))
    return model


def identify(docs: DataFrame, model: KneserNey | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected; a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    src = kept_columns(docs, "doc_id", "text")
    if model is None:
        return src.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lang, score, rejected = sent.value.decide(texts(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema=schema)

    return src.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: KneserNey | None) -> DataFrame:
    """The rows of docs, all columns, whose text the model doesn't reject."""
    if model is None:
        return docs.limit(0)
    spark = docs.sparkSession
    small_batches(spark)
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(~sent.value.decide(texts(b.column(at)))[2]))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % SPLIT == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
