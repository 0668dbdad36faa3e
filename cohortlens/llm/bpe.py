"""Byte-level BPE encoding and decoding over a given public vocabulary.

Two tiers: a minimal perfect hash (hash and displace, exactly one slot a token)
answers pre-tokens that are a token as they stand; the others are merged with a
heap of candidate pairs over a linked list of byte ranges, lowest rank first,
the leftmost of equal ranks first.  Pre-tokens repeat a lot, so a worker
remembers a bounded number of answers.

The driver reads the vocabulary file (its path is a parameter) and broadcasts
it; its size is that of the file, whatever the corpus.

Defined cases: null text counts as empty (no ids); rows that repeat a doc_id or
have none are encoded each; pairs of equal rank (ties) merge from the left; a text
is encoded whole by the task that reads it; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import kept_columns, small_batches, table, texts

#: Answers that a worker remembers before it starts afresh.
MEMORY = 300_000
_MIX, _MIX2, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * _MIX & _ALL)) * _MIX2 & _ALL
    return (x ^ (x >> 29)) % n


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """_slot over arrays."""
    x = (h ^ (d.astype(np.uint64) * np.uint64(_MIX))) * np.uint64(_MIX2)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: key -> slot in range(n), with the key kept in its slot for the check."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((i, h))
        shift, slot_of, taken, singles = [0] * self.buckets, [-1] * n, bytearray(n), []
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((b, members[0][0]))
                continue
            for d in range(1 << 22):
                slots = {_slot(h, d, n) for _, h in members}
                if len(slots) == len(members) and not any(taken[s] for s in slots):
                    break
            else:
                raise ValueError("two keys have the same 64-bit hash")
            shift[b] = d
            for i, h in members:
                slot_of[i] = s = _slot(h, d, n)
                taken[s] = 1
        free = iter([s for s in range(n) if not taken[s]])
        for b, i in singles:
            slot_of[i] = next(free)
            shift[b] = -1 - slot_of[i]
        self.shift = np.array(shift, dtype=np.int64)
        self.key_at: list[bytes] = [b""] * n
        self.index_at = np.zeros(n, dtype=np.int64)
        for i, s in enumerate(slot_of):
            self.key_at[s], self.index_at[s] = keys[i], i

    def find(self, keys: list[bytes]) -> list[int]:
        """For each key the index it was given with, or -1."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            slots = np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), self.n))
        return [i if self.key_at[s] == k else -1 for k, s, i in zip(keys, slots.tolist(), self.index_at[slots].tolist(), strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a piece: a heap of pairs over byte ranges linked to their neighbours."""
    n = len(piece)
    if n == 1:
        return (ranks[piece],)
    end = list(range(1, n + 1))  # range i is piece[i:end[i]]; the next one starts at end[i]
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one side has been merged since
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (b := before[i]) >= 0 and (r := get(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class ByteBPE:
    """Encoder and decoder; the same ids as the public library gives for ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash | None = None):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = list(ranks)
        self.whole = whole or PerfectHash(self.tokens)
        self.ids = [ranks[t] for t in self.tokens]
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.ids}
        self.memory: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.memory)) if self.memory else list(pieces)
        if len(self.memory) + len(new) > MEMORY:
            self.memory, new = {}, list(pieces)
        raw = [p.encode() for p in new]
        for p, b, i in zip(new, raw, self.whole.find(raw), strict=True):
            self.memory[p] = (self.ids[i],) if i >= 0 else merge(b, self.ranks)

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(set(pieces))
        return list(chain.from_iterable(map(self.memory.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[str, ByteBPE] = {}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(ranks_path)
    sent = spark.sparkContext.broadcast((ranks, PerfectHash(list(ranks))))
    key = hashlib.sha256(f"{pattern}{sorted(ranks.items())}".encode()).hexdigest()
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(key)
        if coder is None:
            _encoders.clear()
            coder = _encoders[key] = ByteBPE(sent.value[0], pattern, sent.value[1])
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in texts(batch.column(1)):
                ids = coder.encode(text)
                cols[0].append(len(ids))
                cols[1].append(hashlib.sha256(",".join(map(coder.text_of.__getitem__, ids)).encode()).hexdigest())
                cols[2].append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    cols[3].append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=False)]], schema=schema)

    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return kept_columns(docs, "doc_id", "text").mapInArrow(run, ddl)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    return encode_documents(table(spark, sf_dir, "documents"), path, pattern, with_ids=False)


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
