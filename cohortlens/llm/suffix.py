"""Exact removal of repeated byte strings, by a sparse distributed suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier.
Suffixes are kept at sampled positions only: in every window of ``LENGTH`` bytes
the position whose next ``LEAD`` bytes hash lowest.  The choice depends on the
window's bytes alone, so equal windows hold the same sampled suffix at the same
offset, and each repeat is seen at one of them.  About 4 % of the positions are
sampled.

1. Each task finds the sampled suffixes of its documents and hashes their leading
   bytes and their whole surroundings (all windows around the position).  This is
   the aggregation before the shuffle: of equal surroundings in one task all but
   the first are covered, and only the first goes on.
2. A filter by the same hashes over all tasks: suffixes whose leading bytes hash like
   no others' repeat nothing, and of equal surroundings again the first goes on.
3. All others are sorted.  Sampled splitters range-partition them by their first 8
   bytes (place breaks ties, so the suffixes of a hot passage are cut like any
   others), and a partition comes in the order of these as buckets of about
   ``BUCKET`` suffixes.  Each bucket is sorted by multikey quicksort with 8-byte
   characters and neighbours are compared (longest common prefixes).  For each
   offset those windows are equal whose suffixes lie in one run of common prefixes
   and whose bytes to the left agree.  Suffixes that begin like a bucket's first or
   last one may have equals in the buckets before and after: the first of each of
   their different windows is compared across the boundaries by a grouped minimum.
4. Covered ranges meet their documents, are merged, and the bytes are cut out.

Hot leading bytes: where one task has more than ``MANY`` different surroundings
of the same leading bytes these are known to repeat, so the suffixes skip step 2
(one stands in for them) under a key of their own.  A task holds one bucket at a
time, at most twice ``BUCKET`` suffixes of about 0.5 kB, however large the input.

Defined cases: null text counts as empty; documents under LENGTH bytes are never
changed; a null doc_id is later than all others; rows of one doc_id with
different texts are documents of their own, in the order of a hash of their
texts, and rows that agree in doc_id and text are one document, whose result each
of them gets; a text is held whole by the task that reads it; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, kept_columns, small_batches, table, texts

LENGTH = 100
LEAD = 32
WINDOW = LENGTH - LEAD + 1  # sampled positions are at most WINDOW - 1 bytes into a window
BACK = WINDOW - 1
#: Different surroundings of the same leading bytes, in one task, from which on they are known to repeat.
MANY = 64
#: Suffixes that a bucket aims at, and the most partitions, which may hold several buckets each.
BUCKET, MAX_PARTITIONS = 50_000, 10_000
#: The place of a row without doc_id: after all others.
LAST = (1 << 63) - 1
SEGMENT = 1 << 20
_BUFFER = 1_000_000

_rng = np.random.default_rng(20240229)
_BASE = int(_rng.integers(1 << 62)) * 2 + 1
_BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_power: tuple[np.ndarray, np.ndarray] | None = None


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    global _power
    if _power is None:
        n = SEGMENT + 4 * LENGTH
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _power = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _power


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, op, fill: int) -> np.ndarray:
    """op over each WINDOW consecutive values."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % WINDOW, fill, np.uint64)]).reshape(-1, WINDOW)
    ahead = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - WINDOW + 1
    return op(back[:m], ahead[BACK : BACK + m])


def sampled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a text, hash of their leading bytes, hash of their surroundings."""
    n, up, down = len(text), *_powers()
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, n - LENGTH + 1), SEGMENT):
        a, z = max(0, at - BACK), min(n, at + SEGMENT + 2 * LENGTH)  # what windows from at on need, and their surroundings
        b = text[a:z]
        c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=c[1:])
        stop = min(n - LENGTH + 1, at + SEGMENT) - 1 + WINDOW - a  # last leading bytes of a window that starts here
        h = _mix((c[at - a + LEAD : stop + LEAD] - c[at - a : stop]) * down[at - a : stop])
        low = _sliding(h, np.minimum, (1 << 64) - 1)
        edge = np.zeros(BACK, np.uint64)
        p = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), np.maximum, 0) == h)
        own = p + at - a
        left, right = np.minimum(own + a, BACK), np.minimum(n - a - own, LENGTH)
        around = (c[own + right] - c[own - left]) * down[own - left]
        found.append((p + at, h[p], _mix(_mix(around) + (left * 256 + right).astype(np.uint64) * _ODD)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(found) == 1:
        return found[0]
    p, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
    p, first = np.unique(p, return_index=True)
    return p, h[first], c[first]


def merged(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges; touching ranges are one run."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.r_[True, a[1:] > z[:-1]]
    return a[new], z[np.r_[np.flatnonzero(new)[1:] - 1, len(z) - 1]]


# Kinds of rows between steps 1 and 2, in the low bits of meta: (position << 10) | (right length << 2) | kind; ctx is the end of a range
_SUFFIX, _RANGE, _SKIP, _STAND_IN = range(4)
_ROWS = pa.schema([(n, pa.int64()) for n in ("key", "ctx", "doc", "sub", "meta")])
_ROWS_DDL = "key bigint, ctx bigint, doc bigint, sub bigint, meta bigint"


def _batch(schema: pa.Schema, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols], schema=schema)


def _ranks(*cols: np.ndarray) -> np.ndarray:
    """Rank of each row by the columns, the first one leading; equal rows share a rank."""
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    for c in cols:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, over doc, sub and text."""
    parts: list[tuple[np.ndarray, ...]] = []
    names: list[tuple[int, int]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        k, ctx, own, pos, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc, sub = np.array(names, np.int64).T
        parts.clear()
        names.clear()
        place = (_ranks(doc, sub)[own] << 31) | pos
        order = np.lexsort((place, ctx, k))
        k, ctx, own, pos, left, right, place = (x[order] for x in (k, ctx, own, pos, left, right, place))
        new_k = np.r_[True, k[1:] != k[:-1]]
        new_c = new_k | np.r_[True, ctx[1:] != ctx[:-1]]
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(k)), 0))
        later = ~new_c & (place != place[first]) & (left + right >= LENGTH)
        if later.any():
            by = np.argsort(own[later], kind="stable")
            d, a, z = own[later][by], (pos - left)[later][by], (pos + right)[later][by]
            cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            runs = [merged(a[i:j], z[i:j]) for i, j in zip(cuts, np.r_[cuts[1:], len(d)], strict=True)]
            dd = np.repeat(d[cuts], [len(x[0]) for x in runs])
            aa, zz = np.concatenate([x[0] for x in runs]), np.concatenate([x[1] for x in runs])
            yield _batch(_ROWS, _mix(_mix((doc[dd] ^ sub[dd]).astype(np.uint64)) + aa.astype(np.uint64)), zz, doc[dd], sub[dd], (aa << 10) | _RANGE)
        k, ctx, own, pos, right, new_k = (x[new_c] for x in (k, ctx, own, pos, right, new_k))
        group = np.cumsum(new_k) - 1
        many = np.bincount(group)[group] > MANY
        for which, kind in ((~many, _SUFFIX), (many, _SKIP), (many & new_k, _STAND_IN)):
            if which.any():
                d, p = own[which], pos[which]
                key = _mix(_mix((doc[d] ^ sub[d]).astype(np.uint64)) + p.astype(np.uint64)) if kind == _SKIP else k[which]
                yield _batch(_ROWS, key, ctx[which], doc[d], sub[d], (p << 10) | (right[which] << 2) | kind)

    for b in batches:
        for doc, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            pos, k, ctx = sampled(raw)
            if len(pos):
                parts.append((k, ctx, np.full(len(pos), len(names)), pos, np.minimum(pos, BACK), np.minimum(len(raw) - pos, LENGTH)))
                names.append((doc, sub))
                size += len(pos)
                if size >= _BUFFER:
                    yield from flush()
                    size = 0
    yield from flush()


_BYTES = pa.schema([("head", pa.int64()), ("text", pa.binary()), ("back", pa.binary()), ("doc", pa.int64()), ("sub", pa.int64()), ("pos", pa.int64())])
_BYTES_DDL = "head bigint, text binary, back binary, doc bigint, sub bigint, pos bigint"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, sub, text, wanted positions -> each wanted suffix and the bytes before it; head has the order of the first 8 bytes."""
    for b in batches:
        rows = []
        for doc, sub, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(int.from_bytes(raw[p : p + 8], "big") - (1 << 63), raw[p : p + LENGTH], raw[max(0, p - BACK) : p], doc, sub, p) for p in wanted]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BYTES, strict=True)], schema=_BYTES)


def _matrix(column: pa.Array, width: int, *, to_right: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of equal width, filled up with zeros, and their lengths."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    size = np.diff(at)
    out = np.zeros((n, width), np.uint8)
    place = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0] - (width - size if to_right else 0), size)
    out[np.repeat(np.arange(n), size), place] = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return out, size.astype(np.int64)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of characters by multikey quicksort.

    Each segment is split in three by its pivot's character; the middle part goes on with the
    next character, the others with the same one.  All open segments take a step at once.
    """
    n, width = words.shape
    order, start, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n) if n > 1 else np.arange(0)
    while len(open_):
        rows, own, d = order[open_], start[open_], depth[open_]
        c = words[rows, d]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[first, len(own)])
        three = np.sort(np.stack([c[first], c[first + size // 2], c[first + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        part = np.repeat(np.arange(len(first)) * 3, size) + 1 + (c > pivot) - (c < pivot)
        by = np.argsort(part, kind="stable")
        part = part[by]
        order[open_] = rows[by]
        new = np.r_[True, part[1:] != part[:-1]]
        at = np.flatnonzero(new)
        start[open_] = np.repeat(open_[at], np.diff(np.r_[at, len(part)]))
        d = d + (part % 3 == 1)
        depth[open_] = d
        open_ = open_[(np.repeat(np.diff(np.r_[at, len(part)]), np.diff(np.r_[at, len(part)])) > 1) & (d < width)]
    return order


def covered(text: np.ndarray, right: np.ndarray, back: np.ndarray, left: np.ndarray, doc: np.ndarray, sub: np.ndarray, pos: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What earlier windows of the bucket cover, as (doc, sub, start, end), and the windows to compare
    across its boundaries, as (doc, sub, start, hash, other hash)."""
    n = len(text)
    order = multikey_sort(text.view(">u8").astype(np.uint64))
    text, right, back, left, doc, sub, pos = (x[order] for x in (text, right, back, left, doc, sub, pos))
    head = text[:, :8].copy().view(">u8")[:, 0]
    edge = (head == head[0]) | (head == head[-1])
    differ = text[1:, :LENGTH] != text[:-1, :LENGTH]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    lcp = np.r_[0, np.minimum(lcp, np.minimum(right[1:], right[:-1]))]
    place = _ranks(doc, sub, pos)
    up, _ = _powers()
    c = np.zeros(n, np.uint64)  # a hash of the o bytes before
    cov = np.zeros((n, WINDOW), bool)
    edges = []
    for o in range(WINDOW):
        if o:
            c = c + _BYTE[back[:, BACK - o]] * up[o - 1]
        need = LENGTH - o
        joined = lcp >= need
        run = np.cumsum(~joined)
        some = np.flatnonzero((joined | np.r_[joined[1:], False] | edge) & (left >= o) & (right >= need))
        if not len(some):
            continue
        w = _mix(_mix(run[some].astype(np.uint64) * _ODD) + c[some])
        by = np.lexsort((place[some], w))
        w, s = w[by], some[by]
        new = np.r_[True, w[1:] != w[:-1]]
        first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
        cov[s[place[s] > place[first]], o] = True
        e = s[new & edge[s]]
        if len(e):
            windows = np.concatenate([back[e, BACK - o :], text[e, :need]], axis=1)
            h, g = ((t[windows] * up[:LENGTH]).sum(axis=1, dtype=np.uint64) for t in (_BYTE, _mix(_BYTE)))
            edges.append((doc[e], sub[e], pos[e] - o, _mix(h), _mix(g)))
    turns = np.diff(np.pad(cov, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, low = np.nonzero(turns == 1)
    _, high = np.nonzero(turns == -1)
    return (doc[i], sub[i], pos[i] - (high - 1), pos[i] - low + LENGTH), tuple(np.concatenate(x) for x in zip(*edges, strict=True))


_SPANS = pa.schema([(n, pa.int64()) for n in ("doc", "sub", "a", "z", "h", "g")])
_SPANS_DDL = "doc bigint, sub bigint, a bigint, z bigint, h bigint, g bigint"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, over suffixes in the order of head: covered ranges, and windows to compare across the boundaries (z = -1).

    A bucket ends where head changes, or anywhere if that would make it too large.
    """
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        cols = [c.chunk(0) for c in t.columns[1:]]
        found, edges = covered(*_matrix(cols[0], 104), *_matrix(cols[1], BACK, to_right=True), *(c.to_numpy() for c in cols[2:]))
        if len(found[0]):
            yield _batch(_SPANS, *found, np.zeros(len(found[0]), np.int64), np.zeros(len(found[0]), np.int64))
        if edges:
            yield _batch(_SPANS, *edges[:3], np.full(len(edges[0]), -1), *edges[3:])

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        head = b.column(0).to_numpy()
        new = np.flatnonzero(np.r_[bool(held) and held[-1].column(0)[-1].as_py() != head[0], head[1:] != head[:-1]])
        if size >= BUCKET and (len(new) or size >= 2 * BUCKET):
            at = int(new[0]) if len(new) else 0
            if at:
                held.append(b.slice(0, at))
            yield from flush()
            b, size = b.slice(at), 0
        held.append(b)
        size += b.num_rows
    if held:
        yield from flush()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: doc_id, text, ranges -> the contract's columns and the kept bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for b in batches:
        rows = []
        for doc, text, ranges in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            raw = kept = text.encode("utf-8", "surrogatepass")
            n = 0
            if ranges:
                a, z = merged(np.array([r["a"] for r in ranges]), np.array([r["z"] for r in ranges]))
                n = len(a)
                stops = np.r_[0, z].tolist()
                kept = b"".join(raw[i:j] for i, j in zip(stops, [*a.tolist(), len(raw)], strict=True))
            rows.append((doc, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that have been written: the cleaner drops what nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _step_1_2(src: DataFrame) -> DataFrame:
    """doc, sub, a, z: covered ranges, and suffixes that go on (z = -1)."""
    rows = src.select("doc", "sub", "text").mapInArrow(_sample, _ROWS_DDL).repartition("key")
    kind, place = F.col("meta").bitwiseAND(F.lit(3)), F.struct("doc", "sub", "meta")
    # one sort by key and ctx serves both windows
    met = rows.withColumn("first", F.min(place).over(W.partitionBy("key", "ctx")))
    alike = W.partitionBy("key")
    met = met.withColumn("several", (F.min("ctx").over(alike) < F.max("ctx").over(alike)) | F.max(kind == _STAND_IN).over(alike))
    pos, right = F.shiftright("meta", 10), F.shiftright("meta", 2).bitwiseAND(F.lit(255))
    left = F.least(pos, F.lit(BACK))
    later = (kind == _SUFFIX) & (place > F.col("first")) & (left + right >= LENGTH)
    met = met.where(later | kind.isin(_RANGE, _SKIP) | ((kind == _SUFFIX) & F.col("several")))
    z = F.when(kind == _RANGE, F.col("ctx")).when(later, pos + right).otherwise(F.lit(-1))
    return cut(met.select("doc", "sub", F.when(later, pos - left).otherwise(pos).alias("a"), z.alias("z")))


def _step_3(src: DataFrame, met: DataFrame) -> DataFrame:
    go = met.where("z = -1").select("doc", "sub", "a")
    partitions = min(max(1, -(-go.count() // BUCKET)), MAX_PARTITIONS)
    wanted = go.groupBy("doc", "sub").agg(F.collect_list("a").alias("wanted"))
    around = src.select("doc", "sub", "text").join(wanted, ["doc", "sub"]).select("doc", "sub", "text", "wanted").mapInArrow(_fetch, _BYTES_DDL)
    sorted_ = around.repartitionByRange(partitions, "head", "doc", "sub", "pos").sortWithinPartitions("head")
    found = cut(sorted_.mapInArrow(_buckets, _SPANS_DDL))
    edge, place = found.where("z = -1"), F.struct("doc", "sub", "a")
    first = edge.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = edge.join(first, ["h", "g"]).where(place > F.col("first")).select("doc", "sub", "a", (F.col("a") + LENGTH).alias("z"))
    return found.where("z >= 0").select("doc", "sub", "a", "z").unionByName(later)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay); one row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    src = kept_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    repeated = src.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    src = src.withColumn("sub", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))
    once = src.dropDuplicates(["doc", "sub"]) if repeated else src
    met = _step_1_2(src)
    _release(spark)
    spans = _step_3(once, met)
    _release(spark)
    ranges = met.where("z >= 0").unionByName(spans).groupBy("doc", "sub").agg(F.collect_list(F.struct("a", "z")).alias("ranges"))
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return src.join(ranges, ["doc", "sub"], "left").select("doc_id", "text", "ranges").mapInArrow(_cut_out, ddl)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Every window of LENGTH bytes by its digest; the texts are cut into parts, since a slice costs the length of what it is cut from.
OP2_SQL = f"""
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
k as (select doc_id, n, q, b[q * 512 + 1:q * 512 + {511 + LENGTH}] as s from (select *, unnest(range((n + 511) // 512)) as q from d)),
w as (select doc_id, q * 512 + p as p, md5(s[p + 1:p + {LENGTH}]) as s from (select *, unnest(range(greatest(least(512, n - {LENGTH - 1} - q * 512), 0))) as p from k)),
c as (select doc_id, p from (select *, min(doc_id * 2147483648 + p) over (partition by s) as f from w) where doc_id * 2147483648 + p > f),
r as (select *, sum(o) over (partition by doc_id order by p) as run from (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + {LENGTH} then 1 else 0 end as o from c)),
g as (select doc_id, min(p) as a, max(p) + {LENGTH} as z from r group by doc_id, run),
e as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as y from g),
m as (select e.doc_id, sum(z - a)::bigint as n_removed, count(*)::bigint as n_spans, max(z) as last, string_agg(hex(b[y + 1:a]), '' order by a) as kept from e join d using (doc_id) group by e.doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:n]))) as kept_sha256 from d left join m using (doc_id)
"""

QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES = {"op2_suffix_dedup": OP2_SQL}
