"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two of them link at 3 or fewer differing bits.  Cut
into two segments of 32 bits, one segment of a linked pair differs by at most
one bit, so the pair shares a segment variant with one bit wildcarded.  Every
distinct fingerprint is indexed under its 2 x 32 variants, rows with an equal
key meet, and the pairs among them are verified on all 64 bits.  A pair is
looked at under one key a segment only (the one whose wildcard is its differing
bit, or the first if the segments are equal), and a bucket gives a spanning
forest of its links, never all of its pairs.

Equal fingerprints are one class from the start (smallest doc_id).  A bucket
whose size can pass ``HOT`` is dealt to cells, one for each pair of blocks of
its rows: cells together see each pair, and none holds more than about two
blocks.

Defined cases: null text counts as empty, whose fingerprint is zero; repeated
rows and ties share a class; a null doc_id is never a smallest one, so a component
of such rows only has a null component_id; a text is held whole by the task that
reads it, its hashes in parts of 65,536; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept_columns, numbered, small_batches, table, texts
from .graph import components

MAX_BITS = 3
SEED = 42
HOT = 4096
#: Up to this many rows of a bucket are compared by shifts; more by blocks of a matrix.
_SHIFTS = 24
#: Rows that are compared at once; a key's rows stay together beyond it.
_ROWS = 10_000


def fingerprint(text: str) -> int:
    """The 64 majority bits over the 3-word shingles of a text, as a signed number."""
    words = text.encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64, count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t) for t in texts(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), fps], schema=schema)

    return kept_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _near(a: np.ndarray, b: np.ndarray, sp: int | np.ndarray) -> np.ndarray:
    """Whether fingerprints link and this key is the one that answers for the pair."""
    x = (a ^ b).view(np.uint64)
    seg = (x >> np.asarray(32 * (sp // 32), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    bit = np.asarray(sp % 32, dtype=np.uint64)
    own = (seg == (np.uint64(1) << bit)) | ((seg == 0) & (bit == 0))
    return own & (np.bitwise_count(x) <= MAX_BITS)


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node) of the components of a few index pairs."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(i, r) for i in list(up) if (r := root(i)) != i]


def _large_bucket(fp: np.ndarray, sp: int) -> list[tuple[int, int]]:
    """The same for a large bucket: smallest label among the linked, again and again, block by block."""
    n, label = len(fp), np.arange(len(fp))
    changed = True
    while changed:
        changed = False
        for at in range(0, n, 512):
            near = _near(fp[at : at + 512, None], fp[None, :], sp)
            least = np.minimum(np.where(near, label[None, :], n).min(axis=1), label[at : at + 512])
            if (least < label[at : at + 512]).any():
                changed = True
                label[at : at + 512] = least
    return [(i, int(r)) for i, r in enumerate(label) if r != i]


def _links(key: np.ndarray, sp: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links among rows sorted by key, as index pairs (node, smallest node)."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    out: list[tuple[int, int]] = []
    for s, z in zip(starts[sizes > _SHIFTS], sizes[sizes > _SHIFTS], strict=True):
        out += [(i + s, r + s) for i, r in _large_bucket(fp[s : s + z], int(sp[s]))]
    pick = np.repeat((sizes > 1) & (sizes <= _SHIFTS), sizes)
    idx = np.flatnonzero(pick)
    k, f, p = key[idx], fp[idx], sp[idx]
    pairs: list[tuple[int, int]] = []
    for d in range(1, _SHIFTS):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        hit = same[_near(f[same], f[same + d], p[same])]
        pairs += zip(idx[hit].tolist(), idx[hit + d].tolist(), strict=True)
    return out + _forest(pairs)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> verified links; the last key of a batch waits for the next one."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush(rows):
        if rows:
            key, sp, fp = (np.concatenate(c) for c in zip(*rows, strict=True))
            if found := _links(key, sp, fp):
                i, r = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[r])], schema=schema)

    for b in batches:
        cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(cols[0]):
            continue
        size += len(cols[0])
        cut_at = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if size >= _ROWS and (cut_at or held and held[-1][0][-1] != cols[0][0]):
            yield from flush([*held, tuple(c[:cut_at] for c in cols)])
            held, cols = [], tuple(c[cut_at:] for c in cols)
            size = len(cols[0])
        held.append(cols)
    yield from flush(held)


def _signatures(classes: DataFrame) -> DataFrame:
    """key, sp, fp: 64 rows a fingerprint; sp is 32 * segment + wildcard."""
    seg = F.when(F.col("sp") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    masked = F.col("seg").bitwiseAND(F.bitwise_not(F.col("bit")))
    return (
        classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sp"))
        .select("fp", "sp", seg.alias("seg"), F.expr("shiftleft(1L, sp % 32)").alias("bit"))
        .select(masked.bitwiseOR(F.shiftleft(F.col("sp").cast("bigint"), 32)).alias("key"), "sp", "fp")
    )


def links(classes: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect whatever links within MAX_BITS."""
    rows = _signatures(classes)
    spark = classes.sparkSession
    segs = classes.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))).alias("seg"))
    hot = cut(segs.groupBy("seg").count().where(F.col("count") > HOT // 2))
    if hot.limit(1).count():
        low, at = F.col("seg").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("seg", 32)
        keys = (
            hot.select(low.alias("seg"), at.alias("at"), "count", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
            .select(
                F.col("seg").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)"))).bitwiseOR(F.expr("shiftleft(cast(at * 32 + bit as bigint), 32)")).alias("key"), "count"
            )
            .groupBy("key")
            .agg(F.ceil((F.sum("count") + HOT // 2) / F.lit(float(HOT))).cast("int").alias("blocks"))
        )
        rows = rows.join(keys, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(j, own), F.greatest(j, own)))
        rows = rows.withColumn("key", F.explode(F.when(F.col("blocks") > 1, cells).otherwise(F.array("key")))).select("key", "sp", "fp")
        ordered = rows.repartition("key", "sp").sortWithinPartitions("key", "sp")
    else:
        ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_verify, "u bigint, v bigint")


def _grouped(fps: DataFrame, smallest: Column) -> DataFrame:
    """fp and component: the smallest value of its component, for every fingerprint of fps."""
    classes = fps.groupBy("fp").agg(F.min(smallest).alias("rep"))
    roots = components(cut(links(classes)))
    members = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = members.groupBy("root").agg(F.min("rep").alias("component"))
    return members.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included)."""
    fps = cut(fingerprints(docs))
    by_fp = _grouped(fps, F.col("doc_id")).withColumnRenamed("component", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, for each component: that of the smallest doc_id (null last, then by a hash of the text).

    Rows get numbers of their own first, so that one of equal rows stays.
    """
    rows, row = numbered(docs)
    src = kept_columns(rows, row, "doc_id", "text").toDF("row", "doc_id", "text")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("doc_id"), "h", "row")
    fps = cut(fingerprints(src.select(F.col("row").alias("doc_id"), "text")))
    keyed = fps.withColumnRenamed("doc_id", "row").join(src.select("row", "doc_id", F.xxhash64("text").alias("h")), "row")
    kept = _grouped(keyed, first).select(F.col("component.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
