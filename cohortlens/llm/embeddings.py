"""Embedding near-duplicates with a forest of random-projection trees.

Each tree splits the unit vectors again and again by a random direction, near
the median of a bounded sample, and sends what lies close to a split to both
sides (spill).  Vectors of one label that share a leaf of any tree are compared
in double precision; a pair counts under the first leaf that it shares only, so
that links are counted once.  Union of the verified links gives the components.

Equal vectors of a label are one class from the start.  A leaf that holds more
than ``BLOCK`` classes is dealt to cells, one for each pair of its blocks, so
that a dense group is spread over tasks without losing a pair.  No pair leaves a
task: a cell returns counts and a spanning forest.

Only the splits come from a sample (about ``SAMPLE`` vectors, or ``ROOT`` times the
root of their number if that is more); every vector is indexed.  Each label and
length has splits of its own, down to ``LEAF`` vectors or to ``LEAST`` of the
sample, whichever comes first: where the sample ends a leaf stays whole and goes
to cells, so that every split has its spill.  Recall is measured against brute force in the tests.

Defined cases: a label or vector that is null, a vector that is empty, zero or
holds null or non-finite components links with nothing (n_links 0, its own
component); vectors of different lengths don't link; equal vectors of a label
(repeated rows) link with each other; a cosine of exactly the threshold links;
a row without vec_id links with nothing; rows that repeat a vec_id are vectors of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept_columns, small_batches, table
from .graph import components

THRESHOLD = 0.93
TREES = 4
LEAF = 256
SPILL = 0.14
SAMPLE = 20_000
ROOT = 32
LEAST = 8
BLOCK = 512
SEED = 11


class Forest:
    """Directions by vector length and split bounds by label and length; a leaf is the number of a node without bounds.

    share is that of the sample among all vectors.
    """

    def __init__(self, share: float, sample: list[tuple[object, np.ndarray]], trees: int = TREES):
        self.trees = trees
        self.bounds: dict[tuple[object, int, int, int], tuple[float, float]] = {}
        groups: dict[tuple[object, int], list[np.ndarray]] = {}
        for label, v in sample:
            groups.setdefault((label, len(v)), []).append(v)
        for (label, size), vectors in groups.items():
            x = np.array(vectors)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for t in range(trees):
                todo = [(0, np.arange(len(x)))]
                while todo:
                    node, own = todo.pop()
                    if len(own) < LEAST or len(own) <= LEAF * share or node >= 1 << 40:
                        continue
                    p = x[own] @ self.direction(size, t, node)
                    low, mid, high = np.quantile(p, [0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2]).tolist()
                    left, right = own[p <= mid], own[p > mid]
                    if len(left) and len(right):
                        self.bounds[label, size, t, node] = low, high
                        todo += [(2 * node + 1, left), (2 * node + 2, right)]

    @staticmethod
    def direction(size: int, tree: int, node: int) -> np.ndarray:
        return np.random.default_rng([SEED, size, tree, node]).standard_normal(size)

    def leaves(self, label: object, x: np.ndarray) -> list[list[int]]:
        """For each unit vector of a label the codes (tree and leaf) of all leaves that hold it, ascending."""
        size = x.shape[1]
        out: list[list[int]] = [[] for _ in range(len(x))]
        for t in range(self.trees):
            rows, found = {0: np.arange(len(x))}, {}
            while rows:
                below = {}
                for node, own in rows.items():
                    if (bounds := self.bounds.get((label, size, t, node))) is None:
                        found[node] = own
                        continue
                    p = x[own] @ self.direction(size, t, node)
                    low, high = bounds
                    for child, part in ((2 * node + 1, own[p <= high]), (2 * node + 2, own[p >= low])):
                        if len(part):
                            below[child] = part
                rows = below
            for node in sorted(found):
                for i in found[node].tolist():
                    out[i].append((t << 42) + node)
        return out


def _doubles(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in column]


def _leaf_rows(forest: Forest, batch: pa.RecordBatch) -> list[list[int]]:
    """Codes for the vectors in the last column of a batch, whose first column is the label."""
    vectors, codes = _doubles(batch.column(batch.num_columns - 1)), [None] * batch.num_rows
    groups: dict[tuple[object, int], list[int]] = {}
    for i, (label, v) in enumerate(zip(batch.column(0).to_pylist(), vectors, strict=True)):
        groups.setdefault((label, len(v)), []).append(i)
    for (label, _), members in groups.items():
        x = np.array([vectors[i] for i in members])
        for i, c in zip(members, forest.leaves(label, x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True):
            codes[i] = c
    return codes


def _compare(code: int, side: np.ndarray, ids: np.ndarray, copies: np.ndarray, codes: list[list[int]], x: np.ndarray):
    """Links of one cell: (id, smallest linked id reachable inside the cell, links counted here) for each row with any."""
    n = len(ids)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    place: dict[int, int] = {}
    cells = [(i, place.setdefault(c, len(place))) for i, own in enumerate(codes) for c in own if c < code]
    shared = np.zeros((n, len(place)), dtype=np.float32)
    if cells:
        shared[tuple(np.array(cells).T)] = 1
    count, label = np.zeros(n, np.int64), ids.copy()
    step = max(1, (1 << 21) // n)
    cross = len(np.unique(side)) > 1
    links = []
    for at in range(0, n, step):
        z = slice(at, at + step)
        hit = (x[z] @ x.T) / (norms[z, None] * norms[None, :]) >= THRESHOLD
        hit &= shared[z] @ shared.T == 0
        hit &= side[z, None] != side[None, :] if cross else ids[z, None] != ids[None, :]
        count[z] = hit @ copies
        i, j = np.nonzero(hit)
        links.append((i + at, j))
    i, j = np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(count)
    return ids[some], label[some], count[some]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept; one row for each row of vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    src = kept_columns(vectors, id_col, vector_col, label_col).toDF("vec_id", "v", "label")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    src = src.withColumn("ok", F.coalesce(ok, F.lit(False)))
    classes = src.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    total = classes.count()
    share = min(1.0, max(SAMPLE, ROOT * math.sqrt(total)) / max(1, total))
    sample = classes.where(F.shiftrightunsigned(F.xxhash64("rep", F.lit(SEED)), 11) / F.lit(float(1 << 53)) < share).select("label", "v").toArrow()
    drawn = list(zip(sample["label"].to_pylist(), _doubles(sample["v"].combine_chunks()), strict=True)) if sample.num_rows else []
    forest = spark.sparkContext.broadcast(Forest(share, drawn))
    label_type = classes.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_leaf_rows(forest.value, b), pa.list_(pa.int64()))], names=["label", "cid", "copies", "v", "codes"])

    v_type = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("label", "cid", "copies", "v").mapInArrow(assign, f"label {label_type}, cid bigint, copies bigint, v {v_type}, codes array<bigint>")
    rows = dealt.select("label", "cid", "copies", "v", "codes", F.explode("codes").alias("code"))
    full = rows.groupBy("label", "code").count().where(F.col("count") > BLOCK)
    full = cut(full.select("label", "code", F.ceil(F.col("count") / F.lit(float(BLOCK))).cast("int").alias("blocks")))
    if full.limit(1).count():
        rows = rows.join(full, ["label", "code"], "left")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("cid", F.lit(SEED)), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own).alias("a"), F.greatest(j, own).alias("b"), own.alias("own")))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("own")))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("blocks") > 1, cells).otherwise(one)))
    key = F.struct("label", F.size("v").alias("n"), "code", F.col("cell.a").alias("a"), F.col("cell.b").alias("b"))
    rows = rows.select(F.to_json(key).alias("key"), "code", F.col("cell.own").alias("side"), "cid", "copies", "codes", "v")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            if len(held) > 1:
                _, code, side, ids, copies, codes, v = zip(*held, strict=True)
                u, r, n = _compare(code[0], np.array(side), np.array(ids), np.array(copies), list(codes), np.array(v, dtype=np.float64))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(r), pa.array(n)], schema=schema)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from flush()
                held.append(row)
        yield from flush()

    found = cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "u bigint, v bigint, n bigint"))
    counts = found.groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
    roots = cut(components(found.where("u <> v").select("u", "v")).select(F.col("node").alias("cid"), "root"))
    least = roots.join(classes.select("cid", "rep"), "cid").groupBy("root").agg(F.min("rep").alias("least"))
    by_class = (
        classes.join(counts, "cid", "left")
        .join(roots.join(least, "root"), "cid", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    )
    linked = src.where("ok").join(by_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = src.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_duplicates": op6_embedding_duplicates}
#: Brute force over all pairs of a label, and links followed to the end: for small tables.
OP6_SQL = f"""
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where vec_id is not null and label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0),
e as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= {THRESHOLD:e}),
r(i, j) as (select i, j from e union select r.i, e.j from r join e on e.i = r.j),
m as (select i, least(i, min(j)) as c from r group by i), n as (select i, count(*) as n from e group by i)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join m on m.i = vec_id left join n on n.i = vec_id
"""
ORACLES = {"op6_embedding_duplicates": OP6_SQL}
