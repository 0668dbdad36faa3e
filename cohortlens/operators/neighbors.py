"""Exact nearest neighbours by blocks, and what is built on them: outliers, near duplicates, data value, order effects.

The rows that ask are dealt to groups, one a task; all rows come by each group in blocks, and a
numpy matrix product of a block keeps the k nearest so far.  Memory is bounded by the rows of a group and a block; what
is shuffled is the rows once a group; the work is that of all pairs, which exact search needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import once, shared_folder, ship_package
from . import confident

BLOCK = 1024
#: Asking rows that are compared with a block at once: the similarities stay in the processor's cache.
TILE = 512
#: Groups that the rows of an exact search are dealt to, and the rows of one at most.
GROUPS, GROUP_ROWS = 32, 65_536
#: Rows that the splits of approximate_edges are fitted on.
SPLIT_ROWS = 20_000
EDGES = "i bigint, rank int, j bigint, d double"
TINY = 100 * 2.220446049250313e-16

#: A metric: a name, ("minkowski", p), or a function from two matrices (rows are vectors) to their matrix of distances.
Metric = str | tuple[str, float] | Callable[[np.ndarray, np.ndarray], np.ndarray]


def default_metric(dims: int) -> str:
    return "cosine" if dims > 3 else "euclidean"


def _distances(a: np.ndarray, b: np.ndarray, metric: Metric) -> np.ndarray:
    if callable(metric):
        return np.asarray(metric(a, b), dtype=np.float64)
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return 1 - (a @ b.T) / np.maximum(na[:, None] * nb[None, :], 1e-300)
    if metric == "euclidean":
        return np.stack([np.sqrt(((b - x) ** 2).sum(axis=1)) for x in a])
    if isinstance(metric, tuple) and metric[0] == "minkowski":
        return np.stack([(np.abs(b - x) ** metric[1]).sum(axis=1) ** (1 / metric[1]) for x in a])
    raise ValueError(f"unknown metric {metric!r}")


def _vectors(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one packed block."""
    values = rows.values
    ids, lists = values.field(0).to_numpy(), values.field(1)
    return ids, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each row, by distance and then id."""
    if k < d.shape[1]:  # all that may be among them: up to the k-th distance, with its ties
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        width = int((d <= limit).sum(axis=1).max())
        some = np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
    else:
        some = np.tile(np.arange(d.shape[1]), (len(d), 1))
    order = np.lexsort((ids[some], np.take_along_axis(d, some, axis=1)), axis=1)[:, :k]
    return np.take_along_axis(some, order, axis=1)


def knn_edges(df: DataFrame, k: int = 10, metric: Metric | None = None, base: DataFrame | None = None) -> DataFrame:
    """(i, rank, j, d) of the k nearest other rows of each row of df(id, features); equal rows have distance 0; ties by id.

    With base, of the k nearest rows of that table instead (all of them, whatever their ids).
    Rows without features, or with a null or non-finite one, take no part.  The rows that ask are
    dealt to GROUPS tasks (more beyond GROUP_ROWS rows each), and all rows pass each task once, so
    what is shuffled grows with the rows.  The table is written once to the shared folder.
    """
    spark = df.sparkSession
    ship_package(spark)

    def sound(t: DataFrame) -> DataFrame:
        t = t.select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features"))
        return t.where(F.col("id").isNotNull() & F.col("features").isNotNull() & F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))

    df = sound(df)
    n, dims = df.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    m = n
    alone = base is None
    if not alone:
        base = sound(base)
        m, dims = base.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if not n or not m:
        return spark.createDataFrame([], EDGES)
    metric = metric or default_metric(dims)
    groups = max(min(GROUPS, math.ceil(n / BLOCK)), math.ceil(n / GROUP_ROWS))

    def packed(asks: bool, answers: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    t = b.slice(at, BLOCK)
                    ids, g, x = t.column(0).to_numpy(), t.column(1).to_numpy(), _matrix(t.column(2))
                    parts = [([int(z)], 0, np.flatnonzero(g == z)) for z in np.unique(g)] if asks else []
                    parts += [(list(range(groups)), 1, np.arange(len(ids)))] if answers else []
                    for to, tag, own in parts:
                        with np.errstate(over="ignore"):
                            small = x[own].astype(np.float32)
                        values = small if (small == x[own]).all() else x[own]
                        one = [[to], [tag], [int(ids[own].min())], [values.itemsize], [ids[own].tobytes()], [values.tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, PACK, strict=True)], schema=PACK)

        return pack

    kind = "g array<int>, tag int, first bigint, width int, ids binary, features binary"
    asking = df.select("id", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), "features")
    packs = asking.mapInArrow(packed(True, alone), kind)
    if not alone:
        packs = packs.unionByName(base.select("id", F.lit(0).alias("g"), "features").mapInArrow(packed(False, True), kind))
    packs = packs.select(F.explode("g").alias("g"), "tag", "first", "width", "ids", "features")
    packs = packs.repartitionById(groups, "g").sortWithinPartitions("tag", "first").select("tag", "width", "ids", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, asks, answers, held = None, [], [], 0
        for b in batches:
            for tag, width, ids, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(values, np.float32 if width == 4 else np.float64).reshape(len(ids), -1)
                if tag == 0:
                    asks.append((ids, x))
                    continue
                if not asks:
                    continue
                search = search or _Search(asks, k, metric, alone)
                answers.append((ids, x))
                held += len(ids)
                if held >= 2 * BLOCK:
                    search.see(answers)
                    answers, held = [], 0
        if answers:
            search.see(answers)
        if search is not None:
            yield from search.found()

    return once(packs.mapInArrow(run, EDGES))


PACK = pa.schema([("g", pa.list_(pa.int32())), ("tag", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("features", pa.binary())])


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of length 1 (zero rows stay), also where squares would leave the range of a double; and the two numbers each was divided by."""
    x = x.astype(np.float64)
    most = np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 5e-324)
    x /= most
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    x /= length
    return x, most, length


class _Search:
    """The k nearest of some rows among all rows, which come by in parts.

    Cosine distances are first taken in single precision, with room for its error; those that may be
    among the k are taken again in double precision, row by row, so equal rows get equal distances.
    The first are taken TILE rows at a time into one piece of memory: the square of the rows is paid in a matrix
    product and a comparison.
    """

    def __init__(self, asks: list[tuple[np.ndarray, np.ndarray]], k: int, metric: Metric, alone: bool):
        self.ids, self.x = np.concatenate([i for i, _ in asks]), np.concatenate([x for _, x in asks])
        self.k, self.metric, self.alone = k, metric, alone
        self.cosine = isinstance(metric, str) and metric == "cosine"
        self.room = (self.x.shape[1] + 8) * 1.2e-7 if self.cosine else 0.0
        if self.cosine:
            unit, self.most, self.length = _unit_rows(self.x)
            self.unit = unit.astype(np.float32)
        self.near = np.empty(0, np.float32)
        self.d = np.full((len(self.ids), k), np.inf)
        self.j = np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def see(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        ids, x = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
        if self.cosine:
            whole = _unit_rows(x)[0]
            unit = whole.astype(np.float32).T
            if self.near.size < TILE * len(ids):
                self.near = np.empty(TILE * len(ids), np.float32)
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(self.ids), TILE):
            z = slice(at, at + TILE)
            if self.cosine:
                near = self.near[: len(self.ids[z]) * len(ids)].reshape(-1, len(ids))
                np.matmul(self.unit[z], unit, out=near)
            else:
                near = -_distances(self.x[z].astype(np.float64), x.astype(np.float64), self.metric)
            if self.alone:
                low, high = np.searchsorted(ids[order], self.ids[z], "left"), np.searchsorted(ids[order], self.ids[z], "right")
                for r in np.flatnonzero(high > low):
                    near[r, order[low[r] : high[r]]] = -np.inf
            worst = self.d[z, -1]
            limit = (1 - worst if self.cosine else -worst) - self.room
            limit[(worst == 0) & (self.j[z, -1] < ids[order[0]])] = np.inf  # k copies of smaller ids
            new = np.flatnonzero(np.isinf(worst))
            if len(new) and self.k < near.shape[1]:
                limit[new] = np.partition(near[new], -self.k, axis=1)[:, -self.k] - 2 * self.room
            hits = np.flatnonzero(near >= limit[:, None].astype(near.dtype))  # many times as fast as the places in two dimensions
            for start in range(0, len(hits), 1 << 16):
                part = hits[start : start + (1 << 16)]
                i, c = np.divmod(part, len(ids))
                rough = near.ravel()[part]
                d = self._cosine(at + i, whole, c) if self.cosine else -rough
                d[np.isneginf(rough)] = np.inf
                close = np.flatnonzero(d <= 1e-9)
                d[close[(self.x[at + i[close]] == x[c[close]]).all(axis=1)]] = 0
                self._take(at + i, ids[c], d)

    def _cosine(self, i: np.ndarray, whole: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distances of pairs in double precision; the asking rows are brought to length 1 as in _unit_rows, which keeps them narrow until then."""
        a = self.x[i].astype(np.float64)
        a /= self.most[i]
        a /= self.length[i]
        a *= whole[c]
        return 1 - a.sum(axis=1)

    def _take(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        fine = np.isfinite(d)
        i, j, d = i[fine], j[fine], d[fine]
        rows = np.unique(i)
        i, j, d = np.concatenate([i, np.repeat(rows, self.k)]), np.concatenate([j, self.j[rows].ravel()]), np.concatenate([d, self.d[rows].ravel()])
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        first = rank < self.k
        self.j[i[first], rank[first]], self.d[i[first], rank[first]] = j[first], d[first]

    def found(self) -> Iterator[pa.RecordBatch]:
        """Rows of one id share one list."""
        i, j, d = np.repeat(self.ids, self.k), self.j.ravel(), self.d.ravel()
        fine = np.isfinite(d)
        i, j, d = i[fine], j[fine], d[fine]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        fine = rank <= self.k
        i, j, d, rank = i[fine], j[fine], d[fine], rank[fine].astype(np.int32)
        for at in range(0, len(i), 10_000):
            z = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(i[z]), pa.array(rank[z]), pa.array(j[z]), pa.array(d[z])], names=["i", "rank", "j", "d"])


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(i, rank, j, d): the first k of pairs(i, j, d) for each i, by distance and then j."""
    w = W.partitionBy("i").orderBy("d", "j")
    return pairs.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("i", "rank", "j", "d")


def approximate_edges(df: DataFrame, k: int = 10, metric: Metric | None = None, trees: int = 8, leaf: int = 1024, seed: int = 7) -> DataFrame:
    """(i, rank, j, d) like knn_edges, from the rows that share a leaf with a row in some of several random-projection trees.

    Splits are at medians of a sample of SPLIT_ROWS rows; every row is in one leaf of each tree, so
    the work grows with the rows times trees times leaf.  A leaf that holds more than twice its size
    (many equal rows, or beyond the sample's reach) is dealt to parts by a hash of the id.  Tables of
    up to a leaf are searched exactly.
    """
    spark = df.sparkSession
    df = df.select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features")).where("id is not null and features is not null")
    n, dims = df.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if not n or n <= leaf:
        return knn_edges(df, k, metric)
    metric = metric or default_metric(dims)
    ship_package(spark)
    shared_folder(spark)
    sample = df.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53)) < min(1.0, SPLIT_ROWS / n)).select("features").limit(2 * SPLIT_ROWS).toArrow()
    x = _unit(np.array(sample["features"].to_pylist(), dtype=np.float64).reshape(sample.num_rows, -1), metric)
    depth, bounds = math.ceil(math.log2(n / leaf)), {}

    def direction(tree: int, node: int) -> np.ndarray:
        return np.random.default_rng([seed, tree, node]).standard_normal(dims)

    for tree in range(trees):
        at = np.ones(len(x), np.int64)
        for _ in range(depth):
            for node in np.unique(at).tolist():
                own = np.flatnonzero(at == node)
                if len(own) > 1:
                    p = x[own] @ direction(tree, node)
                    bounds[tree, node] = float(np.median(p))
                    at[own] = 2 * node + (p > bounds[tree, node])
    sent = spark.sparkContext.broadcast(bounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            unit = _unit(v, metric)
            for tree in range(trees):
                at, todo, done = np.ones(len(ids), np.int64), [(1, np.arange(len(ids)))], sent.value
                while todo:
                    node, own = todo.pop()
                    at[own] = node
                    if len(own) and (tree, node) in done:
                        right = unit[own] @ direction(tree, node) > done[tree, node]
                        todo += [(2 * node, own[~right]), (2 * node + 1, own[right])]
                yield pa.RecordBatch.from_arrays([pa.array(at * trees + tree), pa.array(ids), b.column(1)], names=["key", "id", "features"])

    rows = df.mapInArrow(assign, "key bigint, id bigint, features array<double>")
    parts = F.ceil(F.col("count") / F.lit(float(2 * leaf)))
    rows = rows.join(rows.groupBy("key").count().select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")))
    groups = rows.groupBy("key", "part").agg(F.collect_list(F.struct("id", "features")).alias("rows")).select("rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.column(0):
                ids, v = _vectors(g)
                for at in range(0, len(ids), BLOCK):
                    z = slice(at, at + BLOCK)
                    d = _distances(v[z], v, metric)
                    i, j = np.nonzero(d <= 1e-9)
                    same = (v[z][i] == v[j]).all(axis=1)
                    d[i[same], j[same]] = 0
                    d[ids[z, None] == ids[None, :]] = np.inf
                    top = _nearest(d, ids, min(k, len(ids)))
                    dist = np.take_along_axis(d, top, axis=1)
                    fine = np.isfinite(dist)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[z], top.shape[1])[fine.ravel()]), pa.array(ids[top][fine]), pa.array(dist[fine])], names=["i", "j", "d"])

    found = groups.mapInArrow(compare, "i bigint, j bigint, d double").groupBy("i", "j").agg(F.min("d").alias("d"))
    return ranked(found, k)


def _unit(v: np.ndarray, metric: Metric) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if metric == "cosine" else v


def edges_of_index(found: DataFrame) -> DataFrame:
    """(i, rank, j, d) from an index's answers (id, neighbors, distances), arrays from the nearest on."""
    x = found.select(F.col("id").cast("bigint").alias("i"), F.posexplode(F.arrays_zip(F.col("neighbors").alias("j"), F.col("distances").alias("d"))).alias("r", "x"))
    return x.select("i", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.j").cast("bigint").alias("j"), F.col("x.d").cast("double").alias("d"))


def equal_rows(df: DataFrame) -> DataFrame:
    """(id, first, n) of rows whose features another row shares: the smallest id among them, and how many there are."""
    groups = df.groupBy("features").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.select("id", "features").join(groups, "features").select("id", "first", "n")


def corrected(edges: DataFrame, df: DataFrame, k: int | None = None) -> DataFrame:
    """A neighbour table in which rows with equal features come first, at distance 0, and each row has k neighbours.

    Approximate tables may miss copies or put them behind others.  A row takes at most k copies,
    the smallest ids, so a large group of copies costs its members times k.
    """
    k = k or edges.agg(F.max("rank")).first()[0] or 1
    own = equal_rows(df)
    few = own.withColumn("r", F.row_number().over(W.partitionBy("first").orderBy("id"))).where(F.col("r") <= k + 1).select("first", F.col("id").alias("j"))
    copies = own.join(few, "first").where(F.col("id") != F.col("j")).select(F.col("id").alias("i"), "j", F.lit(0.0).alias("d"))
    both = edges.select("i", "j", "d").unionByName(copies).groupBy("i", "j").agg(F.min("d").alias("d"))
    return ranked(both, k)


def distance_scale(avg: DataFrame, column: str = "avg_distance") -> float:
    """The median mean distance, never 0."""
    return max(avg.agg(F.median(column)).first()[0] or 0.0, TINY)


def distance_scores(avg: Column, scale: float, t: float = 1.0, metric: Metric | None = None) -> Column:
    """exp(-t d / scale); distances that are rounding errors of a metric score 1."""
    score = F.exp(avg * F.lit(-t / max(scale, 1e-6)))
    error = {"cosine": 100 * 1.1102230246251565e-16, "euclidean": math.sqrt(TINY)}.get(metric) if isinstance(metric, str) else TINY ** (1 / metric[1]) if isinstance(metric, tuple) else None
    return score if error is None else F.when(avg < error, 1.0).otherwise(score)


def mean_distances(edges: DataFrame, k: int | None = None) -> DataFrame:
    """(id, avg_distance) over the first k neighbours, or all stored ones."""
    some = edges if k is None else edges.where(F.col("rank") <= k)
    return some.groupBy(F.col("i").alias("id")).agg(F.avg("d").alias("avg_distance"))


def outliers(edges: DataFrame, threshold: float = 0.37037, t: float = 1.0, metric: Metric | None = None) -> DataFrame:
    """(id, avg_distance, score, is_outlier_issue) by the mean distance to all stored neighbours."""
    avg = once(mean_distances(once(edges)))
    q1, q2, q3 = avg.agg(F.percentile("avg_distance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or (0.0, 0.0, 0.0)
    limit = q3 + (1 / threshold - 1) * (q3 - q1)
    return avg.withColumn("score", distance_scores(F.col("avg_distance"), max(q2, TINY), t, metric)).withColumn("is_outlier_issue", F.col("avg_distance") > F.lit(limit))


class OutlierDetector:
    """Scores of rows by their distance to the rows of a fitted table, or by the doubt of their class probabilities.

    Fitted on features, it keeps the table (written to the shared folder) and the median of its mean
    distances; fitted on pred_probs, the thresholds of the classes if it is to adjust for them.
    """

    def __init__(self, k: int = 10, t: float = 1.0, metric: Metric | None = None, method: str = "entropy", adjust: bool = True):
        self.k, self.t, self.metric, self.method, self.adjust = k, t, metric, method, adjust
        self.table: DataFrame | None = None
        self.scale: float | None = None
        self.limits: list[float] | None = None
        self.kind: str | None = None

    def fit(self, df: DataFrame) -> OutlierDetector:
        self.fit_score(df)
        return self

    def fit_score(self, df: DataFrame) -> DataFrame:
        """(id, score) of the rows of df(id, features) or df(id, pred_probs and, to adjust, label), which become the fitted ones."""
        if self.kind:
            return self.score(df)
        if "features" in df.columns:
            shared_folder(df.sparkSession)
            table = df.select("id", "features").checkpoint()
            self.metric = self.metric or default_metric(table.agg(F.max(F.size("features"))).first()[0] or 0)
            avg = once(mean_distances(knn_edges(table, self.k, self.metric)))
            self.scale, self.table, self.kind = distance_scale(avg), table, "features"
            return avg.select("id", distance_scores(F.col("avg_distance"), self.scale, self.t, self.metric).alias("score"))
        self.limits, self.kind = (confident.thresholds(df) if self.adjust else None), "pred_probs"
        return self.score(df)

    def score(self, df: DataFrame) -> DataFrame:
        """(id, score) of other rows."""
        if self.kind is None:
            raise ValueError("the detector isn't fitted")
        if self.kind == "features":
            avg = mean_distances(knn_edges(df, self.k, self.metric, self.table))
            return avg.select("id", distance_scores(F.col("avg_distance"), self.scale, self.t, self.metric).alias("score"))
        return confident.ood_from_probs(df, self.method, self.adjust, self.limits)


def near_duplicates(edges: DataFrame, threshold: float = 0.13) -> DataFrame:
    """(id, nn_distance, score, is_near_duplicate_issue); sets are symmetric."""
    edges = once(edges)
    close, median = _close(edges, threshold)
    nn = edges.where("rank = 1").select(F.col("i").alias("id"), F.col("d").alias("nn_distance"))
    members = close.select(F.col("i").alias("id")).unionByName(close.select(F.col("j").alias("id"))).distinct().withColumn("hit", F.lit(True))
    score = F.when(F.col("nn_distance") < 1e-12, 0.0).otherwise(1 - F.exp(-F.col("nn_distance") / F.lit(max(median, 1e-6))))
    return nn.join(members, "id", "left").select("id", "nn_distance", score.alias("score"), F.coalesce("hit", F.lit(False)).alias("is_near_duplicate_issue"))


def _close(edges: DataFrame, threshold: float) -> tuple[DataFrame, float]:
    median = edges.where("rank = 1").agg(F.median("d")).first()[0] or 0.0
    return edges.where(F.col("d") < F.lit(threshold * max(median, 1e-6))).select("i", "j"), median


def near_duplicate_sets(edges: DataFrame, threshold: float = 0.13) -> DataFrame:
    """(id, near_duplicate_set): the ids of a row's near duplicates in ascending order, for every row that has some.

    A set holds at most the neighbours of the row and the rows that have it as theirs.
    """
    close, _ = _close(once(edges), threshold)
    both = close.unionByName(close.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    return both.groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list("j")).alias("near_duplicate_set"))


def data_value(edges: DataFrame, labels: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(id, score, is_data_valuation_issue): kNN-Shapley value of each row of labels(id, label) for its neighbours' labels."""
    q = labels.select(F.col("id").alias("i"), F.col("label").alias("li"))
    r = labels.select(F.col("id").alias("j"), F.col("label").alias("lj"))
    e = edges.where(F.col("rank") <= k).join(q, "i").join(r, "j").withColumn("m", (F.col("li") == F.col("lj")).cast("int"))
    last = e.groupBy("i").agg(F.max_by("m", "rank").alias("mk"))
    n = labels.count()
    got = e.join(last, "i").groupBy("j").agg((F.sum(F.col("m") - F.col("mk")) / F.lit(float(k * n))).alias("v"))
    out = labels.select("id").join(got.withColumnRenamed("j", "id"), "id", "left")
    score = 0.5 * (F.coalesce("v", F.lit(0.0)) + 1)
    return out.select("id", score.alias("score"), (score < threshold).alias("is_data_valuation_issue"))


def vote_probs(edges: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """(id, pred_probs): share of each label among the neighbours."""
    r = labels.select(F.col("id").alias("j"), "label")
    votes = edges.join(r, "j").groupBy(F.col("i").alias("id")).agg(
        F.array(*[F.avg((F.col("label") == c).cast("double")) for c in range(n_classes)]).alias("pred_probs")
    )
    return votes


def order_effect(edges: DataFrame, n: int, buckets: int = 1000) -> DataFrame:
    """One row (ks): largest gap between the distribution of index distances to neighbours and that of random pairs.

    Ids are the positions 0 .. n - 1.  Running totals are taken inside buckets of
    distances and shifted by the totals of the buckets before, of which there is
    a fixed number.  Between distances that occur one side is constant and the
    other grows, so only these and the ones just before them can be extreme.
    """
    width = max(1, n // buckets)
    gap = F.abs(F.col("i") - F.col("j"))
    d = edges.groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor(F.col("gap") / width).cast("int"))
    sums = {r["b"]: r["s"] for r in d.groupBy("b").agg(F.sum("c").alias("s")).collect()}
    total, before, at = sum(sums.values()), [], 0
    for b in range(max(sums, default=0) + 1):
        before.append(at)
        at += sums.get(b, 0)
    start = F.element_at(F.array(*[F.lit(int(x)) for x in before]), F.col("b") + 1)
    run = d.withColumn("cum", F.sum("c").over(W.partitionBy("b").orderBy("gap")) + start)
    background = lambda g: (2.0 * n * g - g * (g + 1)) / F.lit(float(n) * (n - 1))
    here = F.abs(F.col("cum") / F.lit(float(max(total, 1))) - background(F.col("gap")))
    left = F.abs((F.col("cum") - F.col("c")) / F.lit(float(max(total, 1))) - background(F.col("gap") - 1))
    return run.agg(F.max(F.greatest(here, left)).alias("ks"))


def _permuted(c, r, n: int):
    """Where round r puts position c: a seeded hash, so that no permutation has to be held; round 0 leaves it."""
    return F.when(r == 0, c).otherwise(F.pmod(F.xxhash64(c.cast("bigint"), r), F.lit(n)))


def order_test(edges: DataFrame, n: int, rounds: int = 25, buckets: int = 1000) -> tuple[float, float]:
    """(ks, p-value) of the order effect: the gap between the distribution of index distances to
    neighbours and that of all pairs, against the same for `rounds` shuffles of the positions.

    The p-value is the tail of a Gaussian density over the gaps of the shuffles (Scott's width).
    Shuffled positions are drawn independently, so their background counts equal positions too.
    The driver gets one row a round; the running totals of the buckets stay in a table of at
    most rounds x buckets rows.
    """
    if n < 2:
        return 0.0, 1.0
    r = F.col("r")
    rows = edges.select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("r"))
    gap = F.abs(_permuted(F.col("i"), r, n) - _permuted(F.col("j"), r, n))
    d = rows.groupBy("r", gap.alias("gap")).agg(F.count(F.lit(1)).alias("c"))
    d = d.withColumn("b", F.floor(F.col("gap") / max(1, math.ceil(n / buckets))).cast("int"))
    before = d.groupBy("r", "b").agg(F.sum("c").alias("s"))
    before = before.select("r", "b", (F.sum("s").over(W.partitionBy("r").orderBy("b")) - F.col("s")).alias("start"), F.sum("s").over(W.partitionBy("r")).alias("m"))
    run = d.join(F.broadcast(before), ["r", "b"]).withColumn("cum", F.sum("c").over(W.partitionBy("r", "b").orderBy("gap")) + F.col("start"))
    g = F.col("gap").cast("double")
    exact = (2.0 * n * g - g * (g + 1)) / F.lit(float(n) * (n - 1))
    drawn = (n + 2.0 * n * g - g * (g + 1)) / F.lit(float(n) * n)
    at = F.when(r == 0, exact).otherwise(drawn)
    low, high = (F.col("cum") - F.col("c")) / F.col("m"), (F.col("cum") - 1) / F.col("m")
    ks = {x["r"]: x["ks"] for x in run.groupBy("r").agg(F.max(F.greatest(F.abs(low - at), F.abs(high - at))).alias("ks")).collect()}
    if not ks:
        return 0.0, 1.0
    own, null = ks[0], np.array([ks[x] for x in range(1, rounds + 1)])
    width = max(float(null.std(ddof=1)) * len(null) ** -0.2, 1e-12)
    return float(own), float(np.mean([0.5 * math.erfc((own - x) / width / math.sqrt(2)) for x in null]))


def order_scores(edges: DataFrame, n: int) -> DataFrame:
    """(id, score) of each row: near 1 if its neighbours lie at index distances as of random rows.

    The area between the step function of the row's neighbour distances and the distribution
    of its distances to all positions 0 .. n - 1, interval by interval.
    """
    i, last = F.col("id").cast("double"), float(n - 1)
    x = edges.groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.abs(F.col("i") - F.col("j")).cast("double"))).alias("x"))
    x = x.select("id", F.concat("x", F.array(F.lit(last))).alias("x"), F.least(i, last - i).alias("d"))
    d = F.col("d")

    def area(v):
        middle = d * d / last + (v + 3 * d) * (v - d) / (2 * last)
        end = d * d / last + 0.5 * (2 * d / last + 1) * (last - 2 * d) + v - (last - d)
        return F.when(v <= d, v * v / last).when(v <= last - d, middle).otherwise(end)

    at = lambda k: F.when(k == 0, F.lit(0.0)).otherwise(F.element_at("x", F.greatest(k, F.lit(1))))
    parts = F.transform("x", lambda v, k: F.abs(k / (F.size("x") - 1) * (v - at(k)) - (area(v) - area(at(k)))))
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    return x.select("id", (F.tanh(-total / F.greatest(i, float(n) - i)) + 1).alias("score"))


def density_clusters(edges: DataFrame, ids: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, cluster) by density over the neighbour table; -1 for rows outside all clusters.

    A core row has min_samples rows, itself included, within eps.  A cluster is named by the
    smallest core row that reaches its members along edges that leave core rows (the
    neighbour relation has a direction).  Labels pass along edges and then jump to the label
    of their label, so the rounds grow slowly with the length of a chain.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    close = edges.where(F.col("d") <= eps).select("i", "j")
    core = ids.select(F.col("id").alias("i")).join(close.groupBy("i").agg(F.count(F.lit(1)).alias("c")), "i", "left").where(F.coalesce("c", F.lit(0)) + 1 >= min_samples).select("i")
    links = close.join(core, "i").select("i", "j").checkpoint()
    label = core.select(F.col("i").alias("id"), F.col("i").alias("cluster")).unionByName(links.select(F.col("j").alias("id"), F.col("i").alias("cluster")))
    label = label.groupBy("id").agg(F.min("cluster").alias("cluster")).checkpoint()
    state = label.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
    while state is not None:
        sent = links.join(label.withColumnRenamed("id", "i"), "i").select(F.col("j").alias("id"), "cluster")
        up = label.select(F.col("id").alias("cluster"), F.col("cluster").alias("higher"))
        jumped = label.join(up, "cluster").select("id", F.col("higher").alias("cluster"))
        label = label.unionByName(sent).unionByName(jumped).groupBy("id").agg(F.min("cluster").alias("cluster")).checkpoint()
        now = label.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
        if now == state:
            break
        state = now
    return ids.select("id").join(label, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def label_issue_probs(edges: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """(id, label, pred_probs): the neighbours' votes as a model's out-of-sample probabilities."""
    return labels.select("id", "label").join(vote_probs(edges, labels, n_classes), "id")


def ood_scores(edges: DataFrame, k: int = 10, t: float = 1.0) -> DataFrame:
    """(id, score) by the mean distance to the first k neighbours, scaled by its median."""
    avg = once(mean_distances(edges, k))
    return avg.select("id", distance_scores(F.col("avg_distance"), distance_scale(avg), t).alias("score"))
