"""Confident learning over a DataFrame (id, label, pred_probs): thresholds, joint, issue filters, scores, summaries.

A filter reads the rows three times at most: for the thresholds and counts of the
classes, for their joint, and for the flags.  Rows are never exploded by class
except for the few classes that have a quota, and the first rows of a quota are
found by counts of cells, so that no class is ordered in one task.  What reaches
the driver has one row a class or a pair of classes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cells

FLOOR, ABSENT, EPS = 2e-6, 2.0, 1e-6
#: Cells of equal width that scores are counted in to find where a quota ends; only the rows of that cell are ordered.
CELLS = 4096
_SCORES = {"self_confidence": A.own_prob, "normalized_margin": A.normalized_margin, "confidence_weighted_entropy": A.confidence_weighted_entropy}


def P() -> Column:  # noqa: N802
    return F.col("pred_probs")


def LABEL() -> Column:  # noqa: N802
    return F.col("label")


def validate(df: DataFrame) -> DataFrame:
    """Raise unless labels are classes of pred_probs, and probabilities lie in [0, 1]; one aggregate."""
    bad_p = F.exists(P(), lambda x: x.isNull() | F.isnan(x) | (x < -EPS) | (x > 1 + EPS))
    r = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(LABEL().isNull() | (LABEL() < 0) | (LABEL() >= F.size(P()))).alias("bad_label"),
        F.count_if(bad_p | P().isNull()).alias("bad_p"),
        F.count_distinct(F.size(P())).alias("sizes"),
        F.count_distinct(LABEL()).alias("classes"),
    ).first()
    if r.n and (r.bad_label or r.bad_p or r.sizes != 1 or r.classes < 2):
        raise ValueError(f"invalid labels or probabilities: {r.asDict()}")
    return df


def num_classes(df: DataFrame) -> int:
    return df.agg(F.max(F.size(P()))).first()[0] or 0


class Stats(NamedTuple):
    """Threshold (mean own-class probability; ABSENT for a class without rows) and number of rows of each class."""

    thresholds: list[float]
    counts: np.ndarray

    @property
    def n(self) -> int:
        return int(self.counts.sum())


def class_stats(df: DataFrame) -> Stats:
    """Thresholds and counts from one pass."""
    rows = df.groupBy("label").agg(F.avg(A.own_prob(P(), LABEL())).alias("t"), F.count(F.lit(1)).alias("n"), F.max(F.size(P())).alias("k")).collect()
    k = max((r["k"] for r in rows), default=0)
    t, n = [ABSENT] * k, np.zeros(k, np.int64)
    for r in rows:
        t[r["label"]], n[r["label"]] = max(r["t"], FLOOR), r["n"]
    return Stats(t, n)


def label_counts(df: DataFrame, k: int) -> np.ndarray:
    """Rows of each of k classes, 0 for a class without any."""
    out = np.zeros(k, np.int64)
    for r in df.groupBy("label").count().collect():
        out[r["label"]] = r["count"]
    return out


def thresholds(df: DataFrame) -> list[float]:
    return class_stats(df).thresholds


def confident_class(t: list[float]) -> Column:
    """The one class that reaches its threshold; of several the overall prediction; null if none does."""
    limits = F.array(*[F.lit(float(x)) for x in t])
    reached = F.zip_with(P(), limits, lambda p, x: p >= x - EPS)
    n = F.size(F.filter(reached, lambda x: x))
    return F.when(n == 1, (F.array_position(reached, True) - 1).cast("int")).when(n > 1, A.argmax(P()))


def confident_joint(df: DataFrame, t: list[float] | None = None, calibrate: bool = True, stats: Stats | None = None) -> np.ndarray:
    """[given, guess] counts; the diagonal is at least 1 before calibration."""
    stats = stats or class_stats(df)
    t = t or stats.thresholds
    m = np.zeros((len(t), len(t)), np.int64)
    # rows that reach no threshold come as one group a class: a filter on the guess would work it out again for each mention
    for r in df.groupBy("label", confident_class(t).alias("g")).count().collect():
        if r["g"] is not None:
            m[r["label"], r["g"]] = r["count"]
    np.fill_diagonal(m, np.maximum(np.diagonal(m), 1))
    return cells.calibrated(m, stats.counts) if calibrate else m


def estimate_joint(df: DataFrame, joint: np.ndarray | None = None) -> np.ndarray:
    joint = confident_joint(df) if joint is None else joint
    return joint / joint.sum()


def off_diagonal(df: DataFrame, t: list[float]) -> Column:
    """Whether a row is confident in another class than its label, and isn't predicted as labelled."""
    return F.coalesce(confident_class(t) != LABEL(), F.lit(False)) & ~A.near_given(P(), LABEL())


def num_label_issues(df: DataFrame, method: str = "off_diagonal", joint: np.ndarray | None = None, stats: Stats | None = None) -> int:
    if method == "off_diagonal":
        return df.agg(F.count_if(off_diagonal(df, (stats or class_stats(df)).thresholds))).first()[0]
    if method not in ("off_diagonal_calibrated", "off_diagonal_custom"):
        raise ValueError(f"unknown method {method!r}")
    if method == "off_diagonal_custom" and joint is None:
        raise ValueError("off_diagonal_custom needs a joint")
    stats = stats or class_stats(df)
    joint = confident_joint(df, stats=stats) if joint is None or method == "off_diagonal_calibrated" else joint
    return int(np.rint((1 - np.trace(joint / joint.sum())) * stats.n))


def first_of(df: DataFrame, keys: list[str], order: list[Column], cell: Column, quota: str) -> DataFrame:
    """Rows among the first `quota` (a column, the same for all rows of a key) of their keys by the order.

    cell is a number in [0, 1] that grows with the order.  Rows are counted by cells of it; the
    cells before the one where the quota ends are in as a whole, those after it are out, and
    only the rows of that one are ordered.
    """
    df = df.withColumn("__c", F.floor(F.least(F.greatest(cell, F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int"))
    counts = df.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__c", "__n", (F.sum("__n").over(W.partitionBy(*keys).orderBy("__c")) - F.col("__n")).alias("__b"))
    near = df.join(before, [*keys, "__c"]).where(F.col("__b") < F.col(quota))
    whole = F.col("__b") + F.col("__n") <= F.col(quota)
    last = near.where(~whole).withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__c").orderBy(*order)) + F.col("__b")).where(F.col("__r") <= F.col(quota)).drop("__r")
    return near.where(whole).unionByName(last).drop("__c", "__n", "__b")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df with its row number within keys: counted inside the buckets `b` of a class and shifted by the buckets before."""
    totals = df.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("__n"))
    starts = totals.select(*keys, "b", (F.sum("__n").over(W.partitionBy(*keys).orderBy("b")) - F.col("__n")).alias("__s"))
    inside = F.row_number().over(W.partitionBy(*keys, "b").orderBy(*order))
    return df.join(starts, [*keys, "b"]).withColumn(name, inside + F.col("__s")).drop("__s")


def lowest(df: DataFrame, score: str, n: int, cell: Column | None = None) -> DataFrame:
    """The n rows of the lowest score, ties by id; cell is a number in [0, 1] that grows with the score (the score itself by default)."""
    rows = df.withColumn("__q", F.lit(n)).withColumn("__k", F.lit(0))
    return first_of(rows, ["__k"], [F.col(score), F.col("id")], F.col(score) if cell is None else cell, "__q").drop("__q", "__k")


def find_top(scores: DataFrame, score: str = "label_quality", top: int | None = 10) -> DataFrame:
    """The `top` rows of the lowest score in order, all of them if top is null or larger."""
    ordered = scores.orderBy(score, "id")
    return ordered if top is None else ordered.limit(top)


def _flag(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


POLICIES = ("prune_by_noise_rate", "prune_by_class", "both", "confident_learning", "predicted_neq_given", "low_self_confidence", "low_normalized_margin")


def find_label_issues(
    df: DataFrame,
    filter_by: str = "prune_by_noise_rate",
    *,
    frac_noise: float = 1.0,
    min_examples_per_class: int = 1,
    joint: np.ndarray | None = None,
    num_to_remove_per_class: list[int] | None = None,
    rank_by: str | None = None,
    stats: Stats | None = None,
) -> DataFrame:
    """(id, is_label_issue), a row for each row of df; with rank_by only the issues, with their score, lowest first.

    Numbers to remove are for the two pruning policies only; frac_noise has no meaning for the
    others.  stats and joint are taken as given where they are known already.
    """
    if filter_by not in POLICIES:
        raise ValueError(f"unknown filter {filter_by!r}")
    pruning = filter_by in POLICIES[:3]
    if num_to_remove_per_class is not None and not pruning:
        raise ValueError(f"numbers to remove need a pruning filter, not {filter_by!r}")
    df = df.select("id", "label", "pred_probs")
    keep = A.near_given(P(), LABEL())
    if filter_by in ("low_self_confidence", "low_normalized_margin"):
        n = num_label_issues(df, stats=stats)
        scored = df.select("id", _SCORES[filter_by[4:]](P(), LABEL()).alias("s"))
        out = _flag(df, lowest(scored, "s", n)).withColumn("is_label_issue", F.col("hit"))
    elif filter_by == "predicted_neq_given":
        out = df.withColumn("is_label_issue", (A.argmax(P()) != LABEL()) & ~keep)
    elif filter_by == "confident_learning":
        out = df.withColumn("is_label_issue", off_diagonal(df, (stats or class_stats(df)).thresholds))
    else:
        stats = stats or class_stats(df)
        joint = confident_joint(df, stats=stats) if joint is None else joint
        k, counts = len(joint), stats.counts
        quotas = cells.prune_quotas(joint, min_examples_per_class, frac_noise)
        if num_to_remove_per_class is not None:
            quotas = cells.quotas_for_removals(quotas, counts, np.asarray(num_to_remove_per_class))
        enough = [c > min_examples_per_class and c > 1 for c in counts]
        out = df
        marks = []
        if filter_by in ("prune_by_noise_rate", "both"):
            pairs = F.array(*[F.array(*[F.lit(int(quotas[j, given]) if j != given and enough[given] else 0) for j in range(k)]) for given in range(k)])
            own = F.element_at(pairs, LABEL() + 1)
            margin = F.zip_with(own, P(), lambda n, p: F.struct(n.alias("n"), (p - A.own_prob(P(), LABEL())).alias("m")))
            wanted = F.filter(F.transform(margin, lambda x, j: F.struct(j.alias("j"), x.n.alias("n"), x.m.alias("m"))), lambda x: x.n > 0)
            rows = df.select("id", "label", F.explode(wanted).alias("w")).select("id", "label", "w.*")
            hit = first_of(rows, ["label", "j"], [F.col("m").desc(), F.col("id")], (1 - F.col("m")) / 2, "n")
            out = _flag(out, hit).withColumnRenamed("hit", "by_rate")
            marks.append(F.col("by_rate"))
        if filter_by in ("prune_by_class", "both"):
            n = F.element_at(F.array(*[F.lit(int(max(0, counts[c] - quotas[c, c])) if enough[c] else 0) for c in range(k)]), LABEL() + 1)
            rows = df.select("id", "label", n.alias("n"), A.own_prob(P(), LABEL()).alias("m")).where("n > 0")
            out = _flag(out, first_of(rows, ["label"], [F.col("m"), F.col("id")], F.col("m"), "n")).withColumnRenamed("hit", "by_class")
            marks.append(F.col("by_class"))
        both = marks[0]
        for m in marks[1:]:
            both = both & m
        out = out.withColumn("is_label_issue", both & ~keep)
    if rank_by is None:
        return out.select("id", "is_label_issue")
    return out.where("is_label_issue").select("id", _SCORES[rank_by](P(), LABEL()).alias("score")).orderBy("score", "id")


def argmax_issues(df: DataFrame, calibrate: bool = True, filter_by: str = "prune_by_noise_rate") -> DataFrame:
    """The filter with the confusion of labels and predictions in the place of the confident joint: a baseline."""
    return find_label_issues(df, filter_by, joint=argmax_confusion(df, calibrate))


def argmax_confusion(df: DataFrame, calibrate: bool = True) -> np.ndarray:
    """[given, predicted] counts as a joint."""
    k = num_classes(df)
    m = np.zeros((k, k), np.int64)
    for r in df.groupBy("label", A.argmax(P()).alias("g")).count().collect():
        m[r["label"], r["g"]] = r["count"]
    return cells.calibrated(m, label_counts(df, k)) if calibrate else m


def label_quality(df: DataFrame, method: str = "self_confidence", adjust: bool = False) -> DataFrame:
    """(id, label_quality)."""
    p = P()
    if adjust:
        if method == "confidence_weighted_entropy":
            raise ValueError("confidence_weighted_entropy can't be adjusted")
        p = A.adjusted(P(), thresholds(df))
    return df.select("id", _SCORES[method](p, LABEL()).alias("label_quality"))


def ensemble_quality(df: DataFrame, columns: list[str], method: str = "self_confidence", weight: str = "uniform", custom: list[float] | None = None) -> DataFrame:
    """Weighted mean of the scores of several probability columns."""
    m = len(columns)
    if weight == "accuracy":
        acc = df.agg(*[F.avg((A.argmax(F.col(c)) == LABEL()).cast("double")).alias(c) for c in columns]).first()
        w = [acc[c] / sum(acc) for c in columns]
    elif weight == "log_loss_search":
        w = _log_loss_weights(df, columns)
    else:
        w = custom if weight == "custom" else [1 / m] * m
    score = sum((F.lit(float(x)) * _SCORES[method](F.col(c), LABEL()) for x, c in zip(w, columns, strict=True)), F.lit(0.0))
    return df.select("id", score.alias("label_quality"))


def _log_loss_weights(df: DataFrame, columns: list[str], grid=(1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0, 200.0)) -> list[float]:
    """Weights exp(-T loss) with the T whose ensemble has the least log loss; all T are tried in one pass."""
    fine = {c: A.normalized(F.transform(F.col(c), lambda x: F.least(F.greatest(x, F.lit(EPS)), F.lit(1 - EPS)))) for c in columns}
    loss = df.agg(*[F.avg(-F.ln(A.own_prob(fine[c], LABEL()))).alias(c) for c in columns]).first()
    ws = []
    for t in grid:
        w = np.exp(-t * (np.array(list(loss))))
        ws.append((w / w.sum()).tolist() if w.sum() > 0 else [1 / len(columns)] * len(columns))
    mixed = [sum((F.lit(x) * A.own_prob(fine[c], LABEL()) for x, c in zip(w, columns, strict=True)), F.lit(0.0)) for w in ws]
    got = list(df.agg(*[F.avg(-F.ln(F.greatest(x, F.lit(EPS)))).alias(f"t{i}") for i, x in enumerate(mixed)]).first())
    return ws[int(np.argmin(got))]


def class_quality(df: DataFrame, joint: np.ndarray | None = None, n: int | None = None) -> list[tuple]:
    """(class, label_issues, inverse_issues, noise, inverse_noise, quality), worst first; n is the number of rows, that of the joint by default."""
    joint = confident_joint(df) if joint is None else joint
    j, n = estimate_joint(df, joint), num_examples(joint) if n is None else n
    rows = []
    for c in range(len(j)):
        out, into = j[c].sum() - j[c, c], j[:, c].sum() - j[c, c]
        noise = out / max(j[c].sum(), EPS)
        rows.append((c, int(np.rint(out * n)), int(np.rint(into * n)), float(noise), float(into / max(j[:, c].sum(), EPS)), float(1 - noise)))
    return sorted(rows, key=lambda r: (r[5], r[0]))


def overlapping_classes(df: DataFrame, joint: np.ndarray | None = None, asymmetric: bool = False, n: int | None = None) -> list[tuple]:
    """(class_a, class_b, num_overlapping, joint), largest first."""
    joint = confident_joint(df) if joint is None else joint
    j, n = estimate_joint(df, joint), num_examples(joint) if n is None else n
    k = len(j)
    pairs = [(a, b, j[a, b]) for a in range(k) for b in range(k) if a != b] if asymmetric else [(a, b, j[a, b] + j[b, a]) for a in range(k) for b in range(a + 1, k)]
    return sorted([(a, b, int(np.rint(x * n)), float(x)) for a, b, x in pairs], key=lambda r: (-r[3], r[0], r[1]))


def num_examples(joint: np.ndarray) -> int:
    """The rows that a calibrated joint stands for."""
    return int(np.asarray(joint).sum())


def health_score(df: DataFrame | None, joint: np.ndarray | None = None, stats: Stats | None = None) -> float:
    """1 less the share of issues; without rows, the diagonal's share of a joint."""
    if df is None:
        return float(np.trace(joint) / joint.sum())
    stats = stats or class_stats(df)
    return 1 - num_label_issues(df, stats=stats) / max(1, stats.n)


def health_summary(df: DataFrame) -> dict:
    stats = class_stats(df)
    j = confident_joint(df, stats=stats)
    return {"joint": estimate_joint(df, j), "classes": class_quality(df, j), "overlaps": overlapping_classes(df, j), "score": health_score(df, stats=stats)}


def noise_estimates(df: DataFrame, converge: bool = True, method: str = "cnt", t: list[float] | None = None, calibrate: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prior of the true classes, noise matrix, inverse noise matrix and joint, from the rows' probabilities."""
    joint = confident_joint(df, t, calibrate)
    return (*cells.latent(joint, method, converge), joint)


def ood_from_probs(df: DataFrame, method: str = "entropy", adjust: bool = True, t: list[float] | None = None) -> DataFrame:
    """(id, score): low for rows unlike the classes; adjusted by given thresholds, or those of the rows."""
    p = A.adjusted(P(), t or thresholds(df)) if adjust else P()
    score = {"entropy": lambda x: 1 - A.normalized_entropy(x), "least_confidence": A.least_confidence, "gen": A.generalized_entropy}[method](p)
    return df.select("id", score.alias("score"))


def reaching_guess(t: list[float], thorough: bool = False) -> Column:
    """The prediction if it reaches its own class's threshold, else null; thorough: the most likely of all classes that reach theirs."""
    limits = F.array(*[F.lit(float(x)) for x in t])
    if thorough:
        reached = F.zip_with(P(), limits, lambda p, x: F.when(p >= x - EPS, p))
        return (F.array_position(reached, F.array_max(reached)) - 1).cast("int")
    top = A.argmax(P())
    return F.when(F.array_max(P()) >= F.element_at(limits, top + 1) - EPS, top)


def issue_counts(guess: Column, thorough: bool = False) -> list[Column]:
    """Aggregates by class for a count in batches: rows (n), those with a guess (norm), with a guess that isn't the label (off), and of these those not predicted as labelled (hits)."""
    off = F.coalesce(guess != LABEL(), F.lit(False))
    hits = off & (A.argmax(P()) != LABEL()) if thorough else off
    return [F.count(F.lit(1)).alias("n"), F.count_if(guess.isNotNull()).alias("norm"), F.count_if(off).alias("off"), F.count_if(hits).alias("hits")]


def issue_total(rows, calibrated: bool = False) -> int:
    """Issues from issue_counts by class: the hits, or the share of the guesses that are off scaled to all rows of each class."""
    if calibrated:
        return int(np.rint(sum(r["off"] * r["n"] / max(r["norm"], EPS) for r in rows)))
    return sum(r["hits"] for r in rows)


def batched_issue_count(df: DataFrame, calibrated: bool = False, thorough: bool = False, stats: Stats | None = None) -> int:
    """Rows whose guess differs from the label, counted as a scan in batches does."""
    guess = reaching_guess((stats or class_stats(df)).thresholds, thorough)
    return issue_total(df.groupBy("label").agg(*issue_counts(guess, thorough)).collect(), calibrated)


def batched_issues(df: DataFrame, method: str = "self_confidence", calibrated: bool = False, thorough: bool = False) -> DataFrame:
    """(id) of the batched filter: the rows of the lowest scores, as many as are counted, less those predicted as labelled."""
    n = batched_issue_count(df, calibrated, thorough)
    scored = df.select("id", _SCORES[method](P(), LABEL()).alias("s"), A.near_given(P(), LABEL()).alias("same"))
    return lowest(scored, "s", n).where("not same").select("id")


def recalibrated_probs(df: DataFrame, noise: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """(id, pred_probs): p(true | x), from p(given | x) by the diagonals of both matrices."""
    r = F.array(*[F.lit(float(x)) for x in np.diagonal(inverse) / np.diagonal(noise)])
    p = F.transform(F.zip_with(P(), r, lambda x, y: x * y), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return df.select("id", A.normalized(p).alias("pred_probs"))
