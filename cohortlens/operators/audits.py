"""Audits of one table, crowd labels, regression labels and synthetic noise."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.session import once, shared_folder, ship_package
from . import confident as C


def class_imbalance(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(id, score, is_class_imbalance_issue): rows of the rarest class if its share is under threshold / K."""
    counts = df.groupBy("label").count()
    n, k = counts.agg(F.sum("count"), F.count(F.lit(1))).first()
    rare = counts.orderBy("count", "label").first()
    if rare is None or rare["count"] / n >= threshold / k:
        return df.select("id", F.lit(1.0).alias("score"), F.lit(False).alias("is_class_imbalance_issue"))
    hit = F.col("label") == F.lit(rare["label"])
    return df.select("id", F.when(hit, F.lit(rare["count"] / n)).otherwise(1.0).alias("score"), hit.alias("is_class_imbalance_issue"))


def null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(id, score, is_null_issue): share of columns with a value; an issue if none has one."""
    full = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.select("id", (full / F.lit(float(len(columns)))).alias("score"), (full == 0).alias("is_null_issue"))


def null_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pattern, n) of rows with some null; 1 marks a null."""
    p = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return df.select(p.alias("pattern")).where(F.col("pattern").contains("1")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def commonest_null_pattern(df: DataFrame, columns: list[str]) -> tuple[str | None, DataFrame]:
    """The most frequent pattern of nulls among rows with some (the first in order of equal ones), and the (id) of the rows that have it."""
    top = null_patterns(df, columns).orderBy(F.desc("n"), "pattern").first()
    p = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    name = top["pattern"] if top else None
    return name, df.where(p == F.lit(name)).select("id")


def column_impact(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_share), from one aggregate."""
    r = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_share")) for c in columns])).alias("x")).select("x.*")


def identifier_columns(df: DataFrame) -> DataFrame:
    """(column, is_identifier): whole-number columns whose distinct values are a run from the least to the greatest."""
    cols = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, is_identifier boolean")
    run = lambda c: (F.count_distinct(F.col(c)) == F.max(c) - F.min(c) + 1) & (F.max(c) > F.min(c)) & (F.count_if(F.col(c).isNull()) == 0)
    r = df.agg(*[F.coalesce(run(c), F.lit(False)).alias(c) for c in cols])
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("is_identifier")) for c in cols])).alias("x")).select("x.*")


def underperforming_group(df: DataFrame, threshold: float = 0.1, least: int = 5) -> DataFrame:
    """(cluster, n, mean_own_prob, ratio, is_worst_issue) for df(id, label, pred_probs, cluster).

    Clusters under `least` rows, null and -1 (rows outside all clusters) take no part, nor do their rows in the mean.
    """
    own = A.own_prob(C.P(), C.LABEL())
    g = df.where(F.col("cluster").isNotNull() & (F.col("cluster").cast("string") != "-1"))
    g = g.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(own).alias("mean_own_prob")).where(F.col("n") >= least)
    mean = g.agg(F.sum(F.col("n") * F.col("mean_own_prob")) / F.sum("n")).first()[0] or 1.0
    g = g.withColumn("ratio", F.least(F.col("mean_own_prob") / F.lit(mean), F.lit(1.0)))
    worst = g.agg(F.min("ratio")).first()[0]
    return g.withColumn("is_worst_issue", (F.col("ratio") == F.lit(worst)) & (F.col("ratio") < threshold))


# Crowd labels: (task_id, annotator_id, label), model: (task_id, pred_probs)


def majority_vote(votes: DataFrame, probs: DataFrame | None = None) -> DataFrame:
    """(task_id, consensus).

    Ties: highest model probability, then the class least frequent over all votes,
    then the annotators who agree most with untied tasks, then the lowest class.
    """
    votes = once(votes)
    n = votes.groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("best", F.max("n").over(W.partitionBy("task_id"))).where("n = best")
    freq = votes.groupBy("label").agg(F.count(F.lit(1)).alias("freq"))
    tied = top.withColumn("ties", F.count(F.lit(1)).over(W.partitionBy("task_id")))
    untied = tied.where("ties = 1").select("task_id", F.col("label").alias("winner"))
    agree = votes.join(untied, "task_id").groupBy("annotator_id").agg(F.avg((F.col("label") == F.col("winner")).cast("double")).alias("agree"))
    support = votes.join(agree, "annotator_id", "left").groupBy("task_id", "label").agg(F.avg("agree").alias("support"))
    rows = tied.join(freq, "label").join(support, ["task_id", "label"])
    rows = rows.join(probs, "task_id", "left").withColumn("p", A.own_prob(F.col("pred_probs"), F.col("label"))) if probs is not None else rows.withColumn("p", F.lit(0.0))
    order = [F.desc_nulls_last("p"), F.asc("freq"), F.desc_nulls_last("support"), F.asc("label")]
    return rows.withColumn("r", F.row_number().over(W.partitionBy("task_id").orderBy(*order))).where("r = 1").select("task_id", F.col("label").alias("consensus"))


def agreement_with_consensus(votes: DataFrame, consensus: DataFrame) -> DataFrame:
    """(task_id, agreement, n_annotations)."""
    j = votes.join(consensus, "task_id")
    return j.groupBy("task_id").agg(F.avg((F.col("label") == F.col("consensus")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n_annotations"))


def annotator_agreement(votes: DataFrame) -> DataFrame:
    """(annotator_id, agreement): mean share of the other annotators of a task who agree, weighted by their number.

    Counted from votes by class, so pairs of annotators are never formed.
    """
    votes = once(votes)
    by = votes.groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("same"))
    all_ = votes.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    j = votes.join(by, ["task_id", "label"]).join(all_, "task_id").where("n > 1")
    a = j.groupBy("annotator_id").agg((F.sum(F.col("same") - 1) / F.sum(F.col("n") - 1)).alias("agreement"))
    mean = a.agg(F.avg("agreement")).first()[0]
    return votes.select("annotator_id").distinct().join(a, "annotator_id", "left").select("annotator_id", F.coalesce("agreement", F.lit(mean)).alias("agreement"))


def annotator_stats(votes: DataFrame, consensus: DataFrame) -> DataFrame:
    """(annotator_id, n_labeled, accuracy, worst_class) against the consensus; of equal classes the one labelled most, then the first."""
    j = votes.join(consensus, "task_id").withColumn("hit", (F.col("label") == F.col("consensus")).cast("double"))
    total = j.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_labeled"), F.avg("hit").alias("accuracy"))
    by = j.groupBy("annotator_id", "label").agg(F.avg("hit").alias("acc"), F.count(F.lit(1)).alias("n"))
    worst = by.withColumn("r", F.row_number().over(W.partitionBy("annotator_id").orderBy("acc", F.desc("n"), "label"))).where("r = 1")
    return total.join(worst.select("annotator_id", F.col("label").alias("worst_class")), "annotator_id")


def crowd_weights(votes: DataFrame, probs: DataFrame, consensus: DataFrame) -> tuple[DataFrame, float, float]:
    """(annotator_id, w), the model's weight, and the mean agreement on tasks with several labels.

    A weight is one less the error over that of always answering the most likely class.
    """
    w, models, agree = ensemble_weights(votes, probs, ["pred_probs"], consensus)
    return w, models[0], agree


def crowd_posterior(votes: DataFrame, probs: DataFrame, n_classes: int, weights=None, majority: DataFrame | None = None) -> DataFrame:
    """(task_id, posterior, consensus, consensus_quality): weighted mean of the model's probabilities and the annotators' likelihoods."""
    if majority is None:
        votes, probs = once(votes), once(probs)
        majority = majority_vote(votes, probs).checkpoint()
    w, mw, agree = weights or crowd_weights(votes, probs, majority)
    like = lambda c: F.when(F.col("label") == c, F.lit(agree)).otherwise(F.lit((1 - agree) / (n_classes - 1)))
    sums = votes.join(w, "annotator_id").groupBy("task_id").agg(F.sum("w").alias("ws"), *[F.sum(F.col("w") * like(c)).alias(f"s{c}") for c in range(n_classes)])
    j = probs.join(sums, "task_id").join(majority, "task_id")
    post = F.array(*[(F.lit(mw) * F.element_at("pred_probs", c + 1) + F.col(f"s{c}")) / (F.lit(mw) + F.col("ws")) for c in range(n_classes)])
    j = j.select("task_id", post.alias("posterior"), F.col("consensus").alias("majority"))
    best = F.when(F.element_at("posterior", F.col("majority") + 1) == F.array_max("posterior"), F.col("majority")).otherwise(A.argmax(F.col("posterior")))
    return j.select("task_id", "posterior", best.alias("consensus")).withColumn("consensus_quality", A.own_prob(F.col("posterior"), F.col("consensus")))


def annotation_quality(votes: DataFrame, posterior: DataFrame) -> DataFrame:
    """(task_id, annotator_id, label_quality) of each single label under the posterior."""
    return votes.join(posterior, "task_id").select("task_id", "annotator_id", A.own_prob(F.col("posterior"), F.col("label")).alias("label_quality"))


# Several models: probs has (task_id, m_0, m_1, ...), one probability array a model


def mean_probs(columns: list[str]):
    """The models' mean probabilities of each class."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = F.zip_with(total, F.col(c), lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(columns))


def ensemble_weights(votes: DataFrame, probs: DataFrame, columns: list[str], consensus: DataFrame) -> tuple[DataFrame, list[float], float]:
    """As crowd_weights, with one weight a model."""
    hit = F.avg((F.col("label") == F.col("consensus")).cast("double")).alias("agreement")
    tasks = votes.join(consensus, "task_id", "left").groupBy("task_id").agg(hit, F.count(F.lit(1)).alias("n_annotations"), F.max("consensus").alias("consensus")).join(probs.select("task_id", *[A.argmax(F.col(c)).alias(f"__m{i}") for i, c in enumerate(columns)]), "task_id", "left")
    # One pass: by consensus the tasks of several labels, their agreement, and the models that miss it.
    several = (F.col("n_annotations") > 1) & F.col("consensus").isNotNull()
    miss = [(F.col(f"__m{i}") != F.col("consensus")).cast("double") for i in range(len(columns))]
    by = tasks.groupBy("consensus").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("n_annotations").alias("votes"), F.count_if(several).alias("n"), F.sum(F.when(several, F.col("agreement"))).alias("agreement"),
        *[x for i, m in enumerate(miss) for x in (F.sum(F.when(several, m)).alias(f"s{i}"), F.count(F.when(several, m)).alias(f"c{i}"))],
    ).collect()
    n = sum(r["n"] for r in by)
    top = min((r for r in by if r["n"] and r["consensus"] is not None), key=lambda r: (-r["n"], r["consensus"]), default=None)
    base = max(((n - top["n"]) / n if top else 0.0) or 1.0, 1e-6)
    mean_n = sum(r["votes"] for r in by) / max(sum(r["tasks"] for r in by), 1) or 1.0
    error = [sum(r[f"s{i}"] or 0.0 for r in by) / max(sum(r[f"c{i}"] for r in by), 1) for i in range(len(columns))]
    w = once(annotator_agreement(votes).select("annotator_id", F.greatest(1 - (1 - F.col("agreement")) / F.lit(base), F.lit(1e-6)).alias("w")))
    return w, [max(1 - x / base, 1e-6) * float(np.sqrt(mean_n)) for x in error], sum(r["agreement"] or 0.0 for r in by) / n if n else 1.0


def blended(columns: list[str], weights: list[float]):
    """Weighted sum of the models' probabilities over the sum of the weights."""
    scaled = lambda c, w: F.transform(c, lambda x: x * F.lit(w))
    total = scaled(columns[0], weights[0])
    for c, w in zip(columns[1:], weights[1:], strict=True):
        total = F.zip_with(total, scaled(c, w), lambda a, b: a + b)
    return F.transform(total, lambda x: x / F.lit(sum(weights)))


def crowd_posterior_ensemble(votes: DataFrame, probs: DataFrame, columns: list[str], n_classes: int, majority: DataFrame | None = None) -> DataFrame:
    """As crowd_posterior for several models: ties by their mean, each with a weight of its own in the posterior."""
    if majority is None:
        votes, probs = once(votes), once(probs)
        majority = majority_vote(votes, probs.select("task_id", mean_probs(columns).alias("pred_probs"))).checkpoint()
    w, models, agree = ensemble_weights(votes, probs, columns, majority)
    one = probs.select("task_id", blended(columns, models).alias("pred_probs"))
    return crowd_posterior(votes, one, n_classes, (w, sum(models), agree), majority)


@dataclass
class Crowd:
    """What crowd_labels finds: per task, and what it weighs annotators and models by."""

    labels: DataFrame
    posterior: DataFrame
    weights: DataFrame
    models: list[float]


def crowd_labels(votes: DataFrame, probs: DataFrame, n_classes: int, columns: tuple[str, ...] = ("pred_probs",), consensus: str = "best_quality", quality: str = "posterior") -> Crowd:
    """Consensus labels (task_id, consensus, consensus_quality, agreement, n_annotations) from annotators and models.

    The majority gives first weights and a first posterior; its best class is the consensus
    ("best_quality"; "majority_vote" keeps the majority), from which weights, posterior and
    quality are taken anew.  Quality "agreement" uses the shares of votes and no model weights.
    """
    if consensus not in ("best_quality", "majority_vote") or quality not in ("posterior", "agreement"):
        raise ValueError(f"unknown method {consensus!r} or {quality!r}")
    columns = list(columns)
    votes, probs = once(votes), once(probs)
    chosen = majority_vote(votes, probs.select("task_id", mean_probs(columns).alias("pred_probs"))).checkpoint()
    if quality == "agreement":
        n = votes.groupBy("task_id").agg(F.array(*[F.count_if(F.col("label") == c) / F.count(F.lit(1)) for c in range(n_classes)]).alias("posterior"))
        post, w, models = n, votes.select("annotator_id").distinct().withColumn("w", F.lit(1.0)), [0.0] * len(columns)
    else:
        if consensus == "best_quality":
            chosen = crowd_posterior_ensemble(votes, probs, columns, n_classes, chosen).select("task_id", "consensus").checkpoint()
        w, models, agree = ensemble_weights(votes, probs, columns, chosen)
        one = probs.select("task_id", blended(columns, models).alias("pred_probs"))
        post = crowd_posterior(votes, one, n_classes, (w, sum(models), agree), chosen).select("task_id", "posterior")
    found = post.join(chosen, "task_id").join(agreement_with_consensus(votes, chosen), "task_id")
    score = F.col("agreement") if quality == "agreement" else A.own_prob(F.col("posterior"), F.col("consensus"))
    labels = found.select("task_id", "consensus", score.alias("consensus_quality"), "agreement", "n_annotations")
    return Crowd(labels, post, w, models)


def annotator_quality(votes: DataFrame, crowd: Crowd) -> DataFrame:
    """(annotator_id, annotator_quality, agreement_with_consensus, worst_class, n_labeled).

    Quality is the mean quality of the annotator's labels and the agreement with the consensus on
    tasks of several labels, weighed by the models' weight against the annotators' on a mean task.
    Equal worst classes: the one labelled most, then of the best mean consensus quality, then the first.
    """
    n, tasks = votes.count(), votes.select("task_id").distinct().count()
    total, people = crowd.weights.agg(F.sum("w"), F.count(F.lit(1))).first()
    share = sum(crowd.models) / max(sum(crowd.models) + (total or 0.0) * n / max(tasks, 1) / max(people, 1), 1e-300)
    j = votes.join(crowd.labels, "task_id").withColumn("hit", (F.col("label") == F.col("consensus")).cast("double"))
    mean = annotation_quality(votes, crowd.posterior).groupBy("annotator_id").agg(F.avg("label_quality").alias("q"))
    a = j.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_labeled"), F.avg("hit").alias("agreement_with_consensus"), F.avg(F.when(F.col("n_annotations") > 1, F.col("hit"))).alias("multi"))
    by = j.groupBy("annotator_id", "label").agg(F.avg("hit").alias("acc"), F.count(F.lit(1)).alias("n"), F.avg("consensus_quality").alias("cq"))
    worst = by.groupBy("annotator_id").agg(F.min_by("label", F.struct("acc", -F.col("n"), -F.col("cq"), "label")).alias("worst_class"))
    quality = F.lit(share) * F.col("q") + F.lit(1 - share) * F.col("multi")
    return a.join(mean, "annotator_id").join(worst, "annotator_id").select("annotator_id", quality.alias("annotator_quality"), "agreement_with_consensus", "worst_class", "n_labeled")


def active_learning_scores_ensemble(votes: DataFrame, probs: DataFrame, columns: list[str], n_classes: int) -> DataFrame:
    """(task_id, score) of every task with probabilities, low where another label helps most.

    Each model is brought to its best temperature first.  The quality of the consensus (without
    labels: of the class that most models choose, then of the highest mean probability, then the
    lowest) is drawn towards 1 / K by the weight of one more mean annotator.  If no task has
    several labels, every annotator and model weighs 1 and nothing is rescaled.
    """
    votes, probs = once(votes), once(probs)
    several = votes.groupBy("task_id").count().where("count > 1").limit(1).count() > 0
    if several:
        for c in columns:
            one = probs.select("task_id", F.col(c).alias("pred_probs"))
            probs = probs.withColumn(c, temperature_scaled(F.col(c), best_temperature(votes, one)))
        probs = probs.checkpoint()
        crowd = crowd_labels(votes, probs, n_classes, tuple(columns))
        w, models, found = crowd.weights, crowd.models, crowd.labels.select("task_id", "consensus_quality")
    else:
        w, models = votes.select("annotator_id").distinct().withColumn("w", F.lit(1.0)), [1.0] * len(columns)
        mean = probs.select("task_id", mean_probs(columns).alias("m"))
        found = mean.join(votes, "task_id").select("task_id", A.own_prob(F.col("m"), F.col("label")).alias("consensus_quality"))
    mean_w = w.agg(F.avg("w")).first()[0] or 1.0
    own = votes.join(w, "annotator_id").groupBy("task_id").agg(F.sum("w").alias("ws"))
    count = [sum((A.argmax(F.col(m)) == c).cast("int") for m in columns) for c in range(n_classes)]
    rank = F.array(*[F.struct(n.alias("n"), F.element_at(mean_probs(columns), c + 1).alias("p"), F.lit(-c).alias("c")) for c, n in enumerate(count)])
    sure = A.own_prob(blended(columns, models), -F.array_max(rank)["c"])
    j = probs.join(own, "task_id", "left").join(found, "task_id", "left")
    weight = F.coalesce("ws", F.lit(0.0)) + F.lit(sum(models))
    # Without labels the total is that of the models and the one mean annotator, which the same form gives.
    return j.select("task_id", ((F.coalesce("consensus_quality", sure) * weight + F.lit(mean_w / n_classes)) / (weight + mean_w)).alias("score"))


def active_learning_scores(votes: DataFrame, probs: DataFrame, n_classes: int) -> DataFrame:
    """(task_id, score) as active_learning_scores_ensemble, for one model's pred_probs."""
    return active_learning_scores_ensemble(votes, probs, ["pred_probs"], n_classes)


def lost_classes(votes: DataFrame, consensus: DataFrame) -> DataFrame:
    """(label) that annotators gave and no task has as its consensus."""
    return votes.select("label").distinct().join(consensus.select(F.col("consensus").alias("label")), "label", "left_anti")


def temperature_scaled(p, t: float):
    """softmax(ln p / T)."""
    return A.softmax(F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(1e-30)))), t)


def best_temperature(votes: DataFrame, probs: DataFrame, coarse=(0.1, 0.2, 0.5, 0.8, 1.0, 2.0, 3.0, 5.0, 8.0), steps: int = 4) -> float:
    """Temperature of least mean soft cross-entropy: a coarse grid, then a fine one on either side of its best; each grid is one pass."""
    by = votes.groupBy("task_id", "label").count()
    n = votes.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    j = by.join(n, "task_id").join(probs, "task_id").select("task_id", "label", (F.col("count") / F.col("n")).alias("share"), "pred_probs")

    def losses(grid):
        terms = [F.sum(-F.col("share") * F.ln(F.greatest(A.own_prob(temperature_scaled(F.col("pred_probs"), t), F.col("label")), F.lit(1e-30)))).alias(f"t{i}") for i, t in enumerate(grid)]
        return list(j.agg(*terms).first())

    first = losses(coarse)
    if first[0] is None:
        return 1.0
    i = int(np.argmin(first))
    below = np.linspace(coarse[i - 1], coarse[i], steps, endpoint=False).tolist() if i else []
    above = np.linspace(coarse[i], coarse[i + 1], steps + 1).tolist() if i + 1 < len(coarse) else []
    fine = below + above
    return float(fine[int(np.argmin(losses(fine)))])


def soft_cross_entropy(votes: DataFrame, probs: DataFrame) -> DataFrame:
    """(task_id, soft_ce): cross-entropy of the vote shares under the model, over ln K."""
    by = votes.groupBy("task_id", "label").count()
    n = votes.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    j = by.join(n, "task_id").join(probs, "task_id")
    t = F.col("count") / F.col("n") * F.ln(F.greatest(A.own_prob(F.col("pred_probs"), F.col("label")), F.lit(1e-30)))
    return j.groupBy("task_id").agg((-F.sum(t) / F.ln(F.first(F.size("pred_probs")))).alias("soft_ce"))


# Regression: (id, y, prediction)


def residual_scores(df: DataFrame) -> DataFrame:
    return df.select("id", F.exp(-F.abs(F.col("prediction") - F.col("y"))).alias("label_quality"))


MOST_POINTS, STRIPES = 20_000_000, 64
#: Points of a tile, and Chebyshev nodes of a group of tiles each way.
LEAF, NODES = 64, 12


def outlying_residual_scores(df: DataFrame, residual_scale: float = 5.0, share: float = 0.5, cells: bool = False) -> DataFrame:
    """(id, label_quality) of df(id, y, prediction) by how far a row lies from the nearest `share` of all rows, itself included.

    Rows are points: the standardised label and residual_scale times the standardised residual.
    The points lie in tiles of LEAF, sorted, on all executors (16 bytes a point; more than MOST_POINTS are an error, which names the other way).  Rows of one tile are scored
    together: tiles that are inside all their circles count as a whole, far groups of tiles among them by
    weights at Chebyshev nodes (the mean distances are within 1e-11 of the exact ones), tiles outside not at all, and only points of
    tiles at the rim are ordered, so the work grows with the power 1.5 of the rows.  With cells, the points
    compared with are the means of at most STRIPES x STRIPES cells of equal depth, weighted by their
    rows: linear work, and a mean distance is off by less than the mean radius of the cells.  Rows with a null take no part.
    """
    rows = df.select("id", F.col("y").cast("double").alias("y"), (F.col("prediction") - F.col("y")).cast("double").alias("e")).where("y is not null and e is not null")
    n, my, sy, me, se = rows.agg(F.count(F.lit(1)), F.avg("y"), F.stddev_pop("y"), F.avg("e"), F.stddev_pop("e")).first()
    if not n:
        return rows.select("id", F.lit(1.0).alias("label_quality"))
    pts = rows.select("id", ((F.col("y") - F.lit(my)) / F.lit(sy + 1e-100)).alias("a"), ((F.col("e") - F.lit(me)) / F.lit(se + 1e-100) * residual_scale).alias("b"))
    if cells:
        cuts = [x / STRIPES for x in range(1, STRIPES)]
        qa, qb = pts.approxQuantile(["a", "b"], cuts, 1e-4)
        stripe = lambda c, q: F.size(F.filter(F.array(*[F.lit(x) for x in q]), lambda x: x < F.col(c)))
        means = pts.groupBy(stripe("a", qa).alias("u"), stripe("b", qb).alias("v")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.count(F.lit(1)).cast("double").alias("w"))
        base = means.select("a", "b", "w").toArrow()
    elif n > MOST_POINTS:
        raise ValueError(f"{n} rows are too many to hold on every executor (at most {MOST_POINTS}): ask for cells")
    else:
        return _residual_distances_by_tiles(pts, int(np.ceil(share * n)))
    ship_package(df.sparkSession)
    need, shared = float(np.ceil(share * n)), df.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in base.columns))

    def mean_distance(batches):
        x, y, weight = shared.value
        size = max(1, (1 << 22) // len(x))
        for t in batches:
            a, b = t["a"].to_numpy(), t["b"].to_numpy()
            parts = [_nearest_mean(np.hypot(a[i : i + size, None] - x, b[i : i + size, None] - y), weight, need, cells) for i in range(0, len(a), size)]
            yield t[["id"]].assign(d=np.concatenate(parts) if parts else np.zeros(0))

    id_type = dict(pts.dtypes)["id"]
    return _distance_scores(pts.mapInPandas(mean_distance, f"id {id_type}, d double"))


def _distance_scores(dist: DataFrame) -> DataFrame:
    dist = once(dist)
    scale = dist.agg(F.percentile("d", F.lit(0.5))).first()[0]
    return dist.select("id", F.exp(-F.col("d") / F.lit(max(scale, 100 * 2.220446049250313e-16))).alias("label_quality"))


def _residual_distances_by_tiles(pts: DataFrame, need: int) -> DataFrame:
    ship_package(pts.sparkSession)
    got = pts.select("a", "b").toArrow()
    tiles = Tiles(np.stack([got["a"].to_numpy(), got["b"].to_numpy()], axis=1))
    shared = pts.sparkSession.sparkContext.broadcast(tiles)
    id_type = dict(pts.dtypes)["id"]

    def place(batches):
        for t in batches:
            yield t.assign(tile=shared.value.tile_of(t["a"].to_numpy(), t["b"].to_numpy()))

    def mean_distance(batches):
        last = None
        for t in batches:
            tile, q, d = t["tile"].to_numpy(), t[["a", "b"]].to_numpy(), np.zeros(len(t))
            edges = np.flatnonzero(np.diff(tile)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(t)], strict=True) if len(t) else ():
                for at in range(lo, hi, LEAF):
                    z = slice(at, min(hi, at + LEAF))
                    d[z], last = shared.value.means(q[z], need, last)
            yield t[["id"]].assign(d=d)

    tasks = max(1, min(200, len(tiles.starts) // 8))
    placed = pts.mapInPandas(place, f"id {id_type}, a double, b double, tile int").repartition(tasks, F.floor(F.col("tile") / 8)).sortWithinPartitions("tile")
    return _distance_scores(placed.mapInPandas(mean_distance, f"id {id_type}, d double"))


class Tiles:
    """Points in tiles of LEAF: stripes of equal depth by the first coordinate, sorted by the second inside each."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        shape = np.clip(points[:, 1].std() / max(points[:, 0].std(), 1e-300), 1 / 64, 64)
        per = LEAF * max(1, int(np.ceil(np.sqrt(n / LEAF * shape))))
        order = np.argsort(points[:, 0], kind="stable")
        order = np.concatenate([z[np.argsort(points[z, 1], kind="stable")] for z in (order[at : at + per] for at in range(0, n, per))])
        self.points, self.per = points[order], per
        self.starts = np.arange(0, n, LEAF)
        self.ends = np.minimum(self.starts + LEAF, n)
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)
        self.cuts = np.array([self.points[at : at + per, 0].min() for at in range(0, n, per)])
        side = max(2, round((n / LEAF) ** 0.25 / 2))  # groups of neighbouring tiles: up to so many stripes, and tiles of each
        row, column = self.starts // per, self.starts % per // LEAF
        key = row // side * (per // LEAF) + column // side
        self.group = np.unique(key, return_inverse=True)[1]
        by = np.argsort(self.group, kind="stable")
        first = np.flatnonzero(np.diff(self.group[by], prepend=-1))
        self.group_low, self.group_high = np.minimum.reduceat(self.low[by], first), np.maximum.reduceat(self.high[by], first)
        node = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
        middle, half = (self.group_low + self.group_high) / 2, np.maximum((self.group_high - self.group_low) / 2, 1e-12)
        self.nodes, self.weights = [], []
        poly = np.cos(np.outer(np.arange(NODES), np.arccos(node)))
        for g, part in enumerate(np.split(by, first[1:])):
            u = (self.points[self._of(part)] - middle[g]) / half[g]
            c = np.cos(np.arccos(np.clip(u, -1, 1))[:, :, None] * np.arange(NODES))
            c[:, :, 0] = 0.5
            lx, ly = 2 / NODES * c[:, 0] @ poly, 2 / NODES * c[:, 1] @ poly
            self.weights.append((lx.T @ ly).ravel())
            self.nodes.append(np.stack([np.repeat(middle[g, 0] + half[g, 0] * node, NODES), np.tile(middle[g, 1] + half[g, 1] * node, NODES)], axis=1))
        self.nodes, self.weights = np.array(self.nodes), np.array(self.weights)

    def _of(self, tiles: np.ndarray) -> np.ndarray:
        """Places of the points of some tiles."""
        size = self.ends[tiles] - self.starts[tiles]
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[tiles], size)

    def tile_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int32)
        stripe = np.maximum(np.searchsorted(self.cuts, a, "right") - 1, 0)
        for s in np.unique(stripe):
            z = stripe == s
            first = s * self.per // LEAF
            lows = self.low[first : first + self.per // LEAF, 1]
            out[z] = first + np.maximum(np.searchsorted(lows, b[z], "right") - 1, 0)
        return out

    @staticmethod
    def _reach(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance between the box from a to b and other boxes."""
        near = np.maximum(np.maximum(low - b, a - high), 0)
        far = np.maximum(high - a, b - low)
        return np.hypot(near[:, 0], near[:, 1]), np.hypot(far[:, 0], far[:, 1])

    def means(self, q: np.ndarray, need: int, last: tuple | None) -> tuple[np.ndarray, tuple]:
        """The mean distance of each row of q to its `need` nearest points, and (centre, radius) for the next call."""
        a, b = q.min(axis=0), q.max(axis=0)
        centre = (a + b) / 2
        near, far = self._reach(self.low, self.high, centre, centre)
        radius, slack = (last[1], np.hypot(*(centre - last[0]))) if last else (0.0, np.inf)
        slack = slack * (1 + 1e-9) + 1e-9 * radius
        inside, rim = far < radius - slack, (near <= radius + slack) & (far >= radius - slack)
        z = self.points[self._of(np.flatnonzero(rim))]
        rest = need - int((self.ends - self.starts)[inside].sum())
        radius = float(np.partition(np.hypot(z[:, 0] - centre[0], z[:, 1] - centre[1]), rest - 1)[rest - 1])

        near, far = self._reach(self.low, self.high, a, b)
        slack = np.hypot(*(b - a)) / 2 * (1 + 1e-9) + 1e-9 * radius
        inside = far < radius - slack
        rim = np.flatnonzero((near <= radius + slack) & ~inside)
        g_near, _ = self._reach(self.group_low, self.group_high, a, b)
        whole = np.bincount(self.group[~inside], minlength=len(self.nodes)) == 0
        distant = whole & (g_near > 1.5 * (self.group_high - self.group_low).max(axis=1))
        z = self.points[self._of(np.flatnonzero(inside & ~distant[self.group]))]
        total = np.zeros(len(q))
        for at in range(0, len(z), 4096):
            total += _distances_to(q, z[at : at + 4096]).sum(axis=1)
        far, weight = self.nodes[distant].reshape(-1, 2), self.weights[distant].ravel()
        for at in range(0, len(far), 4096):
            total += _distances_to(q, far[at : at + 4096]) @ weight[at : at + 4096]
        rest = need - int((self.ends - self.starts)[inside].sum())
        if rest:
            z = self.points[self._of(rim)]
            few = max(1, (1 << 17) // len(z))
            for at in range(0, len(q), few):
                d = _distances_to(q[at : at + few], z)
                if rest < d.shape[1]:
                    d.partition(rest - 1, axis=1)
                total[at : at + few] += d[:, :rest].sum(axis=1)
        return total / need, (centre, radius)


def _distances_to(q: np.ndarray, z: np.ndarray) -> np.ndarray:
    x = (q[:, :1] - z[:, 0]) ** 2
    x += (q[:, 1:] - z[:, 1]) ** 2
    return np.sqrt(x, out=x)


def _nearest_mean(d: np.ndarray, weight: np.ndarray, need: float, weighted: bool) -> np.ndarray:
    """Mean of the `need` smallest distances of each row of a matrix; weighted, a column stands for as many points as its weight."""
    if not weighted:
        k = int(need)
        return (np.partition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else d).mean(axis=1)
    order = np.argsort(d, axis=1)
    w = weight[order]
    taken = np.clip(need - (np.cumsum(w, axis=1) - w), 0, w)
    return (np.take_along_axis(d, order, axis=1) * taken).sum(axis=1) / need


def regression_scores(df: DataFrame, method: str = "outlying", **options) -> DataFrame:
    """(id, label_quality) by one of two scores: "outlying" (the default) or "residual"."""
    if method not in ("outlying", "residual"):
        raise ValueError(f"unknown method {method!r}")
    return outlying_residual_scores(df, **options) if method == "outlying" else residual_scores(df)


def regression_issues(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(id, label_quality, is_label_issue): scores under threshold x median."""
    s = residual_scores(df)
    m = s.agg(F.median("label_quality")).first()[0] or 0.0
    return s.withColumn("is_label_issue", F.col("label_quality") < F.lit(threshold * m))


# Properties of images (or of any rows) against their labels: df(id, label, fold, property ...)


def spurious_correlations(df: DataFrame, properties: list[str], baseline: str = "index") -> DataFrame:
    """(property, score): how little one property alone tells the label, 1 if it tells nothing.

    Gaussian naive Bayes on the single property, each fold predicted by the others; the score is
    1 less the mean accuracy of the folds, over 1 less a baseline accuracy, at most 1.  The baseline
    is the number of the largest class over the rows ("index", the customary score, near 0 on
    large tables) or the share of the largest class ("share").  One pass gathers sums by property,
    fold and class; training statistics are totals less the fold's own.
    """
    if baseline not in ("index", "share"):
        raise ValueError(f"unknown baseline {baseline!r}")
    long = df.select("id", "label", "fold", F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("v")) for p in properties])).alias("x")).select("id", "label", "fold", "x.*")
    long = long.where("v is not null and label is not null")
    own = long.groupBy("property", "fold", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    every = own.groupBy("property", "label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    widest = long.groupBy("property").agg(F.var_pop("v").alias("spread"))
    grid = own.select("property", "fold").distinct().join(every.withColumnsRenamed({"n": "tn", "s": "ts", "q": "tq"}), "property").join(own, ["property", "fold", "label"], "left").join(widest, "property")
    take = lambda t, o: F.col(t) - F.coalesce(o, F.lit(0))
    stats = grid.select("property", "fold", "label", "spread", take("tn", "n").alias("n"), take("ts", "s").alias("s"), take("tq", "q").alias("q")).where("n > 0")
    var = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)) + 1e-9 * F.col("spread") + 1e-300
    stats = stats.select("property", "fold", F.struct("label", F.ln("n").alias("w"), (F.col("s") / F.col("n")).alias("m"), var.alias("var")).alias("c")).groupBy("property", "fold").agg(F.sort_array(F.collect_list("c")).alias("c"))
    likelihood = F.transform("c", lambda c: F.struct((c["w"] - F.ln(c["var"]) / 2 - F.pow(F.col("v") - c["m"], 2) / (2 * c["var"])).alias("l"), c["label"].alias("label")))
    best = F.reduce(likelihood, F.element_at(likelihood, 1), lambda a, b: F.when(b["l"] > a["l"], b).otherwise(a))
    wrong = long.join(stats, ["property", "fold"]).select("property", "fold", (best["label"] != F.col("label")).cast("double").alias("miss"))
    wrong = wrong.groupBy("property", "fold").agg(F.avg("miss").alias("miss")).groupBy("property").agg(F.avg("miss").alias("miss"))
    top = F.max_by("label", F.struct("n", -F.col("label"))) if baseline == "index" else F.max("n")
    base = every.groupBy("property").agg((1 - top / F.sum("n")).alias("base"))
    return wrong.join(base, "property").select("property", F.least(F.col("miss") / F.greatest("base", F.lit(1e-8)), F.lit(1.0)).alias("score"))


def property_issues(df: DataFrame, thresholds: dict[str, float], max_prevalence: float = 0.1) -> tuple[DataFrame, list[str]]:
    """(id, is_<property>_issue ...) of rows whose property score lies under its threshold, and the properties left out.

    A property that flags more than max_prevalence of the rows says something about the table, not
    about single rows, and is left out.
    """
    flags = {p: F.coalesce(F.col(p) < F.lit(t), F.lit(False)) for p, t in thresholds.items()}
    n, *hits = df.agg(F.count(F.lit(1)), *[F.count_if(f) for f in flags.values()]).first()
    common = [p for p, h in zip(flags, hits, strict=True) if h > max_prevalence * n]
    return df.select("id", *[f.alias(f"is_{p}_issue") for p, f in flags.items() if p not in common]), common


# Noise


def noise_matrix_is_valid(noise: np.ndarray, py: np.ndarray) -> bool:
    joint = noise * py
    ps = joint.sum(axis=1)
    return abs(joint.sum() - 1) < 1e-6 and all(py[k] * ps[k] < joint[k, k] for k in range(len(py)))


def noisy_labels(df: DataFrame, noise: np.ndarray, seed: int = 0) -> DataFrame:
    """(id, label, noisy): exactly int(noise x count) rows of each (true, given) pair are flipped, chosen by a seeded hash.

    Rows are numbered within their label in 1,024 ranges of the hash, so that a hot label is no single task.
    """
    k = len(noise)
    counts = C.label_counts(df, k)
    bounds = []
    for t in range(k):
        n = [int(noise[g, t] * counts[t]) if g != t else 0 for g in range(k)]
        bounds.append(np.cumsum(n).tolist())
    hashed = df.select("id", "label", F.xxhash64("id", F.lit(seed)).alias("h")).withColumn("b", F.shiftright("h", 54))
    edges = F.element_at(F.array(*[F.array(*[F.lit(int(x)) for x in b]) for b in bounds]), F.col("label") + 1)
    ranked = C.numbered(hashed, ["label"], [F.col("h"), F.col("id")], "r").withColumn("g", F.size(F.filter(edges, lambda x: x < F.col("r"))))
    return ranked.select("id", "label", F.when(F.col("g") < k, F.col("g")).otherwise(F.col("label")).alias("noisy"))


def shares_of(total: float, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> np.ndarray:
    """n random numbers in [low, high] with a given sum, if there are any.

    The room above low is shared out at random; what would pass high is handed on to those with
    room left, in proportion to that room, until all of it is placed.
    """
    if not n * low - 1e-12 <= total <= n * high + 1e-12:
        raise ValueError(f"{n} numbers in [{low}, {high}] can't sum to {total}")
    r = np.random.default_rng(seed)
    x = np.full(n, low) + r.dirichlet(np.ones(n)) * (total - n * low)
    while (over := np.clip(x - high, 0, None).sum()) > 1e-12:
        x = np.minimum(x, high)
        room = high - x
        x += over * room / room.sum()
    return np.minimum(x, high)


def balls_in_bins(balls: int, bins: int, least: int = 0, most: int | None = None, seed: int = 0) -> np.ndarray:
    """Random numbers of balls in bins, each between least and most, that sum to balls."""
    most = balls if most is None else most
    if not bins * least <= balls <= bins * most:
        raise ValueError(f"{balls} balls don't go into {bins} bins of {least} to {most}")
    r = np.random.default_rng(seed)
    out = np.full(bins, least)
    for _ in range(balls - bins * least):
        out[r.choice(np.flatnonzero(out < most))] += 1
    return out


def random_noise_matrix(k: int, trace: float, py: np.ndarray | None = None, seed: int = 0, tries: int = 1000) -> np.ndarray:
    """A K x K matrix with columns that sum to one and a given trace, drawn until it is valid for the prior."""
    r = np.random.default_rng(seed)
    py = np.full(k, 1 / k) if py is None else np.asarray(py)
    for _ in range(tries):
        own = np.full(k, trace / k) + r.uniform(-1, 1, k) * min(trace / k, 1 - trace / k) * 0.5
        own += (trace - own.sum()) / k
        m = r.dirichlet(np.ones(k - 1), k).T * (1 - own)
        out = np.zeros((k, k))
        for j in range(k):
            out[[i for i in range(k) if i != j], j] = m[:, j]
            out[j, j] = own[j]
        if (own > 0).all() and (own <= 1).all() and noise_matrix_is_valid(out, py):
            return out
    raise ValueError("no valid noise matrix found for this trace and prior")
