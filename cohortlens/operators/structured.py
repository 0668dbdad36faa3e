"""Multi-label, token, pixel and box data: nested labels as arrays or long rows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.session import once, ship_package
from . import confident as C
from .contracts import aggregation_weights

# Multi-label: (id, bits, probs)


def one_hot(labels: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.array_contains(labels, c).cast("int"))


def label_list(bits: Column) -> Column:
    return F.filter(F.transform(bits, lambda b, i: F.when(b == 1, i)), lambda x: x.isNotNull())


def class_scores(df: DataFrame, method: str = "self_confidence", thresholds: np.ndarray | None = None) -> Column:
    """Score of each class of a row, as a two-class problem; with thresholds [class, bit], of the adjusted probabilities."""
    own = F.zip_with("bits", "probs", lambda b, p: F.when(b == 1, p).otherwise(1 - p))
    if thresholds is not None:
        limits = F.array(*[F.array(*[F.lit(float(max(t) - x)) for x in t]) for t in thresholds])
        raised = F.transform(F.arrays_zip(F.col("probs").alias("p"), limits.alias("t")), lambda x: F.array(1 - x["p"] + F.get(x["t"], F.lit(0)), x["p"] + F.get(x["t"], F.lit(1))))
        own = F.zip_with("bits", raised, lambda b, q: F.get(q, b.cast("int")) / (F.get(q, F.lit(0)) + F.get(q, F.lit(1))))
    if method == "self_confidence":
        return own
    if method == "normalized_margin":
        return F.transform(own, lambda x: (2 * x - 1 + 1) / 2)
    return F.transform(own, lambda x: A.confidence_weighted_entropy(F.array(1 - x, x), F.lit(1)))


def multilabel_quality(df: DataFrame, method: str = "self_confidence", aggregate: str = "exponential_moving_average", alpha: float = 0.8, temperature: float = 0.1) -> DataFrame:
    options = {"exponential_moving_average": {"alpha": alpha}, "softmin": {"temperature": temperature}}.get(aggregate, {})
    return PooledScorer(method, Pool(aggregate, **options))(df)


POOLS: dict[str, Callable[..., Column]] = {
    "exponential_moving_average": A.moving_average,
    "softmin": A.softmin,
    "mean": lambda s: A.total(s) / F.size(s),
    "min": F.array_min,
    "max": F.array_max,
    "median": lambda s: (F.element_at(F.sort_array(s), ((F.size(s) + 1) / 2).cast("int")) + F.element_at(F.sort_array(s), (F.size(s) / 2).cast("int") + 1)) / 2,
}


class Pool:
    """How the scores of a row's classes become one: a name of POOLS, or a function from the column of scores to a column.

    A plain Python function of a list is applied by a Pandas UDF.
    """

    def __init__(self, method: str | Callable[..., Column] = "exponential_moving_average", *, python: bool = False, **options):
        if isinstance(method, str) and method not in POOLS:
            raise ValueError(f"unknown pool {method!r}: {sorted(POOLS)}")
        self.method, self.python, self.options = method, python, options

    def __call__(self, scores: Column) -> Column:
        if not self.python:
            return (POOLS[self.method] if isinstance(self.method, str) else self.method)(scores, **self.options)
        f, options = self.method, self.options

        @F.pandas_udf("double")
        def pooled_(column: pd.Series) -> pd.Series:
            return column.map(lambda x: float(f(x, **options)))

        return pooled_(scores)


class PooledScorer:
    """A score of each class, pooled."""

    def __init__(self, method: str = "self_confidence", pool: Pool | None = None, adjust: bool = False):
        if adjust and method == "confidence_weighted_entropy":
            raise ValueError("confidence_weighted_entropy can't be adjusted")
        self.method, self.pool, self.adjust = method, pool or Pool(alpha=0.8), adjust

    def __call__(self, df: DataFrame) -> DataFrame:
        """(id, label_quality)."""
        s = class_scores(df, self.method, multilabel_stats(df)[0] if self.adjust else None)
        return df.select("id", self.pool(s).alias("label_quality"))


def multilabel_scores_per_class(df: DataFrame, method: str = "self_confidence") -> DataFrame:
    """(id, class, label_quality)."""
    return df.select("id", F.posexplode(class_scores(df, method)).alias("class", "label_quality"))


# The two-class problems of all classes at once: rows of (id, class, label, pred_probs) with pred_probs = (1 - p, p)


def class_rows(df: DataFrame) -> DataFrame:
    x = df.select("id", F.posexplode(F.arrays_zip("bits", "probs")).alias("class", "x"))
    return x.select("id", "class", F.col("x.bits").cast("int").alias("label"), F.array(1 - F.col("x.probs"), F.col("x.probs")).alias("pred_probs"))


def multilabel_stats(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and numbers of rows, [class, bit], from one pass; one row a class and bit comes to the driver."""
    rows = class_rows(df).groupBy("class", "label").agg(F.avg(A.own_prob(C.P(), C.LABEL())).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    k = max((r["class"] for r in rows), default=-1) + 1
    t, n = np.full((k, 2), C.ABSENT), np.zeros((k, 2), np.int64)
    for r in rows:
        t[r["class"], r["label"]], n[r["class"], r["label"]] = max(r["t"], C.FLOOR), r["n"]
    return t, n


def _of_class(values) -> Column:
    """The entry of an array (of arrays) for the row's class."""
    lit = lambda v: F.array(*[lit(x) for x in v]) if np.ndim(v) else F.lit(v.item() if hasattr(v, "item") else v)
    return F.element_at(lit(np.asarray(values)), F.col("class") + 1)


def class_guess(t: np.ndarray) -> Column:
    """The bit that reaches its class's threshold; of both the likelier one; null if none does."""
    limits = _of_class(t)
    zero, one = (F.get(C.P(), F.lit(b)) >= F.get(limits, F.lit(b)) - C.EPS for b in (0, 1))
    return F.when(zero & one, A.argmax(C.P())).when(one, F.lit(1)).when(zero, F.lit(0))


def multilabel_joint(df: DataFrame, calibrate: bool = True, stats: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """[class, given, guess] counts; the diagonals are at least 1 before calibration."""
    t, n = stats or multilabel_stats(df)
    m = np.zeros((len(t), 2, 2), np.int64)
    for r in class_rows(df).groupBy("class", "label", class_guess(t).alias("g")).count().collect():
        if r["g"] is not None:
            m[r["class"], r["label"], r["g"]] = r["count"]
    m[:, (0, 1), (0, 1)] = np.maximum(m[:, (0, 1), (0, 1)], 1)
    return calibrated_multilabel(m, n) if calibrate else m


def calibrated_multilabel(joint: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.stack([C.cells.calibrated(j, n) for j, n in zip(joint, counts, strict=True)]) if len(joint) else joint


def estimate_multilabel_joint(df: DataFrame, joint: np.ndarray | None = None) -> np.ndarray:
    """[class, given, guess] shares, each class's sum to 1."""
    joint = multilabel_joint(df) if joint is None else joint
    return joint / joint.sum(axis=(1, 2), keepdims=True)


def multilabel_issues_per_class(
    df: DataFrame, filter_by: str = "prune_by_noise_rate", *, frac_noise: float = 1.0, min_examples_per_class: int = 1, joint: np.ndarray | None = None, num_to_remove_per_class: list[list[int]] | None = None
) -> DataFrame:
    """(id, class, is_label_issue): the filters of two classes, for all classes in the same passes."""
    if filter_by not in C.POLICIES:
        raise ValueError(f"unknown filter {filter_by!r}")
    rows, near = class_rows(df), A.near_given(C.P(), C.LABEL())
    own, order = A.own_prob(C.P(), C.LABEL()), [F.col("m"), F.col("id")]
    t, counts = stats = multilabel_stats(df)
    off = F.coalesce(class_guess(t) != C.LABEL(), F.lit(False)) & ~near
    if filter_by == "predicted_neq_given":
        return rows.select("id", "class", ((A.argmax(C.P()) != C.LABEL()) & ~near).alias("is_label_issue"))
    if filter_by == "confident_learning":
        return rows.select("id", "class", off.alias("is_label_issue"))
    if filter_by.startswith("low_"):  # both scores have the order of the own probability
        found = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count_if(off).alias("n")).collect()}
        wanted = rows.select("id", "class", own.alias("m"), _of_class([found.get(c, 0) for c in range(len(t))]).alias("n"))
        hits = [C.first_of(wanted, ["class"], order, F.col("m"), "n")]
    else:
        joint = multilabel_joint(df, stats=stats) if joint is None else joint
        quotas = np.stack([C.cells.prune_quotas(j, min_examples_per_class, frac_noise) for j in joint])
        if num_to_remove_per_class is not None:
            quotas = np.stack([C.cells.quotas_for_removals(q, n, np.asarray(x)) for q, n, x in zip(quotas, counts, num_to_remove_per_class, strict=True)])
        enough = (counts > min_examples_per_class) & (counts > 1)
        both = [0, 1]
        by_rate = np.where(enough, quotas[:, [1, 0], both], 0)  # [class, given]: rows to remove as the other one
        by_class = np.where(enough, np.maximum(counts - quotas[:, both, both], 0), 0)
        hits = []
        for n in {"prune_by_noise_rate": [by_rate], "prune_by_class": [by_class], "both": [by_rate, by_class]}[filter_by]:
            wanted = rows.select("id", "class", "label", own.alias("m"), F.element_at(_of_class(n), C.LABEL() + 1).alias("n"))
            hits.append(C.first_of(wanted.where("n > 0"), ["class", "label"], order, F.col("m"), "n"))
    out = rows.select("id", "class", near.alias("near"))
    flag = ~F.col("near")
    for i, h in enumerate(hits):
        out = out.join(h.select("id", "class", F.lit(True).alias(f"hit{i}")), ["id", "class"], "left")
        flag = flag & F.coalesce(f"hit{i}", F.lit(False))
    return out.select("id", "class", (flag if not filter_by.startswith("low_") else F.coalesce("hit0", F.lit(False))).alias("is_label_issue"))


def multilabel_issues(df: DataFrame, filter_by: str = "prune_by_noise_rate", *, rank_by: str | None = None, low_memory: bool = False, **kw) -> DataFrame:
    """(id, is_label_issue): flagged in some class; with rank_by only the issues and their score, lowest first.

    The low_ filters rank whole rows by their pooled score, as many as confident_learning flags;
    with low_memory they rank inside each class.
    """
    if filter_by.startswith("low_") and not low_memory:
        n = num_multilabel_issues(df)
        low = C.lowest(PooledScorer()(df), "label_quality", n).select("id", F.lit(True).alias("hit"))
        out = df.select("id").join(low, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("is_label_issue"))
    else:
        out = multilabel_issues_per_class(df, filter_by, **kw).groupBy("id").agg(F.bool_or("is_label_issue").alias("is_label_issue"))
    if rank_by is None:
        return out
    scores = PooledScorer(rank_by)(df).withColumnRenamed("label_quality", "score")
    return out.where("is_label_issue").join(scores, "id").select("id", "score").orderBy("score", "id")


def num_multilabel_issues(df: DataFrame) -> int:
    """Rows that the confident_learning filter flags in some class; the flags of a row are looked at together, without a shuffle."""
    t, _ = multilabel_stats(df)
    parts = [F.struct(F.lit(c).alias("class"), F.get("bits", F.lit(c)).cast("int").alias("label"), F.get("probs", F.lit(c)).alias("p")) for c in range(len(t))]
    hit = F.lit(False)
    for c in range(len(t)):
        x = parts[c]
        q = F.array(1 - x["p"], x["p"])
        zero, one = 1 - x["p"] >= float(t[c, 0]) - C.EPS, x["p"] >= float(t[c, 1]) - C.EPS
        g = F.when(zero & one, A.argmax(q)).when(one, F.lit(1)).when(zero, F.lit(0))
        hit = hit | (F.coalesce(g != x["label"], F.lit(False)) & ~A.near_given(q, x["label"]))
    return df.agg(F.count_if(hit)).first()[0]


def common_multilabel_issues(df: DataFrame, filter_by: str = "prune_by_noise_rate") -> DataFrame:
    """(class, given, num_examples, issue_probability)."""
    flags = multilabel_issues_per_class(df, filter_by)
    long = df.select("id", F.posexplode("bits").alias("class", "given"))
    by = flags.join(long, ["id", "class"]).groupBy("class", "given").agg(F.count_if("is_label_issue").alias("num_examples"))
    return by.withColumn("issue_probability", F.col("num_examples") / F.lit(float(max(1, df.count()))))


def multilabel_class_quality(df: DataFrame, filter_by: str = "prune_by_noise_rate") -> DataFrame:
    """(class, label_issues, inverse_label_issues, label_noise, inverse_label_noise, label_quality), worst first: one row a class."""
    of = lambda given, c: F.max(F.when(F.col("given") == given, F.col(c)))
    by = common_multilabel_issues(df, filter_by).groupBy("class").agg(
        of(1, "num_examples").alias("label_issues"), of(0, "num_examples").alias("inverse_label_issues"), of(1, "issue_probability").alias("label_noise"), of(0, "issue_probability").alias("inverse_label_noise")
    )
    return by.withColumn("label_quality", 1 - F.col("label_noise")).orderBy("label_quality", "class")


def multilabel_health(df: DataFrame) -> float:
    """1 less the share of rows with an issue in some class."""
    hits, n = multilabel_issues(df).agg(F.count_if("is_label_issue"), F.count(F.lit(1))).first()
    return 1.0 - hits / max(1, n)


def multilabel_health_summary(df: DataFrame) -> dict:
    return {"score": multilabel_health(df), "classes": multilabel_class_quality(df), "issues": common_multilabel_issues(df)}


def class_prior(df: DataFrame) -> DataFrame:
    """(class, p0, p1)."""
    return df.select(F.posexplode("bits").alias("class", "bit")).groupBy("class").agg((1 - F.avg("bit")).alias("p0"), F.avg("bit").alias("p1"))


def best_cutoff(df: DataFrame, cutoffs=tuple(round(0.05 * i, 2) for i in range(1, 18))) -> tuple[float, float]:
    """The cut-off of largest micro-F1 and that F1, the lowest of equal ones; all are tried in one pass."""

    def count(hit) -> Column:
        return F.sum(F.aggregate(F.zip_with("bits", "probs", lambda b, p: hit(b, p).cast("int")), F.lit(0), lambda a, x: a + x))

    def counts(i: int, c: float) -> list[Column]:
        return [count(lambda b, p: (b == 1) & (p >= F.lit(c))).alias(f"tp{i}"), count(lambda b, p: (b == 1) != (p >= F.lit(c))).alias(f"w{i}")]

    cells_ = [x for i, c in enumerate(cutoffs) for x in counts(i, c)]
    r = df.agg(*cells_).first()
    f1 = [2 * (r[f"tp{i}"] or 0) / max(1, 2 * (r[f"tp{i}"] or 0) + (r[f"w{i}"] or 0)) for i in range(len(cutoffs))]
    best = int(np.argmax(f1))
    return cutoffs[best], f1[best]


def cut_predictions(df: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(id, bits) predicted by a cut-off, by default the best one."""
    c = best_cutoff(df)[0] if cutoff is None else cutoff
    return df.select("id", F.transform("probs", lambda p: (p >= F.lit(c)).cast("int")).alias("bits"))


# Tokens: (sentence_id, token_id, token, label, pred_probs)

def _token_id() -> Column:
    return F.col("sentence_id") * (1 << 24) + F.col("token_id")


def token_issues(df: DataFrame, filter_by: str = "prune_by_noise_rate", rank_by: str | None = None, **kw) -> DataFrame:
    """(sentence_id, token_id) of the flagged tokens; with rank_by also their score, lowest first."""
    flat = df.withColumn("id", _token_id())
    hit = C.find_label_issues(flat, filter_by, rank_by=rank_by, **kw)
    hit = hit.where("is_label_issue").drop("is_label_issue") if rank_by is None else hit
    place = [F.floor(F.col("id") / (1 << 24)).cast("bigint").alias("sentence_id"), (F.col("id") % (1 << 24)).cast("bigint").alias("token_id")]
    return hit.select(*place, *(["score"] if rank_by else []))


def token_scores(df: DataFrame, method: str = "self_confidence") -> DataFrame:
    """(sentence_id, token_id, score)."""
    return df.select("sentence_id", "token_id", C._SCORES[method](C.P(), C.LABEL()).alias("score"))


def sentence_scores(df: DataFrame, method: str = "min", temperature: float = 0.05) -> DataFrame:
    """(sentence_id, score): the least of the tokens' own probabilities, or their soft minimum (the mean at infinite temperature).

    Soft minima are two sums a sentence, so that no sentence is gathered in one row.
    """
    own = A.own_prob(F.col("pred_probs"), F.col("label"))
    if method == "min" or temperature == 0:
        score = F.min(own)
    elif math.isinf(temperature):
        score = F.avg(own)
    else:  # scores are at most 1, so exp((1 - s) / T - 1 / T) is too
        e = F.exp(-own / temperature)
        score = F.sum(own * e) / F.sum(e)
    return df.groupBy("sentence_id").agg(score.alias("score"))


def issues_from_scores(scores: DataFrame, threshold: float = 0.1, score: str = "score", inclusive: bool = False) -> DataFrame:
    """The rows below a threshold (or at it, if inclusive), lowest first."""
    c = F.col(score)
    others = [x for x in scores.columns if x != score]
    return scores.where(c <= threshold if inclusive else c < threshold).orderBy(score, *others)


def span_rows(df: DataFrame) -> DataFrame:
    """Tokens with one probability p of lying in a span, as tokens of two classes."""
    return df.withColumn("pred_probs", F.array(1 - F.col("p"), F.col("p"))).drop("p")


def span_issues(df: DataFrame, **kw) -> DataFrame:
    return token_issues(span_rows(df), **kw)


def span_scores(df: DataFrame, **kw) -> DataFrame:
    return sentence_scores(span_rows(df), **kw)


_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def sentence_text(words: Column) -> Column:
    """The words of an array as a sentence: a space before each that is no punctuation, before "-" and "(", and none after "(" or before an apostrophe."""
    tight = lambda w: (F.instr(F.lit(_PUNCTUATION), w) > 0) & ~w.isin("-", "(")
    joined = F.array_join(F.transform(words, lambda w: F.when(tight(w), w).otherwise(F.concat(F.lit(" "), w))), "")
    return F.trim(F.replace(F.replace(joined, F.lit(" '"), F.lit("'")), F.lit("( "), F.lit("(")))


def is_plain_sentence(sentence: Column) -> Column:
    """Longer than one character and without "#"."""
    return (F.length(sentence) > 1) & ~F.contains(sentence, F.lit("#"))


def replaced(token: Column, replace: tuple[tuple[str, str], ...] = (("#", ""),)) -> Column:
    """Literal replacements, all in one pass from the left: what one puts in, another doesn't change."""
    keys = F.lit("(?s)" + "|".join(_quoted(k) for k, _ in replace) + "|.")
    names = F.create_map(*[F.lit(x) for pair in dict(replace).items() for x in pair])
    return F.array_join(F.transform(F.regexp_extract_all(token, keys, F.lit(0)), lambda x: F.coalesce(F.element_at(names, x), x)), "")


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def mapped(entities: Column, to: list[int]) -> Column:
    """Class ids of an array by a table of new ids."""
    return F.transform(entities, lambda x: F.element_at(F.array(*[F.lit(int(x)) for x in to]), x.cast("int") + 1))


def coloured(sentence: Column, word: str) -> Column:
    """A word of a sentence between terminal codes for red: where it stands as a whole word, and if it never does, anywhere."""
    red = f"\x1b[31m{word}\x1b[0m"
    whole = F.lit(rf"\b{_quoted(word)}\b")
    return F.when(F.regexp_like(sentence, whole), F.regexp_replace(sentence, whole, F.lit(re.sub(r"([\\$])", r"\\\1", red)))).otherwise(F.replace(sentence, F.lit(word), F.lit(red)))


def show_token_issues(df: DataFrame, issues: DataFrame, top: int = 20, exclude: list[tuple[int, int]] = (), names: list[str] | None = None) -> DataFrame:
    """(sentence_id, token_id, note, sentence) of the first issues: the token with its given and predicted class, and its sentence."""
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in names]), c + 1) if names else c.cast("string")
    given, guess = F.col("label"), A.argmax(F.col("pred_probs"))
    rows = df.join(issues.select("sentence_id", "token_id"), ["sentence_id", "token_id"]).withColumn("guess", guess)
    for a, b in exclude:
        rows = rows.where(~((given == a) & (F.col("guess") == b)))
    rows = rows.orderBy(A.own_prob(F.col("pred_probs"), given), "sentence_id", "token_id").limit(top)
    note = F.format_string("%s: given %s, predicted %s", F.col("token"), name(given), name(F.col("guess")))
    rows = rows.select("sentence_id", "token_id", note.alias("note"))
    words = df.join(rows.select("sentence_id").distinct(), "sentence_id").groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_id", "token"))).alias("w"))
    return rows.join(words, "sentence_id").select("sentence_id", "token_id", "note", sentence_text(F.col("w.token")).alias("sentence"))


def common_token_issues(df: DataFrame, issues: DataFrame, exclude: list[tuple[int, int]] = ()) -> DataFrame:
    """(token, given_label, predicted_label, num_label_issues)."""
    rows = df.join(issues, ["sentence_id", "token_id"]).select("token", F.col("label").alias("given_label"), A.argmax(F.col("pred_probs")).alias("predicted_label"))
    for a, b in exclude:
        rows = rows.where(~((F.col("given_label") == a) & (F.col("predicted_label") == b)))
    return rows.groupBy("token", "given_label", "predicted_label").agg(F.count(F.lit(1)).alias("num_label_issues"))


def filter_by_token(df: DataFrame, issues: DataFrame, token: str) -> DataFrame:
    return df.where(F.lower("token") == token.lower()).join(issues, ["sentence_id", "token_id"]).select("sentence_id", "token_id")


def merged_probs(p: Column, groups: list[int]) -> Column:
    """Probabilities summed over merged classes; group -1 is dropped and the rest renormalised."""
    k = max(groups) + 1
    sums = F.array(*[sum((F.element_at(p, i + 1) for i, g in enumerate(groups) if g == c), F.lit(0.0)) for c in range(k)])
    return A.normalized(sums) if -1 in groups else sums


# Pixels: (image_id, y, x, label, pred_probs)


def image_scores(df: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Soft minimum of the own-class probabilities of an image, as two sums, so that no image is gathered in one row."""
    own = A.own_prob(F.col("pred_probs"), F.col("label"))
    e = F.exp((1 - own) / temperature - 1 / temperature)
    return df.groupBy("image_id").agg((F.sum(own * e) / F.sum(e)).alias("score"))


def shrunk(df: DataFrame, factor: int) -> DataFrame:
    """Blocks of factor x factor pixels as one: the rounded mean label and the mean probabilities, made to sum to 1."""
    if df.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w")).where(((F.col("h") + 1) % factor != 0) | ((F.col("w") + 1) % factor != 0)).limit(1).count():
        raise ValueError(f"heights and widths can't be divided by {factor}")
    k = C.num_classes(df)
    small = df.groupBy("image_id", *[F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]).agg(
        F.bround(F.avg("label")).cast("int").alias("label"), F.array(*[F.avg(F.get("pred_probs", F.lit(c))) for c in range(k)]).alias("pred_probs")
    )
    return small.withColumn("pred_probs", A.normalized(F.col("pred_probs")))


def pixel_issues(df: DataFrame, downsample: int = 1) -> DataFrame:
    """(image_id, y, x) of flagged pixels: the lowest scores, as many as the batched count says, less those predicted as labelled.

    With downsample, blocks are flagged, and the pixels of a flagged block are looked at one by one.
    """
    small = shrunk(df, downsample) if downsample > 1 else df
    n = C.batched_issue_count(small)
    scored = small.select(F.struct("image_id", "y", "x").alias("id"), A.own_prob(C.P(), C.LABEL()).alias("s"))
    low = C.lowest(scored, "s", n).select("id.*")
    if downsample > 1:
        low = low.toDF("image_id", "by", "bx")
        at = df.withColumn("by", F.floor(F.col("y") / downsample).cast("int")).withColumn("bx", F.floor(F.col("x") / downsample).cast("int"))
        low = at.join(low, ["image_id", "by", "bx"])
    else:
        low = df.join(low, ["image_id", "y", "x"])
    return low.where(A.argmax(C.P()) != C.LABEL()).select("image_id", "y", "x")


def image_issue_scores(df: DataFrame, downsample: int = 1) -> DataFrame:
    """(image_id, score): 1 less the share of flagged pixels."""
    bad = pixel_issues(df, downsample).groupBy("image_id").agg(F.count(F.lit(1)).alias("bad"))
    return df.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).join(bad, "image_id", "left").select("image_id", (1 - F.coalesce("bad", F.lit(0)) / F.col("n")).alias("score"))


def low_pixels(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(image_id, y, x, score) of pixels with an own probability under a threshold."""
    return df.select("image_id", "y", "x", A.own_prob(C.P(), C.LABEL()).alias("score")).where(F.col("score") < threshold)


def low_images(scores: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(image_id, score), lowest first: the images under a threshold and the one that follows them."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    n = scores.where(F.col("score") < threshold).count() + 1
    return scores.orderBy("score", "image_id").limit(n)


def common_pixel_issues(df: DataFrame, issues: DataFrame, exclude: list[int] = (), top: int | None = None) -> DataFrame:
    """(given_label, predicted_label, num_pixel_issues), most first."""
    rows = df.join(issues, ["image_id", "y", "x"]).select(F.col("label").alias("given_label"), A.argmax(F.col("pred_probs")).alias("predicted_label"))
    if exclude:
        rows = rows.where(~F.col("predicted_label").isin(*exclude))
    out = rows.groupBy("given_label", "predicted_label").agg(F.count(F.lit(1)).alias("num_pixel_issues")).orderBy(F.desc("num_pixel_issues"), "given_label", "predicted_label")
    return out if top is None else out.limit(top)


def pixels_of_class(df: DataFrame, issues: DataFrame, c: int) -> DataFrame:
    """(image_id, y, x) of the issues that are given or predicted as a class."""
    return df.join(issues, ["image_id", "y", "x"]).where((C.LABEL() == c) | (A.argmax(C.P()) == c)).select("image_id", "y", "x")


def images_by_issues(issues: DataFrame, top: int | None = None) -> DataFrame:
    """(image_id, num_pixel_issues), most first."""
    out = issues.groupBy("image_id").agg(F.count(F.lit(1)).alias("num_pixel_issues")).orderBy(F.desc("num_pixel_issues"), "image_id")
    return out if top is None else out.limit(top)


# Boxes: labels (image_id, box_id, x1, y1, x2, y2, label), predictions with p

ALPHA, HIGH, LOW, OVERLAP, TEMPERATURE = 0.9, 0.95, 0.5, 0.95, 0.1
IOU_STEPS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def iou(a: str, b: str) -> Column:
    c = lambda s, n: F.col(f"{s}.{n}")
    w = F.greatest(F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")), F.lit(0.0))
    h = F.greatest(F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")), F.lit(0.0))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-6))


def box_pairs(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """All label x prediction pairs inside an image: iou and similarity."""
    mid = lambda s, u, v: (F.col(f"{s}.{u}") + F.col(f"{s}.{v}")) / 2
    dist = F.sqrt(F.pow(mid("l", "x1", "x2") - mid("p", "x1", "x2"), 2) + F.pow(mid("l", "y1", "y2") - mid("p", "y1", "y2"), 2))
    j = labels.alias("l").join(predictions.alias("p"), F.col("l.image_id") == F.col("p.image_id"))
    return j.select(
        F.col("l.image_id").alias("image_id"), F.col("l.box_id").alias("box_id"), F.col("l.label").alias("label"), F.col("p.box_id").alias("pred_id"), F.col("p.label").alias("pred_label"),
        F.col("p.p").alias("p"), iou("l", "p").alias("iou"), (ALPHA * iou("l", "p") + (1 - ALPHA) * F.exp(-0.1 * dist)).alias("sim"),
    )


def min_similarity(pairs: DataFrame) -> float:
    return pairs.where("sim > 0").agg(F.min("sim")).first()[0] or 1.0


def overlooked_boxes(pairs: DataFrame, predictions: DataFrame, least: float) -> DataFrame:
    """(image_id, pred_id, score) of confident predictions that touch no label."""
    seen = pairs.groupBy("image_id", "pred_id").agg(F.max("iou").alias("best"), F.max(F.when(F.col("label") == F.col("pred_label"), F.col("sim"))).alias("same"))
    free = predictions.where(F.col("p") >= HIGH).select("image_id", F.col("box_id").alias("pred_id"), "p")
    j = free.join(seen, ["image_id", "pred_id"], "left").where(F.coalesce("best", F.lit(0.0)) == 0)
    return j.select("image_id", "pred_id", F.coalesce("same", F.lit(least) * (1 - F.col("p"))).alias("score"))


def badly_located_boxes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    best = pairs.where((F.col("label") == F.col("pred_label")) & (F.col("p") > LOW) & (F.col("iou") > 0)).groupBy("image_id", "box_id").agg(F.max("sim").alias("s"))
    return labels.select("image_id", "box_id").join(best, ["image_id", "box_id"], "left").select("image_id", "box_id", F.coalesce("s", F.lit(1.0)).alias("score"))


def swapped_boxes(pairs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    best = pairs.where((F.col("label") != F.col("pred_label")) & (F.col("p") > HIGH)).groupBy("image_id", "box_id").agg(F.max("sim").alias("s"))
    clash = (
        labels.alias("l").join(labels.alias("p"), (F.col("l.image_id") == F.col("p.image_id")) & (F.col("l.label") != F.col("p.label")))
        .where(iou("l", "p") >= OVERLAP).select(F.col("l.image_id").alias("image_id"), F.col("l.box_id").alias("box_id")).distinct().withColumn("clash", F.lit(True))
    )
    j = labels.select("image_id", "box_id").join(best, ["image_id", "box_id"], "left").join(clash, ["image_id", "box_id"], "left")
    return j.select("image_id", "box_id", F.when(F.col("clash"), F.lit(least)).when(F.col("s").isNull(), 1.0).otherwise(F.greatest(F.lit(least), 1 - F.col("s"))).alias("score"))


WEIGHTS = {"overlooked": 1 / 3, "badloc": 1 / 3, "swap": 1 / 3}


def box_image_scores(labels: DataFrame, predictions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(image_id, overlooked, badloc, swap, label_quality): weighted geometric mean of the three, by default with equal weights."""
    weights = weights or WEIGHTS
    aggregation_weights(**weights)
    found = _scored(once(images_with_boxes(labels, predictions).select("image_id", *SCORED)))
    out = found.select("image_id", *[F.when(F.size(c) == 0, 1.0).otherwise(A.softmin(F.sort_array(c), TEMPERATURE)).alias(c) for c in ("overlooked", "badloc", "swap")])
    mean = sum((F.lit(float(w)) * F.ln(F.col(c) + 1e-100) for c, w in weights.items()), F.lit(0.0))
    return out.withColumn("label_quality", F.exp(mean))


def likely_boxes(predictions: DataFrame, threshold: float) -> DataFrame:
    """Predictions of at least a probability."""
    return predictions.where(F.col("p") >= threshold)


def least_probability(predictions: DataFrame) -> float:
    """The least probability of any prediction, 1 without any."""
    least = predictions.agg(F.min("p")).first()[0]
    return 1.0 if least is None else min(least, 1.0)


def flat_predictions(nested: DataFrame) -> DataFrame:
    """(image_id, box_id, x1, y1, x2, y2, label, p) of images with an array by class of arrays of (x1, y1, x2, y2, p)."""
    by_class = nested.select("image_id", F.posexplode("boxes").alias("label", "b")).select("image_id", "label", F.posexplode("b").alias("nth", "box"))
    before = F.row_number().over(W.partitionBy("image_id").orderBy("label", "nth")) - 1
    return by_class.select("image_id", before.alias("box_id"), *[F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], "label", F.get("box", F.lit(4)).alias("p"))


def corner_and_size(boxes: DataFrame) -> DataFrame:
    """Boxes by corner, width and height (x, y, w, h) in place of two corners."""
    others = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    return boxes.select(*others, F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def box_counts(labels: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """(image_id, n_boxes) and, with predictions, n_predicted; an image that one side lacks has 0 there. Most boxes first."""
    n = labels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_boxes"))
    if predictions is None:
        return n.orderBy(F.desc("n_boxes"), "image_id")
    m = predictions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_predicted"))
    both = n.join(m, "image_id", "full").fillna(0, ["n_boxes", "n_predicted"])
    return both.orderBy(F.desc("n_boxes"), F.desc("n_predicted"), "image_id")


def each_box_area(labels: DataFrame) -> DataFrame:
    """(image_id, box_id, label, area)."""
    return labels.select("image_id", "box_id", "label", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


def box_areas(labels: DataFrame) -> DataFrame:
    a = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("avg_area"), F.min(a).alias("min_area"), F.max(a).alias("max_area"))


def box_class_share(labels: DataFrame) -> DataFrame:
    n = labels.count()
    return labels.groupBy("label").agg(F.round(F.count(F.lit(1)) / F.lit(n + 1e-6), 2).alias("share"))


SCORED = ("least", "label", "badloc", "swap", "free_label", "free", "free_p")
HITS = ("hit_label", "hit_id", "hit_p", "hit")


def images_with_boxes(labels: DataFrame, predictions: DataFrame, thresholds=IOU_STEPS) -> DataFrame:
    """One row an image, from one shuffle of both tables by image; pairs of boxes are formed 2^18 at a time and not kept.

    least: the least similarity above 0 of a pair (null without one).  By label box: label, badloc,
    and swap before the floor: 1 less the best similarity to a confident prediction of another class
    (1 without any, -1 if it lies on a label of another class).  By confident prediction that touches no label:
    free_label, free (the best similarity to a label of its class, null without one), free_p.  By prediction:
    hit_label, hit_id, hit_p and the bits of the thresholds at which it is a true positive: it goes for the label
    of its class that it overlaps most, and of those that go for one label the most confident gets it.
    Ids tell the boxes of an image apart; boxes without all coordinates overlap nothing.
    """
    ship_package(labels.sparkSession)
    image = dict(labels.dtypes)["image_id"]
    side = lambda t, tag, p: t.select("image_id", F.lit(tag).alias("tag"), F.col("box_id").cast("bigint").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("label").cast("int").alias("label"), p.cast("double").alias("p"))
    rows = side(labels, 0, F.lit(None)).unionByName(side(predictions, 1, F.col("p"))).repartition("image_id").sortWithinPartitions("image_id", "tag")
    steps = tuple(float(t) for t in thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            start = pa.compute.index(b.column(0), b.column(0)[b.num_rows - 1]).as_py() if b.column(0)[b.num_rows - 1].is_valid else pa.compute.sum(pa.compute.is_valid(b.column(0))).as_py()
            if start:
                held[-1] = b.slice(0, start)
                yield _image_rows(held, steps)
                held = [b.slice(start)]
        if held:
            yield _image_rows(held, steps)

    kinds = "least double, label array<int>, badloc array<double>, swap array<double>, free_label array<int>, free array<double>, free_p array<double>, hit_label array<int>, hit_id array<bigint>, hit_p array<double>, hit array<bigint>"
    return rows.mapInArrow(run, f"image_id {image}, {kinds}").where("image_id is not null")


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.maximum(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0)
    h = np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0)
    area = lambda z: (z[:, 2] - z[:, 0]) * (z[:, 3] - z[:, 1])
    return w * h / np.maximum(area(a) + area(b) - w * h, 1e-6)


def _image_rows(held: list[pa.RecordBatch], steps: tuple[float, ...]) -> pa.RecordBatch:
    """The rows of images_with_boxes for whole images."""
    t = pa.Table.from_batches(held).combine_chunks()
    images = t.column(0).combine_chunks()
    code = images.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    names = images.dictionary_encode("encode").dictionary
    tag, ids, cls, p = t["tag"].to_numpy(), t["box_id"].to_numpy(), t["label"].to_numpy(), t["p"].to_numpy()
    known = np.asarray(t["label"].is_valid())
    cls = np.where(known, np.nan_to_num(cls), -1).astype(np.int64)
    box = np.stack([t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
    n = len(names)
    is_label = tag == 0
    own, guess = np.flatnonzero(is_label), np.flatnonzero(~is_label)
    first, count = np.searchsorted(code[guess], np.arange(n)), np.bincount(code[guess], minlength=n)
    first_own, count_own = np.searchsorted(code[own], np.arange(n)), np.bincount(code[own], minlength=n)
    mid = np.stack([(box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2], axis=1)
    least = np.full(n, np.inf)
    badloc, best, clash = np.full(len(own), -np.inf), np.full(len(own), -np.inf), np.zeros(len(own), bool)
    seen, same = np.zeros(len(guess)), np.full(len(guess), -np.inf)
    some = []

    def pairs(others: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Places in own and in the others, for all pairs inside an image, a bounded number at a time."""
        c = size[code[own]]
        at, ends = 0, np.cumsum(c)
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
            i = np.repeat(np.arange(at, to), c[at:to])
            before = np.repeat(ends[at:to] - c[at:to], c[at:to])
            j = np.arange(ends[at - 1] if at else 0, ends[to - 1]) - before + start[code[own[i]]]
            yield i, j
            at = to

    for i, j in pairs(guess, first, count):
        a, b = own[i], guess[j]
        iou = _overlap(box[a], box[b])
        sim = ALPHA * iou + (1 - ALPHA) * np.exp(-0.1 * np.sqrt(((mid[a] - mid[b]) ** 2).sum(axis=1)))
        both = known[a] & known[b]
        alike, other = both & (cls[a] == cls[b]), both & (cls[a] != cls[b])
        up = sim > 0
        np.fmin.at(least, code[a[up]], sim[up])
        np.fmax.at(seen, j, iou)
        np.fmax.at(same, j[alike], sim[alike])
        z = alike & (p[b] > LOW) & (iou > 0)
        np.fmax.at(badloc, i[z], sim[z])
        z = other & (p[b] > HIGH)
        np.fmax.at(best, i[z], sim[z])
        z = alike & (iou >= min(steps))
        some.append((i[z], j[z], iou[z]))
    for i, j in pairs(own, first_own, count_own):
        a, b = own[i], own[j]
        z = known[a] & known[b] & (cls[a] != cls[b])
        i, a, b = i[z], a[z], b[z]
        clash[i[_overlap(box[a], box[b]) >= OVERLAP]] = True
    hit = np.zeros(len(guess), np.int64)
    if some:
        i, j, iou = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.lexsort((ids[own[i]], -iou, j))
        order = order[np.unique(j[order], return_index=True)[1]]
        i, j, iou = i[order], j[order], iou[order]
        order = np.lexsort((ids[guess[j]], -np.nan_to_num(p[guess[j]], nan=-np.inf), i))
        i, j, iou = i[order], j[order], iou[order]
        for bit, step in enumerate(steps):
            z = np.flatnonzero(iou >= step)
            hit[j[z[np.unique(i[z], return_index=True)[1]]]] |= 1 << bit
    null = lambda x: pa.array(x, mask=~np.isfinite(x))
    listed = lambda at, x: pa.ListArray.from_arrays(pa.array(np.searchsorted(code[at], np.arange(n + 1)).astype(np.int32)), x)
    label_of = lambda at: pa.array(cls[at].astype(np.int32), mask=~known[at])
    free = np.flatnonzero((p[guess] >= HIGH) & (seen == 0))
    swap = np.where(clash, -1.0, np.where(np.isfinite(best), 1 - best, 1.0))
    columns = {
        "image_id": names, "least": null(least), "label": listed(own, label_of(own)), "badloc": listed(own, pa.array(np.where(np.isfinite(badloc), badloc, 1.0))), "swap": listed(own, pa.array(swap)),
        "free_label": listed(guess[free], label_of(guess[free])), "free": listed(guess[free], null(same[free])), "free_p": listed(guess[free], pa.array(p[guess[free]])),
        "hit_label": listed(guess, label_of(guess)), "hit_id": listed(guess, pa.array(ids[guess])), "hit_p": listed(guess, null(p[guess])), "hit": listed(guess, pa.array(hit)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _scored(found: DataFrame) -> DataFrame:
    """images_with_boxes with the scores of its boxes: overlooked (by free prediction), badloc and swap (by label)."""
    least = F.lit(float(found.agg(F.min("least")).first()[0] or 1.0))
    floor = F.transform("swap", lambda s: F.when(s < 0, least).when(s == 1, 1.0).otherwise(F.greatest(least, s)))
    free = F.zip_with("free", "free_p", lambda s, p: F.coalesce(s, least * (1 - p)))
    return found.withColumn("swap", floor).withColumn("overlooked", free)


def hit_rows(found: DataFrame) -> DataFrame:
    """(image_id, pred_id, label, p, hit): a row for each prediction of images_with_boxes."""
    x = found.select("image_id", F.explode(F.arrays_zip(*HITS)).alias("x"))
    return x.select("image_id", F.col("x.hit_id").alias("pred_id"), F.col("x.hit_label").alias("label"), F.col("x.hit_p").alias("p"), F.col("x.hit").alias("hit"))


def box_confusion(labels: DataFrame, predictions: DataFrame, thresholds=IOU_STEPS) -> DataFrame:
    """(label, tp, fp, fn) of each class, summed over the thresholds, over thresholds x classes."""
    k = len(thresholds)
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own = images_with_boxes(labels, predictions, thresholds).select(F.explode(F.arrays_zip("hit_label", "hit")).alias("x"))
    m = own.groupBy(F.col("x.hit_label").alias("label")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.bit_count("x.hit")).alias("tp"))
    j = n.join(m, "label", "full").fillna(0, ["n", "m", "tp"])
    size = F.lit(float(k)) * F.count(F.lit(1)).over(W.partitionBy())
    return j.select("label", (F.col("tp") / size).alias("tp"), ((F.col("m") * k - F.col("tp")) / size).alias("fp"), ((F.col("n") * k - F.col("tp")) / size).alias("fn"))


def box_class_metrics(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) over the thresholds 0.50 to 0.95."""
    c = box_confusion(labels, predictions).select("label", (F.col("tp") / (F.col("tp") + F.col("fp") + 1e-100)).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + 1e-100)).alias("recall"))
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-100))


def box_image_issues(labels: DataFrame, predictions: DataFrame, factor: float = 0.8, scale: float = 0.25) -> DataFrame:
    """(image_id, is_label_issue): some box scores at most factor x scale x the mean average precision of its class."""
    found = once(images_with_boxes(labels, predictions))
    bounds = {r["label"]: factor * scale * r["ap"] for r in _precisions(hit_rows(found), labels, IOU_STEPS).groupBy("label").agg(F.avg("ap").alias("ap")).collect()}
    low = lambda scores, of: F.exists(F.arrays_zip(F.col(scores).alias("s"), F.col(of).alias("c")), lambda x: x["s"] <= F.coalesce(_at(bounds, x["c"]), F.lit(0.0)))
    scored = _scored(found)
    return scored.select("image_id", (low("overlooked", "free_label") | low("badloc", "label") | low("swap", "label")).alias("is_label_issue"))


def _at(values: dict[int | None, float], key: Column) -> Column:
    """The value of a key, null where there is none."""
    pairs = [F.lit(x) for k, v in values.items() if k is not None for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("double")


def average_precisions(labels: DataFrame, predictions: DataFrame, thresholds=IOU_STEPS) -> DataFrame:
    """(t, label, ap): area under the precision envelope of each labelled class at each overlap threshold.

    Predictions are sorted over all tasks by class and confidence; ranks and running maxima are taken inside
    a task's run of rows and shifted by the totals of the runs, of which the driver gets a row each, so
    a class with a large share of the boxes is no single task.
    """
    return _precisions(hit_rows(images_with_boxes(labels, predictions, thresholds)), labels, thresholds)


def _precisions(hits: DataFrame, labels: DataFrame, thresholds) -> DataFrame:
    spark = labels.sparkSession
    order = [F.col("label"), F.desc_nulls_last("p"), F.col("image_id"), F.col("pred_id")]
    runs = once(hits).where("label is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    runs = once(runs.select(F.spark_partition_id().alias("part"), "label", "hit"))
    steps = len(thresholds)
    bits = [F.getbit("hit", F.lit(b)).cast("bigint") for b in range(steps)]
    totals = runs.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"h{b}") for b, x in enumerate(bits)]).collect()
    starts, at = {}, {}
    for r in sorted(totals, key=lambda r: (r["label"], r["part"])):
        before = at.setdefault(r["label"], np.zeros(steps + 1))
        starts[r["label"], r["part"]] = before.copy()
        before += np.array([r["n"], *[r[f"h{b}"] for b in range(steps)]], float)
    ship_package(spark)

    def each(batches: Iterator[pa.RecordBatch], later: dict | None) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        part, label, hit = (np.concatenate(x) for x in zip(*got, strict=True))
        edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(label) != 0)) + 1
        out = []
        for lo, hi in zip([0, *edges], [*edges, len(part)], strict=True):
            key = int(label[lo]), int(part[lo])
            for b in range(steps):
                k = np.flatnonzero(hit[lo:hi] >> b & 1)
                if len(k):
                    precision = (starts[key][b + 1] + np.arange(1, len(k) + 1)) / (starts[key][0] + k + 1)
                    if later is None:
                        out.append((*key, b, float(precision.max())))
                    else:
                        envelope = np.maximum.accumulate(precision[::-1])
                        out.append((*key, b, float(np.maximum(envelope, later.get((*key, b), 0.0)).sum())))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["label", "part", "b", "x"])

    def over(later: dict | None) -> DataFrame:
        return runs.mapInArrow(lambda batches: each(batches, later), "label int, part int, b int, x double")

    later, top = {}, {}
    for r in sorted(over(None).collect(), key=lambda r: -r["part"]):
        key = r["label"], r["b"]
        later[r["label"], r["part"], r["b"]] = top.get(key, 0.0)
        top[key] = max(top.get(key, 0.0), r["x"])
    step = F.element_at(F.array(*[F.lit(x) for x in thresholds]), F.col("b") + 1)
    area = over(later).groupBy("label", "b").agg(F.sum("x").alias("s")).select("label", step.alias("t"), "s")
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("t"))
    return n.join(area, ["t", "label"], "left").select("t", "label", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ap"))


def average_precision(labels: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> dict[int, float]:
    """Class -> area under the precision envelope.  One row a class comes to the driver."""
    return {r["label"]: r["ap"] for r in average_precisions(labels, predictions, (threshold,)).collect()}
