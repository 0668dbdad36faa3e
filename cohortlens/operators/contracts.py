"""What inputs have to be.  Each check is one aggregate over the rows and raises ValueError with the counts that broke it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, **broken: Column) -> DataFrame:
    """(reason, rows): how many rows meet each of the named conditions (null counts as met), from one aggregate."""
    r = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in broken.items()])
    return r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("rows")) for n in broken])).alias("x")).select("x.*")


def require(df: DataFrame, **broken: Column) -> DataFrame:
    """df itself, if no row meets any of the named conditions."""
    if found := {r["reason"]: r["rows"] for r in violations(df, **broken).where("rows > 0").collect()}:
        raise ValueError(f"invalid input, rows by reason: {found}")
    return df


def _outside(p: str) -> Column:
    return F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < -1e-6) | (x > 1 + 1e-6))


def class_rules(k: int) -> dict[str, Column]:
    total = F.aggregate("pred_probs", F.lit(0.0), lambda s, x: s + x)
    return {"label": (F.col("label") < 0) | (F.col("label") >= k), "size": F.size("pred_probs") != k, "range": _outside("pred_probs"), "total": F.abs(total - 1) > 1e-2}


def multilabel_rules(k: int) -> dict[str, Column]:
    return {"size": (F.size("bits") != k) | (F.size("probs") != k), "bits": F.exists("bits", lambda x: x.isNull() | ~x.isin(0, 1)), "range": _outside("probs")}


def regression_rules() -> dict[str, Column]:
    return {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in ("y", "prediction")}


def crowd_rules(k: int | None = None) -> dict[str, Column]:
    too_high = F.col("label") >= k if k is not None else F.lit(False)
    return {"task_id": F.col("task_id").isNull(), "annotator_id": F.col("annotator_id").isNull(), "label": (F.col("label") < 0) | too_high}


def box_rules(predicted: bool = False) -> dict[str, Column]:
    rules = {"corners": (F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1")), "label": F.col("label") < 0}
    return rules | ({"p": (F.col("p") < 0) | (F.col("p") > 1)} if predicted else {})


def class_probabilities(df: DataFrame, k: int) -> DataFrame:
    """label in 0 .. k - 1, pred_probs of k numbers in [0, 1] that sum to about one."""
    return require(df, **class_rules(k))


def class_labels(df: DataFrame, allow_missing: bool = True, allow_one: bool = False) -> DataFrame:
    """Whole labels from 0, of two classes or more, and without gaps if asked."""
    require(df, label=(F.col("label") < 0) | (F.col("label") != F.floor("label")))
    n, top = df.agg(F.count_distinct("label"), F.max("label")).first()
    if n < 2 and not allow_one:
        raise ValueError("labels of one class only")
    if not allow_missing and n != top + 1:
        raise ValueError(f"{int(top) + 1 - n} classes have no rows")
    return df


def multilabel(df: DataFrame, k: int) -> DataFrame:
    """bits and probs of k entries, bits 0 or 1, probs in [0, 1] without a rule for their sum."""
    return require(df, **multilabel_rules(k))


def regression(df: DataFrame) -> DataFrame:
    """y and prediction are there and are numbers."""
    return require(df, **regression_rules())


def crowd(votes: DataFrame, allow_single: bool = False, k: int | None = None) -> DataFrame:
    """One whole label from 0 (below k) a task and annotator, more than one annotator, some task with several labels."""
    require(votes, **crowd_rules(k))
    twice = votes.groupBy("task_id", "annotator_id").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("an annotator labelled a task twice")
    if votes.agg(F.count_distinct("annotator_id")).first()[0] < 2:
        raise ValueError("fewer than two annotators")
    if not allow_single and not votes.groupBy("task_id").count().where("count > 1").limit(1).count():
        raise ValueError("no task has more than one label")
    return votes


def some_agreement(votes: DataFrame) -> bool:
    """Whether two annotators gave some task the same label."""
    return votes.groupBy("task_id", "label").count().where("count > 1").limit(1).count() > 0


def boxes(df: DataFrame, predicted: bool = False) -> DataFrame:
    """Corners in order, whole labels from 0, and a probability in [0, 1] on predictions."""
    return require(df, **box_rules(predicted))


def aggregation_weights(overlooked: float, badloc: float, swap: float) -> None:
    """Not negative, and with a sum of about one."""
    w = (overlooked, badloc, swap)
    if min(w) < 0 or abs(sum(w) - 1) > 1e-6:
        raise ValueError(f"weights must be at least 0 and sum to 1: {w}")


def pixels(df: DataFrame) -> DataFrame:
    """One label and one probability in [0, 1] for every place of an image."""
    require(df, label=F.col("label") < 0, p1=(F.col("p1") < 0) | (F.col("p1") > 1))
    if df.groupBy("image_id", "y", "x").count().where("count > 1").limit(1).count():
        raise ValueError("a place of an image is given twice")
    return df


def numeric_column(df: DataFrame, name: str) -> DataFrame:
    """df with a column that has to be there, as numbers: of a type of numbers, or of arrays or texts with one in each."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind.startswith("array"):
        require(df, size=F.size(c) != 1)
        c = F.get(c, F.lit(0))
    as_number = c.cast("double")
    require(df.where(c.isNotNull()), number=as_number.isNull())
    return df.withColumn(name, as_number)


def label_lists(df: DataFrame, column: str = "labels") -> DataFrame:
    """Labels are lists of whole numbers from 0."""
    kind = dict(df.dtypes).get(column, "")
    if kind not in ("array<int>", "array<bigint>", "array<smallint>", "array<tinyint>"):
        raise ValueError(f"labels must be lists of whole numbers, not {kind or 'missing'}")
    return require(df, label=F.exists(column, lambda x: x.isNull() | (x < 0)))


def crowd_probabilities(labelled: DataFrame | None = None, unlabelled: DataFrame | None = None, columns: tuple[str, ...] = ("pred_probs",)) -> int:
    """The number of classes that all probabilities of both tables have; at least one table is needed, and every model must give as many."""
    tables = [t for t in (labelled, unlabelled) if t is not None]
    if not tables:
        raise ValueError("probabilities of labelled or unlabelled tasks are needed")
    sizes = set()
    for t in tables:
        if lacking := [c for c in columns if c not in t.columns]:
            raise ValueError(f"no column {lacking}")
        require(t, **{f"range_{c}": _outside(c) for c in columns})
        sizes |= {x for r in t.select(*[F.size(c) for c in columns]).distinct().limit(3).collect() for x in r}
    if len(sizes) > 1:
        raise ValueError(f"different numbers of classes: {sorted(sizes)}")
    return sizes.pop() if sizes else 0


def features(df: DataFrame) -> DataFrame:
    """features are arrays of one length, y is a number."""
    if df.select(F.size("features")).distinct().limit(2).count() > 1:
        raise ValueError("features of different lengths")
    return require(df, features=F.col("features").isNull(), y=F.col("y").isNull() | F.isnan(F.col("y").cast("double")))


def method(name: str, allowed: tuple[str, ...]) -> str:
    """name, if it is one of the allowed."""
    if name not in allowed:
        raise ValueError(f"unknown method {name!r}: {sorted(allowed)}")
    return name


def pixel_classes(df: DataFrame) -> DataFrame:
    """Pixels of any number of classes: label and pred_probs of one size, every place of an image once."""
    sizes = df.select(F.size("pred_probs").alias("k")).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("probabilities of different numbers of classes")
    k = sizes[0]["k"] if sizes else 0
    require(df, label=(F.col("label") < 0) | (F.col("label") >= k), range=_outside("pred_probs"))
    if df.groupBy("image_id", "y", "x").count().where("count > 1").limit(1).count():
        raise ValueError("a place of an image is given twice")
    return df
