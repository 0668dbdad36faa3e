"""Label columns: counts and sets of classes, coding of values and of lists of values, and small reshapings of tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each_label(df: DataFrame, column: str = "label") -> DataFrame:
    """(label): one row a label; the entries of lists one by one."""
    c = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    return df.select(c.alias("label"))


def class_counts(df: DataFrame, column: str = "label", k: int | None = None) -> DataFrame:
    """(label, n); with k, a row for each of the classes 0 .. k - 1, also those without rows."""
    n = each_label(df, column).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return n
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("label")).join(n, "label", "left").fillna(0, ["n"])


def unique_classes(df: DataFrame, column: str = "label") -> DataFrame:
    """(label) of the classes that occur, in order."""
    return each_label(df, column).where("label is not null").distinct().orderBy("label")


def num_unique_classes(df: DataFrame, column: str = "label") -> int:
    return each_label(df, column).agg(F.count_distinct("label")).first()[0]


def missing_classes(df: DataFrame, k: int, column: str = "label") -> DataFrame:
    """(label) of the classes 0 .. k - 1 without a row, in order."""
    return class_counts(df, column, k).where("n = 0").select("label").orderBy("label")


def num_classes(df: DataFrame, label: str | None = "label", probs: str | None = "pred_probs", matrix: np.ndarray | None = None) -> int:
    """The number of classes: of the probabilities if there are any, else of a matrix of classes, else of the labels that occur."""
    if probs is not None and probs in df.columns:
        return df.agg(F.max(F.size(probs))).first()[0] or 0
    if matrix is not None:
        return len(matrix)
    return num_unique_classes(df, label)


def coded_lists(df: DataFrame, column: str, to: str) -> tuple[DataFrame, DataFrame]:
    """df with lists of values as lists of dense ids, and the table (value, id) of the values in order.

    Positions are kept; null lists, and nulls in lists, stay null.
    """
    values = each_label(df, column).where("label is not null").distinct()
    names = numbered_values(values, "label")
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    long = rows.select("__row", F.posexplode(column).alias("at", "value"))
    coded = long.join(names, long["value"] == names["value"], "left").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("x"))
    empty = F.when(F.col(f"`{column}`").isNotNull(), F.array().cast("array<int>"))
    out = rows.join(coded, "__row", "left").withColumn(to, F.coalesce(F.col("x.id"), empty)).drop("__row", "x")
    return out, names


def numbered_values(values: DataFrame, column: str) -> DataFrame:
    """(value, id): distinct values with their ranks from 0.

    Ranks are counted in ranges of the values and shifted by the ranges before, so that many
    values are no single task; what comes to the driver has one row a range.
    """
    spark = values.sparkSession
    ranges = values.select(F.col(f"`{column}`").alias("value")).repartitionByRange("value").sortWithinPartitions("value")
    from .session import shared_folder

    shared_folder(spark)
    placed = ranges.select("value", F.monotonically_increasing_id().alias("m")).checkpoint()
    part = F.shiftright("m", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(sizes):
        before[p] = at
        at += sizes[p]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part) if before else F.lit(0)
    return placed.select("value", (F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("int").alias("id"))


def compressed(column: Column, k: int) -> Column:
    """Class ids in the smallest whole-number type that holds k values."""
    kind = "smallint" if k < 1 << 15 else "int" if k < 1 << 31 else "bigint"
    return column.cast(kind)


def split(df: DataFrame, held_out: Column) -> tuple[DataFrame, DataFrame]:
    """The rows to train on and those held out."""
    out = F.coalesce(held_out, F.lit(False))
    return df.where(~out), df.where(out)


def masked(df: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows whose id has a true flag in mask(id, flag)."""
    return df.join(mask.where("flag").select("id"), "id", "left_semi")


def with_row(df: DataFrame, other: DataFrame, row: Column) -> DataFrame:
    """df and the rows of another table that meet a condition."""
    return df.unionByName(other.where(row).select(*df.columns))


def flat(values: Column, depth: int) -> Column:
    """Nested arrays of a depth as one array of numbers."""
    for _ in range(depth - 1):
        values = F.flatten(values)
    return values
