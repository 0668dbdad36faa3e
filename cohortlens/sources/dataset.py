"""Reading tables by file kind, class encoding, and saving audit results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import coded_lists, numbered_values

_KINDS = {"txt": "text", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc"}


def load(spark: SparkSession, data, kind: str | None = None) -> DataFrame:
    """A DataFrame from a DataFrame, pandas or Arrow table, dict of columns, list of dicts, or a path by its extension."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        kind = kind or _KINDS.get(data.rstrip("/").rsplit(".", 1)[-1].lower())
        if kind is None:
            raise ValueError(f"unknown kind of file: {data}")
        reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
        return reader.format(kind).load(data)
    if isinstance(data, dict):
        if len({len(v) for v in data.values()}) > 1:
            raise ValueError("columns of different lengths")
        return spark.createDataFrame([dict(zip(data, row, strict=True)) for row in zip(*data.values(), strict=True)])
    if isinstance(data, list) or hasattr(data, "columns") or hasattr(data, "schema"):
        return spark.createDataFrame(data)
    raise ValueError(f"no table can be made of {type(data).__name__}")


def encode_labels(df: DataFrame, column: str, to: str = "__label") -> tuple[DataFrame, DataFrame]:
    """df with dense class ids by sorted value (null stays null), and the table (value, id); one way for any number of values."""
    names = numbered_values(df.select(column).where(F.col(column).isNotNull()).distinct(), column)
    return df.join(names.select(F.col("value").alias(column), F.col("id").alias(to)), column, "left"), names


def encode_label_lists(df: DataFrame, column: str, to: str = "__labels") -> tuple[DataFrame, DataFrame]:
    """df with lists of labels as lists of dense ids over the union of all labels, and the table (value, id)."""
    return coded_lists(df, column, to)


def long_to_wide(votes: DataFrame) -> DataFrame:
    """One column an annotator."""
    return votes.groupBy("task_id").pivot("annotator_id").agg(F.first("label"))


def wide_to_long(wide: DataFrame) -> DataFrame:
    """(task_id, annotator_id, label) of the votes that are there, from one column an annotator."""
    people = [c for c in wide.columns if c != "task_id"]
    kind = dict(wide.dtypes)[people[0]]
    long = wide.select("task_id", F.explode(F.array(*[F.struct(F.lit(c).alias("annotator_id"), F.col(f"`{c}`").cast(kind).alias("label")) for c in people])).alias("x"))
    return long.select("task_id", "x.*").where("label is not null")


def encode_votes(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes of any values in wide form as long votes of dense ids, and the table (value, id)."""
    coded, names = encode_labels(wide_to_long(wide), "label", "__id")
    return coded.select("task_id", "annotator_id", F.col("__id").alias("label")), names


def fingerprint(df: DataFrame) -> int:
    """Order-free content hash."""
    return int(df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0] or 0)


def save(path: str, issues: DataFrame, summary: DataFrame, info: dict, source: DataFrame, force: bool = False) -> None:
    """issues, summary and info as Parquet and JSON under path; refuses a path that exists unless forced."""
    mode = "overwrite" if force else "errorifexists"
    issues.write.mode(mode).parquet(f"{path}/issues")
    summary.write.mode(mode).parquet(f"{path}/summary")
    text = json.dumps(info | {"fingerprint": fingerprint(source), "rows": source.count()}, default=str)
    source.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/info")


def restore(spark: SparkSession, path: str, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    info = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/info").collect()))
    if source is not None and (fingerprint(source) != info["fingerprint"] or source.count() != info["rows"]):
        raise ValueError("the data differs from what was audited")
    return spark.read.parquet(f"{path}/issues"), spark.read.parquet(f"{path}/summary"), info
