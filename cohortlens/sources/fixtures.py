"""Model outputs derived from the test tables by integer arithmetic, so that every engine starts from the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def class_probs(spark: SparkSession, d: str, a: int = 7919, b: int = 104729, name: str = "pred_probs") -> DataFrame:
    """id, label, pred_probs of five classes."""
    raw = f"transform(sequence(0, 4), k -> ((id * {a} + k * {b} + ck * 31) % 997) + 1 + if(k = guess, 900, 0))"
    return (
        _t(spark, d, "orders")
        .selectExpr("o_orderkey as id", "o_custkey as ck", "cast(substr(o_orderpriority, 1, 1) as int) - 1 as label")
        .selectExpr("*", "cast(if(id % 7 = 0, (label + 1 + ((id div 7) % 4)) % 5, label) as int) as guess")
        .selectExpr("id", "ck", "label", f"{raw} as raw")
        .selectExpr("id", "ck", "label", f"transform(raw, x -> cast(x as double) / aggregate(raw, 0L, (s, y) -> s + y)) as {name}")
    )


def multilabel(spark: SparkSession, d: str) -> DataFrame:
    """id, bits, probs of four classes."""
    bit = "transform(sequence(0, 3), k -> if((o_orderkey * (k + 3) + o_custkey) % 5 < 2, 1, 0))"
    p = "transform(sequence(0, 3), k -> cast(((o_orderkey * 7919 + k * 104729 + o_custkey * 31) % 89) + 5 + if(((o_orderkey * (k + 3) + o_custkey) % 5 < 2) <> ((o_orderkey + k) % 11 = 0), 400, 0) as double) / 500)"
    return _t(spark, d, "orders").selectExpr("o_orderkey as id", f"{bit} as bits", f"{p} as probs")


def crowd(spark: SparkSession, d: str) -> DataFrame:
    """task_id, annotator_id, label."""
    return (
        _t(spark, d, "lineitem")
        .selectExpr(
            "l_partkey as task_id",
            "l_suppkey % 20 as annotator_id",
            "cast(case when (l_partkey * 31 + (l_suppkey % 20) * 17) % 10 < (l_suppkey % 20) % 5 then (l_partkey + 1 + ((l_partkey + l_suppkey % 20) % 2)) % 3 else l_partkey % 3 end as int) as label",
        )
        .distinct()
    )


def task_probs(spark: SparkSession, d: str, a: int = 7919, b: int = 104729) -> DataFrame:
    """task_id, pred_probs of three classes."""
    raw = f"transform(sequence(0, 2), k -> ((p_partkey * {a} + k * {b}) % 997) + 1 + if(k = (if(p_partkey % 9 = 0, p_partkey + 1, p_partkey)) % 3, 700, 0))"
    return _t(spark, d, "part").selectExpr("p_partkey as task_id", f"{raw} as raw").selectExpr("task_id", "transform(raw, x -> cast(x as double) / aggregate(raw, 0L, (s, y) -> s + y)) as pred_probs")


def two_models(spark: SparkSession, d: str) -> DataFrame:
    """task_id, m_0, m_1 of three classes."""
    return task_probs(spark, d).withColumnRenamed("pred_probs", "m_0").join(task_probs(spark, d, 7907, 104723).withColumnRenamed("pred_probs", "m_1"), "task_id")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """sentence_id, token_id, token, label, pred_probs of three classes."""
    raw = "transform(sequence(0, 2), k -> ((sentence_id * 7919 + token_id * 613 + k * 104729) % 997) + 1 + if(k = (label + if((sentence_id * 8 + token_id) % 7 = 0, 1, 0)) % 3, 900, 0))"
    return (
        _t(spark, d, "conversations")
        .selectExpr("conv_id as sentence_id", "turn as token_id", "role as token", "case role when 'system' then 0 when 'user' then 1 else 2 end as label")
        .selectExpr("*", f"{raw} as raw")
        .selectExpr("sentence_id", "token_id", "token", "label", "transform(raw, x -> cast(x as double) / aggregate(raw, 0L, (s, y) -> s + y)) as pred_probs")
    )


def regression(spark: SparkSession, d: str) -> DataFrame:
    """id, y, prediction."""
    return _t(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "o_totalprice / 1e5 as y",
        "o_totalprice / 1e5 * (1e0 + (((o_orderkey * 7919) % 201) - 100) / 1e3) + case when o_orderkey % 50 = 0 then 3e0 else 0e0 end as prediction",
    )


def point_predictions(spark: SparkSession, d: str) -> DataFrame:
    """id, y, prediction."""
    return _t(spark, d, "customer").selectExpr(
        "c_custkey as id", "c_acctbal / 1e3 as y", "c_acctbal / 1e3 + ((c_custkey * 7919) % 201 - 100) / 1e2 + case when c_custkey % 50 = 0 then 5e0 else 0e0 end as prediction"
    )


def row_properties(spark: SparkSession, d: str) -> DataFrame:
    """id, label, fold and three properties: one that tells the label, one that hints at it, one that doesn't."""
    return (
        _t(spark, d, "orders")
        .selectExpr("o_orderkey as id", "cast(substr(o_orderpriority, 1, 1) as int) - 1 as label", "o_totalprice")
        .selectExpr("id", "label", "cast(id % 5 as int) as fold", "label * 3e0 + (id * 7919 % 101) / 1e2 as darkness", "label + (id * 7907 % 401) / 1e2 as blur", "o_totalprice / 1e5 as odd_size")
    )


_BOX = "cast((o_orderkey * 37 + b * 61) % 200 as double) as x1, cast((o_orderkey * 53 + b * 29) % 200 as double) as y1, cast((o_orderkey * 37 + b * 61) % 200 + 20 + (o_orderkey * 7 + b * 13) % 60 as double) as x2, cast((o_orderkey * 53 + b * 29) % 200 + 20 + (o_orderkey * 5 + b * 19) % 60 as double) as y2, cast((o_orderkey + b) % 4 as int) as label"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """image_id, box_id, x1, y1, x2, y2, label."""
    return _t(spark, d, "orders").selectExpr("o_orderkey", "explode(sequence(0, 3)) as b").selectExpr("o_orderkey as image_id", "b as box_id", _BOX.split(", cast(")[0], *["cast(" + x for x in _BOX.split(", cast(")[1:]])


def predicted_boxes(spark: SparkSession, d: str) -> DataFrame:
    """image_id, box_id, x1, y1, x2, y2, label, p."""
    moved = boxes(spark, d).where("(image_id + box_id) % 9 <> 0").selectExpr(
        "image_id", "box_id", "x1 + (image_id + box_id) % 5 as x1", "y1 + (image_id + 2 * box_id) % 4 as y1", "x2 + (image_id + box_id) % 5 as x2", "y2 + (image_id + 2 * box_id) % 4 as y2",
        "cast(case when (image_id * 3 + box_id) % 10 = 0 then (label + 1) % 4 else label end as int) as label",
        "case when (image_id * 3 + box_id) % 10 = 0 then 97e-2 else 6e-1 + ((image_id * 11 + box_id * 7) % 40) / 1e2 end as p",
    )
    more = _t(spark, d, "orders").where("o_orderkey % 6 = 0").selectExpr(
        "o_orderkey as image_id", "99 as box_id", "4e2 as x1", "4e2 as y1", "44e1 as x2", "44e1 as y2", "cast(o_orderkey % 4 as int) as label", "97e-2 as p"
    )
    return moved.unionByName(more)


def partial_nulls(spark: SparkSession, d: str) -> DataFrame:
    """id, a, b, c with nulls."""
    return _t(spark, d, "customer").selectExpr(
        "c_custkey as id",
        "case when c_custkey % 7 = 0 then null else c_acctbal end as a",
        "case when c_custkey % 5 = 0 then null else c_nationkey end as b",
        "case when c_custkey % 7 = 0 and c_custkey % 3 = 0 or c_custkey % 35 = 0 then null else c_mktsegment end as c",
    )


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """image_id, y, x, label, p1 (two classes)."""
    return (
        _t(spark, d, "nation")
        .selectExpr("n_nationkey as image_id", "explode(sequence(0, 15)) as y")
        .selectExpr("image_id", "y", "explode(sequence(0, 15)) as x")
        .selectExpr(
            "image_id", "y", "x", "case when (y < 8) = (image_id % 8 <> 3) then 1 else 0 end as label",
            "(cast((image_id * 7919 + y * 104729 + x * 1299709) % 97 as double) + 1 + case when y < 8 then 150 else 20 end) / 300 as p1",
        )
    )
