"""Shared pieces of the training-data operators: table access, lineage cuts, row numbers, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import shared_folder, ship_package

#: One word: a run of anything but the ASCII white space \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts in one Arrow batch, for every operator: a plan that is built later doesn't change an earlier one's.
BATCH_ROWS = 256
#: Copies of a row that are unfolded at once.
_CHUNK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Ready the session for Python on the executors; bound what one Arrow batch of whole texts can hold there."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there: a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written as a Parquet table to the shared folder and read again; its rows stay where they are."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or the next name like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, written so that the numbers stay as they are; and the column's name.

    Rows that repeat a doc_id, or have none, are told apart by it.
    """
    name = free_name(docs, "row_number")
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def unfolded(df: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row as often as times says, numbered from 0; at most _CHUNK numbers of a row are in memory at once."""
    part = free_name(df, "part")
    df = df.withColumn(name, times).where(F.col(name) > 0)
    df = df.withColumn(part, F.explode(F.sequence(F.lit(0), ((F.col(name) - 1) / _CHUNK).cast("int"))))
    at = F.col(part).cast("bigint") * _CHUNK
    return df.withColumn(name, F.explode(F.sequence(at, F.least(at + _CHUNK, F.col(name)) - 1))).drop(part)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


def grouped(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold so many bytes, for work with a cost for each batch; none is empty."""
    held, held_bytes = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            held_bytes += b.nbytes
            if held_bytes >= size:
                yield pa.concat_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def kept_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, taken by exact name, so that further columns can't clash with computed ones."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
