"""From raw documents to token ids: five stages of the training-data operators.

Each stage reads what the stage before it has kept and written, and its decision
takes effect: rejected languages and near copies go, secrets are replaced by
their kind, the mix drops and repeats documents, and the last stage returns the
ids of every text.

Defined cases, for every stage: a null text counts as empty; rows that repeat a
doc_id, or have none, are documents of their own; texts are worked on whole,
however long; ties are ordered by a hash or by doc_id; an empty table gives an
empty one; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlens.functions.session import shared_folder
from cohortlens.llm import bpe, language, mixing, secrets, simhash
from cohortlens.llm.common import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the models, learned from the labelled rows of docs, reject.

    These are documents without a letter (null and empty ones too) and those unlike every
    language; without a labelled row there is no model and every document goes.
    """
    return language.keep_identified(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: that of the smallest doc_id, null last.

    Of rows with that doc_id one stays; all documents without words are one component.
    """
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind; no document is dropped, null texts stay null, n_chars follows the text."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of its source asks for, 0 to 3 times.

    A document without words is taken zero times; null is a source of its own.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to; a null text has no ids."""
    path, pattern = bpe.public_vocabulary()
    return bpe.encode_documents(docs, path, pattern)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL has no language models, XXH64 fingerprints or BPE; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
