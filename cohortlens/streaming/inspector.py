"""Incremental label inspection over a stream of (id, label, pred_probs) micro-batches.

Two passes: class thresholds are running sums per class, then batches are scored
with the thresholds so far.  State is one row a class; every batch is aggregated
on the executors.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import arrays as A
from ..operators import confident as C


class StreamAudit:
    """Thresholds, scores and the number of issues of the rows seen so far.

    The number is that of a scan in batches: calibrated, the share of guesses that differ from the
    label is scaled to all rows of each class; thorough, the guess is the most likely class of
    those that reach their thresholds.
    """

    def __init__(self, num_classes: int, score_method: str = "self_confidence", calibrated: bool = False, thorough: bool = False):
        self.k, self.method, self.calibrated, self.thorough = num_classes, score_method, calibrated, thorough
        self.sums, self.counts = np.zeros(num_classes), np.zeros(num_classes, np.int64)
        self.found: dict[int, Counter] = {}

    def update_thresholds(self, batch: DataFrame) -> None:
        for r in batch.groupBy("label").agg(F.sum(A.own_prob(C.P(), C.LABEL())).alias("s"), F.count(F.lit(1)).alias("n")).collect():
            self.sums[r["label"]] += r["s"]
            self.counts[r["label"]] += r["n"]

    def thresholds(self) -> list[float]:
        if not self.counts.sum():
            raise ValueError("no batch has updated the thresholds yet")
        means = np.where(self.counts > 0, self.sums / np.maximum(self.counts, 1), C.ABSENT)
        return np.maximum(means, C.FLOOR).tolist()

    @property
    def rows(self) -> int:
        return sum(c["n"] for c in self.found.values())

    @property
    def issues(self) -> int:
        return C.issue_total(self.found.values(), self.calibrated)

    def score(self, batch: DataFrame, count: bool = True) -> DataFrame:
        """(id, label_quality, is_candidate) of a batch; counts its issues unless told not to."""
        guess = C.reaching_guess(self.thresholds(), self.thorough)
        if count:
            for r in batch.groupBy("label").agg(*C.issue_counts(guess, self.thorough)).collect():
                self.found.setdefault(r["label"], Counter()).update({k: v for k, v in r.asDict().items() if k != "label"})
        off = F.coalesce(guess != C.LABEL(), F.lit(False)) & (C.A.argmax(C.P()) != C.LABEL())
        return batch.select("id", C._SCORES[self.method](C.P(), C.LABEL()).alias("label_quality"), off.alias("is_candidate"))

    def watch(self, stream: DataFrame, scores_path: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
        """Update thresholds, and if a path is given also score and store, for every micro-batch of a stream."""

        def each(batch: DataFrame, epoch: int) -> None:
            batch.persist()
            self.update_thresholds(batch)
            if scores_path:
                self.score(batch).write.mode("overwrite").parquet(f"{scores_path}/epoch={epoch}")
            batch.unpersist()

        writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

    def issue_ids(self, scores: DataFrame) -> DataFrame:
        """The rows of the lowest scores, as many as were counted."""
        return C.lowest(scores, "label_quality", self.issues).select("id")


def quality_scores(spark: SparkSession, scores_path: str) -> DataFrame:
    """(id, label_quality) of all micro-batches that a watch has stored."""
    return spark.read.parquet(scores_path).select("id", "label_quality")


def audit_file(df: DataFrame, calibrated: bool = False, thorough: bool = False) -> DataFrame:
    """(id) of the issues of stored rows in two scans, the first for thresholds and the second for scores, whatever their number."""
    return C.batched_issues(df, calibrated=calibrated, thorough=thorough)
