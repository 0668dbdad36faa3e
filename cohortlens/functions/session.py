"""What a session needs before Python code of this package runs on its executors, and where it writes what it shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a Spark application (about 100 kB)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="cohortlens-")), "cohortlens.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, else that of spark.checkpoint.dir.

    Only a master in one process ("local", as in tests) may go without and gets a temporary
    one; a cluster without the setting is an error, since its machines share no local folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohortlens-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def once(df: DataFrame) -> DataFrame:
    """df written to the shared folder, for what is read again and again; a table that has been is given back as it is."""
    if getattr(df, "_written_once", False):
        return df
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    out._written_once = True
    return out
