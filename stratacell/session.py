"""Session set-up shared by the library's entry points."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    A cluster that ships the package itself (``spark.submit.pyFiles`` or an installed wheel) needs nothing.
    """
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines share; it goes when the session ends.

    Only where the setting is absent, as in local tests, a temporary folder of the driver serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="stratacell-")
    folder = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return folder


def saved(df: DataFrame, what: str) -> DataFrame:
    """df, written to a work folder and read again: it is computed once, and needs no executor that made it."""
    path = f"{work_folder(df.sparkSession, what)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
