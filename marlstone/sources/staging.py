"""Staged tables: an intermediate result that several readers share is written once to the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[str, str]] = []


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if driver and executors are one process, or else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
            held = sc._jsc.sc().getCheckpointDir()
        at = held.get()
    return at.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, cleared at the end."""
    path = f"{_folder(spark)}/staged-{uuid.uuid4().hex}"
    _tables.append((spark.sparkContext.applicationId, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """`df`, computed once: readers scan a table instead of its whole plan, and an executor may be lost at any time."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for app, path in _tables if spark else []:
        if app == spark.sparkContext.applicationId:
            try:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # noqa: BLE001  the session is ending; the folder's owner clears what is left
                return
