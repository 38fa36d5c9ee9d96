"""What the corpus operators share: shipping code, cutting lineage, columns that cannot clash."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"

_tables: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(os.path.realpath(tempfile.mkdtemp())) / "marlstone.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(out))
    sc._marlstone_shipped = True


#: Bytes of an Arrow batch in the registered queries and the pipeline. A task holds a few copies of a batch outside the heap.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let a session whose Arrow batches are of Spark's default size, 64 MB, make smaller ones. Operators do not call this:
    it is the affair of those who set a session up, as the registered queries do."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of our own if driver and executors are
    one process, or else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session is ending; the folder's owner clears what is left
            return


atexit.register(_remove_all)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame that cut() returned and that nothing will read again."""
    path = getattr(df, "_marlstone_path", None)
    if path:
        _tables[df.sparkSession.sparkContext.applicationId].remove(path)
        _remove(df.sparkSession, path)


def parts(spark: SparkSession, times: int = 1) -> int:
    """Number of partitions for work dealt out by hand; it follows spark.sql.shuffle.partitions, the knob for data size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def row_hash(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with other text; rows equal in both count as one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
