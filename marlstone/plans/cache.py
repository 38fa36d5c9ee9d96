"""Dataset tables: one per grid and set of knobs, partitioned by block; columns are pruned at the scan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dataset import Dataset


def grid_hash(ds: Dataset, columns: Sequence[str] = ()) -> str:
    """Identity of a grid and its knobs; with columns, of a dataset. It names the table's folder."""
    knobs = {"target": ds.target, "step": ds.step, "low": ds.low, "high": ds.high, "mask": ds.mask, "wide": ds.wide, "reference": sorted(ds.reference.items()), "latency": ds.latency_rows, "columns": list(columns)}
    return "g_" + hashlib.sha1(json.dumps(knobs, sort_keys=True).encode()).hexdigest()[:12]


def write_blocks(df: DataFrame, path: str) -> None:
    """df (block, t, ...): blocks that are written again replace their old rows only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)


def cached_columns(spark: SparkSession, path: str) -> list[str]:
    return [c for c in spark.read.parquet(path).columns if c not in ("block", "t")]


def read_dataset(spark: SparkSession, path: str, columns: Sequence[str] | None = None, blocks: Sequence[str] | None = None, trim: dict[str, int] | None = None, least_gap: int = 1) -> DataFrame:
    """Columns of some blocks; a reader that needs an order sorts by (block, t) itself. trim: steps to leave out at the start of a block, per block, if the
    gap since the block before it is at least `least_gap` steps; it is found from each block's ends."""
    have = cached_columns(spark, path)
    missing = set(columns or ()) - set(have)
    if missing:
        raise ValueError(f"columns are not in the table: {sorted(missing)}")
    df = spark.read.parquet(path).select("block", "t", *(columns or have))
    if blocks is not None:
        df = df.where(F.col("block").cast("string").isin(*blocks))
    if trim:
        ends = df.groupBy("block").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
        ends = ends.withColumn("_gap", F.col("_lo") - F.lag("_hi").over(W.orderBy("_lo")))  # a row per block
        cut = F.coalesce(*(F.when(F.col("block").cast("string") == b, F.lit(k)) for b, k in trim.items()), F.lit(0))
        df = df.join(F.broadcast(ends), "block").where(F.col("t") >= F.col("_lo") + F.when(F.coalesce(F.col("_gap"), F.lit(1 << 60)) >= least_gap, cut).otherwise(0)).drop("_lo", "_hi", "_gap")
    return df
