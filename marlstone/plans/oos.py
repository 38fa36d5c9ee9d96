"""Out-of-sample sweep: every module, with spans frozen on the first block, scored on all blocks at once.

`block` is a grouping key, so blocks run in parallel. Blocks with too few rows score null.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from . import features, research
from .market import Market

log = logging.getLogger(__name__)


def readings(mk: Market, spans: dict[str, tuple]) -> DataFrame:
    """(feature, leg, t, value) of modules at given spans."""
    out = None
    for name, s in spans.items():
        one = features.get(name).build(mk, *s).select(F.lit(name).alias("feature"), F.col("listing").alias("leg"), "t", "value")
        out = one if out is None else out.unionByName(one)
    return out


def best_spans(mk: Market, name: str, grid: Sequence[tuple], target: DataFrame, y: str, signed: bool = False) -> dict[str, str]:
    """Leg -> the span (as text) with the strongest correlation with the target, whatever its sign unless `signed`."""
    ics = research.ic_scan(mk, name, grid, target, y).where("ic is not null")
    size = F.col("ic") if signed else F.abs("ic")
    return {r[0]: r[1] for r in ics.groupBy("listing").agg(F.max_by("span", size)).collect()}  # a row per leg


def sweep(values: DataFrame, target: DataFrame, y: str, block, echo: DataFrame | None = None) -> DataFrame:
    """(feature, leg, block, ic[, netted]): rank correlations per block; echo (t, trailing) is netted out."""
    both = values.join(target, "t").withColumn("block", block)
    keys = ["feature", "leg", "block"]
    if echo is None:
        return stats.rank_ic(both, "value", y, keys)
    return stats.partial_ic(both.join(echo, "t"), "value", y, "trailing", keys).withColumnsRenamed({"raw": "ic"})


def report(ics: DataFrame) -> DataFrame:
    """(feature, leg, block0, mean, std, n, same_sign, verdict)."""
    return stats.block_stats(ics, ["feature", "leg"], "block", "ic").withColumn("verdict", stats.verdict()).orderBy("feature", "leg")


def save_spans(spark: SparkSession, spans: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(spans, sort_keys=True),)], "spans string").coalesce(1).write.mode("overwrite").text(path)


def load_spans(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def sweep_blocks(spark: SparkSession, blocks: dict[int, Callable[[], DataFrame]], path: str, scores: Sequence[str] = ("ic",)) -> list[int]:
    """Score blocks that have to be loaded apart, one after the other, and append (feature, leg, block, scores) of each to
    the matrix at `path`. A block that fails is written as one row without scores, so that the matrix names every block;
    the numbers of those that failed are returned."""
    failed = []
    for number, score in blocks.items():
        try:
            append_matrix(score().select("feature", "leg", F.lit(number).alias("block"), *scores), path)
        except Exception as e:  # noqa: BLE001  one block's fault is not the others'
            none = (F.lit(None).cast("string").alias(c) for c in ("feature", "leg"))
            append_matrix(spark.range(1).select(*none, F.lit(number).alias("block"), *(F.lit(None).cast("double").alias(c) for c in scores)), path)
            failed.append(number)
            log.warning("block %s failed: %s", number, (str(e).splitlines() or [type(e).__name__])[0])
    return failed


def append_matrix(ics: DataFrame, path: str) -> None:
    """Scores of more blocks, as CSV; failed ones are empty."""
    ics.write.mode("append").option("header", True).csv(path)
