"""Raw market relations: schemas, settings, and the adapter from the generic `events` table.

Times are nanoseconds in a bigint. `seq` is the order of arrival, which a DataFrame does not keep by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = "listing string, seq bigint, rx bigint, exchange_time bigint, bid_prc double, bid_qty double, ask_prc double, ask_qty double"
TRADE = "listing string, seq bigint, rx bigint, exchange_time bigint, aggressor string, prc double, qty double"
LISTINGS = ("byb", "bin", "okx")
HOUR = 3_600_000_000_000
MINUTE = 60_000_000_000


@dataclass(frozen=True)
class Settings:
    """Where blocks lie, and the venue markets whose aggressor field names the other side."""

    data_dir: str = ""
    synthetic_dir: str = ""
    aggressor_inverted: frozenset[str] = field(default_factory=frozenset)
    no_merged: frozenset[str] = field(default_factory=frozenset)


@dataclass(frozen=True)
class FileName:
    prefix: str
    block: str
    listing: str
    kind: str


def parse_name(path: str) -> FileName | None:
    """`{prefix}.{time}.{index}.{listing}.{kind}.parquet`; the first three tokens are the block."""
    m = re.fullmatch(r"(?P<b>(?P<p>[^.]+)\.[^.]+\.[^.]+)\.(?P<l>[^.]+)\.(?P<k>[^.]+)\.parquet", path.rsplit("/", 1)[-1])
    return m and FileName(m["p"], m["b"], m["l"], m["k"])


def _files(spark: SparkSession, folder: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in fs.listStatus(at)] if fs.exists(at) else []


def list_blocks(spark: SparkSession, settings: Settings, listing: str, kind: str) -> list[str]:
    """Sorted block ids that have the stream; for merged_levels those that have both of its inputs."""
    if kind == "merged_levels":
        if listing in settings.no_merged:
            return []
        return sorted(set(list_blocks(spark, settings, listing, "front_levels")) & set(list_blocks(spark, settings, listing, "trade")))
    names = (parse_name(f) for f in _files(spark, settings.data_dir))
    return sorted({n.block for n in names if n and n.listing == listing and n.kind == kind})


def load_block(spark: SparkSession, settings: Settings, block: str, listing: str, kind: str) -> DataFrame:
    """All files of one stream of one block; raises if there is none."""
    own = [f for f in _files(spark, settings.data_dir) if (n := parse_name(f)) and (n.block, n.listing, n.kind) == (block, listing, kind)]
    if not own:
        raise FileNotFoundError(f"no {kind} of {listing} in {block}")
    return spark.read.parquet(*own).withColumns({"listing": F.lit(listing), "block": F.lit(block)})


def require_merged(settings: Settings, listing: str) -> None:
    if listing in settings.no_merged:
        raise ValueError(f"{listing} has no merged stream")


def lazily(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at `path`, built by build() if it is not there; a table write appears only once it is complete."""
    if not any(f.endswith("_SUCCESS") for f in _files(spark, path)):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


TICKS = {"byb": 0.01, "bin": 0.01, "okx": 0.1}


def tick_sizes(spark: SparkSession, ticks: dict[str, float] = TICKS) -> DataFrame:
    return spark.createDataFrame(sorted(ticks.items()), "listing string, tick double")


def with_ticks(df: DataFrame, ticks: DataFrame) -> DataFrame:
    """Tick of each row's listing; an unknown listing raises when read. The table of ticks has a row per listing."""
    met = df.join(ticks, "listing", "left")
    return met.withColumn("tick", F.coalesce("tick", F.raise_error(F.concat(F.lit("no tick size of "), F.col("listing"))).cast("double")))


# the adapter


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z"):
        ts = F.from_utc_timestamp(ts, zone)
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), (F.unix_micros(ts) * 1000).alias("rx"), "event_type", "value", "user_id", k.alias("k")
    )


def _listing():
    return F.element_at(F.array(*map(F.lit, LISTINGS)), (F.col("user_id") % 3 + 1).cast("int"))


def books(spark: SparkSession, sf_dir: str, round_ns: int = 1) -> DataFrame:
    """Top-of-book rows (BOOK); round_ns floors times, which makes rows share them."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click", "signup"))
    mid, half = 100 + F.col("value") / 100, 0.01 * (1 + F.col("k") % 5)
    rx = F.col("rx") - F.col("rx") % round_ns
    return e.select(
        _listing().alias("listing"), "seq", rx.alias("rx"), (rx - (F.col("k") % 7) * F.lit(1_000_000_000).cast("long")).alias("exchange_time"),
        (mid - half).alias("bid_prc"), (1 + F.col("k")).cast("double").alias("bid_qty"), (mid + half).alias("ask_prc"), (1 + (7 * F.col("k") + 3) % 100).cast("double").alias("ask_qty"),
    )


def trades(spark: SparkSession, sf_dir: str, round_ns: int = 1) -> DataFrame:
    """Trade rows (TRADE)."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    rx = F.col("rx") - F.col("rx") % round_ns
    return e.select(
        _listing().alias("listing"), "seq", rx.alias("rx"), (rx - (F.col("k") % 7) * F.lit(1_000_000_000).cast("long")).alias("exchange_time"),
        F.when(F.col("k") % 2 == 0, "Bid").otherwise("Ask").alias("aggressor"), (100 + F.col("value") / 100).alias("prc"), (1 + F.col("k")).cast("double").alias("qty"),
    )
