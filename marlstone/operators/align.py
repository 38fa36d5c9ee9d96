"""Alignment in time: as-of reads, clocks, grids, and sums between ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK, carried, numbered, running

#: Grid times that one task makes at a time.
GRID = 65_536


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "t", time: str = "rx", seq: str | None = None, strict: bool = False, chunk: int = CHUNK) -> DataFrame:
    """`left` with `values` of the last row of `right` at or before left's time (strict: before it), by keys; null if none.

    A union and a scan: each side is read and shuffled once, whatever the number of matches.
    """
    order = [c for c in left.columns if c not in keys]
    own = left.withColumns({"_t": F.col(at), "_kind": F.lit(0 if strict else 1), "_seq": F.lit(0).cast("long")})
    event = right.select(*keys, F.col(time).alias("_t"), F.lit(1 if strict else 0).alias("_kind"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("_seq"), *values)
    own = own.drop(*(v for v in values if v in order))
    both = event.unionByName(own, allowMissingColumns=True)
    out = carried(both, keys, "_t", ["_t", "_kind", "_seq"], values, chunk, F.col("_kind") == (1 if strict else 0))
    return out.where(F.col("_kind") == (0 if strict else 1)).drop("_t", "_kind", "_seq")


def asof_clipped(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "t", time: str = "rx", **options) -> DataFrame:
    """As asof, but before the first row of `right` that row's values."""
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*values), time).alias("_first"))
    out = asof(left, right, keys, values, at, time, **options).join(first, list(keys), "left")
    return out.withColumns({v: F.coalesce(v, F.col("_first").getField(v)) for v in values}).drop("_first")


def each_listing(df: DataFrame, listings: Sequence[str]) -> DataFrame:
    """One copy of every row per listing."""
    return df.withColumn("listing", F.explode(F.array(*map(F.lit, listings))))


def trade_clock(trades: DataFrame) -> DataFrame:
    """(rx, n): distinct trade times of all listings, numbered from 1."""
    return numbered(trades.select("rx").distinct(), [], "rx", ["rx"])


def event_grid(*streams: DataFrame) -> DataFrame:
    """(t): distinct times of all streams."""
    out = streams[0].select("rx")
    for s in streams[1:]:
        out = out.unionByName(s.select("rx"))
    return out.distinct().withColumnRenamed("rx", "t")


def uniform_grid(clock: DataFrame, warm_ticks: int, horizon: int, step: int) -> DataFrame:
    """(t): from the first tick past the warm-up, by step, up to a horizon before the last tick."""
    ends = clock.agg(F.min(F.when(F.col("n") > warm_ticks, F.col("rx"))).alias("a"), (F.max("rx") - horizon).alias("b")).where("a < b")
    # one row for each GRID times, dealt out, and then each time: no task makes the whole grid
    starts = ends.select("b", F.explode(F.expr(f"sequence(a, b - 1, {step * GRID}L)")).alias("_s")).repartition("_s")
    return starts.select(F.explode(F.expr(f"sequence(_s, least(b - 1, _s + {step * (GRID - 1)}L), {step}L)")).alias("t"))


def active_grid(grid: DataFrame, events: DataFrame, step: int) -> DataFrame:
    """Grid times with an event in (t - step, t]."""
    start = grid.agg(F.min("t").alias("_a"))
    hit = events.select("rx").crossJoin(F.broadcast(start)).select((F.ceil((F.col("rx") - F.col("_a")) / step) * step + F.col("_a")).cast("long").alias("t")).distinct()  # one row, broadcast
    return grid.join(hit, "t", "left_semi")


def masked_steps(mask: str, book: DataFrame, trade: DataFrame, moves: DataFrame, step: int, low: int, high: int) -> DataFrame:
    """(t): numbers of the grid steps in low..high that have an event of the mask; only those are made.

    none: all; book, trade, both: the step an event falls in; trade_or_move: the step at which it is first seen.
    """
    floor, ceil = F.floor(F.col("rx") / step), F.floor((F.col("rx") + step - 1) / step)
    if mask == "none":
        return book.sparkSession.range(low, high + 1).select(F.col("id").alias("t"))
    source = {"book": [(book, floor)], "trade": [(trade, floor)], "both": [(book, floor), (trade, floor)], "trade_or_move": [(trade, ceil), (moves, ceil)]}[mask]
    out = None
    for df, t in source:
        own = df.select(t.cast("long").alias("t"))
        out = own if out is None else out.unionByName(own)
    return out.where(F.col("t").between(low, high)).distinct()


def bucket_sum(events: DataFrame, keys: Sequence[str], step: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over (t - step, t] for steps that have an event: t is the step's number."""
    t = F.floor((F.col("rx") + step - 1) / step).cast("long").alias("t")
    return events.groupBy(*keys, t).agg(*(F.sum(c).alias(n) for n, c in sums.items()))


def tick_index(df: DataFrame, clock: DataFrame, at: str, name: str, before: bool = False) -> DataFrame:
    """Number of ticks at or before each row's time (before: strictly before)."""
    kind = 0 if before else 2
    own = df.withColumns({"_t": F.col(at), "_kind": F.lit(kind), "_tick": F.lit(0)})
    ticks = clock.select(F.col("rx").alias("_t"), F.lit(1).alias("_kind"), F.lit(1).alias("_tick"))
    both = own.unionByName(ticks, allowMissingColumns=True)
    return running(both, [], "_t", ["_t", "_kind"], {name: F.col("_tick")}).where(F.col("_kind") == kind).drop("_t", "_kind", "_tick")


def interval_sum(events: DataFrame, clock: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, n, sums): of each tick n, over (previous tick, tick]; ticks without events and events after the last tick are left out."""
    own = tick_index(events, clock, "rx", "_k", before=True).withColumn("n", F.col("_k") + 1)
    return own.groupBy(*keys, "n").agg(*(F.sum(c).alias(c_) for c_, c in sums.items()))


def trailing_count(left: DataFrame, events: DataFrame, keys: Sequence[str], width: int, name: str, at: str = "t") -> DataFrame:
    """Events in (t - width, t]: the difference of two running counts."""
    counted = running(events.select(*keys, "rx", F.lit(1).alias("_one")).groupBy(*keys, "rx").agg(F.sum("_one").alias("_one")), keys, "rx", ["rx"], {"_run": F.col("_one")}).select(*keys, "rx", "_run")
    now = asof(left, counted, keys, ["_run"], at).withColumnsRenamed({"_run": "_now"}).withColumn("_then", F.col(at) - width)
    out = asof(now, counted, keys, ["_run"], "_then")
    return out.withColumn(name, (F.coalesce("_now", F.lit(0)) - F.coalesce("_run", F.lit(0))).cast("long")).drop("_now", "_run", "_then")


def nth_after(left: DataFrame, events: DataFrame, keys: Sequence[str], n: int, values: Sequence[str], at: str = "t") -> DataFrame:
    """Values of the n-th event strictly after t: an as-of read of the running number, and an equi-join on number + n."""
    own = numbered(events, keys, "rx", ["rx"], "_n")
    now = asof(left, own, keys, ["_n"], at).withColumn("_n", F.coalesce("_n", F.lit(0)) + n)
    return now.join(own.select(*keys, "_n", *values), [*keys, "_n"], "left").drop("_n")


def with_event(grid: DataFrame, events: DataFrame, step: int) -> DataFrame:
    """Grid times t, whole numbers of steps, with an event in [t, t + step)."""
    hit = events.select((F.floor(F.col("rx") / step) * step).cast("long").alias("t")).distinct()
    return grid.join(hit, "t", "left_semi")
