"""Exponential averages as closed forms over chunks, so that no task walks a whole series.

With decay d = 1 - 2 / (span + 1) and rows numbered n, sum(d^(n - j) x_j) is a running sum of x_j d^-j, times d^n. The
powers would overflow, so rows are cut into chunks of L = 45 / -ln d rows, powers count from a chunk's start, and the
chunk before contributes one number. Anything older weighs less than e^-45.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged
from .align import asof, each_listing, tick_index
from .scan import carried


def alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def chunk_rows(span: float) -> int:
    return math.ceil(45.0 / -math.log(1.0 - alpha(span)))


def ewm(df: DataFrame, keys: Sequence[str], n: str, values: dict[str, Column], span: float, order: Sequence[str] = ()) -> DataFrame:
    """y_i = a x_i + (1 - a) y_(i-1), from zero, for rows numbered 1, 2, ... in column n; a span of 1 is x itself."""
    if span <= 1:
        return df.withColumns(values)
    a, d, size = alpha(span), 1.0 - alpha(span), chunk_rows(span)
    i = F.col(n) - 1
    df = df.withColumns({f"_x_{v}": F.coalesce(c.cast("double"), F.lit(0.0)) for v, c in values.items()} | {"_c": F.floor(i / size).cast("long"), "_p": (i % size).cast("double")})
    up = F.pow(F.lit(d), -F.col("_p"))
    inside = W.partitionBy(*keys, "_c").orderBy(n).rowsBetween(W.unboundedPreceding, 0)
    per = df.groupBy(*keys, "_c").agg(*((F.sum(F.col(f"_x_{v}") * up) * (a * d ** (size - 1))).alias(f"_t_{v}") for v in values)).withColumn("_c", F.col("_c") + 1)
    out = df.withColumns({v: F.sum(F.col(f"_x_{v}") * up).over(inside) * a * F.pow(F.lit(d), F.col("_p")) for v in values})
    out = out.join(per, [*keys, "_c"], "left")
    out = out.withColumns({v: F.col(v) + F.coalesce(F.col(f"_t_{v}"), F.lit(0.0)) * F.pow(F.lit(d), F.col("_p") + 1) for v in values})
    return out.drop("_c", "_p", *(f"_x_{v}" for v in values), *(f"_t_{v}" for v in values))


def debiased(value: Column, n: Column, span: float) -> Column:
    """An average from zero over its own rows, divided by the weights it has had so far."""
    return value / (1 - F.pow(F.lit(1.0 - alpha(span)), n))


def kernel(events: DataFrame, clock: DataFrame, reads: DataFrame, listings: Sequence[str], values: dict[str, Column], span: float, indexed: bool = False) -> DataFrame:
    """Flows that decay at every tick of a shared clock, read at any time.

    events (listing, rx, ...): value v adds a v; every tick after or at rx multiplies by 1 - a. reads (t). Returns
    (listing, t, values). With k ticks before an event and C up to a read, E = a sum d^(C - k) v over events up to it.
    indexed: events and reads already carry their numbers of ticks, as k and c.
    """
    a, d = alpha(span), 1.0 - alpha(span)
    ev = events if indexed else tick_index(events, clock, "rx", "k", before=True)
    rd = reads if indexed else tick_index(reads, clock, "t", "c")
    ev = ev.select("listing", F.col("rx").alias("_t"), F.lit(0).alias("_kind"), F.col("k").alias("_m"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(v) for v, c in values.items()))
    rd = each_listing(rd.select("t", F.col("c").alias("_m")), listings).select("listing", F.col("t").alias("_t"), F.lit(1).alias("_kind"), "_m", *(F.lit(0.0).alias(v) for v in values))
    both = ev.unionByName(rd)
    if span <= 1:  # only what came since the last tick is left
        inside = W.partitionBy("listing", "_m").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
        out = both.withColumns({v: F.sum(v).over(inside) for v in values})
    else:
        size = chunk_rows(span)
        both = both.withColumns({"_c": F.floor(F.col("_m") / size).cast("long"), "_d": (F.col("_m") % size).cast("double")})
        inside = W.partitionBy("listing", "_c").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
        up = F.pow(F.lit(d), -F.col("_d"))
        per = both.groupBy("listing", "_c").agg(*(F.sum(F.col(v) * F.pow(F.lit(d), size - F.col("_d"))).alias(f"_t_{v}") for v in values)).withColumn("_c", F.col("_c") + 1)
        out = both.withColumns({v: F.sum(F.col(v) * up).over(inside) for v in values}).join(per, ["listing", "_c"], "left")
        out = out.withColumns({v: a * F.pow(F.lit(d), F.col("_d")) * (F.col(v) + F.coalesce(F.col(f"_t_{v}"), F.lit(0.0))) for v in values})
    return out.where("_kind = 1").select("listing", F.col("_t").alias("t"), *values)


def means(events: DataFrame, reads: DataFrame, listings: Sequence[str], value: Column, spans: dict[str, float], weight: Column | None = None) -> DataFrame:
    """(listing, t, names): weighted means of kernel flows, by name of a span; null before a listing's first event.

    events (listing, rx, k, ...), numbered as for kernel; reads (t). Both sums decay alike, so a mean changes at events
    only: it is taken there, and all spans are read by one as-of read.
    """
    base = events.select("listing", "rx", "k", F.coalesce(value.cast("double"), F.lit(0.0)).alias("_v"), (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))).alias("_w"))
    out = base
    for name, span in spans.items():
        d, size = (1.0 - alpha(span), chunk_rows(span)) if span > 1 else (1.0, 1)
        chunk, at = F.floor(F.col("k") / size).cast("long"), (F.col("k") % size).cast("double")
        inside = W.partitionBy("listing", "_c").orderBy("rx").rangeBetween(W.unboundedPreceding, 0)  # what shares a time counts together
        out = out.withColumn("_c", chunk)
        e, w = (F.sum(F.col(f"_{x}") * F.pow(F.lit(d), -at)).over(inside) for x in "vw")
        out = out.withColumns({"_e": e, "_s": w})
        if span > 1:  # or else only what came since the last tick is left
            last = F.pow(F.lit(d), size - at)
            per = base.groupBy("listing", (chunk + 1).alias("_c")).agg(F.sum(F.col("_v") * last).alias("_tv"), F.sum(F.col("_w") * last).alias("_tw"))
            out = out.join(per, ["listing", "_c"], "left").withColumns({"_e": F.col("_e") + F.coalesce("_tv", F.lit(0.0)), "_s": F.col("_s") + F.coalesce("_tw", F.lit(0.0))}).drop("_tv", "_tw")
        out = out.withColumn(name, mean("_e", "_s")).drop("_c", "_e", "_s")
    own = staged(out.where(F.col(next(iter(spans))).isNotNull()).select("listing", "rx", *spans))
    return asof(each_listing(reads.select("t"), listings), own, ["listing"], list(spans)).select("listing", "t", *spans)


def held(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("listing",), at: str = "t") -> DataFrame:
    """Each value's last one that was not null."""
    return carried(df, keys, at, [at], values)


def mean(num: str, den: str) -> Column:
    """num / den, null where den is not above zero."""
    return F.when(F.col(den) > 0, F.col(num) / F.col(den))
