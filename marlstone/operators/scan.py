"""Running values over time, without one task per listing.

A window over a listing's whole history is one task however large the cluster. Here time is cut in two levels. A chunk is
CHUNK nanoseconds long: its rows are scanned apart, as one window partition. Chunks are known by one row each, and FAN
chunks make a span: the rows of a span's chunks are scanned apart too, and a table with one row per span (a dozen a year)
across spans. What is carried is joined back. So no window partition holds more than the rows of ten minutes, or FAN rows
of chunks, whatever the length of the history; at the 13 million events a day of a busy listing that is some 90,000 rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Nanoseconds of a chunk, and chunks of a span.
CHUNK = 600_000_000_000
FAN = 4096


@dataclass(frozen=True)
class Carry:
    """How values of rows combine into one: as an aggregate or over a window, and of a nearer and a farther part."""

    over: Callable[[Column], Column]
    total: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


SUM = Carry(F.sum, F.sum, lambda near, far: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
MAX = Carry(F.max, F.max, F.greatest)
LAST = Carry(lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_chunk"))), F.coalesce)


def in_chunks(df: DataFrame, time: str, chunk: int = CHUNK) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(time) / chunk).cast("long"))


def same_chunk(keys: Sequence[str]) -> list[str]:
    return [*keys, "_chunk"]


def _in_spans(per: DataFrame) -> DataFrame:
    return per.withColumn("_span", F.floor(F.col("_chunk") / FAN).cast("long"))


def before_chunk(per: DataFrame, keys: Sequence[str], carries: dict[str, Carry]) -> DataFrame:
    """per (keys, _chunk, columns of `carries`), one row per chunk -> the same, each column combined over all earlier chunks."""
    per = _in_spans(per)
    inside = W.partitionBy(*keys, "_span").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = per.groupBy(*keys, "_span").agg(*(c.total(F.col(n)).alias(n) for n, c in carries.items()))
    spans = spans.select(*keys, "_span", *(c.over(F.col(n)).over(across).alias(f"_far{n}") for n, c in carries.items()))
    out = per.withColumns({n: c.over(F.col(n)).over(inside) for n, c in carries.items()}).join(spans, [*keys, "_span"])
    return out.select(*same_chunk(keys), *(c.both(F.col(n), F.col(f"_far{n}")).alias(n) for n, c in carries.items()))


def running(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """`df` with inclusive running sums, by keys, in the given order, which must start with time and be total."""
    df = in_chunks(df.withColumns({f"_{n}": c for n, c in sums.items()}), time, chunk)
    inside = W.partitionBy(*same_chunk(keys)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per = df.groupBy(*same_chunk(keys)).agg(*(F.sum(f"_{n}").alias(f"_b_{n}") for n in sums))
    per = before_chunk(per, keys, {f"_b_{n}": SUM for n in sums})
    out = df.withColumns({n: F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums}).join(per, same_chunk(keys))
    out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_chunk", *(f"_{n}" for n in sums), *(f"_b_{n}" for n in sums))


def carried(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], values: Sequence[str], chunk: int = CHUNK, when: Column | None = None) -> DataFrame:
    """`df` with each of `values` replaced by its last value so far: of rows where `when` holds (then nulls carry too),
    or else of rows where the value itself is not null."""
    df = in_chunks(df, time, chunk)
    if when is not None:
        packs = {"_pack": F.when(when, F.struct(*values))}
    else:
        packs = {f"_pack_{v}": F.when(F.col(v).isNotNull(), F.struct(v)) for v in values}
    df = df.withColumns(packs)
    inside = W.partitionBy(*same_chunk(keys)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # only rows that have a value are sorted for the last one; of the others, chunks are counted in by their numbers
    known = reduce(Column.__or__, (F.col(p).isNotNull() for p in packs))
    some = df.where(known).groupBy(*same_chunk(keys)).agg(*(F.max_by(p, F.when(F.col(p).isNotNull(), F.struct(*order))).alias(f"_b{p}") for p in packs))
    per = df.select(*same_chunk(keys)).distinct().join(some, same_chunk(keys), "left")
    per = before_chunk(per, keys, {f"_b{p}": LAST for p in packs})
    out = df.withColumns({p: F.last(p, ignorenulls=True).over(inside) for p in packs}).join(per, same_chunk(keys))
    fresh = {}
    for v in values:
        p = "_pack" if when is not None else f"_pack_{v}"
        fresh[v] = F.coalesce(p, f"_b{p}").getField(v)
    return out.withColumns(fresh).drop("_chunk", *packs, *(f"_b{p}" for p in packs))


def highest(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], values: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """`df` with each of `values` replaced by the greatest one so far."""
    df = in_chunks(df, time, chunk)
    inside = W.partitionBy(*same_chunk(keys)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per = before_chunk(df.groupBy(*same_chunk(keys)).agg(*(F.max(v).alias(f"_b_{v}") for v in values)), keys, {f"_b_{v}": MAX for v in values})
    out = df.withColumns({v: F.max(v).over(inside) for v in values}).join(per, same_chunk(keys))
    return out.withColumns({v: F.greatest(v, f"_b_{v}") for v in values}).drop("_chunk", *(f"_b_{v}" for v in values))


def numbered(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], name: str = "n", chunk: int = CHUNK) -> DataFrame:
    """Row number from 1."""
    return running(df, keys, time, order, {name: F.lit(1)}, chunk)


def _next_chunks(df: DataFrame, keys: Sequence[str], far: int) -> DataFrame:
    """(keys, _chunk, _next): each chunk that has rows, with each of the `far` chunks with rows that follow it."""
    per = _in_spans(df.select(*same_chunk(keys)).distinct())
    inside = W.partitionBy(*keys, "_span").orderBy("_chunk")
    heads = per.groupBy(*keys, "_span").agg(F.slice(F.sort_array(F.collect_list("_chunk")), 1, far).alias("_heads"))  # of FAN numbers at most
    after = F.flatten(F.collect_list("_heads").over(W.partitionBy(*keys).orderBy("_span").rowsBetween(1, far)))
    here = F.filter(F.array(*(F.lead("_chunk", j).over(inside) for j in range(1, far + 1))), lambda x: x.isNotNull())
    both = per.withColumn("_here", here).join(heads.select(*keys, "_span", after.alias("_after")), [*keys, "_span"])
    return both.select(*same_chunk(keys), F.explode(F.slice(F.concat("_here", "_after"), 1, far)).alias("_next"))


def neighbours(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], back: dict[str, tuple[str, int]], chunk: int = CHUNK) -> DataFrame:
    """`df` with columns of earlier rows: name -> (column, how many rows before; null where there is none).

    The last rows of each chunk are also dealt to the chunks that follow, as many as are looked back.
    """
    far = max(k for _, k in back.values())
    df = in_chunks(df, time, chunk)
    need = sorted({c for c, _ in back.values()} | {*keys, *order})
    last = W.partitionBy(*same_chunk(keys)).orderBy(*(F.desc(c) for c in order))
    tails = df.select(*need, "_chunk").withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= far)
    lent = tails.join(_next_chunks(df, keys, far), same_chunk(keys)).select(*need, F.col("_next").alias("_chunk")).withColumn("_lent", F.lit(True))
    both = df.withColumn("_lent", F.lit(False)).unionByName(lent, allowMissingColumns=True)
    w = W.partitionBy(*same_chunk(keys)).orderBy(*order)
    return both.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in back.items()}).where("not _lent").drop("_lent", "_chunk")
