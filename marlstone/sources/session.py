"""Sessions: the book and trade rows of a stretch of time, cut, carried on and kept.

A build that goes block by block seeds each block with the tail of the one before, as long as its longest memory, and
drops the rows of the tail from its result. A tail can be kept, so that a later run goes on where an earlier one ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Session:
    book: DataFrame
    trade: DataFrame

    def each(self, f: Callable[[DataFrame], DataFrame]) -> Session:
        return Session(f(self.book), f(self.trade))


def cut(s: Session, lo: int, hi: int) -> Session:
    """Rows with lo <= rx < hi; a filter that reaches the scan."""
    return s.each(lambda df: df.where((F.col("rx") >= lo) & (F.col("rx") < hi)))


def tail(s: Session, window: int, upto: int | None = None) -> Session:
    """Rows of the last `window` before `upto`; None: up to the last row, inclusive."""
    if upto is None:
        ends = [df.agg(F.max("rx")).first()[0] for df in (s.book, s.trade)]
        upto = max((x for x in ends if x is not None), default=0) + 1
    return cut(s, upto - window, upto)


def concat(parts: Sequence[Session]) -> Session:
    """One session of several, in any order: operators sort by time themselves."""
    out = parts[0]
    for p in parts[1:]:
        out = Session(out.book.unionByName(p.book), out.trade.unionByName(p.trade))
    return out


def save(s: Session, path: str) -> None:
    for name, df in (("book", s.book), ("trade", s.trade)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Session:
    return Session(*(spark.read.parquet(f"{path}/{name}") for name in ("book", "trade")))
