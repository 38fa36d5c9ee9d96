"""Column expressions of market atoms. Division never raises: what is undefined is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid(bid="bid_prc", ask="ask_prc") -> Column:
    return (F.col(bid) + F.col(ask)) / 2


def microprice() -> Column:
    """Sizes weigh the opposite side's price."""
    return (F.col("bid_qty") * F.col("ask_prc") + F.col("ask_qty") * F.col("bid_prc")) / F.greatest(F.col("bid_qty") + F.col("ask_qty"), F.lit(1e-30))


def spread_width() -> Column:
    return (F.col("ask_prc") - F.col("bid_prc")) / F.greatest(microprice(), F.lit(1e-30))


def depth() -> Column:
    return F.col("bid_qty") + F.col("ask_qty")


def imbalance() -> Column:
    return F.try_divide(F.col("bid_qty") - F.col("ask_qty"), depth())


def spread_wide(threshold: float = 1e-4) -> Column:
    return F.when(spread_width() > threshold, 1.0).otherwise(0.0)


def premium() -> Column:
    return (microprice() - mid()) / mid()


def valid_l1() -> Column:
    ok = F.lit(True)
    for c in ("bid_prc", "bid_qty", "ask_prc", "ask_qty"):
        ok = ok & (F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c)
    return ok


def ofi_step(prefix: str = "p_") -> Column:
    """Depth added at the bid less depth added at the ask, against the previous state in prefixed columns; null if none."""
    b, a = F.col("bid_prc"), F.col("ask_prc")
    pb, pa = F.col(f"{prefix}bid_prc"), F.col(f"{prefix}ask_prc")
    bid = F.when(b >= pb, F.col("bid_qty")).otherwise(0.0) - F.when(b <= pb, F.col(f"{prefix}bid_qty")).otherwise(0.0)
    ask = F.when(a <= pa, F.col("ask_qty")).otherwise(0.0) - F.when(a >= pa, F.col(f"{prefix}ask_qty")).otherwise(0.0)
    return F.when(pb.isNotNull(), bid - ask)


def lifts_ask(inverted: frozenset[str] = frozenset()) -> Column:
    """Whether a trade lifts the ask; on inverted venues the aggressor field names the other side."""
    other = F.col("listing").isin(*inverted) if inverted else F.lit(False)
    return F.when(other, F.col("aggressor") == "Ask").otherwise(F.col("aggressor") == "Bid")


def sign(inverted: frozenset[str] = frozenset()) -> Column:
    return F.when(lifts_ask(inverted), 1.0).otherwise(-1.0)


def good_print() -> Column:
    return (F.col("prc") > 0) & (F.col("qty") > 0)
