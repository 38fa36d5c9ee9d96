"""Event normalisation per listing: what shares a time is one event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import market as m
from ..sources.market import with_ticks
from .scan import highest, neighbours, running

STATE = ("bid_prc", "bid_qty", "ask_prc", "ask_qty")


def last_per_time(df: DataFrame) -> DataFrame:
    """The last row, by seq, of each (listing, rx); an aggregation with a map-side combine."""
    rest = [c for c in df.columns if c not in ("listing", "rx")]
    return df.groupBy("listing", "rx").agg(F.max(F.struct("seq", *(c for c in rest if c != "seq"))).alias("_s")).select("listing", "rx", "_s.*").select(*df.columns)


def collapse_trades(trades: DataFrame) -> DataFrame:
    """Consecutive prints of one time and side become one: total qty, volume-weighted price; opposite sides stay apart."""
    back = neighbours(trades, ["listing"], "rx", ["rx", "seq"], {"_rx": ("rx", 1), "_side": ("aggressor", 1)})
    new = F.when((F.col("_rx") == F.col("rx")) & (F.col("_side") == F.col("aggressor")), 0).otherwise(1)
    w = W.partitionBy("listing", "rx").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    isle = back.withColumn("_isle", F.sum(new).over(w))
    return isle.groupBy("listing", "rx", "_isle").agg(
        F.min("seq").alias("seq"), F.first("aggressor").alias("aggressor"), (F.sum(F.col("qty") * F.col("prc")) / F.sum("qty")).alias("prc"), F.sum("qty").alias("qty"), F.count("*").alias("prints")
    ).drop("_isle")


def with_previous(df: DataFrame, columns=STATE, prefix: str = "p_") -> DataFrame:
    return neighbours(df, ["listing"], "rx", ["rx", "seq"], {f"{prefix}{c}": (c, 1) for c in columns})


def ofi_endpoint(book: DataFrame) -> DataFrame:
    """(listing, rx, ofi) between consecutive collapsed states; the first is 0."""
    return with_previous(last_per_time(book)).select("listing", "rx", F.coalesce(m.ofi_step(), F.lit(0.0)).alias("ofi"), F.col("p_bid_prc").isNull().alias("first"))


def ofi_path(book: DataFrame) -> DataFrame:
    """(listing, rx, ofi): increments over every raw row, summed per time; the first raw row has none."""
    return with_previous(book).withColumn("_o", m.ofi_step()).where("_o is not null").groupBy("listing", "rx").agg(F.sum("_o").alias("ofi"))


def mids(book: DataFrame) -> DataFrame:
    """(listing, rx, seq, mid) of the last row of each time."""
    return last_per_time(book.select("listing", "rx", "seq", m.mid().alias("mid")))


def mid_moves(mid: DataFrame) -> DataFrame:
    """(listing, rx, d): non-zero changes of log mid."""
    d = F.log("mid") - F.log("p_mid")
    return with_previous(mid, ["mid"]).select("listing", "rx", d.alias("d")).where("d <> 0")


def signed_volume(trades: DataFrame, inverted: frozenset[str] = frozenset()) -> DataFrame:
    """(listing, rx, signed, total, net, n) per time; net is the sum of sides."""
    s = m.sign(inverted)
    return trades.where(m.good_print()).groupBy("listing", "rx").agg(F.sum(s * F.col("qty")).alias("signed"), F.sum("qty").alias("total"), F.sum(s).alias("net"), F.count("*").alias("n"))


def net_signs(trades: DataFrame, inverted: frozenset[str] = frozenset()) -> DataFrame:
    """(listing, rx, eps): sign of the net side; ties are dropped."""
    return signed_volume(trades, inverted).select("listing", "rx", F.signum("net").alias("eps")).where("eps <> 0")


def sign_products(trades: DataFrame, inverted: frozenset[str] = frozenset()) -> DataFrame:
    """(listing, rx, per): sign times the one before."""
    back = neighbours(net_signs(trades, inverted), ["listing"], "rx", ["rx"], {"p_eps": ("eps", 1)})
    return back.where("p_eps is not null").select("listing", "rx", (F.col("eps") * F.col("p_eps")).alias("per"))


def rolling_min(df: DataFrame, value: str, rows: int, name: str) -> DataFrame:
    """Least of the last `rows` rows, for any width at one cost: rows are cut into blocks of that many, and a window is the
    end of one block and the start of the next."""
    n = running(df, ["listing"], "rx", ["rx", "seq"], {"_n": F.lit(1)}).withColumn("_b", F.floor((F.col("_n") - 1) / rows))
    up = W.partitionBy("listing", "_b").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("listing", "_b").orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, 0)
    n = n.withColumns({"_up": F.min(value).over(up), "_down": F.min(value).over(down)})
    tail = n.select("listing", (F.col("_n") + rows - 1).alias("_n"), F.col("_down").alias("_tail"))
    return n.join(tail, ["listing", "_n"], "left").withColumn(name, F.least("_up", F.coalesce("_tail", "_up"))).drop("_n", "_b", "_up", "_down", "_tail")


def latency_excess(book: DataFrame, rows: int = 30_000) -> DataFrame:
    """(…, latency, excess): rx less exchange_time, and that less its rolling least."""
    raw = book.where("exchange_time is not null").withColumn("latency", F.col("rx") - F.col("exchange_time"))
    return rolling_min(raw, "latency", rows, "_least").withColumn("excess", F.col("latency") - F.col("_least")).drop("_least")


def serial_covariance(trades: DataFrame, collapse: bool = True) -> DataFrame:
    """(listing, rx, seq, cov): product of consecutive price changes of collapsed trades, or else of every print; the first two are 0."""
    back = neighbours(collapse_trades(trades) if collapse else trades, ["listing"], "rx", ["rx", "seq"], {"_p1": ("prc", 1), "_p2": ("prc", 2)})
    return back.select("listing", "rx", "seq", F.coalesce((F.col("prc") - F.col("_p1")) * (F.col("_p1") - F.col("_p2")), F.lit(0.0)).alias("cov"))


def merged_levels(book: DataFrame, trades: DataFrame, ticks: DataFrame, inverted: frozenset[str] = frozenset()) -> DataFrame:
    """(listing, rx, bid_prc, ask_prc, bid_exchange_time, ask_exchange_time): quotes and prints fused by exchange time.

    Per side the newest by exchange time so far wins, of equal ones the latest in sequence (book before trade at a time).
    One row per time from the first snapshot on; a crossed pair is parted by one tick on its older side.
    """
    def side(kind: int, price, when=None):
        # compared field by field: exchange time, then place in the sequence
        x = F.struct(F.col("exchange_time").alias("x"), F.col("rx").alias("r"), F.lit(kind).alias("k"), F.col("seq").alias("q"), price.alias("p"))
        return x if when is None else F.when(when, x)

    b = book.dropna(subset=["bid_prc", "ask_prc", "exchange_time"]).select("listing", "rx", "seq", F.lit(0).alias("kind"), side(0, F.col("bid_prc")).alias("bid"), side(0, F.col("ask_prc")).alias("ask"))
    lifts = m.lifts_ask(inverted)
    t = trades.where(m.good_print()).dropna(subset=["exchange_time"]).select("listing", "rx", "seq", F.lit(1).alias("kind"), side(1, F.col("prc"), ~lifts).alias("bid"), side(1, F.col("prc"), lifts).alias("ask"))
    first = b.groupBy("listing").agg(F.min("rx").alias("_first"))
    run = highest(b.unionByName(t), ["listing"], "rx", ["rx", "kind", "seq"], ["bid", "ask"]).join(first, "listing").where(F.col("rx") >= F.col("_first"))
    run = run.select("listing", "rx", F.struct("kind", "seq").alias("_o"), "bid", "ask")
    last = run.groupBy("listing", "rx").agg(F.max(F.struct("_o", "bid", "ask")).alias("s")).select("listing", "rx", F.col("s.bid.p").alias("b"), F.col("s.ask.p").alias("a"), F.col("s.bid.x").alias("bid_exchange_time"), F.col("s.ask.x").alias("ask_exchange_time"))
    crossed, ask_fresher = F.col("a") < F.col("b"), F.col("ask_exchange_time") >= F.col("bid_exchange_time")
    last = with_ticks(last, ticks)
    return last.select("listing", "rx", F.when(crossed & ask_fresher, F.col("a") - F.col("tick")).otherwise(F.col("b")).alias("bid_prc"), F.when(crossed & ~ask_fresher, F.col("b") + F.col("tick")).otherwise(F.col("a")).alias("ask_prc"), "bid_exchange_time", "ask_exchange_time")
