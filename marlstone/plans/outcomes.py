"""What happens after a read: prices at entry and exit, moves and trades between. Values are log-ratios to the mid at t."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import market as m
from ..operators import events as ev
from ..operators.align import asof
from ..operators.scan import neighbours, running
from ..sources.staging import staged

INF = float("inf")


def _ends(values: DataFrame, spans: DataFrame) -> DataFrame:
    """values (side, n, prc), numbered from 1; spans (t, side, i, j): i <= j -> (t, side, lo, hi) of prc over i..j.

    A span of 2^l values and more, but fewer than twice as many, is the union of its first and its last 2^l. A run of 2^l
    values is the end of one aligned block of that length and the start of the next. So each span is four equi-join
    look-ups, in tables of running extremes inside blocks, of the lengths that spans have.
    """
    spans = spans.withColumn("l", F.floor(F.log2((F.col("j") - F.col("i") + 1) + 0.5)).cast("int")).withColumn("_w", F.expr("1L << l"))
    top = spans.agg(F.max("l").alias("_top"))
    at = values.join(F.broadcast(top)).select("side", "n", "prc", F.explode(F.sequence(F.lit(0), "_top")).alias("l"))  # one row
    w = W.partitionBy("side", "l", F.expr("(n - 1) >> l")).orderBy("n")
    start, end = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    runs = at.select("side", "l", "n", *(f("prc").over(x).alias(c) for c, f, x in (("lo0", F.min, end), ("hi0", F.max, end), ("lo1", F.min, start), ("hi1", F.max, start))))
    edges = F.array(*(F.struct(F.lit(k).alias("edge"), F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi")) for k in (0, 1)))
    table = runs.select("side", "l", "n", F.explode(edges).alias("x")).select("side", "l", "n", "x.*")
    places = F.array(*(F.struct(F.lit(k).alias("edge"), x.cast("long").alias("n")) for k, x in ((0, F.col("i")), (1, F.col("i") + F.col("_w") - 1), (0, F.col("j") - F.col("_w") + 1), (1, F.col("j")))))
    asked = spans.select("t", "side", "l", F.explode(places).alias("x")).select("t", "side", "l", "x.*")
    return asked.join(table, ["side", "l", "n", "edge"]).groupBy("t", "side").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _between(trade: DataFrame, reads: DataFrame) -> DataFrame:
    """reads (t, entry, exit) -> (t, and of each side _min, _max, _n, _v) of trades from entry up to the exit time: counts
    and values are differences of running sums, extremes come from _ends()."""
    buy, value = F.col("_buy"), F.col("prc") * F.col("qty")
    own = trade.where(m.good_print()).select("listing", "rx", "seq", "prc", "qty", m.lifts_ask().alias("_buy"))
    sums = {f"{s}_{n}": F.when(on, x).otherwise(F.lit(0).cast(kind)) for s, on in (("buy", buy), ("sell", ~buy)) for n, x, kind in (("n", F.lit(1).cast("long"), "long"), ("v", value, "double"))}
    own = staged(running(own, ["listing"], "rx", ["rx", "seq"], sums).drop("listing"))
    both = reads.select("t", F.explode(F.array(F.struct(F.lit("e").alias("w"), F.col("entry").alias("at")), F.struct(F.lit("x").alias("w"), F.col("exit").alias("at")))).alias("_")).select("t", "_.*")
    both = asof(both, own, [], list(sums), at="at", seq="seq", strict=True)
    ends = both.groupBy("t").agg(*(F.coalesce(F.max(F.when(F.col("w") == w, F.col(c))), F.lit(0)).alias(f"{w}_{c}") for w in "ex" for c in sums))
    ends = staged(ends)
    side = lambda s: F.struct(F.lit(s == "buy").alias("side"), (F.col(f"e_{s}_n") + 1).alias("i"), F.col(f"x_{s}_n").alias("j"))
    spans = ends.select("t", F.explode(F.array(side("buy"), side("sell"))).alias("_")).select("t", "_.*").where("i <= j")
    values = own.select(buy.alias("side"), F.when(buy, F.col("buy_n")).otherwise(F.col("sell_n")).alias("n"), "prc")
    out = ends.select("t", *(x for s in ("buy", "sell") for x in ((F.col(f"x_{s}_n") - F.col(f"e_{s}_n")).alias(f"_{s}_n"), F.when(F.col(f"x_{s}_n") > F.col(f"e_{s}_n"), F.col(f"x_{s}_v") - F.col(f"e_{s}_v")).alias(f"_{s}_v"))))
    far = _ends(values, spans)
    per = far.groupBy("t").agg(*(F.max(F.when(F.col("side") == (s == "buy"), F.col(c))).alias(f"_{s}_{n}") for s in ("buy", "sell") for c, n in (("lo", "min"), ("hi", "max"))))
    return out.join(per, "t", "left")


def outcomes(book: DataFrame, trade: DataFrame, reads: DataFrame, horizon: int, baseline: int = 0, processing: int = 0, latency_rows: int = 30_000, fields: Sequence[str] | None = None) -> DataFrame:
    """reads (t) of one listing's book and trade -> (t, fields); fields None: all.

    Entry is at t + baseline + excess latency + processing, on the book at or before it; exit is the last book before
    t + horizon, not before entry's. Trades count from entry up to the exit time.
    """
    raw = staged(ev.last_per_time(ev.latency_excess(book, latency_rows)).withColumn("mid", m.mid()))
    s = neighbours(raw, ["listing"], "rx", ["rx", "seq"], {"_p": ("mid", 1)})
    d = F.coalesce(F.log(F.col("mid") / F.col("_p")), F.lit(0.0))
    s = staged(running(s.withColumn("_d", d), ["listing"], "rx", ["rx"], {
        "n": F.lit(1), "ups": F.when(F.col("_d") > 0, 1).otherwise(0), "downs": F.when(F.col("_d") < 0, 1).otherwise(0), "up": F.greatest("_d", F.lit(0.0)), "down": F.greatest(-F.col("_d"), F.lit(0.0)),
    }).drop("listing", "_d", "_p"))
    read = ["bid_prc", "ask_prc", "mid", "latency", "excess", "n", "ups", "downs", "up", "down"]

    def as_of(df: DataFrame, at: str) -> DataFrame:
        return asof(df, s.select("rx", *read), [], read, at=at)

    q = as_of(reads.select("t"), "t").select("t", *(F.col(c).alias(f"v_{c}") for c in read))
    q = staged(q).withColumn("entry", F.col("t") + baseline + processing + F.coalesce("v_excess", F.lit(0))).withColumn("exit", F.col("t") + horizon)
    # entry and exit in one scan; the last book strictly before the exit is that at or before one nanosecond less
    both = q.select("t", F.explode(F.array(F.struct(F.lit("e").alias("w"), F.col("entry").alias("at")), F.struct(F.lit("x").alias("w"), (F.col("exit") - 1).alias("at")))).alias("_")).select("t", "_.*")
    both = as_of(both, "at").groupBy("t").agg(*(F.max(F.when(F.col("w") == w, F.col(c))).alias(f"{w}_{c}") for w in "ex" for c in read))
    q = staged(q.join(both, "t"))
    seen, ok = F.col("v_n").isNotNull(), F.col("v_n").isNotNull() & (F.coalesce("x_n", F.lit(0)) >= F.col("e_n"))

    def ratio(c: str, when) -> F.Column:
        return F.when(when & (F.col(c) > 0), F.log(F.col(c) / F.col("v_mid"))).otherwise(0.0)

    q = q.withColumns({"_seen": F.coalesce(seen, F.lit(False)), "_ok": F.coalesce(ok, F.lit(False))})
    sides = [f"_{s}_{n}" for s in ("buy", "sell") for n in ("min", "max", "n", "v")]
    if fields is None or any("_trade_" in f for f in fields):
        q = q.join(_between(trade, q.where("_ok").select("t", "entry", "exit")), "t", "left")
    else:  # nobody asks what was traded
        q = q.withColumns({c: F.lit(None).cast("double") for c in sides})
    gain = lambda c: F.when(F.col("_ok"), F.col(f"x_{c}") - F.col(f"e_{c}")).otherwise(F.lit(0))
    low = lambda c, none: F.coalesce(F.log(F.col(c) / F.col("v_mid")), F.lit(none))
    out = {
        "eval_mid": F.coalesce("v_mid", F.lit(0.0)), "eval_bid_l": ratio("v_bid_prc", F.col("_seen")), "eval_ask_l": ratio("v_ask_prc", F.col("_seen")),
        "feed_latency_raw_ms": F.coalesce(F.col("v_latency") / 1e6, F.lit(0.0)), "feed_latency_excess_ms": F.coalesce(F.col("v_excess") / 1e6, F.lit(0.0)),
        "c_bid_entry_l": ratio("e_bid_prc", F.col("_seen")), "c_ask_entry_l": ratio("e_ask_prc", F.col("_seen")),
        "c_bid_exit_l": ratio("x_bid_prc", F.col("_ok")), "c_ask_exit_l": ratio("x_ask_prc", F.col("_ok")), "c_mid_exit_l": ratio("x_mid", F.col("_ok")),
        "c_mid_move_count": F.when(F.col("_seen") & (F.col("x_n") >= F.col("v_n")), F.col("x_ups") + F.col("x_downs") - F.col("v_ups") - F.col("v_downs")).otherwise(F.lit(0)),
        "c_mid_up_count": gain("ups"), "c_mid_down_count": gain("downs"), "c_mid_up_l": gain("up").cast("double"), "c_mid_down_l": gain("down").cast("double"),
        **{f"c_{s}_trade_{e}_l": low(f"_{s}_{e}", INF if e == "min" else -INF) for s in ("buy", "sell") for e in ("min", "max")},
        **{f"c_{s}_trade_count": F.coalesce(f"_{s}_n", F.lit(0)) for s in ("buy", "sell")},
        **{f"c_{s}_trade_value_l": F.when(F.col(f"_{s}_v") > 0, F.log(f"_{s}_v")).otherwise(F.lit(-INF)) for s in ("buy", "sell")},
    }
    want = list(out) if fields is None else list(fields)
    unknown = set(want) - set(out)
    if unknown:
        raise ValueError(f"unknown outcome fields {sorted(unknown)}")
    return q.select("t", *(out[f].alias(f) for f in want))
