"""A market: its streams, clock, mids and yardsticks, as lazily built frames that the features share."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import market as m
from ..operators import events as ev
from ..operators.align import asof, asof_clipped, each_listing, tick_index, trade_clock
from ..operators.ema import alpha, ewm, kernel, means
from ..sources.staging import staged


@dataclass
class Market:
    """book and trade as BOOK and TRADE rows; reads (t): the times at which features are read."""

    book: DataFrame
    trade: DataFrame
    listings: tuple[str, ...]
    target: str
    reads: DataFrame
    yard_span: float = 60
    inverted: frozenset[str] = field(default_factory=frozenset)
    _yards: dict = field(default_factory=dict, repr=False)

    @property
    def others(self) -> list[str]:
        return [x for x in self.listings if x != self.target]

    @cached_property
    def clock(self) -> DataFrame:
        return staged(trade_clock(self.trade))

    @cached_property
    def at_reads(self) -> DataFrame:
        """(t, c): reads with their number of ticks."""
        return staged(tick_index(self.reads, self.clock, "t", "c"))

    @cached_property
    def mids(self) -> DataFrame:
        return staged(ev.mids(self.book))

    @cached_property
    def moves(self) -> DataFrame:
        return staged(tick_index(ev.mid_moves(self.mids), self.clock, "rx", "k", before=True))

    @cached_property
    def gaps(self) -> DataFrame:
        """(n, rx, dt): seconds since the tick before; 0 at the first."""
        back = self.clock.withColumnsRenamed({"n": "n0", "rx": "rx0"}).withColumn("n", F.col("n0") + 1)
        return self.clock.join(back, "n", "left").select("n", "rx", F.coalesce((F.col("rx") - F.col("rx0")) / 1e9, F.lit(0.0)).alias("dt"))

    # readings

    def flow(self, events: DataFrame, values: dict[str, Column], span: float) -> DataFrame:
        """(listing, t, values): kernel flows of events (listing, rx, ...)."""
        if "k" not in events.columns:
            events = tick_index(events, self.clock, "rx", "k", before=True)
        return kernel(events, self.clock, self.at_reads, self.listings, values, span, indexed=True)

    def flow_means(self, events: DataFrame, value: Column, spans: dict[str, float], weight: Column | None = None) -> DataFrame:
        """(listing, t, names): E / W by name of a span, held where a flow has decayed to nothing."""
        if "k" not in events.columns:
            events = tick_index(events, self.clock, "rx", "k", before=True)
        return means(events, self.reads, self.listings, value, spans, weight)

    def flow_mean(self, events: DataFrame, value: Column, span: float, name: str = "value") -> DataFrame:
        return self.flow_means(events, value, {name: span})

    def committed(self, per_tick: DataFrame, values: dict[str, Column], span: float, keys: tuple[str, ...] = ("listing",)) -> DataFrame:
        """(keys, t, values): plain averages over all ticks, read at the last tick. per_tick (keys, n, ...)."""
        out = ewm(per_tick, keys, "n", values, span).select(*keys, F.col("n").alias("c"), *values)
        return self.at_reads.join(out, "c").select(*keys, "t", *values)

    def on_ticks(self, stream: DataFrame, values: list[str], clip: bool = False) -> DataFrame:
        """(listing, n, values): levels at each tick, 0 before the first (clip: the first)."""
        ticks = each_listing(self.clock.select("n", F.col("rx").alias("t")), self.listings)
        out = (asof_clipped if clip else asof)(ticks, stream, ["listing"], values)
        return out.select("listing", "n", "t", *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))

    def fresh(self, stream: DataFrame, values: list[str], clip: bool = False) -> DataFrame:
        return (asof_clipped if clip else asof)(each_listing(self.reads, self.listings), stream, ["listing"], values)

    def live_fronts(self, stream: DataFrame, value: str, spans: dict[str, float], clip: bool = False) -> DataFrame:
        """(listing, t, names): committed averages of a level, each taken one step towards its freshest value."""
        tick = self.on_ticks(stream, [value], clip)
        if len(spans) > 1:
            tick = staged(tick)
        out = self.fresh(stream, [value], clip)
        for name, span in spans.items():
            out = out.join(self.committed(tick, {f"_{name}": F.col(value)}, span), ["listing", "t"])
        fronts = ((1 - alpha(s)) * F.col(f"_{n}") + alpha(s) * F.col(value) for n, s in spans.items())
        return out.select("listing", "t", *(f.alias(n) for f, n in zip(fronts, spans, strict=True)))

    def live_front(self, stream: DataFrame, value: str, span: float, name: str = "value", clip: bool = False) -> DataFrame:
        return self.live_fronts(stream, value, {name: span}, clip)

    def indexed(self, events: DataFrame) -> DataFrame:
        """Events with their number of ticks, staged for several flows."""
        return staged(tick_index(events, self.clock, "rx", "k", before=True))

    def injected(self, events: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """(listing, n, sums): mass of each tick, from events that lie on ticks."""
        per = events.groupBy("listing", "rx").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
        ticks = each_listing(self.clock, self.listings)
        return ticks.join(per, ["listing", "rx"], "left").select("listing", "n", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in sums))

    # yardsticks

    def sigma(self, span: float | None = None, name: str = "sigma") -> DataFrame:
        """(listing, t, sigma): root mean square of a listing's own moves; null until it has moved."""
        key = "sigma", span or self.yard_span
        if key not in self._yards:
            out = self.flow_mean(self.moves, F.col("d") * F.col("d"), key[1], "v")
            self._yards[key] = staged(out.withColumn("v", F.sqrt("v")))
        return self._yards[key].withColumnRenamed("v", name)

    def lam(self, span: float | None = None, name: str = "lam") -> DataFrame:
        """(listing, t, lam): a listing's own moves per second; null until the clock has run."""
        key = "lam", span or self.yard_span
        if key not in self._yards:
            w = self.flow(self.moves, {"w": F.lit(1.0)}, key[1])
            dt = self.committed(self.gaps, {"dt": F.col("dt")}, key[1], ())
            self._yards[key] = staged(w.join(dt, "t").select("listing", "t", F.when(F.col("dt") > 0, F.col("w") / F.col("dt")).alias("v")))
        return self._yards[key].withColumnRenamed("v", name)

    def of_target(self, df: DataFrame) -> DataFrame:
        """The target's rows, without listing."""
        return df.where(F.col("listing") == self.target).drop("listing")

    def per_sigma(self, df: DataFrame, value: str = "value") -> DataFrame:
        """Value over the target's sigma; null while that is 0 or undefined."""
        return df.join(self.of_target(self.sigma()), "t", "left").withColumn(value, F.try_divide(value, "sigma")).drop("sigma")

    def gap(self, stream: DataFrame, value: str, sign_: float = 1.0) -> DataFrame:
        """(listing, rx, value): other listings' level less the target's, at each change of either; null where one is unseen."""
        times = stream.select("rx").distinct().withColumnRenamed("rx", "t")
        own = asof(each_listing(times, self.listings), stream, ["listing"], [value])
        tgt = self.of_target(own).withColumnRenamed(value, "_tgt")
        return own.where(F.col("listing") != self.target).join(tgt, "t").select("listing", F.col("t").alias("rx"), (sign_ * (F.col(value) - F.col("_tgt"))).alias(value))

    def premium(self) -> DataFrame:
        """(listing, rx, seq, prem, qi): atoms of the last valid book row of each time."""
        ok = ev.last_per_time(self.book.where(m.valid_l1()))
        return ok.select("listing", "rx", "seq", m.premium().alias("prem"), m.imbalance().alias("qi"))
