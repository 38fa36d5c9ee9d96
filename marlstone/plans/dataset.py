"""Declared columns -> one wide frame on a masked step grid.

A column is asked for by template, e.g. `{LISTING}_ema_ofi_{N}b@...`; `expand` checks and names it. Columns of one
listing that are read from one stream share that stream's scan and as-of read, so a listing costs a handful of scans
however many columns are asked for, and columns that nobody asked for are never built. Only masked steps are read, and
averages over every step are closed forms over the steps at which something changes: the dense grid is never made.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import market as m
from ..operators import events as ev
from ..operators.align import asof, bucket_sum, interval_sum, masked_steps, trailing_count
from ..operators.ema import alpha, ewm, kernel
from ..operators.scan import carried, numbered
from ..sources.staging import staged

# The column families, by kind of clock.
STATE = ("microprice", "spread_width", "book_depth", "book_imbalance", "spread_wide_flag")
SINCE = ("time_since_last_trade_ms", "time_since_spread_wide_ms", "feed_latency_excess_ms")
FLOW = ("buy_trade_value", "sell_trade_value")
LAGS = ("dt_{N}b", "dt_{N}t", "dt_{N}m")
STEPS = ("return_{N}ms", "ema_microprice_centered_{N}ms", "ema_microprice_centered_sq_{N}ms", "ema_microprice_return_sq_{N}ms", "ema_buy_trade_value_{N}ms", "ema_sell_trade_value_{N}ms")
BOOK_EMA = ("ema_ofi_{N}b", "ema_ofi_sq_{N}b", "ema_abs_log_ret_{N}b", "ema_book_imbalance_{N}b", "ema_book_imbalance_sq_{N}b", "ema_book_depth_{N}b", "ema_book_depth_sq_{N}b", "ema_spread_wide_flag_{N}b")
TRADE_EMA = ("ema_buy_trade_qty_{N}t", "ema_sell_trade_qty_{N}t", "ema_buy_trade_value_{N}t", "ema_sell_trade_value_{N}t", "ema_trade_serial_cov_{N}t")
LEVEL_T = ("ema_book_imbalance_{N}t", "ema_book_imbalance_sq_{N}t", "ema_book_depth_{N}t", "ema_book_depth_sq_{N}t", "ema_spread_wide_flag_{N}t", "ema_microprice_centered_{N}t", "ema_microprice_centered_sq_{N}t")
FLOW_T = ("ema_ofi_{N}t", "ema_ofi_sq_{N}t", "ema_abs_log_ret_{N}t")
CROSS = ("ema_log_microprice_ratio_{N}ms", "ema_log_microprice_ratio_sq_{N}ms")
_CLOCKED = (*TRADE_EMA, "vol_{N}t", *LEVEL_T, *FLOW_T)
TEMPLATES: tuple[str, ...] = (
    *(f"{{LISTING}}_{x}" for x in (*STATE, *SINCE, *FLOW, *LAGS, "trade_count_{N}ms", *STEPS, *BOOK_EMA, *_CLOCKED)),
    *(f"{{LISTING}}_{x}@{{CLOCK}}" for x in _CLOCKED),
    *(f"{{LISTING1}}_{{LISTING2}}_{x}" for x in CROSS),
)


@dataclass(frozen=True)
class Column:
    """A request: a template and values for each of its placeholders."""

    template: str
    listings: Sequence[str] = ()
    spans: Sequence[int] = ()
    clocks: Sequence[str] = ()
    pairs: Sequence[tuple[str, str]] = ()


@dataclass(frozen=True)
class Unit:
    """One column: its name, family, listing (or two), span, and clock listing (None: its own)."""

    name: str
    family: str
    listing: str
    other: str | None = None
    span: int | None = None
    clock: str | None = None


def expand(columns: Iterable[Column], listings: Sequence[str]) -> list[Unit]:
    """In the order asked for; raises on unknown templates or listings, wrong bindings and repeated names."""
    out: list[Unit] = []
    for c in columns:
        if c.template not in TEMPLATES:
            raise ValueError(f"unknown template {c.template}")
        need = {p: f"{{{p}}}" in c.template for p in ("LISTING", "N", "CLOCK", "LISTING1")}
        given = {"LISTING": c.listings, "N": c.spans, "CLOCK": c.clocks, "LISTING1": c.pairs}
        for p, n in need.items():
            if n != bool(given[p]):
                raise ValueError(f"{c.template} {'needs' if n else 'does not take'} {p}")
        bad = [s for s in c.spans if not (isinstance(s, int) and s > 0)]
        unknown = {*c.listings, *(k.removeprefix("trades_") for k in c.clocks), *(x for p in c.pairs for x in p)} - set(listings)
        if bad or unknown:
            raise ValueError(f"{c.template}: {bad or sorted(unknown)}")
        family = re.sub(r"^\{LISTING1?\}_(\{LISTING2\}_)?", "", c.template).replace("@{CLOCK}", "")
        for own, span, clock in product(c.pairs or c.listings, c.spans or (None,), c.clocks or (None,)):
            a, b = own if c.pairs else (own, None)
            name = c.template.replace("{LISTING1}", a).replace("{LISTING2}", b or "").replace("{LISTING}", a).replace("{N}", str(span)).replace("{CLOCK}", clock or "")
            out.append(Unit(name, family, a, b, span, clock and clock.removeprefix("trades_")))
    names = [u.name for u in out]
    if len(set(names)) < len(names):
        raise ValueError(f"columns are asked for twice: {sorted({n for n in names if names.count(n) > 1})}")
    return out


@dataclass
class Dataset:
    """book and trade rows; steps low..high of `step` ns; mask as in masked_steps; unit_ns: a step's `ms` in names."""

    book: DataFrame
    trade: DataFrame
    listings: Sequence[str]
    target: str
    step: int
    low: int
    high: int
    mask: str = "both"
    wide: float = 1e-4
    reference: dict[str, float] = field(default_factory=dict)
    latency_rows: int = 30_000
    _held: dict = field(default_factory=dict, repr=False)

    def _once(self, key: tuple, make) -> DataFrame:
        """A stream that several columns read, staged the first time."""
        if key not in self._held:
            self._held[key] = staged(make())
        return self._held[key]

    def build(self, columns: Iterable[Column], single: bool = True) -> DataFrame:
        """(t, columns): t is the step's number; 0 where nothing has happened yet. single: 32-bit floats."""
        units = expand(columns, self.listings)
        out = self.steps()
        groups: dict[tuple, list[Unit]] = {}
        for u in units:
            groups.setdefault(self._source(u), []).append(u)
        for key, own in groups.items():
            out = out.join(getattr(self, f"_{key[0]}")(own, *key[1:]), "t", "left")
        kind = "float" if single else "double"
        return out.select("t", *(F.coalesce(F.col(f"`{u.name}`").cast(kind), F.lit(0.0).cast(kind)).alias(u.name) for u in units))

    def steps(self) -> DataFrame:
        return self._once(("steps",), self._steps)

    def _steps(self) -> DataFrame:
        book, trade = self.book.where(F.col("listing") == self.target), self.trade.where(F.col("listing") == self.target)
        micro = ev.last_per_time(book).withColumn("mid", m.microprice()).select("listing", "rx", "seq", "mid")
        return masked_steps(self.mask, book, trade, ev.mid_moves(micro), self.step, self.low, self.high)

    def _source(self, u: Unit) -> tuple:
        f = u.family
        if u.other:
            return "cross", u.listing, u.other
        if f in STATE or f in BOOK_EMA or f in ("dt_{N}b", "time_since_spread_wide_ms"):
            return "book", u.listing
        if f == "feed_latency_excess_ms":
            return "latency", u.listing
        if f == "dt_{N}m":
            return "moves", u.listing
        if f in FLOW:
            return "flow", u.listing
        if f == "trade_count_{N}ms":
            return "count", u.listing
        if f == "return_{N}ms":
            return "returns", u.listing
        if f in STEPS:
            return "dense", u.listing
        if f in ("dt_{N}t", "time_since_last_trade_ms") or (f in TRADE_EMA and u.clock is None):
            return "trades", u.listing
        return "clocked", u.listing, u.clock or u.listing

    # streams of one listing

    def _own(self, df: DataFrame, listing: str) -> DataFrame:
        return df.where(F.col("listing") == listing)

    def _states(self, listing: str) -> DataFrame:
        return self._once(("states", listing), lambda: self._make_states(listing))

    def _collapsed(self, listing: str) -> DataFrame:
        return self._once(("trades", listing), lambda: self._make_collapsed(listing))

    def _make_states(self, listing: str) -> DataFrame:
        s = numbered(ev.last_per_time(self._own(self.book, listing)), ["listing"], "rx", ["rx"])
        s = s.withColumns({"microprice": m.microprice(), "spread_width": m.spread_width(), "book_depth": m.depth(), "book_imbalance": F.coalesce(m.imbalance(), F.lit(0.0)), "spread_wide_flag": m.spread_wide(self.wide)})
        s = ev.with_previous(s, [*ev.STATE, "microprice"])
        return s.withColumns({
            "ofi": F.coalesce(m.ofi_step(), F.lit(0.0)),
            "abs_log_ret": F.when((F.col("microprice") > 0) & (F.col("p_microprice") > 0), F.abs(F.log(F.col("microprice") / F.col("p_microprice")))).otherwise(0.0),
        })

    def _make_collapsed(self, listing: str) -> DataFrame:
        t = numbered(ev.collapse_trades(self._own(self.trade, listing)), ["listing"], "rx", ["rx", "seq"])
        buy, v = m.lifts_ask(), F.col("qty") * F.col("prc")
        t = t.withColumns({"buy_trade_qty": F.when(buy, F.col("qty")).otherwise(0.0), "sell_trade_qty": F.when(buy, 0.0).otherwise(F.col("qty")), "buy_trade_value": F.when(buy, v).otherwise(0.0), "sell_trade_value": F.when(buy, 0.0).otherwise(v)})
        back = ev.neighbours(t, ["listing"], "rx", ["rx", "seq"], {"_p1": ("prc", 1), "_p2": ("prc", 2)})
        return back.withColumn("trade_serial_cov", F.coalesce((F.col("prc") - F.col("_p1")) * (F.col("_p1") - F.col("_p2")), F.lit(0.0)))

    def _read(self, stream: DataFrame, values: list[str], seq: str | None = None) -> DataFrame:
        """Values as of each step's time."""
        return asof(self.steps().withColumn("_at", F.col("t") * self.step), stream, [], values, at="_at", seq=seq)

    @staticmethod
    def _atom(family: str) -> tuple[str, bool]:
        """What an average is of, and whether of its square."""
        base = re.sub(r"_\{N\}\w+$", "", family.removeprefix("ema_"))
        return base.removesuffix("_sq"), base.endswith("_sq")

    def _emas(self, df: DataFrame, own: list[Unit], n: str = "n") -> DataFrame:
        """Averages over the rows of df, numbered in column n."""
        by: dict[int, dict] = {}
        for u in own:
            atom, square = self._atom(u.family)
            by.setdefault(u.span, {})[u.name] = F.col(atom) * F.col(atom) if square else F.col(atom)
        for span, values in by.items():
            df = ewm(df, [], n, {k.replace("@", "__"): v for k, v in values.items()}, span)
        return df

    def _lags(self, df: DataFrame, own: list[Unit], per: float) -> DataFrame:
        """Time since the N-th row before, by an equi-join on row numbers; 0 for the first N."""
        for u in own:
            then = df.select((F.col("n") + u.span).alias("n"), F.col("rx").alias("_then"))
            df = df.join(then, "n", "left").withColumn(u.name, F.coalesce((F.col("rx") - F.col("_then")) / per, F.lit(0.0))).drop("_then")
        return df

    def _named(self, df: DataFrame, own: list[Unit]) -> DataFrame:
        return df.select("t", *(F.col(u.name.replace("@", "__")).alias(u.name) for u in own))

    # families

    def _book(self, own: list[Unit], listing: str) -> DataFrame:
        s = self._states(listing)
        s = self._lags(s, [u for u in own if u.family == "dt_{N}b"], self.step)
        s = self._emas(s, [u for u in own if u.family in BOOK_EMA])
        s = s.withColumns({u.name: F.col(u.family) for u in own if u.family in STATE})
        plain = [u.name for u in own if u.family != "time_since_spread_wide_ms"]
        out = self._read(s, plain)
        for u in own:
            if u.family == "time_since_spread_wide_ms":
                last = self._read(s.where("spread_wide_flag > 0").withColumn("_last", F.col("rx")), ["_last"])
                out = out.join(last.select("t", F.coalesce((F.col("_at") - F.col("_last")) / self.step, F.lit(0.0)).alias(u.name)), "t")
        return self._named(out, own)

    def _latency(self, own: list[Unit], listing: str) -> DataFrame:
        raw = ev.latency_excess(self._own(self.book, listing), self.latency_rows).withColumn("_v", F.col("excess") / self.step)
        return self._read(raw, ["_v"], seq="seq").select("t", *(F.col("_v").alias(u.name) for u in own))

    def _moves(self, own: list[Unit], listing: str) -> DataFrame:
        mv = self._once(("moves", listing), lambda: numbered(ev.mid_moves(ev.mids(self._own(self.book, listing))), ["listing"], "rx", ["rx"]))
        return self._named(self._read(self._lags(mv, own, self.step), [u.name for u in own]), own)

    def _trades(self, own: list[Unit], listing: str) -> DataFrame:
        t = self._collapsed(listing)
        t = self._lags(t, [u for u in own if u.family == "dt_{N}t"], self.step)
        t = self._emas(t, [u for u in own if u.family in TRADE_EMA]).withColumn("_last", F.col("rx"))
        out = self._read(t, [*(u.name for u in own if u.family != "time_since_last_trade_ms"), "_last"], seq="seq")
        for u in own:
            if u.family == "time_since_last_trade_ms":
                out = out.withColumn(u.name, F.coalesce((F.col("_at") - F.col("_last")) / self.step, F.lit(0.0)))
        return self._named(out, own)

    def _flow(self, own: list[Unit], listing: str) -> DataFrame:
        t = self._collapsed(listing)
        return bucket_sum(t, [], self.step, {u.name: F.col(u.family) for u in own})

    def _count(self, own: list[Unit], listing: str) -> DataFrame:
        t, out = self._collapsed(listing).select("rx"), self.steps().withColumn("_at", F.col("t") * self.step)
        for u in own:
            out = trailing_count(out, t, [], u.span * self.step, u.name, at="_at")
        return out.select("t", *(u.name for u in own))

    def _returns(self, own: list[Unit], listing: str) -> DataFrame:
        s = self._states(listing).select("rx", "microprice")
        out = self._read(s, ["microprice"]).withColumnRenamed("microprice", "_now")
        for u in own:
            out = asof(out.withColumn("_then_at", F.col("_at") - u.span * self.step), s, [], ["microprice"], at="_then_at")
            ok = (F.col("t") >= self.low + u.span) & (F.col("_now") > 0) & (F.col("microprice") > 0)
            out = out.withColumn(u.name, F.when(ok, F.log("_now") - F.log("microprice")).otherwise(0.0)).drop("microprice", "_then_at")
        return out.select("t", *(u.name for u in own))

    # averages over every step, of levels that stay put between a few changes: no step without a change is ever made.
    # With jumps D_k at steps t_k a level is x(t) = sum of D_k so far, and its average from zero is x(t) - sum of
    # D_k d^(t - t_k + 1); the sum is a flow that decays by the step.

    def _changes(self, listing: str) -> DataFrame:
        """(rx, k, microprice, mid, and p_ of both): steps at which a state is first seen, from `low` on, with the one before."""
        return self._once(("changes", listing), lambda: self._make_changes(listing))

    def _make_changes(self, listing: str) -> DataFrame:
        k = F.greatest(F.floor((F.col("rx") + self.step - 1) / self.step), F.lit(self.low)).cast("long")
        s = self._states(listing).withColumns({"mid": m.mid(), "k": k}).where(F.col("k") <= self.high)
        s = s.groupBy("k").agg(F.max_by(F.struct("microprice", "mid"), "rx").alias("_s")).select((F.col("k") * self.step).alias("rx"), "k", "_s.*")
        return ev.neighbours(s, [], "rx", ["rx"], {"p_k": ("k", 1), "p_microprice": ("microprice", 1), "p_mid": ("mid", 1)})

    def _step_emas(self, events: DataFrame, levels: DataFrame, own: list[Unit], now: dict[str, C], was: dict[str, C], flows: dict[str, C]) -> DataFrame:
        """(t, columns): averages at the asked steps. events (k, ...) are changes and flows by step; now and was: levels
        before and after a change, by atom, of columns that `levels` has as of each step."""
        reads = self.steps().select("t", (F.col("t") - self.low + 1).alias("c"))
        square = lambda x, u: x * x if self._atom(u.family)[1] else x
        out = levels
        for span in sorted({u.span for u in own}):
            some = {u.name.replace("@", "__"): (u, self._atom(u.family)[0]) for u in own if u.span == span}
            mass = {n: square(flows[x], u) if x in flows else square(now[x], u) - square(was[x], u) for n, (u, x) in some.items()}
            ev_ = events.select(F.lit("").alias("listing"), F.col("k").alias("rx"), (F.col("k") - self.low + 1).alias("k"), *(v.alias(n) for n, v in mass.items()))
            got = kernel(ev_, reads, reads, [""], {n: F.col(n) for n in some}, span, indexed=True).drop("listing")
            a = alpha(span)
            out = out.join(got.withColumnsRenamed({n: f"_e_{n}" for n in some}), "t")
            out = out.withColumns({n: F.col(f"_e_{n}") if x in flows else square(now[x], u) - (1 - a) / a * F.col(f"_e_{n}") for n, (u, x) in some.items()})
        return self._named(out, own)

    def _dense(self, own: list[Unit], listing: str) -> DataFrame:
        s, ref = self._changes(listing), self.reference.get(listing, 0.0)
        centered = lambda c: F.coalesce(F.col(c) - ref, F.lit(0.0))
        moved = (F.col("microprice") > 0) & (F.col("p_microprice") > 0)
        flows = {"microprice_return": F.when(moved, F.log(F.col("microprice") / F.col("p_microprice"))).otherwise(0.0)}
        events = s
        if any("trade_value" in u.family for u in own):
            sums = bucket_sum(self._collapsed(listing), [], self.step, {x: F.col(x) for x in FLOW}).withColumnRenamed("t", "k")
            events = s.unionByName(sums.where(F.col("k").between(self.low, self.high)), allowMissingColumns=True)
            flows |= {x: F.coalesce(x, F.lit(0.0)) for x in FLOW}
        levels = self._read(s, ["microprice"])
        return self._step_emas(events, levels, own, {"microprice_centered": centered("microprice")}, {"microprice_centered": centered("p_microprice")}, flows)

    def _cross(self, own: list[Unit], one: str, two: str) -> DataFrame:
        none = F.lit(None).cast("double")
        a = self._changes(one).select("rx", "k", F.col("microprice").alias("_a"), none.alias("_b"))
        b = self._changes(two).select("rx", "k", none.alias("_a"), F.col("microprice").alias("_b"))
        both = a.unionByName(b).groupBy("rx", "k").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        both = carried(both, [], "rx", ["rx"], ["_a", "_b"])
        ratio = F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.log(F.col("_a") / F.col("_b"))).otherwise(0.0)
        s = self._once(("ratio", one, two), lambda: ev.neighbours(both.select("rx", "k", ratio.alias("ratio")), [], "rx", ["rx"], {"p_ratio": ("ratio", 1)}))
        level = lambda c: F.coalesce(c, F.lit(0.0))
        return self._step_emas(s, self._read(s, ["ratio"]), own, {"log_microprice_ratio": level("ratio")}, {"log_microprice_ratio": level("p_ratio")}, {})

    def _clocked(self, own: list[Unit], listing: str, clock: str) -> DataFrame:
        """Averages over the ticks of a listing's trades: levels as of each tick, flows summed since the tick before."""
        ticks = numbered(self._own(self.trade, clock).select("rx").distinct(), [], "rx", ["rx"])
        kinds = {"level": [u for u in own if u.family in LEVEL_T], "book": [u for u in own if u.family in FLOW_T], "trade": [u for u in own if u.family in TRADE_EMA]}
        df = ticks
        if kinds["level"]:
            s = self._states(listing).withColumn("microprice_centered", F.col("microprice") - self.reference.get(listing, 0.0))
            atoms = sorted({self._atom(u.family)[0] for u in kinds["level"]})
            df = asof(df.withColumn("_q", F.col("rx")), s, [], atoms, at="_q").withColumns({x: F.coalesce(x, F.lit(0.0)) for x in atoms}).drop("_q")
        for kind, stream in (("book", self._states), ("trade", self._collapsed)):
            if kinds[kind]:
                e, sums = stream(listing), {}
                for u in kinds[kind]:
                    atom, square = self._atom(u.family)
                    sums[f"_{atom}{'_sq' * square}"] = F.col(atom) * F.col(atom) if square else F.col(atom)
                df = df.join(interval_sum(e, ticks, [], sums), "n", "left").withColumns({x: F.coalesce(x, F.lit(0.0)) for x in sums})
        spans: dict[int, dict] = {}
        for u in own:
            if u.family == "vol_{N}t":
                continue
            atom, square = self._atom(u.family)
            level = u.family in LEVEL_T
            col = (F.col(atom) * F.col(atom) if square else F.col(atom)) if level else F.col(f"_{atom}{'_sq' * square}")
            spans.setdefault(u.span, {})[u.name.replace("@", "__")] = col
        for span, values in spans.items():
            df = ewm(df, [], "n", values, span)
        vols = [u for u in own if u.family == "vol_{N}t"]
        plain = [u.name.replace("@", "__") for u in own if u not in vols]
        out = self._read(df, plain) if plain else self.steps()
        if vols:
            inside = ticks.where(F.col("rx").between(self.low * self.step, self.high * self.step))
            inside = numbered(inside.select("rx"), [], "rx", ["rx"])
            d = self._changes(listing).where("mid > 0 and p_mid > 0").select("rx", F.pow(F.log(F.col("mid") / F.col("p_mid")), 2).alias("_r2")).where("_r2 > 0")
            v = inside.join(interval_sum(d, inside, [], {"_r2": F.col("_r2")}), "n", "left")
            for u in vols:
                v = ewm(v, [], "n", {u.name.replace("@", "__"): F.col("_r2")}, u.span)
            names = [u.name.replace("@", "__") for u in vols]
            out = out.select("t", *plain).join(self._read(v.withColumns({x: F.sqrt(x) for x in names}), names).select("t", *names), "t", "left")
        return self._named(out, own)
