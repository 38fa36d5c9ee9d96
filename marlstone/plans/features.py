"""The registered features: each a function (market, *spans) -> (listing, t, value).

`kind` says how a mirrored market changes the value: odd changes its sign, even leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators.ema import alpha, held, mean
from ..operators.stats import quantiles, rank_ic
from ..sources.staging import staged
from .market import Market


@dataclass(frozen=True)
class Feature:
    name: str
    build: Callable[..., DataFrame]
    spans: int
    kind: str
    group: str = "feature"


_registry: dict[str, Feature] = {}


def register(spans: int, kind: str, group: str = "feature"):
    def put(f):
        name = f.__name__
        if name in _registry:
            raise ValueError(f"feature {name} is registered twice")
        _registry[name] = Feature(name, f, spans, kind, group)
        return f

    return put


def get(name: str) -> Feature:
    if name not in _registry:
        raise KeyError(f"no feature {name}; there are {sorted(_registry)}")
    return _registry[name]


def all_features(group: str | None = None) -> list[Feature]:
    return [f for _, f in sorted(_registry.items()) if group in (None, f.group)]


def _spread(both: DataFrame) -> DataFrame:
    return both.select("listing", "t", (F.col("fast") - F.col("slow")).alias("value"))


def _ratio(a: DataFrame, b: DataFrame, log: bool = False) -> DataFrame:
    b = b.withColumnRenamed("value", "_b")
    q = F.when((F.col("value") > 0) & (F.col("_b") > 0), F.log(F.col("value") / F.col("_b"))) if log else F.when(F.col("_b") > 0, F.col("value") / F.col("_b"))
    return a.join(b, ["listing", "t"]).select("listing", "t", q.alias("value"))


# features of the second layer


@register(2, "odd")
def price_dislocation(mk: Market, fast: float, slow: float) -> DataFrame:
    """Fast less slow live-front average of log(mid / target's mid), per sigma."""
    gap = staged(mk.gap(mk.mids.select("listing", "rx", F.log("mid").alias("g")), "g"))
    out = _spread(mk.live_fronts(gap, "g", {"fast": fast, "slow": slow}))
    return mk.per_sigma(out.where(F.col("listing") != mk.target))


@register(1, "odd")
def price_momentum(mk: Market, span: float) -> DataFrame:
    """Mean log move, per the target's sigma."""
    return mk.per_sigma(mk.flow_mean(mk.moves, F.col("d"), span))


@register(2, "even")
def rate_momentum(mk: Market, fast: float, slow: float) -> DataFrame:
    return _ratio(mk.lam(fast, "value"), mk.lam(slow, "value"), log=True)


@register(2, "even")
def vol_momentum(mk: Market, fast: float, slow: float) -> DataFrame:
    both = mk.flow_means(mk.moves, F.col("d") * F.col("d"), {"fast": fast, "slow": slow})
    q = F.when((F.col("fast") > 0) & (F.col("slow") > 0), F.log(F.sqrt("fast") / F.sqrt("slow")))
    return both.select("listing", "t", q.alias("value"))


@register(1, "odd")
def ofi_ema(mk: Market, span: float) -> DataFrame:
    return mk.flow_mean(ev.ofi_path(mk.book), F.col("ofi"), span)


@register(2, "odd")
def ofi_fast_slow(mk: Market, fast: float, slow: float) -> DataFrame:
    return _spread(mk.flow_means(ev.ofi_path(mk.book), F.col("ofi"), {"fast": fast, "slow": slow}))


@register(2, "odd")
def stoikov_premium_fast_slow(mk: Market, fast: float, slow: float) -> DataFrame:
    """Fast less slow live-front average of the premium; null until a tick has seen one."""
    p = staged(mk.premium())
    first = p.groupBy("listing").agg(F.min("rx").alias("_p"))
    ticks = mk.at_reads.join(mk.clock.withColumnsRenamed({"n": "c", "rx": "_last"}), "c")
    out = _spread(mk.live_fronts(p, "prem", {"fast": fast, "slow": slow})).join(first, "listing").join(ticks.select("t", "_last"), "t", "left")
    return out.select("listing", "t", F.when(F.col("_last") >= F.col("_p"), F.col("value")).alias("value"))


@register(1, "odd")
def trade_flow_imbalance(mk: Market, span: float) -> DataFrame:
    """Signed over total volume."""
    return mk.flow_means(ev.signed_volume(mk.trade, mk.inverted), F.col("signed"), {"value": span}, F.col("total"))


@register(1, "even")
def flow_persistence(mk: Market, span: float) -> DataFrame:
    return mk.flow_mean(ev.sign_products(mk.trade, mk.inverted), F.col("per"), span)


# modules of the out-of-sample harness; yardsticks are floored there


def _module(spans: int, kind: str):
    return register(spans, kind, "module")


def _committed_ratio(mk: Market, events: DataFrame, num, den, span: float) -> DataFrame:
    per = mk.injected(events, {"e": num, "w": den})
    out = mk.committed(per, {"e": F.col("e"), "w": F.col("w")}, span)
    return held(out.select("listing", "t", mean("e", "w").alias("value")), ["value"])


@_module(1, "odd")
def m_flow_imbalance(mk: Market, span: float) -> DataFrame:
    return _committed_ratio(mk, ev.signed_volume(mk.trade, mk.inverted), F.col("signed"), F.col("total"), span)


@_module(1, "odd")
def m_flow_persistence(mk: Market, span: float) -> DataFrame:
    """Mean sign of trade times."""
    return _committed_ratio(mk, ev.net_signs(mk.trade, mk.inverted), F.col("eps"), F.lit(1.0), span)


@_module(1, "odd")
def m_gap_dynamics(mk: Market, span: float) -> DataFrame:
    """Standardised log gap of the target to each other listing."""
    log_mid = mk.mids.select("listing", "rx", F.log("mid").alias("g"))
    tick = mk.on_ticks(log_mid, ["g"], clip=True)
    com = tick.where(F.col("listing") != mk.target).join(mk.of_target(tick).select("n", F.col("g").alias("_g")), "n").select("listing", "n", (F.col("_g") - F.col("g")).alias("g"))
    com = mk.committed(com, {"e": F.col("g"), "e2": F.col("g") * F.col("g")}, span)
    now = mk.fresh(log_mid, ["g"], clip=True)
    now = now.where(F.col("listing") != mk.target).join(mk.of_target(now).select("t", F.col("g").alias("_g")), "t").select("listing", "t", (F.col("_g") - F.col("g")).alias("now"))
    dev = F.greatest(F.sqrt(F.greatest(F.col("e2") - F.col("e") * F.col("e"), F.lit(0.0))), F.lit(1e-9))
    return com.join(now, ["listing", "t"]).select("listing", "t", ((F.col("now") - F.col("e")) / dev).alias("value"))


@_module(1, "odd")
def m_microprice(mk: Market, span: float) -> DataFrame:
    """Legs prem_x of each listing and gap_x of others against the target."""
    return _level_legs(mk, "prem", span, True)


def _level_legs(mk: Market, atom: str, span: float, own: bool) -> DataFrame:
    """Live fronts are linear: the front of a difference of levels is the difference of fronts."""
    front = staged(mk.live_front(mk.premium(), atom, span, clip=True))
    tgt = mk.of_target(front).withColumnRenamed("value", "_v")
    gaps = front.where(F.col("listing") != mk.target).join(tgt, "t").select(F.concat(F.lit("gap_"), "listing").alias("listing"), "t", (F.col("value") - F.col("_v")).alias("value"))
    return gaps if not own else front.select(F.concat(F.lit("prem_"), "listing").alias("listing"), "t", "value").unionByName(gaps)


@_module(2, "even")
def m_mid_rate_surge(mk: Market, fast: float, slow: float) -> DataFrame:
    return _ratio(mk.lam(fast, "value"), mk.lam(slow, "value"))


def _ofi_endpoint(mk: Market) -> DataFrame:
    return ev.ofi_endpoint(mk.book).where("not first")


@_module(2, "odd")
def m_ofi(mk: Market, fast: float, slow: float) -> DataFrame:
    return _spread(mk.flow_means(_ofi_endpoint(mk), F.col("ofi"), {"fast": fast, "slow": slow}))


@_module(1, "odd")
def m_ofi_normalised(mk: Market, span: float, variant: str = "sigma") -> DataFrame:
    """Mean endpoint flow, raw (none), per sigma or per lambda of the target."""
    raw = mk.flow_mean(_ofi_endpoint(mk), F.col("ofi"), span)
    if variant == "none":
        return raw
    yard = mk.of_target(mk.sigma(name="y") if variant == "sigma" else mk.lam(name="y"))
    return raw.join(yard, "t").select("listing", "t", (F.col("value") / F.greatest("y", F.lit(1e-12))).alias("value"))


VARIANTS = ("none", "sigma", "lambda")


def best_variants(mk: Market, spans: Sequence[float], target: DataFrame, y: str) -> DataFrame:
    """(listing, variant, span, ic): of each leg the reading of m_ofi_normalised that goes most with the target in sample,
    whatever its sign; of equal ones the first variant, then the least span."""
    every = None
    for span in spans:
        for k, v in enumerate(VARIANTS):
            one = m_ofi_normalised(mk, span, v).select("listing", "t", "value", F.lit(v).alias("variant"), F.lit(k).alias("_k"), F.lit(span).alias("span"))
            every = one if every is None else every.unionByName(one)
    ics = rank_ic(every.join(target, "t"), "value", y, ["listing", "variant", "_k", "span"]).where("ic is not null")
    best = ics.groupBy("listing").agg(F.max(F.struct(F.abs("ic").alias("_s"), (-F.col("_k")).alias("_o"), (-F.col("span")).alias("_l"), "variant", "span", "ic")).alias("_b"))
    return best.select("listing", "_b.variant", "_b.span", "_b.ic")


def ofi_best(mk: Market, spans: Sequence[float], target: DataFrame, y: str) -> DataFrame:
    """(listing, t, value): m_ofi_normalised, each leg in its best reading."""
    legs = best_variants(mk, spans, target, y).collect()  # one row per leg
    out = None
    for leg in legs:
        one = m_ofi_normalised(mk, leg.span, leg.variant).where(F.col("listing") == leg.listing)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else m_ofi_normalised(mk, spans[0], "none").limit(0)


#: Span and bar of the rule that decides whether momentum is divided by sigma.
SCALE_SPAN, SCALE_BAR = 50, 3.0


def too_spread(mk: Market, span: float = SCALE_SPAN) -> bool:
    """Whether raw momentum of the target changes its scale with the regime: more than SCALE_BAR times over deciles of sigma."""
    v = mk.of_target(mk.flow(mk.moves, {"value": F.col("d")}, span)).join(mk.of_target(mk.sigma()), "t").where("sigma > 0").withColumn("level", F.log("sigma"))
    got = scale_spread(v, "level", "value").first()[0]  # one number
    return got is not None and got > SCALE_BAR


@_module(1, "odd")
def m_price_momentum(mk: Market, span: float, normalise: bool | None = False) -> DataFrame:
    """Decayed sum of log moves, raw or per sigma; None: per sigma if too_spread()."""
    out = mk.flow(mk.moves, {"value": F.col("d")}, span)
    return mk.per_sigma(out) if (too_spread(mk) if normalise is None else normalise) else out


def scale_spread(values: DataFrame, level: str, value: str) -> DataFrame:
    """(scale): greatest over least deviation of a value within deciles of a level; above 3 it should be normalised."""
    cuts = quantiles(values, level, [k / 10 for k in range(1, 10)])
    d = F.size(F.filter("_cuts", lambda x: x <= F.col(level)))
    per = values.crossJoin(F.broadcast(cuts)).groupBy(d.alias("d")).agg(F.stddev_pop(value).alias("s")).where("s > 0")  # one row, broadcast
    return per.agg((F.max("s") / F.min("s")).alias("scale"))


@_module(1, "odd")
def m_range_breakout(mk: Market, span: float) -> DataFrame:
    """Distance of the mid from its live band, in band widths; the first mid is the reference level."""
    first = mk.mids.groupBy("listing").agg(F.min_by("mid", "rx").alias("_r"))
    own = mk.mids.join(first, "listing").select("listing", "rx", (F.col("mid") - F.col("_r")).alias("x")).withColumn("x2", F.col("x") * F.col("x"))
    a = alpha(span)
    com = mk.committed(mk.on_ticks(own, ["x", "x2"], clip=True), {"e1": F.col("x"), "e2": F.col("x2")}, span)
    out = com.join(mk.fresh(own, ["x"], clip=True), ["listing", "t"])
    e, e2 = (1 - a) * F.col("e1") + a * F.col("x"), (1 - a) * F.col("e2") + a * F.col("x") * F.col("x")
    width = F.sqrt(F.greatest(e2 - e * e, F.lit(0.0)))
    return out.select("listing", "t", F.when(width > 0, (F.col("x") - e) / width).alias("value"))


def _trade_rate(mk: Market, span: float, after: bool) -> DataFrame:
    """Trade times per second; after: each decays by its own tick."""
    per = mk.injected(mk.trade.select("listing", "rx").distinct(), {"w": F.lit(1.0)})
    w = mk.committed(per, {"w": F.col("w")}, span)
    dt = mk.committed(mk.gaps, {"dt": F.col("dt")}, span, ())
    lost = 1 - alpha(span) if after else 1.0
    return w.join(dt, "t").select("listing", "t", F.when(F.col("dt") > 1e-12, lost * F.col("w") / F.col("dt")).alias("value"))


@_module(1, "even")
def m_trade_rate_normalised(mk: Market, span: float) -> DataFrame:
    lam = mk.of_target(mk.lam())
    return _trade_rate(mk, span, False).join(lam, "t").select("listing", "t", F.when(F.col("lam") > 0, F.col("value") / F.col("lam")).alias("value"))


@_module(2, "even")
def m_trade_rate_surge(mk: Market, fast: float, slow: float) -> DataFrame:
    return _ratio(_trade_rate(mk, fast, True), _trade_rate(mk, slow, True))


@_module(2, "even")
def m_vol_over_rate(mk: Market, vol: float, rate: float) -> DataFrame:
    s = mk.sigma(vol, "value")
    return s.join(mk.lam(rate), ["listing", "t"]).select("listing", "t", (F.col("value") / F.greatest("lam", F.lit(1e-12))).alias("value"))


def _mean_qty(mk: Market, span: float) -> DataFrame:
    return _committed_ratio(mk, ev.signed_volume(mk.trade, mk.inverted), F.col("total"), F.lit(1.0), span)


@_module(1, "even")
def m_volume_normalised(mk: Market, span: float) -> DataFrame:
    y = mk.of_target(mk.sigma())
    return _mean_qty(mk, span).join(y, "t").select("listing", "t", (F.col("value") / F.greatest("sigma", F.lit(1e-12))).alias("value"))


@_module(2, "even")
def m_volume_surge(mk: Market, fast: float, slow: float) -> DataFrame:
    return _ratio(_mean_qty(mk, fast), _mean_qty(mk, slow))


@_module(1, "odd")
def m_xv_book_pressure(mk: Market, span: float) -> DataFrame:
    """Legs qi_x and prem_x: others' book atoms against the target's."""
    legs = [_level_legs(mk, a, span, False).withColumn("listing", F.regexp_replace("listing", "^gap_", f"{a}_")) for a in ("qi", "prem")]
    return legs[0].unionByName(legs[1])
