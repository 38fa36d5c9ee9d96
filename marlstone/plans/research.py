"""Targets, controls and reports over a market's reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import stats
from ..operators.align import asof, nth_after, trailing_count
from ..sources.staging import staged
from . import features
from .market import Market


def _mid_at(mk: Market, df: DataFrame, at, name: str) -> DataFrame:
    own = mk.of_target(mk.mids).select("rx", F.col("mid").alias(name))
    return asof(df.withColumn("_at", at), own, [], [name], at="_at").drop("_at")


def log_move(mk: Market, lo: int, hi: int, name: str) -> DataFrame:
    """(t, name): log move of the target's mid from t + lo to t + hi."""
    both = _mid_at(mk, _mid_at(mk, mk.reads, F.col("t") + lo, "_a"), F.col("t") + hi, "_b")
    return both.select("t", (F.log("_b") - F.log("_a")).alias(name))


def price_target(mk: Market, horizon: int) -> DataFrame:
    """Forward move in units of sigma."""
    y = mk.of_target(mk.sigma())
    return log_move(mk, 0, horizon, "y").join(y, "t").select("t", F.try_divide("y", "sigma").alias("price_target"))


def rate_target(mk: Market, horizon: int) -> DataFrame:
    """Moves in (t, t + horizon] per lambda."""
    mv = mk.of_target(ev.mid_moves(mk.mids)).select("rx")
    n = trailing_count(mk.reads.withColumn("_end", F.col("t") + horizon), mv, [], horizon, "n", at="_end")
    return n.join(mk.of_target(mk.lam()), "t").select("t", (F.col("n") / F.greatest("lam", F.lit(1e-9))).alias("rate_target"))


def n_move_target(mk: Market, n: int) -> DataFrame:
    """Log move to the n-th move after t, in units of sigma."""
    back = ev.with_previous(mk.mids, ["mid"])
    moved = mk.of_target(back.where("p_mid is not null and mid <> p_mid")).select("rx", F.col("mid").alias("_then"))
    now = _mid_at(mk, mk.reads, F.col("t"), "_now")
    out = nth_after(now, moved, [], n, ["_then"])
    return out.join(mk.of_target(mk.sigma()), "t").select("t", F.try_divide(F.log("_then") - F.log("_now"), F.col("sigma")).alias("n_move_target"))


def trailing_outcome(mk: Market, horizon: int) -> DataFrame:
    """The move already under way, over [t - horizon, t], in units of sigma."""
    y = mk.of_target(mk.sigma())
    return log_move(mk, -horizon, 0, "y").join(y, "t").select("t", F.try_divide("y", "sigma").alias("trailing"))


def regimes(mk: Market) -> DataFrame:
    """(t, vol_level, rate_level): log sigma and log lambda of the target."""
    s, r = mk.of_target(mk.sigma()), mk.of_target(mk.lam())
    return s.join(r, "t").select("t", F.when(F.col("sigma") > 0, F.log("sigma")).alias("vol_level"), F.when(F.col("lam") > 0, F.log("lam")).alias("rate_level"))


def controls(mk: Market) -> DataFrame:
    """(t, rate_momentum, vol_momentum) of the target, a tenth of the yardstick's span against it."""
    spans = (max(1, round(mk.yard_span / 10)), mk.yard_span)
    a, b = (mk.of_target(features.get(n).build(mk, *spans)).select("t", F.col("value").alias(n)) for n in ("rate_momentum", "vol_momentum"))
    return a.join(b, "t")


def terciles(df: DataFrame, level: str, name: str = "regime") -> DataFrame:
    cuts = stats.quantiles(df.where(stats.finite(level)), level, [0.33, 0.67])
    return df.join(F.broadcast(cuts)).withColumn(name, F.size(F.filter("_cuts", lambda x: x <= F.col(level)))).drop("_cuts")  # one row


def family(mk: Market, name: str, spans: Sequence[tuple]) -> DataFrame:
    """(span, listing, t, value) for every combination of spans."""
    out = None
    for s in spans:
        one = features.get(name).build(mk, *s).select(F.lit("/".join(map(str, s))).alias("span"), "listing", "t", "value")
        out = one if out is None else out.unionByName(one)
    return out


def ic_scan(mk: Market, name: str, spans: Sequence[tuple], target: DataFrame, y: str, digits: int | None = None) -> DataFrame:
    """(span, listing, ic, n) of a feature against a target, for every combination."""
    return stats.rank_ic(family(mk, name, spans).join(target, "t"), "value", y, ["span", "listing"], digits=digits)


def gate_report(mk: Market, name: str, spans: tuple, target: DataFrame, y: str, embargo: int, size: bool = False) -> dict:
    """Scores of a feature, and whether it passes: joint marginal of .01, and bars 3, .05, .1, .1 on dependence on the regime.

    size: a rate head scores the feature's size.
    """
    wide = features.get(name).build(mk, *spans)
    if size:
        wide = wide.withColumn("value", F.abs("value"))
    legs = [r[0] for r in wide.select("listing").distinct().orderBy("listing").collect()]  # one per listing
    table = wide.groupBy("t").pivot("listing", legs).agg(F.first("value")).join(controls(mk), "t").join(target, "t").join(regimes(mk), "t")
    marg = stats.fold_marginals(table, legs, ["rate_momentum", "vol_momentum"], y, ["t"], embargo=embargo).agg(F.avg("marginal")).first()[0]
    per = [stats.gate_a(table, leg, "vol_level", "rate_level").first().asDict() for leg in legs]
    worst = {k: max((p[k] for p in per if p[k] is not None), default=None) for k in ("scale", "track", "mag", "disp")}
    bars = {"scale": 3.0, "track": 0.05, "mag": 0.1, "disp": 0.1}
    passes = marg is not None and marg >= 0.01 and all(worst[k] is not None and worst[k] <= b for k, b in bars.items())
    return {"joint": marg, **worst, "passes": passes}


def second_span_adds(table: DataFrame, chosen: str, others: Sequence[str], y: str, embargo: int, bar: float = 0.01, size: bool = False, mirror: str | None = None) -> DataFrame:
    """(second, conditional, solo, joint, adds): whether another span adds to the chosen one, out of sample.

    The second span is the one whose correlation with the target, given the chosen one, is strongest in sample, whatever
    its sign; the walk then decides. size: sizes of features and target (then nothing is mirrored).
    """
    if not others:
        raise ValueError("there is no other span")
    if size:
        table, mirror = table.withColumns({c: F.abs(c) for c in (chosen, *others, y)}), None
    table = staged(table)
    flat = table if mirror is None else stats.mirrored(table, [chosen, *others], y, mirror == "odd")
    member = flat.select(F.explode(F.array(*(F.struct(F.lit(o).alias("second"), F.col(o).alias("_f")) for o in others))).alias("_"), chosen, y).select("_.*", F.col(chosen).alias("_c"), F.col(y).alias("_y"))
    screen = stats.partial_ic(member, "_f", "_y", "_c", ["second"]).where("netted is not null")
    best = screen.agg(F.max_by("second", F.struct(F.abs("netted"), "second")).alias("second"), F.max_by("netted", F.struct(F.abs("netted"), "second")).alias("conditional")).first()
    walk = lambda cols, name: stats.wf_ic(table, cols, y, ["t"], embargo=embargo, mirror=mirror).select(F.col("ic").alias(name))
    solo = walk([chosen], "solo")
    if best.second is None:
        return solo.select(F.lit(None).cast("string").alias("second"), F.lit(None).cast("double").alias("conditional"), "solo", F.lit(None).cast("double").alias("joint"), F.lit(False).alias("adds"))
    both = solo.join(F.broadcast(walk([chosen, best.second], "joint")))  # one row
    return both.select(F.lit(best.second).alias("second"), F.lit(best.conditional).alias("conditional"), "solo", "joint", (F.col("joint") - F.col("solo") >= bar).alias("adds"))


def joint_adds(table: DataFrame, legs: Sequence[str], y: str, embargo: int, bar: float = 0.01, mirror: str | None = None) -> DataFrame:
    """(joint, best, single, adds): whether all legs together beat the best one, out of sample. Each leg is scored on the
    rows it has; of equal ones the last by name counts as best."""
    ones = None
    for leg in sorted(legs):  # a walk's folds depend on its leg's rows
        one = stats.wf_ic(table, [leg], y, ["t"], embargo=embargo, mirror=mirror).select(F.lit(leg).alias("leg"), "ic")
        ones = one if ones is None else ones.unionByName(one)
    best = ones.groupBy().agg(F.max(F.struct("ic", "leg")).alias("_b")).select(F.col("_b.leg").alias("best"), F.col("_b.ic").alias("single"))
    joint = stats.wf_ic(table, list(legs), y, ["t"], embargo=embargo, mirror=mirror).select(F.col("ic").alias("joint"))
    return joint.join(F.broadcast(best)).withColumn("adds", F.col("joint") - F.col("single") >= bar)  # one row


def markdown(df: DataFrame) -> str:
    """A report table; df has one row per feature and leg."""
    rows = df.collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    show = lambda v: "nan" if v is None else f"{v:+.4f}" if isinstance(v, float) else str(v)
    return "\n".join([head, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])
