"""Rank statistics and walk-forward fits.

Ranks are average ranks of tied values, exact, without a global sort in one task: values are counted (with a map-side
combine), cut into quantile buckets, and numbered by a running sum in two levels. Fits need sums of products only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged

LEAST = 100
#: Cuts of the range of a value, in two steps of EDGES: some EDGES * EDGES buckets of about as many rows each.
EDGES = 32


def finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return ok


def counted(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _v, _n, _run): each value, how many rows have it, and how many rows have it or a lesser one, within keys.

    Values are counted with a map-side combine, cut into buckets by quantiles of a sketch, and summed up inside buckets
    and across them; the sketch moves work only. Its EDGES * EDGES numbers are all that reaches the driver.
    """
    cells = EDGES * EDGES
    edges = df.agg(F.percentile_approx(F.col(value).cast("double"), [k / cells for k in range(1, cells)], 20 * cells)).first()[0] or []
    edges = sorted({float(x) for x in edges})
    coarse, own = edges[EDGES - 1 :: EDGES], df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    below = lambda some: F.size(F.filter(some, lambda x: x < F.col("_v")))
    if edges:
        groups = [edges[k * EDGES : (k + 1) * EDGES] for k in range(len(coarse) + 1)]
        own = own.withColumn("_c", below(F.array(*map(F.lit, coarse))) if coarse else F.lit(0))
        fine = F.element_at(F.from_json(F.lit(json.dumps(groups)), "array<array<double>>"), F.col("_c") + 1)
        own = own.withColumn("_b", F.col("_c") * (EDGES + 1) + F.coalesce(below(fine), F.lit(0)))
    else:
        own = own.withColumn("_b", F.lit(0))
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # of a row for each bucket
    per = own.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    runs = own.withColumn("_run", F.sum("_n").over(inside)).join(per, [*keys, "_b"])
    return runs.select(*keys, "_v", "_n", (F.col("_before") + F.col("_run")).alias("_run"))


def average_ranks(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` with the average rank, from 1, of a value within keys."""
    ranks = counted(df, value, keys).select(*keys, F.col("_v").alias(value), (F.col("_run") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, value])


def quantiles(df: DataFrame, value: str, shares: Sequence[float], name: str = "_cuts") -> DataFrame:
    """(name): one row, an array of exact quantiles of a value that is not null, interpolated; null if there is none.

    The two counted values around each share are picked out by their running counts; no task holds all values.
    """
    own = counted(df.select(F.col(value).cast("double").alias("_q")).where("_q is not null"), "_q")
    total = own.agg(F.sum("_n").alias("_all"))
    own = own.join(F.broadcast(total))  # one row
    at = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    pick = lambda k: F.max(F.when((F.col("_run") > k) & (F.col("_run") - F.col("_n") <= k), F.col("_v")))
    got = own.agg(F.max("_all").alias("_all"), *(x for i, p in enumerate(shares) for x in (pick(F.floor(at(p))).alias(f"_lo{i}"), pick(F.ceil(at(p))).alias(f"_hi{i}"))))
    cuts = F.array(*(F.col(f"_lo{i}") + (at(p) - F.floor(at(p))) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i, p in enumerate(shares)))
    return got.select(F.when(F.col("_all").isNotNull(), cuts).alias(name))


def rank_ic(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), least: int = LEAST, digits: int | None = None) -> DataFrame:
    """(keys, ic, n): Spearman's correlation of rows where both are finite; null unless n > least and both vary.

    digits: values equal to so many decimals are tied, so that ties do not hang on the last bits of a sum.
    """
    tied = (lambda c: F.col(c)) if digits is None else (lambda c: F.round(F.col(c).cast("double"), digits) + 0.0)
    ok = staged(df.where(finite(x, y)).select(*keys, tied(x).alias("_x"), tied(y).alias("_y")))
    r = average_ranks(average_ranks(ok, "_x", "_rx", keys), "_y", "_ry", keys)
    a, b, n = F.col("_rx"), F.col("_ry"), F.count("*")
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    out = r.groupBy(*keys).agg(n.alias("n"), cov.alias("_c"), F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"))
    return out.select(*keys, F.when((F.col("n") > least) & (F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_c") / (F.col("_sa") * F.col("_sb"))).alias("ic"), "n")


def the_ic(df: DataFrame, x: str, y: str, least: int = LEAST) -> float | None:
    got = rank_ic(df, x, y, (), least).first()
    return got and got.ic


def partial(r_fy: Column, r_ft: Column, r_ty: Column) -> Column:
    return (r_fy - r_ft * r_ty) / F.sqrt(F.greatest((1 - r_ft * r_ft) * (1 - r_ty * r_ty), F.lit(1e-12)))


def partial_ic(df: DataFrame, f: str, y: str, t: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, raw, backward, netted): f with y, f with t, and f with y given t, on rows where all are finite."""
    ok = staged(df.where(finite(f, y, t)))
    three = [rank_ic(ok, a, b, keys).select(*keys, F.col("ic").alias(n)) for a, b, n in ((f, y, "raw"), (f, t, "backward"), (t, y, "_ty"))]
    out = three[0]
    for other in three[1:]:
        out = out.join(other, list(keys)) if keys else out.crossJoin(other)  # one row each
    return out.select(*keys, "raw", "backward", partial(F.col("raw"), F.col("backward"), F.col("_ty")).alias("netted"))


def quantile_bins(df: DataFrame, level: str, bins: int, name: str) -> DataFrame:
    """`df` with the number of interior quantiles at or below the level; null where it is not finite. The cuts are one row."""
    cuts = quantiles(df.where(finite(level)), level, [k / bins for k in range(1, bins)])
    return df.join(F.broadcast(cuts)).withColumn(name, F.when(finite(level), F.size(F.filter("_cuts", lambda x: x <= F.col(level))))).drop("_cuts")


def stratified_ic(df: DataFrame, x: str, y: str, level: str, bins: int = 40, least: int = LEAST, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ic): mean of the correlations within bins of a level, weighted by their rows; the bins are those of each
    key's rows, one set of cuts for a key."""
    ok = df.where(finite(x, y, level))
    if keys:
        values = [tuple(r) for r in ok.groupBy(*keys).count().where(F.col("count") >= LEAST).select(*keys).orderBy(*keys).collect()]  # a row for each regime
        parts = [stratified_ic(ok.where(F.struct(*keys) == F.struct(*map(F.lit, v))), x, y, level, bins, least).select(*(F.lit(c).alias(k) for k, c in zip(keys, v, strict=True)), "ic") for v in values]
        out = parts[0] if parts else ok.select(*keys, F.lit(None).cast("double").alias("ic")).limit(0)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    per = rank_ic(quantile_bins(ok, level, bins, "_bin"), x, y, ["_bin"], least).where("ic is not null")
    return per.agg((F.sum(F.col("ic") * F.col("n")) / F.sum("n")).alias("ic"))


def gate_a(df: DataFrame, feature: str, vol: str, rate: str) -> DataFrame:
    """(scale, track, mag, disp): how far a feature, or its size, depends on the regime."""
    df = staged(df.withColumn("_abs", F.abs(feature)))
    tracks, mags, disp = [], [], []
    for level in (vol, rate):
        tracks.append(rank_ic(df, feature, level).select(F.abs("ic").alias("v")))
        mags.append(rank_ic(df, "_abs", level).select(F.abs("ic").alias("v")))
        d = quantile_bins(df.where(finite(feature)), level, 10, "_d").where("_d is not null")
        means = d.groupBy("_d").agg(F.avg(feature).alias("f"), F.avg("_abs").alias("a"))
        norm = df.where(finite(feature)).agg(F.stddev_pop(feature).alias("sf"), F.avg("_abs").alias("sa"))
        disp.append(means.agg(F.stddev_pop("f").alias("f"), F.stddev_pop("a").alias("a")).join(F.broadcast(norm)).select(F.greatest(F.col("f") / (F.col("sf") + 1e-12), F.col("a") / (F.col("sa") + 1e-12)).alias("v")))  # one row each
    bands = quantile_bins(df.where(finite(feature)), vol, 10, "_d").where("_d is not null").groupBy("_d").agg(F.stddev_pop(feature).alias("s")).where("s > 0")
    worst = lambda parts, name: parts[0].unionByName(parts[1]).agg(F.max("v").alias(name))
    out = bands.agg(F.when(F.count("*") >= 2, F.max("s") / F.min("s")).alias("scale"))
    for part in (worst(tracks, "track"), worst(mags, "mag"), worst(disp, "disp")):
        out = out.join(F.broadcast(part))  # one row
    return out


def mirrored(df: DataFrame, features: Sequence[str], target: str, odd: bool = True) -> DataFrame:
    """Each row and its reflection, interleaved by `_side`: the target changes sign, and so do odd features."""
    flip = {target: -F.col(target)} | ({f: -F.col(f) for f in features} if odd else {})
    return df.withColumn("_side", F.lit(0)).unionByName(df.withColumns(flip).withColumn("_side", F.lit(1)))


# walk-forward


def folded(df: DataFrame, order: Sequence[str], k: int = 6, embargo: int = 2000) -> tuple[DataFrame, int]:
    """`df` with `_seg` (segment, from 0) and `_from` (the first fold whose training rows include this row; k if none)."""
    from .scan import numbered

    own = staged(numbered(staged(df), [], order[0], list(order), "_i"))
    total = own.agg(F.max("_i")).first()[0] or 0
    edges = [int(x) for x in np.linspace(0, total, k + 1)]
    i = F.col("_i") - 1
    seg = sum((F.when(i >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    first = F.lit(k)
    for f in range(k - 1, 0, -1):
        first = F.when(i < max(0, edges[f] - embargo), f).otherwise(first)
    return own.withColumns({"_seg": seg, "_from": first}), total


def fit_folds(df: DataFrame, features: Sequence[str], target: str, k: int, least: int = LEAST) -> dict[int, np.ndarray]:
    """Fold -> coefficients, the intercept last: least squares on the rows before it, standardised on them.

    df is folded() and holds usable rows only. What reaches the driver are sums of products per fold, k rows.
    """
    cols = [*features, target]
    prods = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    got = df.groupBy("_from").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)), *prods).collect()
    tests = {r[0]: r[1] for r in df.groupBy("_seg").count().collect()}
    out, p = {}, len(features)
    for f in range(1, k):
        rows = [r for r in got if r["_from"] <= f]
        n = sum(r.n for r in rows)
        if n < least or tests.get(f, 0) < least:
            continue
        mean = np.array([sum(r[f"s{i}"] for r in rows) for i in range(p + 1)]) / n
        both = np.array([[sum(r[f"p{min(i, j)}_{max(i, j)}"] for r in rows) for j in range(p + 1)] for i in range(p + 1)]) / n - np.outer(mean, mean)
        dev = np.sqrt(np.maximum(np.diag(both)[:p], 0)) + 1e-12
        beta = np.linalg.pinv(both[:p, :p] / np.outer(dev, dev)) @ (both[:p, p] / dev) / dev
        out[f] = np.append(beta, mean[p] - beta @ mean[:p])
    return out


def predicted(df: DataFrame, features: Sequence[str], fits: dict[int, np.ndarray], name: str) -> DataFrame:
    """Test rows with their fold's prediction."""
    pred = F.lit(None).cast("double")
    for f, w in fits.items():
        lin = F.lit(float(w[-1]))
        for c, x in zip(features, w, strict=False):
            lin = lin + float(x) * F.col(c)
        pred = F.when(F.col("_seg") == f, lin).otherwise(pred)
    return df.withColumn(name, pred).where(F.col(name).isNotNull())


def reflected(df: DataFrame, features: Sequence[str], target: str, order: Sequence[str], embargo: int, mirror: str | None) -> tuple[DataFrame, list[str], int]:
    """Rows, order and embargo of a walk. mirror (odd, even): each row is followed by its reflection, in the same fold, and
    the embargo counts both; None: as they are."""
    if mirror is None:
        return df, list(order), embargo
    if mirror not in ("odd", "even"):
        raise ValueError(f"mirror is odd, even or None, not {mirror}")
    return mirrored(df, features, target, mirror == "odd"), [*order, "_side"], 2 * embargo


def walk_forward(
    df: DataFrame, features: Sequence[str], target: str, order: Sequence[str], k: int = 6, embargo: int = 2000, also: Sequence[str] = (), least: int = LEAST, mirror: str | None = None,
) -> tuple[DataFrame, dict]:
    """Test rows with `pred`, of an expanding, purged walk; rows must be finite in features, target and `also`."""
    df, order, embargo = reflected(df, features, target, order, embargo, mirror)
    own, _ = folded(df, order, k, embargo)
    own = staged(own.where(finite(*features, target, *also)))
    fits = fit_folds(own, features, target, k, least)
    return predicted(own, features, fits, "pred"), fits


def wf_ic(df: DataFrame, features: Sequence[str], target: str, order: Sequence[str], k: int = 6, embargo: int = 2000, by: Sequence[str] = (), mirror: str | None = None) -> DataFrame:
    """(by, ic, folds): mean over folds of the correlation of prediction and target."""
    test, _ = walk_forward(df, features, target, order, k, embargo, mirror=mirror)
    per = rank_ic(test, "pred", target, ["_seg", *by], LEAST - 1 if by else 1).where("ic is not null")
    return per.groupBy(*by).agg(F.avg("ic").alias("ic"), F.count("*").alias("folds"))


def aligned(df: DataFrame, legs: Sequence[str], controls: Sequence[str], target: str, order: Sequence[str], k: int = 6, embargo: int = 2000) -> DataFrame:
    """Test rows of one walk with `full` (controls and legs) and `base` (controls): both on the same rows and folds."""
    own, _ = folded(df, order, k, embargo)
    cols = [*controls, *legs]
    own = staged(own.where(finite(*cols, target)))
    both = predicted(own, cols, fit_folds(own, cols, target, k), "full")
    return staged(predicted(both, list(controls), fit_folds(own, controls, target, k), "base"))


def _marginals(test: DataFrame, target: str, keys: Sequence[str], least: int) -> DataFrame:
    """(keys, marginal) of aligned() test rows."""
    one, two = (rank_ic(test, c, target, keys, least).where("ic is not null").select(*keys, F.col("ic").alias(f"_{c}")) for c in ("full", "base"))
    return one.join(two, list(keys)).select(*keys, (F.col("_full") - F.col("_base")).alias("marginal"))


def fold_marginals(df: DataFrame, legs: Sequence[str], controls: Sequence[str], target: str, order: Sequence[str], k: int = 6, embargo: int = 2000) -> DataFrame:
    """(fold, marginal): what legs add to controls, on the same rows and folds."""
    return _marginals(aligned(df, legs, controls, target, order, k, embargo), target, ["_seg"], 1).withColumnRenamed("_seg", "fold")


def marginal_ic(df: DataFrame, features: Sequence[str], controls: Sequence[str], target: str, order: Sequence[str], k: int = 6, embargo: int = 2000) -> DataFrame:
    """(marginal): score of controls and features less that of controls, each on all rows that it can use itself."""
    one = wf_ic(df, [*controls, *features], target, order, k, embargo).select(F.col("ic").alias("_one"))
    two = wf_ic(df, list(controls), target, order, k, embargo).select(F.col("ic").alias("_two"))
    return one.join(F.broadcast(two)).select((F.col("_one") - F.col("_two")).alias("marginal"))  # one row


def signal_ic(
    df: DataFrame, legs: Sequence[str], controls: Sequence[str], target: str, order: Sequence[str], kind: str = "alpha", own: bool = False, level: str | None = None, bins: int = 40,
    by: str | None = None, k: int = 6, embargo: int = 2000, digits: int = 3,
) -> DataFrame:
    """(ic), or (by, ic) for each regime: Gate B, rounded.

    A feature scores what its legs add to the controls, averaged over folds. A control's own leg (kind control, own) cannot
    be asked that: it scores its plain correlation, within bins of `level` where it shares that yardstick with the
    target, averaged over legs. Regimes of fewer than 100 rows (of a fold's test rows) are left out.
    """
    if kind not in ("alpha", "control"):
        raise ValueError(f"kind is alpha or control, not {kind}")
    keys = [by] if by else []
    df = df if by is None else df.where(finite(by))
    if kind == "control" and own and (by is None or level is not None):
        parts = [stratified_ic(df, leg, target, level, bins, keys=keys) if level else rank_ic(df, leg, target).select("ic") for leg in legs]
        per = parts[0]
        for p in parts[1:]:
            per = per.unionByName(p)
        out = per.groupBy(*keys).agg(F.avg("ic").alias("ic"))
    else:
        test = aligned(df, legs, controls, target, order, k, embargo)
        out = _marginals(test, target, ["_seg", *keys], LEAST - 1 if by else 1).groupBy(*keys).agg(F.avg("marginal").alias("ic"))
    return out.select(*keys, F.round("ic", digits).alias("ic"))


def marginal_ci(df: DataFrame, legs: Sequence[str], controls: Sequence[str], target: str, order: Sequence[str], k: int = 6, embargo: int = 2000, draws: int = 400, seed: int = 0, digits: int = 3) -> DataFrame:
    """(pos, folds, mean, block, lo, hi, boot_mean): how sure a marginal is. Blocks are as long as the target's memory
    asks, and no longer than a thirtieth of the smallest fold unless the embargo is."""
    test = aligned(df, legs, controls, target, order, k, embargo)
    per = _marginals(test, target, ["_seg"], 1)
    rows = [r[0] for r in test.groupBy("_seg").count().select("count").collect()]  # a row per fold
    block = block_length(acf_lag(test, target, order), embargo, min(rows, default=0))
    boot = block_bootstrap(test, "full", "base", target, order, block, draws, seed)
    some = per.agg(F.count(F.when(F.col("marginal") > 0, 1)).alias("pos"), F.count("*").alias("folds"), F.round(F.avg("marginal"), digits).alias("mean"))
    some = some.withColumn("block", F.lit(block).cast("long"))
    return some.join(F.broadcast(boot.select(F.round("lo", digits).alias("lo"), F.round("hi", digits).alias("hi"), F.round("mean", digits).alias("boot_mean"))))  # one row


def acf_lag(df: DataFrame, value: str, order: Sequence[str], lags: Sequence[int] = (50, 100, 200, 500, 1000, 2000, 5000, 10000)) -> int:
    """First lag whose autocorrelation is below 2 / sqrt(n); lags are equi-joins on row numbers."""
    from .scan import numbered

    own = staged(numbered(staged(df.where(finite(value)).select(*order, value)), [], order[0], list(order), "_i"))
    n, mean, var = own.agg(F.count("*"), F.avg(value), F.var_pop(value)).first()
    if n < 200:
        return lags[0]
    for lag in lags:
        if lag >= n:
            break
        then = own.select((F.col("_i") + lag).alias("_i"), F.col(value).alias("_then"))
        c = own.join(then, "_i").agg(F.sum((F.col(value) - mean) * (F.col("_then") - mean))).first()[0]
        if abs(c / ((n * var) or 1.0)) < 2 / n**0.5:
            return lag
    return lags[-1]


def block_length(lag: int, embargo: int, n: int, safety: int = 10) -> int:
    return int(np.clip(safety * lag, embargo, max(embargo, n // 30)))


def _sampler():
    """Functions that travel to the executors by value, so that these need no installation of this package."""

    def block_start(seed: int, draw: int, fold: int, number: int, places: int) -> int:
        """Where a block begins, from 0: the first 13 hex digits of a digest, as a share of the places."""
        return int(hashlib.md5(f"{seed}|{draw}|{fold}|{number}".encode()).hexdigest()[:13], 16) * places >> 52

    def sample_ranks(codes: np.ndarray) -> np.ndarray:
        """Average ranks, from counts of whole numbers."""
        n = np.bincount(codes)
        return (np.cumsum(n) - (n - 1) / 2)[codes]

    return block_start, sample_ranks


block_start, _sample_ranks = _sampler()


def block_bootstrap(test: DataFrame, full: str, base: str, target: str, order: Sequence[str], block: int, draws: int = 400, seed: int = 0, parts: int = 8) -> DataFrame:
    """(lo, hi, mean) of the mean marginal over folds, from moving blocks drawn within folds; draws repeat on every run.

    Draws are dealt to tasks. A task needs a fold's rows in order, as a sample of a series is not a sum: it is sent three
    ranks a row, 12 bytes, packed as arrays of a few thousand rows, not the rows themselves.
    """
    from .scan import numbered

    rows = staged(numbered(test.select(F.col("_seg").cast("long").alias("_seg"), *order, full, base, target), ["_seg"], order[0], list(order), "_i"))
    for c in (full, base, target):  # ties stay ties, and order is all that ranks of a sample depend on
        rows = average_ranks(rows, c, f"_r_{c}", ["_seg"])
    packed = rows.groupBy("_seg", F.floor((F.col("_i") - 1) / 4096).alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_i", *((2 * F.col(f"_r_{c}")).cast("int").alias(n) for c, n in ((full, "a"), (base, "b"), (target, "y")))))).alias("_rows"))
    packed = staged(packed.select("_seg", "_at", *(F.col(f"_rows.{n}").alias(n) for n in "aby")))
    start_of, ranks_of = block_start, _sample_ranks
    dealt = packed.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(pdf):
        import pandas as pd

        task, fold = int(pdf["_task"].iloc[0]), int(pdf["_seg"].iloc[0])
        pdf = pdf.sort_values("_at")
        x = [np.concatenate([np.asarray(v, np.int32) for v in pdf[n]]) for n in "aby"]
        n, out = len(x[0]), []
        for draw in range(task, draws, parts):
            if n <= block:
                at = np.arange(n)
            else:
                starts = np.array([start_of(seed, draw, fold, j, n - block + 1) for j in range(-(-n // block))])
                at = (starts[:, None] + np.arange(block)).ravel()[:n]
            r = [ranks_of(c[at]) for c in x]
            if all(c.std() > 0 for c in r):
                out.append((draw, np.corrcoef(r[0], r[2])[0, 1] - np.corrcoef(r[1], r[2])[0, 1]))
        return pd.DataFrame(out, columns=["draw", "v"])

    per = dealt.groupBy("_task", "_seg").applyInPandas(run, "draw long, v double").groupBy("draw").agg(F.avg("v").alias("v"))
    return per.agg(F.percentile("v", F.lit(0.05)).alias("lo"), F.percentile("v", F.lit(0.95)).alias("hi"), F.avg("v").alias("mean"))  # of `draws` numbers


# shaping


# The coefficients of Acklam's rational approximation of the inverse normal distribution, highest power first.
ACKLAM = {
    "a": (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    "b": (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    "c": (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    "d": (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
}
#: Where its middle part begins.
ACKLAM_TAIL = 0.02425


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution (error below 1.2e-9 of the value)."""

    def poly(name, x):
        k = ACKLAM[name]
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q = p - 0.5
    tail = lambda x: poly("c", x) / poly("d", x)
    middle = q * poly("a", q * q) / poly("b", q * q)
    return F.when(p < ACKLAM_TAIL, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - ACKLAM_TAIL, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def shaping(df: DataFrame, value: str, clip: float = 4.0) -> DataFrame:
    """(shape, n, std, skew, excess_kurtosis, max_abs) of the raw feature and of its four candidate shapes; raises where no
    value is finite."""
    ok = staged(df.where(finite(value)).select(F.col(value).alias("f")))
    if ok.isEmpty():
        raise ValueError(f"{value} has no finite value")
    mid = ok.agg(F.avg("f").alias("m"), F.stddev_pop("f").alias("s"), F.count("*").alias("n"))
    med = quantiles(ok, "f", [0.5]).select(F.col("_cuts")[0].alias("med"))
    ok = staged(ok.join(F.broadcast(mid)).join(F.broadcast(med)).withColumn("_off", F.abs(F.col("f") - F.col("med"))))  # one row each
    mad = quantiles(ok, "_off", [0.5]).select((1.4826 * F.col("_cuts")[0]).alias("mad"))
    ok = average_ranks(ok.join(F.broadcast(mad)), "f", "r")
    rz = F.when(F.col("mad") > 0, (F.col("f") - F.col("med")) / F.col("mad")).otherwise(0.0)
    shapes = {"raw": F.col("f"), "z-score": F.when(F.col("s") > 0, (F.col("f") - F.col("m")) / F.col("s")).otherwise(0.0), "robust+clip": F.greatest(F.least(rz, F.lit(clip)), F.lit(-clip)), "arcsinh": F.asinh(rz), "rank-Gaussian": normal_quantile((F.col("r") - 0.5) / F.col("n"))}
    long = ok.select(F.explode(F.array(*(F.struct(F.lit(k).alias("shape"), v.alias("v")) for k, v in shapes.items()))).alias("x")).select("x.*")
    return long.groupBy("shape").agg(F.count("*").alias("n"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("excess_kurtosis"), F.max(F.abs("v")).alias("max_abs"))


def lightest(report: DataFrame, bar: float = 5.0) -> DataFrame:
    """(shape): the lightest candidate without wild outliers."""
    order = F.array_position(F.array(*map(F.lit, ("z-score", "robust+clip", "arcsinh", "rank-Gaussian"))), F.col("shape"))
    return report.where((order > 0) & (F.col("max_abs") <= bar)).agg(F.min_by("shape", order).alias("shape"))


# verdicts over blocks


def block_stats(df: DataFrame, keys: Sequence[str], block: str, value: str) -> DataFrame:
    """(keys, block0, mean, std, n, same_sign) of the blocks after the first."""
    first = df.where(F.col(block) == 0).select(*keys, F.col(value).alias("block0"))
    return df.where((F.col(block) > 0) & finite(value)).join(first, list(keys)).groupBy(*keys, "block0").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"), F.avg(F.when(F.signum(value) == F.signum("block0"), 1.0).otherwise(0.0)).alias("same_sign")
    )


def verdict(floor: float = 0.02) -> Column:
    same = (F.signum("mean") == F.signum("block0")) & (F.col("block0") != 0)
    holds = same & (F.abs("mean") >= 0.5 * F.abs("block0")) & (F.abs("mean") > floor) & (F.col("same_sign") >= 0.7) & (F.abs("mean") >= F.col("std"))
    return F.when(~finite("block0", "mean", "same_sign"), "INSUFFICIENT").when(F.coalesce(holds, F.lit(False)), "PERSISTS").otherwise("FADES")


def echo_verdict(floor: float = 0.02) -> Column:
    """Of columns raw and net: how much of a lead is left once the echo of the past move is taken away."""
    left = (F.abs("net") > floor) & (F.signum("net") == F.signum("raw")) & (F.col("raw") != 0)
    return F.when(~finite("raw", "net"), "INSUFFICIENT").when(~left, "COLLAPSES").when(F.abs(F.col("net") / F.col("raw")) >= 0.5, "PERSISTS").otherwise("SHRINKS")


def best_span(ics: DataFrame, span: str = "span") -> DataFrame:
    """(span): that with the greatest mean size of ic over legs, whatever its sign."""
    return ics.groupBy(span).agg(F.avg(F.abs("ic")).alias("s")).agg(F.max_by(span, "s").alias(span))
