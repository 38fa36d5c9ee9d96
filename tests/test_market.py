"""The market operators: hand-made tables, loops as oracles, and invariants."""

import math
import os
import pickle
import random
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone.functions import market as m
from marlstone.operators import align, ema, scan, stats
from marlstone.operators import events as ev
from marlstone.plans import cache, dataset, features, oos, outcomes, research
from marlstone.plans.market import Market
from marlstone.sources import market as src
from marlstone.sources import session
from marlstone.streaming import live
from marlstone.streaming import query as sq

DATA = "/root/testdata/sf0.001"
HOUR = src.HOUR


def book_of(spark, rows):
    """rows: (listing, seq, rx, bid, bid size, ask, ask size)."""
    return spark.createDataFrame([(a, s, r, r, b, bq, c, cq) for a, s, r, b, bq, c, cq in rows], src.BOOK)


def trade_of(spark, rows):
    """rows: (listing, seq, rx, aggressor, price, size)."""
    return spark.createDataFrame([(a, s, r, r, g, p, q) for a, s, r, g, p, q in rows], src.TRADE)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def data(spark):
    book, trade = src.books(spark, DATA), src.trades(spark, DATA)
    mk = Market(book, trade, src.LISTINGS, "byb", None, 30)
    mk.reads = align.uniform_grid(mk.clock, 20, HOUR, 4 * HOUR).cache()
    return mk


# normalisation


def test_same_time_rows_are_one_event(spark):
    b = book_of(spark, [("a", 1, 10, 1.0, 1.0, 2.0, 1.0), ("a", 2, 10, 1.5, 1.0, 2.0, 1.0), ("a", 3, 20, 1.0, 2.0, 2.0, 3.0)])
    assert rows(ev.last_per_time(b), "rx", "bid_prc") == [(10, 1.5), (20, 1.0)]
    t = trade_of(spark, [("a", 1, 10, "Bid", 1.0, 1.0), ("a", 2, 10, "Bid", 2.0, 3.0), ("a", 3, 10, "Ask", 5.0, 1.0), ("a", 4, 10, "Bid", 7.0, 2.0), ("a", 5, 11, "Bid", 7.0, 2.0)])
    assert rows(ev.collapse_trades(t), "rx", "aggressor", "prc", "qty") == [(10, "Ask", 5.0, 1.0), (10, "Bid", 1.75, 4.0), (10, "Bid", 7.0, 2.0), (11, "Bid", 7.0, 2.0)]


def test_serial_covariance_of_every_print_at_one_time(spark):
    t = trade_of(spark, [("a", 1, 10, "Bid", 1.0, 1.0), ("a", 2, 10, "Bid", 2.0, 1.0), ("a", 3, 10, "Bid", 4.0, 1.0), ("a", 4, 20, "Bid", 3.0, 1.0)])
    assert rows(ev.serial_covariance(t, collapse=False), "seq", "cov") == [(1, 0.0), (2, 0.0), (3, 2.0), (4, -2.0)]
    assert ev.serial_covariance(t).count() < 4


def test_order_flow_forms_differ_at_one_time(spark):
    b = book_of(spark, [("a", 1, 10, 1.0, 5.0, 2.0, 5.0), ("a", 2, 20, 1.1, 4.0, 2.0, 5.0), ("a", 3, 20, 1.0, 6.0, 2.0, 5.0), ("a", 4, 30, 1.0, 7.0, 1.9, 2.0)])
    assert rows(ev.ofi_path(b), "rx", "ofi") == [(20, 4.0 - 4.0), (30, 1.0 - 2.0)]
    assert rows(ev.ofi_endpoint(b), "rx", "ofi") == [(10, 0.0), (20, 1.0), (30, 1.0 - 2.0)]


def test_division_by_nothing_is_null(spark):
    b = book_of(spark, [("a", 1, 10, 1.0, 0.0, 2.0, 0.0)])
    assert b.select(m.imbalance()).first()[0] is None and b.where(m.valid_l1()).count() == 0


def test_inverted_venues_name_the_other_side(spark):
    t = trade_of(spark, [("x", 1, 1, "Bid", 1.0, 1.0), ("y", 2, 1, "Bid", 1.0, 1.0)])
    assert rows(t.select("listing", m.sign(frozenset({"y"})).alias("s")), "listing", "s") == [("x", 1.0), ("y", -1.0)]


def test_merge_takes_the_newest_by_exchange_time(spark):
    b = spark.createDataFrame([("byb", 1, 10, 100, 1.0, 1.0, 2.0, 1.0), ("byb", 4, 40, 130, 1.0, 1.0, 2.0, 1.0)], src.BOOK)
    t = spark.createDataFrame([("byb", 2, 20, 90, "Bid", 1.9, 1.0), ("byb", 3, 30, 110, "Bid", 1.8, 1.0), ("byb", 5, 50, 140, "Ask", 2.5, 1.0), ("byb", 6, 60, 150, "Bid", 0.0, 1.0)], src.TRADE)
    out = rows(ev.merged_levels(b, t, src.tick_sizes(spark)), "rx", "bid_prc", "ask_prc")
    # a stale print is ignored; a fresh one moves its side; a crossed pair is parted on the older side
    assert out == [(10, 1.0, 2.0), (20, 1.0, 2.0), (30, 1.0, 1.8), (40, 1.0, 2.0), (50, 2.5, 2.51)]
    with pytest.raises(Exception, match="no tick size"):
        src.with_ticks(b.withColumn("listing", F.lit("zzz")), src.tick_sizes(spark)).collect()


def test_rolling_minimum(spark):
    r = np.random.default_rng(0).integers(0, 1000, 300)
    df = spark.createDataFrame([("a", k, int(k * 1e9), int(v)) for k, v in enumerate(r)], "listing string, seq long, rx long, v long")
    for w in (1, 7, 50, 400):
        got = [x for _, x in rows(ev.rolling_min(df, "v", w, "least"), "seq", "least")]
        assert got == pd.Series(r).rolling(w, min_periods=1).min().astype(int).tolist()


# scans and alignment


@pytest.mark.parametrize("chunk", [1, 7, 1000, 10**9])
def test_scans_do_not_depend_on_chunks(spark, chunk):
    r = random.Random(chunk)
    own = [("ab"[r.random() < 0.3], k, r.randint(0, 300), r.choice([None, r.randint(0, 9)])) for k in range(200)]
    df = spark.createDataFrame(own, "listing string, seq long, rx long, v long").repartition(3)
    sums, last, back = {}, {}, {}
    want = []
    for a, k, x, v in sorted(own, key=lambda y: (y[2], y[1])):
        sums[a] = sums.get(a, 0) + (v or 0)
        if v is not None:
            last[a] = v
        back.setdefault(a, []).append(k)
        want.append((k, sums[a], last.get(a), back[a][-2] if len(back[a]) > 1 else None, back[a][-4] if len(back[a]) > 3 else None))
    out = scan.running(df, ["listing"], "rx", ["rx", "seq"], {"s": F.coalesce("v", F.lit(0))}, chunk)
    out = scan.carried(out, ["listing"], "rx", ["rx", "seq"], ["v"], chunk)
    out = scan.neighbours(out, ["listing"], "rx", ["rx", "seq"], {"one": ("seq", 1), "three": ("seq", 3)}, chunk)
    assert sorted(map(tuple, out.select("seq", "s", "v", "one", "three").collect()), key=lambda y: y[0]) == sorted(want)


@pytest.mark.parametrize("fan", [1, 3, 4096])
def test_scans_do_not_depend_on_spans(spark, fan, monkeypatch):
    monkeypatch.setattr(scan, "FAN", fan)
    test_scans_do_not_depend_on_chunks(spark, 7)


def test_no_window_partition_grows_with_the_history(spark):
    """Millisecond steps of two days: the rows of a chunk, and the chunks of a span, stay below what their lengths allow."""
    ms = spark.range(0, 2 * 86_400_000, 100).select(F.lit("a").alias("listing"), (F.col("id") * 1_000_000).alias("rx"))
    chunks = scan.in_chunks(ms, "rx")
    assert chunks.groupBy("listing", "_chunk").count().agg(F.max("count")).first()[0] == scan.CHUNK // 100_000_000
    year = spark.range(0, 365 * 86_400_000_000_000 // scan.CHUNK).select(F.lit("a").alias("listing"), F.col("id").alias("_chunk"))
    per_span = scan._in_spans(year).groupBy("listing", "_span").count()
    assert per_span.agg(F.max("count")).first()[0] == scan.FAN and per_span.count() == 13
    plan = scan.running(ms, ["listing"], "rx", ["rx"], {"n": F.lit(1)})._jdf.queryExecution().analyzed().toString()
    windows = [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Window")]
    assert len(windows) == 3 and sum("_chunk" in x.split("],")[1] for x in windows) >= 1


def test_running_maximum(spark):
    r = random.Random(4)
    own = [("ab"[k % 2], k, r.randint(0, 400), r.choice([None, r.random()])) for k in range(150)]
    df = spark.createDataFrame(own, "listing string, seq long, rx long, v double")
    best, want = {}, []
    for a, k, _, v in sorted(own, key=lambda y: (y[2], y[1])):
        if v is not None:
            best[a] = max(best.get(a, v), v)
        want.append((k, best.get(a)))
    assert rows(scan.highest(df, ["listing"], "rx", ["rx", "seq"], ["v"], 20), "seq", "v") == sorted(want)


def test_uniform_grid_is_a_range(spark, monkeypatch):
    clock = spark.createDataFrame([(10 * k, k) for k in range(1, 101)], "rx long, n long")
    for grid in (1, 7, 65_536):
        monkeypatch.setattr(align, "GRID", grid)
        assert [x[0] for x in rows(align.uniform_grid(clock, 5, 100, 3), "t")] == list(range(60, 900, 3))
    assert align.uniform_grid(clock, 5, 10_000, 3).count() == 0


def test_as_of_reads(spark):
    e = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("a", 30, None)], "listing string, rx long, v double")
    q = spark.createDataFrame([("a", t) for t in (5, 10, 15, 20, 31)], "listing string, t long")
    assert [x.v for x in align.asof(q, e, ["listing"], ["v"]).orderBy("t").collect()] == [None, 1.0, 1.0, 2.0, None]
    assert [x.v for x in align.asof(q, e, ["listing"], ["v"], strict=True).orderBy("t").collect()] == [None, None, 1.0, 1.0, None]
    assert [x.v for x in align.asof_clipped(q, e, ["listing"], ["v"]).orderBy("t").collect()][0] == 1.0
    assert rows(align.nth_after(q, e.select("listing", "rx"), ["listing"], 2, ["rx"]), "t", "rx")[:2] == [(5, 20), (10, 30)]
    assert [x[1] for x in rows(align.trailing_count(q, e, ["listing"], 11, "n"), "t", "n")] == [0, 1, 1, 2, 1]


def test_interval_sums_close_at_ticks(spark):
    e = spark.createDataFrame([("a", r, 1.0) for r in (1, 10, 11, 20, 25)], "listing string, rx long, v double")
    c = spark.createDataFrame([(10, 1), (20, 2)], "rx long, n long")
    assert rows(align.interval_sum(e, c, ["listing"], {"v": F.col("v")}), "n", "v") == [(1, 2.0), (2, 2.0), (3, 1.0)]


# averages


@pytest.mark.parametrize("span", [1, 2, 5, 100])
def test_averages_match_a_loop(spark, span):
    x = np.random.default_rng(1).normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"n": np.arange(1, 3001), "x": x}))
    got = [r.y for r in ema.ewm(df, [], "n", {"y": F.col("x")}, span).orderBy("n").collect()]
    a, y, want = 2 / (span + 1), 0.0, []
    for v in x:
        y = a * v + (1 - a) * y
        want.append(y)
    assert np.abs(np.array(got) - want).max() < 1e-12


@pytest.mark.parametrize("span", [1, 3, 40])
def test_kernels_match_an_event_loop(spark, span):
    r = random.Random(span)
    ticks = sorted(r.sample(range(1000), 300))
    events = [(r.randrange(1000), r.gauss(0, 1)) for _ in range(400)]
    reads = sorted(r.sample(range(1000), 120))
    clock = spark.createDataFrame(list(zip(ticks, range(1, 301), strict=True)), "rx long, n long")
    e = spark.createDataFrame([("a", t, v) for t, v in events], "listing string, rx long, v double")
    got = {x.t: x.e for x in ema.kernel(e, clock, spark.createDataFrame([(t,) for t in reads], "t long"), ["a"], {"e": F.col("v")}, span).collect()}
    flow, want = live.Flow(span), {}
    stamps = {}
    for t, v in events:
        stamps.setdefault(t, []).append(v)
    for t in range(1000):
        for v in stamps.get(t, []):
            flow.add(v)
        if t in set(ticks):
            flow.tick()
        if t in set(reads):
            want[t] = flow.e
    assert max(abs(got[t] - want[t]) for t in reads) < 1e-12


def test_average_of_nothing_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0)], "e double, w double")
    assert [x[0] for x in df.select(ema.mean("e", "w")).collect()] == [None, 0.5]


# features


def test_registry():
    assert len(features.all_features("feature")) == 9 and len(features.all_features("module")) == 15
    with pytest.raises(KeyError):
        features.get("none")
    with pytest.raises(ValueError, match="twice"):
        features.register(1, "odd")(features.ofi_ema)


@pytest.mark.parametrize("name", ["trade_flow_imbalance", "flow_persistence", "ofi_ema", "price_momentum", "stoikov_premium_fast_slow", "vol_momentum"])
def test_mirror_commutes(spark, data, name):
    """Reflecting prices about a level and swapping sides changes the sign of odd features only."""
    f = features.get(name)
    flip = data.book.select("listing", "seq", "rx", "exchange_time", (1 / F.col("ask_prc")).alias("bid_prc"), F.col("ask_qty").alias("bid_qty"), (1 / F.col("bid_prc")).alias("ask_prc"), F.col("bid_qty").alias("ask_qty"))
    side = F.when(F.col("aggressor") == "Bid", "Ask").otherwise("Bid")
    other = Market(flip, data.trade.withColumn("aggressor", side).withColumn("prc", 1 / F.col("prc")), data.listings, "byb", data.reads, 30)
    spans = (5, 20)[: f.spans]
    a = f.build(data, *spans).withColumnRenamed("value", "a")
    both = a.join(f.build(other, *spans), ["listing", "t"]).where("a is not null").toPandas()
    sign, close = (-1 if f.kind == "odd" else 1), 1e-9 if name in ("trade_flow_imbalance", "flow_persistence", "ofi_ema") else 2e-3
    assert len(both) and (both.a - sign * both.value).abs().max() <= close * max(1.0, both.a.abs().max())


def test_features_do_not_depend_on_partitions(data):
    spread = Market(data.book.repartition(7), data.trade.repartition(3), data.listings, "byb", data.reads.repartition(2), 30)
    for name in ("price_dislocation", "rate_momentum", "m_range_breakout"):
        f = features.get(name)
        a, b = (f.build(x, *(5, 20)[: f.spans]).toPandas().sort_values(["listing", "t"]).reset_index(drop=True) for x in (data, spread))
        pd.testing.assert_frame_equal(a, b, rtol=1e-10)


# dataset


def test_templates_expand_in_order_and_are_checked():
    c = dataset.Column
    assert len(dataset.TEMPLATES) == 62
    names = [u.name for u in dataset.expand([c("{LISTING}_ema_ofi_{N}b", ["a", "b"], [5, 9]), c("{LISTING}_vol_{N}t@{CLOCK}", ["a"], [5], ["trades_b"]), c("{LISTING1}_{LISTING2}_ema_log_microprice_ratio_{N}ms", pairs=[("a", "b")], spans=[3])], ["a", "b"])]
    assert names == ["a_ema_ofi_5b", "a_ema_ofi_9b", "b_ema_ofi_5b", "b_ema_ofi_9b", "a_vol_5t@trades_b", "a_b_ema_log_microprice_ratio_3ms"]
    for bad in (c("{LISTING}_nothing", ["a"]), c("{LISTING}_microprice", ["z"]), c("{LISTING}_microprice", ["a"], [5]), c("{LISTING}_dt_{N}b", ["a"]), c("{LISTING}_dt_{N}b", ["a"], [0])):
        with pytest.raises(ValueError):
            dataset.expand([bad], ["a", "b"])
    with pytest.raises(ValueError, match="twice"):
        dataset.expand([c("{LISTING}_microprice", ["a"])] * 2, ["a"])


def test_a_subset_of_columns_is_the_same_columns(spark, data, tmp_path):
    c = dataset.Column
    low, high = data.book.agg(F.floor(F.min("rx") / HOUR) + 1, F.floor(F.max("rx") / HOUR)).first()
    ds = dataset.Dataset(data.book, data.trade, src.LISTINGS, "byb", HOUR, low, high)
    asked = [c("{LISTING}_microprice", ["byb", "okx"]), c("{LISTING}_ema_ofi_{N}b", ["byb"], [5]), c("{LISTING}_return_{N}ms", ["byb"], [3])]
    full = ds.build(asked)
    assert full.columns == ["t", "byb_microprice", "okx_microprice", "byb_ema_ofi_5b", "byb_return_3ms"]
    assert full.where(F.greatest(*(F.col(x).isNull().cast("int") for x in full.columns)) > 0).count() == 0
    assert rows(full, "t", "byb_ema_ofi_5b") == rows(ds.build(asked[1:2]), "t", "byb_ema_ofi_5b")
    path = str(tmp_path / cache.grid_hash(ds))
    cache.write_blocks(full.withColumn("block", F.when(F.col("t") < low + 100, "b0").otherwise("b1")), path)
    assert "okx_microprice" in cache.cached_columns(spark, path)
    assert rows(cache.read_dataset(spark, path, ["byb_microprice"]), "t", "byb_microprice") == rows(full, "t", "byb_microprice")
    assert cache.read_dataset(spark, path, blocks=["b1"], trim={"b1": 5}).agg(F.min("t")).first()[0] >= low + 100
    with pytest.raises(ValueError):
        cache.read_dataset(spark, path, ["nothing"])


def test_averages_over_every_step_match_a_dense_loop(spark):
    """States and trades at odd times, read on a grid on which most steps have no event."""
    r, spans = random.Random(4), (1, 4, 60)
    times = sorted(r.sample(range(3000), 120))
    price, states = 100.0, []
    for k, t in enumerate(times):
        price += r.choice([-0.1, 0.0, 0.1])
        states.append(("ab"[k % 3 == 0], k, t, price, 1.0 + r.randrange(5), price + 0.2, 1.0 + r.randrange(5)))
    trades = [("a", 1000 + k, t, r.choice(["Bid", "Ask"]), 100.0, 1.0 + r.randrange(3)) for k, t in enumerate(sorted(r.sample(range(3000), 60)))]
    step, low, high = 10, 20, 290
    ds = dataset.Dataset(book_of(spark, states), trade_of(spark, trades), ("a", "b"), "a", step, low, high, reference={"a": 99.5})
    c = dataset.Column
    one = [c(f"{{LISTING}}_{x}", ["a"], spans) for x in ("ema_microprice_centered_{N}ms", "ema_microprice_centered_sq_{N}ms", "ema_microprice_return_sq_{N}ms", "ema_buy_trade_value_{N}ms")]
    two = [c(f"{{LISTING1}}_{{LISTING2}}_{x}", pairs=[("a", "b")], spans=spans) for x in ("ema_log_microprice_ratio_{N}ms", "ema_log_microprice_ratio_sq_{N}ms")]
    got_ = {x[0]: np.array(x[1:]).reshape(6, 3) for x in map(tuple, ds.build(one + two, single=False).collect())}
    a, y, want, before = 2 / (np.array(spans) + 1), np.zeros((6, 3)), {}, None
    for t in range(low, high + 1):
        micro = {}
        for x, _, rx, bid, bq, ask, aq in states:
            if rx <= t * step:
                micro[x] = (bid * aq + ask * bq) / (bq + aq)
        now = micro.get("a")
        level = now - 99.5 if now is not None else 0.0
        ret = math.log(now / before) if now is not None and before is not None else 0.0
        buys = sum(p * q for _, _, rx, g, p, q in trades if g == "Bid" and (t - 1) * step < rx <= t * step)
        ratio = math.log(micro["a"] / micro["b"]) if len(micro) == 2 else 0.0
        y = (1 - a) * y + a * np.array([level, level**2, ret**2, buys, ratio, ratio**2])[:, None]
        want[t], before = y.copy(), now
    assert len(got_) > 20
    assert max(np.abs(v - want[t]).max() for t, v in got_.items()) < 1e-9


def test_trades_between_entry_and_exit_match_a_scan(spark):
    r = random.Random(9)
    b = book_of(spark, [("a", k, 10 * k, 100.0 + r.random(), 10.0, 101.0 + r.random(), 10.0) for k in range(300)])
    own = [("a", 1000 + k, r.randrange(3000), r.choice(["Bid", "Ask"]), 90 + 20 * r.random(), 1.0 + r.randrange(4)) for k in range(500)]
    own += [("a", 5000 + k, 1500, "Bid", 100.0 + k, 1.0) for k in range(5)]  # at one time
    for horizon in (40, 700, 2500):
        q = [(t,) for t in range(0, 2900, 37)]
        out = {x.t: x for x in outcomes.outcomes(b, trade_of(spark, own), spark.createDataFrame(q, "t long"), horizon).collect()}
        for (t,) in q:
            mid = out[t].eval_mid
            for name, side in (("buy", "Bid"), ("sell", "Ask")):
                hit = [(p, p * z) for _, _, rx, g, p, z in own if g == side and t <= rx < t + horizon]
                assert out[t][f"c_{name}_trade_count"] == len(hit)
                low, high, value = out[t][f"c_{name}_trade_min_l"], out[t][f"c_{name}_trade_max_l"], out[t][f"c_{name}_trade_value_l"]
                if hit:
                    assert math.isclose(low, math.log(min(hit)[0] / mid), rel_tol=1e-12) and math.isclose(high, math.log(max(hit)[0] / mid), rel_tol=1e-12) and abs(value - math.log(sum(x[1] for x in hit))) < 1e-9
                else:
                    assert (low, high, value) == (math.inf, -math.inf, -math.inf)


def test_outcomes_of_a_small_session(spark):
    b = book_of(spark, [("a", k, 1000 * k, 100.0 + k, 10.0, 101.0 + k, 10.0) for k in range(10)])
    t = trade_of(spark, [("a", 100, 2500, "Bid", 104.0, 1.0), ("a", 101, 3500, "Ask", 102.0, 2.0), ("a", 102, 9000, "Bid", 200.0, 1.0)])
    q = spark.createDataFrame([(2000,), (-5,)], "t long")
    out = {r.t: r for r in outcomes.outcomes(b, t, q, 3000, 0, 0).collect()}
    r, mid = out[2000], 102.5
    assert r.eval_mid == mid and r.c_bid_entry_l == math.log(102 / mid) and r.c_mid_exit_l == math.log(104.5 / mid)  # the book at 5000 is too late
    assert (r.c_mid_move_count, r.c_mid_up_count, r.c_mid_down_count) == (2, 2, 0)
    assert r.c_buy_trade_max_l == math.log(104 / mid) and r.c_sell_trade_min_l == math.log(102 / mid) and r.c_sell_trade_count == 1
    assert out[-5].eval_mid == 0 and out[-5].c_buy_trade_min_l == math.inf


# statistics


def spearman(x, y):
    return pd.Series(np.asarray(x)).rank().corr(pd.Series(np.asarray(y)).rank())


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(3)
    n = 3000
    f, c = r.normal(size=n), r.normal(size=n)
    y = np.where(r.random(n) < 0.6, 0.0, 0.5 * f + 0.3 * c + r.normal(size=n))
    pdf = pd.DataFrame({"t": np.arange(n), "f": f, "c": c, "y": y, "lv": r.normal(size=n)})
    pdf.loc[::50, "f"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_rank_correlation_with_ties(sample):
    pdf, df = sample
    ok = pdf.dropna()
    assert abs(stats.the_ic(df, "f", "y") - spearman(ok.f, ok.y)) < 1e-12
    assert stats.the_ic(df.where("t < 90"), "f", "y") is None and stats.the_ic(df.withColumn("k", F.lit(1.0)), "k", "y") is None


def test_walk_forward_is_least_squares_on_the_past(sample):
    pdf, df = sample
    ics = []
    edges = np.linspace(0, len(pdf), 7).astype(int)
    for i in range(1, 6):
        tr, te = pdf.iloc[: max(0, edges[i] - 100)].dropna(), pdf.iloc[edges[i] : edges[i + 1]].dropna()
        w, *_ = np.linalg.lstsq(np.column_stack([tr.f, tr.c, np.ones(len(tr))]), tr.y, rcond=None)
        ics.append(spearman(np.column_stack([te.f, te.c, np.ones(len(te))]) @ w, te.y))
    got = stats.wf_ic(df, ["f", "c"], "y", ["t"], embargo=100).first()
    assert got.folds == 5 and abs(got.ic - np.mean(ics)) < 1e-9
    marg = stats.fold_marginals(df, ["f"], ["c"], "y", ["t"], embargo=100).agg(F.avg("marginal")).first()[0]
    assert marg > 0.1
    none = stats.fold_marginals(df, ["lv"], ["c"], "y", ["t"], embargo=100).agg(F.avg("marginal")).first()[0]
    assert abs(none) < 0.05


def folds_of(pdf, cols, y, embargo, k=6):
    """(test rows, prediction) of each fold, by least squares."""
    edges = np.linspace(0, len(pdf), k + 1).astype(int)
    for i in range(1, k):
        tr, te = pdf.iloc[: max(0, edges[i] - embargo)].dropna(), pdf.iloc[edges[i] : edges[i + 1]].dropna()
        w, *_ = np.linalg.lstsq(np.column_stack([tr[cols], np.ones(len(tr))]), tr[y], rcond=None)
        yield te, np.column_stack([te[cols], np.ones(len(te))]) @ w


def test_gate_b(sample):
    pdf, df = sample
    pdf = pdf.assign(half=(pdf.lv > 0).astype(int))
    df = df.withColumn("half", (F.col("lv") > 0).cast("int"))
    full, base = list(folds_of(pdf, ["c", "f"], "y", 100)), list(folds_of(pdf, ["c"], "y", 100))
    want = [spearman(p, te.y) - spearman(q, te.y) for (te, p), (_, q) in zip(full, base, strict=True)]
    args = (df, ["f"], ["c"], "y", ["t"])
    got_ = sorted(tuple(r) for r in stats.fold_marginals(*args, embargo=100).collect())
    assert np.abs(np.array([x[1] for x in got_]) - want).max() < 1e-9
    assert stats.signal_ic(*args, embargo=100).first().ic == round(float(np.mean(want)), 3)
    by = {}
    for (te, p), (_, q) in zip(full, base, strict=True):
        for h in (0, 1):
            at = (te.half == h).to_numpy()
            if at.sum() >= 100:
                by.setdefault(h, []).append(spearman(p[at], te.y[at]) - spearman(q[at], te.y[at]))
    found = {r.half: r.ic for r in stats.signal_ic(*args, by="half", embargo=100).collect()}
    assert found.keys() == {0, 1} and all(abs(found[h] - np.mean(v)) < 6e-4 for h, v in by.items())
    ok = pdf.dropna()
    own = stats.signal_ic(df, ["f", "c"], [], "y", ["t"], kind="control", own=True).first().ic
    assert abs(own - (spearman(ok.f, ok.y) + spearman(pdf.c, pdf.y)) / 2) < 6e-4
    strata = stats.signal_ic(df, ["f"], [], "y", ["t"], kind="control", own=True, level="lv", bins=4).first().ic
    cuts = np.quantile(ok.lv, [0.25, 0.5, 0.75])
    parts = [(spearman(x.f, x.y), len(x)) for _, x in ok.groupby(np.searchsorted(cuts, ok.lv, "right"))]
    assert abs(strata - np.average([p[0] for p in parts], weights=[p[1] for p in parts])) < 6e-4
    regimes = stats.signal_ic(df, ["f"], [], "y", ["t"], kind="control", own=True, level="lv", bins=4, by="half").collect()
    assert {r.half for r in regimes} == {0, 1}
    with pytest.raises(ValueError):
        stats.signal_ic(*args, kind="other")
    assert abs(stats.marginal_ic(*args, embargo=100).first()[0] - 0.0) > 0.1


def test_a_mirrored_walk_is_the_walk_over_reflected_rows(sample):
    pdf, df = sample
    two = pd.concat([pdf.assign(side=0), pdf.assign(side=1, f=-pdf.f, y=-pdf.y)]).sort_values(["t", "side"])[["f", "y"]]
    want = np.mean([spearman(p, te.y) for te, p in folds_of(two, ["f"], "y", 200)])
    got_ = stats.wf_ic(df.drop("c", "lv"), ["f"], "y", ["t"], embargo=100, mirror="odd").first()
    assert got_.folds == 5 and abs(got_.ic - want) < 1e-9
    with pytest.raises(ValueError):
        stats.wf_ic(df, ["f"], "y", ["t"], mirror="sideways")


def test_bootstrap_repeats_and_matches_a_plain_one(sample):
    pdf, df = sample
    test = stats.aligned(df, ["f"], ["c"], "y", ["t"], embargo=100)
    a, b = (stats.block_bootstrap(test, "full", "base", "y", ["t"], 50, draws=24, parts=p).first() for p in (2, 5))
    assert np.allclose(a, b, atol=1e-12) and a.lo < a.mean < a.hi
    folds = [x.sort_values("t") for _, x in test.toPandas().groupby("_seg")]
    means = []
    for draw in range(24):
        each = []
        for x in folds:
            n, fold = len(x), int(x._seg.iloc[0])
            at = np.concatenate([np.arange(50) + stats.block_start(0, draw, fold, j, n - 49) for j in range(-(-n // 50))])[:n]
            some = x.iloc[at]
            each.append(spearman(some.full, some.y) - spearman(some.base, some.y))
        means.append(np.mean(each))
    assert np.allclose(a, (np.percentile(means, 5), np.percentile(means, 95), np.mean(means)), atol=1e-9)
    assert len({stats.block_start(0, d, 1, 0, 1000) for d in range(200)}) > 150 and all(0 <= stats.block_start(1, d, 2, 3, 7) < 7 for d in range(100))


def test_interval_of_a_marginal(sample):
    _, df = sample
    r = stats.marginal_ci(df, ["f"], ["c"], "y", ["t"], embargo=100, draws=40).first()
    lag = stats.acf_lag(stats.aligned(df, ["f"], ["c"], "y", ["t"], embargo=100), "y", ["t"])
    assert r.pos == r.folds == 5 and r.lo < r.boot_mean < r.hi and r.lo < r["mean"] < r.hi
    assert r.block == stats.block_length(lag, 100, 490) and lag in (50, 100, 200, 500, 1000, 2000)


def test_memory_of_a_series(spark):
    r = np.random.default_rng(5)
    x = np.convolve(r.normal(size=4000), np.ones(120), "valid")
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(len(x)), "y": x}))
    z = x - x.mean()
    want = next((k for k in (50, 100, 200, 500, 1000, 2000) if abs((z[k:] * z[:-k]).sum() / (z * z).sum()) < 2 / len(x) ** 0.5), 10_000)
    assert stats.acf_lag(df, "y", ["t"]) == want > 50
    assert stats.acf_lag(df.limit(150), "y", ["t"]) == 50
    assert stats.block_length(100, 2000, 60_000) == 2000 and stats.block_length(500, 2000, 600_000) == 5000


@pytest.mark.parametrize("n", [1, 2, 9, 5000])
def test_quantiles_are_exact(spark, n, monkeypatch):
    r = np.random.default_rng(n)
    x = np.round(r.normal(size=n), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    p = [0, 0.05, 0.33, 0.5, 0.9, 1]
    for edges in (2, 32):
        monkeypatch.setattr(stats, "EDGES", edges)
        assert np.allclose(stats.quantiles(df, "v", p).first()[0], np.quantile(x, p), atol=1e-12)
    assert stats.quantiles(df.where("v is null"), "v", p).first()[0] is None
    keyed = df.where("v is not null").select(F.col("v"), (F.col("v") > 0).alias("k"))
    ranks = {(x.k, x.v): x.r for x in stats.average_ranks(keyed, "v", "r", ["k"]).collect()}
    own = pd.DataFrame({"v": x, "k": x > 0})
    own["r"] = own.groupby("k").v.rank()
    assert ranks == {(k, v): r for k, v, r in own[["k", "v", "r"]].itertuples(index=False)}


def test_a_second_span_and_joint_legs(sample):
    pdf, df = sample
    df = df.withColumns({"near": F.col("f") + 0.1 * F.col("lv"), "far": F.col("c") + 0.2 * F.col("f")})
    r = research.second_span_adds(df, "f", ["near", "far"], "y", 100).first()
    assert r.second == "far" and r.adds and r.joint > r.solo + 0.01
    alone = research.second_span_adds(df, "f", ["near"], "y", 100).first()
    assert alone.second == "near" and not alone.adds
    assert research.second_span_adds(df, "f", ["near", "far"], "y", 100, mirror="odd").first().second == "far"
    assert research.second_span_adds(df, "f", ["near", "far"], "y", 100, size=True).first().solo is not None
    with pytest.raises(ValueError):
        research.second_span_adds(df, "f", [], "y", 100)
    out = research.joint_adds(df, ["f", "c"], "y", 100).first()
    ones = {x: np.mean([spearman(p, te.y) for te, p in folds_of(pdf[["t", x, "y"]], [x], "y", 100)]) for x in ("f", "c")}
    both = np.mean([spearman(p, te.y) for te, p in folds_of(pdf[["t", "f", "c", "y"]], ["f", "c"], "y", 100)])
    assert out.best == max(ones, key=ones.get) and abs(out.single - max(ones.values())) < 1e-9 and abs(out.joint - both) < 1e-9 and out.adds


def test_shapes_and_verdicts(spark, sample):
    pdf, df = sample
    rep = {r.shape: r for r in stats.shaping(df, "f").collect()}
    x = pdf.f.dropna()
    assert rep["raw"].n == len(x) and abs(rep["raw"].std - x.std(ddof=0)) < 1e-9 and abs(rep["raw"].skew - ((x - x.mean()) ** 3).mean() / x.std(ddof=0) ** 3) < 1e-9
    with pytest.raises(ValueError):
        stats.shaping(df.where("f is null"), "f")
    assert abs(rep["z-score"].max_abs - ((x - x.mean()) / x.std(ddof=0)).abs().max()) < 1e-9 and rep["robust+clip"].max_abs <= 4
    p = spark.createDataFrame([(0.975,), (0.5,), (0.001,)], "p double").select(stats.normal_quantile(F.col("p"))).collect()
    assert np.abs(np.array([r[0] for r in p]) - [1.959963984540054, 0.0, -3.090232306167813]).max() < 1e-8
    ics = spark.createDataFrame([("f", k, v) for k, v in enumerate([0.3, 0.25, 0.28, 0.31])] + [("g", k, v) for k, v in enumerate([0.3, -0.2, 0.1, 0.02])], "feature string, block int, ic double").withColumn("leg", F.lit("x"))
    assert rows(oos.report(ics), "feature", "verdict") == [("f", "PERSISTS"), ("g", "FADES")]
    e = spark.createDataFrame([(0.3, 0.2), (0.3, 0.05), (0.3, 0.0), (0.3, -0.2)], "raw double, net double").select(stats.echo_verdict()).collect()
    assert [r[0] for r in e] == ["PERSISTS", "SHRINKS", "COLLAPSES", "COLLAPSES"]
    assert "| f |" in research.markdown(oos.report(ics))


def test_reports_over_a_market(spark, data, tmp_path):
    y = research.price_target(data, HOUR)
    grid = [(5,), (20,)]
    best = oos.best_spans(data, "trade_flow_imbalance", grid, y, "price_target")
    assert set(best) <= set(src.LISTINGS) and set(best.values()) <= {"5", "20"}
    values = oos.readings(data, {"m_flow_imbalance": (5,), "m_ofi": (5, 20)})
    ics = oos.sweep(values, y, "price_target", F.lit(0), research.trailing_outcome(data, HOUR))
    assert {"feature", "leg", "block", "ic", "netted"} <= set(ics.columns) and ics.count() == 6
    oos.append_matrix(ics, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 6
    rep = research.gate_report(data, "trade_flow_imbalance", (5,), y, "price_target", 10)
    assert set(rep) == {"joint", "scale", "track", "mag", "disp", "passes"}
    bars = {"scale": 3.0, "track": 0.05, "mag": 0.1, "disp": 0.1}
    assert rep["passes"] == (rep["joint"] is not None and rep["joint"] >= 0.01 and all(rep[k] is not None and rep[k] <= b for k, b in bars.items()))
    best = {x.listing: x for x in features.best_variants(data, (5, 20), y, "price_target").collect()}
    assert set(best) == set(src.LISTINGS) and all(b.variant in features.VARIANTS and b.span in (5, 20) for b in best.values())
    legs = features.ofi_best(data, (5, 20), y, "price_target")
    b = best["okx"]
    assert rows(legs.where("listing = 'okx'"), "t", "value") == rows(features.get("m_ofi_normalised").build(data, b.span, b.variant).where("listing = 'okx'"), "t", "value")
    ruled, plain = (features.get("m_price_momentum").build(data, 5, n) for n in (None, features.too_spread(data)))
    assert rows(ruled, "listing", "t", "value") == rows(plain, "listing", "t", "value")


def test_a_block_that_fails_does_not_stop_the_sweep(spark, tmp_path):
    good = lambda: spark.createDataFrame([("f", "byb", 0.1)], "feature string, leg string, ic double")

    def bad():
        raise FileNotFoundError("no trade of byb in h.2")

    assert oos.sweep_blocks(spark, {1: good, 2: bad, 3: good}, str(tmp_path / "m")) == [2]
    kept = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert sorted((int(r.block), r.feature, r.ic) for r in kept.collect()) == [(1, "f", "0.1"), (2, None, None), (3, "f", "0.1")]


def test_sessions_carry_a_tail(spark, tmp_path):
    """Averages of a block seeded with the kept tail of the one before are those of the whole stretch."""
    r = random.Random(1)
    b = book_of(spark, [("a", k, 10 * k, 100 + r.random(), 1.0, 101 + r.random(), 2.0) for k in range(400)])
    t = trade_of(spark, [("a", 1000 + k, 7 * k, "Bid", 100.0, 1.0 + k % 3) for k in range(400)])
    whole = session.Session(b, t)
    first, second = session.cut(whole, 0, 2000), session.cut(whole, 2000, 10_000)
    assert (first.book.count(), second.book.count()) == (200, 200) and first.trade.where("rx >= 2000").count() == 0
    session.save(session.tail(first, 1500, 2000), str(tmp_path / "tail"))
    carried = session.load(spark, str(tmp_path / "tail"))
    assert carried.book.agg(F.min("rx"), F.max("rx")).first() == (500, 1990)
    assert session.tail(whole, 10).book.count() == 1 and session.tail(session.cut(whole, 0, 0), 10).book.count() == 0
    step = lambda s: {x.rx: x.ofi for x in ev.ofi_endpoint(s.book).where("rx >= 2000").collect()}
    assert step(session.concat([carried, second])) == step(whole)
    grid = spark.range(0, 4000, 50).select(F.col("id").alias("t"))
    hit = rows(align.with_event(grid, whole.trade.where("rx < 1000"), 50), "t")
    assert hit == [(x,) for x in range(0, 1000, 50)]


def test_spans_and_scores_are_kept(spark, tmp_path):
    oos.save_spans(spark, {"ofi": {"byb": "20/60"}}, str(tmp_path / "s"))
    assert oos.load_spans(spark, str(tmp_path / "s")) == {"ofi": {"byb": "20/60"}}


# sources


def test_block_files(spark, tmp_path):
    for n in ("h.1.0.byb_eth.trade", "h.1.0.byb_eth.front_levels", "h.2.0.byb_eth.trade"):
        spark.range(3).toPandas().to_parquet(tmp_path / f"{n}.parquet")
    s = src.Settings(data_dir=str(tmp_path), no_merged=frozenset({"bin_eth_p"}))
    assert src.list_blocks(spark, s, "byb_eth", "trade") == ["h.1.0", "h.2.0"]
    assert src.list_blocks(spark, s, "byb_eth", "merged_levels") == ["h.1.0"] and src.list_blocks(spark, s, "bin_eth_p", "merged_levels") == []
    assert src.load_block(spark, s, "h.1.0", "byb_eth", "trade").count() == 3
    with pytest.raises(FileNotFoundError):
        src.load_block(spark, s, "h.9.0", "byb_eth", "trade")
    with pytest.raises(ValueError):
        src.require_merged(s, "bin_eth_p")
    made = []
    for _ in range(2):
        assert src.lazily(spark, str(tmp_path / "built"), lambda: made.append(1) or spark.range(5)).count() == 5
    assert made == [1]


def test_live_book_unparts_crossed_quotes():
    assert live.uncrossed(2.0, 1.0, 5, 5, 0.1) == (0.9, 1.0) and live.uncrossed(2.0, 1.0, 6, 5, 0.1) == (2.0, 2.1) and live.uncrossed(1.0, 2.0, 1, 1, 0.1) == (1.0, 2.0)
    b = live.LiveBook(0.1)
    b.trade(50, 1.9, True)
    assert b.top() is None
    b.quote(100, 1.0, 2.0)
    b.trade(90, 1.5, True)
    assert b.top() == (1.0, 2.0)
    b.trade(100, 1.7, True)
    assert b.top() == (1.0, 1.7)


def test_every_query_has_an_oracle_or_says_why():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert {n for n in q if n not in sql and not n.startswith("op") and n != "pipeline"} == set()


def test_stream_equals_batch(spark):
    out = entry.queries()["n_stream_parity"](spark, DATA).collect()
    assert len(out) == 9 and all(r.n == r.same > 0 for r in out)


def test_a_stream_sends_values_in_bounded_frames():
    """A batch of many events, in frames out of order: values leave some times at a time, and are those of one event after the other."""
    kept = SimpleNamespace(exists=False, update=lambda x: kept.__dict__.update(exists=True, get=x))
    grouped = SimpleNamespace(applyInPandasWithState=lambda run, *_: run)
    run = sq.live(SimpleNamespace(groupBy=lambda *_: grouped), ("byb", "bin", "okx"), "byb", 3, 9, 5)
    r = np.random.default_rng(2)
    n = 5000
    e = pd.DataFrame({"market": "all", "listing": r.choice(["byb", "bin", "okx"], n), "seq": np.arange(n), "rx": np.sort(r.integers(0, 4 * n, n)), "kind": r.integers(0, 2, n).astype(np.int32)})
    e = e.assign(a=100 + r.normal(0, 1, n), b=r.integers(1, 9, n) * 1.0, c=np.where(e.kind == 0, 105.0, r.integers(0, 2, n)), d=2.0)
    mixed = e.sample(frac=1, random_state=1)
    got = list(run(("all",), iter([mixed[:1700], mixed[1700:]]), kept))
    one, want = live.LiveFeatures(("byb", "bin", "okx"), "byb", 3, 9, 5), []
    for x in e.sort_values(["rx", "kind", "seq"]).itertuples():
        done = one.push(x.rx, x.kind, x.listing, x.a, x.b, x.c, x.d)
        want += [("all", f, y, done[0], v) for (f, y), v in done[1].items()] if done else []
    pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), pd.DataFrame(want, columns=list(got[0].columns)).astype({"value": float}))
    assert max(map(len, got)) <= 26 * 1000 and pickle.loads(kept.get[0]).rx == e.rx.max()


def test_a_streams_columns_are_its_values():
    """A row for each listing and time, with a column of each feature, holds what the rows of single values hold."""
    grouped = SimpleNamespace(groupBy=lambda *_: SimpleNamespace(applyInPandasWithState=lambda run, *_: run))
    args = grouped, ("byb", "bin", "okx"), "byb", 3, 9, 5
    r = np.random.default_rng(4)
    n = 2500
    e = pd.DataFrame({"market": "all", "listing": r.choice(["byb", "bin", "okx"], n), "seq": np.arange(n), "rx": np.sort(r.integers(0, 4 * n, n)), "kind": r.integers(0, 2, n).astype(np.int32)})
    e = e.assign(a=100 + r.normal(0, 1, n), b=r.integers(1, 9, n) * 1.0, c=np.where(e.kind == 0, 105.0, r.integers(0, 2, n)), d=2.0)
    state = SimpleNamespace(exists=False, update=lambda _: None)
    frames = list(sq.live_columns(*args)(("all",), iter([e]), state))
    one = pd.concat(frames).set_index(["market", "listing", "t"]).rename_axis("feature", axis=1).stack(future_stack=True)
    want = pd.concat(sq.live(*args)(("all",), iter([e]), state)).set_index(["market", "listing", "t", "feature"])["value"]
    assert len(one) == 27 * len(want) // 26 and one.drop(want.index).isna().all()  # the target has no dislocation against itself
    pd.testing.assert_series_equal(one.loc[want.index], want, check_names=False)
    assert max(map(len, frames)) <= 3 * 1000


@pytest.mark.parametrize("span", [1, 3, 40])
def test_means_hold_events_between_far_reads(spark, span):
    """A mean is that of the last event, also where it came and decayed to nothing between two reads."""
    ticks = range(10, 40_000, 10)
    clock = spark.createDataFrame([(t, n) for n, t in enumerate(ticks, 1)], "rx long, n long")
    events = [(4, 1.0), (7, 2.0), (10, 4.0), (13, 0.5), (15_003, 8.0), (15_003, 6.0), (15_011, -1.0)]
    reads = [3, 9, 12, 30, 15_000, 39_000]
    mk = Market(None, None, ("a",), "a", spark.createDataFrame([(t,) for t in reads], "t long"))
    mk.__dict__["clock"] = clock
    e = spark.createDataFrame([("a", t, v) for t, v in events], "listing string, rx long, v double")
    got = {x.t: x.value for x in mk.flow_mean(e, F.col("v"), span).collect()}
    flow, want = live.Flow(span), {}
    for t in range(39_001):
        for _, v in (x for x in events if x[0] == t):
            flow.add(v)
            flow.mean()  # not later, as sums that decay below 1e-308 lose their digits
        if t in ticks:
            flow.tick()
        if t in reads:
            want[t] = flow.last
    assert got[3] is None is want[3] and max(abs(got[t] - want[t]) for t in reads[1:]) < 1e-12


def test_a_feed_is_cut_into_files_of_bounded_size(spark, tmp_path):
    e = spark.range(2000).selectExpr("'all' AS market", "'byb' AS listing", "id AS seq", "id DIV 3 AS rx", "0 AS kind", *(f"1D AS {x}" for x in "abcd")).repartition(3)
    at = sq.in_files(e, str(tmp_path), 300)
    files = sorted(Path(at).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    rx = [pd.read_parquet(p).rx for p in files]
    assert len(files) == 7 and max(map(len, rx)) < 320 and sum(map(len, rx)) == 2000
    assert all(a.max() < b.min() for a, b in zip(rx, rx[1:], strict=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["listing", "t", "value"]
