import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest as bt
from tickloom.operators import screen as scr
from tickloom.operators import risk as rk


def trades(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [("s" if i % 5 else "t", i // 7, i, round(rng.uniform(-3, 3), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "strategy string, day int, rank int, net double")


def test_two_level_curve_matches_loop(spark):
    rows, df = trades(spark)
    got = {(r.strategy, r["rank"]): r for r in bt.equity_curve(df, ["strategy"], "day", ["rank"]).collect()}
    for s in ("s", "t"):
        cum = peak = 0.0
        best, i = None, 0
        for _, _, rank, net in [r for r in rows if r[0] == s]:
            cum += net
            peak = max(peak, cum)
            best = cum if best is None else max(best, cum)
            r = got[(s, rank)]
            assert r.cumulative == pytest.approx(cum) and r.peak == pytest.approx(peak) and r.best == pytest.approx(best) and r.idx == i
            i += 1


def test_drawdown_episodes_match_loop(spark):
    rows, df = trades(spark, seed=8)
    ep = bt.drawdown_episodes(bt.equity_curve(df, ["strategy"], "day", ["rank"]), ["strategy"], "day", ["rank"]).where("strategy = 's'").orderBy("peak_idx").collect()
    curve, c = [], 0.0
    for r in rows:
        if r[0] == "s":
            c += r[3]
            curve.append(round(c, 2))
    want, peak, pi, trough = [], curve[0], 0, None
    for i, v in enumerate(curve[1:], 1):
        if v >= peak:
            if trough:
                want.append((pi, trough[1], i))
            peak, pi, trough = v, i, None
        elif trough is None or v < trough[0]:
            trough = (v, i)
    if trough:
        want.append((pi, trough[1], None))
    assert [(e.peak_idx, e.trough_idx, e.recovery_idx) for e in ep] == want


def test_exit_simulation(spark):
    d0 = dt.date(2024, 1, 1)
    px = [100, 99, 94, 120, 100]
    bars = spark.createDataFrame([(i, d0 + dt.timedelta(days=k), k + 1, 5, float(p * (1 if i == 1 else 1 + 0.001 * k)), 10.0 if (i, k) == (3, 2) else None, 0.0) for i in (1, 2, 3) for k, p in enumerate(px)],
                                 "instrument long, date date, ord int, n_bars int, price double, cash_div double, stock_div double")
    tr = spark.createDataFrame([(1, 1, 95.0, 110.0), (2, 1, 80.0, 119.0), (3, 1, 95.0, 200.0)], "instrument long, entry_ord int, stop_loss double, take_profit double")
    out = {r.instrument: r for r in bt.simulate_exits(tr, bt.price_path(bars)).collect()}
    assert (out[1].exit_reason, out[1].exit_price, out[1].exit_date.day) == ("stop_loss", 95.0, 3)
    assert (out[2].exit_reason, out[2].exit_price) == ("take_profit", 119.0)
    assert out[3].exit_reason == "max_holding_days" and out[3].exit_date.day == 5  # the ex-date drop is added back
    fast = {r.instrument: r for r in bt.simulate_exits(tr, bt.price_path(bars), max_days=1).collect()}
    assert fast[2].exit_reason == "max_holding_days" and fast[2].exit_date.day == 2


def test_position_sizing_caps(spark):
    c = spark.createDataFrame([("m", i, "x" if i < 4 else "y", 100.0 - i, 1.0) for i in range(6)], "month string, instrument long, sector string, strength double, regime_mult double")
    out = {r.instrument: r.allocation_pct for r in bt.size_positions(c, "month", max_positions=6, sector_cap=0.07).collect()}
    assert out[0] == 3.0 and out[1] == 2.97 and out[2] == pytest.approx(1.03) and 3 not in out
    assert out[4] == 2.88


def test_halving_order(spark):
    h = spark.createDataFrame([("p", 1, 4.0), ("p", 2, 6.0), ("p", 3, 3.0)], "portfolio string, instrument long, allocation_pct double")
    pairs = spark.createDataFrame([("p", 1, 2, 0.9, True), ("p", 1, 3, 0.9, True), ("p", 2, 3, 0.1, False)], "portfolio string, a long, b long, correlation double, flagged boolean")
    out = {r.instrument: r.adjusted_pct for r in bt.halve_correlated(h, pairs, "portfolio").collect()}
    assert out == {1: 1.0, 2: 6.0, 3: 3.0}


def test_weight_smoothing_sums_to_one(spark):
    w = spark.createDataFrame([("g", k, p, n) for k, p, n in (("a", 0.5, 0.1), ("b", 0.3, 0.3), ("c", 0.2, 0.6), ("d", None, 0.2))], "g string, k string, prev double, new double")
    out = {r.k: r.weight for r in scr.smooth_weights(w, "g").collect()}
    assert sum(out.values()) == pytest.approx(1.0) and out["a"] > out["b"]


def test_value_at_risk_rank(spark):
    rng = random.Random(4)
    rets = [rng.gauss(0, 0.02) for _ in range(60)]
    hr = spark.createDataFrame([("p", 1, k, r, 1.0) for k, r in enumerate(rets)], "portfolio string, instrument long, k int, ret double, weight double")
    tot = spark.createDataFrame([("p", 1000.0), ("q", 10.0)], "portfolio string, total_value double")
    out = {r.portfolio: r for r in rk.value_at_risk(hr, tot).collect()}
    assert out["p"].var_pct == pytest.approx(abs(sorted(rets)[int(60 * (1 - 0.95))]), abs=1e-4)
    assert out["q"].method == "fallback_estimate" and out["q"].var_amount == 0.35


def test_scenarios_respect_cap(spark):
    h = spark.createDataFrame([("p", i) for i in range(8)], "portfolio string, instrument long")
    s = rk.scenario_weights(h, "portfolio", 20, cap=0.2).groupBy("scenario").agg(F.sum("weight").alias("t"), F.max("weight").alias("m")).collect()
    assert all(abs(r.t - 1) < 1e-9 and r.m <= 0.2 + 1e-9 for r in s)


def test_exits_shuffle_bars_and_trades_once_and_match_a_walk_over_the_bars(spark):
    rng, day = random.Random(3), dt.date(2024, 1, 1)
    bars, trades = [], []
    for i in range(1, 5):
        for o in range(1, 61):
            ex = rng.random() < 0.1
            bars.append((i, day + dt.timedelta(days=o + i), o, 60, round(20 + rng.random(), 4), 0.3 if ex else None, 0.1 if ex else None))
        trades += [(i, o, 20.0 + rng.choice((-1, 0.03)), 21.0 - rng.choice((-1, 0.03))) for o in (1, 7, 30, 45, 59, 60)]
    open_days = {b[1] for b in bars if b[1].weekday() < 5}
    tr = spark.createDataFrame(trades + [(1, 61, 1.0, 99.0)], "instrument long, entry_ord long, stop_loss double, take_profit double")
    df = spark.createDataFrame(bars, "instrument long, date date, ord long, n_bars long, price double, cash_div double, stock_div double")
    out = bt.simulate_exits(tr, bt.price_path(df, spark.createDataFrame([(d,) for d in open_days], "date date")), max_days=10)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(instrument") <= 2

    def walk(i, entry, stop, target):
        mine, held = [b for b in bars if b[0] == i], 0
        for _, d, _, _, price, cash, stock in mine[entry:]:
            if d in open_days:
                held, p = held + 1, price if cash is None else (price + cash) * (1 + stock / 10)
                if p <= stop:
                    return stop, "stop_loss", d
                if p >= target:
                    return target, "take_profit", d
                if held >= 10 and cash is None:
                    return price, "max_holding_days", d
        last = mine[min(entry + 10, 60) - 1]
        return last[4], "max_holding_days", last[1]

    got = {(r.instrument, r.entry_ord): (r.exit_price, r.exit_reason, r.exit_date) for r in out.collect()}
    assert got == {t[:2]: walk(*t) for t in trades} and len({v[1] for v in got.values()}) == 3


def test_weight_search_shuffles_signals_and_no_pairs(spark):
    rng, dims = random.Random(5), ("a", "b")
    rows = [(m, i, float(rng.randrange(101)), float(rng.randrange(101)), round(rng.uniform(-3, 3), 2)) for m in range(6) for i in range(0, 4000, 37)]
    df = spark.createDataFrame(rows, "month int, instrument long, a double, b double, net_pnl_pct double").withColumn("win", F.col("net_pnl_pct") > 0).withColumn("stop_type", F.lit("atr"))
    out = bt.weight_search(df, dims, "month", ["instrument"], n=12, split="instrument")
    got = {r.scenario: (r.total_trades, r.max_drawdown) for r in out.collect()}
    for s in range(12):
        w, cum, peak, dd, k = bt.scenario_vector(s, 2), 0.0, 0.0, 0.0, 0
        for _, _, a, b, pnl in rows:
            if a * w[0] + b * w[1] >= 55:
                cum, k = cum + pnl, k + 1
                peak = max(peak, cum)
                dd = max(dd, peak - cum)
        assert got[s] == (k, pytest.approx(round(dd, 2)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_windows_of_a_walk_forward_share_the_results_of_a_date(spark):
    rng, day = random.Random(9), dt.date(2024, 1, 1)
    days = [day + dt.timedelta(days=i) for i in range(70)]
    rows = []
    for d in days[3::7]:
        for i in sorted(rng.sample(range(0, 6000, 7), 40)):
            pnl = 0.1 if d == days[3] else round(rng.uniform(-3, 3), 2)  # the first window holds equal values alone
            rows.append((d, i, pnl, pnl > 0, rng.choice(("atr", "fallback_pct"))))
    df = spark.createDataFrame(rows, "date date, instrument long, net_pnl_pct double, win boolean, stop_type string")
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    out = bt.chunk_performance(bt.walk_forward(bt.chunk_results(df, [], "date", "instrument"), dates, "date", train=6, test=5), ["window"], "date")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(window#[^)]*instrument#", plan)  # trades are not repeated per window
    old = bt.performance(bt.equity_curve(bt.walk_forward(df, dates, "date", train=6, test=5), ["window"], "date", ["instrument"], "net_pnl_pct"), ["window"])
    assert {r.window: r for r in out.collect()} == {r.window: r for r in old.collect()}
    got = {r.window: r for r in out.collect()}
    assert len(got) > 5
    for w in got:
        cum = peak = dd = 0.0
        mine = [r for r in rows if days[5 * w] <= r[0] <= days[5 * w + 5]]
        for r in mine:
            cum += r[2]
            peak = max(peak, cum)
            dd = max(dd, peak - cum)
        assert (got[w].total_trades, got[w].max_drawdown, got[w].atr_stops) == (len(mine), pytest.approx(dd, abs=0.006), sum(r[4] == "atr" for r in mine))
    assert got[0].sharpe_ratio == 0.0


def test_walk_forward_summary_joins_the_windows_and_nothing_else(spark):
    from tickloom.plans import load_all

    out = load_all().QUERIES["K16_walk_forward_summary"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
