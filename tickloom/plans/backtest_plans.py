"""Trade simulation and backtest queries (section K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import params
from tickloom.functions.typing import dbl, rnd, round_trip_cost
from tickloom.operators import backtest as bt
from tickloom.operators import calendar as cal
from tickloom.operators import indicators as ind
from tickloom.plans.panel_plans import trades as order_trades
from tickloom.plans.registry import query
from tickloom.sources.sql_views import VIEWS

CODE_SQL = "lpad(CAST(instrument * 83 % 10000 AS VARCHAR), 4, '0')"
COST_SQL = f"CASE WHEN CAST({CODE_SQL} AS INT) >= 9900 OR CAST({CODE_SQL} AS INT) BETWEEN 6000 AND 7999 THEN 0.007e0 ELSE 0.006e0 END"

# Monthly candidates: every instrument's latest bar of the month with its trailing return as the score.
VIEWS["v_cand"] = """
SELECT c.month, m.date, c.instrument, c.ord AS entry_ord, c.entry_price, c.score, c.atr, c.momentum, s.sector, coalesce(k.date - k.prev_trading <= 20 AND k.date - k.prev_trading > 3, false) AS post_holiday,
  CASE WHEN k.date - k.prev_trading <= 20 THEN k.date - k.prev_trading ELSE 0 END AS gap_days,
  CASE CAST(month(m.date) % 3 AS INT) WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.6e0 ELSE 0.3e0 END AS regime_mult
FROM (SELECT r.instrument, r.ord, r.date, date_trunc('month', r.date)::DATE AS month, r.adj_close AS entry_price, r.adj_close / lag(r.adj_close, 19) OVER (PARTITION BY r.instrument ORDER BY r.date) - 1.0e0 AS score, a.atr, q.momentum
      FROM v_rank r JOIN v_atr a ON a.instrument = r.instrument AND a.date = r.date JOIN v_mom q ON q.instrument = r.instrument AND q.date = r.date
      QUALIFY row_number() OVER (PARTITION BY r.instrument, date_trunc('month', r.date) ORDER BY r.date DESC) = 1) c
JOIN (SELECT date_trunc('month', date)::DATE AS month, max(date) AS date FROM v_days GROUP BY 1) m ON m.month = c.month
JOIN v_sectors s ON s.instrument = c.instrument JOIN v_cal k ON k.date = m.date WHERE c.ord >= 20"""
VIEWS["v_sel"] = """
SELECT *, round(entry_price + (entry_price - stop_loss) * 2, 2) AS take_profit, CASE WHEN atr > 0 THEN 'atr' ELSE 'fixed_pct' END AS stop_type FROM (
 SELECT *, round(CASE WHEN atr > 0 THEN least(entry_price - atr * am - atr * 0.5e0, entry_price * 0.98e0) ELSE entry_price * (1 + -0.03e0) END, 2) AS stop_loss FROM (
  SELECT *, CASE WHEN post_holiday AND gap_days >= 4 THEN 3.25e0 ELSE 2.5e0 END AS am, row_number() OVER (PARTITION BY month, sector ORDER BY score DESC, instrument) AS sr FROM (
   SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, instrument) AS rank FROM v_cand) WHERE rank <= floor(regime_mult * 8) AND entry_price > 0) WHERE sr <= 3)"""
VIEWS["v_tb"] = """
SELECT instrument, date, adj_close AS price, cash_div, stock_div, cash_div IS NOT NULL AS is_ex, row_number() OVER (PARTITION BY instrument ORDER BY date) AS t
FROM v_rank WHERE date IN (SELECT date FROM v_cal WHERE is_trading)"""
VIEWS["v_tn"] = """
SELECT instrument, ord, sum(CASE WHEN date IN (SELECT date FROM v_cal WHERE is_trading) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY date) AS entry_t FROM v_rank"""
VIEWS["v_hits"] = """
SELECT s.month, s.instrument, b.t, b.date, CASE WHEN p <= stop_loss THEN 'stop_loss' WHEN p >= take_profit THEN 'take_profit' WHEN NOT is_ex AND b.t - s.entry_t >= 20 THEN 'max_holding_days' END AS reason,
  CASE WHEN p <= stop_loss THEN stop_loss WHEN p >= take_profit THEN take_profit ELSE b.price END AS exit_price
FROM (SELECT v.*, n.entry_t FROM v_sel v JOIN v_tn n ON n.instrument = v.instrument AND n.ord = v.entry_ord) s
JOIN (SELECT *, CASE WHEN is_ex THEN (price + cash_div) * (1.0e0 + stock_div / 10.0e0) ELSE price END AS p FROM v_tb) b ON b.instrument = s.instrument AND b.t > s.entry_t"""
VIEWS["v_exits"] = """
SELECT s.*, coalesce(h.exit_price, f.adj_close) AS exit_price, coalesce(h.reason, 'max_holding_days') AS exit_reason, coalesce(h.date, f.date) AS exit_date
FROM v_sel s LEFT JOIN (SELECT * FROM v_hits WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY month, instrument ORDER BY t) = 1) h ON h.month = s.month AND h.instrument = s.instrument
LEFT JOIN v_rank f ON f.instrument = s.instrument AND f.ord = least(s.entry_ord + 20, f.n_bars)"""
VIEWS["v_bt"] = f"""
SELECT x.*, ((exit_price - entry_price) / entry_price - {COST_SQL}) * 100 AS net, round(((exit_price - entry_price) / entry_price - {COST_SQL}) * 100, 2) AS pnl_pct,
  (SELECT count(*) FROM v_cal c WHERE c.is_trading AND c.date BETWEEN x.date AND x.exit_date) AS holding_days, 'main' AS strategy FROM v_exits x"""
VIEWS["v_curve"] = """
SELECT *, greatest(0.0e0, max(cumulative) OVER (ORDER BY date, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak, row_number() OVER (ORDER BY date, rank) - 1 AS idx
FROM (SELECT *, sum(net) OVER (ORDER BY date, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM v_bt)"""


#: what the stored tables of this section are built from
SOURCES = ("lineitem", "supplier", "nation", "region")


def code():
    return F.lpad((F.col("instrument") * 83 % 10000).cast("string"), 4, "0")


def candidates(t):
    w = Window.partitionBy("instrument").orderBy("date")
    base = ind.momentum(ind.with_atr(t.series)).withColumn("score", F.col("adj_close") / F.lag("adj_close", 19).over(w) - 1.0)
    month, after = F.trunc("date", "month"), F.lead("date").over(w)
    # the last bar of a month is the one followed by another month: a filter, not an aggregate
    last = base.withColumn("_last", after.isNull() | (F.trunc(after, "month") != month)).where(F.col("_last") & (F.col("ord") >= 20))
    ends = t.days.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))
    flags = cal.post_holiday(t.trading_calendar)
    mult = F.when(F.month("date") % 3 == 0, 1.0).when(F.month("date") % 3 == 1, 0.6).otherwise(0.3)
    # months and dates are bounded by the calendar; broadcast, they leave the rows dealt by instrument, as the bars are
    return (
        last.select("instrument", month.alias("month"), F.col("ord").alias("entry_ord"), F.col("adj_close").alias("entry_price"), "score", "atr", "momentum")
        .join(F.broadcast(ends), "month").join(F.broadcast(flags), "date").join(t.sectors, "instrument").withColumn("regime_mult", mult)
    )


def entries(t):
    return bt.select_entries(candidates(t), "month")


def path(t):
    bars = t.series.select("instrument", "date", "ord", "n_bars", F.col("adj_close").alias("price"), "cash_div", "stock_div")
    return bt.price_path(bars, t.trading_calendar.where("is_trading"))


def closed(t):
    tr = entries(t).select("month", "date", "rank", "instrument", "sector", "entry_ord", "entry_price", "stop_loss", "take_profit", "stop_type", "score")
    return bt.simulate_exits(t.deal(tr, "instrument"), path(t))


def results(t):
    """The ledger: small (positions per date), read by several scans and queries."""
    def build():
        net = bt.net_pnl(F.col("entry_price"), F.col("exit_price"), round_trip_cost(code()))
        x = cal.count_trading_days(closed(t), t.trading_calendar, "date", "exit_date", "holding_days")
        return x.withColumn("net", net).withColumn("pnl_pct", rnd("net", 2)).withColumn("strategy", F.lit("main"))

    return t.shared("ledger", SOURCES, build)


def curve(t):
    return bt.equity_curve(results(t), ["strategy"], "date", ["rank"])


@query("K1_entry_selection", """
SELECT month, instrument, sector, rank, round(entry_price, 4) AS entry_price, stop_loss, take_profit, stop_type FROM v_sel""")
def _(t):
    return entries(t).select("month", "instrument", "sector", F.col("rank").cast("long").alias("rank"), rnd("entry_price", 4).alias("entry_price"), "stop_loss", "take_profit", "stop_type")


@query("K2_exit_simulation", "SELECT month, instrument, round(exit_price, 4) AS exit_price, exit_date, exit_reason FROM v_exits")
def _(t):
    return closed(t).select("month", "instrument", rnd("exit_price", 4).alias("exit_price"), "exit_date", "exit_reason")


@query("K3_exit_step", f"""
SELECT instrument, date, CASE WHEN close <= stop THEN 'stop_loss' WHEN close >= target THEN 'take_profit' WHEN held >= 20 THEN 'max_holding_days' END AS exit_reason,
  round(((CASE WHEN close <= stop THEN stop WHEN close >= target THEN target WHEN held >= 20 THEN close END - entry) / entry - {COST_SQL}) * 100, 2) AS pnl_pct
FROM (SELECT *, entry * 0.97e0 AS stop, entry * 1.06e0 AS target FROM (SELECT instrument, date, close, lag(close, 3) OVER w AS entry, date - lag(date, 3) OVER w AS held FROM v_bars WINDOW w AS (PARTITION BY instrument ORDER BY date)) WHERE entry IS NOT NULL)""")
def _(t):
    w = Window.partitionBy("instrument").orderBy("date")
    x = t.bars.select("instrument", "date", "close", F.lag("close", 3).over(w).alias("entry"), F.datediff("date", F.lag("date", 3).over(w)).alias("held")).where("entry is not null")
    e = bt.exit_step(F.col("close"), F.col("entry") * 0.97, F.col("entry") * 1.06, F.col("held"))
    x = x.withColumn("e", e)
    return x.select("instrument", "date", "e.exit_reason", rnd(bt.net_pnl(F.col("entry"), F.col("e.exit_price"), round_trip_cost(code())), 2).alias("pnl_pct"))


SUMMARY = """count(*) AS total_trades, count(*) FILTER (WHERE net > 0) AS winning_trades, count(*) FILTER (WHERE net <= 0) AS losing_trades, round(count(*) FILTER (WHERE net > 0) * 1.0e0 / count(*) * 100, 1) AS win_rate,
 round(sum(net) / count(*), 2) AS avg_pnl_pct, round(sum(net), 2) AS total_pnl_pct, round(greatest(max(peak - cumulative), 0), 2) AS max_drawdown, round(avg(holding_days), 1) AS avg_holding_days"""


@query("K4_equity_curve", "SELECT idx, month, instrument, round(cumulative, 2) AS cumulative, round(peak, 2) AS peak, round(peak - cumulative, 2) AS drawdown FROM v_curve")
def _(t):
    return curve(t).select("idx", "month", "instrument", *[rnd(c, 2).alias(c) for c in ("cumulative", "peak", "drawdown")])


@query("K4_backtest_summary", f"SELECT strategy, {SUMMARY} FROM v_curve GROUP BY strategy")
def _(t):
    return bt.backtest_summary(curve(t), ["strategy"])


@query("K5_survivorship_haircut", f"""
SELECT strategy, round(avg_pnl_pct * 0.88e0, 2) AS avg_pnl_pct_adj, round(greatest(0, win_rate * 0.92e0), 1) AS win_rate_adj, round(total_pnl_pct * 0.88e0, 2) AS total_pnl_pct_adj
FROM (SELECT strategy, {SUMMARY} FROM v_curve GROUP BY strategy)""")
def _(t):
    return bt.survivorship_haircut(bt.backtest_summary(curve(t), ["strategy"])).select("strategy", "avg_pnl_pct_adj", "win_rate_adj", "total_pnl_pct_adj")


VIEWS["v_period"] = """
SELECT date, CAST(least(floor((row_number() OVER (ORDER BY date) - 1) / greatest(floor(count(*) OVER () / 3), 1)), 2) AS INT) AS period FROM (SELECT DISTINCT date FROM v_bt)"""
VIEWS["v_pcurve"] = """
SELECT *, greatest(0.0e0, max(cumulative) OVER (PARTITION BY period ORDER BY date, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak
FROM (SELECT b.*, p.period, sum(net) OVER (PARTITION BY p.period ORDER BY b.date, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM v_bt b JOIN v_period p ON p.date = b.date)"""
VIEWS["v_psum"] = f"SELECT period, min(date) AS start_date, max(date) AS end_date, {SUMMARY} FROM v_pcurve GROUP BY period"


def period_summaries(t):
    r = results(t)
    x = r.join(bt.period_of(r, "date", 3), "date")
    c = bt.equity_curve(x, ["period"], "date", ["rank"])
    return bt.backtest_summary(c, ["period"]).join(c.groupBy("period").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date")), "period")


@query("K6_multi_period", "SELECT period, start_date, end_date, total_trades, win_rate, avg_pnl_pct, max_drawdown, avg_holding_days FROM v_psum")
def _(t):
    return period_summaries(t).select("period", "start_date", "end_date", "total_trades", "win_rate", "avg_pnl_pct", "max_drawdown", "avg_holding_days")


@query("K6_period_consistency", """
SELECT CAST(total_trades AS BIGINT) AS total_trades, win_rate, avg_pnl_pct, avg_holding_days, round(ws, 1) AS win_rate_std, round(ps, 2) AS avg_pnl_std, mn > 0 AS all_periods_profitable,
  least(100.0e0, round(greatest(0, (1.0e0 - least(1.0e0, ws / 20.0e0) * 0.5e0 - least(1.0e0, ps / 5.0e0) * 0.5e0) * 100 * CASE WHEN mn > 0 THEN 1.2e0 ELSE 0.6e0 END), 1)) AS score
FROM (SELECT sum(total_trades) AS total_trades, round(sum(win_rate * total_trades) / sum(total_trades), 1) AS win_rate, round(sum(avg_pnl_pct * total_trades) / sum(total_trades), 2) AS avg_pnl_pct,
  round(sum(avg_holding_days * total_trades) / sum(total_trades), 1) AS avg_holding_days, stddev_pop(win_rate) AS ws, stddev_pop(avg_pnl_pct) AS ps, min(avg_pnl_pct) AS mn FROM v_psum)""")
def _(t):
    return bt.consistency(period_summaries(t))


VIEWS["v_alpha"] = """
SELECT b.*, s.bench AS sector_benchmark, round(b.pnl_pct - s.bench, 2) AS sector_alpha FROM v_bt b JOIN (SELECT sector, round(round(sum(pnl_pct), 6) / count(*), 2) AS bench FROM v_bt GROUP BY sector) s ON s.sector = b.sector"""


@query("K7_sector_alpha", "SELECT month, instrument, sector, sector_benchmark, sector_alpha FROM v_alpha")
def _(t):
    return bt.sector_alpha(results(t), ["strategy"]).select("month", "instrument", "sector", "sector_benchmark", "sector_alpha")


@query("K7_alpha_summary", """
SELECT strategy, round(round(sum(sector_alpha), 6) / count(*), 2) AS portfolio_alpha, CASE WHEN count(*) >= 2 AND stddev_pop(sector_alpha) > 1e-9 THEN round(avg(sector_alpha) / stddev_pop(sector_alpha) * sqrt(50.0e0), 2) ELSE 0.0e0 END AS sector_adjusted_sharpe
FROM v_alpha GROUP BY strategy""")
def _(t):
    return bt.alpha_summary(bt.sector_alpha(results(t), ["strategy"]), ["strategy"])


VIEWS["v_dd"] = """
SELECT island, max(v) FILTER (WHERE np) AS pv, max(idx) FILTER (WHERE np) AS peak_idx, min(v) FILTER (WHERE NOT np) AS tv, first(idx ORDER BY v, idx) FILTER (WHERE NOT np) AS trough_idx, count(*) FILTER (WHERE NOT np) AS underwater
FROM (SELECT *, sum(CASE WHEN np THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS island FROM (
  SELECT idx, v, coalesce(v >= max(v) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS np FROM (SELECT idx, round(cumulative, 2) AS v FROM v_curve))) GROUP BY island"""
VIEWS["v_ep"] = """
SELECT d.peak_idx, d.trough_idx, n.peak_idx AS recovery_idx, round(d.pv - d.tv, 2) AS drawdown_pct, d.trough_idx - d.peak_idx AS duration, n.peak_idx - d.trough_idx AS recovery_time, d.underwater
FROM v_dd d LEFT JOIN v_dd n ON n.island = d.island + 1 WHERE d.underwater > 0"""


def episodes(t):
    return bt.drawdown_episodes(curve(t), ["strategy"], "date", ["rank"])


@query("K8_drawdown_episodes", "SELECT * FROM v_ep")
def _(t):
    return episodes(t).drop("strategy")


@query("K8_drawdown_summary", """
SELECT count(*) AS episodes, max(drawdown_pct) AS max_drawdown_pct, first(duration ORDER BY drawdown_pct DESC, peak_idx) AS max_drawdown_duration, round(avg(CASE WHEN duration > 0 THEN duration END), 1) AS avg_drawdown_duration,
  coalesce(max(recovery_time), 0) AS max_recovery_time, round(coalesce(avg(recovery_time), 0), 1) AS avg_recovery_time, CAST(sum(underwater) AS BIGINT) AS underwater_count FROM v_ep""")
def _(t):
    return bt.drawdown_summary(episodes(t), ["strategy"]).drop("strategy")


VIEWS["v_alloc"] = """
SELECT month, date, instrument, sector, entry_ord, rank, least(15.0e0, run) - least(15.0e0, run - raw) AS raw_alloc, round(least(15.0e0, run) - least(15.0e0, run - raw), 2) AS allocation_pct FROM (
 SELECT *, sum(raw) OVER (PARTITION BY month, sector ORDER BY rank) AS run FROM (
  SELECT *, round(greatest(0.5e0, least(3.0e0, greatest(0.0e0, least(100.0e0, strength)) / 50.0e0)) * (0.015e0 * 100), 2) AS raw, row_number() OVER (PARTITION BY month ORDER BY strength DESC, instrument) AS rank
  FROM (SELECT *, round(50 + 1000 * score, 4) AS strength FROM v_cand)) WHERE rank <= floor(regime_mult * 12))"""


def allocations(t):
    c = candidates(t).withColumn("strength", rnd(F.col("score") * 1000 + 50, 4))
    return bt.size_positions(c, "month", max_positions=12)


@query("K9_position_sizing", "SELECT month, instrument, sector, rank, allocation_pct FROM v_alloc WHERE allocation_pct > 0")
def _(t):
    return allocations(t).select("month", "instrument", "sector", F.col("rank").cast("long").alias("rank"), "allocation_pct")


@query("K10_sector_rotation", """
SELECT sector, i AS step, CASE WHEN sd > 0 AND round(cur - roll, 9) > round(sd, 9) THEN 'overweight' WHEN sd > 0 AND round(cur - roll, 9) < -round(sd, 9) THEN 'underweight' ELSE 'neutral' END AS signal,
  round(cur, 2) AS current_avg, round(roll, 2) AS rolling_avg, round(cur - roll, 2) AS momentum, round(sd, 2) AS std_dev, k AS days_in_window, sc AS stock_count
FROM (SELECT *, CASE WHEN k >= 2 THEN sp ELSE 5.0e0 END AS sd FROM (
  SELECT sector, i, cur, avg(cur) OVER w AS roll, count(*) OVER w AS k, stddev_pop(cur) OVER w AS sp, max(n) OVER w AS sc
  FROM (SELECT sector, year(month) * 12 + month(month) AS i, avg(50 + 1000 * score) AS cur, count(*) AS n FROM v_cand GROUP BY 1, 2) WINDOW w AS (PARTITION BY sector ORDER BY i RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)))""")
def _(t):
    s = candidates(t).select("sector", (F.year("month") * 12 + F.month("month")).alias("step"), (F.col("score") * 1000 + 50).alias("score"))
    return bt.sector_rotation(s, "step")


@query("K11_sector_rotation_lite", """
SELECT month, sector, a AS current_avg, n AS score_count, CASE WHEN s > 0 AND abs(a - m) > s THEN CASE WHEN a > m THEN 'overweight' ELSE 'underweight' END ELSE 'neutral' END AS signal,
  CASE WHEN s > 0 AND abs(a - m) > s THEN round((a - m) / s, 2) ELSE 0.0e0 END AS momentum
FROM (SELECT *, avg(a) OVER (PARTITION BY month) AS m, stddev_pop(a) OVER (PARTITION BY month) AS s FROM (SELECT month, sector, round(avg(50 + 1000 * score), 1) AS a, count(*) AS n FROM v_cand GROUP BY 1, 2))""")
def _(t):
    return bt.sector_rotation_lite(candidates(t).select("month", "sector", (F.col("score") * 1000 + 50).alias("score")), "month")


VIEWS["v_hret"] = """
SELECT h.month, h.instrument, h.allocation_pct, h.entry_ord - b.ord + 1 AS k, b.ret FROM v_alloc h
JOIN (SELECT instrument, ord, (adj_close - lag(adj_close) OVER w) / lag(adj_close) OVER w AS ret FROM v_rank WINDOW w AS (PARTITION BY instrument ORDER BY date)) b
ON b.instrument = h.instrument AND b.ord BETWEEN h.entry_ord - 19 AND h.entry_ord WHERE h.allocation_pct > 0 AND b.ret IS NOT NULL"""
VIEWS["v_hcorr"] = """
SELECT a.month, a.instrument AS a, b.instrument AS b, CASE WHEN count(*) >= 10 THEN round(greatest(-1.0e0, least(1.0e0, coalesce(corr(a.ret, b.ret), 0))), 3) ELSE 0.0e0 END AS correlation
FROM v_hret a JOIN v_hret b ON a.month = b.month AND a.k = b.k AND a.instrument < b.instrument GROUP BY 1, 2, 3"""
HALVE_SQL = """
WITH RECURSIVE h AS (SELECT month, list(instrument ORDER BY instrument) AS ids, list(allocation_pct ORDER BY instrument) AS pct FROM v_alloc WHERE allocation_pct > 0 GROUP BY month),
p AS (SELECT month, a, b, row_number() OVER (PARTITION BY month ORDER BY a, b) AS i FROM v_hcorr WHERE correlation > 0.4e0),
f AS (SELECT month, ids, pct, 0 AS i FROM h
  UNION ALL
  SELECT f.month, f.ids, list_transform(f.pct, lambda v, x: CASE WHEN x = CASE WHEN f.pct[list_position(f.ids, p.a)] <= f.pct[list_position(f.ids, p.b)] THEN list_position(f.ids, p.a) ELSE list_position(f.ids, p.b) END THEN floor(v * 0.5e0 * 100 + 0.5e0) / 100 ELSE v END), p.i
  FROM f JOIN p ON p.month = f.month AND p.i = f.i + 1),
last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY month ORDER BY i DESC) = 1),
adj AS (SELECT month, unnest(ids) AS instrument, unnest(pct) AS adjusted_pct FROM last)
"""


def _hold(t):
    w = Window.partitionBy("instrument").orderBy("date")
    rets = t.series.select("instrument", "ord", ((F.col("adj_close") - F.lag("adj_close").over(w)) / F.lag("adj_close").over(w)).alias("ret")).where("ret is not null")
    h = t.shared("holdings", SOURCES, lambda: allocations(t).select("month", "instrument", "allocation_pct", F.col("entry_ord").alias("as_of_ord")))
    return h, t.shared("holding-returns", SOURCES, lambda: bt.holding_returns(h, rets))


@query("K12_holding_correlation", "SELECT month, a, b, correlation, correlation > 0.4e0 AS flagged FROM v_hcorr")
def _(t):
    return bt.holding_correlations(_hold(t)[1], "month", 0.4)


@query("K12_correlation_adjustments", HALVE_SQL + "SELECT month, instrument, adjusted_pct FROM adj")
def _(t):
    h, r = _hold(t)
    return bt.halve_correlated(h, bt.holding_correlations(r, "month", 0.4), "month")


@query("K12_portfolio_beta", HALVE_SQL.rstrip() + """,
port AS (SELECT month, k, avg(ret) AS pr FROM v_hret GROUP BY 1, 2),
be AS (SELECT h.month, h.instrument, covar_pop(h.ret, p.pr) / var_pop(p.pr) AS beta FROM v_hret h JOIN port p ON p.month = h.month AND p.k = h.k GROUP BY 1, 2)
SELECT be.month, round(sum(beta * adjusted_pct) / sum(adjusted_pct), 2) AS effective_beta, count(*) AS holdings FROM be JOIN adj ON adj.month = be.month AND adj.instrument = be.instrument GROUP BY be.month""")
def _(t):
    h, r = _hold(t)
    return bt.portfolio_beta(r, bt.halve_correlated(h, bt.holding_correlations(r, "month", 0.4), "month"), "month")


@query("K13_trade_stats", """
SELECT instrument, count(*) AS total_trades, count(*) FILTER (WHERE status = 'open') AS open_positions, count(*) FILTER (WHERE status = 'closed') AS closed_trades,
  round(count(*) FILTER (WHERE pnl_pct > 0) * 1.0e0 / nullif(count(*) FILTER (WHERE status = 'closed'), 0) * 100, 1) AS win_rate, round(sum(pnl_pct), 2) AS total_pnl_pct,
  round(round(sum(pnl_pct), 6) / nullif(count(*) FILTER (WHERE status = 'closed'), 0), 2) AS avg_pnl_pct, round((round(sum(CASE WHEN pnl_pct > 0 THEN pnl_pct END), 6) / count(CASE WHEN pnl_pct > 0 THEN pnl_pct END)), 2) AS avg_win_pct, round((round(sum(CASE WHEN pnl_pct <= 0 THEN pnl_pct END), 6) / count(CASE WHEN pnl_pct <= 0 THEN pnl_pct END)), 2) AS avg_loss_pct,
  round(abs((round(sum(CASE WHEN pnl_pct > 0 THEN pnl_pct END), 6) / count(CASE WHEN pnl_pct > 0 THEN pnl_pct END)) / (round(sum(CASE WHEN pnl_pct <= 0 THEN pnl_pct END), 6) / count(CASE WHEN pnl_pct <= 0 THEN pnl_pct END))), 2) AS profit_factor,
  first(trade_id ORDER BY pnl_pct DESC, trade_id) FILTER (WHERE status = 'closed') AS best_trade, first(trade_id ORDER BY pnl_pct, trade_id) FILTER (WHERE status = 'closed') AS worst_trade
FROM v_trades GROUP BY instrument""")
def _(t):
    return bt.trade_stats(order_trades(t), ["instrument"])


# Every candidate simulated on its own for 20 bars, without calendar or ex-date rules.
VIEWS["v_all_cand"] = """
SELECT *, round(entry_price + (entry_price - stop_loss) * 2, 2) AS take_profit, CASE WHEN atr > 0 THEN 'atr' ELSE 'fallback_pct' END AS stop_type FROM (
 SELECT *, round(CASE WHEN atr > 0 THEN least(entry_price - atr * 1.0e0 - atr * 0.5e0, entry_price * 0.98e0) ELSE entry_price * (1 + -0.03e0) END, 2) AS stop_loss FROM v_cand)"""
VIEWS["v_sim"] = f"""
SELECT *, round(((exit_price - entry_price) / entry_price - {COST_SQL}) * 100, 2) AS net_pnl_pct, (exit_price - entry_price) / entry_price - {COST_SQL} > 0 AS win FROM (
SELECT c.*, coalesce(h.px, f.adj_close) AS exit_price, coalesce(h.reason, 'end_of_data') AS exit_reason FROM v_all_cand c
LEFT JOIN (SELECT c.month, c.instrument, b.ord, CASE WHEN b.adj_close <= stop_loss THEN 'stop_loss' WHEN b.adj_close >= take_profit THEN 'take_profit' WHEN b.ord - c.entry_ord >= 20 THEN 'max_holding_days' END AS reason,
    CASE WHEN b.adj_close <= stop_loss THEN stop_loss WHEN b.adj_close >= take_profit THEN take_profit ELSE b.adj_close END AS px
  FROM v_all_cand c JOIN v_rank b ON b.instrument = c.instrument AND b.ord BETWEEN c.entry_ord + 1 AND c.entry_ord + 20
  WHERE b.adj_close <= stop_loss OR b.adj_close >= take_profit OR b.ord - c.entry_ord >= 20
  QUALIFY row_number() OVER (PARTITION BY c.month, c.instrument ORDER BY b.ord) = 1) h ON h.month = c.month AND h.instrument = c.instrument
LEFT JOIN v_rank f ON f.instrument = c.instrument AND f.ord = least(c.entry_ord + 20, f.n_bars))"""


def simulated(t):
    return t.shared("simulated", SOURCES, lambda: _simulated(t))


def _simulated(t):
    stop = ind.atr_stop(F.col("entry_price"), F.col("atr"), 1.0)
    c = candidates(t).withColumn("stop_loss", stop).withColumn("take_profit", rnd(F.col("entry_price") + (F.col("entry_price") - F.col("stop_loss")) * 2, 2))
    c = c.withColumn("stop_type", F.when(F.col("atr") > 0, "atr").otherwise("fallback_pct")).select(
        "month", "date", "instrument", "sector", "entry_ord", "entry_price", "stop_loss", "take_profit", "stop_type", "momentum")
    bars = t.series.select("instrument", "date", "ord", "n_bars", F.col("adj_close").alias("price"), F.lit(None).cast("double").alias("cash_div"), F.lit(None).cast("double").alias("stock_div"))
    x = bt.simulate_exits(c, bt.price_path(bars), end_reason="end_of_data")
    net = bt.net_pnl(F.col("entry_price"), F.col("exit_price"), round_trip_cost(code()))
    return x.withColumn("net_pnl_pct", rnd(net, 2)).withColumn("win", net > 0)


@query("K14_weight_test_simulation", "SELECT month, instrument, round(exit_price, 4) AS exit_price, exit_reason, net_pnl_pct, win FROM v_sim")
def _(t):
    return simulated(t).select("month", "instrument", rnd("exit_price", 4).alias("exit_price"), "exit_reason", "net_pnl_pct", "win")


def _metrics_sql(src: str, keys: str, order: str) -> str:
    return f"""SELECT {keys}, n AS total_trades, round(w * 100, 1) AS win_rate,
  CASE WHEN n >= 10 THEN round(((w + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) - 1.96e0 * sqrt((w * (1 - w) + 3.8416e0 / (4 * n)) / n) / (1 + 3.8416e0 / n)) * 100, 1) END AS ci_lower,
  CASE WHEN n >= 10 THEN round(((w + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) + 1.96e0 * sqrt((w * (1 - w) + 3.8416e0 / (4 * n)) / n) / (1 + 3.8416e0 / n)) * 100, 1) END AS ci_upper,
  round(mean, 2) AS avg_pnl, round(tot, 2) AS total_pnl, CASE WHEN sd > 1e-12 THEN round(mean / sd * sqrt(252.0e0), 2) ELSE 0.0e0 END AS sharpe_ratio, n >= 30 AS sharpe_reliable, round(dd, 2) AS max_drawdown,
  CASE WHEN loss > 0 THEN round(gain / loss, 2) END AS profit_factor, CASE WHEN n < 10 THEN 'critical' WHEN n < 30 THEN 'warning' WHEN n < 50 THEN 'note' END AS sample_warning, atr_stops, fallback_stops
FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE win) * 1.0e0 / count(*) AS w, round(sum(net_pnl_pct), 6) / count(*) AS mean, round(sum(net_pnl_pct), 6) AS tot, stddev_pop(net_pnl_pct) AS sd, greatest(max(peak - cum), 0) AS dd,
   coalesce(sum(net_pnl_pct) FILTER (WHERE win), 0) AS gain, abs(coalesce(sum(net_pnl_pct) FILTER (WHERE NOT win), 0)) AS loss, count(*) FILTER (WHERE stop_type = 'atr') AS atr_stops, count(*) FILTER (WHERE stop_type <> 'atr') AS fallback_stops
  FROM (SELECT *, greatest(0, max(cum) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak
        FROM (SELECT *, sum(net_pnl_pct) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM {src})) GROUP BY {keys})"""


def sector_metrics(t):
    return bt.chunk_performance(bt.chunk_results(simulated(t), ["sector"], "month", "instrument"), ["sector"], "month")


@query("K15_performance_metrics", _metrics_sql("v_sim", "sector", "month, instrument"))
def _(t):
    return sector_metrics(t)


VIEWS["v_wf"] = """
SELECT s.*, w.i AS "window" FROM v_sim s JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o, count(*) OVER () AS n FROM v_days) d ON d.date = s.date
JOIN (SELECT unnest(generate_series(0, 100000)) AS i) w ON d.o BETWEEN w.i * 10 AND w.i * 10 + 19 AND w.i * 10 + 30 <= d.n AND w.i BETWEEN d.o // 10 - 2 AND d.o // 10"""
VIEWS["v_wfm"] = _metrics_sql("v_wf", '"window"', "month, instrument")


def wf_metrics(t):
    # a month's trades share its last date, and a date's results count for every window that holds it: windows repeat no trade
    x = bt.walk_forward(bt.chunk_results(simulated(t), [], "date", "instrument"), t.days, "date")
    return bt.chunk_performance(x, ["window"], "date")


@query("K16_walk_forward", 'SELECT "window", total_trades, win_rate, avg_pnl, sharpe_ratio, max_drawdown FROM v_wfm')
def _(t):
    return wf_metrics(t).select("window", "total_trades", "win_rate", "avg_pnl", "sharpe_ratio", "max_drawdown")


@query("K16_walk_forward_summary", """
SELECT count(*) AS windows_tested, round(avg(win_rate), 1) AS avg_win_rate, round(avg(sharpe_ratio), 2) AS avg_sharpe, round(avg(avg_pnl), 2) AS avg_pnl,
  round(count(*) FILTER (WHERE win_rate > 50) * 1.0e0 / count(*) * 100, 4) AS consistent_win_rate FROM v_wfm""")
def _(t):
    return bt.walk_forward_summary(wf_metrics(t))


DIMS = ("revenue", "profitability", "valuation", "flow", "momentum")
VIEWS["v_signals"] = """
SELECT *, CAST((instrument * 37 + month(month) * 11) % 101 AS DOUBLE) AS revenue, CAST((instrument * 53 + year(month) * 7) % 101 AS DOUBLE) AS profitability,
  CAST((instrument * 19 + month(month) * 29 + year(month)) % 101 AS DOUBLE) AS valuation, CAST((instrument * 71 + month(month) * 3) % 101 AS DOUBLE) AS flow FROM v_sim"""


def signals(t):
    i, m, y = F.col("instrument"), F.month("month"), F.year("month")
    pseudo = lambda c: (c % 101).cast("double")
    return simulated(t).withColumns({
        "revenue": pseudo(i * 37 + m * 11), "profitability": pseudo(i * 53 + y * 7), "valuation": pseudo(i * 19 + m * 29 + y), "flow": pseudo(i * 71 + m * 3)})


def _grid_sql():
    rows = [f"({i}, " + ", ".join(f"{x!r}e0" for x in bt.scenario_vector(i, len(DIMS))) + ")" for i in range(100)]
    return f"(VALUES {', '.join(rows)}) g(scenario, w1, w2, w3, w4, w5)"


VIEWS["v_grid"] = f"""
SELECT s.*, g.scenario FROM v_signals s CROSS JOIN {_grid_sql()} WHERE revenue * w1 + profitability * w2 + valuation * w3 + flow * w4 + momentum * w5 >= 55.0e0"""


@query("K17_weight_search", f"""
SELECT *, row_number() OVER (ORDER BY objective DESC, scenario) = 1 AS best FROM (SELECT *, round(sharpe_ratio + win_rate / 100 - max_drawdown / 100, 6) AS objective FROM (SELECT scenario, total_trades, win_rate, sharpe_ratio, max_drawdown FROM ({_metrics_sql('v_grid', 'scenario', 'month, instrument')})))""")
def _(t):
    x = bt.weight_search(signals(t), DIMS, "month", ["instrument"], n=100, split="instrument")
    return x.select("scenario", "total_trades", "win_rate", "sharpe_ratio", "max_drawdown", "objective", "best")


_EDGE = """SELECT '{d}' AS dimension, round(coalesce(avg(win::INT) FILTER (WHERE {d} >= 70), 0) * 100, 1) AS high_score_win_rate, round(coalesce(avg(win::INT) FILTER (WHERE {d} <= 30), 0) * 100, 1) AS low_score_win_rate,
 round((coalesce(avg(win::INT) FILTER (WHERE {d} >= 70), 0) - coalesce(avg(win::INT) FILTER (WHERE {d} <= 30), 0)) * 100, 1) AS edge, count(*) FILTER (WHERE {d} >= 70 OR {d} <= 30) AS sample_size FROM v_signals"""
VIEWS["v_edge"] = " UNION ALL ".join(_EDGE.format(d=d) for d in DIMS)


@query("K18_dimension_edge", "SELECT * FROM v_edge")
def _(t):
    return bt.dimension_edge(signals(t), DIMS)


@query("K19_weight_recalibration", """
SELECT dimension, weight, round(w / sum(w) OVER (), 2) AS new_weight FROM (
 SELECT e.dimension, x.weight, CASE WHEN sample_size >= 5 THEN round(greatest(0.05e0, least(0.4e0, weight + edge / 100 * 0.1e0)), 2) ELSE weight END AS w
 FROM v_edge e JOIN (VALUES ('revenue', 0.2e0), ('profitability', 0.25e0), ('valuation', 0.15e0), ('flow', 0.2e0), ('momentum', 0.2e0)) x(dimension, weight) ON x.dimension = e.dimension)""")
def _(t):
    from tickloom.functions.typing import lookup

    edges = bt.dimension_edge(signals(t), DIMS)
    weights = edges.select("dimension", lookup(F.col("dimension"), params.STAGE1_WEIGHTS).alias("weight"))
    return bt.recalibrate(edges, weights)


@query("K19_calibration_gate", f"""
SELECT sector, total_trades, win_rate, sharpe_ratio, NOT (total_trades < 10 OR win_rate < 45 OR sharpe_ratio < 0) AS valid,
  CASE WHEN total_trades < 10 THEN 'insufficient_trades' WHEN win_rate < 45 THEN 'win_rate_below_threshold' WHEN sharpe_ratio < 0 THEN 'negative_sharpe' ELSE 'ok' END AS reason FROM ({_metrics_sql('v_sim', 'sector', 'month, instrument')})""")
def _(t):
    m = sector_metrics(t)
    return bt.accept_weights(m).select("sector", "total_trades", "win_rate", "sharpe_ratio", "valid", "reason")


@query("K20_feature_importance", " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(corr({d}, net_pnl_pct), 3) AS correlation, count(*) AS n FROM v_signals" for d in DIMS))
def _(t):
    return bt.feature_importance(signals(t), DIMS, "net_pnl_pct")


@query("K21_signal_exit_update", """
SELECT trade_id, exit_date, exit_reason, round((exit_price - entry_price) / entry_price * 100, 2) AS pnl_pct, (exit_price - entry_price) / entry_price > 0 AS win FROM v_trades""")
def _(t):
    tr = order_trades(t)
    log = tr.select("trade_id", "instrument", "entry_date", "entry_price")
    exits = tr.where("exit_date is not null").select("trade_id", "exit_date", "exit_price", "exit_reason")
    return bt.apply_exits(log, exits).select("trade_id", "exit_date", "exit_reason", "pnl_pct", "win")


@query("K22_pnl_timeline", """
SELECT exit_date, trades, round(pnl, 4) AS pnl, round(sum(pnl) OVER (ORDER BY exit_date), 2) AS cumulative_pnl FROM (SELECT exit_date, count(*) AS trades, sum(pnl_pct) AS pnl FROM v_trades WHERE exit_date IS NOT NULL GROUP BY 1)""")
def _(t):
    return bt.pnl_timeline(order_trades(t))
