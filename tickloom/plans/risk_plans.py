"""Risk and portfolio queries (section L). A portfolio is one month's sized positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.typing import dbl, letter_grade, rnd
from tickloom.operators import backtest as bt
from tickloom.operators import indicators as ind
from tickloom.operators import optimiser
from tickloom.operators import risk as rk
from tickloom.plans.backtest_plans import SOURCES, allocations
from tickloom.plans.market_plans import REGIME_SQL, regimes
from tickloom.plans.panel_plans import trades as order_trades
from tickloom.plans.registry import query
from tickloom.sources.sql_views import VIEWS

VIEWS["v_pos"] = """
SELECT a.month AS portfolio, a.date, a.instrument, a.sector, a.entry_ord, a.allocation_pct * 10000.0e0 AS value, a.allocation_pct, CAST((a.instrument * 13) % 100 AS DOUBLE) AS conviction FROM v_alloc a WHERE allocation_pct > 0"""
VIEWS["v_pret"] = """
SELECT h.portfolio, h.instrument, h.value, h.value / sum(h.value) OVER (PARTITION BY h.portfolio, b.k) AS w0, b.k, b.ret FROM (SELECT * FROM v_pos) h
JOIN (SELECT p.portfolio AS pf, p.instrument AS ins, p.entry_ord - r.ord + 1 AS k, r.ret FROM v_pos p JOIN (
   SELECT instrument, ord, (adj_close - lag(adj_close) OVER w) / lag(adj_close) OVER w AS ret FROM v_rank WINDOW w AS (PARTITION BY instrument ORDER BY date)) r
   ON r.instrument = p.instrument AND r.ord BETWEEN p.entry_ord - 59 AND p.entry_ord WHERE r.ret IS NOT NULL) b ON b.pf = h.portfolio AND b.ins = h.instrument"""
VIEWS["v_pwt"] = "SELECT *, value / sum(value) OVER (PARTITION BY portfolio) AS weight FROM v_pos"
VIEWS["v_pcorr"] = """
SELECT a.portfolio, a.instrument AS a, b.instrument AS b, CASE WHEN count(*) >= 10 THEN round(greatest(-1.0e0, least(1.0e0, coalesce(corr(a.ret, b.ret), 0))), 3) ELSE 0.0e0 END AS correlation
FROM v_pret a JOIN v_pret b ON a.portfolio = b.portfolio AND a.k = b.k AND a.instrument < b.instrument WHERE a.k <= 20 GROUP BY 1, 2, 3"""


def positions(t):
    return t.shared("positions", SOURCES, lambda: allocations(t).select(
        F.col("month").alias("portfolio"), "date", "instrument", "sector", "entry_ord", (F.col("allocation_pct") * 10000.0).alias("value"),
        ((F.col("instrument") * 13) % 100).cast("double").alias("conviction")))


def returns60(t):
    w = Window.partitionBy("instrument").orderBy("date")
    rets = t.series.select("instrument", "ord", ((F.col("adj_close") - F.lag("adj_close").over(w)) / F.lag("adj_close").over(w)).alias("ret")).where("ret is not null")
    return t.shared("returns60", SOURCES, lambda: bt.holding_returns(positions(t).withColumn("as_of_ord", F.col("entry_ord")), rets, 60))


def pairs(t, hr=None):
    """Correlations over the last 20 returns."""
    hr = returns60(t) if hr is None else hr
    return bt.holding_correlations(hr.where("k <= 20"), "portfolio")


#: correlations of the test panel are small: its limit on correlated pairs
LIMIT = 0.2125


@query("L1_trailing_tier", """
SELECT portfolio, instrument, grade, CASE grade WHEN 'A' THEN 0.15e0 WHEN 'B' THEN 0.18e0 WHEN 'C' THEN 0.2e0 WHEN 'D' THEN 0.22e0 ELSE 0.25e0 END AS trailing_pct
FROM (SELECT *, CASE WHEN conviction >= 90 THEN 'A' WHEN conviction >= 80 THEN 'B' WHEN conviction >= 70 THEN 'C' WHEN conviction >= 60 THEN 'D' ELSE 'E' END AS grade FROM v_pos)""")
def _(t):
    g = letter_grade("conviction")
    return positions(t).select("portfolio", "instrument", g.alias("grade"), rk.trailing_pct(g).alias("trailing_pct"))


VIEWS["v_limits"] = f"""
SELECT *, CASE WHEN alerts > 2 OR stock_pct >= 0.08e0 THEN 'reject' WHEN sector_pct >= 0.25e0 OR alerts > 0 THEN 'reduce' ELSE 'allow' END AS action FROM (
 SELECT p.portfolio, p.instrument, p.conviction, round(value / sum(value) OVER (PARTITION BY p.portfolio), 4) AS stock_pct, round(sum(value) OVER (PARTITION BY p.portfolio, sector) / sum(value) OVER (PARTITION BY p.portfolio), 4) AS sector_pct,
  (SELECT count(*) FROM v_pcorr c WHERE c.portfolio = p.portfolio AND (c.a = p.instrument OR c.b = p.instrument) AND abs(c.correlation) > {LIMIT}e0) AS alerts,
  round(greatest(0, sum(value) OVER (PARTITION BY p.portfolio) * 0.08e0 - value), 2) AS max_allowed_value FROM v_pos p)"""


@query("L2_position_limits", "SELECT portfolio, instrument, stock_pct, sector_pct, alerts, max_allowed_value, action FROM v_limits")
def _(t):
    return rk.position_limits(positions(t), pairs(t), limit=LIMIT).select("portfolio", "instrument", "stock_pct", "sector_pct", "alerts", "max_allowed_value", "action")


VIEWS["v_var"] = """
SELECT portfolio, round(tot * v, 2) AS var_amount, round(v, 4) AS var_pct, 'historical_simulation' AS method, n AS samples FROM (
 SELECT r.portfolio, abs(r.ret * p.weight) AS v, row_number() OVER (PARTITION BY r.portfolio ORDER BY r.ret * p.weight) AS pos, count(*) OVER (PARTITION BY r.portfolio) AS n, p.tot
 FROM v_pret r JOIN (SELECT *, sum(value) OVER (PARTITION BY portfolio) AS tot FROM v_pwt) p ON p.portfolio = r.portfolio AND p.instrument = r.instrument)
WHERE pos = greatest(0, CAST(floor(n * (1.0e0 - 0.95e0)) AS INT)) + 1"""


def var(t, hr):
    tot = positions(t).groupBy("portfolio").agg(F.sum("value").alias("total_value"))
    w = hr.join(tot, "portfolio").withColumn("weight", F.col("value") / F.col("total_value"))
    return rk.value_at_risk(w, tot)


@query("L3_value_at_risk", "SELECT * FROM v_var")
def _(t):
    return var(t, returns60(t))


@query("L4_risk_summary", REGIME_SQL.rsplit("SELECT", 1)[0] + """
SELECT p.portfolio, round(sum(p.value), 2) AS total_exposure, count(*) AS positions, any_value(v.var_pct) AS var_pct, any_value(g.regime) AS regime,
  least(round(any_value(v.var_pct) * CASE any_value(g.regime) WHEN 'caution' THEN 1.5e0 WHEN 'stress' THEN 2.5e0 WHEN 'crisis' THEN 4.0e0 WHEN 'black_swan' THEN 6.0e0 ELSE 1.0e0 END * 3, 4), 0.5e0) AS max_drawdown_risk,
  CAST(least(10, CASE WHEN any_value(s.top) > 0.5e0 THEN 3 WHEN any_value(s.top) > 0.25e0 THEN 2 ELSE 1 END + CASE WHEN any_value(v.var_pct) > 0.05e0 THEN 3 WHEN any_value(v.var_pct) > 0.03e0 THEN 2 ELSE 1 END
   + CASE any_value(g.regime) WHEN 'stress' THEN 2 WHEN 'crisis' THEN 3 WHEN 'black_swan' THEN 4 ELSE 1 END) AS INT) AS risk_score
FROM v_pos p JOIN v_var v ON v.portfolio = p.portfolio JOIN (SELECT portfolio, round(max(x) / sum(x) * 100, 1) / 100 AS top FROM (SELECT portfolio, sector, sum(value) AS x FROM v_pos GROUP BY 1, 2) GROUP BY 1) s ON s.portfolio = p.portfolio
LEFT JOIN (SELECT q.portfolio, f.regime FROM (SELECT portfolio, max(date) AS date FROM v_pos GROUP BY 1) q JOIN f ON f.date = q.date) g ON g.portfolio = p.portfolio GROUP BY p.portfolio""")
def _(t):
    p = positions(t)
    held = p.groupBy("portfolio").agg(F.max("date").alias("date")).join(regimes(t).select("date", "regime"), "date").select("portfolio", "regime")
    return rk.risk_summary(p, var(t, returns60(t)), held)


@query("L4_top_sectors", """
SELECT portfolio, sector, round(value, 2) AS value, rank, round(value / tot * 100, 1) AS weight_pct FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY value DESC, sector) AS rank, sum(value) OVER (PARTITION BY portfolio) AS tot FROM (
  SELECT portfolio, sector, sum(value) AS value FROM v_pos GROUP BY 1, 2)) WHERE rank <= 5""")
def _(t):
    return rk.top_sectors(positions(t)).select("portfolio", "sector", rnd("value", 2).alias("value"), F.col("rank").cast("long").alias("rank"), "weight_pct")


@query("L5_pre_trade_gate", """
SELECT l.portfolio, l.instrument, l.action, l.action <> 'reject' AS allowed, s.stop_price, CASE WHEN conviction >= 90 THEN 0.15e0 WHEN conviction >= 80 THEN 0.18e0 WHEN conviction >= 70 THEN 0.2e0 WHEN conviction >= 60 THEN 0.22e0 ELSE 0.25e0 END AS trailing_pct
FROM v_limits l LEFT JOIN v_risk_stop s ON s.instrument = l.instrument""")
def _(t):
    lim = rk.position_limits(positions(t), pairs(t), limit=LIMIT)
    return rk.pre_trade_gate(lim, ind.risk_stop(t.panel), letter_grade("conviction")).select("portfolio", "instrument", "action", "allowed", "stop_price", "trailing_pct")


@query("L6_stop_enforcement", """
SELECT portfolio, instrument, signal, CASE WHEN signal IS NOT NULL THEN round(price, 2) END AS exit_price, CASE WHEN signal IS NOT NULL THEN round((price - entry) / entry * 100, 2) END AS pnl_pct,
  CASE WHEN signal IS NULL THEN round(greatest(entry * 0.96e0, greatest(entry, price, hi) * (1.0e0 - trail)), 2) END AS trailing_stop
FROM (SELECT *, CASE WHEN price <= entry * 0.96e0 THEN 'stop_loss' WHEN price >= entry * 1.05e0 THEN 'take_profit' END AS signal,
   CASE WHEN conviction >= 90 THEN 0.15e0 WHEN conviction >= 80 THEN 0.18e0 WHEN conviction >= 70 THEN 0.2e0 WHEN conviction >= 60 THEN 0.22e0 ELSE 0.25e0 END AS trail FROM (
 SELECT p.portfolio, p.instrument, p.conviction, max(b.adj_close) FILTER (WHERE b.ord = p.entry_ord) AS entry, last(b.adj_close ORDER BY b.ord) AS price, max(b.adj_close) AS hi
 FROM v_pos p JOIN v_rank b ON b.instrument = p.instrument AND b.ord BETWEEN p.entry_ord AND p.entry_ord + 10 GROUP BY 1, 2, 3))""")
def _(t):
    p = positions(t).select("portfolio", "instrument", "entry_ord", letter_grade("conviction").alias("grade"))
    want = p.select("portfolio", "instrument", "entry_ord", F.explode(F.sequence(F.col("entry_ord"), F.col("entry_ord") + 10)).alias("ord"))
    px = t.shared("prices", SOURCES, lambda: want.join(t.panel.select("instrument", "ord", "adj_close"), ["instrument", "ord"]).groupBy("portfolio", "instrument").agg(
        F.max(F.when(F.col("ord") == F.col("entry_ord"), F.col("adj_close"))).alias("entry_price"), F.max_by("adj_close", "ord").alias("price"), F.max("adj_close").alias("highest")))
    held = p.join(px.select("portfolio", "instrument", "entry_price"), ["portfolio", "instrument"]).withColumn("stop_loss", F.col("entry_price") * 0.96).withColumn("take_profit", F.col("entry_price") * 1.05)
    out = rk.enforce_stops(held, px.select("portfolio", "instrument", "price", "highest"))
    return out.select("portfolio", "instrument", "signal", "exit_price", "pnl_pct", "trailing_stop")


VIEWS["v_apanel"] = """
SELECT r.portfolio, r.instrument, r.k, r.ret FROM v_pret r JOIN (SELECT portfolio, min(mk) AS n FROM (SELECT portfolio, instrument, max(k) AS mk FROM v_pret GROUP BY 1, 2) GROUP BY 1) m ON m.portfolio = r.portfolio AND r.k <= m.n AND m.n >= 30"""
VIEWS["v_cov"] = """
SELECT a.portfolio, a.instrument AS a, b.instrument AS b, covar_samp(a.ret, b.ret) AS cov FROM v_apanel a JOIN v_apanel b ON a.portfolio = b.portfolio AND a.k = b.k GROUP BY 1, 2, 3"""
VIEWS["v_mean"] = "SELECT portfolio, instrument, avg(ret) AS mean FROM v_apanel GROUP BY 1, 2"


def moments(t):
    """Stored long covariance and means: small tables read by several joins."""
    panel = rk.aligned_panel(returns60(t), "portfolio")
    return t.shared("means", SOURCES, lambda: rk.mean_returns(panel, "portfolio")), t.shared("covariances", SOURCES, lambda: rk.covariance(panel, "portfolio"))


@query("L7_covariance", "SELECT portfolio, a, b, round(cov, 10) AS cov FROM v_cov")
def _(t):
    return rk.covariance(rk.aligned_panel(returns60(t), "portfolio"), "portfolio").select("portfolio", "a", "b", rnd("cov", 10).alias("cov"))


def weights(t):
    w = Window.partitionBy("portfolio")
    return positions(t).select("portfolio", "instrument", (F.col("value") / F.sum("value").over(w)).alias("weight"))


@query("L8_portfolio_metrics", """
SELECT r.portfolio, round(r.x * 252, 6) AS annual_return, round(sqrt(v.x * 252), 6) AS annual_volatility, round((r.x * 252 - 0.011e0) / sqrt(v.x * 252), 4) AS sharpe
FROM (SELECT w.portfolio, sum(weight * mean) AS x FROM v_pwt w JOIN v_mean m ON m.portfolio = w.portfolio AND m.instrument = w.instrument GROUP BY 1) r
JOIN (SELECT c.portfolio, sum(a.weight * b.weight * cov) AS x FROM v_cov c JOIN v_pwt a ON a.portfolio = c.portfolio AND a.instrument = c.a JOIN v_pwt b ON b.portfolio = c.portfolio AND b.instrument = c.b GROUP BY 1) v ON v.portfolio = r.portfolio""")
def _(t):
    m, c = moments(t)
    x = rk.portfolio_metrics(weights(t), m, c, ["portfolio"])
    return x.select("portfolio", rnd("annual_return", 6).alias("annual_return"), rnd("annual_volatility", 6).alias("annual_volatility"), rnd("sharpe", 4).alias("sharpe"))


@query("L9_equilibrium_blend", """
SELECT c.portfolio, c.a AS instrument, round(2.5e0 * sum(cov * w.weight), 10) AS implied, round(0.7e0 * (2.5e0 * sum(cov * w.weight)) + 0.3e0 * ((any_value(v.conviction) / 100 - 0.5e0) * 0.002e0), 10) AS blended
FROM v_cov c JOIN v_pwt w ON w.portfolio = c.portfolio AND w.instrument = c.b JOIN v_pos v ON v.portfolio = c.portfolio AND v.instrument = c.a GROUP BY 1, 2""")
def _(t):
    _, c = moments(t)
    p = positions(t)
    views = p.select("portfolio", "instrument", ((F.col("conviction") / 100 - 0.5) * 0.002).alias("view"), F.lit(0.3).alias("confidence"))
    x = rk.equilibrium(c, p.select("portfolio", "instrument", F.col("value").alias("cap")), views, "portfolio")
    return x.select("portfolio", "instrument", rnd("implied", 10).alias("implied"), rnd("blended", 10).alias("blended"))


#: weight vectors tried per portfolio
SCENARIOS = 300
VIEWS["v_scen"] = """
SELECT portfolio, scenario, instrument, 1.0e0 / n + (w - 1.0e0 / n) * CASE WHEN top > greatest(0.2e0, 1.0e0 / n) THEN (greatest(0.2e0, 1.0e0 / n) - 1.0e0 / n) / (top - 1.0e0 / n) ELSE 1.0e0 END AS weight
FROM (SELECT *, max(w) OVER (PARTITION BY portfolio, scenario) AS top FROM (SELECT *, u / sum(u) OVER (PARTITION BY portfolio, scenario) AS w FROM (
  SELECT p.portfolio, p.instrument, s.scenario, count(*) OVER (PARTITION BY p.portfolio, s.scenario) AS n,
   CASE WHEN s.scenario = 0 THEN 1.0e0 ELSE ((p.instrument * 7919 + s.scenario * 104729 + s.scenario * p.instrument * 31) % 1000 + 1) / 1000.0e0 END AS u
  FROM v_pos p CROSS JOIN (SELECT unnest(generate_series(0, 299)) AS scenario) s)))"""


@query("L10_scenario_search", """
SELECT portfolio, CAST(scenario AS INT) AS scenario, round(sharpe, 4) AS sharpe, round(ar, 6) AS annual_return FROM (
 SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY round(sharpe, 8) DESC, scenario) AS rn FROM (
  SELECT r.portfolio, r.scenario, r.x * 252 AS ar, (r.x * 252 - 0.011e0) / sqrt(v.x * 252) AS sharpe
  FROM (SELECT s.portfolio, s.scenario, sum(weight * mean) AS x FROM v_scen s JOIN v_mean m ON m.portfolio = s.portfolio AND m.instrument = s.instrument GROUP BY 1, 2) r
  JOIN (SELECT c.portfolio, a.scenario, sum(a.weight * b.weight * cov) AS x FROM v_cov c JOIN v_scen a ON a.portfolio = c.portfolio AND a.instrument = c.a JOIN v_scen b ON b.portfolio = c.portfolio AND b.instrument = c.b AND b.scenario = a.scenario GROUP BY 1, 2) v
  ON v.portfolio = r.portfolio AND v.scenario = r.scenario)) WHERE rn = 1""")
def _(t):
    m, c = moments(t)
    s = rk.scenario_weights(positions(t), "portfolio", SCENARIOS, cap=0.2)
    best = rk.best_scenario(rk.portfolio_metrics(s, m, c, ["portfolio", "scenario"]), "portfolio")
    return best.select("portfolio", "scenario", rnd("sharpe", 4).alias("sharpe"), rnd("annual_return", 6).alias("annual_return"))


def old_new(t):
    new = weights(t)
    old = new.select(F.add_months("portfolio", 1).alias("portfolio"), "instrument", F.col("weight").alias("old"))
    x = new.withColumnRenamed("weight", "new").join(old, ["portfolio", "instrument"], "full_outer")
    z = lambda c: F.coalesce(F.col(c), dbl(0)).alias(c)
    return x.select("portfolio", "instrument", z("old"), z("new"))


VIEWS["v_oldnew"] = """
SELECT coalesce(n.portfolio, o.portfolio)::DATE AS portfolio, coalesce(n.instrument, o.instrument) AS instrument, coalesce(o.weight, 0.0e0) AS old, coalesce(n.weight, 0.0e0) AS new
FROM v_pwt n FULL OUTER JOIN (SELECT (portfolio + INTERVAL 1 MONTH)::DATE AS portfolio, instrument, weight FROM v_pwt) o ON o.portfolio = n.portfolio AND o.instrument = n.instrument"""


@query("L11_weight_smoothing", """
SELECT portfolio, instrument, round(s / sum(s) OVER (PARTITION BY portfolio), 6) AS weight, round(s - o, 6) AS change, hit AS limited FROM (
 SELECT *, CASE WHEN hit THEN o + sign(n - o) * 0.05e0 ELSE n END AS s FROM (SELECT *, abs(n - o) > 0.05e0 AS hit FROM (
  SELECT portfolio, instrument, CASE WHEN sum(old) OVER w > 0 THEN old / sum(old) OVER w ELSE old END AS o, CASE WHEN sum(new) OVER w > 0 THEN new / sum(new) OVER w ELSE new END AS n FROM v_oldnew WINDOW w AS (PARTITION BY portfolio))))""")
def _(t):
    x = rk.smooth_allocation(old_new(t), "portfolio")
    return x.select("portfolio", "instrument", rnd("weight", 6).alias("weight"), rnd("change", 6).alias("change"), "limited")


@query("L12_constraint_violations", f"""
SELECT portfolio, 'single_stock_cap' AS rule, CAST(instrument AS VARCHAR) AS subject, round(weight, 4) AS value FROM v_pwt WHERE weight > 0.081e0
UNION ALL SELECT portfolio, 'sector_cap', sector, round(sum(weight), 4) FROM v_pwt GROUP BY portfolio, sector HAVING sum(weight) > 0.251e0
UNION ALL SELECT portfolio, 'correlation_risk', 'pairs', round(count(*) * 1.0e0, 4) FROM v_pcorr WHERE abs(correlation) > {LIMIT}e0 GROUP BY portfolio HAVING count(*) > 2""")
def _(t):
    return rk.violations(weights(t), t.sectors, pairs(t), limit=LIMIT)


@query("L13_optimiser_candidates", """
SELECT portfolio, instrument, round((score - 0.5e0) * 0.002e0, 10) AS expected FROM (SELECT *, bool_or(score >= 0.9e0) OVER (PARTITION BY portfolio) AS anyok, row_number() OVER (PARTITION BY portfolio ORDER BY score DESC, instrument) AS r FROM (SELECT *, conviction / 100 AS score FROM v_pos))
WHERE score >= 0.9e0 OR (NOT anyok AND r <= 3)""")
def _(t):
    c = positions(t).select("portfolio", "instrument", (F.col("conviction") / 100).alias("score"))
    return rk.expected_from_score(c, "portfolio", "score", 0.9, 3).select("portfolio", "instrument", rnd("expected", 10).alias("expected"))


@query("L13_previous_weights_asof", """
SELECT d.date, max(s.date) AS previous FROM v_days d LEFT JOIN (SELECT DISTINCT date FROM v_pos) s ON s.date < d.date GROUP BY d.date""")
def _(t):
    return rk.previous_asof(t.days, positions(t))


VIEWS["v_ochosen"] = """
SELECT portfolio, instrument, score, least(score, 0.8e0) AS conf, (score - 0.5e0) * 0.002e0 AS expected FROM (
 SELECT *, bool_or(score >= 0.35e0) OVER (PARTITION BY portfolio) AS anyok, row_number() OVER (PARTITION BY portfolio ORDER BY score DESC, instrument) AS r FROM (SELECT portfolio, instrument, conviction / 100 AS score FROM v_pos))
WHERE score >= 0.35e0 OR (NOT anyok AND r <= 10)"""
VIEWS["v_opanel"] = """
SELECT r.portfolio, r.instrument, r.k, r.ret FROM v_pret r JOIN v_ochosen c ON c.portfolio = r.portfolio AND c.instrument = r.instrument
JOIN (SELECT portfolio, min(mk) AS n FROM (SELECT p.portfolio, p.instrument, max(k) AS mk FROM v_pret p JOIN v_ochosen o ON o.portfolio = p.portfolio AND o.instrument = p.instrument GROUP BY 1, 2) GROUP BY 1) m ON m.portfolio = r.portfolio AND r.k <= m.n AND m.n >= 30"""
VIEWS["v_ocov"] = """
SELECT a.portfolio, a.instrument AS a, b.instrument AS b, covar_samp(a.ret, b.ret) AS cov FROM v_opanel a JOIN v_opanel b ON a.portfolio = b.portfolio AND a.k = b.k GROUP BY 1, 2, 3"""
VIEWS["v_oscen"] = """
SELECT portfolio, scenario, instrument, 1.0e0 / n + (w - 1.0e0 / n) * CASE WHEN top > greatest(0.2e0, 1.0e0 / n) THEN (greatest(0.2e0, 1.0e0 / n) - 1.0e0 / n) / (top - 1.0e0 / n) ELSE 1.0e0 END AS weight
FROM (SELECT *, max(w) OVER (PARTITION BY portfolio, scenario) AS top FROM (SELECT *, u / sum(u) OVER (PARTITION BY portfolio, scenario) AS w FROM (
  SELECT p.portfolio, p.instrument, s.scenario, count(*) OVER (PARTITION BY p.portfolio, s.scenario) AS n,
   CASE WHEN s.scenario = 0 THEN 1.0e0 ELSE ((p.instrument * 7919 + s.scenario * 104729 + s.scenario * p.instrument * 31) % 1000 + 1) / 1000.0e0 END AS u
  FROM (SELECT DISTINCT portfolio, instrument FROM v_opanel) p CROSS JOIN (SELECT unnest(generate_series(0, 299)) AS scenario) s)))"""
VIEWS["v_oopt"] = """
SELECT portfolio, any_value(ids) AS ids, list({'s': scenario, 'vol': vol, 'own': own, 'fixed': fixed, 'w': w, 'm': m} ORDER BY scenario) AS opts FROM (
 SELECT portfolio, scenario, list(instrument ORDER BY instrument) AS ids, sqrt(sum(weight * wc) * 252) AS vol, (sum(weight * expected) * 252 - 0.011e0) / sqrt(sum(weight * wc) * 252) AS own,
  sum(weight * conf * expected) AS fixed, list(weight ORDER BY instrument) AS w, list(answer ORDER BY instrument) AS m
 FROM (SELECT b.portfolio, b.scenario, b.instrument, any_value(b.weight) AS weight, any_value(cb.conf) AS conf, any_value(cb.expected) AS expected, sum(a.weight * cov) AS wc, sum(a.weight * (1.0e0 - ca.conf) * cov * 2.5e0) AS answer
  FROM v_oscen b JOIN v_ocov c ON c.portfolio = b.portfolio AND c.b = b.instrument JOIN v_oscen a ON a.portfolio = b.portfolio AND a.scenario = b.scenario AND a.instrument = c.a
  JOIN v_ochosen ca ON ca.portfolio = a.portfolio AND ca.instrument = a.instrument JOIN v_ochosen cb ON cb.portfolio = b.portfolio AND cb.instrument = b.instrument GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""
VIEWS["v_orow"] = """
SELECT row_number() OVER (ORDER BY d.portfolio) AS step, d.portfolio, coalesce(o.ids, d.ids) AS ids, o.opts FROM (SELECT portfolio, list(instrument ORDER BY instrument) AS ids FROM v_ochosen GROUP BY 1) d LEFT JOIN v_oopt o ON o.portfolio = d.portfolio"""
FLOW_SQL = """
WITH RECURSIVE f AS (
  SELECT 0::BIGINT AS step, NULL::DATE AS portfolio, []::BIGINT[] AS keys, []::DOUBLE[] AS target, []::DOUBLE[] AS old, []::DOUBLE[] AS weight, []::BOOLEAN[] AS hit, '' AS method, 0.0e0 AS sharpe
  UNION ALL
  SELECT step, portfolio, keys, target, old,
    CASE WHEN method = 'equal_weight' THEN list_transform(target, lambda x: round(x, 4)) ELSE list_transform(moved, lambda x: round(x / list_sum(moved), 6)) END,
    CASE WHEN method = 'equal_weight' OR list_sum(old) = 0 THEN list_transform(keys, lambda x: false) ELSE hit END, method, sharpe
  FROM (SELECT *, list_transform(range(1, len(keys) + 1), lambda i: abs(target[i] - old[i]) > 0.05e0) AS hit,
      list_transform(range(1, len(keys) + 1), lambda i: CASE WHEN list_sum(old) > 0 AND abs(target[i] - old[i]) > 0.05e0 THEN old[i] + sign(target[i] - old[i]) * 0.05e0 ELSE target[i] END) AS moved
    FROM (SELECT *, list_transform(keys, lambda k: coalesce(list_extract(aim, list_position(ids, k)), 0.0e0)) AS target,
        list_transform(keys, lambda k: coalesce(list_extract(held, list_position(had, k)) / list_sum(held), 0.0e0)) AS old
      FROM (SELECT *, list_sort(list_distinct(list_concat(ids, had))) AS keys,
          CASE WHEN opts IS NULL THEN list_transform(ids, lambda k: 1.0e0 / len(ids)) WHEN blend.r > own.r THEN list_transform(blend.w, lambda x: x / list_sum(blend.w)) ELSE list_transform(own.w, lambda x: x / list_sum(own.w)) END AS aim,
          CASE WHEN opts IS NULL THEN 'equal_weight' WHEN blend.r > own.r THEN 'blended' ELSE 'mean_variance' END AS method,
          CASE WHEN opts IS NULL THEN 0.0e0 ELSE greatest(blend.r, own.r) END AS sharpe
        FROM (SELECT *, list_max(list_transform(opts, lambda o: {'r': round(((o.fixed + list_sum(list_transform(range(1, len(ids) + 1), lambda j: o.m[j] * CASE WHEN list_sum(p) > 0 THEN p[j] / list_sum(p) ELSE 1.0e0 / len(ids) END))) * 252 - 0.011e0) / o.vol, 8), 's': -o.s, 'w': o.w})) AS blend,
            list_max(list_transform(opts, lambda o: {'r': round(o.own, 8), 's': -o.s, 'w': o.w})) AS own
          FROM (SELECT n.step, n.portfolio, n.ids, n.opts, list_filter(f.keys, lambda k, i: f.weight[i] > 0) AS had, list_filter(f.weight, lambda w: w > 0) AS held,
              list_transform(n.ids, lambda k: coalesce(list_extract(f.weight, list_position(f.keys, k)), 0.0e0)) AS p
            FROM f JOIN v_orow n ON n.step = f.step + 1))))))
SELECT portfolio AS date, keys[i] AS instrument, round(target[i], 6) AS target, round(old[i], 6) AS previous, round(weight[i] - old[i], 6) AS change, weight[i] AS weight, hit[i] AS limited, method, sharpe
FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM f WHERE step > 0)"""


@query("L13_optimiser_flow", FLOW_SQL)
def _(t):
    c = positions(t).select(F.lit("all").alias("book"), F.col("portfolio").alias("date"), "portfolio", "instrument", (F.col("conviction") / 100).alias("score"))
    return optimiser.rebalance(c, returns60(t), SCENARIOS, cap=0.2).drop("book")


@query("L14_pnl_var", """
SELECT instrument, n, CASE WHEN n >= 5 THEN round(abs(pnl_pct), 2) ELSE 0.0e0 END AS var_pct FROM (SELECT instrument, pnl_pct, row_number() OVER (PARTITION BY instrument ORDER BY pnl_pct, trade_id) AS pos, count(*) OVER (PARTITION BY instrument) AS n FROM v_trades WHERE pnl_pct IS NOT NULL)
WHERE pos = floor(n * 0.05e0) + 1""")
def _(t):
    return rk.pnl_var(order_trades(t), ["instrument"])


def drawdowns(t):
    """Deepest fall of each portfolio's weighted return path from its peak, over the last 60 bars before entry."""
    path = returns60(t).join(weights(t), ["portfolio", "instrument"]).groupBy("portfolio", "k").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    w = Window.partitionBy("portfolio").orderBy(F.desc("k"))  # at most 60 rows per portfolio
    path = path.withColumn("cum", F.sum("r").over(w)).withColumn("peak", F.greatest(dbl(0), F.max("cum").over(w)))
    return path.groupBy("portfolio").agg(F.max(F.col("peak") - F.col("cum")).alias("dd"))


@query("L14_dashboard_risk", REGIME_SQL.rsplit("SELECT", 1)[0] + """
SELECT portfolio, CAST(least(10, CASE WHEN top > 0.4e0 THEN 3 WHEN top > 0.3e0 THEN 2 WHEN top > 0.25e0 THEN 1 ELSE 0 END + CASE WHEN dd > 0.15e0 THEN 3 WHEN dd > 0.1e0 THEN 2 WHEN dd > 0.05e0 THEN 1 ELSE 0 END + CASE WHEN lv >= 5 THEN 4 ELSE greatest(0, lv - 1) END) AS INT) AS risk_score
FROM (SELECT s.portfolio, s.top, coalesce(g.dd, 0) AS dd, CASE f.regime WHEN 'black_swan' THEN 5 WHEN 'crisis' THEN 4 WHEN 'stress' THEN 3 WHEN 'caution' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END AS lv
  FROM (SELECT portfolio, max(x) / sum(x) AS top, max(d) AS date FROM (SELECT portfolio, sector, sum(value) AS x, max(date) AS d FROM v_pos GROUP BY 1, 2) GROUP BY 1) s
  LEFT JOIN f ON f.date = s.date
  LEFT JOIN (SELECT portfolio, max(peak - cum) AS dd FROM (SELECT *, greatest(0, max(cum) OVER (PARTITION BY portfolio ORDER BY k DESC)) AS peak FROM (
    SELECT portfolio, k, sum(r) OVER (PARTITION BY portfolio ORDER BY k DESC) AS cum FROM (SELECT b.portfolio, b.k, sum(p.weight * b.ret) AS r FROM v_pret b JOIN v_pwt p ON p.portfolio = b.portfolio AND p.instrument = b.instrument GROUP BY 1, 2))) GROUP BY 1) g ON g.portfolio = s.portfolio)""")
def _(t):
    s = positions(t).groupBy("portfolio", "sector").agg(F.sum("value").alias("x"), F.max("date").alias("d"))
    p = s.groupBy("portfolio").agg((F.max("x") / F.sum("x")).alias("top"), F.max("d").alias("date"))
    level = F.array_position(F.array(*[F.lit(r) for r in ("normal", "caution", "stress", "crisis", "black_swan")]), F.coalesce("regime", F.lit(""))).cast("int")
    p = p.join(regimes(t).select("date", "regime"), "date", "left").join(drawdowns(t), "portfolio", "left")
    return p.select("portfolio", rk.dashboard_risk(F.col("top"), F.coalesce("dd", dbl(0)), level).alias("risk_score"))
