"""Market-level queries (section J) and the regime history reads (A6, E6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickloom import params
from tickloom.functions.typing import rnd
from tickloom.operators import indicators as ind
from tickloom.operators import market as mk
from tickloom.operators import panel
from tickloom.plans.registry import query
from tickloom.sources.sql_views import VIEWS

VIEWS["v_state"] = """
SELECT *, lead(date) OVER (PARTITION BY instrument ORDER BY date) AS until FROM (
 SELECT instrument, date, ord AS n, adj_close,
   avg(adj_volume) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol20,
   ord >= 20 AND adj_close - avg(adj_close) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 1e-7 AS above20,
   ord >= 50 AND adj_close > avg(adj_close) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS above50,
   ord >= 150 AND adj_close > avg(adj_close) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 149 PRECEDING AND CURRENT ROW) AS above150,
   ord >= 300 AND adj_close > avg(adj_close) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS above300,
   count(ret) OVER w AS r_n, coalesce(sum(ret) OVER w, 0) AS r_s, coalesce(sum(ret * ret) OVER w, 0) AS r_q
 FROM (SELECT k.*, t.ret FROM v_rank k LEFT JOIN v_returns t ON t.instrument = k.instrument AND t.date = k.date)
 WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
VIEWS["v_cal_days"] = "SELECT CAST(unnest(generate_series(mn, mx, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) mn, max(date) mx FROM v_days)"
VIEWS["v_breadth"] = """
SELECT d.date, count(*) FILTER (WHERE s.above20) AS above, count(*) FILTER (WHERE s.n >= 20) AS total,
  CASE WHEN count(*) FILTER (WHERE s.n >= 20) > 0 THEN count(*) FILTER (WHERE s.above20) * 1.0e0 / count(*) FILTER (WHERE s.n >= 20) ELSE 0.5e0 END AS breadth
FROM v_days d JOIN v_state s ON s.date <= d.date AND (s.until IS NULL OR s.until > d.date) GROUP BY d.date"""
VIEWS["v_market"] = """
SELECT m.date, m.leaders, m.volatility, m.ratio50, m.ratio150, m.ratio300, b.breadth,
  CASE WHEN breadth < 0.25e0 AND volatility > 0.03e0 THEN 'extreme' WHEN breadth < 0.35e0 OR volatility > 0.025e0 THEN 'high' WHEN breadth > 0.7e0 AND volatility < 0.015e0 THEN 'low' ELSE 'moderate' END AS global_risk
FROM (SELECT date, count(*) AS leaders, sqrt(greatest(sum(r_q) / sum(r_n) - (sum(r_s) / sum(r_n)) * (sum(r_s) / sum(r_n)), 0)) AS volatility,
        count(*) FILTER (WHERE above50) * 1.0e0 / nullif(count(*) FILTER (WHERE n >= 50), 0) AS ratio50,
        count(*) FILTER (WHERE above150) * 1.0e0 / nullif(count(*) FILTER (WHERE n >= 50), 0) AS ratio150,
        count(*) FILTER (WHERE above300) * 1.0e0 / nullif(count(*) FILTER (WHERE n >= 50), 0) AS ratio300
      FROM (SELECT d.date, s.* EXCLUDE (date), row_number() OVER (PARTITION BY d.date ORDER BY s.vol20 DESC, s.instrument) AS r
            FROM v_days d JOIN v_state s ON s.n >= 20 AND s.date <= d.date AND (s.until IS NULL OR s.until > d.date)) WHERE r <= 20 GROUP BY date) m
JOIN v_breadth b ON b.date = m.date"""
VIEWS["v_raw_regime"] = """
SELECT *, CASE WHEN ratio50 IS NULL THEN 'unknown'
  WHEN (breadth < 0.2e0 AND volatility > 0.04e0) OR volatility > 0.05e0 THEN 'black_swan'
  WHEN (global_risk = 'extreme' AND ratio50 < 0.25e0) OR (breadth < 0.25e0 AND volatility > 0.03e0) OR (ratio50 < 0.25e0 AND ratio150 < 0.3e0) THEN 'crisis'
  WHEN (ratio50 < 0.35e0 AND ratio150 < 0.4e0) OR (global_risk = 'high' AND ratio50 < 0.45e0) OR (volatility > 0.03e0 AND ratio50 < 0.45e0) THEN 'stress'
  WHEN ratio50 < 0.5e0 OR (volatility > 0.022e0 AND ratio50 < 0.55e0) THEN 'caution'
  WHEN ratio50 > 0.6e0 AND ratio150 > 0.5e0 THEN 'normal' ELSE 'caution' END AS raw_regime FROM v_market"""


def market(t):
    return t.shared("market", ("lineitem",), lambda: mk.market_state(t.panel, t.action_days, max_gap_days=15, parts=t.parts))


def raw_regimes(t):
    c = F.col
    return market(t).withColumn(
        "raw_regime", mk.raw_regime(c("breadth"), c("volatility"), c("ratio50"), c("ratio150"), c("global_risk"))
    ).withColumn("market", F.lit("main")).join(t.days, "date", "left_semi")


@query("J1_market_breadth", "SELECT date, above, total, round(breadth, 8) AS breadth FROM v_breadth")
def _(t):
    return mk.breadth(t.series).select("date", "above", "total", rnd("breadth", 8).alias("breadth"))


@query("J2_market_volatility", "SELECT date, leaders, round(volatility, 8) AS volatility FROM v_market")
def _(t):
    return market(t).join(t.days, "date", "left_semi").select("date", "leaders", rnd("volatility", 8).alias("volatility"))


@query("J3_global_risk", "SELECT date, global_risk FROM v_market")
def _(t):
    return market(t).join(t.days, "date", "left_semi").select("date", "global_risk")


@query("J4_sma_ratios", "SELECT date, round(ratio50, 8) AS ratio50, round(ratio150, 8) AS ratio150, round(ratio300, 8) AS ratio300 FROM v_market")
def _(t):
    return market(t).join(t.days, "date", "left_semi").select("date", *[rnd(f"ratio{k}", 8).alias(f"ratio{k}") for k in (50, 150, 300)])


@query("J5_raw_regime", "SELECT date, raw_regime FROM v_raw_regime")
def _(t):
    return raw_regimes(t).select("date", "raw_regime")


VIEWS["v_xparts"] = """
SELECT date, CASE WHEN v > 0 THEN CASE WHEN v < 15 THEN 0.1e0 WHEN v > 25 THEN -0.1e0 ELSE round(0.1e0 - (v - 15) * 0.02e0, 4) END ELSE 0 END AS risk,
   CASE WHEN fxc < -0.5e0 THEN -0.1e0 WHEN fxc > 0.5e0 THEN 0.05e0 ELSE 0 END AS fx,
   CASE WHEN pc - ic < -2 THEN -0.05e0 WHEN pc - ic > 2 THEN 0.05e0 ELSE 0 END AS divergence
FROM (SELECT date, round((vix - 28) * 20 + 20, 4) AS v, round((fx / lag(fx) OVER w - 1) * 100, 4) AS fxc, round((peer / lag(peer) OVER w - 1) * 300, 4) AS pc, round((idx / lag(idx) OVER w - 1) * 300, 4) AS ic
  FROM v_wide WINDOW w AS (ORDER BY date))"""
VIEWS["v_xsig"] = "SELECT *, least(0.2e0, greatest(-0.2e0, round(risk + fx + divergence, 4))) AS signal FROM v_xparts"
VIEWS["v_override"] = """
SELECT r.date, raw_regime, signal, CASE WHEN signal < -0.15e0 THEN CASE raw_regime WHEN 'normal' THEN 'caution' WHEN 'caution' THEN 'stress' WHEN 'stress' THEN 'crisis' ELSE raw_regime END
  WHEN signal > 0.15e0 THEN CASE raw_regime WHEN 'crisis' THEN 'stress' WHEN 'stress' THEN 'caution' WHEN 'caution' THEN 'normal' ELSE raw_regime END ELSE raw_regime END AS regime
FROM v_raw_regime r JOIN v_xsig x ON x.date = r.date"""


@query("J6_cross_asset_override", "SELECT date, raw_regime, signal, regime FROM v_override")
def _(t):
    r = raw_regimes(t).join(cross_asset(t), "date")
    return r.select("date", "raw_regime", "signal", mk.cross_asset_override(F.col("raw_regime"), F.col("signal")).alias("regime"))


VIEWS["v_regime_in"] = "SELECT date, regime AS raw_regime, row_number() OVER (ORDER BY date) AS i FROM v_override"
REGIME_SQL = """
WITH RECURSIVE f AS (
  SELECT i, date, raw_regime, raw_regime AS regime, 1 AS d FROM v_regime_in WHERE i = 1
  UNION ALL
  SELECT n.i, n.date, n.raw_regime,
    CASE WHEN f.regime = 'unknown' OR n.raw_regime = 'black_swan' THEN n.raw_regime WHEN f.d < 5 THEN f.regime ELSE n.raw_regime END,
    CASE WHEN f.regime = 'unknown' OR n.raw_regime = 'black_swan' THEN 1 WHEN f.d < 5 THEN f.d + 1 WHEN n.raw_regime <> f.regime THEN 1 ELSE f.d + 1 END
  FROM f JOIN v_regime_in n ON n.i = f.i + 1)
SELECT date, raw_regime, regime, d AS days_in_regime FROM f"""


def regimes(t):
    raw = raw_regimes(t).join(cross_asset(t), "date")
    raw = raw.withColumn("raw_regime", mk.cross_asset_override(F.col("raw_regime"), F.col("signal")))
    return mk.regime_path(raw)


@query("J7_regime_transitions", REGIME_SQL)
def _(t):
    return regimes(t).select("date", "raw_regime", "regime", "days_in_regime")


@query("E6_regime_history", REGIME_SQL + " WHERE date >= DATE '1999-01-01'")
def _(t):
    return panel.between(regimes(t), "date", dt.date(1999, 1, 1)).select("date", "raw_regime", "regime", "days_in_regime").orderBy("date")


@query("A6_regime_snapshot_upsert", REGIME_SQL.rsplit("SELECT", 1)[0] + """
SELECT date, CASE WHEN day(date) % 3 = 0 THEN 'revised' ELSE regime END AS regime FROM f""")
def _(t):
    r = regimes(t).select("date", "regime")
    revised = t.days.where("dayofmonth(date) % 3 = 0").join(r.select("date"), "date", "left_semi").select("date", F.lit("revised").alias("regime"))
    return panel.replace_by_key(r, revised, ["date"])


@query("J8_asof_regime", """
SELECT e.month, r.date, r.raw_regime FROM (SELECT date_trunc('month', date)::DATE AS month, max(date) AS date FROM v_days GROUP BY 1) e
JOIN v_raw_regime r ON r.date = e.date""")
def _(t):
    ends = t.days.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))
    return raw_regimes(t).join(ends, "date").select("month", "date", "raw_regime")


@query("J9_data_quality", """
SELECT month, sector, max(n) AS max_bars, CASE WHEN max(n) < 240 THEN 'INSUFFICIENT_300D' ELSE 'OK' END AS data_quality,
  CASE WHEN max(n) < 240 THEN 'low' WHEN max(n) < 270 THEN 'medium' ELSE 'high' END AS confidence
FROM (SELECT instrument, date_trunc('month', date)::DATE AS month, row_number() OVER (PARTITION BY instrument ORDER BY date) AS n FROM v_bars) JOIN v_sectors USING (instrument) GROUP BY 1, 2""")
def _(t):
    # as of every month with a bar in the sector
    n = t.panel.select("instrument", F.trunc("date", "month").alias("month"), F.col("ord").alias("n"))
    q = n.join(t.sectors, "instrument").groupBy("month", "sector").agg(F.max("n").cast("bigint").alias("max_bars"))
    return q.select("month", "sector", "max_bars", mk.data_quality(F.col("max_bars")).alias("q")).select("month", "sector", "max_bars", "q.*")


@query("J10_position_multiplier", """
SELECT date, raw_regime, CASE raw_regime WHEN 'normal' THEN 1.0e0 WHEN 'caution' THEN 0.6e0 WHEN 'stress' THEN 0.3e0 WHEN 'crisis' THEN 0.1e0 ELSE 0.0e0 END AS multiplier,
  CASE raw_regime WHEN 'normal' THEN 0.2e0 WHEN 'caution' THEN 0.2e0 WHEN 'stress' THEN 0.15e0 WHEN 'crisis' THEN 0.15e0 ELSE 0.2e0 END AS momentum_weight FROM v_raw_regime""")
def _(t):
    r = F.col("raw_regime")
    return raw_regimes(t).select("date", "raw_regime", mk.position_multiplier(r).alias("multiplier"), mk.regime_weight(r, "momentum").alias("momentum_weight"))


VIEWS["v_ad"] = """
SELECT date, count(*) FILTER (WHERE momentum >= 60) AS passed, count(*) FILTER (WHERE momentum >= 45 AND momentum < 60) AS watch, count(*) FILTER (WHERE momentum < 45) AS rejected FROM v_mom GROUP BY date"""


def advance_decline(t):
    m = F.col("momentum")
    d = ind.momentum(t.series).groupBy("date").agg(F.count_if(m >= 60).alias("p"), F.count_if((m >= 45) & (m < 60)).alias("w"), F.count_if(m < 45).alias("r"))
    return d.select("date", mk.advance_decline(F.col("p"), F.col("w"), F.col("r")).alias("x")).select("date", "x.*")


@query("J11_advance_decline", """
SELECT date, ad_ratio, CASE WHEN ad_ratio >= 1.5e0 THEN 'strong' WHEN ad_ratio >= 1 THEN 'normal' WHEN ad_ratio >= 0.5e0 THEN 'weak' ELSE 'very_weak' END AS label
FROM (SELECT date, CASE WHEN rejected > 0 THEN round((passed + watch) * 1.0e0 / rejected, 3) ELSE 2.0e0 END AS ad_ratio FROM v_ad)""")
def _(t):
    return advance_decline(t)


VIEWS["v_wide"] = """
SELECT date, max(c) FILTER (WHERE sector = 'ASIA') AS idx, max(c) FILTER (WHERE sector = 'EUROPE') AS peer, max(c) FILTER (WHERE sector = 'AMERICA') AS fx, max(c) FILTER (WHERE sector = 'MIDDLE EAST') AS vix
FROM (SELECT sector, date, avg(close) AS c FROM v_bars JOIN v_sectors USING (instrument) GROUP BY 1, 2) GROUP BY date"""


def wide(t):
    names = {"ASIA": "idx", "EUROPE": "peer", "AMERICA": "fx", "MIDDLE EAST": "vix"}
    series = lambda: mk.sector_series(t.panel, t.sectors).withColumnRenamed("sector", "series")
    # one row per date, read by every pair and signal
    return t.shared("wide", ("lineitem", "supplier", "nation", "region"), lambda: mk.wide_series(series(), list(names)).select("date", *[F.col(k).alias(v) for k, v in names.items()]))


def _corr_sql(a, b, sign):
    return f"""SELECT '{a}_vs_{b}' AS pair, CASE WHEN count(*) >= 3 THEN round(coalesce(corr(ra, rb), 0) * {sign}, 4) ELSE 0.0e0 END AS correlation, count(*) AS n FROM (
  SELECT {a} / lag({a}) OVER (ORDER BY date) - 1 AS ra, {b} / lag({b}) OVER (ORDER BY date) - 1 AS rb FROM v_wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WHERE ra IS NOT NULL AND rb IS NOT NULL"""


@query("J12_pair_correlations", " UNION ALL ".join(_corr_sql(*x) for x in (("idx", "peer", "1.0e0"), ("idx", "fx", "-1.0e0"), ("idx", "vix", "1.0e0"))))
def _(t):
    w = wide(t)
    return mk.pair_correlation(w, "idx", "peer").unionByName(mk.pair_correlation(w, "idx", "fx", -1.0)).unionByName(mk.pair_correlation(w, "idx", "vix"))


@query("J13_cross_asset_signal", "SELECT date, signal FROM v_xsig")
def _(t):
    return cross_asset(t)


def cross_parts(t):
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    ch = lambda c, k: rnd((F.col(c) / F.lag(c).over(w) - 1) * k, 4)
    x = wide(t).select("date", rnd((F.col("vix") - 28) * 20 + 20, 4).alias("v"), "fx", "peer", ch("fx", 100).alias("fxc"), ch("peer", 300).alias("pc"), ch("idx", 300).alias("ic"))
    c = F.col
    return x.select("date", mk.cross_asset_parts(c("v"), c("fx"), c("fxc"), c("peer"), c("pc"), c("ic")).alias("p")).withColumn("signal", mk.signal_of(F.col("p")))


def cross_asset(t):
    return cross_parts(t).select("date", "signal")


@query("J13_market_context", f"""
SELECT x.date, risk, fx, divergence, signal, ad_ratio, idx_peer, idx_fx FROM v_xsig x
LEFT JOIN (SELECT date, CASE WHEN rejected > 0 THEN round((passed + watch) * 1.0e0 / rejected, 3) ELSE 2.0e0 END AS ad_ratio FROM v_ad) a ON a.date = x.date,
(SELECT correlation AS idx_peer FROM ({_corr_sql("idx", "peer", "1.0e0")})), (SELECT correlation AS idx_fx FROM ({_corr_sql("idx", "fx", "-1.0e0")}))""")
def _(t):
    w = wide(t)
    pair = lambda a, b, sign, name: mk.pair_correlation(w, a, b, sign).select(F.col("correlation").alias(name))  # one row
    x = cross_parts(t).select("date", "p.*", "signal").join(advance_decline(t).select("date", "ad_ratio"), "date", "left")
    return x.crossJoin(F.broadcast(pair("idx", "peer", 1.0, "idx_peer"))).crossJoin(F.broadcast(pair("idx", "fx", -1.0, "idx_fx")))


VIEWS["v_sector_ret"] = """
SELECT sector, date, avg(ret) AS ret FROM v_returns JOIN v_sectors USING (instrument) GROUP BY 1, 2"""


@query("J14_sector_correlation", """
SELECT a.sector AS sector_a, b.sector AS sector_b, CASE WHEN a.sector = b.sector THEN 1.0e0 WHEN count(*) >= 10 THEN round(coalesce(corr(a.ret, b.ret), 0), 3) ELSE 0.0e0 END AS correlation, count(*) AS n
FROM v_sector_ret a JOIN v_sector_ret b ON a.date = b.date WHERE a.date IN (SELECT DISTINCT date FROM v_sector_ret ORDER BY date DESC LIMIT 60) GROUP BY 1, 2""")
def _(t):
    return mk.sector_correlation(ind.daily_returns(t.panel, t.action_days, 15), t.sectors)
