"""Per-instrument indicator queries (section G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.typing import rnd
from tickloom.operators import indicators as ind
from tickloom.operators import panel
from tickloom.plans.registry import query
from tickloom.sources.sql_views import VIEWS


@query("G1_moving_averages", """
SELECT instrument, date, """ + ", ".join(
    f"CASE WHEN ord >= {p} THEN round(avg(adj_close) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW), 6) END AS sma{p}"
    for p in (5, 10, 20, 50, 150, 300)) + " FROM v_rank")
def _(t):
    ps = (5, 10, 20, 50, 150, 300)
    return ind.with_sma(t.panel, ps).select("instrument", "date", *[rnd(f"sma{p}", 6).alias(f"sma{p}") for p in ps])


# All pieces of the momentum score for every bar; prices and means within 1e-7 are equal (functions.typing.above).
VIEWS["v_chg"] = """
SELECT *, adj_close AS p, adj_volume AS v, adj_close - lag(adj_close) OVER w AS chg, close - lag(close) OVER w AS raw_change
FROM v_rank WINDOW w AS (PARTITION BY instrument ORDER BY date)"""
VIEWS["v_gl"] = "SELECT *, greatest(chg, 0.0e0) AS g, greatest(-chg, 0.0e0) AS l FROM v_chg"


def _smooth(c: str) -> str:
    seed = f"(sum({c}) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 18 PRECEDING AND 5 PRECEDING) / 14.0e0)"
    out = seed
    for back in (4, 3, 2, 1, 0):
        out = f"(({out}) * 13.0e0 + lag({c}, {back}) OVER (PARTITION BY instrument ORDER BY date)) / 14.0e0"
    return out


_AVG = "avg({c}) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN {a} PRECEDING AND {b})"
VIEWS["v_mom0"] = f"""
SELECT *, {_AVG.format(c='p', a=4, b='CURRENT ROW')} AS ma5, {_AVG.format(c='p', a=9, b='CURRENT ROW')} AS ma10,
  {_AVG.format(c='p', a=19, b='CURRENT ROW')} AS ma20, {_AVG.format(c='v', a=4, b='CURRENT ROW')} AS vol5,
  {_AVG.format(c='v', a=9, b='5 PRECEDING')} AS vol_prev5, {_smooth('g')} AS ag, {_smooth('l')} AS al,
  first_value(p) OVER (PARTITION BY instrument ORDER BY date) AS first_all
FROM v_gl"""
VIEWS["v_mom1"] = """
SELECT *, 100.0e0 - 100.0e0 / (1.0e0 + ag / CASE WHEN al <> 0 THEN al ELSE 0.0001e0 END) AS rsi,
  CASE WHEN p - ma5 > 1e-7 AND ma5 - ma10 > 1e-7 AND ma10 - ma20 > 1e-7 THEN 20 WHEN p - ma5 > 1e-7 AND ma5 - ma10 > 1e-7 THEN 10
       WHEN ma5 - p > 1e-7 AND ma10 - ma5 > 1e-7 AND ma20 - ma10 > 1e-7 THEN -20 WHEN ma5 - p > 1e-7 AND ma10 - ma5 > 1e-7 THEN -10 ELSE 0 END AS align_points,
  CASE WHEN vol_prev5 > 0 AND vol5 / vol_prev5 > 1.5e0 THEN 10 WHEN vol_prev5 > 0 AND vol5 / vol_prev5 < 0.5e0 THEN -5 ELSE 0 END AS vol_points
FROM v_mom0"""
VIEWS["v_mom"] = """
SELECT *, CASE
  WHEN ord >= 20 THEN least(100, greatest(0, 50 + align_points + vol_points
       + CASE WHEN rsi > 70 THEN -10 WHEN rsi > 60 THEN 5 WHEN rsi > 40 THEN 5 WHEN rsi > 30 THEN 10 WHEN rsi < 30 THEN -10 ELSE 0 END))
  WHEN ord >= 5 THEN least(100, greatest(0, 50 + CASE WHEN p - ma5 > 1e-7 THEN 10 ELSE -10 END
       + CASE WHEN (p - first_all) / first_all > 0.05e0 THEN 15 WHEN (p - first_all) / first_all > 0.02e0 THEN 5 WHEN (p - first_all) / first_all < -0.05e0 THEN -15 WHEN (p - first_all) / first_all < -0.02e0 THEN -5 ELSE 0 END))
  ELSE least(100, greatest(0, 50
       + CASE WHEN rc / close * 100 > 3 THEN 20 WHEN rc / close * 100 > 1 THEN 10 WHEN rc / close * 100 > 0 THEN 5 WHEN rc / close * 100 < -3 THEN -20 WHEN rc / close * 100 < -1 THEN -10 ELSE 0 END
       + CASE WHEN high > low THEN CASE WHEN (close - low) / (high - low) > 0.75e0 THEN 15 WHEN (close - low) / (high - low) > 0.5e0 THEN 5 WHEN (close - low) / (high - low) < 0.25e0 THEN -15 ELSE -5 END ELSE 0 END
       + CASE WHEN trades > 50000 THEN 10 WHEN trades > 10000 THEN 5 WHEN trades < 500 THEN -10 ELSE 0 END))
  END * 1.0e0 AS momentum
FROM (SELECT *, coalesce(raw_change, 0.0e0) AS rc FROM v_mom1)"""


@query("G2_ma_alignment", "SELECT instrument, date, align_points FROM v_mom WHERE ord >= 20")
def _(t):
    m = ind.momentum_parts(t.panel).where("ord >= 20")
    pts = ind.alignment_points(F.col("p"), F.col("ma5"), F.col("ma10"), F.col("ma20"))
    return m.select("instrument", "date", pts.alias("align_points"))


@query("G3_rsi", "SELECT instrument, date, round(rsi, 6) AS rsi FROM v_mom WHERE ord >= 20")
def _(t):
    return ind.momentum_parts(t.panel).where("ord >= 20").select("instrument", "date", rnd("rsi", 6).alias("rsi"))


@query("G4_volume_trend", "SELECT instrument, date, round(vol5 / vol_prev5, 6) AS volume_ratio, vol_points FROM v_mom WHERE ord >= 10")
def _(t):
    m = ind.momentum_parts(t.panel).where("ord >= 10")
    return m.select("instrument", "date", rnd(F.col("vol5") / F.col("vol_prev5"), 6).alias("volume_ratio"),
                    ind.volume_trend_points(F.col("vol5"), F.col("vol_prev5")).alias("vol_points"))


@query("G5_momentum_full", "SELECT instrument, date, momentum FROM v_mom WHERE ord >= 20")
def _(t):
    return ind.momentum_parts(t.panel).where("ord >= 20").select("instrument", "date", ind.momentum_full().alias("momentum"))


@query("G6_momentum_short", "SELECT instrument, date, momentum FROM v_mom WHERE ord BETWEEN 5 AND 19")
def _(t):
    return ind.momentum_parts(t.panel).where("ord between 5 and 19").select("instrument", "date", ind.momentum_short().alias("momentum"))


@query("G7_momentum_single_day", """
SELECT instrument, date, least(100, greatest(0, 50
  + CASE WHEN pct > 3 THEN 20 WHEN pct > 1 THEN 10 WHEN pct > 0 THEN 5 WHEN pct < -3 THEN -20 WHEN pct < -1 THEN -10 ELSE 0 END
  + CASE WHEN high > low THEN CASE WHEN (close - low) / (high - low) > 0.75e0 THEN 15 WHEN (close - low) / (high - low) > 0.5e0 THEN 5 WHEN (close - low) / (high - low) < 0.25e0 THEN -15 ELSE -5 END ELSE 0 END
  + CASE WHEN trades * 9000 > 50000 THEN 10 WHEN trades * 9000 > 10000 THEN 5 WHEN trades * 9000 < 500 THEN -10 ELSE 0 END)) * 1.0e0 AS momentum
FROM (SELECT *, (close - open) / close * 100 AS pct FROM v_bars)""")
def _(t):
    c = F.col
    return t.bars.select("instrument", "date", ind.momentum_single_day(
        c("close"), c("close") - c("open"), c("high"), c("low"), c("trades") * 9000).alias("momentum"))


@query("G8_momentum_dispatch", "SELECT instrument, date, momentum FROM v_mom")
def _(t):
    return ind.momentum(t.panel).select("instrument", "date", "momentum")


VIEWS["v_adv"] = """
SELECT instrument, avg(adj_close * adj_volume) AS adv, max(n_bars) AS n_bars FROM v_rank
WHERE rn <= CASE WHEN n_bars >= 20 THEN 20 ELSE 5 END AND adj_close > 0 AND adj_volume > 0 GROUP BY instrument"""


@query("G9_average_daily_value", "SELECT instrument, round(adv, 2) AS adv, n_bars FROM v_adv")
def _(t):
    return ind.average_daily_value(t.panel.where("rn <= 20")).select("instrument", rnd("adv", 2).alias("adv"), "n_bars")


VIEWS["v_gaps"] = """
SELECT *, (open - prev) / prev * 100 AS gap_pct FROM (SELECT *, lag(adj_close) OVER (PARTITION BY instrument ORDER BY date) AS prev FROM v_rank)"""
VIEWS["v_gap_filled"] = """
SELECT g.instrument, g.date, g.gap_pct, g.ord,
  (SELECT min(b.ord) - g.ord + 1 FROM v_rank b WHERE b.instrument = g.instrument AND b.ord BETWEEN g.ord AND g.ord + 19
     AND CASE WHEN g.gap_pct > 0 THEN b.adj_close <= g.prev ELSE b.adj_close >= g.prev END) AS filled_at
FROM v_gaps g WHERE abs(g.gap_pct) >= 0.5e0"""
VIEWS["v_gap_fill"] = """
SELECT *, CASE WHEN abs(current_gap_pct) > 0.5e0 THEN CASE WHEN fill_pct_5d > 70 THEN -8.0e0 WHEN fill_pct_5d > 50 THEN -4.0e0 WHEN fill_pct_10d > 60 THEN -3.0e0 ELSE 3.0e0 END ELSE 0.0e0 END AS timing_adjustment,
  CASE WHEN abs(current_gap_pct) > 0 THEN round(abs(current_gap_pct) / med, 2) ELSE 0.0e0 END AS gap_vs_median
FROM (SELECT f.instrument, count(*) AS gaps, median(abs(f.gap_pct)) AS med,
    round(count(*) FILTER (WHERE filled_at <= 5) * 1.0e0 / count(*) * 100, 1) AS fill_pct_5d,
    round(count(*) FILTER (WHERE filled_at <= 10) * 1.0e0 / count(*) * 100, 1) AS fill_pct_10d,
    round(count(*) FILTER (WHERE filled_at <= 20) * 1.0e0 / count(*) * 100, 1) AS fill_pct_20d,
    round(avg(filled_at), 1) AS avg_fill_days,
    any_value(cur.c) AS current_gap_pct
  FROM v_gap_filled f JOIN (SELECT instrument, round(gap_pct, 2) AS c FROM v_gaps WHERE rn = 1) cur ON cur.instrument = f.instrument GROUP BY f.instrument)"""


@query("G10_gap_fill", """SELECT instrument, fill_pct_5d, fill_pct_10d, fill_pct_20d, avg_fill_days, current_gap_pct, gap_vs_median, timing_adjustment, gaps FROM v_gap_fill""")
def _(t):
    return ind.gap_fill(t.panel)


VIEWS["v_vol_anom0"] = """
SELECT instrument, count(*) AS n, max(v) FILTER (WHERE rn = 1) AS cur, median(v) FILTER (WHERE rn > 1) AS med,
  regr_slope(v, 5 - rn) FILTER (WHERE rn <= 5) / avg(v) FILTER (WHERE rn <= 5) AS s
FROM (SELECT *, adj_volume AS v FROM v_rank) WHERE rn <= 21 GROUP BY instrument HAVING count(*) >= 6"""
VIEWS["v_vol_anom"] = """
SELECT instrument, relative_volume, anomaly_type, volume_trend, trend_strength, median_volume, current_volume,
  round(least(5, greatest(-5, CASE anomaly_type WHEN 'institutional' THEN least(5.0e0, 2.0e0 + (rel - 3.0e0) * 0.5e0) WHEN 'low_conviction' THEN greatest(-5.0e0, -2.0e0 + (rel - 0.3e0) * 5.0e0) ELSE 0.0e0 END
   + CASE WHEN volume_trend = 'increasing' AND anomaly_type <> 'low_conviction' THEN 1.5e0 WHEN volume_trend = 'decreasing' AND anomaly_type <> 'institutional' THEN -1.0e0 ELSE 0.0e0 END)), 1) AS score_adjustment
FROM (SELECT *, CASE WHEN trend_strength > 5 THEN 'increasing' WHEN trend_strength < -5 THEN 'decreasing' ELSE 'stable' END AS volume_trend
  FROM (SELECT instrument, cur / med AS rel, round(cur / med, 2) AS relative_volume, round(s * 100, 2) AS trend_strength, round(med, 0) AS median_volume, round(cur, 0) AS current_volume,
          CASE WHEN cur / med > 3 THEN 'institutional' WHEN cur / med < 0.3e0 THEN 'low_conviction' ELSE 'normal' END AS anomaly_type FROM v_vol_anom0))"""


@query("G11_volume_anomaly", "SELECT * FROM v_vol_anom")
def _(t):
    return ind.volume_anomaly(t.panel)


VIEWS["v_vbins"] = """
SELECT instrument, bin_size, floor(adj_close / bin_size) AS bin, sum(adj_volume) AS vol, count(*) AS n FROM (
  SELECT *, CASE WHEN min(adj_close) OVER (PARTITION BY instrument) < 30 THEN 1.0e0 WHEN min(adj_close) OVER (PARTITION BY instrument) < 100 THEN 5.0e0 ELSE 10.0e0 END AS bin_size FROM v_adj) GROUP BY 1, 2, 3"""


@query("G12_volume_profile", """
WITH RECURSIVE bins AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bin) AS i FROM v_vbins),
per AS (SELECT instrument, any_value(bin_size) AS bin_size, count(*) AS total_bins, CAST(sum(n) AS BIGINT) AS data_points, sum(vol) AS total,
        list(vol ORDER BY bin) AS vols, list(bin ORDER BY bin) AS bs, first(i ORDER BY vol DESC, bin) AS poc FROM bins GROUP BY instrument),
va AS (SELECT instrument, poc AS lo, poc AS hi, vols[poc] AS vol, total * 0.67e0 AS target, vols, len(vols) AS n FROM per
  UNION ALL
  SELECT instrument, CASE WHEN lo > 1 AND (hi >= n OR vols[lo - 1] >= vols[hi + 1]) THEN lo - 1 ELSE lo END, CASE WHEN lo > 1 AND (hi >= n OR vols[lo - 1] >= vols[hi + 1]) THEN hi ELSE hi + 1 END,
         vol + CASE WHEN lo > 1 AND (hi >= n OR vols[lo - 1] >= vols[hi + 1]) THEN vols[lo - 1] ELSE vols[hi + 1] END, target, vols, n
  FROM va WHERE vol < target AND (lo > 1 OR hi < n)),
fin AS (SELECT instrument, min(lo) AS lo, max(hi) AS hi FROM va GROUP BY instrument),
res AS (SELECT p.instrument, bin_size, total_bins, data_points, round((bs[poc] + 0.5e0) * bin_size, 2) AS poc, round((bs[hi] + 1) * bin_size, 2) AS value_area_high, round(bs[lo] * bin_size, 2) AS value_area_low, r.adj_close AS cp
  FROM per p JOIN fin f ON f.instrument = p.instrument JOIN v_rank r ON r.instrument = p.instrument AND r.rn = 1)
SELECT instrument, bin_size, total_bins, data_points, poc, value_area_high, value_area_low, least(100.0e0,
  CASE WHEN abs(cp - poc) / cp * 100 < 1 THEN 95.0e0 WHEN abs(cp - poc) / cp * 100 < 3 THEN 80.0e0 WHEN abs(cp - poc) / cp * 100 < 5 THEN 65.0e0 WHEN abs(cp - poc) / cp * 100 < 10 THEN 40.0e0 ELSE 20.0e0 END
  + CASE WHEN cp BETWEEN value_area_low AND value_area_high THEN 10.0e0 ELSE 0.0e0 END) AS sr_score FROM res""")
def _(t):
    return ind.volume_profile(t.panel).drop("last_price")


VIEWS["v_candle0"] = """
SELECT *, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn, high - low AS span,
  NOT (open <> 0 AND high <> 0 AND low <> 0 AND close <> 0 AND high > low) AS bad FROM v_bars"""
VIEWS["v_candle1"] = """
SELECT *, body / nullif(span, 0) AS b, up / nullif(span, 0) AS u, dn / nullif(span, 0) AS d FROM v_candle0"""
VIEWS["v_candle"] = """
SELECT instrument, date, CASE WHEN bad THEN 0.0e0 ELSE round(body, 2) END AS body_size, CASE WHEN bad THEN 0.0e0 ELSE round(up, 2) END AS upper_wick, CASE WHEN bad THEN 0.0e0 ELSE round(dn, 2) END AS lower_wick,
  CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'doji' WHEN 2 THEN 'doji' WHEN 3 THEN 'doji' WHEN 4 THEN 'doji' WHEN 5 THEN 'hammer' WHEN 6 THEN 'shooting_star' WHEN 7 THEN 'inside_bar'
    WHEN 8 THEN 'bullish_marubozu' WHEN 9 THEN 'bearish_marubozu' WHEN 10 THEN 'bullish_engulfing' WHEN 11 THEN 'bearish_engulfing' ELSE 'normal' END AS pattern,
  CASE k WHEN 2 THEN 0.15e0 WHEN 3 THEN -0.15e0 WHEN 5 THEN 0.35e0 WHEN 6 THEN -0.35e0 WHEN 8 THEN 0.5e0 WHEN 9 THEN -0.5e0 WHEN 10 THEN 0.4e0 WHEN 11 THEN -0.4e0
    WHEN 12 THEN round(CASE WHEN close > open THEN least(0.2e0, b * 0.3e0) WHEN close < open THEN greatest(-0.2e0, -b * 0.3e0) ELSE 0.0e0 END, 2) ELSE 0.0e0 END AS sentiment,
  CASE WHEN k IN (1, 5, 6, 8, 9) THEN 'high' WHEN k IN (2, 3, 4, 7, 10, 11) THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, CASE WHEN bad THEN 0
  WHEN b < 0.1e0 AND u > 0.3e0 AND d > 0.3e0 THEN 1 WHEN b < 0.1e0 AND d > 0.5e0 AND u < 0.15e0 THEN 2 WHEN b < 0.1e0 AND u > 0.5e0 AND d < 0.15e0 THEN 3 WHEN b < 0.1e0 THEN 4
  WHEN d >= 0.6e0 AND b < 0.25e0 AND u < 0.15e0 THEN 5 WHEN u >= 0.6e0 AND b < 0.25e0 AND d < 0.15e0 THEN 6 WHEN b < 0.2e0 AND u < 0.25e0 AND d < 0.25e0 THEN 7
  WHEN b >= 0.8e0 AND close > open THEN 8 WHEN b >= 0.8e0 THEN 9 WHEN b >= 0.55e0 AND close > open THEN 10 WHEN b >= 0.55e0 AND close < open THEN 11 ELSE 12 END AS k FROM v_candle1)"""


@query("G13_candle_pattern", "SELECT * FROM v_candle")
def _(t):
    c = F.col
    return t.bars.select("instrument", "date", ind.candle(c("open"), c("high"), c("low"), c("close")).alias("k")).select("instrument", "date", "k.*")


VIEWS["v_atr"] = """
SELECT *, CASE WHEN ord >= 15 THEN avg(tr) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr0,
         CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM v_rank WINDOW w AS (PARTITION BY instrument ORDER BY date))"""


@query("G14_average_true_range", "SELECT instrument, date, round(tr, 6) AS tr, round(atr, 6) AS atr FROM v_atr")
def _(t):
    return ind.with_atr(t.bars).select("instrument", "date", rnd("tr", 6).alias("tr"), rnd("atr", 6).alias("atr"))


@query("G15_atr_stop", """
SELECT instrument, date, round(CASE WHEN atr > 0 THEN least(close - atr * 2.5e0 - atr * 0.5e0, close * 0.98e0) ELSE close * (1 + -0.03e0) END, 2) AS stop_price FROM v_atr""")
def _(t):
    return ind.with_atr(t.bars).select("instrument", "date", ind.atr_stop(F.col("close"), F.col("atr")).alias("stop_price"))


VIEWS["v_risk_stop"] = """
SELECT instrument, round(atr, 2) AS atr, round(greatest(last - atr * 2.5e0, last * 0.5e0), 2) AS stop_price, round(high, 2) AS trailing_high,
       round(greatest(high - atr * 2.5e0, last * 0.5e0), 2) AS trailing_stop_price, 'atr' AS method
FROM (SELECT instrument, avg(tr) FILTER (WHERE rn <= 14) AS atr, max(close) FILTER (WHERE rn = 1) AS last, max(close) FILTER (WHERE rn <= 14) AS high FROM v_atr GROUP BY instrument)"""


@query("G16_risk_stop", "SELECT * FROM v_risk_stop")
def _(t):
    return ind.risk_stop(t.panel)


VIEWS["v_returns"] = """
SELECT instrument, date, ret FROM (
  SELECT *, adj_close / lag(adj_close) OVER w - 1 AS ret0, (adj_close - lag(adj_close) OVER w) / lag(adj_close) OVER w AS ret, date - lag(date) OVER w AS gap
  FROM v_adj WINDOW w AS (PARTITION BY instrument ORDER BY date)) WHERE ret IS NOT NULL AND gap <= 15 AND cash_div IS NULL"""


@query("G17_daily_returns", "SELECT instrument, date, round(ret, 8) AS ret FROM v_returns")
def _(t):
    return ind.daily_returns(t.panel, t.action_days, 15).select("instrument", "date", rnd("ret", 8).alias("ret"))


@query("G18_change_pct", """
SELECT instrument, date, round((close - lag(close) OVER w) / lag(close) OVER w * 100, 4) AS change_pct FROM v_bars WINDOW w AS (PARTITION BY instrument ORDER BY date)""")
def _(t):
    return ind.change_pct(t.bars).select("instrument", "date", "change_pct")


@query("G19_fill_zero_forward", """
SELECT instrument, date, round(c, 4) AS close FROM (
  SELECT instrument, date, last_value(CASE WHEN volume <= 60000 THEN NULL ELSE close END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM v_bars) WHERE c IS NOT NULL""")
def _(t):
    holes = t.bars.select("instrument", "date", F.when(F.col("volume") <= 60000, 0.0).otherwise(F.col("close")).alias("close"))
    return ind.fill_zero_forward(holes, "close").select("instrument", "date", rnd("close", 4).alias("close"))
