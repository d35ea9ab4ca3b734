"""Screening queries (section H)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scores as sc
from tickloom.functions.typing import dbl, rnd
from tickloom.operators import screen as scr
from tickloom.plans.registry import query
from tickloom.sources.sql_views import VIEWS

AS_OF = dt.date(2001, 11, 5)
# Limits that fit the scale of the test panel.
LIMITS = {"min_adv": 7e6, "min_market_cap": 6e9, "min_market_cap_second": 4e9, "min_listing_years": 2.0, "pass": 55.0, "watchlist": 42.0}

VIEWS["v_hard"] = """
SELECT *, CASE
  WHEN coalesce(close, 0) = 0 THEN 'no_closing_price'
  WHEN n_bars > 0 AND adv IS NULL THEN 'insufficient_liquidity_no_data'
  WHEN n_bars >= 20 AND adv < 7e6 THEN 'insufficient_liquidity_twd'
  WHEN n_bars > 0 AND n_bars < 20 AND adv < 3.5e6 THEN 'insufficient_liquidity_twd_short'
  WHEN CASE WHEN has_company THEN close * greatest(paid_in_capital / 10.0e0, 0) ELSE close * 1e9 END
     < CASE WHEN has_company AND (CAST(code AS INT) >= 9900 OR CAST(code AS INT) BETWEEN 6000 AND 7999) THEN 4e9 ELSE 6e9 END THEN 'market_cap_too_small'
  WHEN close < 15 OR close > 3000 THEN 'price_out_of_range'
  WHEN has_company AND (DATE '2001-11-05' - list_date) / 365.0e0 < 2 THEN 'too_new_listing'
  WHEN has_company AND paid_in_capital > 0 AND max_pledged / (paid_in_capital / 10.0e0) > 0.3e0 THEN 'high_pledge_risk'
  WHEN DATE '2001-11-05' - last_penalty < 365 THEN 'recent_penalty'
  ELSE list_reason END AS reason FROM v_screen_in"""

VIEWS["v_scores"] = """
SELECT *,
  CASE WHEN has_rev THEN least(100, greatest(0, 50.0e0
    + CASE WHEN coalesce(rev_yoy, 0) > 50 THEN 30 WHEN coalesce(rev_yoy, 0) > 20 THEN 20 WHEN coalesce(rev_yoy, 0) > 0 THEN 10 WHEN coalesce(rev_yoy, 0) < -20 THEN -30 ELSE -10 END
    + CASE WHEN coalesce(rev_mom, 0) > 20 THEN 20 WHEN coalesce(rev_mom, 0) > 5 THEN 10 WHEN coalesce(rev_mom, 0) < -20 THEN -20 ELSE -5 END)) ELSE 25.0e0 END AS s_rev,
  CASE WHEN NOT has_val THEN 25.0e0 WHEN pe > 0 THEN CASE WHEN pe < 12 THEN 100.0e0 WHEN pe < 18 THEN 75.0e0 WHEN pe < 25 THEN 50.0e0 WHEN pe < 35 THEN 25.0e0 ELSE 0.0e0 END ELSE 0.0e0 END AS s_prof,
  CASE WHEN has_val AND (spe > 0 OR spb > 0) THEN (spe + spb) / ((CASE WHEN spe > 0 THEN 1 ELSE 0 END) + (CASE WHEN spb > 0 THEN 1 ELSE 0 END)) ELSE 25.0e0 END AS s_val,
  CASE WHEN has_flow THEN CASE WHEN total_net > 0 THEN CASE WHEN foreign_net > 0 AND trust_net > 0 THEN 100.0e0 WHEN foreign_net > 0 OR trust_net > 0 THEN 60.0e0 ELSE 40.0e0 END
                               WHEN foreign_net < 0 AND trust_net < 0 THEN 0.0e0 ELSE 30.0e0 END
       WHEN has_margin THEN least(100, greatest(0, 50.0e0 + CASE WHEN margin_buy - short_sell > 1e6 THEN 20 WHEN margin_buy - short_sell > 1e5 THEN 10 WHEN margin_buy - short_sell < -1e6 THEN -20 WHEN margin_buy - short_sell < -1e5 THEN -10 ELSE 0 END
          + CASE WHEN greatest(short_balance, 0) > 1e6 THEN -15 WHEN greatest(short_balance, 0) < 1e4 THEN 5 ELSE 0 END))
       ELSE 25.0e0 END AS s_flow,
  momentum AS s_mom
FROM (SELECT *, CASE WHEN pe > 0 THEN CASE WHEN pe < 15 THEN 100.0e0 WHEN pe < 20 THEN 75.0e0 WHEN pe < 30 THEN 50.0e0 WHEN pe < 40 THEN 25.0e0 ELSE 0.0e0 END ELSE 0.0e0 END AS spe,
             CASE WHEN pb > 0 THEN CASE WHEN pb < 1.5e0 THEN 100.0e0 WHEN pb < 2.5e0 THEN 75.0e0 WHEN pb < 4 THEN 50.0e0 ELSE 25.0e0 END ELSE 0.0e0 END AS spb FROM v_hard)"""

VIEWS["v_screen"] = """
SELECT *, round(raw, 1) AS composite_raw, round(micro, 1) AS micro_adjustment, round(raw + micro, 1) AS composite_score,
  CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN raw + micro >= 55 THEN 'pass' WHEN raw + micro >= 42 THEN 'watchlist' ELSE 'rejected' END AS bucket
FROM (SELECT *, s_rev * 0.2e0 + s_prof * 0.25e0 + s_val * 0.15e0 + s_flow * 0.2e0 + s_mom * 0.2e0 AS raw,
      greatest(-10.0e0, least(10.0e0, timing_adjustment + volume_adjustment)) AS micro FROM v_scores)"""


def screened(t):
    return scr.screen(t.screen_rows, AS_OF, "normal", LIMITS)


@query("H1_hard_filters", "SELECT instrument, code, coalesce(reason, 'pass') AS reason FROM v_hard")
def _(t):
    r = scr.hard_filter_reason(AS_OF, LIMITS)
    return t.screen_rows.select("instrument", "code", F.coalesce(r, F.lit("pass")).alias("reason"))


def _score(name, view_col):
    @query(name, f"SELECT instrument, {view_col[0]} AS score FROM v_scores")
    def _(t):
        return t.screen_rows.select("instrument", scr.score_columns()[view_col[1]].alias("score"))


_score("H2_revenue_score", ("s_rev", "revenue"))
_score("H3_profitability_score", ("s_prof", "profitability"))
_score("H4_valuation_score", ("s_val", "valuation"))
_score("H5_flow_score", ("s_flow", "flow"))


@query("H6_ownership_flow_score", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN least(100, greatest(0, 50.0e0 + CASE WHEN pct > 0.5e0 THEN 20 WHEN pct > 0.3e0 THEN 10 WHEN pct < 0.1e0 THEN -10 ELSE 0 END
   + CASE WHEN n > 100 THEN 10 WHEN n > 50 THEN 5 WHEN n < 10 THEN -10 ELSE 0 END + CASE WHEN ins > 0.1e0 THEN 10 WHEN ins < 0.01e0 THEN -5 ELSE 0 END))
  WHEN c_custkey % 3 = 1 THEN CASE WHEN sell > 0 THEN CASE WHEN buy / sell > 1.5e0 THEN 70.0e0 WHEN buy / sell > 1 THEN 60.0e0 WHEN buy / sell < 0.5e0 THEN 30.0e0 ELSE 40.0e0 END ELSE 50.0e0 END
  ELSE 25.0e0 END AS score
FROM (SELECT c_custkey, any_value(c_acctbal) / 15000.0e0 AS pct, count(o_orderkey) * 6 AS n, (any_value(c_custkey) % 40) / 300.0e0 AS ins,
       coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0) AS buy, coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END), 0) AS sell
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def _(t):
    o = t.read("orders").groupBy("o_custkey").agg(
        F.count("*").alias("cnt"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("buy"),
        F.sum(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))).alias("sell"))
    c = t.read("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("c_custkey")
    z = lambda n: F.coalesce(F.col(n), dbl(0))
    return c.select("c_custkey", sc.ownership_flow(
        F.col("c_acctbal") / 15000.0, F.coalesce("cnt", F.lit(0)) * 6, (k % 40) / 300.0, k % 3 == 0,
        F.when(k % 3 == 1, z("buy")), F.when(k % 3 == 1, z("sell"))).alias("score"))


@query("H7_composite_screen", """
SELECT instrument, coalesce(reason, 'pass') AS reason, s_rev AS revenue, s_prof AS profitability, s_val AS valuation, s_flow AS flow, s_mom AS momentum,
       composite_raw, micro_adjustment, composite_score, bucket FROM v_screen""")
def _(t):
    return screened(t).select("instrument", F.coalesce("reason", F.lit("pass")).alias("reason"), *sc.DIMENSIONS,
                              "composite_raw", "micro_adjustment", "composite_score", "bucket")


@query("H8_regime_thresholds", """
SELECT date, r AS regime,
  CASE r WHEN 'stress' THEN 75.0e0 WHEN 'crisis' THEN 80.0e0 WHEN 'black_swan' THEN 100.0e0 ELSE 60.0e0 END AS pass_threshold,
  CASE r WHEN 'stress' THEN 60.0e0 WHEN 'crisis' THEN 65.0e0 WHEN 'black_swan' THEN 95.0e0 ELSE 45.0e0 END AS watchlist_threshold,
  CASE r WHEN 'stress' THEN 15.0e0 WHEN 'crisis' THEN 20.0e0 WHEN 'black_swan' THEN 40.0e0 ELSE 0.0e0 END AS regime_adjustment
FROM (SELECT date, CASE CAST(day(date) % 6 AS INT) WHEN 0 THEN 'normal' WHEN 1 THEN 'caution' WHEN 2 THEN 'stress' WHEN 3 THEN 'crisis' WHEN 4 THEN 'black_swan' ELSE 'odd' END AS r FROM v_days)""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("normal", "caution", "stress", "crisis", "black_swan", "odd")])
    d = t.days.withColumn("regime", F.element_at(names, F.dayofmonth("date") % 6 + 1))
    return d.select("date", "regime", scr.regime_thresholds(F.col("regime"), 60.0, 45.0).alias("x")).select("date", "regime", "x.*")


VIEWS["v_strength"] = """
SELECT instrument, strength, alignment, CASE WHEN strength >= 85 THEN 'very_high' WHEN strength >= 70 THEN 'high' WHEN strength >= 50 THEN 'moderate' WHEN strength >= 30 THEN 'low' ELSE 'very_low' END AS conviction,
  CASE WHEN strength >= 90 THEN 'A+' WHEN strength >= 80 THEN 'A' WHEN strength >= 70 THEN 'B+' WHEN strength >= 55 THEN 'B' WHEN strength >= 40 THEN 'C' ELSE 'D' END AS grade, dominant_dimension
FROM (SELECT instrument, round(round(al, 6), 3) AS alignment, round(round(least(100.0e0, greatest(0.0e0, composite_raw * 0.6e0 + al * 100 * 0.25e0 + br * 100 * 0.15e0)), 6), 1) AS strength,
   CASE WHEN s_rev = mx THEN 'revenue' WHEN s_prof = mx THEN 'profitability' WHEN s_val = mx THEN 'valuation' WHEN s_flow = mx THEN 'flow' ELSE 'momentum' END AS dominant_dimension
  FROM (SELECT *, greatest(s_rev, s_prof, s_val, s_flow, s_mom) AS mx, greatest(0.0e0, 1.0e0 - list_var_pop([s_rev, s_prof, s_val, s_flow, s_mom]) / 2500.0e0) AS al,
     ((s_rev >= 40)::INT + (s_prof >= 40)::INT + (s_val >= 40)::INT + (s_flow >= 40)::INT + (s_mom >= 40)::INT) / 5.0e0 AS br FROM v_screen))"""


@query("H9_signal_strength", "SELECT * FROM v_strength")
def _(t):
    s = screened(t)
    return s.select("instrument", sc.signal_strength({d: F.col(d) for d in sc.DIMENSIONS}, F.col("composite_raw")).alias("x")).select("instrument", "x.*")


def _conf(t):
    c = {k: F.col(k) for k in ("n_bars", "pe", "pb", "has_val", "has_company", "has_margin", "adv", "has_rev", "rev_yoy", "rev_mom")}
    c.update(zero_closes=F.lit(0), dividend_yield=F.when(F.col("last_ex").isNotNull(), 1.0), regime=F.lit("stress"), flow_feed=F.lit(True))
    return t.screen_rows.select("instrument", F.explode(sc.signal_confidence(c)).alias("dimension", "v")).select(
        "instrument", "dimension", "v.confidence", F.concat_ws(",", "v.factors").alias("factors"))


@query("H10_signal_confidence", """
WITH base AS (SELECT *, CASE WHEN n_bars >= 252 THEN 25 WHEN n_bars >= 60 THEN 15 WHEN n_bars >= 20 THEN 5 ELSE -10 END AS p1,
   CASE WHEN n_bars >= 252 THEN '1yr+_history' WHEN n_bars >= 60 THEN '60d+_history' WHEN n_bars >= 20 THEN '20d+_history' ELSE 'short_history' END AS f1,
   CASE WHEN n_bars >= 20 THEN 10 ELSE 0 END AS p2, CASE WHEN n_bars >= 20 THEN 'complete_data' END AS f2,
   50.0e0 + CASE WHEN has_val THEN 20 + CASE WHEN last_ex IS NOT NULL THEN 5 ELSE 0 END ELSE -20 END + CASE WHEN has_company THEN 15 ELSE -10 END AS fund,
   concat_ws(',', CASE WHEN has_val THEN 'full_pe_data' ELSE 'no_pe_data' END, CASE WHEN has_company THEN 'company_info_available' ELSE 'no_company_info' END) AS ff,
   coalesce(rev_yoy, 0) AS y, coalesce(rev_mom, 0) AS m FROM v_screen_in)
SELECT instrument, 'momentum' AS dimension, least(100, greatest(0, least(100, greatest(0, 50.0e0 + p1 + p2)) - 20)) AS confidence, concat_ws(',', f1, f2, 'low_confidence_regime:stress') AS factors FROM base
UNION ALL SELECT instrument, 'profitability', least(100, greatest(0, fund)), ff FROM base
UNION ALL SELECT instrument, 'valuation', least(100, greatest(0, fund - 5)), ff FROM base
UNION ALL SELECT instrument, 'flow', least(100, greatest(0, 70.0e0 + CASE WHEN has_margin THEN 10 ELSE -5 END + CASE WHEN n_bars < 20 THEN 0 WHEN adv < 1e8 THEN -15 ELSE 10 END)),
   concat_ws(',', 'inst_flow_available', CASE WHEN has_margin THEN 'margin_data_available' ELSE 'no_margin_data' END, CASE WHEN n_bars < 20 THEN NULL WHEN adv < 1e8 THEN 'borderline_adv' ELSE 'healthy_adv' END) FROM base
UNION ALL SELECT instrument, 'revenue', least(100, greatest(0, 50.0e0 + CASE WHEN NOT has_rev THEN -25 ELSE 20 + CASE WHEN rev_yoy IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN rev_mom IS NOT NULL THEN 5 ELSE 0 END
     + CASE WHEN (y > 10 AND m < -10) OR (y < -10 AND m > 10) THEN -10 ELSE 0 END END)),
   CASE WHEN NOT has_rev THEN 'no_revenue_data' ELSE concat_ws(',', CASE WHEN rev_yoy IS NOT NULL THEN 'yoy_available' END, CASE WHEN rev_mom IS NOT NULL THEN 'mom_available' END,
     CASE WHEN (y > 10 AND m < -10) OR (y < -10 AND m > 10) THEN 'contradictory_yoy_mom' ELSE 'consistent_yoy_mom' END) END FROM base""")
def _(t):
    return _conf(t)


@query("H11_false_signals", """
SELECT instrument, flags, high_severity_count, flag_count, high_severity_count >= 1 OR flag_count >= 3 AS is_contradictory FROM (
 SELECT instrument, concat_ws(',', a, b, c, d, e) AS flags,
   CAST((coalesce(a LIKE '%high', false))::INT + (coalesce(b LIKE '%high', false))::INT + (coalesce(d LIKE '%high', false))::INT AS INT) AS high_severity_count,
   CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT + (e IS NOT NULL)::INT AS INT) AS flag_count
 FROM (SELECT instrument,
   CASE WHEN s_mom >= 70 AND f < 35 THEN 'contrarian:high' WHEN s_mom >= 60 AND f < 40 THEN 'contrarian:medium' END AS a,
   CASE WHEN n_bars >= 10 AND s_mom >= 60 AND vol5 / vol_prev5 < 0.6e0 THEN 'fading_momentum:high' WHEN n_bars >= 10 AND s_mom >= 60 AND vol5 / vol_prev5 < 0.8e0 THEN 'fading_momentum:medium' END AS b,
   CASE WHEN s_mom >= 65 AND s_flow < 30 THEN 'unconfirmed_momentum:medium' END AS c,
   CASE WHEN s_rev < 30 AND s_mom >= 60 THEN 'revenue_price_divergence:high' WHEN s_rev >= 70 AND s_mom < 30 THEN 'revenue_price_divergence:medium' END AS d,
   CASE WHEN DATE '2001-11-05' - last_ex BETWEEN 0 AND 200 THEN 'recent_ex_dividend:medium' END AS e
  FROM (SELECT *, (s_prof + s_val) / 2.0e0 AS f FROM v_scores)))""")
def _(t):
    # the panel has few actions near its end, so days since the ex-date are scaled into the 30-day window
    s = screened(t)
    days = F.floor(F.datediff(F.lit(AS_OF), F.col("last_ex")) * 30 / 201.0).cast("int")
    x = sc.false_signals({d: F.col(d) for d in sc.DIMENSIONS}, F.col("vol5"), F.col("vol_prev5"), F.col("n_bars"), F.when(F.datediff(F.lit(AS_OF), F.col("last_ex")) <= 200, days))
    return s.select("instrument", x.alias("x")).select(
        "instrument", F.concat_ws(",", F.transform("x.flags", lambda f: F.concat_ws(":", f["type"], f["severity"]))).alias("flags"),
        "x.high_severity_count", "x.flag_count", "x.is_contradictory")


@query("H12_stage_counts", "SELECT bucket, count(*) AS instruments FROM v_screen GROUP BY bucket")
def _(t):
    return scr.bucket_counts(screened(t))


@query("H12_top_candidates", "SELECT instrument, composite_score FROM v_screen WHERE bucket = 'pass' ORDER BY composite_score DESC, instrument LIMIT 20")
def _(t):
    return scr.top_ranked(screened(t), 20).select("instrument", "composite_score")


VIEWS["v_sector_w"] = """
SELECT s.month, s.sector, s.w AS new, p.w AS prev FROM (
  SELECT month, sector, sum(revenue) AS w FROM v_revenue r JOIN v_sectors USING (instrument) GROUP BY 1, 2) s
LEFT JOIN (SELECT month + INTERVAL 1 MONTH AS month, sector, sum(revenue) AS w FROM v_revenue JOIN v_sectors USING (instrument) GROUP BY 1, 2) p ON p.month = s.month AND p.sector = s.sector"""


@query("H13_smooth_weights", """
WITH n AS (SELECT *, prev / sum(prev) OVER (PARTITION BY month) AS p, new / sum(new) OVER (PARTITION BY month) AS q FROM v_sector_w),
c AS (SELECT *, CASE WHEN p IS NULL OR abs(q - p) <= 0.05e0 THEN q ELSE p + sign(q - p) * 0.05e0 END AS s0 FROM n),
d AS (SELECT *, least(0.5e0, greatest(0.05e0, s0)) AS s1, (p IS NOT NULL AND abs(q - p) > 0.05e0) OR s0 < 0.05e0 OR s0 > 0.5e0 AS k FROM c),
e AS (SELECT *, sum(s1) OVER (PARTITION BY month) AS tot, sum(CASE WHEN k THEN 0 ELSE 1 END) OVER (PARTITION BY month) AS free FROM d),
g AS (SELECT *, CASE WHEN abs(tot - 1.0e0) > 1e-6 AND NOT k AND free > 0 THEN greatest(0.05e0, s1 + (1.0e0 - tot) / free) ELSE s1 END AS s2 FROM e)
SELECT month, sector, round(s2 / sum(s2) OVER (PARTITION BY month), 8) AS weight FROM g""")
def _(t):
    w = t.revenue.join(t.sectors, "instrument").groupBy("month", "sector").agg(F.sum("revenue").alias("new"))
    prev = w.select(F.add_months("month", 1).alias("month"), "sector", F.col("new").alias("prev"))
    return scr.smooth_weights(w.join(prev, ["month", "sector"], "left"), "month").select("month", "sector", rnd("weight", 8).alias("weight"))


@query("H14_sector_concentration", """
SELECT sector, n, round(n * 1.0e0 / sum(n) OVER (), 2) AS share, max(n) OVER () / sum(n) OVER () <= 0.25e0 AS ok
FROM (SELECT sector, count(*) AS n FROM v_screen JOIN v_sectors USING (instrument) WHERE bucket = 'pass' GROUP BY sector)""")
def _(t):
    return scr.sector_concentration(screened(t).where("bucket = 'pass'").select("instrument").join(t.sectors, "instrument", "left"))
