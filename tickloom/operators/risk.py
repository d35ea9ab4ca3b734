"""Risk limits, value at risk, covariance and portfolio construction.

Portfolios are keyed rows (portfolio, instrument, value or weight). A
portfolio is bounded by its position limit; pairs are only formed inside one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.typing import dbl, lookup, rnd
from tickloom.operators.backtest import running
from tickloom.operators.indicators import KEY

# Fixed values.
TRAILING_TIERS = {"A": 0.15, "B": 0.18, "C": 0.20, "D": 0.22, "E": 0.25}
DEFAULT_TRAIL = 0.20
MAX_STOCK, MAX_SECTOR, CORRELATION_LIMIT = 0.08, 0.25, 0.85
RISK_FREE = 0.011
DRAWDOWN_MULT = {"normal": 1.0, "caution": 1.5, "stress": 2.5, "crisis": 4.0, "black_swan": 6.0}
REGIME_SCORE = {"normal": 0, "caution": 1, "stress": 2, "crisis": 3, "black_swan": 4}


def trailing_pct(grade: Column) -> Column:
    return lookup(grade, TRAILING_TIERS, DEFAULT_TRAIL)


def position_limits(positions: DataFrame, pairs: DataFrame, portfolio: str = "portfolio", limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Share of stock and sector, correlation alerts and action per position. Pairs are those within a portfolio, whose size its position limits bound."""
    w, ws = Window.partitionBy(portfolio), Window.partitionBy(portfolio, "sector")
    x = positions.withColumn("_tot", F.sum("value").over(w)).withColumn("_sec", F.sum("value").over(ws))
    hot = pairs.where(F.abs("correlation") > limit)
    alerts = hot.select(portfolio, F.col("a").alias(KEY)).unionByName(hot.select(portfolio, F.col("b").alias(KEY))).groupBy(portfolio, KEY).agg(F.count("*").alias("alerts"))
    x = x.join(alerts, [portfolio, KEY], "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    x = x.withColumn("stock_pct", rnd(F.col("value") / F.col("_tot"), 4)).withColumn("sector_pct", rnd(F.col("_sec") / F.col("_tot"), 4))
    action = F.when((F.col("alerts") > 2) | (F.col("stock_pct") >= MAX_STOCK), "reject").when((F.col("sector_pct") >= MAX_SECTOR) | (F.col("alerts") > 0), "reduce").otherwise("allow")
    return x.withColumn("max_allowed_value", rnd(F.greatest(dbl(0), F.col("_tot") * MAX_STOCK - F.col("value")), 2)).withColumn("action", action).drop("_tot", "_sec")


def value_at_risk(hr: DataFrame, totals: DataFrame, portfolio: str = "portfolio", confidence: float = 0.95, pooled: bool = True, bucket: float = 1e-4) -> DataFrame:
    """Historical value at risk: exact order statistic of weighted returns per portfolio.

    ``hr`` holds (portfolio, instrument, k, ret, weight). Pooled mode ranks the
    weighted returns of all positions; otherwise they are summed per day k
    first. Ranks come from a two-level scan over return buckets.
    """
    c = hr.withColumn("r", F.col("ret") * F.col("weight"))
    if not pooled:
        c = c.groupBy(portfolio, "k").agg(F.sum("r").alias("r"))
    n = c.groupBy(portfolio).agg(F.count("*").alias("n"))
    ranked = running(c.withColumn("_b", F.floor(F.col("r") / bucket)).withColumn("_one", F.lit(1)), [portfolio], "_b", ["r"], {"pos": "_one"})
    at = F.greatest(F.lit(0), F.floor(F.col("n") * (1.0 - confidence))) + 1
    pick = ranked.join(n, portfolio).where(F.col("pos") == at).select(portfolio, F.abs("r").alias("_v"), "n")
    fallback = 0.035 if confidence == 0.95 else 0.046
    x = totals.join(pick, portfolio, "left")
    v = F.coalesce(F.col("_v"), dbl(fallback))
    return x.select(portfolio, rnd(F.col("total_value") * v, 2).alias("var_amount"), rnd(v, 4).alias("var_pct"),
                    F.when(F.col("_v").isNull(), "fallback_estimate").otherwise("historical_simulation").alias("method"), F.coalesce("n", F.lit(0)).alias("samples"))


def top_sectors(positions: DataFrame, portfolio: str = "portfolio", n: int = 5) -> DataFrame:
    s = positions.groupBy(portfolio, "sector").agg(F.sum("value").alias("value"))
    w = Window.partitionBy(portfolio)
    x = s.withColumn("_t", F.sum("value").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("value")), "sector")))
    return x.where(F.col("rank") <= n).withColumn("weight_pct", rnd(F.col("value") / F.col("_t") * 100, 1)).drop("_t")


def risk_summary(positions: DataFrame, var: DataFrame, regimes: DataFrame, portfolio: str = "portfolio") -> DataFrame:
    top = top_sectors(positions, portfolio, 1).select(portfolio, (F.col("weight_pct") / 100).alias("_top"))
    tot = positions.groupBy(portfolio).agg(rnd(F.sum("value"), 2).alias("total_exposure"), F.count("*").alias("positions"))
    x = tot.join(top, portfolio).join(var.select(portfolio, "var_pct"), portfolio).join(regimes, portfolio, "left")
    r = F.coalesce("regime", F.lit("normal"))
    dd = F.least(rnd(F.col("var_pct") * lookup(r, DRAWDOWN_MULT, 1.0) * 3, 4), dbl(0.5))
    score = F.when(F.col("_top") > MAX_SECTOR * 2, 3).when(F.col("_top") > MAX_SECTOR, 2).otherwise(1) + F.when(F.col("var_pct") > 0.05, 3).when(
        F.col("var_pct") > 0.03, 2).otherwise(1) + F.greatest(F.lit(1), lookup(r, REGIME_SCORE, 0))
    return x.withColumn("max_drawdown_risk", dd).withColumn("risk_score", F.least(F.lit(10), F.greatest(F.lit(1), score))).drop("_top")


def pre_trade_gate(limits: DataFrame, stops: DataFrame, grade: Column) -> DataFrame:
    """Limits, volatility stop and trailing tier of each proposed position in one row."""
    s = stops.select(KEY, "stop_price", "method")
    return limits.join(s, KEY, "left").withColumn("trailing_pct", trailing_pct(grade)).withColumn("allowed", F.col("action") != "reject")


def enforce_stops(positions: DataFrame, prices: DataFrame, portfolio: str = "portfolio") -> DataFrame:
    """Exit signal or ratcheted trailing stop of open positions.

    ``prices`` holds (portfolio, instrument, price, highest) as of the check.
    """
    x = positions.join(prices, [portfolio, KEY], "left")
    p, e = F.col("price"), F.col("entry_price")
    live = (p > 0) & (e > 0)
    signal = F.when(live & (F.col("stop_loss") > 0) & (p <= F.col("stop_loss")), "stop_loss").when(live & (F.col("take_profit") > 0) & (p >= F.col("take_profit")), "take_profit")
    trail = F.greatest(e, p, F.col("highest")) * (dbl(1) - trailing_pct(F.col("grade")))
    return x.withColumn("signal", signal).withColumns({
        "exit_price": F.when(F.col("signal").isNotNull(), rnd(p, 2)), "pnl_pct": F.when(F.col("signal").isNotNull(), rnd((p - e) / e * 100, 2)),
        "trailing_stop": F.when(live & F.col("signal").isNull() & F.col("grade").isNotNull(), rnd(F.greatest(F.col("stop_loss"), trail), 2))})


def aligned_panel(hr: DataFrame, portfolio: str, min_n: int = 30) -> DataFrame:
    """Returns k = 1..n per holding cut to the length shared by all holdings of the portfolio."""
    per = hr.groupBy(portfolio, KEY).agg(F.max("k").alias("_k")).groupBy(portfolio).agg(F.min("_k").alias("n_obs")).where(F.col("n_obs") >= min_n)
    return hr.join(per, portfolio).where(F.col("k") <= F.col("n_obs"))


def mean_returns(panel: DataFrame, portfolio: str) -> DataFrame:
    return panel.groupBy(portfolio, KEY).agg(F.avg("ret").alias("mean"), F.count("*").alias("n"))


def covariance(panel: DataFrame, portfolio: str) -> DataFrame:
    """Sample covariance of holdings in long form (both triangles)."""
    a = panel.select(portfolio, "k", F.col(KEY).alias("a"), F.col("ret").alias("ra"))
    b = panel.select(portfolio, "k", F.col(KEY).alias("b"), F.col("ret").alias("rb"))
    return a.join(b, [portfolio, "k"]).groupBy(portfolio, "a", "b").agg(F.covar_samp("ra", "rb").alias("cov"))


def _ratio(ret: Column, var: Column) -> dict[str, Column]:
    vol = F.when(var > 0, F.sqrt(var * 252)).otherwise(0.0)
    return {"annual_return": ret * 252, "annual_volatility": vol, "sharpe": F.when(vol > 1e-10, (ret * 252 - RISK_FREE) / vol).otherwise(0.0)}


def portfolio_metrics(weights: DataFrame, means: DataFrame, cov: DataFrame, keys: Sequence[str], portfolio: str = "portfolio") -> DataFrame:
    """Annual return, volatility and Sharpe per ``keys`` (portfolio first), weights in long form."""
    r = weights.join(means.select(portfolio, KEY, "mean"), [portfolio, KEY]).groupBy(*keys).agg(F.sum(F.col("weight") * F.col("mean")).alias("_r"))
    wa = weights.select(*keys, F.col(KEY).alias("a"), F.col("weight").alias("wa"))
    wb = weights.select(*keys, F.col(KEY).alias("b"), F.col("weight").alias("wb"))
    v = wa.join(cov, [portfolio, "a"]).join(wb, [*keys, "b"]).groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("_v"))
    return r.join(v, list(keys)).withColumns(_ratio(F.col("_r"), F.col("_v"))).drop("_r", "_v")


def equilibrium(cov: DataFrame, market: DataFrame, views: DataFrame, portfolio: str, aversion: float = 2.5) -> DataFrame:
    """Implied return of each holding and its blend with the view by confidence."""
    w = Window.partitionBy(portfolio)
    m = market.withColumn("w", F.col("cap") / F.sum("cap").over(w)).select(portfolio, F.col(KEY).alias("b"), "w")
    pi = cov.join(m, [portfolio, "b"]).groupBy(portfolio, F.col("a").alias(KEY)).agg((F.sum(F.col("cov") * F.col("w")) * aversion).alias("implied"))
    x = pi.join(views, [portfolio, KEY], "left")
    conf = F.coalesce("confidence", dbl(0.3))
    return x.withColumn("blended", (dbl(1) - conf) * F.col("implied") + conf * F.coalesce("view", dbl(0)))


def scenario_weights(holdings: DataFrame, portfolio: str, n: int, cap: float = MAX_STOCK) -> DataFrame:
    """``n`` reproducible long-only weight vectors per portfolio, in long form; scenario 0 is equal weight.

    Draws are a line in instrument and scenario modulo 1000, the same for every
    portfolio. A vector that breaks the cap is pulled toward equal weight just far enough to meet it.
    """
    size = F.count("*").over(Window.partitionBy(portfolio))
    x = holdings.select(portfolio, KEY).withColumn("_n", size).withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    mix = (F.col(KEY) * 7919 + F.col("scenario") * 104729 + F.col("scenario") * F.col(KEY) * 31) % 1000
    x = x.withColumn("_u", F.when(F.col("scenario") == 0, 1.0).otherwise((mix + 1) / 1000.0))
    w = Window.partitionBy(portfolio, "scenario")
    x = x.withColumn("_w", F.col("_u") / F.sum("_u").over(w)).withColumn("_top", F.max("_w").over(w))
    eq, lim = dbl(1) / F.col("_n"), F.greatest(dbl(cap), dbl(1) / F.col("_n"))
    t = F.when(F.col("_top") > lim, (lim - eq) / (F.col("_top") - eq)).otherwise(1.0)
    return x.select(portfolio, "scenario", KEY, (eq + (F.col("_w") - eq) * t).alias("weight"))


def best_scenario(metrics: DataFrame, portfolio: str) -> DataFrame:
    pick = F.max_by(F.struct("scenario", "annual_return", "annual_volatility", "sharpe"), F.struct(rnd("sharpe", 8), -F.col("scenario")))
    return metrics.groupBy(portfolio).agg(pick.alias("b")).select(portfolio, "b.*")


def smooth_allocation(pairs: DataFrame, group: str, max_change: float = 0.05) -> DataFrame:
    """Normalise old and new, limit each step, normalise again. Rows (group, key, old, new), zeros for missing."""
    w = Window.partitionBy(group)
    norm = lambda c: F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).otherwise(F.col(c))
    x = pairs.withColumn("_o", norm("old")).withColumn("_n", norm("new")).withColumn("_d", F.col("_n") - F.col("_o"))
    hit = F.abs(F.col("_d")) > max_change
    x = x.withColumn("_s", F.when(hit, F.col("_o") + F.signum("_d") * max_change).otherwise(F.col("_n")))
    return x.withColumn("weight", F.col("_s") / F.sum("_s").over(w)).withColumn("change", F.col("_s") - F.col("_o")).withColumn("limited", hit).drop("_o", "_n", "_d", "_s")


def violations(weights: DataFrame, sectors: DataFrame, pairs: DataFrame, portfolio: str = "portfolio", limit: float = CORRELATION_LIMIT) -> DataFrame:
    """One row per broken rule: stock cap, sector cap, correlated pairs, total."""
    v = lambda kind, subject, val: [F.lit(kind).alias("rule"), subject.cast("string").alias("subject"), rnd(val, 4).alias("value")]
    stock = weights.where(F.col("weight") > MAX_STOCK + 0.001).select(portfolio, *v("single_stock_cap", F.col(KEY), F.col("weight")))
    sec = weights.join(sectors.select(KEY, "sector"), KEY, "left").groupBy(portfolio, F.coalesce("sector", F.lit("other")).alias("sector")).agg(F.sum("weight").alias("w"))
    sector = sec.where(F.col("w") > MAX_SECTOR + 0.001).select(portfolio, *v("sector_cap", F.col("sector"), F.col("w")))
    corr = pairs.where(F.abs("correlation") > limit).groupBy(portfolio).agg(F.count("*").alias("n")).where("n > 2").select(
        portfolio, *v("correlation_risk", F.lit("pairs"), F.col("n")))
    tot = weights.groupBy(portfolio).agg(F.sum("weight").alias("w")).where(F.abs(F.col("w") - 1.0) > 0.001).select(portfolio, *v("total_weight", F.lit("sum"), F.col("w")))
    return stock.unionByName(sector).unionByName(corr).unionByName(tot)


def expected_from_score(candidates: DataFrame, batch: str, score: str, minimum: float = 0.35, fallback: int = 10) -> DataFrame:
    """Candidates above the minimum, or the best ``fallback`` of a batch that has none; expected return from the score."""
    good = candidates.where(F.col(score) >= minimum)
    none = candidates.groupBy(batch).agg(F.max(F.coalesce((F.col(score) >= minimum).cast("int"), F.lit(0))).alias("_any")).where("_any = 0").select(batch)
    w = Window.partitionBy(batch).orderBy(F.desc(score), KEY)  # a group limit: ``fallback`` rows per batch and task
    best = candidates.join(none, batch, "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= fallback).drop("_r")
    return good.unionByName(best).withColumn("expected", (F.col(score) - 0.5) * 0.002)


def previous_asof(dates: DataFrame, stored: DataFrame, date: str = "date") -> DataFrame:
    """Latest stored date before each date: union, carry forward, no range join (one row per date)."""
    a = dates.select(F.col(date).alias("d"), F.lit(0).alias("s")).distinct()
    b = stored.select(F.col(date).alias("d"), F.lit(1).alias("s")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("d", "s").rowsBetween(Window.unboundedPreceding, -1)
    return a.unionByName(b).withColumn("previous", F.max(F.when(F.col("s") == 1, F.col("d"))).over(w)).where("s = 0").select(F.col("d").alias(date), "previous")


def dashboard_risk(max_sector: Column, max_dd: Column, regime_level: Column) -> Column:
    a = F.when(max_sector > 0.40, 3).when(max_sector > 0.30, 2).when(max_sector > 0.25, 1).otherwise(0)
    b = F.when(max_dd > 0.15, 3).when(max_dd > 0.10, 2).when(max_dd > 0.05, 1).otherwise(0)
    c = F.when(regime_level >= 5, 4).otherwise(F.greatest(F.lit(0), regime_level - 1))
    return F.least(F.lit(10), a + b + c)


def pnl_var(trades: DataFrame, group: Sequence[str], pnl: str = "pnl_pct", share: float = 0.05, min_n: int = 5, bucket: float = 0.1) -> DataFrame:
    """5th percentile of closed results by exact rank; zero below ``min_n`` trades."""
    c = trades.where(F.col(pnl).isNotNull())
    n = c.groupBy(*group).agg(F.count("*").alias("n"))
    r = running(c.withColumn("_b", F.floor(F.col(pnl) / bucket)).withColumn("_one", F.lit(1)), list(group), "_b", [pnl, "trade_id"], {"pos": "_one"})
    pick = r.join(n, list(group)).where(F.col("pos") == F.floor(F.col("n") * share) + 1).select(*group, F.abs(pnl).alias("_v"))
    return n.join(pick, list(group), "left").select(*group, "n", F.when(F.col("n") >= min_n, rnd("_v", 2)).otherwise(0.0).alias("var_pct"))
