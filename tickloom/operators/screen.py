"""Cross-sectional screening: hard filters, composite, buckets, weight smoothing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import params
from tickloom.functions import scores as sc
from tickloom.functions.typing import clamp, dbl, rnd, second_board


def hard_filter_reason(as_of: dt.date, th: Mapping[str, float] | None = None) -> Column:
    """First failing rule of a candidate row, null when it passes.

    Row columns: code, close, adv, n_bars, has_company, paid_in_capital,
    list_date, max_pledged, last_penalty, list_reason.
    """
    th = {**params.THRESHOLDS, **(th or {})}
    c = F.col
    now = F.lit(as_of)
    shares = c("paid_in_capital") / 10.0
    cap = F.when(c("has_company"), c("close") * F.greatest(shares, dbl(0))).otherwise(c("close") * 1e9)
    floor = F.when(c("has_company") & second_board(c("code")), dbl(th["min_market_cap_second"])).otherwise(dbl(th["min_market_cap"]))
    why = lambda cond, name: F.when(cond, F.lit(name))
    return F.coalesce(
        why(F.coalesce(c("close"), dbl(0)) == 0, "no_closing_price"),
        why((c("n_bars") > 0) & c("adv").isNull(), "insufficient_liquidity_no_data"),
        why((c("n_bars") >= 20) & (c("adv") < th["min_adv"]), "insufficient_liquidity_twd"),
        why((c("n_bars") > 0) & (c("n_bars") < 20) & (c("adv") < th["min_adv"] * 0.5), "insufficient_liquidity_twd_short"),
        why(cap < floor, "market_cap_too_small"),
        why((c("close") < th["price_floor"]) | (c("close") > th["price_ceiling"]), "price_out_of_range"),
        why(c("has_company") & (F.datediff(now, c("list_date")) / 365.0 < th["min_listing_years"]), "too_new_listing"),
        why(c("has_company") & (shares > 0) & (c("max_pledged") / F.nullif(shares, dbl(0)) > th["max_pledge_ratio"]), "high_pledge_risk"),
        why(F.datediff(now, c("last_penalty")) < th["penalty_days"], "recent_penalty"),
        c("list_reason"),
    )


def score_columns() -> dict[str, Column]:
    c = F.col
    return {
        "revenue": sc.revenue_momentum(c("rev_yoy"), c("rev_mom"), c("has_rev")),
        "profitability": sc.profitability(c("pe"), c("has_val")),
        "valuation": sc.valuation(c("pe"), c("pb"), c("has_val")),
        "flow": sc.institutional_flow(
            c("foreign_net"), c("trust_net"), c("total_net"), c("has_flow"),
            c("margin_buy"), c("short_sell"), c("short_balance"), c("has_margin")),
        "momentum": F.coalesce(c("momentum"), dbl(sc.NEUTRAL)),
    }


def regime_thresholds(regime: Column, base_pass: float, base_watch: float) -> Column:
    """struct(pass_threshold, watchlist_threshold, regime_adjustment)."""
    p = F.when(regime == "stress", F.least(dbl(100), dbl(base_pass + 15))).when(
        regime == "crisis", F.greatest(dbl(base_pass), dbl(80))).when(regime == "black_swan", 100.0).otherwise(base_pass)
    w = F.when(regime == "stress", F.least(dbl(100), dbl(base_watch + 15))).when(
        regime == "crisis", F.greatest(dbl(base_watch), dbl(65))).when(regime == "black_swan", 95.0).otherwise(base_watch)
    adj = F.when(regime == "stress", 15.0).when(regime.isin("crisis", "black_swan"), p - base_pass).otherwise(0.0)
    return F.struct(p.alias("pass_threshold"), w.alias("watchlist_threshold"), adj.alias("regime_adjustment"))


def screen(rows: DataFrame, as_of: dt.date, regime: str = "normal", th: Mapping[str, float] | None = None,
           weights: Mapping[str, float] | None = None) -> DataFrame:
    """Reason, scores, composite with microstructure points and bucket for every row, in one projection chain."""
    weights = weights or params.STAGE1_WEIGHTS
    limits = {**params.THRESHOLDS, **(th or {})}
    t = regime_thresholds(F.lit(regime), limits["pass"], limits["watchlist"])
    names = list(weights)
    scored = rows.withColumn("reason", hard_filter_reason(as_of, th)).withColumns(score_columns())
    raw = sc.composite({d: F.col(d) for d in names}, weights)
    micro = clamp(F.coalesce(F.col("timing_adjustment"), dbl(0)) + F.coalesce(F.col("volume_adjustment"), dbl(0)), -10, 10)
    scored = scored.withColumn("_raw", raw).withColumn("_micro", micro).withColumn("_adj", F.col("_raw") + F.col("_micro"))
    bucket = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_adj") >= t["pass_threshold"], "pass").when(
        F.col("_adj") >= t["watchlist_threshold"], "watchlist").otherwise("rejected")
    return (
        scored.withColumn("composite_raw", rnd("_raw", 1)).withColumn("micro_adjustment", rnd("_micro", 1))
        .withColumn("composite_score", rnd("_adj", 1)).withColumn("bucket", bucket).drop("_raw", "_micro", "_adj")
    )


def bucket_counts(screened: DataFrame) -> DataFrame:
    return screened.groupBy("bucket").agg(F.count("*").alias("instruments"))


def top_ranked(screened: DataFrame, n: int, score: str = "composite_score") -> DataFrame:
    """Best ``n`` passing rows; a sort with a limit, so each task keeps only ``n`` rows."""
    return screened.where("bucket = 'pass'").orderBy(F.desc(score), "instrument").limit(n)


def smooth_weights(
    w: DataFrame, group: str, max_change: float = params.MAX_WEIGHT_CHANGE,
    lo: float = params.MIN_WEIGHT, hi: float = params.MAX_WEIGHT,
) -> DataFrame:
    """Move previous weights toward new ones, at most ``max_change`` per key.

    Rows are (group, key, prev, new) with null for a missing side. Both sides are
    normalised, steps and bounds are clamped, what is left over goes to the keys
    that were not clamped, and the set is normalised again.
    """
    g = Window.partitionBy(group)
    norm = lambda c: F.when(F.sum(c).over(g) > 0, F.col(c) / F.sum(c).over(g)).otherwise(F.col(c))
    x = w.withColumn("_p", norm("prev")).withColumn("_n", norm("new")).where(F.col("new").isNotNull())
    step = F.col("_n") - F.col("_p")
    x = x.withColumn(
        "_s", F.when(F.col("_p").isNull() | (F.abs(step) <= max_change), F.col("_n")).otherwise(F.col("_p") + F.signum(step) * max_change)
    ).withColumn("_c", (F.col("_p").isNotNull() & (F.abs(step) > max_change)) | (F.col("_s") < lo) | (F.col("_s") > hi))
    x = x.withColumn("_s", clamp(F.col("_s"), lo, hi))
    total, free = F.sum("_s").over(g), F.sum((~F.col("_c")).cast("long")).over(g)
    x = x.withColumn("_t", total).withColumn("_f", free)
    x = x.withColumn(
        "_s",
        F.when((F.abs(F.col("_t") - 1.0) > 1e-6) & ~F.col("_c") & (F.col("_f") > 0),
               F.greatest(dbl(lo), F.col("_s") + (dbl(1) - F.col("_t")) / F.col("_f"))).otherwise(F.col("_s")),
    )
    return x.withColumn("weight", F.col("_s") / F.sum("_s").over(g)).drop("_p", "_n", "_s", "_c", "_t", "_f")


def sector_concentration(rows: DataFrame, sector: str = "sector", limit: float = params.MAX_SECTOR_SHARE) -> DataFrame:
    """Share of rows per sector and whether the largest share is within the limit."""
    counts = rows.groupBy(F.coalesce(sector, F.lit("other")).alias("sector")).agg(F.count("*").alias("n"))
    # the window runs over one row per sector
    w = Window.partitionBy(F.lit(0))
    return counts.select(
        "sector", "n", rnd(F.col("n") / F.sum("n").over(w), 2).alias("share"), (F.max("n").over(w) / F.sum("n").over(w) <= limit).alias("ok")
    )
