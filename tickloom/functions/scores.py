"""Cross-sectional scores as Column expressions. A missing record scores the neutral 25."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.typing import bands, clamp, dbl, present, rnd

NEUTRAL = 25.0
DIMENSIONS = ("revenue", "profitability", "valuation", "flow", "momentum")


def revenue_momentum(yoy: Column, mom: Column, found: Column) -> Column:
    yoy, mom = F.coalesce(yoy, dbl(0)), F.coalesce(mom, dbl(0))
    pts = (
        dbl(50)
        + F.when(yoy > 50, 30.0).when(yoy > 20, 20.0).when(yoy > 0, 10.0).when(yoy < -20, -30.0).otherwise(-10.0)
        + F.when(mom > 20, 20.0).when(mom > 5, 10.0).when(mom < -20, -20.0).otherwise(-5.0)
    )
    return F.when(found, clamp(pts, 0, 100)).otherwise(NEUTRAL)


def profitability(pe: Column, found: Column) -> Column:
    by_pe = bands(pe, ((12, 100.0), (18, 75.0), (25, 50.0), (35, 25.0)), 0.0, "<")
    return F.when(~found, NEUTRAL).when(pe > 0, by_pe).otherwise(0.0)


def valuation(pe: Column, pb: Column, found: Column) -> Column:
    s_pe = F.when(pe > 0, bands(pe, ((15, 100.0), (20, 75.0), (30, 50.0), (40, 25.0)), 0.0, "<")).otherwise(0.0)
    s_pb = F.when(pb > 0, bands(pb, ((1.5, 100.0), (2.5, 75.0), (4, 50.0)), 25.0, "<")).otherwise(0.0)
    n = (s_pe > 0).cast("int") + (s_pb > 0).cast("int")
    return F.when(found & (n > 0), (s_pe + s_pb) / F.nullif(n, F.lit(0))).otherwise(NEUTRAL)


def institutional_flow(
    foreign: Column, trust: Column, total: Column, has_flow: Column,
    margin_buy: Column, short_sell: Column, short_balance: Column, has_margin: Column,
) -> Column:
    by_flow = F.when(
        total > 0, F.when((foreign > 0) & (trust > 0), 100.0).when((foreign > 0) | (trust > 0), 60.0).otherwise(40.0)
    ).otherwise(F.when((foreign < 0) & (trust < 0), 0.0).otherwise(30.0))
    net, short = margin_buy - short_sell, F.greatest(short_balance, dbl(0))
    by_margin = clamp(
        dbl(50)
        + F.when(net > 1e6, 20.0).when(net > 1e5, 10.0).when(net < -1e6, -20.0).when(net < -1e5, -10.0).otherwise(0.0)
        + F.when(short > 1e6, -15.0).when(short < 1e4, 5.0).otherwise(0.0),
        0, 100,
    )
    return F.coalesce(F.when(has_flow, by_flow), F.when(has_margin, by_margin), dbl(NEUTRAL))


def ownership_flow(pct: Column, holders: Column, insider: Column, found: Column, margin_buy: Column, margin_sell: Column) -> Column:
    """Flow score from ownership shares; the buy/sell margin ratio stands in when there is none."""
    pts = (
        dbl(50)
        + F.when(pct > 0.5, 20.0).when(pct > 0.3, 10.0).when(pct < 0.1, -10.0).otherwise(0.0)
        + F.when(holders > 100, 10.0).when(holders > 50, 5.0).when(holders < 10, -10.0).otherwise(0.0)
        + F.when(insider > 0.1, 10.0).when(insider < 0.01, -5.0).otherwise(0.0)
    )
    ratio = margin_buy / F.nullif(margin_sell, dbl(0))
    by_margin = F.when(margin_sell > 0, F.when(ratio > 1.5, 70.0).when(ratio > 1, 60.0).when(ratio < 0.5, 30.0).otherwise(40.0)).otherwise(50.0)
    return F.when(found, clamp(pts, 0, 100)).when(margin_sell.isNotNull(), by_margin).otherwise(NEUTRAL)


def composite(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    terms = [scores[d] * dbl(weights[d]) for d in weights]
    return sum(terms[1:], terms[0])


def signal_strength(scores: Mapping[str, Column], total: Column) -> Column:
    """struct(strength, conviction, grade, dominant_dimension, alignment)."""
    cols = list(scores.values())
    n = float(len(cols))
    mean = sum(cols[1:], cols[0]) / n
    sq = [(c - mean) * (c - mean) for c in cols]
    alignment = F.greatest(dbl(0), dbl(1) - sum(sq[1:], sq[0]) / n / 2500.0)
    wide = sum([(c >= 40).cast("double") for c in cols[1:]], (cols[0] >= 40).cast("double")) / n
    # scores have few decimals, so the sum may lie halfway; it is snapped first, and the order of addition cannot flip the rounding
    strength = rnd(rnd(clamp(total * 0.60 + alignment * 100 * 0.25 + wide * 100 * 0.15, 0, 100), 6), 1)
    top = F.greatest(*cols)
    lead = F.coalesce(*[F.when(c == top, F.lit(k)) for k, c in scores.items()])
    return F.struct(
        strength.alias("strength"),
        bands(strength, ((85, "very_high"), (70, "high"), (50, "moderate"), (30, "low")), "very_low", ">=").alias("conviction"),
        bands(strength, ((90, "A+"), (80, "A"), (70, "B+"), (55, "B"), (40, "C")), "D", ">=").alias("grade"),
        lead.alias("dominant_dimension"),
        rnd(rnd(alignment, 6), 3).alias("alignment"),
    )


def _part(score: Column, *factors: Column) -> Column:
    return F.struct(rnd(clamp(score, 0, 100), 1).alias("confidence"), present(factors).alias("factors"))


def _pick(*cases):
    """(points, label) of the first true case as two columns; the last case may be (None, points, label)."""
    pts = label = None
    for cond, p, l in cases:
        lit = F.lit(l).cast("string") if not isinstance(l, Column) else l
        val = p if isinstance(p, Column) else dbl(p)
        if cond is None:
            return (val, lit) if pts is None else (pts.otherwise(val), label.otherwise(lit))
        pts = F.when(cond, val) if pts is None else pts.when(cond, val)
        label = F.when(cond, lit) if label is None else label.when(cond, lit)
    return pts.otherwise(dbl(0)), label.otherwise(F.lit(None).cast("string"))


def signal_confidence(c: Mapping[str, Column]) -> Column:
    """Map of dimension to struct(confidence, factors).

    ``c`` names: n_bars, zero_closes, pe, pb, dividend_yield, has_val, has_company,
    regime, flow_feed, has_margin, adv, has_rev, rev_yoy, rev_mom.
    """
    n = F.coalesce(c["n_bars"], F.lit(0))
    p1, f1 = _pick((n == 0, -20.0, "no_price_history"), (n >= 252, 25.0, "1yr+_history"), (n >= 60, 15.0, "60d+_history"),
                   (n >= 20, 5.0, "20d+_history"), (None, -10.0, "short_history"))
    miss = c["zero_closes"] / 20.0
    p2, f2 = _pick((n < 20, 0.0, None), (miss > 0.1, -miss * 30.0, F.concat(F.lit("missing_data_"), F.round(miss * 100).cast("int").cast("string"), F.lit("%"))),
                   (None, 10.0, "complete_data"))
    r = c["regime"]
    p3, f3 = _pick((r.isin("stress", "crisis", "black_swan"), -20.0, F.concat(F.lit("low_confidence_regime:"), r)),
                   (r == "caution", -5.0, "caution_regime"), (r == "normal", 5.0, "normal_regime"))
    tech = rnd(clamp(dbl(50) + p1 + p2, 0, 100), 1) + p3

    has = lambda x: x.isNotNull()
    filled = F.when(has(c["pe"]), 10.0).otherwise(0.0) + F.when(has(c["pb"]), 10.0).otherwise(0.0) + F.when(has(c["dividend_yield"]), 5.0).otherwise(0.0)
    p4, f4 = _pick((~c["has_val"], -20.0, "no_pe_data"), (has(c["pe"]) & has(c["pb"]), filled, "full_pe_data"), (None, filled, "partial_pe_data"))
    p5, f5 = _pick((c["has_company"], 15.0, "company_info_available"), (None, -10.0, "no_company_info"))
    fund = dbl(50) + p4 + p5

    p6, f6 = _pick((c["flow_feed"], 20.0, "inst_flow_available"))
    p7, f7 = _pick((c["has_margin"], 10.0, "margin_data_available"), (None, -5.0, "no_margin_data"))
    p8, f8 = _pick((n < 20, 0.0, None), (c["adv"] < 100e6, -15.0, "borderline_adv"), (c["adv"].isNotNull(), 10.0, "healthy_adv"))

    yoy, mom = F.coalesce(c["rev_yoy"], dbl(0)), F.coalesce(c["rev_mom"], dbl(0))
    ok = c["has_rev"]
    p9, f9 = _pick((~ok, -25.0, "no_revenue_data"), (None, 20.0, None))
    p10, f10 = _pick((ok & has(c["rev_yoy"]), 10.0, "yoy_available"))
    p11, f11 = _pick((ok & has(c["rev_mom"]), 5.0, "mom_available"))
    against = ((yoy > 10) & (mom < -10)) | ((yoy < -10) & (mom > 10))
    p12, f12 = _pick((~ok, 0.0, None), (against, -10.0, "contradictory_yoy_mom"), (None, 0.0, "consistent_yoy_mom"))
    return F.create_map(
        F.lit("momentum"), _part(tech, f1, f2, f3),
        F.lit("profitability"), _part(fund, f4, f5),
        F.lit("valuation"), _part(fund - 5.0, f4, f5),
        F.lit("flow"), _part(dbl(50) + p6 + p7 + p8, f6, f7, f8),
        F.lit("revenue"), _part(dbl(50) + p9 + p10 + p11 + p12, f9, f10, f11, f12),
    )


def false_signals(scores: Mapping[str, Column], vol_recent: Column, vol_older: Column, n_bars: Column, days_since_ex: Column) -> Column:
    """struct(flags, is_contradictory, flag_count, high_severity_count)."""
    tech, flow, rev = scores["momentum"], scores["flow"], scores["revenue"]
    fund = (scores["profitability"] + scores["valuation"]) / 2.0

    def flag(cond: Column, kind: str, severity: str, dims: tuple[str, ...]) -> Column:
        return F.when(cond, F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.array(*[F.lit(d) for d in dims]).alias("dimensions")))

    ratio = F.when((n_bars >= 10) & (vol_older > 0) & (vol_recent > 0), vol_recent / F.nullif(vol_older, dbl(0)))
    three, fm = ("momentum", "profitability", "valuation"), ("momentum", "flow")
    flags = present([
        F.coalesce(flag((tech >= 70) & (fund < 35), "contrarian", "high", three), flag((tech >= 60) & (fund < 40), "contrarian", "medium", three)),
        F.coalesce(flag((tech >= 60) & (ratio < 0.6), "fading_momentum", "high", fm), flag((tech >= 60) & (ratio < 0.8), "fading_momentum", "medium", fm)),
        flag((tech >= 65) & (flow < 30), "unconfirmed_momentum", "medium", fm),
        F.coalesce(
            flag((rev < 30) & (tech >= 60), "revenue_price_divergence", "high", ("revenue", "momentum")),
            flag((rev >= 70) & (tech < 30), "revenue_price_divergence", "medium", ("revenue", "momentum"))),
        flag(days_since_ex.between(0, 30), "recent_ex_dividend", "medium", ("momentum",)),
    ])
    high = F.size(F.filter(flags, lambda f: f["severity"] == "high"))
    return F.struct(
        flags.alias("flags"), ((high >= 1) | (F.size(flags) >= 3)).alias("is_contradictory"),
        F.size(flags).alias("flag_count"), high.alias("high_severity_count"))
