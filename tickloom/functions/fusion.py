"""Signal fusion expressions: 13 nullable dimension scores to one calibrated probability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.typing import bands, clamp, dbl, present, rnd

# Dimension weights, interaction terms and calibration constants.
DIMENSION_WEIGHTS = {
    "technical_momentum": 0.12, "fundamentals": 0.10, "revenue_quality": 0.09, "shareholders": 0.06, "pledge_ratio": 0.07,
    "dividends": 0.08, "institutional_flow": 0.10, "signal_quality": 0.08, "microstructure": 0.07, "news_sentiment": 0.06,
    "cross_asset": 0.05, "earnings_quality": 0.07, "risk_management": 0.05,
}
DIMENSIONS = tuple(DIMENSION_WEIGHTS)
INTERACTIONS = (("technical_momentum", "microstructure", 0.03), ("earnings_quality", "fundamentals", 0.02))
SIGMOID_K, SIGMOID_X0 = 1.0, 50.0
DEFAULT_MEAN, DEFAULT_STD = 50.0, 16.7

Stats = Mapping[str, tuple[float, float]]


def zscore(raw: Column, mean: Column | float = DEFAULT_MEAN, std: Column | float = DEFAULT_STD) -> Column:
    m = mean if isinstance(mean, Column) else dbl(mean)
    s = std if isinstance(std, Column) else dbl(std)
    s = F.when(s > 0, s).otherwise(DEFAULT_STD)
    return F.coalesce(rnd(clamp((raw - m) / s, -3, 3), 4), dbl(0))


def denormalize(z: Column, mean: Column | float = DEFAULT_MEAN, std: Column | float = DEFAULT_STD) -> Column:
    return rnd(clamp(mean + z * std, 0, 100), 2)


def _total(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


def interaction(z: Mapping[str, Column]) -> Column:
    return _total([z[a] * z[b] * 0.1 * w for a, b, w in INTERACTIONS])


def weighted_sum(z: Mapping[str, Column], weights: Mapping[str, float] = DIMENSION_WEIGHTS) -> Column:
    return _total([z[d] * dbl(w) for d, w in weights.items()]) + interaction(z)


def probability(wsum: Column, total_weight: float = 1.0) -> Column:
    """Weighted z to the raw scale and through the sigmoid, unclamped."""
    return sigmoid(denormalize(wsum / dbl(total_weight)))


def sigmoid(raw: Column) -> Column:
    return dbl(1) / (dbl(1) + F.exp(-(raw - SIGMOID_X0) * SIGMOID_K / 25.0))


def final_probability(p: Column) -> Column:
    return rnd(clamp(p, 0.01, 0.99), 4)


def label(p: Column) -> Column:
    return bands(p, ((0.75, "strong_bullish"), (0.60, "bullish"), (0.45, "neutral"), (0.30, "bearish")), "strong_bearish", ">=")


TOTAL_WEIGHT = sum(DIMENSION_WEIGHTS.values())


def ensemble(z: Mapping[str, Column], raw: Mapping[str, Column]) -> Column:
    """struct(ensemble_score, raw_weighted_sum, raw_score_equivalent, dimensions_used, dimensions_missing, interaction_bonus, label)."""
    w = weighted_sum(z)
    p = final_probability(probability(w, TOTAL_WEIGHT))
    used = _total([raw[d].isNotNull().cast("int") for d in DIMENSIONS])
    return F.struct(
        p.alias("ensemble_score"), rnd(w, 4).alias("raw_weighted_sum"), denormalize(w / dbl(TOTAL_WEIGHT)).alias("raw_score_equivalent"),
        used.alias("dimensions_used"), present([F.when(raw[d].isNull(), F.lit(d)) for d in DIMENSIONS]).alias("dimensions_missing"),
        rnd(interaction(z), 4).alias("interaction_bonus"), label(p).alias("label"))


def importance(w: Column, base: Column, z: Mapping[str, Column]) -> Column:
    """Array of struct(dimension, contribution, rank) by falling absolute contribution.

    ``w`` is the weighted sum and ``base`` its final probability, both as plain
    columns. Taking a dimension out removes its own term and its interactions
    from the sum, so one formula runs over an array of 13 terms, a step at a
    time: rounding and clamping repeat their argument, and a step repeats a value only.
    """
    terms = []
    for i, (d, weight) in enumerate(DIMENSION_WEIGHTS.items()):
        t = z[d] * dbl(weight)
        for a, b, bonus in INTERACTIONS:
            if d in (a, b):
                t = t + z[a] * z[b] * 0.1 * bonus
        # every term carries the sum and the probability, so that they are computed once a row and not within the steps
        terms.append(F.struct(F.lit(i).alias("i"), F.lit(d).alias("dimension"), base.alias("base"), (w - t).alias("v")))

    def step(items, f):
        return F.transform(items, lambda x: F.struct(x["i"].alias("i"), x["dimension"].alias("dimension"), x["base"].alias("base"), f(x).alias("v")))

    rest = F.array(*terms)
    for f in (
        lambda x: DEFAULT_MEAN + x["v"] / dbl(TOTAL_WEIGHT) * DEFAULT_STD, lambda x: clamp(x["v"], 0, 100), lambda x: sigmoid(rnd(x["v"], 2)),
        lambda x: clamp(x["v"], 0.01, 0.99), lambda x: x["base"] - rnd(x["v"], 4),
    ):
        rest = step(rest, f)
    contribution = F.transform(rest, lambda x: F.struct(x["i"].alias("i"), x["dimension"].alias("dimension"), rnd(x["v"], 6).alias("c")))
    keyed = F.transform(contribution, lambda x: F.struct((-F.abs(x["c"])).alias("k"), x["i"].alias("i"), x["dimension"].alias("dimension"), x["c"].alias("contribution")))
    return F.transform(F.sort_array(keyed), lambda x, i: F.struct(x["dimension"].alias("dimension"), x["contribution"].alias("contribution"), (i + 1).alias("rank")))


def apply_mapping(p: Column, mapping: Column) -> Column:
    """First bin (array of struct input_min, input_max, output) that contains ``p``; a line through the ends otherwise."""
    hit = F.try_element_at(F.filter(mapping, lambda b: (p >= b["input_min"]) & (p <= b["input_max"])), F.lit(1))["output"]
    a, b = F.try_element_at(mapping, F.lit(1))["output"], F.try_element_at(mapping, F.lit(-1))["output"]
    line = F.when(F.size(mapping) >= 2, a + p * (b - a))
    return rnd(clamp(F.coalesce(hit, line, p), 0.01, 0.99), 4)


def extract_signals(c: Mapping[str, Column]) -> dict[str, Column]:
    """Dimension scores from a deep-dive row.

    ``c`` names: momentum, revenue, flow, stage1_score, checks (function of the
    check name), combined_score, sr_score, sentiment, cross_asset_adjustment, earnings_signal.
    """
    check = c["checks"]
    ann, pen = check("announcements"), check("penalties")
    n = ann.isNotNull().cast("int") + pen.isNotNull().cast("int")
    mood = c["sentiment"] * 60.0 + 60.0
    adj = c["cross_asset_adjustment"]
    return {
        "technical_momentum": F.coalesce(c["momentum"], c["stage1_score"]),
        "fundamentals": (F.coalesce(ann, dbl(0)) + F.coalesce(pen, dbl(0))) / F.nullif(n, F.lit(0)),
        "revenue_quality": c["revenue"], "shareholders": check("shareholders"), "pledge_ratio": check("pledge"), "dividends": check("dividend"),
        "institutional_flow": c["flow"], "signal_quality": rnd(clamp(c["combined_score"], 0, 100), 1),
        "microstructure": F.when(c["sr_score"].isNotNull(), rnd((c["sr_score"] + mood) / 2, 1)).when(c["sentiment"] != 0, rnd(mood, 1)),
        "news_sentiment": check("news_sentiment"),
        "cross_asset": F.when(adj != 0, clamp(rnd(adj * 10.0 + 60.0, 1), 0, 100)),
        "earnings_quality": check("earnings_growth"), "risk_management": clamp(rnd(c["earnings_signal"] * 133.0 + 60.0, 1), 0, 100),
    }
