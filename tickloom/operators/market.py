"""Market-level state per date: breadth, pooled volatility, regime, cross-asset signal.

All dates are computed in one plan. Nothing ranks or folds the whole panel in
one task: per-instrument windows first, then one row per date.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import params
from tickloom.functions.typing import above, clamp, dbl, lookup, rnd
from tickloom.operators.indicators import KEY, by_date, sma, with_sma


def breadth(bars: DataFrame, period: int = 20, value: str = "adj_close") -> DataFrame:
    """Share of instruments whose latest bar is above its SMA, for every date.

    An instrument keeps its last state until its next bar, so each bar only
    adds the change of its state to the date; a running sum over the dates
    gives the level. No instrument-by-date grid is built.
    """
    w = by_date()
    m = sma(value, period)
    ok = F.coalesce((m > 0) & (F.col(value) > 0), F.lit(False))
    state = bars.select(
        KEY, "date", ok.cast("long").alias("in"), (ok & above(value, m)).cast("long").alias("above")
    )
    step = state.select(
        "date",
        (F.col("in") - F.coalesce(F.lag("in").over(w), F.lit(0))).alias("d_in"),
        (F.col("above") - F.coalesce(F.lag("above").over(w), F.lit(0))).alias("d_above"),
    )
    per_date = step.groupBy("date").agg(F.sum("d_in").alias("d_in"), F.sum("d_above").alias("d_above"))
    run = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return per_date.select("date", F.sum("d_above").over(run).alias("above"), F.sum("d_in").over(run).alias("total")).withColumn(
        "breadth", F.when(F.col("total") > 0, F.col("above") / F.col("total")).otherwise(0.5)
    )


def numbered_days(bars: DataFrame) -> DataFrame:
    """(date, t, last_t): the dates with a bar, numbered from 0, and the last number (one row per date)."""
    days = bars.select("date").distinct()
    return days.select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("t")).withColumn("last_t", F.max("t").over(Window.partitionBy(F.lit(0))))


def instrument_state(bars: DataFrame, ex_days: DataFrame, max_gap_days: int, days: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Per bar: trailing volume, SMA flags and running return moments, with the trading days [from_t, until_t) of the state.

    ``parts`` is the number of partitions for the windows; without it Spark chooses.
    """
    w = by_date()
    # one row per date; broadcast, it leaves the bars where they are
    bars = bars.select(KEY, "date", "adj_close", "adj_volume").join(F.broadcast(numbered_days(bars) if days is None else days), "date")
    all_so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    prev, gap = F.lag("adj_close").over(w), F.datediff("date", F.lag("date").over(w))
    marked = bars.join(ex_days.select(KEY, F.col("ex_date").alias("date"), F.lit(True).alias("is_ex")), [KEY, "date"], "left")
    if parts:
        marked = marked.repartition(parts, KEY)
    ret = F.when((prev > 0) & (gap <= max_gap_days) & F.col("is_ex").isNull(), (F.col("adj_close") - prev) / prev)
    x = marked.withColumn("ret", ret).withColumn("n", F.row_number().over(w).cast("long"))
    flag = lambda p: F.coalesce((F.col("adj_close") > F.col(f"sma{p}")).cast("long"), F.lit(0))
    x = with_sma(x, (50, 150, 300)).withColumns({
        "vol20": F.avg("adj_volume").over(w.rowsBetween(-19, 0)),
        "above50": flag(50), "above150": flag(150), "above300": flag(300),
        "has50": (F.col("n") >= 50).cast("long"),
        "r_n": F.count("ret").over(all_so_far),
        "r_m": F.coalesce(F.avg("ret").over(all_so_far), dbl(0)),
        "r_v": F.coalesce(F.var_pop("ret").over(all_so_far), dbl(0)),
        "until_t": F.coalesce(F.lead("t").over(w), F.col("last_t") + 1),
    })
    return x.where("n >= 20").select(KEY, "date", F.col("t").alias("from_t"), "until_t", "n", "vol20", "above50", "above150", "above300", "has50", "r_n", "r_m", "r_v")


def blocks(states: DataFrame, start: str, end: str) -> DataFrame:
    """``states`` with (level, index), a row for each dyadic block of the days [start, end): two per level at the
    most, one for a single day. Block (k, i) is the days [i * 2**k, (i + 1) * 2**k)."""
    level = F.explode(F.sequence(F.lit(0), F.floor(F.log2((F.col(end) - F.col(start)).cast("double"))).cast("int")))
    x = states.withColumn("level", level).withColumn("_half", F.expr("shiftleft(1, level)"))
    # what lower levels leave to this one: whole blocks from _a up to _b; an odd end of it is a block of this level
    x = x.withColumn("_a", F.expr(f"shiftright({start} + _half - 1, level)")).withColumn("_b", F.expr(f"shiftright({end}, level)")).where("_a < _b and (_a % 2 = 1 or _b % 2 = 1)")
    odd = F.when(F.col("_a") % 2 == 0, F.array(F.col("_b") - 1)).when(F.col("_b") % 2 == 0, F.array("_a")).otherwise(F.array(F.col("_a"), F.col("_b") - 1))
    return x.withColumn("index", F.explode(odd)).drop("_a", "_b", "_half", start, end)


def leaders(state: DataFrame, days: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` instruments by trailing volume on every trading day (states last until the next bar).

    A state is cut into the dyadic blocks of its days, so it is one row where the
    next bar is the next day and a few after a gap, never one row per day. A state covers
    its blocks whole, so a block needs its ``top`` states only (a group limit before the
    shuffle); a day's leaders are among those of the blocks around it, one per level.
    """
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("vol20"), KEY))
    cut = blocks(state.drop("date"), "from_t", "until_t")
    best = cut.withColumn("_r", rank("level", "index")).where(F.col("_r") <= top).drop("_r")
    levels = F.sequence(F.lit(0), F.floor(F.log2((F.col("last_t") + 1).cast("double"))).cast("int"))
    around = days.select("date", "t", F.explode(levels).alias("level")).select("date", "level", F.expr("shiftright(t, level)").alias("index"))
    met = best.join(around, ["level", "index"]).drop("level", "index")
    return met.withColumn("_r", rank("date")).where(F.col("_r") <= top).drop("_r")


def market_state(bars: DataFrame, ex_days: DataFrame, max_gap_days: int = 3, top: int = 20, parts: int | None = None) -> DataFrame:
    """Per date: breadth, pooled volatility of the leaders, SMA ratios, global risk. ``parts``: partitions for the windows per instrument."""
    days = numbered_days(bars)
    lead = leaders(instrument_state(bars, ex_days, max_gap_days, days, parts), days, top)
    # counts, means and variances of the leaders merge without cancelling: within plus between
    n, by_date_ = F.sum("r_n"), Window.partitionBy("date")
    pooled = F.sum(F.col("r_n") * F.col("r_m")).over(by_date_) / F.nullif(n.over(by_date_), F.lit(0))
    lead = lead.withColumn("_gap", F.col("r_m") - pooled)
    agg = lead.groupBy("date").agg(
        F.count("*").alias("leaders"),
        F.when(n > 0, F.sqrt(F.sum(F.col("r_n") * (F.col("r_v") + F.col("_gap") * F.col("_gap"))) / F.nullif(n, F.lit(0)))).otherwise(0.0).alias("volatility"),
        F.sum("has50").alias("with50"), F.sum(F.col("above50") * F.col("has50")).alias("a50"),
        F.sum("above150").alias("a150"), F.sum("above300").alias("a300"),
    )
    ratio = lambda c: F.when(F.col("with50") > 0, F.col(c) / F.col("with50"))
    return (
        agg.join(breadth(bars.repartition(parts, KEY) if parts else bars).select("date", "breadth"), "date")
        .withColumns({"ratio50": ratio("a50"), "ratio150": ratio("a150"), "ratio300": ratio("a300")})
        .withColumn("global_risk", global_risk(F.col("breadth"), F.col("volatility")))
        .drop("a50", "a150", "a300")
    )


def global_risk(breadth_: Column, vol: Column) -> Column:
    return (
        F.when((breadth_ < 0.25) & (vol > 0.03), "extreme").when((breadth_ < 0.35) | (vol > 0.025), "high")
        .when((breadth_ > 0.7) & (vol < 0.015), "low").otherwise("moderate")
    )


def raw_regime(breadth_: Column, vol: Column, r50: Column, r150: Column, risk: Column) -> Column:
    """Tier of a date; the first rule that holds decides."""
    return (
        F.when(r50.isNull(), "unknown")
        .when(((breadth_ < 0.20) & (vol > 0.04)) | (vol > 0.05), "black_swan")
        .when(((risk == "extreme") & (r50 < 0.25)) | ((breadth_ < 0.25) & (vol > 0.03)) | ((r50 < 0.25) & (r150 < 0.30)), "crisis")
        .when(((r50 < 0.35) & (r150 < 0.40)) | ((risk == "high") & (r50 < 0.45)) | ((vol > 0.030) & (r50 < 0.45)), "stress")
        .when((r50 < 0.50) | ((vol > 0.022) & (r50 < 0.55)), "caution")
        .when((r50 > 0.6) & (r150 > 0.5), "normal")
        .otherwise("caution")
    )


def cross_asset_override(regime: Column, signal: Column, limit: float = 0.15) -> Column:
    """One tier worse or better for a strong signal, never into or out of the worst tier."""
    tiers = F.array(*[F.lit(t) for t in params.REGIME_TIERS])
    at = F.array_position(tiers, regime).cast("int")
    worse = F.when(at > 2, F.element_at(tiers, F.greatest(at - 1, F.lit(1)))).otherwise(regime)
    better = F.when(at.between(2, len(params.REGIME_TIERS) - 1), F.element_at(tiers, F.least(at + 1, F.lit(len(params.REGIME_TIERS))))).otherwise(regime)
    return F.when(at == 0, regime).when(signal < -limit, worse).when(signal > limit, better).otherwise(regime)


def next_regime(raw: str, prev: str | None, days: int, min_days: int = params.MIN_REGIME_DAYS) -> tuple[str, int]:
    """One step of the hysteresis rule, shared by the batch fold and the stream."""
    if prev is None or prev in params.LEGACY_REGIMES or raw == "black_swan":
        return raw, 1
    if days < min_days:
        return prev, days + 1
    return (raw, 1) if raw != prev else (raw, days + 1)


def regime_path(raw: DataFrame, market: str = "market", min_days: int = params.MIN_REGIME_DAYS) -> DataFrame:
    """Regime and days-in-regime along each market's dates.

    A market has one row per date, so the folded array is bounded by the calendar.
    """
    row = F.struct("date", "raw_regime")
    ordered = raw.groupBy(market).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    result = "array<struct<date:date,raw_regime:string,regime:string,days_in_regime:int>>"
    start = F.struct(F.lit(None).cast("string").alias("regime"), F.lit(0).alias("days"), F.array().cast(result).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        regime, days, new = acc["regime"], acc["days"], x["raw_regime"]
        fresh = regime.isNull() | regime.isin(*params.LEGACY_REGIMES) | (new == "black_swan")
        held = ~fresh & (days < min_days)
        kept = held | (~fresh & (new == regime))
        now = F.when(held, regime).otherwise(new)
        count = F.when(kept, days + 1).otherwise(1)
        return F.struct(now.alias("regime"), count.alias("days"), F.concat(acc["out"], F.array(F.struct(x["date"].alias("date"), new.alias("raw_regime"), now.alias("regime"), count.alias("days_in_regime")))).alias("out"))

    folded = F.aggregate("rows", start, step, lambda acc: acc["out"])
    return ordered.select(market, F.explode(folded).alias("r")).select(market, "r.*")


def data_quality(n_max: Column) -> Column:
    return F.struct(
        F.when(n_max < 240, "INSUFFICIENT_300D").otherwise("OK").alias("data_quality"),
        F.when(n_max < 240, "low").when(n_max < 270, "medium").otherwise("high").alias("confidence"),
    )


def position_multiplier(regime: Column, table: Mapping[str, float] = params.POSITION_MULTIPLIER) -> Column:
    return lookup(regime, table, 0.0)


def regime_weight(regime: Column, dimension: str) -> Column:
    """Score weight of a dimension under a regime; base weights where the regime has none."""
    return lookup(regime, {r: w[dimension] for r, w in params.REGIME_WEIGHTS.items()}, params.STAGE1_WEIGHTS[dimension])


def advance_decline(passed: Column, watch: Column, rejected: Column) -> Column:
    total = passed + watch + rejected
    ratio = F.when(total == 0, 1.0).when(rejected > 0, rnd((passed + watch) / F.nullif(rejected, F.lit(0)), 3)).otherwise(2.0)
    label = F.when(total == 0, "no_data").when(ratio >= 1.5, "strong").when(ratio >= 1.0, "normal").when(ratio >= 0.5, "weak").otherwise("very_weak")
    return F.struct(ratio.alias("ad_ratio"), label.alias("label"))


def wide_series(series: DataFrame, names: list[str], key: str = "series", value: str = "close") -> DataFrame:
    """One column per named series on each date of any series (single pass, no self joins)."""
    return series.groupBy("date").agg(
        *[F.max(F.when(F.col(key) == n, F.nullif(F.col(value), dbl(0)))).alias(n) for n in names]
    )


def pair_correlation(wide: DataFrame, a: str, b: str, sign: float = 1.0) -> DataFrame:
    """Pearson correlation of date-aligned returns of two columns; 0 below three returns."""
    both = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("date", F.col(a).alias("a"), F.col(b).alias("b"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    ret = lambda c: (F.col(c) - F.lag(c).over(w)) / F.lag(c).over(w)
    r = both.select(ret("a").alias("ra"), ret("b").alias("rb")).where("ra is not null and rb is not null")
    corr = F.when(F.count("*") >= 3, rnd(F.coalesce(F.corr("ra", "rb"), dbl(0)) * sign, 4)).otherwise(0.0)
    return r.agg(F.lit(f"{a}_vs_{b}").alias("pair"), corr.alias("correlation"), F.count("*").alias("n"))


def cross_asset_parts(vix: Column, fx_level: Column, fx_change: Column, peer_level: Column, peer_change: Column, index_change: Column) -> Column:
    """struct(risk, fx, divergence): the parts of the cross-asset signal."""
    risk = F.when(vix > 0, F.when(vix < 15, 0.1).when(vix > 25, -0.1).otherwise(rnd(dbl(0.1) - (vix - 15) * 0.02, 4))).otherwise(0.0)
    fx = F.when(fx_level.isNotNull(), F.when(fx_change < -0.5, -0.1).when(fx_change > 0.5, 0.05).otherwise(0.0)).otherwise(0.0)
    spread = peer_change - index_change
    div = F.when(peer_level.isNotNull(), F.when(spread < -2, -0.05).when(spread > 2, 0.05).otherwise(0.0)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, dbl(0))
    return F.struct(zero(risk).alias("risk"), zero(fx).alias("fx"), zero(div).alias("divergence"))


def signal_of(parts: Column) -> Column:
    return clamp(rnd(parts["risk"] + parts["fx"] + parts["divergence"], 4), -0.2, 0.2)


def cross_asset_signal(vix: Column, fx_level: Column, fx_change: Column, peer_level: Column, peer_change: Column, index_change: Column) -> Column:
    return signal_of(cross_asset_parts(vix, fx_level, fx_change, peer_level, peer_change, index_change))


def sector_series(bars: DataFrame, sectors: DataFrame, value: str = "close") -> DataFrame:
    """Mean value per sector and date."""
    tagged = bars.join(sectors.select(KEY, "sector"), KEY, "left")
    return tagged.groupBy(F.coalesce("sector", F.lit("other")).alias("sector"), "date").agg(F.avg(value).alias("close"))


def sector_correlation(returns: DataFrame, sectors: DataFrame, lookback: int = 60, min_n: int = 10) -> DataFrame:
    """Correlation matrix of mean daily sector returns over the last ``lookback`` dates."""
    daily = sector_series(returns, sectors, "ret").withColumnRenamed("close", "ret")
    recent = daily.select("date").distinct().orderBy(F.desc("date")).limit(lookback)
    d = daily.join(recent, "date", "left_semi")
    a, b = d.alias("a"), d.alias("b")
    # rows: sectors squared times lookback; the matrix itself is the result
    pairs = a.join(b, F.col("a.date") == F.col("b.date")).groupBy(
        F.col("a.sector").alias("sector_a"), F.col("b.sector").alias("sector_b")
    ).agg(F.corr("a.ret", "b.ret").alias("c"), F.count("*").alias("n"))
    return pairs.select(
        "sector_a", "sector_b",
        F.when(F.col("sector_a") == F.col("sector_b"), 1.0).when(F.col("n") >= min_n, rnd(F.coalesce("c", dbl(0)), 3)).otherwise(0.0).alias("correlation"),
        "n",
    )
