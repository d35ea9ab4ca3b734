"""Trade simulation, backtest statistics and portfolio rules.

Trades walk over a slice of the array of their instrument's bars. Ordered
statistics over trades (curve, peak, drawdown) are two-level scans: inside a
chunk such as a date first, then over one row per chunk, so no strategy is
pulled into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.typing import clamp, dbl, rnd
from tickloom.operators.indicators import KEY, atr_stop


def running(
    df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column | str],
    sums: Mapping[str, str] | None = None, peaks: Mapping[str, tuple[str, str, float | None]] | None = None,
) -> DataFrame:
    """Running sums and running peaks of running sums in (chunk, order) order per group.

    ``sums`` maps output name to column. ``peaks`` maps output name to
    (column, sum name, start): the running maximum of the running sum ``sum
    name`` of ``column``, starting from ``start`` (None: from the first value).
    Only chunk totals cross chunk borders.
    """
    sums, peaks = dict(sums or {}), dict(peaks or {})
    wl = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df
    for out, c in sums.items():
        x = x.withColumn(f"_l_{out}", F.sum(c).over(wl))
    for out, (_, s, _) in peaks.items():
        x = x.withColumn(f"_p_{out}", F.max(f"_l_{s}").over(wl))
    aggs = [F.sum(c).alias(f"_t_{out}") for out, c in sums.items()] + [F.max(f"_l_{s}").alias(f"_m_{out}") for out, (_, s, _) in peaks.items()]
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    tot = x.groupBy(*group, chunk).agg(*aggs)
    for out in sums:
        tot = tot.withColumn(f"_b_{out}", F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)))
    for out, (_, s, start) in peaks.items():
        seen = F.max(F.col(f"_b_{s}") + F.col(f"_m_{out}")).over(before)
        tot = tot.withColumn(f"_q_{out}", F.greatest(seen, dbl(start)) if start is not None else seen)
    keep = [f"_b_{o}" for o in sums] + [f"_q_{o}" for o in peaks]
    x = x.join(tot.select(*group, chunk, *keep), [*group, chunk])
    for out, (_, s, _) in peaks.items():
        x = x.withColumn(out, F.greatest(F.col(f"_q_{out}"), F.col(f"_b_{s}") + F.col(f"_p_{out}")))
    for out in sums:
        x = x.withColumn(out, F.col(f"_b_{out}") + F.col(f"_l_{out}"))
    return x.drop(*[c for c in x.columns if c.startswith(("_l_", "_p_", "_b_", "_q_"))])


def select_entries(
    candidates: DataFrame, batch: str, max_positions: int = 8, per_sector: int = 3, reward: float = 2.0,
    atr_mult: float = 2.5, post_holiday_mult: float = 1.3,
) -> DataFrame:
    """Best candidates of each batch with stops and targets.

    Rows: batch, instrument, score, sector, entry_price, regime_mult, atr,
    post_holiday, gap_days. Rank per batch first (group limit), then per sector.
    """
    rank = Window.partitionBy(batch).orderBy(F.desc("score"), KEY)
    in_sector = Window.partitionBy(batch, "sector").orderBy(F.desc("score"), KEY)
    top = candidates.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_positions)
    top = top.where((F.col("rank") <= F.floor(F.col("regime_mult") * max_positions)) & (F.col("entry_price") > 0))
    top = top.withColumn("_s", F.row_number().over(in_sector)).where(F.col("_s") <= per_sector).drop("_s")
    mult = F.when(F.col("post_holiday") & (F.col("gap_days") >= 4), dbl(atr_mult * post_holiday_mult)).otherwise(dbl(atr_mult))
    stop = atr_stop(F.col("entry_price"), F.col("atr"), mult)
    target = F.col("entry_price") + (F.col("entry_price") - F.col("stop_loss")) * reward
    return top.withColumn("stop_loss", stop).withColumn("take_profit", rnd(target, 2)).withColumn(
        "stop_type", F.when(F.col("atr") > 0, "atr").otherwise("fixed_pct"))


def price_path(bars: DataFrame, trading_days: DataFrame | None = None) -> DataFrame:
    """Bars (instrument, date, ord, n_bars, price, cash_div, stock_div) numbered by trading bar.

    Adds ``t`` (trading bars so far), ``n_t`` (all of them), ``is_trading``,
    ``is_ex`` and ``time_t``: the first trading bar from here on that may be a
    time exit (ex-dates may not).
    """
    x = bars
    if trading_days is not None:
        x = x.join(trading_days.select("date", F.lit(True).alias("_td")), "date", "left").withColumn(
            "is_trading", F.coalesce(F.col("_td"), F.lit(False))).drop("_td")
    else:
        x = x.withColumn("is_trading", F.lit(True))
    w = Window.partitionBy(KEY).orderBy("date")
    back = Window.partitionBy(KEY).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("is_ex", F.col("cash_div").isNotNull()).withColumn("t", F.sum(F.col("is_trading").cast("long")).over(w))
    can_exit = F.when(F.col("is_trading") & ~F.col("is_ex"), F.col("t"))
    return x.withColumn("time_t", F.min(can_exit).over(back)).withColumn("n_t", F.max("t").over(Window.partitionBy(KEY)))


def simulate_exits(trades: DataFrame, path: DataFrame, max_days: int = 20, end_reason: str = "max_holding_days") -> DataFrame:
    """First stop, target or time exit of every trade; the stop wins a tie on the same bar.

    Trades carry instrument, entry_ord, stop_loss, take_profit. A trade without
    any exit closes ``max_days`` bars later or on the last bar. The bars of an
    instrument, numbered from 1 without gaps and bounded by the calendar, meet
    its trades as one array, so nothing fans out and each side is shuffled once.
    """
    # the bar from which a trade entered here may close by time, as an ordinal; rows share a ``t`` with the trading bar before them
    ahead = Window.partitionBy(KEY).orderBy("t").rangeBetween(max_days, max_days)
    can_exit = F.when(F.col("is_trading") & ~F.col("is_ex"), F.col("ord"))
    back = Window.partitionBy(KEY).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    check = F.when(F.col("is_ex"), (F.col("price") + F.col("cash_div")) * (dbl(1) + F.col("stock_div") / 10.0)).otherwise(F.col("price"))
    x = path.withColumn("_out", F.min(can_exit).over(back)).withColumn("_end", F.max(F.when(F.col("is_trading"), F.col("_out"))).over(ahead))
    bar = F.struct(F.col("ord").cast("int").alias("ord"), F.col("_end").cast("int").alias("end"), F.col("t").cast("int").alias("t"), "is_trading", "is_ex", "date", "price", check.alias("p"))
    bars = x.groupBy(KEY).agg(F.sort_array(F.collect_list(bar)).alias("_bars"))
    mine = trades.groupBy(KEY).agg(F.collect_list(F.struct(*trades.columns)).alias("_trades"))
    n = F.size("_bars")

    def leaves(price: Column, reason: str, date: Column) -> Column:
        return F.struct(price.alias("exit_price"), F.lit(reason).alias("exit_reason"), date.alias("exit_date"))

    def event(tr: Column, entry: Column, b: Column) -> Column:
        hit = F.when(b["p"] <= tr["stop_loss"], leaves(tr["stop_loss"], "stop_loss", b["date"])).when(
            b["p"] >= tr["take_profit"], leaves(tr["take_profit"], "take_profit", b["date"])).when(
            ~b["is_ex"] & (b["t"] - entry["t"] >= max_days), leaves(b["price"], "max_holding_days", b["date"]))
        return F.when(b["is_trading"], hit)

    def close(tr: Column) -> Column:
        at = tr["entry_ord"].cast("int")
        entry, last = F.get("_bars", at - 1), F.get("_bars", F.least(at + max_days, n) - 1)
        walk = F.slice("_bars", at + 1, F.greatest(F.coalesce(entry["end"], n) - at, F.lit(0)))
        first = F.get(F.filter(F.transform(walk, lambda b: event(tr, entry, b)), lambda e: e.isNotNull()), 0)
        return F.struct(tr.alias("tr"), F.coalesce(first, leaves(last["price"], end_reason, last["date"])).alias("e"))

    # an entry on a bar that is not there is no trade
    there = F.filter("_trades", lambda tr: tr["entry_ord"].between(1, n))
    return mine.join(bars, KEY).select(F.explode(F.transform(there, close)).alias("x")).select("x.tr.*", "x.e.*")


def exit_step(price: Column, stop: Column, target: Column, holding_days: Column, max_days: int = 20) -> Column:
    """One-step exit decision: struct(exit_price, exit_reason), null fields while held."""
    none = F.lit(None)
    px = F.when(price <= stop, stop).when(price >= target, target).when(holding_days >= max_days, price).otherwise(none.cast("double"))
    why = F.when(price <= stop, "stop_loss").when(price >= target, "take_profit").when(holding_days >= max_days, "max_holding_days")
    return F.struct(px.alias("exit_price"), why.alias("exit_reason"))


def exact_mean(c: Column | str) -> Column:
    """Mean of values with few decimals; the sum is snapped first, so the order of addition cannot flip a later rounding."""
    return rnd(F.sum(c), 6) / F.count(c)


def net_pnl(entry: Column, exit_: Column, cost: Column) -> Column:
    """Net percent result, unrounded."""
    return ((exit_ - entry) / entry - cost) * 100


def equity_curve(trades: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column | str], pnl: str = "net") -> DataFrame:
    """Cumulative result, running peak (from zero), running maximum, drawdown and position after every trade."""
    out = running(
        trades.withColumn("_one", F.lit(1)), group, chunk, order, {"cumulative": pnl, "_pos": "_one"},
        {"peak": (pnl, "cumulative", 0.0), "best": (pnl, "cumulative", None)})
    return out.withColumn("drawdown", F.col("peak") - F.col("cumulative")).withColumn("idx", F.col("_pos") - 1).drop("_pos", "_one")


def _with_course(trades: DataFrame, by: Sequence[str], order: Sequence[Column | str], pnl: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("_c", F.sum(pnl).over(w)).withColumn("_p", F.max("_c").over(w))


def _course(pnl: str) -> list[Column]:
    """Total, peak, own fall and lowest point of a chunk with ``_with_course``."""
    return [F.sum(pnl).alias("_t"), F.max("_p").alias("_m"), F.max(F.col("_p") - F.col("_c")).alias("_d"), F.min("_c").alias("_l")]


def _with_fall(chunks: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``_fall``: the deepest fall below the running peak (from zero) that a chunk sees, by the level and peak before it."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = chunks.withColumn("_b", F.coalesce(F.sum("_t").over(before), dbl(0)))
    x = x.withColumn("_q", F.greatest(F.max(F.col("_b") + F.col("_m")).over(before), dbl(0)))
    return x.withColumn("_fall", F.greatest(F.col("_d"), F.col("_q") - F.col("_b") - F.col("_l"), dbl(0)))


def max_drawdown(trades: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column | str], pnl: str = "net") -> DataFrame:
    """Deepest fall of the cumulative result below its running peak (from zero), per group.

    What a chunk adds is known from its own fall, its lowest point and the level and
    peak before it, so only one row per chunk leaves it.
    """
    tot = _with_course(trades, [*group, chunk], order, pnl).groupBy(*group, chunk).agg(*_course(pnl))
    return _with_fall(tot, group, [chunk]).groupBy(*group).agg(F.max("_fall").alias("drawdown"))


def backtest_summary(curve: DataFrame, group: Sequence[str], pnl: str = "net", days: str = "holding_days") -> DataFrame:
    n = F.count("*")
    return curve.groupBy(*group).agg(
        n.alias("total_trades"), F.count_if(F.col(pnl) > 0).alias("winning_trades"), F.count_if(F.col(pnl) <= 0).alias("losing_trades"),
        rnd(F.count_if(F.col(pnl) > 0) / n * 100, 1).alias("win_rate"), rnd(F.sum(pnl) / n, 2).alias("avg_pnl_pct"),
        rnd(F.sum(pnl), 2).alias("total_pnl_pct"), rnd(F.greatest(F.max("drawdown"), dbl(0)), 2).alias("max_drawdown"),
        rnd(F.avg(days), 1).alias("avg_holding_days"))


def survivorship_haircut(summary: DataFrame, ret: float = -0.12, win: float = -0.08) -> DataFrame:
    return summary.withColumns({
        "avg_pnl_pct_adj": rnd(F.col("avg_pnl_pct") * (1 + ret), 2),
        "win_rate_adj": rnd(F.greatest(dbl(0), F.col("win_rate") * (1 + win)), 1),
        "total_pnl_pct_adj": rnd(F.col("total_pnl_pct") * (1 + ret), 2)})


def period_of(dates: DataFrame, date: str, periods: int) -> DataFrame:
    """Chunk number of every distinct batch date; the last chunk takes the remainder."""
    d = dates.select(date).distinct()  # one row per batch
    w = Window.partitionBy(F.lit(0))
    size = F.greatest(F.floor(F.count("*").over(w) / periods), F.lit(1))
    i = F.row_number().over(w.orderBy(date)) - 1
    return d.withColumn("period", F.least(F.floor(i / size), F.lit(periods - 1)).cast("int"))


def consistency(periods: DataFrame) -> DataFrame:
    """Trade-weighted averages over periods and the stability score."""
    t = F.sum("total_trades")
    wavg = lambda c: F.sum(F.col(c) * F.col("total_trades")) / t
    x = periods.agg(
        t.alias("total_trades"), rnd(wavg("win_rate"), 1).alias("win_rate"), rnd(wavg("avg_pnl_pct"), 2).alias("avg_pnl_pct"),
        rnd(wavg("avg_holding_days"), 1).alias("avg_holding_days"),
        F.stddev_pop("win_rate").alias("_ws"), F.stddev_pop("avg_pnl_pct").alias("_ps"), F.min("avg_pnl_pct").alias("_mn"), F.count("*").alias("_n"))
    good = F.col("_mn") > 0
    score = F.greatest(dbl(0), (dbl(1) - F.least(dbl(1), F.col("_ws") / 20.0) * 0.5 - F.least(dbl(1), F.col("_ps") / 5.0) * 0.5) * 100 * F.when(good, 1.2).otherwise(0.6))
    return x.select(
        "total_trades", "win_rate", "avg_pnl_pct", "avg_holding_days", rnd("_ws", 1).alias("win_rate_std"), rnd("_ps", 2).alias("avg_pnl_std"),
        good.alias("all_periods_profitable"), F.when(F.col("_n") >= 2, F.least(dbl(100), rnd(score, 1))).otherwise(0.0).alias("score"))


def sector_alpha(trades: DataFrame, group: Sequence[str], pnl: str = "pnl_pct") -> DataFrame:
    """Result of each trade over the rounded mean of its sector."""
    bench = trades.groupBy(*group, "sector").agg(rnd(exact_mean(pnl), 2).alias("sector_benchmark"))
    return trades.join(bench, [*group, "sector"]).withColumn("sector_alpha", rnd(F.col(pnl) - F.col("sector_benchmark"), 2))


def alpha_summary(alphas: DataFrame, group: Sequence[str]) -> DataFrame:
    sd = F.stddev_pop("sector_alpha")
    return alphas.groupBy(*group).agg(
        rnd(exact_mean("sector_alpha"), 2).alias("portfolio_alpha"),
        F.when((F.count("*") >= 2) & (sd > 1e-9), rnd(F.avg("sector_alpha") / sd * F.sqrt(dbl(50)), 2)).otherwise(0.0).alias("sector_adjusted_sharpe"))


def drawdown_episodes(curve: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column | str], value: str = "cumulative") -> DataFrame:
    """Peak, trough and recovery of every underwater stretch of a curve.

    Needs ``idx`` (position from 0) and ``best`` (running maximum including the
    row). A row that reaches the maximum starts a new island; the island number
    is a two-level scan as well.
    """
    # the curve is kept to two decimals, so equal levels compare as equal; rounding keeps the maximum
    x = curve.withColumn(value, rnd(value, 2)).withColumn("_new", (F.col(value) >= rnd("best", 2)).cast("long"))
    x = running(x, group, chunk, order, {"island": "_new"})
    under = F.col("_new") == 0
    ep = x.groupBy(*group, "island").agg(
        F.max(F.when(~under, F.col(value))).alias("peak_value"), F.max(F.when(~under, F.col("idx"))).alias("peak_idx"),
        F.min(F.when(under, F.struct(F.col(value).alias("v"), F.col("idx").alias("i")))).alias("trough"), F.count_if(under).alias("underwater"))
    # the peak row of the next island is the recovery; islands are numbered without gaps
    nxt = ep.select(*group, (F.col("island") - 1).alias("island"), F.col("peak_idx").alias("recovery_idx"))
    return ep.where("underwater > 0").join(nxt, [*group, "island"], "left").select(
        *group, "peak_idx", F.col("trough.i").alias("trough_idx"), "recovery_idx",
        rnd(F.col("peak_value") - F.col("trough.v"), 2).alias("drawdown_pct"),
        (F.col("trough.i") - F.col("peak_idx")).alias("duration"), (F.col("recovery_idx") - F.col("trough.i")).alias("recovery_time"), "underwater")


def drawdown_summary(episodes: DataFrame, group: Sequence[str]) -> DataFrame:
    worst = F.max_by("duration", F.struct(F.col("drawdown_pct"), -F.col("peak_idx")))
    return episodes.groupBy(*group).agg(
        F.count("*").alias("episodes"), F.max("drawdown_pct").alias("max_drawdown_pct"), worst.alias("max_drawdown_duration"),
        rnd(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), 1).alias("avg_drawdown_duration"),
        F.coalesce(F.max("recovery_time"), F.lit(0)).alias("max_recovery_time"), rnd(F.coalesce(F.avg("recovery_time"), dbl(0)), 1).alias("avg_recovery_time"),
        F.sum("underwater").alias("underwater_count"))


def size_positions(candidates: DataFrame, batch: str, max_positions: int = 5, risk: float = 0.015, sector_cap: float = 0.15) -> DataFrame:
    """Allocation by strength with a cap per sector, filled in rank order.

    Filling a cap in order equals the step of min(cap, running total), so no
    fold is needed. Rows that get nothing are dropped.
    """
    rank = Window.partitionBy(batch).orderBy(F.desc("strength"), KEY)
    top = candidates.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_positions)
    top = top.where(F.col("rank") <= F.floor(F.col("regime_mult") * max_positions))
    mult = clamp(clamp(F.col("strength"), 0, 100) / 50.0, 0.5, 3.0)
    top = top.withColumn("raw_pct", rnd(mult * (risk * 100), 2))
    w = Window.partitionBy(batch, "sector").orderBy("rank")
    run = F.sum("raw_pct").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cap = dbl(sector_cap * 100)
    got = rnd(F.least(cap, run) - F.least(cap, run - F.col("raw_pct")), 2)
    return top.withColumn("allocation_pct", got).where("allocation_pct > 0")


def sector_rotation(scores: DataFrame, step: str, window: int = 5) -> DataFrame:
    """Sector mean of each step against its mean and deviation over the last ``window`` steps.

    ``step`` is the ordinal of the batch date.
    """
    day = scores.groupBy("sector", step).agg(F.avg("score").alias("current"), F.count("*").alias("n"))
    w = Window.partitionBy("sector").orderBy(step).rangeBetween(-(window - 1), 0)
    x = day.withColumns({"rolling": F.avg("current").over(w), "_k": F.count("*").over(w), "_sd": F.stddev_pop("current").over(w), "stock_count": F.max("n").over(w)})
    sd, mom = F.when(F.col("_k") >= 2, F.col("_sd")).otherwise(5.0), F.col("current") - F.col("rolling")
    # over two steps the distance to the mean equals the deviation: compared at nine digits, a tie is neutral
    near, far = rnd(mom, 9), rnd(sd, 9)
    signal = F.when((sd > 0) & (near > far), "overweight").when((sd > 0) & (near < -far), "underweight").otherwise("neutral")
    return x.select("sector", step, signal.alias("signal"), rnd("current", 2).alias("current_avg"), rnd("rolling", 2).alias("rolling_avg"),
                    rnd(mom, 2).alias("momentum"), rnd(sd, 2).alias("std_dev"), F.col("_k").alias("days_in_window"), "stock_count")


def sector_rotation_lite(scores: DataFrame, batch: str) -> DataFrame:
    """Sector means against the mean of sector means of the same batch."""
    s = scores.groupBy(batch, "sector").agg(rnd(F.avg("score"), 1).alias("avg"), F.count("*").alias("score_count"))
    w = Window.partitionBy(batch)  # one row per sector
    s = s.withColumn("_m", F.avg("avg").over(w)).withColumn("_s", F.stddev_pop("avg").over(w))
    out = (F.col("_s") > 0) & (F.abs(F.col("avg") - F.col("_m")) > F.col("_s"))
    return s.select(batch, "sector", F.col("avg").alias("current_avg"), "score_count",
                    F.when(out & (F.col("avg") > F.col("_m")), "overweight").when(out, "underweight").otherwise("neutral").alias("signal"),
                    F.when(out, rnd((F.col("avg") - F.col("_m")) / F.col("_s"), 2)).otherwise(0.0).alias("momentum"))


def holding_returns(holdings: DataFrame, returns: DataFrame, lookback: int = 20) -> DataFrame:
    """Last ``lookback`` returns of each holding as of its ordinal, numbered k = 1.. from the newest.

    Holdings are (portfolio, instrument, as_of_ord, ...); returns are (instrument, ord, ret).
    """
    want = holdings.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(lookback)))).withColumn("ord", F.col("as_of_ord") - F.col("k") + 1)
    return want.join(returns.select(KEY, "ord", "ret"), [KEY, "ord"]).drop("ord")


def holding_correlations(hr: DataFrame, portfolio: str, threshold: float = 0.85, min_n: int = 10) -> DataFrame:
    """Correlation of every pair inside a portfolio. A portfolio is bounded by its position limit."""
    a = hr.select(portfolio, "k", F.col(KEY).alias("a"), F.col("ret").alias("ra"))
    b = hr.select(portfolio, "k", F.col(KEY).alias("b"), F.col("ret").alias("rb"))
    pairs = a.join(b, [portfolio, "k"]).where("a < b").groupBy(portfolio, "a", "b").agg(F.corr("ra", "rb").alias("c"), F.count("*").alias("n"))
    c = F.when(F.col("n") >= min_n, rnd(clamp(F.coalesce("c", dbl(0)), -1, 1), 3)).otherwise(0.0)
    return pairs.select(portfolio, "a", "b", c.alias("correlation"), (c > threshold).alias("flagged"))


def halve_correlated(holdings: DataFrame, pairs: DataFrame, portfolio: str) -> DataFrame:
    """Walk the flagged pairs in order and halve the smaller allocation of each.

    The fold runs over the positions and flagged pairs of one portfolio only.
    """
    h = holdings.groupBy(portfolio).agg(F.array_sort(F.collect_list(F.struct(F.col(KEY).alias("id"), F.col("allocation_pct").alias("pct")))).alias("h"))
    p = pairs.where("flagged").groupBy(portfolio).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("p"))
    x = h.join(p, portfolio, "left").withColumn("ids", F.transform("h", lambda s: s["id"]))

    def step(acc, pair):
        i, j = F.array_position(F.col("ids"), pair["a"]), F.array_position(F.col("ids"), pair["b"])
        small = F.when(F.element_at(acc, i.cast("int")) <= F.element_at(acc, j.cast("int")), i).otherwise(j)
        return F.transform(acc, lambda v, k: F.when(k + 1 == small, rnd(v * 0.5, 2)).otherwise(v))

    start = F.transform("h", lambda s: s["pct"])
    x = x.withColumn("adj", F.when(F.col("p").isNull(), start).otherwise(F.aggregate("p", start, step)))
    return x.select(portfolio, F.explode(F.arrays_zip("ids", "adj")).alias("z")).select(
        portfolio, F.col("z.ids").alias(KEY), F.col("z.adj").alias("adjusted_pct"))


def portfolio_beta(hr: DataFrame, weights: DataFrame, portfolio: str) -> DataFrame:
    """Allocation-weighted beta of the holdings to their equal-weight portfolio."""
    port = hr.groupBy(portfolio, "k").agg(F.avg("ret").alias("pr"))
    b = hr.join(port, [portfolio, "k"]).groupBy(portfolio, KEY).agg((F.covar_pop("ret", "pr")).alias("cov"), F.var_pop("pr").alias("var"))
    n = F.count("*").over(Window.partitionBy(portfolio))
    x = b.join(weights, [portfolio, KEY]).withColumn("beta", F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(1.0))
    x = x.withColumn("w", F.when(F.col("adjusted_pct") > 0, F.col("adjusted_pct")).otherwise(dbl(1) / n))
    return x.groupBy(portfolio).agg(rnd(F.sum(F.col("beta") * F.col("w")) / F.sum("w"), 2).alias("effective_beta"), F.count("*").alias("holdings"))


def trade_stats(trades: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    closed, pnl = F.col("status") == "closed", F.col("pnl_pct")
    n = F.count_if(closed)
    nz = F.nullif(n, F.lit(0))
    tie = lambda sign: F.struct(pnl * sign, -F.col("trade_id"))
    wins, losses = F.when(closed & (pnl > 0), pnl), F.when(closed & (pnl <= 0), pnl)
    return trades.groupBy(*group).agg(
        F.count("*").alias("total_trades"), F.count_if(F.col("status") == "open").alias("open_positions"), n.alias("closed_trades"),
        rnd(F.count(wins) / nz * 100, 1).alias("win_rate"), rnd(F.sum(F.when(closed, pnl)), 2).alias("total_pnl_pct"),
        rnd(exact_mean(F.when(closed, pnl)), 2).alias("avg_pnl_pct"), rnd(exact_mean(wins), 2).alias("avg_win_pct"), rnd(exact_mean(losses), 2).alias("avg_loss_pct"),
        rnd(F.abs(exact_mean(wins) / exact_mean(losses)), 2).alias("profit_factor"),
        F.max_by(F.when(closed, F.col("trade_id")), F.when(closed, tie(1))).alias("best_trade"),
        F.max_by(F.when(closed, F.col("trade_id")), F.when(closed, tie(-1))).alias("worst_trade"))


def performance(curve: DataFrame, group: Sequence[str], pnl: str = "net_pnl_pct") -> DataFrame:
    """Win rate with Wilson interval, Sharpe, drawdown, profit factor, sample warning."""
    p = F.col(pnl)
    agg = curve.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if("win").alias("wins"), exact_mean(p).alias("mean"), rnd(F.sum(p), 6).alias("total"), F.stddev_pop(p).alias("sd"),
        F.greatest(F.max("drawdown"), dbl(0)).alias("dd"), F.coalesce(F.sum(F.when(F.col("win"), p)), dbl(0)).alias("gain"),
        F.abs(F.coalesce(F.sum(F.when(~F.col("win"), p)), dbl(0))).alias("loss"),
        F.count_if(F.col("stop_type") == "atr").alias("atr_stops"), F.count_if(F.col("stop_type") != "atr").alias("fallback_stops"))
    return _performance_columns(agg, group)


#: width of the ranges that a chunk's trades are divided into
SPLIT = 1024


def chunk_results(trades: DataFrame, group: Sequence[str], chunk: str, order: str, pnl: str = "net_pnl_pct") -> DataFrame:
    """What a chunk of a group's trades adds to ``performance``: one row per chunk and range of ``order``.

    ``order`` is the numeric column that orders the trades of a chunk; its ranges
    divide a chunk that would hold too many for one task. The trades are shuffled once.
    """
    by = [*group, chunk, "_range"]
    x = trades.select(*group, chunk, F.floor(F.col(order) / SPLIT).alias("_range"), order, F.col(pnl).alias("_pnl"), "win", (F.col("stop_type") == "atr").alias("_atr"))
    return _with_course(x, by, [order], "_pnl").groupBy(*by).agg(
        *_course("_pnl"), F.count("*").alias("_n"), F.count_if("win").alias("_wins"), F.avg("_pnl").alias("_avg"), F.var_pop("_pnl").alias("_var"),
        F.sum(F.when(F.col("win"), F.col("_pnl"))).alias("_gain"), F.sum(F.when(~F.col("win"), F.col("_pnl"))).alias("_loss"),
        F.count_if("_atr").alias("_atr"), F.count_if(~F.col("_atr")).alias("_other"))


def chunk_performance(chunks: DataFrame, group: Sequence[str], chunk: str) -> DataFrame:
    """``performance`` of groups of rows of ``chunk_results``; a chunk may count for several groups."""
    all_ = Window.partitionBy(*group)
    x = _with_fall(chunks, group, [chunk, "_range"]).withColumn("_mean", F.sum("_t").over(all_) / F.sum("_n").over(all_))
    n, total, off = F.sum("_n"), rnd(F.sum("_t"), 6), F.col("_avg") - F.col("_mean")
    agg = x.groupBy(*group).agg(
        n.alias("n"), F.sum("_wins").alias("wins"), (total / n).alias("mean"), total.alias("total"),
        F.sqrt(F.sum(F.col("_n") * (F.col("_var") + off * off)) / n).alias("sd"), F.max("_fall").alias("dd"),
        F.coalesce(F.sum("_gain"), dbl(0)).alias("gain"), F.abs(F.coalesce(F.sum("_loss"), dbl(0))).alias("loss"),
        F.sum("_atr").alias("atr_stops"), F.sum("_other").alias("fallback_stops"))
    return _performance_columns(agg, group)


def _performance_columns(agg: DataFrame, group: Sequence[str]) -> DataFrame:
    wr, nn, z = F.col("wins") / F.col("n"), F.col("n"), 1.96
    denom = dbl(1) + dbl(z * z) / nn
    center = (wr + dbl(z * z) / (nn * 2.0)) / denom
    margin = F.sqrt((wr * (dbl(1) - wr) + dbl(z * z) / (nn * 4.0)) / nn) * z / denom
    enough = nn >= 10
    return agg.select(
        *group, nn.alias("total_trades"), rnd(wr * 100, 1).alias("win_rate"),
        F.when(enough, rnd((center - margin) * 100, 1)).alias("ci_lower"), F.when(enough, rnd((center + margin) * 100, 1)).alias("ci_upper"),
        rnd("mean", 2).alias("avg_pnl"), rnd("total", 2).alias("total_pnl"),
        F.when(F.col("sd") > 1e-12, rnd(F.col("mean") / F.col("sd") * F.sqrt(dbl(252)), 2)).otherwise(0.0).alias("sharpe_ratio"),
        (nn >= 30).alias("sharpe_reliable"), rnd("dd", 2).alias("max_drawdown"),
        F.when(F.col("loss") > 0, rnd(F.col("gain") / F.col("loss"), 2)).alias("profit_factor"),
        F.when(nn < 10, "critical").when(nn < 30, "warning").when(nn < 50, "note").alias("sample_warning"), "atr_stops", "fallback_stops")


def walk_forward(trades: DataFrame, dates: DataFrame, date: str, train: int = 20, test: int = 10) -> DataFrame:
    """Trades, or their results by date, tagged with every training window that contains their date.

    Window w covers date ordinals [test*w, test*w + train); a date falls into
    a fixed number of windows, listed from its ordinal, so nothing is range joined.
    """
    d = dates.select(date).distinct()  # one row per date
    w = Window.partitionBy(F.lit(0))
    d = d.withColumn("_o", F.row_number().over(w.orderBy(date)) - 1).withColumn("_n", F.count("*").over(w))
    first = F.greatest(F.ceil((F.col("_o") - (train - 1)) / test), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("_o") / test), F.floor((F.col("_n") - train - test) / test)).cast("int")
    tagged = d.where(last >= first).withColumn("window", F.explode(F.sequence(first, last))).select(date, "window")
    # bounded by the calendar
    return trades.join(F.broadcast(tagged), date)


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    return windows.agg(
        F.count("*").alias("windows_tested"), rnd(F.avg("win_rate"), 1).alias("avg_win_rate"), rnd(F.avg("sharpe_ratio"), 2).alias("avg_sharpe"),
        rnd(F.avg("avg_pnl"), 2).alias("avg_pnl"), rnd(F.count_if(F.col("win_rate") > 50) / F.count("*") * 100, 4).alias("consistent_win_rate"))


def scenario_weights(n: int, dims: Sequence[str]) -> Column:
    """Array of ``n`` weight vectors on a fixed grid, each scaled to a sum of one."""
    items = []
    for i in range(n):
        w = scenario_vector(i, len(dims))
        items.append(F.struct(F.lit(i).alias("scenario"), *[dbl(x).alias(f"w_{d}") for d, x in zip(dims, w, strict=True)]))
    return F.array(*items)


def scenario_vector(i: int, dims: int) -> list[float]:
    draws = [0.05 + 0.35 * (((i + 1) * (7919 + 104 * j) + 31 * j) % 1000) / 1000.0 for j in range(dims)]
    return [round(x / sum(draws), 4) for x in draws]


def weight_search(signals: DataFrame, dims: Sequence[str], chunk: str, order: Sequence[str], n: int = 100, minimum: float = 55.0, split: str | None = None) -> DataFrame:
    """Metrics of the trades each weight vector would have taken, with the objective.

    Each signal is paired with the fixed list of vectors where it lies: the sums
    are combined per scenario on the map side, and for the drawdown the signals
    are dealt by chunk before they are paired, so that no pair is shuffled.
    """
    terms = [F.col(d) * F.col(f"w_{d}") for d in dims]

    def taken(x: DataFrame) -> DataFrame:
        return x.withColumn("_w", F.explode(scenario_weights(n, dims))).select("*", "_w.*").drop("_w").where(sum(terms[1:], terms[0]) >= minimum)

    part = F.struct(F.col(chunk).alias("c"), F.floor(F.col(split) / SPLIT).alias("r")) if split else F.col(chunk)
    dealt = signals.withColumn("_part", part).repartition("_part")
    fall = max_drawdown(taken(dealt), ["scenario"], "_part", order, "net_pnl_pct")
    m = performance(taken(signals).withColumn("drawdown", dbl(0)), ["scenario", *[f"w_{d}" for d in dims]])
    m = m.drop("max_drawdown").join(fall.select("scenario", rnd("drawdown", 2).alias("max_drawdown")), "scenario")
    m = m.withColumn("objective", rnd(F.col("sharpe_ratio") + F.col("win_rate") / 100 - F.col("max_drawdown") / 100, 6))
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("objective"), "scenario")  # one row per vector
    return m.withColumn("best", F.row_number().over(best) == 1)


def dimension_edge(signals: DataFrame, dims: Sequence[str], win: str = "win") -> DataFrame:
    """Win rate of high scores minus win rate of low scores, per dimension."""
    long = signals.select(win, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), dbl(50)).alias("score")) for d in dims])).alias("d")).select(win, "d.*")
    hi, lo = F.col("score") >= 70, F.col("score") <= 30
    rate = lambda c: F.coalesce(F.avg(F.when(c, F.col(win).cast("double"))), dbl(0))
    return long.groupBy("dimension").agg(
        rnd(rate(hi) * 100, 1).alias("high_score_win_rate"), rnd(rate(lo) * 100, 1).alias("low_score_win_rate"),
        rnd((rate(hi) - rate(lo)) * 100, 1).alias("edge"), F.count_if(hi | lo).alias("sample_size"))


def recalibrate(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights (dimension, weight) moved by a tenth of the edge, clamped and normalised."""
    x = weights.join(edges, "dimension", "left")
    moved = rnd(clamp(F.col("weight") + F.col("edge") / 100 * 0.1, 0.05, 0.40), 2)
    x = x.withColumn("_w", F.when(F.col("sample_size") >= 5, moved).otherwise(F.col("weight")))
    w = Window.partitionBy(F.lit(0))  # one row per dimension
    return x.select("dimension", "weight", rnd(F.col("_w") / F.sum("_w").over(w), 2).alias("new_weight"))


def accept_weights(metrics: DataFrame, min_trades: int = 10, min_win_rate: float = 45.0) -> DataFrame:
    reason = F.when(F.col("total_trades") < min_trades, "insufficient_trades").when(F.col("win_rate") < min_win_rate, "win_rate_below_threshold").when(
        F.col("sharpe_ratio") < 0, "negative_sharpe")
    return metrics.withColumn("valid", reason.isNull()).withColumn("reason", F.coalesce(reason, F.lit("ok")))


def feature_importance(signals: DataFrame, dims: Sequence[str], pnl: str) -> DataFrame:
    long = signals.where(F.col(pnl).isNotNull()).select(pnl, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), dbl(50)).alias("score")) for d in dims])).alias("d")).select(pnl, "d.*")
    return long.groupBy("dimension").agg(rnd(F.corr("score", pnl), 3).alias("correlation"), F.count("*").alias("n")).where("n >= 5 and correlation is not null")


def apply_exits(log: DataFrame, exits: DataFrame, key: str = "trade_id") -> DataFrame:
    """Signal log completed with exit rows."""
    x = log.join(exits, key, "left")
    r = F.when((F.col("entry_price") != 0) & (F.col("exit_price") != 0), (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price"))
    return x.withColumn("pnl_pct", rnd(r * 100, 2)).withColumn("win", r > 0)


def pnl_timeline(trades: DataFrame, date: str = "exit_date", pnl: str = "pnl_pct") -> DataFrame:
    """Daily and cumulative result; aggregated to one row per date before the running sum."""
    d = trades.where(F.col(date).isNotNull()).groupBy(date).agg(F.sum(pnl).alias("pnl"), F.count("*").alias("trades"))
    w = Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return d.select(date, "trades", rnd("pnl", 4).alias("pnl"), rnd(F.sum("pnl").over(w), 2).alias("cumulative_pnl"))
