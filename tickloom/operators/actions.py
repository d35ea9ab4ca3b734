"""Corporate actions: feed parsing, source priority, backward adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.typing import dbl, era_to_date, first_numeric, rnd, safe_float

SPECIAL_SHARE = "[BR]$"


def parse_ex_feed(
    raw: DataFrame,
    cash: Sequence[str],
    stock: Sequence[str],
    ref_price: Sequence[str],
    rights: Sequence[str],
    code: str = "code",
    era_date: str = "era_date",
) -> DataFrame:
    """Official ex-date feed; each measure is the first numeric of its alias columns."""
    return (
        raw.withColumn("ex_date", era_to_date(era_date))
        .where(F.col("ex_date").isNotNull() & (F.coalesce(F.col(code), F.lit("")) != ""))
        .select(
            F.col(code).alias("code"),
            "ex_date",
            rnd(first_numeric(*cash), 4).alias("cash_div"),
            rnd(first_numeric(*stock), 4).alias("stock_div"),
            rnd(first_numeric(*ref_price), 2).alias("ref_price"),
            rnd(first_numeric(*rights), 2).alias("rights_value"),
            F.lit("official").alias("source"),
        )
    )


def estimate_ex_date(meeting: Column | str, days: int = 7) -> Column:
    """Meeting date in era text plus the usual delay."""
    c = F.col(meeting) if isinstance(meeting, str) else meeting
    return F.date_add(era_to_date(F.substring(c, 1, 7)), days)


def parse_declarations(
    raw: DataFrame, cash: Sequence[str], stock: Sequence[str], meeting: str, code: str = "code", order: str = "seq"
) -> DataFrame:
    """Declared dividends: summed components, no special shares, no empty rows, first per (code, date)."""
    total = lambda cols: rnd(sum((safe_float(c) for c in cols[1:]), safe_float(cols[0])), 4)
    rows = raw.select(
        F.col(code).alias("code"),
        estimate_ex_date(meeting).alias("ex_date"),
        total(cash).alias("cash_div"),
        total(stock).alias("stock_div"),
        F.col(order).alias("seq"),
    ).where(
        (F.coalesce(F.col("code"), F.lit("")) != "")
        & ~F.col("code").rlike(SPECIAL_SHARE)
        & ((F.col("cash_div") > 0) | (F.col("stock_div") > 0))
        & F.col("ex_date").isNotNull()
    )
    # min_by keeps one small struct per key on the map side
    return (
        rows.groupBy("code", "ex_date")
        .agg(F.min_by(F.struct("cash_div", "stock_div"), F.struct("seq", "cash_div", "stock_div")).alias("r"))
        .select("code", "ex_date", "r.cash_div", "r.stock_div", F.lit("declaration").alias("source"))
    )


def merge_actions(official: DataFrame, declared: DataFrame, key: str = "instrument") -> DataFrame:
    """Official rows, plus declarations on dates that have no official row."""
    fill = declared.join(official.select(key, "ex_date").distinct(), [key, "ex_date"], "left_anti")
    return official.unionByName(fill)


def one_action_per_day(actions: DataFrame, key: str = "instrument", order: str = "seq") -> DataFrame:
    """Last listed action of a day, as the adjustment uses one per date."""
    return (
        actions.groupBy(key, "ex_date")
        .agg(F.max_by(F.struct("cash_div", "stock_div"), F.struct(order, "cash_div", "stock_div")).alias("a"))
        .select(key, "ex_date", "a.cash_div", "a.stock_div")
    )


def adjustment_factor(before: Column, cash: Column, stock: Column) -> Column:
    """Price ratio at an ex-date; 1 where there is no action or the result would not be positive."""
    ratio = dbl(1) + stock / 10.0
    adjusted = (before - cash) / ratio
    return (
        F.when(before > 0, F.when(cash > 0, F.when(adjusted > 0, adjusted / before).otherwise(1.0))
               .when(stock > 0, dbl(1) / ratio).otherwise(1.0))
        .otherwise(1.0)
    )


def backward_adjust(bars: DataFrame, day_actions: DataFrame, key: str = "instrument", parts: int | None = None) -> DataFrame:
    """Continuous price series: every bar is scaled by the factors of all later ex-dates.

    One descending window serves both the previous close and the running
    product, so the panel is shuffled and sorted once. Actions on dates without
    a bar fall out in the join. ``parts`` is the number of partitions for the
    window; without it Spark chooses.
    """
    w = Window.partitionBy(key).orderBy(F.desc("date"))
    acts = day_actions.withColumnRenamed("ex_date", "date")
    factor = adjustment_factor(F.lead("close").over(w), F.col("cash_div"), F.col("stock_div"))
    later = F.coalesce(F.product("factor").over(w.rowsBetween(Window.unboundedPreceding, -1)), dbl(1))
    rows = bars.join(acts, [key, "date"], "left")
    if parts:
        rows = rows.repartition(parts, key)
    return (
        rows.withColumn("factor", factor)
        .withColumn("_cum", later)
        .withColumn("adj_close", F.when(F.col("close") > 0, rnd(F.col("close") * F.col("_cum"), 4)).otherwise(0.0))
        .withColumn("adj_volume", rnd(F.col("volume") / F.col("_cum"), 0))
        .withColumn("cumulative_factor", rnd("_cum", 6))
        .drop("_cum", "factor")
    )


def unadjusted_price(price: Column | str, cash: Column | str = "cash_div", stock: Column | str = "stock_div") -> Column:
    """Price on an ex-date with the mechanical drop added back."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    price = as_col(price)
    cash, stock = F.coalesce(as_col(cash), dbl(0)), F.coalesce(as_col(stock), dbl(0))
    return (price + F.greatest(cash, dbl(0))) * (dbl(1) + F.greatest(stock, dbl(0)) / 10.0)


def validate_ex_dates(actions: DataFrame, cal: DataFrame, key: str = "instrument", official: str = "official") -> DataFrame:
    """Exact duplicates (low) and ex-dates that are not trading days (medium if official, else high)."""
    dup_key = [key, "ex_date", rnd("cash_div", 4).alias("cash_div"), rnd("stock_div", 4).alias("stock_div")]
    dups = (
        actions.select(*dup_key)
        .groupBy(key, "ex_date", "cash_div", "stock_div")
        .agg((F.count("*") - 1).alias("issues"))
        .where("issues > 0")
        .groupBy(key, "ex_date")
        .agg(F.sum("issues").alias("issues"))
        .select(key, "ex_date", F.lit("duplicate").alias("issue"), F.lit("low").alias("severity"), "issues")
    )
    closed = cal.where(~F.col("is_trading")).select(F.col("date").alias("ex_date"))
    off = (
        actions.join(closed, "ex_date", "left_semi")
        .groupBy(key, "ex_date", F.when(F.col("source") == official, "medium").otherwise("high").alias("severity"))
        .agg(F.count("*").alias("issues"))
        .select(key, "ex_date", F.lit("closed_day").alias("issue"), "severity", "issues")
    )
    return dups.unionByName(off)


def forward_yield(asof: DataFrame, actions: DataFrame, key: str = "instrument", days: int = 365) -> DataFrame:
    """Cash paid in the ``days`` after each (instrument, date) over the price.

    Actions are summed per day and turned into a running total per instrument;
    both ends of the interval are looked up by one union-and-fill pass, so no
    range join is needed.
    """
    daily = actions.groupBy(key, F.col("ex_date").alias("date")).agg(F.sum("cash_div").alias("cash"))
    # events ordered by date: an action at day d counts for start <= d <= end
    ev = daily.select(key, "date", F.lit(1).alias("side"), "cash", F.lit(None).cast("date").alias("origin"))
    lo = asof.select(key, "date", F.lit(0).alias("side"), F.lit(0.0).alias("cash"), F.col("date").alias("origin"))
    hi = asof.select(key, F.date_add("date", days).alias("date"), F.lit(2).alias("side"), F.lit(0.0).alias("cash"), F.col("date").alias("origin"))
    w = Window.partitionBy(key).orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = ev.unionByName(lo).unionByName(hi).withColumn("run", F.sum("cash").over(w)).where("origin is not null")
    span = run.groupBy(key, F.col("origin").alias("date")).agg(
        (F.max(F.when(F.col("side") == 2, F.col("run"))) - F.max(F.when(F.col("side") == 0, F.col("run")))).alias("cash")
    )
    return asof.join(span, [key, "date"]).select(
        key, "date", F.when(F.col("price") > 0, rnd(F.col("cash") / F.col("price") * 100, 2)).otherwise(0.0).alias("yield_pct")
    )
