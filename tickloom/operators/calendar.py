"""Trading calendar: holiday classification, sessions, gaps and ordinals.

A calendar has one row per civil day, so it grows with the covered years and
never with the panel. Windows over it are keyed by ``market``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.typing import era_to_date

# Feed phrases.
HALF_DAY_WORDS = ("僅上午交易", "half")
NO_TRADING_WORDS = ("市場無交易", "無交易")
BOUNDARY_WORDS = ("開始交易日", "最後交易日")
MAKEUP_NAME, MAKEUP_DESCRIPTION, MAKEUP_TEXT = "補行上班", "調整上班", "makeup"


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def classify_holidays(raw: DataFrame) -> DataFrame:
    """Feed rows (era_date, name, description, is_trading, file_no) to one row per date.

    The first file that lists a date wins. An explicit flag decides; without
    one the text does.
    """
    first = raw.groupBy("era_date").agg(
        F.min_by(F.struct("name", "description", "is_trading"), F.struct("file_no", "name")).alias("r")
    )
    text = F.lower(F.concat_ws(" ", F.col("r.name"), F.col("r.description")))
    flag = F.col("r.is_trading")
    by_text = _any(text, NO_TRADING_WORDS) | ~_any(text, BOUNDARY_WORDS)
    return (
        first.withColumn("date", era_to_date("era_date"))
        .where(F.col("date").isNotNull())
        .select(
            "date",
            F.col("r.name").alias("name"),
            F.coalesce((flag == "N") | (flag.isNull() & by_text), F.lit(False)).alias("closed"),
            F.coalesce((flag == "Y") & _any(text, HALF_DAY_WORDS), F.lit(False)).alias("partial"),
            (
                F.col("r.name").contains(MAKEUP_NAME)
                | F.col("r.description").contains(MAKEUP_DESCRIPTION)
                | text.contains(MAKEUP_TEXT)
            ).alias("makeup"),
        )
    )


def build_calendar(bounds: DataFrame, holidays: DataFrame, market: str = "main") -> DataFrame:
    """One row per day between ``bounds`` (first, last) with flags, ordinal and neighbours."""
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
    flags = ("closed", "partial", "makeup")
    joined = days.join(holidays, "date", "left").select(
        F.lit(market).alias("market"), "date", "name", *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags]
    )
    trading = F.when(F.col("makeup"), True).when(F.weekday("date") >= 5, False).otherwise(~F.col("closed"))
    w = Window.partitionBy("market").orderBy("date")
    mark = F.when(F.col("is_trading"), F.col("date"))
    return (
        joined.withColumn("is_trading", trading)
        .withColumn("ordinal", F.sum(F.col("is_trading").cast("long")).over(w))
        .withColumn("prev_trading", F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        # the next trading day is the previous one of the reversed order, which keeps the frame growing
        .withColumn(
            "next_trading",
            F.last(mark, True).over(
                Window.partitionBy("market").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
    )


def with_sessions(cal: DataFrame, full: float = 6.5, half: float = 4.0) -> DataFrame:
    kind = F.when(~F.col("is_trading"), "closed").when(F.col("partial"), "half").otherwise("full")
    return cal.withColumn("session", kind).withColumn(
        "hours", F.when(kind == "closed", 0.0).when(kind == "half", half).otherwise(full)
    )


def near_trading_days(cal: DataFrame, limit: int = 60) -> DataFrame:
    """Exclusive next and previous trading day, null when farther than ``limit`` days."""
    nxt = F.when(F.datediff("next_trading", "date") <= limit, F.col("next_trading"))
    prv = F.when(F.datediff("date", "prev_trading") <= limit, F.col("prev_trading"))
    return cal.select("date", nxt.alias("next_day"), prv.alias("prev_day"))


def last_weekday_before(c: Column | str) -> Column:
    """Latest weekday on or before the date (ignores holidays)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_sub(c, F.greatest(F.lit(0), F.weekday(c) - 4))


def count_trading_days(ranges: DataFrame, cal: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Trading days in [start, end], none if it ends before it starts: two equi-joins on the date, no range join."""
    a = cal.select(F.col("date").alias(start), (F.col("ordinal") - F.col("is_trading").cast("long")).alias("_lo"))
    b = cal.select(F.col("date").alias(end), F.col("ordinal").alias("_hi"))
    n = F.when(F.col(end) < F.col(start), F.lit(0).cast("long")).otherwise(F.col("_hi") - F.col("_lo"))
    return ranges.join(a, start, "left").join(b, end, "left").withColumn(out, n).drop("_lo", "_hi")


def _risk(length: Column) -> Column:
    return F.when(length >= 8, "high").when(length >= 4, "medium").otherwise("low")


def holiday_gaps(cal: DataFrame, min_length: int = 3) -> DataFrame:
    """Closed stretches that contain a weekday, from that weekday to the day before trading resumes."""
    last = cal.groupBy("market").agg(F.max("date").alias("range_end"))
    closed_weekday = F.when(F.weekday("date") < 5, F.col("date"))
    islands = (
        cal.where(~F.col("is_trading"))
        .groupBy("market", "ordinal")
        .agg(
            F.min(closed_weekday).alias("start"),
            F.max("date").alias("end"),
            F.min_by(F.when(F.weekday("date") < 5, F.coalesce("name", F.lit("Unknown holiday"))), closed_weekday).alias("reason"),
        )
        .where(F.col("start").isNotNull())
        .withColumn("length", F.datediff("end", "start") + 1)
        .join(last, "market")
    )
    keep = (F.col("length") >= min_length) | (F.col("end") == F.col("range_end"))
    return islands.where(keep).select("start", "end", "length", "reason", _risk(F.col("length")).alias("risk_level"))


def post_holiday(cal: DataFrame, normal_gap: int = 3) -> DataFrame:
    gap = F.datediff("date", "prev_trading")
    ok = gap <= 20
    return cal.select(
        "date",
        F.coalesce(F.when(ok, gap > normal_gap), F.lit(False)).alias("post_holiday"),
        F.coalesce(F.when(ok, gap), F.lit(0)).alias("gap_days"),
    )


def holiday_risk(dates: DataFrame, cal: DataFrame, ahead: int = 20) -> DataFrame:
    """Size factor from the longest closed stretch seen inside [date, date + ahead].

    Each date fans out to ``ahead + 1`` days and meets the calendar on equality.
    """
    seen = dates.select("date").distinct().withColumn(
        "day", F.explode(F.sequence(F.col("date"), F.date_add("date", ahead)))
    )
    closed = cal.where(~F.col("is_trading")).select(F.col("date").alias("day"), F.col("ordinal").alias("island"))
    per_gap = (
        seen.join(closed, "day")
        .groupBy("date", "island")
        .agg(F.min(F.when(F.weekday("day") < 5, F.col("day"))).alias("s"), F.max("day").alias("e"))
        .withColumn("length", F.datediff("e", "s") + 1)
    )
    worst = per_gap.groupBy("date").agg(F.max("length").alias("length"))
    factor = F.when(F.col("length") >= 8, 0.5).when(F.col("length") >= 4, 0.75).otherwise(1.0)
    return dates.select("date").distinct().join(worst, "date", "left").select("date", factor.alias("risk_factor"))


def ex_dividend_season(c: Column | str) -> Column:
    """Mid July to the end of August."""
    c = F.col(c) if isinstance(c, str) else c
    return ((F.month(c) == 7) & (F.dayofmonth(c) >= 15)) | (F.month(c) == 8)
