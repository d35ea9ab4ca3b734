"""Queries on the (instrument, date) panel: history, cross-sections, upserts, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.typing import rnd


def history(bars: DataFrame, instrument, since=None, limit: int | None = None) -> DataFrame:
    """One instrument, oldest first; the first ``limit`` since a date, or the latest ``limit``."""
    rows = bars.where(F.col("instrument") == instrument)
    if since is not None:
        rows = rows.where(F.col("date") >= F.lit(since)).orderBy("date")
        return rows.limit(limit) if limit else rows
    if limit:
        rows = rows.orderBy(F.desc("date")).limit(limit)
    return rows.orderBy("date")


def history_batch(bars: DataFrame, wanted: DataFrame, since=None, limit: int | None = None) -> DataFrame:
    """Last ``limit`` bars of every wanted instrument.

    The rank filter is a window group limit, so each task keeps at most
    ``limit`` rows per instrument before the shuffle.
    """
    rows = bars.join(wanted.select("instrument"), "instrument", "left_semi")
    if since is not None:
        rows = rows.where(F.col("date") >= F.lit(since))
    if limit:
        rows = last_bars(rows, limit).drop("rn")
    return rows


def last_bars(bars: DataFrame, n: int, key: str = "instrument") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("date"))
    return bars.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def cross_section(bars: DataFrame, date: Column | None = None) -> DataFrame:
    """All instruments of one day, busiest first; the latest day when none is given."""
    if date is None:
        latest = bars.agg(F.max("date").alias("date"))
        return bars.join(latest, "date", "left_semi").orderBy(F.desc("volume"), "instrument")
    return bars.where(F.col("date") == date).orderBy(F.desc("volume"), "instrument")


def latest_dates(bars: DataFrame, n: int) -> DataFrame:
    return bars.select("date").distinct().orderBy(F.desc("date")).limit(n)


def date_span(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("bars")
    )


def between(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    if lo is not None:
        df = df.where(F.col(column) >= F.lit(lo))
    if hi is not None:
        df = df.where(F.col(column) <= F.lit(hi))
    return df


def table_stats(df: DataFrame, name: str, date: str = "date", key: str = "instrument", exact: bool = True) -> DataFrame:
    distinct = F.count_distinct(key) if exact else F.approx_count_distinct(key)
    return df.agg(
        F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        distinct.alias("instruments"),
    ).select(F.lit(name).alias("table"), "*")


def table_sketches(df: DataFrame, part: Column, date: str = "date", key: str = "instrument", lg: int = 16) -> DataFrame:
    """(part, rows, first_date, last_date, sketch): statistics per partition that can be kept and merged.

    A sketch of 2**lg registers holds the distinct keys; its standard error is about
    1.04 / sqrt(2**lg), and small counts are exact. Null keys are not counted.
    """
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.hll_sketch_agg(F.col(key), F.lit(lg)).alias("sketch"))


def refresh_sketches(kept: DataFrame, df: DataFrame, part: Column, date: str = "date", key: str = "instrument", lg: int = 16) -> DataFrame:
    """``kept`` and the sketches of partitions it lacks: only rows of those are aggregated. There is one row per partition."""
    fresh = df.withColumn("_p", part).join(kept.select(F.col("part").alias("_p")), "_p", "left_anti")
    return kept.unionByName(table_sketches(fresh, F.col("_p"), date, key, lg))


def merged_stats(sketches: DataFrame, name: str) -> DataFrame:
    """The statistics of ``table_stats`` from kept sketches, distinct keys by estimate."""
    return sketches.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("instruments"),
    ).select(F.lit(name).alias("table"), "*")


def table_keys(df: DataFrame, part: Column, date: str = "date", key: str = "instrument") -> DataFrame:
    """(part, key, rows, first_date, last_date): one row per partition and key, which can be kept and merged exactly.

    Twin of ``table_sketches`` for exact distinct counts; it has at most as many rows as the table, and null keys have rows as well.
    """
    return df.groupBy(part.alias("part"), F.col(key).alias("key")).agg(F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def refresh_keys(kept: DataFrame, df: DataFrame, part: Column, date: str = "date", key: str = "instrument") -> DataFrame:
    """``kept`` and the rows of partitions it lacks: only those are aggregated."""
    fresh = df.withColumn("_p", part).join(kept.select(F.col("part").alias("_p")).distinct(), "_p", "left_anti")
    return kept.unionByName(table_keys(fresh, F.col("_p"), date, key))


def merged_key_stats(keys: DataFrame, name: str) -> DataFrame:
    """The statistics of ``table_stats`` from the rows of ``table_keys``."""
    per_key = keys.groupBy("key").agg(F.sum("rows").alias("rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.count("key").alias("instruments"),
    ).select(F.lit(name).alias("table"), "*")


def index_proxy(bars: DataFrame, top: int = 20) -> DataFrame:
    """Mean close and mean change of the ``top`` busiest instruments of each day.

    Ranked per date with a group limit, so a date ships ``top`` rows per task.
    ``bars`` needs a ``change`` column.
    """
    w = Window.partitionBy("date").orderBy(F.desc("volume"), "instrument")
    return (
        bars.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= top)
        .groupBy("date")
        .agg(F.avg("close").alias("_c"), F.avg("change").alias("_d"), F.count("*").alias("members"))
        .select(
            "date", rnd("_c", 2).alias("index_close"),
            F.when(F.col("_c") > 0, rnd(F.col("_d") / F.col("_c") * 100, 2)).otherwise(0.0).alias("change_pct"), "members",
        )
    )


def upsert_first(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append only keys that are not there yet; among duplicates the smallest ``order`` wins."""
    rest = [c for c in incoming.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti").groupBy(*keys).agg(pick.alias("_r"))
    return existing.unionByName(fresh.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def upsert_priority(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of sources listed by falling priority, one row per key."""
    parts = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in sources[0].columns if c not in keys]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_prio", *order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def trade_ledger(trades: DataFrame, entry_digits: int | None = None) -> DataFrame:
    """Entry row for every trade and an exit row for closed ones, unique per (date, action, code, price).

    With ``entry_digits`` entries are one row if their prices are equal to so many digits.
    """
    price = F.col("entry_price") if entry_digits is None else rnd("entry_price", entry_digits)
    entry = F.struct(
        F.col("entry_date").alias("date"), F.lit("entry").alias("action"), price.alias("price"),
        F.lit(None).cast("double").alias("pnl_pct"), F.lit(None).cast("double").alias("pnl_abs"),
        F.lit(None).cast("string").alias("reason"), F.col("entry_price").alias("entry_price"),
    )
    exit_ = F.struct(
        F.col("exit_date").alias("date"), F.lit("exit").alias("action"), F.col("exit_price").alias("price"),
        F.col("pnl_pct"), rnd(F.col("entry_price") * F.col("pnl_pct") / 100, 4).alias("pnl_abs"),
        F.col("exit_reason").alias("reason"), F.col("entry_price").alias("entry_price"),
    )
    legs = F.when(F.col("exit_date").isNotNull(), F.array(entry, exit_)).otherwise(F.array(entry))
    rows = trades.select("instrument", F.explode(legs).alias("l")).select("instrument", "l.*")
    # one deterministic survivor per ledger key: results are rounded, so equal ones are told apart by the entry price
    return (
        rows.groupBy("date", "action", "instrument", "price")
        .agg(F.min_by(F.struct("pnl_pct", "pnl_abs", "reason"), F.struct("pnl_pct", "entry_price", "reason")).alias("r"))
        .select("date", "action", "instrument", "price", "r.pnl_pct", "r.pnl_abs", "r.reason")
    )


def missing_dates(cal: DataFrame, present: DataFrame, asof: DataFrame, lookback: int) -> DataFrame:
    """Trading days of the window [as_of - 1.2 * lookback, as_of] without a stored day."""
    span = int(lookback * 1.2)
    # as_of is a single row, so this join only filters the calendar
    window = cal.where("is_trading").crossJoin(F.broadcast(asof.select("as_of"))).where(
        (F.col("date") <= F.col("as_of")) & (F.col("date") >= F.date_sub("as_of", span))
    )
    return window.select("date").join(present.select("date").distinct(), "date", "left_anti")


def first_match(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join against the first right row per key."""
    rest = [c for c in right.columns if c != key]
    one = right.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return left.join(one, key, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in rest])


def exclude(df: DataFrame, lists: dict[str, DataFrame], key: str = "instrument") -> DataFrame:
    """Add ``reason``: name of the first exclusion list that holds the key, else null."""
    out = df
    for name, ids in lists.items():
        out = out.join(ids.select(key, F.lit(True).alias(f"_in_{name}")).distinct(), key, "left")
    reason = F.coalesce(*[F.when(F.col(f"_in_{n}"), F.lit(n)) for n in lists])
    return out.withColumn("reason", reason).drop(*[f"_in_{n}" for n in lists])


def asof_join(
    events: DataFrame, bars: DataFrame, value: Sequence[str], key: str = "instrument", at: str = "at", spread: int = 1
) -> DataFrame:
    """Latest bar on or before ``at`` for each event.

    Both sides are unioned and the last bar is carried forward in one window:
    no range join, no fan-out. When one instrument can hold a large share of
    all events, ``spread`` splits its events over that many salted copies of
    the instrument's bars (a bar series is bounded by the number of dates).
    """
    salt = F.pmod(F.xxhash64(*events.columns), F.lit(spread)) if spread > 1 else F.lit(0)
    e = events.select(
        F.struct(*events.columns).alias("_e"), F.col(key), F.col(at).alias("_t"), salt.cast("int").alias("_s"),
        F.lit(None).cast(bars.select(F.struct(F.col("date").alias("bar_date"), *value).alias("b")).schema["b"].dataType).alias("_b"),
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))) if spread > 1 else F.lit(0)
    b = bars.select(
        F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), F.col(key), F.col("date").alias("_t"), salts.cast("int").alias("_s") if spread == 1 else salts.alias("_s"),
        F.struct(F.col("date").alias("bar_date"), *value).alias("_b"),
    )
    w = Window.partitionBy(key, "_s").orderBy("_t", F.col("_b").isNull())
    joined = e.unionByName(b).withColumn("_hit", F.last("_b", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.where(F.col("_e").isNotNull()).select("_e.*", "_hit.*")


def forward_bars(events: DataFrame, bars: DataFrame, horizon: int, key: str = "instrument") -> DataFrame:
    """Events (key, entry_ord) with the next ``horizon`` bars.

    Each event lists the ordinals it needs and meets the bars on equality of
    (key, ord), which spreads a busy instrument over many partitions.
    """
    want = events.withColumn("ord", F.explode(F.sequence(F.col("entry_ord") + 1, F.col("entry_ord") + horizon)))
    return want.join(bars, [key, "ord"])


def aligned_returns(series: DataFrame, left, right, key: str = "instrument", value: str = "close") -> DataFrame:
    """Returns of two series on their common dates."""
    a = series.where(F.col(key) == left).select("date", F.col(value).alias("a"))
    b = series.where(F.col(key) == right).select("date", F.col(value).alias("b"))
    w = Window.orderBy("date")  # two series only: bounded by the number of dates
    j = a.join(b, "date")
    ret = lambda c: F.when(F.lag(c).over(w) > 0, (F.col(c) - F.lag(c).over(w)) / F.lag(c).over(w))
    return j.select("date", ret("a").alias("ret_a"), ret("b").alias("ret_b")).where("ret_a is not null and ret_b is not null")


def key_union(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer union of two keyed tables with missing values as zero."""
    o, n = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return o.join(n, key, "full_outer").select(key, zero("old"), zero("new"))
