"""Calendar and corporate-action queries (sections C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.typing import date_to_era, rnd
from tickloom.operators import actions as act
from tickloom.operators import calendar as cal
from tickloom.plans.registry import query


@query("C1_classify_holidays", "SELECT date, name, closed, partial, makeup FROM v_hol")
def _(t):
    return t.holidays.select("date", "name", "closed", "partial", "makeup")


@query("C2_trading_day_flags", """SELECT date, is_trading, closed AS is_holiday, partial AS is_half_day FROM v_cal""")
def _(t):
    return t.calendar.select("date", "is_trading", F.col("closed").alias("is_holiday"), F.col("partial").alias("is_half_day"))


@query("C3_session_hours", """
SELECT date, CASE WHEN NOT is_trading THEN 'closed' WHEN partial THEN 'half' ELSE 'full' END AS session,
       CASE WHEN NOT is_trading THEN 0.0e0 WHEN partial THEN 4.0e0 ELSE 6.5e0 END AS hours FROM v_cal""")
def _(t):
    return cal.with_sessions(t.calendar).select("date", "session", "hours")


@query("C4_trading_days_in_range", """
SELECT o_orderkey, s AS start_date, e AS end_date, (SELECT count(*) FROM v_cal_wide c WHERE c.date BETWEEN s AND e AND c.is_trading) AS trading_days
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS e FROM orders) x""")
def _(t):
    r = t.read("orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40).cast("int")).alias("end_date"))
    # the calendar covers the ranges as well as the ticks, so no range falls outside
    span = r.agg(F.min("start_date").alias("first"), F.max("end_date").alias("last")).unionByName(t.bounds)
    wide = cal.build_calendar(span.agg(F.min("first").alias("first"), F.max("last").alias("last")), t.holidays)
    return cal.count_trading_days(r, wide, "start_date", "end_date", "trading_days")


@query("C5_next_prev_trading_day", """
SELECT date, CASE WHEN next_trading - date <= 60 THEN next_trading END AS next_day,
       CASE WHEN date - prev_trading <= 60 THEN prev_trading END AS prev_day,
       date - CAST(greatest(0, isodow(date) - 5) AS INT) AS last_weekday FROM v_cal""")
def _(t):
    return cal.near_trading_days(t.calendar).withColumn("last_weekday", cal.last_weekday_before("date"))


V_GAPS = """
SELECT s AS start, e AS "end", e - s + 1 AS length, reason,
       CASE WHEN e - s + 1 >= 8 THEN 'high' WHEN e - s + 1 >= 4 THEN 'medium' ELSE 'low' END AS risk_level
FROM (SELECT ordinal, min(CASE WHEN isodow(date) < 6 THEN date END) AS s, max(date) AS e,
             coalesce(first(name ORDER BY date) FILTER (WHERE isodow(date) < 6), 'Unknown holiday') AS reason
      FROM v_cal WHERE NOT is_trading GROUP BY ordinal)
WHERE s IS NOT NULL AND (e - s + 1 > 2 OR e = (SELECT max(date) FROM v_cal))"""


@query("C6_holiday_gaps", V_GAPS)
def _(t):
    return cal.holiday_gaps(t.calendar)


@query("C7_holidays_by_year", """
SELECT year(date) AS year, count(*) AS holidays, count(*) FILTER (WHERE closed) AS closed_days,
       count(*) FILTER (WHERE partial) AS partial_days, count(*) FILTER (WHERE makeup) AS makeup_days,
       min(date) AS first_date, first(name ORDER BY date) AS first_name FROM v_hol GROUP BY 1""")
def _(t):
    return t.holidays.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("holidays"),
        F.count_if("closed").alias("closed_days"),
        F.count_if("partial").alias("partial_days"),
        F.count_if("makeup").alias("makeup_days"),
        F.min("date").alias("first_date"),
        F.min_by("name", "date").alias("first_name"),
    )


@query("C8_post_holiday", """
SELECT date, coalesce(date - prev_trading <= 20 AND date - prev_trading > 3, false) AS post_holiday,
       CASE WHEN date - prev_trading <= 20 THEN date - prev_trading ELSE 0 END AS gap_days FROM v_cal""")
def _(t):
    return cal.post_holiday(t.calendar)


@query("C9_holiday_risk_factor", """
SELECT d.date, CASE WHEN max(len) >= 8 THEN 0.5e0 WHEN max(len) >= 4 THEN 0.75e0 ELSE 1.0e0 END AS risk_factor
FROM v_days d LEFT JOIN (
  SELECT d2.date, c.ordinal, max(c.date) - min(CASE WHEN isodow(c.date) < 6 THEN c.date END) + 1 AS len
  FROM v_days d2 JOIN v_cal c ON c.date BETWEEN d2.date AND d2.date + 20 WHERE NOT c.is_trading GROUP BY 1, 2) g ON g.date = d.date
GROUP BY d.date""")
def _(t):
    return cal.holiday_risk(t.days, t.calendar)


@query("C10_holding_days", """
SELECT o_orderkey, min(l.date) AS entry_date, max(l.date) AS exit_date,
       (SELECT count(*) FROM v_cal c WHERE c.is_trading AND c.date BETWEEN min(l.date) AND max(l.date)) AS holding_days
FROM orders JOIN v_ticks l ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _(t):
    spans = t.ticks.groupBy("l_orderkey").agg(F.min("date").alias("entry_date"), F.max("date").alias("exit_date"))
    spans = spans.join(t.read("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")
    return cal.count_trading_days(spans, t.calendar, "entry_date", "exit_date", "holding_days")


@query("C11_ex_dividend_season", """
SELECT date, (month(date) = 7 AND day(date) >= 15) OR month(date) = 8 AS in_season FROM v_days""")
def _(t):
    return t.days.select("date", cal.ex_dividend_season("date").alias("in_season"))


# Raw feeds are text columns derived from the same lines as the actions view.
RAW_EX = """(SELECT CAST(instrument AS VARCHAR) AS code,
  CASE WHEN seq % 11 = 0 THEN 'bad' ELSE lpad(CAST(year(ex_date) - 1911 AS VARCHAR), 3, '0') || strftime(ex_date, '%m%d') END AS era_date,
  CASE WHEN seq % 5 = 0 THEN '' ELSE CAST(cash_div AS VARCHAR) END AS cash_a, CAST(cash_div AS VARCHAR) AS cash_b,
  CASE WHEN seq % 7 = 0 THEN '--' ELSE CAST(stock_div AS VARCHAR) END AS stock_a, 'x' AS stock_b,
  CAST(cash_div * 50 AS VARCHAR) AS ref_a, CAST(stock_div * 3 AS VARCHAR) AS rights_a FROM v_actions_all)"""


def raw_ex(t):
    text = lambda c: F.col(c).cast("string")
    return t.actions_all.select(
        F.col("instrument").cast("string").alias("code"),
        F.when(F.col("seq") % 11 == 0, "bad").otherwise(date_to_era("ex_date")).alias("era_date"),
        F.when(F.col("seq") % 5 == 0, "").otherwise(text("cash_div")).alias("cash_a"),
        text("cash_div").alias("cash_b"),
        F.when(F.col("seq") % 7 == 0, "--").otherwise(text("stock_div")).alias("stock_a"),
        F.lit("x").alias("stock_b"),
        (F.col("cash_div") * 50).cast("string").alias("ref_a"),
        (F.col("stock_div") * 3).cast("string").alias("rights_a"),
    )


@query("D1_parse_ex_feed", f"""
SELECT code, CAST(strptime(CAST(CAST(substr(era_date, 1, 3) AS INT) + 1911 AS VARCHAR) || substr(era_date, 4, 4), '%Y%m%d') AS DATE) AS ex_date,
  round(coalesce(TRY_CAST(cash_a AS DOUBLE), TRY_CAST(cash_b AS DOUBLE), 0), 4) AS cash_div,
  round(coalesce(TRY_CAST(stock_a AS DOUBLE), TRY_CAST(stock_b AS DOUBLE), 0), 4) AS stock_div,
  round(coalesce(TRY_CAST(ref_a AS DOUBLE), 0), 2) AS ref_price, round(coalesce(TRY_CAST(rights_a AS DOUBLE), 0), 2) AS rights_value,
  'official' AS source
FROM {RAW_EX} WHERE era_date <> 'bad'""")
def _(t):
    return act.parse_ex_feed(raw_ex(t), ["cash_a", "cash_b"], ["stock_a", "stock_b"], ["ref_a"], ["rights_a"])


RAW_DECL = """(SELECT CAST(instrument AS VARCHAR) || CASE WHEN seq % 13 = 0 THEN 'B' ELSE '' END AS code,
  lpad(CAST(year(ex_date) - 1911 AS VARCHAR), 3, '0') || strftime(ex_date, '%m%d') AS meeting,
  CAST(cash_div AS VARCHAR) AS c1, CASE WHEN seq % 3 = 0 THEN '0.5' ELSE '' END AS c2, '0' AS c3,
  CAST(stock_div AS VARCHAR) AS s1, CASE WHEN seq % 4 = 0 THEN '0.25' ELSE 'n/a' END AS s2, NULL AS s3, seq FROM v_actions_all)"""


def raw_decl(t):
    text = lambda c: F.col(c).cast("string")
    return t.actions_all.select(
        F.concat(text("instrument"), F.when(F.col("seq") % 13 == 0, "B").otherwise("")).alias("code"),
        date_to_era("ex_date").alias("meeting"),
        text("cash_div").alias("c1"), F.when(F.col("seq") % 3 == 0, "0.5").otherwise("").alias("c2"), F.lit("0").alias("c3"),
        text("stock_div").alias("s1"), F.when(F.col("seq") % 4 == 0, "0.25").otherwise("n/a").alias("s2"),
        F.lit(None).cast("string").alias("s3"), "seq",
    )


DECL = f"""SELECT code, CAST(strptime(CAST(CAST(substr(meeting, 1, 3) AS INT) + 1911 AS VARCHAR) || substr(meeting, 4, 4), '%Y%m%d') AS DATE) + 7 AS ex_date,
  round(coalesce(TRY_CAST(c1 AS DOUBLE), 0) + coalesce(TRY_CAST(c2 AS DOUBLE), 0) + coalesce(TRY_CAST(c3 AS DOUBLE), 0), 4) AS cash_div,
  round(coalesce(TRY_CAST(s1 AS DOUBLE), 0) + coalesce(TRY_CAST(s2 AS DOUBLE), 0) + coalesce(TRY_CAST(s3 AS DOUBLE), 0), 4) AS stock_div, seq FROM {RAW_DECL}"""


@query("D2_parse_declarations", f"""
SELECT code, ex_date, cash_div, stock_div, 'declaration' AS source FROM ({DECL}) x
WHERE NOT (code LIKE '%B' OR code LIKE '%R') AND (cash_div > 0 OR stock_div > 0)
QUALIFY row_number() OVER (PARTITION BY code, ex_date ORDER BY seq, cash_div, stock_div) = 1""")
def _(t):
    return act.parse_declarations(raw_decl(t), ["c1", "c2", "c3"], ["s1", "s2", "s3"], "meeting")


@query("D3_estimated_ex_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS ex_date FROM orders""")
def _(t):
    era = date_to_era(F.col("o_orderdate").cast("date"))
    return t.read("orders").select("o_orderkey", act.estimate_ex_date(era).alias("ex_date"))


@query("D4_merge_actions", "SELECT instrument, ex_date, cash_div, stock_div, source FROM v_actions")
def _(t):
    return t.actions.select("instrument", "ex_date", "cash_div", "stock_div", "source")


@query("D5_action_on_date", """
SELECT b.instrument, b.date, a.ex_date IS NOT NULL AS is_ex_date, coalesce(a.cash_div, 0.0e0) AS cash_div,
       coalesce(a.stock_div, 0.0e0) / 10.0e0 AS stock_ratio
FROM v_bars b LEFT JOIN v_action_day a ON a.instrument = b.instrument AND a.ex_date = b.date""")
def _(t):
    a = t.action_days.withColumnRenamed("ex_date", "date").withColumn("hit", F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return t.bars.join(a, ["instrument", "date"], "left").select(
        "instrument", "date", F.col("hit").isNotNull().alias("is_ex_date"),
        zero("cash_div").alias("cash_div"), (zero("stock_div") / 10.0).alias("stock_ratio"))


@query("D5_codes_by_ex_date", """
SELECT DISTINCT ex_date, CAST(instrument AS VARCHAR) AS code, codes FROM v_actions JOIN (SELECT ex_date, count(DISTINCT instrument) AS codes FROM v_actions GROUP BY 1) USING (ex_date)""")
def _(t):
    codes = t.actions.select("ex_date", F.col("instrument").cast("string").alias("code")).distinct()
    # one row per code: a day with very many codes is not one value
    return codes.join(codes.groupBy("ex_date").agg(F.count("*").alias("codes")), "ex_date")


@query("D6_validate_ex_dates", """
SELECT instrument, ex_date, 'duplicate' AS issue, 'low' AS severity, CAST(sum(n - 1) AS BIGINT) AS issues FROM (
  SELECT instrument, ex_date, round(cash_div, 4) c, round(stock_div, 4) s, count(*) n FROM v_actions_all GROUP BY ALL) WHERE n > 1 GROUP BY 1, 2
UNION ALL
SELECT instrument, ex_date, 'closed_day', CASE WHEN source = 'official' THEN 'medium' ELSE 'high' END, count(*)
FROM v_actions_all WHERE ex_date IN (SELECT date FROM v_cal WHERE NOT is_trading) GROUP BY ALL""")
def _(t):
    return act.validate_ex_dates(t.actions_all, t.calendar)


@query("D7_backward_adjust", """
SELECT instrument, date, round(close, 6) AS close, adj_close, adj_volume, cumulative_factor FROM v_adj""")
def _(t):
    return t.adj.select("instrument", "date", rnd("close", 6).alias("close"), "adj_close", "adj_volume", "cumulative_factor")


@query("D8_unadjusted_price", """
SELECT instrument, date, cash_div IS NOT NULL AS skip_stop_check,
       round((close + coalesce(cash_div, 0)) * (1.0e0 + coalesce(stock_div, 0) / 10.0e0), 6) AS check_price FROM v_adj""")
def _(t):
    a = t.action_days.withColumnRenamed("ex_date", "date")
    return t.bars.join(a, ["instrument", "date"], "left").select(
        "instrument", "date", F.col("cash_div").isNotNull().alias("skip_stop_check"),
        rnd(act.unadjusted_price("close"), 6).alias("check_price"))


@query("D9_forward_yield", """
SELECT b.instrument, b.date, round(coalesce(sum(a.cash_div), 0) / any_value(b.close) * 100, 2) AS yield_pct
FROM v_bars b LEFT JOIN v_actions a ON a.instrument = b.instrument AND a.ex_date BETWEEN b.date AND b.date + 365
GROUP BY b.instrument, b.date""")
def _(t):
    return act.forward_yield(t.bars.select("instrument", "date", F.col("close").alias("price")), t.actions)


@query("D10_action_summary", """
SELECT source, count(*) AS actions, count(DISTINCT instrument) AS instruments,
       (SELECT count(DISTINCT instrument) FROM v_adj WHERE abs(adj_close - close) > 0.001e0) AS adjusted_instruments
FROM v_actions GROUP BY source""")
def _(t):
    adjusted = (
        t.adj.where("abs(adj_close - close) > 0.001D").groupBy("instrument").count()
        .agg(F.count("*").alias("adjusted_instruments"))
    )
    return t.actions.groupBy("source").agg(
        F.count("*").alias("actions"), F.count_distinct("instrument").alias("instruments")).crossJoin(adjusted)
