import datetime as dt

from pyspark.sql import functions as F

from tickloom.functions import typing as ty
from tickloom.operators import actions as act
from tickloom.operators import calendar as cal
from tickloom.sources.driver_tables import Tables

D = dt.date


def holidays(spark, rows):
    return cal.classify_holidays(spark.createDataFrame(rows, "era_date string, name string, description string, is_trading string, file_no int"))


def test_classification_rules(spark):
    h = {r.date: r for r in holidays(spark, [
        ("1130101", "New Year", "", "N", 1), ("1130101", "Other", "", "Y", 2), ("1130205", "Eve", "half", "Y", 1),
        ("1130206", "Start", "開始交易日", None, 1), ("1130207", "Storm", "無交易", None, 1), ("1130217", "補行上班", "", "Y", 1), ("bad", "x", "", "N", 1),
    ]).collect()}
    assert len(h) == 5
    assert h[D(2024, 1, 1)].closed and h[D(2024, 1, 1)].name == "New Year"
    assert h[D(2024, 2, 5)].partial and not h[D(2024, 2, 5)].closed
    assert not h[D(2024, 2, 6)].closed and h[D(2024, 2, 7)].closed
    assert h[D(2024, 2, 17)].makeup


def test_calendar_gaps_and_counts(spark):
    hol = holidays(spark, [(f"11302{d:02d}", "Break", "", "N", 1) for d in range(5, 13)])
    bounds = spark.createDataFrame([(D(2024, 1, 29), D(2024, 2, 20))], "first date, last date")
    c = cal.build_calendar(bounds, hol).cache()
    gaps = cal.holiday_gaps(c).collect()
    assert [(g.start, g.end, g.length, g.risk_level) for g in gaps] == [(D(2024, 2, 5), D(2024, 2, 12), 8, "high")]
    near = {r.date: r for r in cal.near_trading_days(c).collect()}
    assert near[D(2024, 2, 2)].next_day == D(2024, 2, 13) and near[D(2024, 2, 13)].prev_day == D(2024, 2, 2)
    r = spark.createDataFrame([(D(2024, 2, 1), D(2024, 2, 14))], "a date, b date")
    assert cal.count_trading_days(r, c, "a", "b", "n").first().n == 4
    risk = {r.date: r.risk_factor for r in cal.holiday_risk(c.select("date"), c).collect()}
    assert risk[D(2024, 1, 29)] == 0.5 and risk[D(2024, 2, 14)] == 1.0


def test_range_that_ends_before_it_starts_holds_no_trading_day(spark):
    c = spark.createDataFrame([(D(2024, 3, d), d, True) for d in range(1, 9)], "date date, ordinal long, is_trading boolean")
    r = spark.createDataFrame([(D(2024, 3, 6), D(2024, 3, 2)), (D(2024, 3, 6), D(2024, 3, 5)), (D(2024, 3, 6), D(2024, 3, 6)), (D(2024, 3, 2), D(2024, 3, 6)), (D(2024, 3, 2), None)], "a date, b date")
    out = {(x.a.day, x.b and x.b.day): x.n for x in cal.count_trading_days(r, c, "a", "b", "n").collect()}
    assert out == {(6, 2): 0, (6, 5): 0, (6, 6): 1, (2, 6): 5, (2, None): None}


def test_backward_adjustment(spark):
    bars = spark.createDataFrame([(1, D(2024, 1, d), float(c), 1000.0) for d, c in ((1, 100), (2, 110), (3, 105), (4, 50))], "instrument long, date date, close double, volume double")
    acts = spark.createDataFrame([(1, D(2024, 1, 3), 10.0, 0.0), (1, D(2024, 1, 4), 0.0, 10.0), (1, D(2024, 1, 9), 5.0, 0.0)], "instrument long, ex_date date, cash_div double, stock_div double")
    out = {r.date.day: r for r in act.backward_adjust(bars, acts).collect()}
    f3, f4 = 100 / 110, 0.5
    assert out[4].adj_close == 50.0 and out[3].adj_close == round(105 * f4, 4)
    assert out[2].adj_close == round(110 * f4 * f3, 4) and out[1].adj_close == round(100 * f4 * f3, 4)
    assert out[3].adj_volume == 2000.0


def test_scalar_parsing(spark):
    df = spark.createDataFrame([("1150105", "2024/03/01", " 50 ", "1,000"), ("junk", "20240301", "12345", "7.5"), (None, "x", "AB", None)], "e string, d string, c string, n string")
    rows = df.select(ty.era_to_date("e").alias("e"), ty.parse_date("d").alias("d"), ty.normalize_code("c").alias("c"), ty.safe_float("n", -1).alias("n")).collect()
    assert [r.e for r in rows] == [D(2026, 1, 5), None, None]
    assert [r.d for r in rows] == [D(2024, 3, 1), D(2024, 3, 1), None]
    assert [r.c for r in rows] == ["0050", "12345", "AB"]
    assert [r.n for r in rows] == [-1.0, 7.5, -1.0]


def test_rounding_helper(spark):
    r = spark.createDataFrame([(-1.255,), (2.5,), (-0.001,), (None,)], "x double").select(ty.rnd("x", 2).alias("a"), ty.rnd("x").alias("b")).collect()
    assert [x.b for x in r] == [-1.0, 3.0, 0.0, None] and r[2].a == 0.0 and str(r[2].a) == "0.0"


def test_bars_of_orders_that_share_numbers(spark, tmp_path):
    """Open and close by order, line, part and price, whatever their size."""
    row = lambda order, line, part, price: (1, "1996-01-02", order, line, part, 1.0, price, 0.0, 0.0, "A")
    ticks = [row(1, 12, 5, 300.0), row(2, 2, 5, 200.0), row(2, 2, 10**14, 100.0), row(10**18, 1, 1, 50.0), row(10**18, 1, 1, 40.0), row(1, 12, 5, 310.0)]
    names = "l_suppkey long, l_shipdate string, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(ticks, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    bar = Tables(spark, str(tmp_path)).bars.first()
    price = lambda x: (100.0 + x / 1e5) / 13**0.5
    assert abs(bar["open"] - price(300.0)) < 1e-12 and abs(bar["close"] - price(50.0)) < 1e-12
