import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.operators import fusion, panel


def pooled(values):
    """Brute force: the greatest over starts of the least over ends of the weighted mean."""
    mean = lambda a, b: sum(v * w for v, w in values[a : b + 1]) / sum(w for _, w in values[a : b + 1])
    n = len(values)
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_monotone_bins_against_brute_force(spark):
    draw = random.Random(4)
    models = {"up": [(0.1, 5), (0.2, 5), (0.9, 5)], "down": [(0.9, 1), (0.5, 2), (0.1, 3)], "ties": [(0.5, 2), (0.5, 2)], "one": [(0.3, 7)]}
    models |= {f"r{i}": [(round(draw.random(), 4), draw.randint(1, 40)) for _ in range(10)] for i in range(30)}
    rows = [(m, i, v, w) for m, line in models.items() for i, (v, w) in enumerate(line)]
    bins = spark.createDataFrame(rows, "model string, bin int, output double, sample_count long").repartition(5)
    got = {(r["model"], r["bin"]): r["monotone"] for r in fusion.monotone_bins(bins, "model").collect()}
    assert len(got) == len(rows)
    for m, line in models.items():
        assert all(abs(got[m, i] - v) < 1e-4 for i, v in enumerate(pooled(line)))
        assert all(got[m, i] <= got[m, i + 1] for i in range(len(line) - 1))


def test_sketches_merge_to_one_pass_and_skip_known_partitions(spark):
    start = dt.date(2024, 1, 1)
    df = spark.range(60_000).select((F.col("id") % 50_000).alias("instrument"), F.date_add(F.lit(start), (F.col("id") % 90).cast("int")).alias("date"))
    month = F.date_format("date", "yyyy-MM")
    whole = panel.merged_stats(panel.table_sketches(df, F.lit("all"), lg=12), "t").first()
    kept = panel.table_sketches(df.where(month < "2024-03"), month, lg=12)
    merged = panel.merged_stats(panel.refresh_sketches(kept, df, month, lg=12), "t").first()
    assert merged["rows"] == 60_000 and (merged["first_date"], merged["last_date"]) == (start, start + dt.timedelta(89))
    assert abs(merged["instruments"] - whole["instruments"]) <= 0.01 * whole["instruments"]
    assert abs(merged["instruments"] - 50_000) < 3 * 1.04 / 64 * 50_000
    # rows of a known partition are not counted again
    assert panel.merged_stats(panel.refresh_sketches(kept, df.where(month < "2024-03"), month, lg=12), "t").first()["rows"] == kept.agg(F.sum("rows")).first()[0]
    assert tuple(panel.merged_stats(panel.table_sketches(df.limit(0), month), "t").first()) == ("t", 0, None, None, 0)


def test_kept_keys_count_exactly(spark):
    start, n = dt.date(2024, 1, 1), 150_000
    ids = spark.range(n).select(F.when(F.col("id") % 1000 != 0, F.floor(F.col("id") / 2) * 7).alias("instrument"), F.date_add(F.lit(start), (F.col("id") % 90).cast("int")).alias("date"))
    month = F.date_format("date", "yyyy-MM")
    kept = panel.table_keys(ids.where(month < "2024-03"), month)
    want = tuple(panel.table_stats(ids, "t").first())
    assert tuple(panel.merged_key_stats(panel.refresh_keys(kept, ids, month), "t").first()) == want
    assert tuple(panel.merged_key_stats(panel.refresh_keys(kept, ids.where(month < "2024-03"), month), "t").first()) == tuple(panel.table_stats(ids.where(month < "2024-03"), "t").first())
    assert tuple(panel.merged_key_stats(panel.table_keys(ids.limit(0), month), "t").first()) == ("t", 0, None, None, 0)


def test_ledger_ties_go_to_the_lower_entry_price(spark):
    day = dt.date(2024, 1, 1)
    trades = [(k, day, entry, day, 50.0, "stop_loss", 25.0) for k in range(40) for entry in ((40.001, 40.0) if k % 2 else (40.0, 40.001))]
    df = spark.createDataFrame(trades, "instrument long, entry_date date, entry_price double, exit_date date, exit_price double, exit_reason string, pnl_pct double").coalesce(1)
    assert {r["pnl_abs"] for r in panel.trade_ledger(df).where("action = 'exit'").collect()} == {10.0}


def test_ledger_entries_of_one_rounded_price_are_one_row(spark, tmp_path):
    days = [dt.datetime(1995, 8, 13), dt.datetime(1995, 9, 1)]
    # of each day two prices that differ in the seventh digit: (l_extendedprice, l_discount, l_tax)
    lines = [(order, order, 7, number, 1.0, price, off, tax, "N", "O", day) for order, price, off, tax in [(1, 85348.24, 0.03, 0.06), (2, 45348.29, 0.06, 0.07)] for number, day in enumerate(days)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    tables = {"lineitem": (lines, names), "orders": ([(1, "F"), (2, "F")], "o_orderkey long, o_orderstatus string")}
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = entry.queries()["A7_trade_ledger"](spark, str(tmp_path)).select("date", "action", "instrument", "price", "pnl_abs").collect()
    want = con.execute(entry.oracle_sql()["A7_trade_ledger"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and [r["action"] for r in got].count("entry") == 1 and len(got) == 3
