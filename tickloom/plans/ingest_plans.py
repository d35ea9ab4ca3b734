"""Sources, sinks and ingestion quality (sections A and B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from tickloom import params
from tickloom.functions import typing as ty
from tickloom.functions.typing import lookup, rnd
from tickloom.operators import panel
from tickloom.operators import quality as qa
from tickloom.plans.market_plans import raw_regimes
from tickloom.plans.panel_plans import trades
from tickloom.plans.registry import query
from tickloom.plans.screen_plans import screened
from tickloom.sources import snapshots as sn
from tickloom.sources.sql_views import VIEWS
from tickloom.sources.store import fresh_path
from tickloom.sources.stored import StoredTable, load

VIEWS["v_raw"] = """
SELECT instrument, date, date_trunc('month', date)::DATE AS snapshot, CAST(instrument AS VARCHAR) || CASE WHEN instrument % 40 = 9 THEN 'B' ELSE '' END AS code, CASE WHEN instrument % 6 = 0 THEN '' ELSE 'Firm ' || instrument END AS name_a, 'Name ' || instrument AS name_b,
  CASE CAST((instrument + day(date)) % 50 AS INT) WHEN 0 THEN '' WHEN 1 THEN '--' WHEN 2 THEN '1,234.5' WHEN 3 THEN 'NaN' WHEN 4 THEN '-5' ELSE CAST(round(close, 4) AS VARCHAR) END AS closing_price,
  CASE WHEN (instrument + day(date)) % 31 = 0 THEN NULL ELSE CAST(CAST(volume AS BIGINT) AS VARCHAR) END AS trade_volume, CAST(round(open, 4) AS VARCHAR) AS opening_price FROM v_bars"""


def raw(t):
    i, d = F.col("instrument"), F.dayofmonth("date")
    m = (i + d) % 50
    text = lambda c: F.col(c).cast("string")
    close = F.when(m == 0, "").when(m == 1, "--").when(m == 2, "1,234.5").when(m == 3, "NaN").when(m == 4, "-5").otherwise(rnd("close", 4).cast("string"))
    return t.bars.select(
        "instrument", "date", F.trunc("date", "month").alias("snapshot"), F.concat(text("instrument"), F.when(i % 40 == 9, "B").otherwise("")).alias("code"),
        F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("Firm "), text("instrument"))).alias("name_a"), F.concat(F.lit("Name "), text("instrument")).alias("name_b"),
        close.alias("closing_price"), F.when((i + d) % 31 != 0, F.col("volume").cast("bigint").cast("string")).alias("trade_volume"), rnd("open", 4).cast("string").alias("opening_price"))


RAW_SCHEMA = StructType().add("instrument", "long").add("date", "date").add("code", "string").add("closing_price", "string").add("trade_volume", "string").add("snapshot", "date")


def snapshot_root(t):
    root = fresh_path(t.spark, "snapshots")
    sn.write_json_snapshot(raw(t).select("instrument", "date", "code", "closing_price", "trade_volume", "snapshot"), root, "daily", "snapshot")
    return root


@query("A1_read_snapshot", "SELECT instrument, date, code, closing_price, trade_volume FROM v_raw WHERE snapshot = (SELECT max(snapshot) FROM v_raw)")
def _(t):
    df = sn.read_dataset(t.spark, snapshot_root(t), "daily", RAW_SCHEMA)
    return sn.on_date(df, "snapshot").select("instrument", "date", "code", "closing_price", "trade_volume")


@query("A2_merge_history_files", "SELECT strftime(snapshot, '%Y-%m-%d') AS file_date, count(*) AS rows, count(DISTINCT instrument) AS instruments FROM v_raw GROUP BY 1")
def _(t):
    df = sn.read_dataset(t.spark, snapshot_root(t), "daily", RAW_SCHEMA)
    return sn.merge_files(df, r"snapshot=(\d{4}-\d{2}-\d{2})").groupBy("file_date").agg(F.count("*").alias("rows"), F.count_distinct("instrument").alias("instruments"))


@query("A3_missing_dates", """
SELECT c.date FROM v_cal c, (SELECT max(date) AS m FROM v_days) x WHERE c.is_trading AND c.date BETWEEN x.m - CAST(floor(2000 * 1.2) AS INT) AND x.m AND c.date NOT IN (SELECT date FROM v_bars WHERE trades > 2)""")
def _(t):
    as_of = t.bounds.select(F.col("last").alias("as_of"))
    return panel.missing_dates(t.calendar, t.bars.where("trades > 2"), as_of, 2000)  # a date counts once an instrument has traded on it often enough


@query("A4_panel_upsert", """
SELECT instrument, date, round(close, 4) AS close FROM v_bars WHERE date < DATE '1999-01-01'
UNION ALL SELECT instrument, date, 1.0e0 FROM v_bars b WHERE date >= DATE '1999-01-01'""")
def _(t):
    rows = t.bars.select("instrument", "date", rnd("close", 4).alias("close"))
    old = rows.where("date < '1999-01-01'")
    new = rows.withColumn("close", F.lit(1.0))
    return panel.upsert_first(old, new, ["instrument", "date"], ["close"])


@query("A5_action_upsert", """
SELECT instrument, ex_date, first(source ORDER BY source = 'declaration', seq) AS source, first(cash_div ORDER BY source = 'declaration', seq) AS cash_div FROM v_actions_all GROUP BY 1, 2""")
def _(t):
    a = t.actions_all.select("instrument", "ex_date", "source", "cash_div", "seq")
    return panel.upsert_priority([a.where("source = 'official'"), a.where("source = 'declaration'")], ["instrument", "ex_date"], ["seq"]).drop("seq")


@query("A7_trade_ledger", """
SELECT entry_date AS date, 'entry' AS action, instrument, round(entry_price, 6) AS price, NULL::DOUBLE AS pnl_abs FROM v_trades GROUP BY ALL
UNION ALL SELECT exit_date, 'exit', instrument, round(exit_price, 6), round(first(entry_price * pnl_pct / 100 ORDER BY pnl_pct, entry_price), 4) FROM v_trades WHERE exit_date IS NOT NULL GROUP BY exit_date, instrument, exit_price""")
def _(t):
    # entries are told apart by the rounded price, exits by the price itself
    return panel.trade_ledger(trades(t), entry_digits=6).select("date", "action", "instrument", rnd("price", 6).alias("price"), "pnl_abs")


@query("A8_replace_run", "SELECT instrument, composite_score, bucket FROM v_screen")
def _(t):
    path = fresh_path(t.spark, "runs")
    s = screened(t).select("instrument", "composite_score", "bucket")
    sn.replace_partitions(s.withColumn("run_date", F.lit("2001-11-04")).withColumn("composite_score", F.lit(0.0)), path, "run_date")
    sn.replace_partitions(s.withColumn("run_date", F.lit("2001-11-05")), path, "run_date")
    return sn.read_run(t.spark, path, "run_date", "composite_score").select("instrument", "composite_score", "bucket")


@query("A9_snapshot_sink", "SELECT snapshot, count(*) AS records FROM v_raw GROUP BY 1")
def _(t):
    df = sn.read_dataset(t.spark, snapshot_root(t), "daily", RAW_SCHEMA)
    return df.groupBy("snapshot").agg(F.count("*").alias("records"))


@query("A10_backfill_actions", """
SELECT instrument, date, cash AS cash_div, CASE WHEN split > 1 THEN (split - 1) * 10 ELSE 0.0e0 END AS stock_div FROM (
 SELECT instrument, ex_date AS date, CASE WHEN seq % 3 = 0 THEN 0.0e0 ELSE cash_div END AS cash, CASE WHEN seq % 2 = 0 THEN 1.0e0 + stock_div ELSE 0.0e0 END AS split FROM v_actions_all)
WHERE year(date) BETWEEN 1996 AND 2000 AND (cash > 0 OR split > 0)""")
def _(t):
    f = t.actions_all.select("instrument", F.col("ex_date").alias("date"), F.when(F.col("seq") % 3 == 0, 0.0).otherwise(F.col("cash_div")).alias("cash"),
                             F.when(F.col("seq") % 2 == 0, F.col("stock_div") + 1.0).otherwise(0.0).alias("split"))
    return sn.backfill_actions(f, 1996, 2000)


@query("A11_universe", """
SELECT DISTINCT CASE WHEN length(code) < 4 THEN lpad(code, 4, '0') ELSE code END AS code FROM v_raw WHERE snapshot IN (SELECT DISTINCT snapshot FROM v_raw ORDER BY snapshot DESC LIMIT 3) AND NOT (code LIKE '%B' OR code LIKE '%R')""")
def _(t):
    return sn.universe(raw(t), "code", "snapshot")


@query("A12_parameter_tables", """
SELECT name, coalesce(v, d) AS value FROM (VALUES ('revenue', 0.2e0), ('profitability', 0.25e0), ('valuation', 0.15e0), ('flow', 0.2e0), ('momentum', 0.2e0)) p(name, d)
LEFT JOIN (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'flow' WHEN '2-HIGH' THEN 'revenue' WHEN '3-MEDIUM' THEN 'unknown' WHEN '5-LOW' THEN 'momentum' ELSE 'other' END AS n, round(count(*) * 1.0e0 / (SELECT count(*) FROM orders), 6) AS v FROM orders GROUP BY 1) g ON g.n = p.name""")
def _(t):
    o = t.read("orders")
    total = o.agg(F.count("*").alias("total"))
    given = o.groupBy(lookup(F.col("o_orderpriority"), {"1-URGENT": "flow", "2-HIGH": "revenue", "3-MEDIUM": "unknown", "5-LOW": "momentum"}, "other").alias("name")).agg(F.count("*").alias("n"))
    given = given.crossJoin(F.broadcast(total)).select("name", rnd(F.col("n") / F.col("total"), 6).alias("value"))  # total is one row
    return sn.parameter_table(t.spark, params.STAGE1_WEIGHTS, given)


REGIME_OF = {"1-URGENT": "normal", "2-HIGH": "caution", "3-MEDIUM": "stress", "4-NOT SPECIFIED": "crisis", "5-LOW": "panic"}
FACTOR_OF = {"F": "revenue", "O": "valuation"}
_cases = lambda column, names, other: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{other}' END"


@query("A12_parameter_files", f"""
WITH d(path, x) AS (VALUES {", ".join(f"('regime_weights.{r}.{k}', {v}e0)" for r, w in params.REGIME_WEIGHTS.items() for k, v in w.items())}, ('max_weight', {params.MAX_WEIGHT}e0)),
g AS (SELECT 'regime_weights.' || {_cases("o_orderpriority", REGIME_OF, "none")} || '.' || {_cases("o_orderstatus", FACTOR_OF, "liquidity")} AS path, {_cases("o_orderpriority", REGIME_OF, "none")} = 'crisis' AS words, count(*) / 8.0e0 AS n FROM orders GROUP BY 1, 2)
SELECT coalesce(d.path, g.path) AS path, CASE WHEN d.path IS NULL THEN CASE WHEN NOT words THEN n END WHEN g.path IS NULL OR words THEN x ELSE n END AS number, CASE WHEN d.path IS NULL AND words THEN 'n/a' END AS text,
  CASE WHEN d.path IS NULL THEN 'unknown' WHEN g.path IS NULL THEN 'default' WHEN words THEN 'wrong type' ELSE 'given' END AS status FROM d FULL JOIN g ON d.path = g.path""")
def _(t):
    o = t.read("orders").select(lookup(F.col("o_orderpriority"), REGIME_OF, "none").alias("regime"), lookup(F.col("o_orderstatus"), FACTOR_OF, "liquidity").alias("factor"))
    counts = o.groupBy("regime", "factor").agg((F.count("*") / 8.0).alias("n"))
    value = F.when(F.col("regime") == "crisis", '"n/a"').otherwise(F.col("n").cast("string"))
    inner = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('"'), "factor", F.lit('": '), value))), ", ")  # three factors
    bodies = counts.groupBy("regime").agg(F.concat(F.lit('{"regime_weights": {"'), "regime", F.lit('": {'), inner, F.lit("}}}")).alias("value"))
    root = fresh_path(t.spark, "parameters")
    bodies.repartition("regime").write.partitionBy("regime").text(root)  # a file for each regime
    files = sn.read_parameter_files(t.spark, root, "*.txt")
    return sn.nested_parameters(t.spark, {"regime_weights": params.REGIME_WEIGHTS, "max_weight": params.MAX_WEIGHT}, sn.flatten_parameters(files))


@query("A13_completed_signals", "SELECT trade_id, pnl_pct FROM v_trades WHERE exit_price IS NOT NULL")
def _(t):
    path = fresh_path(t.spark, "calibration-log")
    done = trades(t).where("exit_price is not null").select("trade_id", "pnl_pct")
    done.where("trade_id % 2 = 0").write.mode("append").parquet(path)
    done.where("trade_id % 2 = 1").write.mode("append").parquet(path)
    return t.spark.read.schema(done.schema).parquet(path)


BARS = T.StructType([T.StructField("instrument", T.LongType()), T.StructField("date", T.DateType()), T.StructField("close", T.DoubleType())])
ACTIONS = T.StructType([T.StructField("instrument", T.LongType()), T.StructField("ex_date", T.DateType()), T.StructField("source", T.StringType()), T.StructField("cash_div", T.DoubleType())])
REGIMES = T.StructType([T.StructField("date", T.DateType()), T.StructField("raw_regime", T.StringType())])
LEDGER = T.StructType([T.StructField("date", T.DateType()), T.StructField("action", T.StringType()), T.StructField("instrument", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("pnl_abs", T.DoubleType())])


def stored_tables(t) -> dict[str, StoredTable]:
    """Empty stored tables of their own: dates by month or year."""
    root = fresh_path(t.spark, "loads")
    make = lambda name, schema, keys, part: StoredTable(t.spark, f"{root}/{name}", schema, keys, part)
    return {
        "bars": make("bars", BARS, ["instrument", "date"], F.date_format("date", "yyyy-MM")),
        "actions": make("actions", ACTIONS, ["instrument", "ex_date"], F.year("ex_date")),
        "regimes": make("regimes", REGIMES, ["date"], F.year("date")),
        "ledger": make("ledger", LEDGER, ["date", "action", "instrument", "price"], F.date_format("date", "yyyy-MM")),
    }


def load_rows(t, early: bool, name: str) -> DataFrame:
    """What a table is loaded with first (up to 1998, official actions, regimes still unknown) and later (everything).

    Several loads read the bars and the ledger, so both come from stored tables.
    """
    if name == "actions":
        rows = t.actions_all.select("instrument", "ex_date", "source", "cash_div", "seq", (F.col("source") == "declaration").cast("int").alias("late"))
        return rows.where("late = 0") if early else rows
    if name == "regimes":
        rows = raw_regimes(t).select("date", "raw_regime")
        return rows.where("date < '1999-01-01'").withColumn("raw_regime", F.lit("unknown")) if early else rows
    if name == "bars":
        rows = t.panel.select("instrument", "date", rnd("close", 4).alias("close"))
    else:
        rows = t.shared("ledger-rows", ("lineitem", "orders"), lambda: panel.trade_ledger(trades(t)).select("date", "action", "instrument", "price", "pnl_abs"))
    return rows.where("date < '1999-01-01'") if early else rows


LOAD_ORDER = {"bars": ["close"], "actions": ["late", "seq"], "regimes": ["raw_regime"], "ledger": ["pnl_abs"]}


@query("A14_stored_load", """
WITH n AS (
  SELECT 'bars' AS name, count(*) FILTER (WHERE date < DATE '1999-01-01') AS early, count(*) FILTER (WHERE date < DATE '1999-01-01') AS early_rows, count(*) AS whole, count(*) AS whole_rows, 0 AS again FROM v_bars
  UNION ALL SELECT 'actions', count(DISTINCT (instrument, ex_date)) FILTER (WHERE source = 'official'), count(*) FILTER (WHERE source = 'official'), count(DISTINCT (instrument, ex_date)), count(*), 0 FROM v_actions_all
  UNION ALL SELECT 'regimes', count(*) FILTER (WHERE date < DATE '1999-01-01'), count(*) FILTER (WHERE date < DATE '1999-01-01'), count(*), count(*), count(*) FILTER (WHERE date < DATE '1999-01-01' AND raw_regime <> 'unknown') FROM v_raw_regime
  UNION ALL SELECT 'ledger', count(*) FILTER (WHERE date < DATE '1999-01-01'), count(*) FILTER (WHERE date < DATE '1999-01-01'), count(*), count(*), 0 FROM (
    SELECT entry_date AS date, 'entry' AS action, instrument, entry_price AS price FROM v_trades GROUP BY ALL UNION ALL SELECT exit_date, 'exit', instrument, exit_price FROM v_trades WHERE exit_date IS NOT NULL GROUP BY ALL))
SELECT 1 AS run, name AS "table", early AS inserted, early_rows - early AS skipped FROM n
UNION ALL SELECT 2, name, whole - early + again, whole_rows - (whole - early + again) FROM n
UNION ALL SELECT 3, name, 0, whole_rows FROM n""")
def _(t):
    tables, out = stored_tables(t), None
    for run, early in ((1, True), (2, False), (3, False)):
        n = load(tables, {name: load_rows(t, early, name) for name in tables}, LOAD_ORDER, replaced=["regimes"]).select(F.lit(run).alias("run"), "table", "inserted", "skipped")
        out = n if out is None else out.unionByName(n)
    return out


@query("A4_stored_upsert", """
SELECT instrument, date, CASE WHEN date < DATE '1999-01-01' THEN round(close, 4) ELSE 1.0e0 END AS close FROM v_bars""")
def _(t):
    table, rows = stored_tables(t)["bars"], load_rows(t, False, "bars")
    table.insert(rows.where("date < '1999-01-01'"), LOAD_ORDER["bars"])
    table.insert(rows.withColumn("close", F.lit(1.0)), LOAD_ORDER["bars"])
    return table.rows()


@query("A6_stored_replace", "SELECT date, raw_regime FROM v_raw_regime")
def _(t):
    table = stored_tables(t)["regimes"]
    for early in (True, False):
        table.replace(load_rows(t, early, "regimes"), LOAD_ORDER["regimes"])
    return table.rows()


@query("A14_load_counts", """
SELECT 'bars' AS "table", count(*) FILTER (WHERE date >= DATE '1999-01-01') AS inserted, count(*) FILTER (WHERE date < DATE '1999-01-01') AS skipped FROM v_bars
UNION ALL SELECT 'actions', count(DISTINCT (instrument, ex_date)) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v_actions_all o WHERE o.source = 'official' AND o.instrument = a.instrument AND o.ex_date = a.ex_date)),
  count(*) - count(DISTINCT (instrument, ex_date)) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v_actions_all o WHERE o.source = 'official' AND o.instrument = a.instrument AND o.ex_date = a.ex_date)) FROM v_actions_all a
UNION ALL SELECT 'regimes', count(*) FILTER (WHERE date >= DATE '1999-01-01'), count(*) FILTER (WHERE date < DATE '1999-01-01') FROM v_raw_regime
UNION ALL SELECT 'trades', count(*) FILTER (WHERE entry_date >= DATE '1999-01-01'), count(*) FILTER (WHERE entry_date < DATE '1999-01-01') FROM v_trades""")
def _(t):
    # what was loaded up to 1998 (official actions), then everything again
    b, a, r, tr = t.bars.select("instrument", "date"), t.actions_all, raw_regimes(t).select("date", "raw_regime"), trades(t)
    return sn.load_counts(
        [("bars", b.where("date < '1999-01-01'")), ("actions", a.where("source = 'official'")), ("regimes", r.where("date < '1999-01-01'")), ("trades", tr.where("entry_date < '1999-01-01'"))],
        [("bars", b), ("actions", a), ("regimes", r), ("trades", tr)],
        {"bars": ["instrument", "date"], "actions": ["instrument", "ex_date"], "regimes": ["date"], "trades": ["trade_id"]})


@query("B1_safe_float", "SELECT instrument, date, coalesce(TRY_CAST(nullif(closing_price, 'NaN') AS DOUBLE), 0) AS close, coalesce(TRY_CAST(trade_volume AS DOUBLE), -1) AS volume FROM v_raw")
def _(t):
    return raw(t).select("instrument", "date", ty.safe_float(F.nullif("closing_price", F.lit("NaN"))).alias("close"), ty.safe_float("trade_volume", -1.0).alias("volume"))


@query("B2_parse_float", "SELECT instrument, date, TRY_CAST(nullif(closing_price, 'NaN') AS DOUBLE) AS close FROM v_raw")
def _(t):
    return raw(t).select("instrument", "date", ty.parse_float("closing_price").alias("close"))


@query("B3_first_filled", "SELECT instrument, date, coalesce(nullif(name_a, ''), nullif(name_b, ''), '') AS name FROM v_raw")
def _(t):
    return raw(t).select("instrument", "date", ty.first_filled("name_a", "name_b", default="").alias("name"))


@query("B4_rename_aliases", """SELECT code, name_b AS name, coalesce(closing_price, opening_price) AS closing_price, trade_volume FROM v_raw""")
def _(t):
    src = raw(t).select(F.col("code").alias("證券代號"), F.col("name_b").alias("name"), F.col("closing_price").alias("收盤價"), F.col("opening_price").alias("closing_price"), F.col("trade_volume").alias("成交股數"))
    return src.select(*ty.rename_aliases(src.columns, qa.FIELD_ALIASES))


@query("B5_era_dates", """
SELECT o_orderkey, lpad(CAST(year(o_orderdate) - 1911 AS VARCHAR), 3, '0') || strftime(o_orderdate, '%m%d') AS era, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS back FROM orders""")
def _(t):
    o = t.read("orders").select("o_orderkey", ty.date_to_era(F.col("o_orderdate").cast("date")).alias("era"))
    return o.withColumn("back", ty.era_to_date(F.when(F.col("o_orderkey") % 9 == 0, "0991399").otherwise(F.col("era"))))


@query("B6_parse_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def _(t):
    d = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy/MM/dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyyMMdd")).otherwise("soon")
    return t.read("orders").select("o_orderkey", ty.parse_date(text).alias("parsed"))


@query("B7_normalize_code", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'ETF' || p_partkey WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END AS code FROM part""")
def _(t):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 3, F.concat(F.lit("ETF"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit(" 00"), k.cast("string"), F.lit(" "))).otherwise(k.cast("string"))
    return t.read("part").select("p_partkey", ty.normalize_code(text).alias("code"))


@query("B8_market_segment", "SELECT p_partkey, (p_partkey * 7 % 12000) >= 9900 OR (p_partkey * 7 % 12000) BETWEEN 6000 AND 7999 AS second_board FROM part")
def _(t):
    return t.read("part").select("p_partkey", ty.second_board((F.col("p_partkey") * 7 % 12000).cast("string")).alias("second_board"))


@query("B9_transaction_cost", "SELECT p_partkey, CASE WHEN (p_partkey * 7 % 12000) >= 9900 OR (p_partkey * 7 % 12000) BETWEEN 6000 AND 7999 THEN 0.007e0 ELSE 0.006e0 END AS cost FROM part")
def _(t):
    return t.read("part").select("p_partkey", ty.round_trip_cost((F.col("p_partkey") * 7 % 12000).cast("string")).alias("cost"))


@query("B10_sector_counts", """
SELECT coalesce(s.sector, 'other') AS sector, count(*) AS instruments FROM (SELECT DISTINCT instrument FROM v_days_inst) i LEFT JOIN (SELECT instrument, CASE WHEN instrument % 12 <> 5 THEN sector END AS sector FROM v_sectors) s ON s.instrument = i.instrument GROUP BY 1""")
def _(t):
    known = t.sectors.select("instrument", F.when(F.col("instrument") % 12 != 5, F.col("sector")).alias("sector"))
    x = t.ticks.select("instrument").distinct().join(known, "instrument", "left")
    return x.groupBy(F.coalesce("sector", F.lit("other")).alias("sector")).agg(F.count("*").alias("instruments")).orderBy(F.desc("instruments"), "sector")


VIEWS["v_raw_checked"] = """
SELECT *, concat_ws(',', CASE WHEN NOT coalesce(TRY_CAST(nullif(closing_price, 'NaN') AS DOUBLE) > 0, false) THEN 'closing_price' END, CASE WHEN NOT coalesce(TRY_CAST(trade_volume AS DOUBLE) >= 0, false) THEN 'trade_volume' END) AS errors FROM v_raw"""


def checked_daily(t):
    x = raw(t).withColumn("highest_price", F.lit(None).cast("string")).withColumn("lowest_price", F.lit(None).cast("string"))
    return qa.check_rows(x, qa.daily_rules())


@query("B11_row_rules", "SELECT instrument, date, errors, errors = '' AS valid FROM v_raw_checked")
def _(t):
    return checked_daily(t).select("instrument", "date", F.concat_ws(",", "errors").alias("errors"), "valid")


@query("B11_price_point_rules", """
SELECT instrument, date, CASE WHEN closing_price = '-5' OR TRY_CAST(nullif(closing_price, 'NaN') AS DOUBLE) IS NULL THEN false ELSE true END AS valid, CASE WHEN TRY_CAST(nullif(closing_price, 'NaN') AS DOUBLE) > 0 THEN TRY_CAST(closing_price AS DOUBLE) END AS adj_close FROM v_raw""")
def _(t):
    x = raw(t).select("instrument", F.col("date").alias("day"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("closing_price").alias("close"),
                      F.lit(None).cast("string").alias("adj_close"), F.lit(None).cast("string").alias("volume"))
    c = qa.check_rows(x, qa.price_point_rules())
    return c.select("instrument", F.col("day").alias("date"), "valid", qa.default_adj_close().alias("adj_close"))


@query("B11_record_rules", """
SELECT 'valuation' AS dataset, count(*) AS rows, count(*) FILTER (WHERE pb - 1.5e0 < 0) AS error_rows FROM v_val_latest
UNION ALL SELECT 'company', count(*), count(*) FILTER (WHERE s_acctbal < 0) FROM supplier
UNION ALL SELECT 'revenue', count(*), count(*) FILTER (WHERE revenue < 1e5) FROM v_revenue
UNION ALL SELECT 'action', count(*), count(*) FILTER (WHERE seq % 11 = 0 OR cash_div < 1.2e0) FROM v_actions_all
UNION ALL SELECT 'regime', count(*), count(*) FILTER (WHERE day(date) = 1) FROM v_raw_regime
UNION ALL SELECT 'holiday', count(*), count(*) FILTER (WHERE name = 'Eve') FROM v_raw_hol""")
def _(t):
    code = F.col("instrument").cast("string").alias("code")
    batches = {
        "valuation": (t.valuation_latest.select(code, (F.col("pb") - 1.5).cast("string").alias("pb_ratio")), qa.valuation_rules()),
        "company": (t.read("supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_acctbal").cast("string").alias("paid_in_capital")), qa.company_rules()),
        "revenue": (t.monthly_revenue.select(code, (F.col("revenue") - 1e5).cast("string").alias("revenue")), qa.revenue_rules()),
        "action": (t.actions_all.select(code, F.when(F.col("seq") % 11 != 0, F.col("ex_date")).alias("ex_date"), (F.col("cash_div") - 1.2).cast("string").alias("cash_div"), "stock_div"), qa.action_rules()),
        "regime": (raw_regimes(t).select(F.when(F.dayofmonth("date") == 1, "sideways").otherwise(F.col("raw_regime")).alias("regime"), F.lit("high").alias("confidence"), F.lit(1).alias("days_in_regime")), qa.regime_rules()),
        "holiday": (t.raw_holidays.select("era_date", F.when(F.col("name") != "Eve", F.col("name")).alias("name")), qa.holiday_rules()),
    }
    checked = [qa.batch_report(qa.check_rows(df, rules).withColumn("dataset", F.lit(name)), ["dataset"]) for name, (df, rules) in batches.items()]
    return reduce(DataFrame.unionByName, checked).select("dataset", "rows", "error_rows")


@query("B12_batch_validation", """
SELECT snapshot, count(*) AS rows, count(*) FILTER (WHERE errors = '') AS valid_rows, count(*) FILTER (WHERE errors <> '') AS error_rows, round(count(*) FILTER (WHERE errors <> '') * 1.0e0 / count(*), 6) AS error_rate,
  count(*) FILTER (WHERE errors <> '') * 1.0e0 / count(*) > 0.05e0 AS warn FROM v_raw_checked GROUP BY 1""")
def _(t):
    return qa.batch_report(checked_daily(t), ["snapshot"])


GATE_SRC = """(SELECT 'daily' AS dataset, count(*) AS rows, count(*) FILTER (WHERE errors <> '') AS e FROM v_raw_checked UNION ALL
 SELECT 'company', count(*), count(*) FILTER (WHERE paid_in_capital < 1.5e9) FROM v_company UNION ALL SELECT 'valuation', count(*), count(*) FILTER (WHERE (pe >= 0) IS NOT TRUE) FROM v_val_latest)"""


def reports(t):
    d = qa.batch_report(checked_daily(t).withColumn("dataset", F.lit("daily")), ["dataset"])
    c = qa.batch_report(qa.check_rows(t.company.withColumn("dataset", F.lit("company")), {"paid_in_capital": F.col("paid_in_capital") >= 1.5e9}), ["dataset"])
    v = qa.batch_report(qa.check_rows(t.valuation_latest.withColumn("dataset", F.lit("valuation")), {"pe": F.col("pe") >= 0}), ["dataset"])
    return d.unionByName(c).unionByName(v)


@query("B13_quality_gate", f"""
SELECT dataset, CAST(rows AS BIGINT) AS rows, CAST(e AS BIGINT) AS error_rows, round(e * 1.0e0 / rows, 6) AS error_rate, dataset = 'daily' AND round(e * 1.0e0 / rows, 6) > 0.1e0 AS abort
FROM (SELECT * FROM {GATE_SRC} UNION ALL SELECT 'total', sum(rows), sum(e) FROM {GATE_SRC})""")
def _(t):
    return qa.quality_gate(reports(t))


@query("B14_completeness_gate", f"SELECT dataset, rows, CASE dataset WHEN 'daily' THEN 500 WHEN 'company' THEN 500 ELSE 50 END AS required, rows >= CASE dataset WHEN 'daily' THEN 500 WHEN 'company' THEN 500 ELSE 50 END AS complete FROM {GATE_SRC}")
def _(t):
    return qa.completeness(reports(t), {"daily": 500, "company": 500, "valuation": 50})


@query("B15_candidate_validation", """
SELECT instrument, concat_ws(',', CASE WHEN m IS NULL OR m > 90 THEN 'momentum' END) AS errors, coalesce(m, 25.0e0) AS soft_momentum FROM (SELECT instrument, CASE WHEN instrument % 9 <> 4 THEN s_mom + CASE WHEN instrument % 13 = 1 THEN 100 ELSE 0 END END AS m FROM v_screen)
""".replace("m > 90", "m > 100"))
def _(t):
    m = F.when(F.col("instrument") % 9 != 4, F.col("momentum") + F.when(F.col("instrument") % 13 == 1, 100.0).otherwise(0.0))
    x = screened(t).withColumn("momentum", m)
    c = qa.check_rows(x, qa.score_rules(["revenue", "profitability", "valuation", "flow", "momentum"]))
    return c.select("instrument", F.concat_ws(",", "errors").alias("errors"), F.coalesce("momentum", F.lit(25.0)).alias("soft_momentum"))


@query("B16_fiscal_quarter", """
SELECT date, CAST(quarter(date) AS INT) AS quarter, CAST(year(date) AS INT) AS year, CAST(CASE WHEN quarter(date) = 1 THEN 4 ELSE quarter(date) - 1 END AS INT) AS prior_quarter,
  CAST(CASE WHEN quarter(date) = 1 THEN year(date) - 1 ELSE year(date) END AS INT) AS prior_year, CAST(year(date) - 1 AS INT) AS last_year FROM v_days""")
def _(t):
    return t.days.select("date", qa.fiscal(F.col("date")).alias("f")).select("date", "f.*")


@query("B17_metric_extraction", """
SELECT instrument, date, CASE WHEN nullif(closing_price, '') IS NOT NULL THEN coalesce(TRY_CAST(nullif(closing_price, 'NaN') AS DOUBLE), 0) ELSE coalesce(nullif(TRY_CAST(opening_price AS DOUBLE), 0), 0) END AS metric FROM v_raw""")
def _(t):
    x = raw(t).withColumn("closing_price", F.when(F.col("closing_price") == "NaN", "x").otherwise(F.col("closing_price")))
    return x.select("instrument", "date", qa.metric(["closing_price"], ["opening_price"]).alias("metric"))


@query("B18_pct_change", "SELECT instrument, date, CASE WHEN base > 0 THEN round((close - base) / base * 100, 2) END AS pct FROM (SELECT *, CASE WHEN trades % 2 = 0 THEN open ELSE 0 END AS base FROM v_bars)")
def _(t):
    base = F.when(F.col("trades") % 2 == 0, F.col("open")).otherwise(0.0)
    return t.bars.select("instrument", "date", ty.pct_change(F.col("close"), base).alias("pct"))


@query("B19_letter_grade", """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'E' WHEN v >= 90 THEN 'A' WHEN v >= 80 THEN 'B' WHEN v >= 70 THEN 'C' WHEN v >= 60 THEN 'D' ELSE 'E' END AS grade FROM (SELECT c_custkey, c_acctbal / 100 AS v FROM customer)""")
def _(t):
    v = F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise((F.col("c_acctbal") / 100).cast("string"))
    return t.read("customer").select("c_custkey", ty.letter_grade(v).alias("grade"))


@query("B20_board_label", """
SELECT s.instrument, CASE WHEN s.instrument % 11 = 0 THEN 'AB' || s.instrument ELSE c || CASE WHEN CAST(c AS INT) >= 9900 OR CAST(c AS INT) BETWEEN 6000 AND 7999 THEN '(second)' ELSE '(main)' END || ' [' || sector || ']' END AS label
FROM (SELECT *, lpad(CAST(instrument * 83 % 10000 AS VARCHAR), 4, '0') AS c FROM v_sectors) s""")
def _(t):
    i = F.col("instrument")
    code = F.when(i % 11 == 0, F.concat(F.lit("AB"), i.cast("string"))).otherwise(F.lpad((i * 83 % 10000).cast("string"), 4, "0"))
    return t.sectors.select("instrument", qa.board_label(code, F.col("sector")).alias("label"))


@query("B20_price_change", """
SELECT instrument, date, round(close - open, 4) AS change, round((close - open) / open * 100, 4) AS change_pct,
  'NT$' || printf('%.1f', close) || ' (' || CASE WHEN close >= open THEN '+' ELSE '' END || printf('%.1f', close - open) || ' / ' || CASE WHEN close >= open THEN '+' ELSE '' END || printf('%.2f', (close - open) / open * 100) || '%)' AS text FROM v_bars""")
def _(t):
    return t.bars.select("instrument", "date", qa.price_change(F.col("close"), F.col("open")).alias("x")).select("instrument", "date", "x.*")


PAYLOAD_SQL = """(SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '<!DOCTYPE html><p>' || event_type WHEN 2 THEN '{"error": "limit"}' WHEN 3 THEN '{"data": [' || props || ',' || props || ']}'
  WHEN 4 THEN '[]' WHEN 5 THEN '[' || props || ']' WHEN 6 THEN props ELSE 'busy' END AS payload FROM events)"""


def payloads(t):
    p, e = F.col("props"), F.col("event_id") % 8
    body = (F.when(e == 0, F.lit(None).cast("string")).when(e == 1, F.concat(F.lit("<!DOCTYPE html><p>"), "event_type")).when(e == 2, '{"error": "limit"}')
            .when(e == 3, F.concat(F.lit('{"data": ['), p, F.lit(","), p, F.lit("]}"))).when(e == 4, "[]").when(e == 5, F.concat(F.lit("["), p, F.lit("]"))).when(e == 6, p).otherwise("busy"))
    return t.read("events").select("event_id", body.alias("payload"))


@query("B21_payload_class", f"""
SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'null' WHEN 1 THEN 'html' WHEN 2 THEN 'error' WHEN 3 THEN 'wrapped' WHEN 4 THEN 'empty_list' WHEN 5 THEN 'list' WHEN 6 THEN 'record' ELSE 'text' END AS kind FROM {PAYLOAD_SQL}""")
def _(t):
    return payloads(t).select("event_id", qa.classify_payload("payload").alias("kind"))


@query("B21_payload_records", """
SELECT event_id, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events WHERE event_id % 8 IN (3, 5, 6) UNION ALL SELECT event_id, CAST(props::JSON->>'k' AS BIGINT) FROM events WHERE event_id % 8 = 3""")
def _(t):
    return qa.unwrap_payloads(payloads(t), "payload", "struct<k: bigint>")


@query("B21_payload_checks", """
SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 3 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 1 END AS n_records,
  CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'null' WHEN 1 THEN 'html' WHEN 2 THEN 'error' WHEN 7 THEN 'text' WHEN 4 THEN NULL
  ELSE CASE WHEN event_id % 5 = 0 AND event_id % 8 <> 6 THEN 'unexpected fields' WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'null: k' END END AS reason FROM events""")
def _(t):
    renamed = F.when(F.col("event_id") % 5 == 0, F.replace("payload", F.lit('"k"'), F.lit('"_k"'))).otherwise(F.col("payload"))
    blank = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("payload", r'("_?k"\s*:\s*)[^,}]+', "$1null")).otherwise(F.col("payload"))
    p = payloads(t).withColumn("payload", renamed).withColumn("payload", blank)
    return qa.check_payloads(p, "payload", ["k"]).select("event_id", "n_records", "reason")


@query("B22_nested_lookup", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(props::JSON->>'k' AS BIGINT) AS VARCHAR) ELSE 'none' END AS value FROM events")
def _(t):
    p = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}"))).otherwise(F.col("props"))
    return t.read("events").select("event_id", qa.nested(p, "a.b.k", "none").alias("value"))


@query("B23_display_columns", """
SELECT instrument, date, 'NT$' || format('{:,}', CAST(volume AS BIGINT)) AS money, CASE WHEN p > 0 THEN '+' ELSE '' END || printf('%.2f', p) || '%' AS pct,
  '民國' || CAST(year(date) - 1911 AS VARCHAR) || '年' || strftime(date, '%m') || '月' || strftime(date, '%d') || '日' AS era FROM (SELECT *, (close - open) / open * 100 AS p FROM v_bars)""")
def _(t):
    p = (F.col("close") - F.col("open")) / F.col("open") * 100
    return t.bars.select("instrument", "date", qa.money_text(F.col("volume")).alias("money"), qa.percent_text(p).alias("pct"), qa.era_text(F.col("date")).alias("era"))
