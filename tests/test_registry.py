import importlib.util
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SECTIONS = {"A": 14, "B": 23, "C": 11, "D": 10, "E": 10, "F": 10, "G": 19, "H": 14, "I": 19, "J": 14, "K": 22, "L": 14, "M": 10, "N": 10}


def test_every_inventory_row_has_a_query():
    names = entry.queries()
    seen = {m.group(0) for n in names if (m := re.match(r"[A-N]\d+", n))}
    assert [f"{s}{i}" for s, n in SECTIONS.items() for i in range(1, n + 1) if f"{s}{i}" not in seen] == []
    assert set(entry.oracle_sql()) <= set(names)


def test_oracle_sql_binds():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        con.execute("EXPLAIN " + sql)


#: one query of each section, by value
VALUES = [
    "A14_load_counts", "B13_quality_gate", "C4_trading_days_in_range", "D7_backward_adjust", "E10_index_proxy", "F9_full_outer_weights", "G12_volume_profile",
    "H7_composite_screen", "I13_batch_sentiment", "J7_regime_transitions", "K4_backtest_summary", "L14_dashboard_risk", "M10_fusion_ranking", "N5_rate_limit",
]


@pytest.mark.parametrize("name", VALUES)
def test_values_match_sql(spark, name):
    spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(__file__), "..", "tools", "check.py"))
    tool = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(tool)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    assert tool.compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall()) is None
