import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.stored import PART, StoredTable, load

SCHEMA = T.StructType([T.StructField("instrument", T.LongType()), T.StructField("date", T.DateType()), T.StructField("close", T.DoubleType())])


def day(m, d):
    return dt.date(2024, m, d)


def files(path):
    return {os.path.join(top, n): os.stat(os.path.join(top, n)).st_mtime_ns for top, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, f"file://{tmp_path}/bars", SCHEMA, ["instrument", "date"], F.date_format("date", "yyyy-MM"))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def contents(table):
    return sorted((tuple(r) for r in table.rows().collect()), key=str)


def test_insert_keeps_the_first_writer_and_touches_new_partitions_only(spark, table, tmp_path):
    first = frame(spark, [(1, day(1, 2), 10.0), (2, day(1, 2), 20.0), (1, day(2, 1), 11.0), (1, day(2, 1), 10.5), (None, day(1, 1), 1.0), (3, None, 1.0)])
    assert table.insert(first, ["close"]) == {"inserted": 3, "skipped": 1}
    before = files(tmp_path)
    assert table.insert(first, ["close"]) == {"inserted": 0, "skipped": 4} and files(tmp_path) == before
    assert table.insert(frame(spark, [(1, day(1, 2), 99.0), (1, day(3, 1), 12.0), (3, day(1, 2), None)]), ["close"]) == {"inserted": 2, "skipped": 1}
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())
    assert {f.split(f"{PART}=")[1].split("/")[0] for f in after.keys() - before.keys()} == {"2024-01", "2024-03"}
    assert contents(table) == sorted([(1, day(1, 2), 10.0), (2, day(1, 2), 20.0), (1, day(2, 1), 10.5), (1, day(3, 1), 12.0), (3, day(1, 2), None)], key=str)


def test_replace_rewrites_what_differs(spark, table, tmp_path):
    first = frame(spark, [(1, day(1, 2), 10.0), (2, day(1, 3), None), (1, day(2, 1), 11.0)])
    assert table.replace(first, ["close"]) == {"inserted": 3, "replaced": 0, "skipped": 0}
    before = files(tmp_path)
    assert table.replace(first, ["close"]) == {"inserted": 0, "replaced": 0, "skipped": 3} and files(tmp_path) == before
    assert table.replace(frame(spark, [(1, day(1, 2), 10.0), (2, day(1, 3), 5.0), (1, day(2, 1), 11.0)]), ["close"]) == {"inserted": 0, "replaced": 1, "skipped": 2}
    after = files(tmp_path)
    assert all(after.get(f) == t for f, t in before.items() if "2024-02" in f) and not any(f in after for f in before if "2024-01" in f)
    assert contents(table) == sorted([(1, day(1, 2), 10.0), (2, day(1, 3), 5.0), (1, day(2, 1), 11.0)], key=str)


def test_only_partitions_of_the_load_are_read(spark, table):
    table.insert(frame(spark, [(1, day(m, 1), 1.0) for m in range(1, 13)]), ["close"])
    read = table._stored(table._parts(frame(spark, [(1, day(5, 3), 1.0)])))
    assert len(read.inputFiles()) == 12 and {r[PART] for r in read.select(PART).collect()} == {"2024-05"}
    assert f"({PART}#" in read._jdf.queryExecution().toString().split("PartitionFilters: [")[-1].split("]")[0]


def test_load_of_several_tables_is_idempotent(spark, table, tmp_path):
    other = StoredTable(spark, f"file://{tmp_path}/other", SCHEMA, ["date"], F.year("date"))
    tables, order = {"bars": table, "regimes": other}, {"bars": ["close"], "regimes": ["instrument"]}
    rows = {"bars": frame(spark, [(1, day(1, 2), 10.0)]), "regimes": frame(spark, [(1, day(1, 2), 1.0), (2, day(1, 2), 2.0)])}
    first, again = (sorted(tuple(r) for r in load(tables, rows, order, replaced=["regimes"]).collect()) for _ in range(2))
    assert first == [("bars", 1, 0), ("regimes", 1, 1)] and again == [("bars", 0, 1), ("regimes", 0, 2)]
    empty = {k: v.limit(0) for k, v in rows.items()}
    assert sorted(tuple(r) for r in load(tables, empty, order, replaced=["regimes"]).collect()) == [("bars", 0, 0), ("regimes", 0, 0)]


def test_load_into_nothing(spark, table):
    assert table.insert(frame(spark, []), ["close"]) == {"inserted": 0, "skipped": 0} and table.rows().count() == 0


def test_rows_of_several_loads_come_from_stored_tables(spark):
    from tickloom.plans.ingest_plans import load_rows
    from tickloom.sources.driver_tables import Tables
    from tickloom.sources.store import shared_dir

    t = Tables(spark, "/root/testdata/sf0.001")
    for name in ("bars", "ledger"):
        assert all(shared_dir(spark) in f for f in load_rows(t, False, name).inputFiles())


def test_an_insert_deals_its_rows_once(spark, table, tmp_path):
    first = frame(spark, [(1, day(1, 2), 10.0), (2, day(1, 2), 20.0)])
    table.insert(first, ["close"])
    plans, write = [], type(first).write
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(first), "write", property(lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()), write.fget(df))[1]))
        assert table.insert(frame(spark, [(1, day(1, 2), 9.0), (1, day(1, 3), 11.0), (1, day(1, 3), 12.0)]), ["close"]) == {"inserted": 1, "skipped": 2}
    assert len(plans) == 1 and "Join" not in plans[0]
    assert contents(table) == [(1, day(1, 2), 10.0), (1, day(1, 3), 11.0), (2, day(1, 2), 20.0)]
