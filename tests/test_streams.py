import datetime as dt
import os
import random
import time

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tickloom.operators import alerts as al
from tickloom.streaming import rules

SCHEMA = "event_id long, ts timestamp_ntz, kind string, message string"
KINDS = ["new_entry", "regime_change", "stop_loss_hit", "signal_detected", "daily", "heartbeat", "other"]


def events(n, seed, hours=120):
    r, start = random.Random(seed), dt.datetime(2024, 3, 1, 0, 0)
    return [(i, start + dt.timedelta(seconds=r.randrange(hours * 3600)), r.choice(KINDS), f"stock {r.randrange(40):04d} moved {r.randrange(5)}") for i in range(n)]


def arrive(spark, folder, rows, delay_hours=3, files=5):
    """Files in order of arrival; an event arrives up to ``delay_hours`` after its time."""
    r = random.Random(1)
    rows = sorted(rows, key=lambda e: e[1] + dt.timedelta(hours=r.random() * delay_hours))
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def want_routes(rows):
    return sorted((i, k, al.ROUTES[al.SEVERITY.get(k, "info")]) for i, _, k, _ in rows)


def test_routing_after_failures_writes_each_alert_once(spark, tmp_path):
    folder, root, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = events(60, 2)
    arrive(spark, folder, rows[:40])
    write, failed = rules.route_batch(root, "kind", "message"), []

    def fails_once(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 2 and not failed:  # all sinks are written, the batch is not committed
            failed.append(batch_id)
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        source(spark, folder).writeStream.foreachBatch(fails_once).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    schema = spark.createDataFrame([], SCHEMA).schema
    rules.route_stream(source(spark, folder), root, state)
    assert failed and sorted(tuple(r) for r in rules.routed(spark, root, schema).select("event_id", "kind", "route").collect()) == want_routes(rows[:40])
    arrive(spark, folder, rows[40:], files=1)
    for _ in range(2):  # the second run has nothing to do
        rules.route_stream(source(spark, folder), root, state)
        out = rules.routed(spark, root, schema)
        assert sorted(tuple(r) for r in out.select("event_id", "kind", "route").collect()) == want_routes(rows)
    said = {r["event_id"]: r["message"] for r in out.collect()}
    assert all(said[i] == (f"[STOP_LOSS_HIT] {m[6:10]}: {m}" if k == "stop_loss_hit" else m) for i, _, k, m in rows)


def test_digests_as_a_stream(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = events(400, 3)
    early = [e for e in rows if e[1] < dt.datetime(2024, 3, 3)]
    batch = al.digests(spark.createDataFrame(rows, SCHEMA), "kind", "ts", "message")
    want = {(r["digest"], r["kind"]): (r["alerts"], r["messages"], r["first_ts"], r["last_ts"]) for r in batch.collect()}
    last = max(d for d, _ in want)
    for part in (early, [e for e in rows if e not in early]):
        arrive(spark, folder, part)
        got = rules.drain(rules.digest_stream(source(spark, folder), "kind", "ts", "message"), out, state)
        found = {(r["digest"].replace(tzinfo=None), r["kind"]): (r["alerts"], r["messages"], r["first_ts"], r["last_ts"]) for r in got.withColumn("digest", F.col("digest").cast("timestamp_ntz")).collect()}
        assert found.items() <= want.items() and got.count() == len(found)
    assert found == {k: v for k, v in want.items() if k[0] <= last - dt.timedelta(hours=4)} and len(found) > 15


def test_digest_counts_rows_that_come_after_the_next_digest_has_begun(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    at = lambda *x: dt.datetime(2024, 3, *x)
    # local time is 8 hours ahead: the digest of 17:00 is that of alerts up to 09:00
    files = [[(1, at(1, 8, 30), "daily", "a")], [(2, at(1, 9, 30), "daily", "b")], [(3, at(1, 8, 45), "daily", "c")], [(4, at(2, 12), "daily", "d")]]
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the source takes files by their time
    got = rules.drain(rules.digest_stream(source(spark, folder), "kind", "ts", "message"), out, state).withColumn("digest", F.col("digest").cast("timestamp_ntz"))
    assert sorted((r["digest"], r["alerts"], r["messages"]) for r in got.collect()) == [(at(1, 17), 2, 2), (at(2, 8), 1, 1)]


def test_rate_limit_as_a_stream_over_files_out_of_order(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = events(500, 4)
    days = spark.createDataFrame([(dt.date(2024, 3, 1) + dt.timedelta(days=i), i != 1) for i in range(4)], "date date, is_trading boolean")  # the last day is not listed
    arrive(spark, folder, rows)
    stream = source(spark, folder).withColumn("channel", F.lit("main"))
    got = sorted(r["event_id"] for r in rules.drain(rules.rate_limit_stream(stream, days, "channel", "kind", "ts", "event_id"), out, state).collect())
    batch = al.rate_limited(spark.createDataFrame(rows, SCHEMA).withColumn("channel", F.lit("main")), days, "channel", "kind", "ts", "event_id")
    open_ = [e for e in rows if e[2] in al.NEVER_SUPPRESS or e[1].date() != dt.date(2024, 3, 2)]
    decided = max(e[1] for e in open_) - dt.timedelta(hours=4)
    times = {e[0]: e[1] for e in rows}
    want = sorted(r["event_id"] for r in batch.collect() if times[r["event_id"]] < decided)
    assert got == want and len(want) > 50


def test_a_key_of_many_rows_meets_its_state_once(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    spark.range(25_000).select(F.lit("main").alias("k"), "id").coalesce(1).write.parquet(folder)

    def step(key, batches, state):
        yield pd.DataFrame({"rows": [len(b) for b in batches]})

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n) for n in names]
    stream = spark.readStream.schema("k string, id long").parquet(folder).groupBy("k").applyInPandasWithState(step, "rows long", "seen long", "append", GroupStateTimeout.NoTimeout)
    assert [r["rows"] for r in rules.drain(stream, out, state, 3).collect()] == [25_000]
    assert sorted(n for n in os.listdir(tmp_path / "state/state/0") if n.isdigit()) == ["0", "1", "2"]
    assert [spark.conf.get(n) for n in names] == before
