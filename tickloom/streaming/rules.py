"""Structured Streaming forms of the stateful rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from tickloom import params
from tickloom.operators.alerts import EVENING, MORNING, RATE_LIMIT_SECONDS, ROUTES, in_session, instrument_code, message_hash, micros, route, severity, walk
from tickloom.operators.market import next_regime
from tickloom.sources.workers import ship


def dedupe_stream(alerts: DataFrame, keys: list[str], ts: str, event_id: str, seconds: int, lateness: str = "4 hours") -> DataFrame:
    """Cooldown from the last accepted alert of each key, in event time.

    Rows wait in the key's state until the watermark has passed them, as an earlier
    row may still come; then they are walked in time order. State is the last
    accepted time and the waiting rows of one lateness; without waiting rows it
    expires once the cooldown is over. Rows later than the watermark are dropped by
    the engine, which counts them in its progress. Rows that no watermark has
    passed yet are not decided. The engine hands a key's state over again with every
    Arrow batch of its rows, so the waiting rows are kept as two byte strings and not
    as lists, which would be taken apart each time, and ``drain`` makes the batches large.
    """
    gap = seconds * 1_000_000
    ship(alerts.sparkSession)
    x = alerts.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness).select(
        F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]).alias("k"), "_ts", F.unix_micros("_ts").alias("us"), F.col(event_id).alias("event_id"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, times, ids = state.get if state.exists else (None, b"", b"")
        times, ids = [np.frombuffer(times, np.int64)], [np.frombuffer(ids, np.int64)]
        if not state.hasTimedOut:
            for batch in batches:
                times.append(batch["us"].to_numpy(np.int64))
                ids.append(batch["event_id"].to_numpy(np.int64))
        times, ids = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        fresh = np.diff(times, prepend=times[:1] - 1) != 0  # of equal times the least id
        times, ids = times[fresh], ids[fresh]
        now = state.getCurrentWatermarkMs()
        due = int(np.searchsorted(times, now * 1000))
        taken = walk(times[:due], last, gap)
        out = ids[taken]
        last = int(times[taken[-1]]) if taken else last
        if due < len(times) or (last is not None and last + gap >= now * 1000):
            state.update((last, times[due:].tobytes(), ids[due:].tobytes()))
            state.setTimeoutTimestamp(max(now + 1, (int(times[due]) if due < len(times) else last + gap) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"k": [key[0]] * len(out), "event_id": pd.array(out, dtype="int64")})

    return x.groupBy("k").applyInPandasWithState(step, "k string, event_id bigint", "last bigint, times binary, ids binary", "append", GroupStateTimeout.EventTimeTimeout)


def regime_stream(raw: DataFrame, market: str = "market", min_days: int = params.MIN_REGIME_DAYS) -> DataFrame:
    """Regime and days-in-regime from a stream of raw daily regimes (dates arrive in order per market)."""

    ship(raw.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prev, days = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("date")
        names, counts = [], []
        for r in rows["raw_regime"]:
            prev, days = next_regime(r, prev, days, min_days)
            names.append(prev)
            counts.append(days)
        state.update((prev, days))
        yield pd.DataFrame({market: key[0], "date": rows["date"], "regime": names, "days_in_regime": counts})

    return raw.select(market, "date", "raw_regime").groupBy(market).applyInPandasWithState(
        step, f"{market} string, date date, regime string, days_in_regime int", "regime string, days int", "append", GroupStateTimeout.NoTimeout)


def rate_limit_stream(alerts: DataFrame, cal: DataFrame, channel: str, kind: str, ts: str, event_id: str, seconds: int = RATE_LIMIT_SECONDS, lateness: str = "4 hours") -> DataFrame:
    """``operators.alerts.rate_limited`` as a stream: the calendar, a static table, is joined by day before the
    channel's spacing is decided, so suppressed alerts never wait in state. Decisions are those of ``dedupe_stream``."""
    return dedupe_stream(in_session(alerts, cal, kind, ts), [channel], ts, event_id, seconds, lateness)


def digest_stream(alerts: DataFrame, kind: str, ts: str, message: str, offset_hours: int = 8, lateness: str = "4 hours") -> DataFrame:
    """The digests of ``operators.alerts.digests`` as a stream; a digest is emitted once no late row can change it.

    The watermark follows the local times of the alerts: a digest lies up to 15 hours
    after its alerts, so one that followed the digests would pass the last digest as
    soon as the next one has an alert. Day and night are branches with windows of a day,
    which end at the evening or the morning digest. Messages are counted once each by a
    first aggregate per message hash, whose rows leave its state when the digest closes
    and are added up by the second one.
    """
    # a time without zone as the instant of the same digits in UTC, as windows of a day are cut in UTC
    local = F.timestamp_micros(micros(F.col(ts) + F.expr(f"INTERVAL {offset_hours} HOURS")))
    info = alerts.where(severity(F.col(kind)) == "info").withColumn("_local", local).withWatermark("_local", lateness)
    hour = F.pmod(F.floor(F.unix_seconds("_local") / 3600), F.lit(24))

    def digests_at(rows: DataFrame, end: int) -> DataFrame:
        window = F.window("_local", "24 hours", startTime=f"{end} hours")
        each = rows.groupBy(window.alias("window"), kind, message_hash(F.col(message)).alias("hash")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        return each.groupBy("window", kind).agg(F.sum("n").alias("alerts"), F.count("*").alias("messages"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    day = hour.between(MORNING, EVENING - 1)
    both = digests_at(info.where(day), EVENING).unionByName(digests_at(info.where(~day), MORNING))
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds("window.end"))
    digest = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since).cast("timestamp")
    return both.select(digest.alias("digest"), kind, "alerts", "messages", "first_ts", "last_ts")


def route_batch(root: str, kind: str, message: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: each alert goes to the sink of its route, one folder per sink and batch.

    A batch that runs again, after a failure between its sinks or before its commit,
    replaces its own folders, so that no alert is written twice or lost. Critical alerts
    carry a formatted message.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        k = F.col(kind)
        rows = batch.withColumns({"route": route(k), "hash": message_hash(F.col(message)), "code": instrument_code(F.col(message), k)}).persist()
        try:
            for name in ROUTES.values():
                mine = rows.where(F.col("route") == name).drop("route")
                if name == "send_formatted":
                    mine = mine.withColumn(message, F.concat(F.lit("["), F.upper(k), F.lit("] "), F.when(F.col("code") != "", F.concat("code", F.lit(": "))).otherwise(""), message))
                mine.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()

    return write


def route_stream(alerts: DataFrame, root: str, checkpoint: str, kind: str = "kind", message: str = "message") -> None:
    """Route what is available now; what an earlier run with this checkpoint has routed is not read again."""
    q = alerts.writeStream.foreachBatch(route_batch(root, kind, message)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def routed(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All sinks of ``route_stream`` over alerts of ``schema``, with their route."""
    full = StructType([*schema.fields]).add("hash", "string").add("code", "string").add("batch", "long")
    sinks = [spark.read.schema(full).parquet(f"{root}/{name}").withColumn("route", F.lit(name)) for name in ROUTES.values()]
    return sinks[0].unionByName(sinks[1]).unionByName(sinks[2])


#: rows of a key that meet its state at once. The waiting rows of a key are about one micro-batch, and they are written
#: again for each Arrow batch of the next: with the usual 10,000 rows that is the square of a micro-batch
ROWS_AT_ONCE = 1 << 22


def drain(stream: DataFrame, path: str, checkpoint: str, parts: int | None = None) -> DataFrame:
    """Run a stream over what is available now into parquet and read it back.

    ``parts`` partitions hold the state, or as many as the session shuffles into: each is a task of every
    micro-batch, also where it is empty. A checkpoint keeps the number it began with.
    """
    conf = stream.sparkSession.conf
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_AT_ONCE} | ({"spark.sql.shuffle.partitions": parts} if parts else {})
    usual = {name: conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            conf.set(name, value)
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:  # a query keeps the settings of its start
        for name, value in usual.items():
            conf.set(name, value)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
