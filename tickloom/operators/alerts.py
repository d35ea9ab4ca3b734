"""Alert rules on event tables: severity, routing, cooldown, rate limit, digests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.typing import lookup
from tickloom.sources.store import store
from tickloom.sources.workers import ship

# Severity per alert type and the types that are never suppressed or have no instrument.
SEVERITY = {
    "new_entry": "info", "take_profit": "info", "regime_change": "warning", "signal_detected": "warning", "stop_loss_hit": "critical",
    "daily": "info", "crisis": "warning", "black_swan": "warning", "heartbeat": "info",
}
LEVEL = {"info": 1, "warning": 2, "critical": 3}
NEVER_SUPPRESS = ("regime_change", "crisis", "black_swan", "heartbeat", "stop_loss_hit")
MARKET_LEVEL = ("regime_change", "daily", "crisis", "black_swan", "heartbeat")
ROUTES = {"info": "digest", "warning": "send", "critical": "send_formatted"}
COOLDOWN_SECONDS, RATE_LIMIT_SECONDS, DAY = 4 * 3600, 30 * 60, 86400
MORNING, EVENING = 8, 17  # local hours of the digests


def severity(kind: Column) -> Column:
    return lookup(kind, SEVERITY, "info")


def severity_level(kind: Column) -> Column:
    return lookup(severity(kind), LEVEL, 1)


def route(kind: Column) -> Column:
    return lookup(severity(kind), ROUTES, "digest")


def message_hash(message: Column) -> Column:
    return F.substring(F.sha2(message, 256), 1, 16)


def instrument_code(message: Column, kind: Column) -> Column:
    """First stand-alone four digit number; empty for market-level types."""
    return F.when(kind.isin(*MARKET_LEVEL), "").otherwise(F.regexp_extract(message, r"\b(\d{4})\b", 1))


def micros(ts: Column | str) -> Column:
    """Microseconds of a time without zone, independent of the session time zone."""
    t = F.col(ts) if isinstance(ts, str) else ts
    part = F.hour(t) * 3600 + F.minute(t) * 60
    second = (F.extract(F.lit("SECOND"), t) * 1000000).cast("bigint")
    return (F.unix_date(t.cast("date")).cast("bigint") * DAY + part) * 1000000 + second


def walk(ts: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Positions accepted from sorted times when each must be ``gap`` after the one before."""
    out: list[int] = []
    i = 0 if last is None else int(np.searchsorted(ts, last + gap))
    while i < len(ts):
        out.append(i)
        i = int(np.searchsorted(ts, ts[i] + gap))
    return out


#: chunks that one task composes
FAN = 16


def reduce_chunk(t: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, finals) of a chunk: the last event its chain accepts, by the first one accepted.

    An earlier event can only push the first accept up to ``gap`` into the chunk.
    Chains that end alike are one step: only the last of their starts is kept.
    """
    m = min(len(t), int(np.searchsorted(t, start + gap)) + 1)
    nxt, cur = np.searchsorted(t, t + gap), np.arange(m)
    while (nxt[cur] < len(t)).any():
        cur = np.where(nxt[cur] < len(t), np.minimum(nxt[cur], len(t) - 1), cur)
    return steps(t[:m], t[cur])


def steps(starts: np.ndarray, finals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.concatenate((finals[1:] != finals[:-1], [True])) if len(finals) else np.zeros(0, bool)
    return starts[last], finals[last]


def enter(starts: np.ndarray, finals: np.ndarray, last: np.ndarray, gap: int) -> np.ndarray:
    """The last accepted time after a chunk for each last accepted time before it."""
    i = np.searchsorted(starts, last + gap)
    return np.where(i < len(starts), np.append(finals, 0)[i], last)


def compose(parts: list[tuple[np.ndarray, np.ndarray]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """One step function of consecutive chunks.

    An event before them pushes the first accept less than ``gap`` past their first
    event, so starts beyond that, but for the next one, are left out.
    """
    starts, finals = [], []
    for n, (s, f) in enumerate(parts):
        if starts:
            s, f = s[s > starts[-1][-1]], f[s > starts[-1][-1]]
        if not len(s):
            continue
        for later in parts[n + 1 :]:
            f = enter(*later, f, gap)
        starts.append(s)
        finals.append(f)
        if s[-1] >= starts[0][0] + gap:
            break
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, f = np.concatenate(starts), np.concatenate(finals)
    end = int(np.searchsorted(s, s[0] + gap)) + 1
    return steps(s[:end], f[:end])


def spaced(events: DataFrame, keys: Sequence[str], ts: str, event_id: str, seconds: int, chunk_seconds: int | None = None) -> DataFrame:
    """Events that pass a cooldown measured from the last *accepted* event of their key.

    The rule is a chain along time, and one key may hold most of the events, so a
    key is cut into time chunks (as long as the cooldown, unless given) that form a
    tree:

    1. equal times collapse in a partial aggregate;
    2. every chunk becomes a step function: for each possible first accepted
       event, the last event the chain accepts;
    3. level by level, ``FAN`` neighbouring functions are composed into one;
    4. from the top down, the last accepted time before each node is handed to its
       children;
    5. each chunk is walked once more from there and emits its events.

    A task holds the events of one chunk, or ``FAN`` functions of at most one
    cooldown's events each; neither grows with the length of the history.
    """
    spark = events.sparkSession
    ship(spark)
    gap, size = seconds * 1_000_000, (chunk_seconds or seconds) * 1_000_000
    k = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys])
    d = events.select(k.alias("k"), micros(ts).alias("us"), F.col(event_id).alias("id")).groupBy("k", F.floor(F.col("us") / size).alias("chunk"), "us").agg(F.min("id").alias("id"))
    node = "k string, chunk bigint, starts array<bigint>, finals array<bigint>"
    numbers = lambda a: np.asarray(a, np.int64)

    def leaf(g):
        yield (g["k"][0], int(g["chunk"][0]), *reduce_chunk(numbers(g["us"]), int(g["chunk"][0]) * size, gap))

    def join(g):
        functions = [(numbers(s), numbers(f)) for s, f in zip(g["starts"], g["finals"])]
        yield (g["k"][0], int(g["g"][0]), *compose(functions, gap))

    def descend(g):
        last = None if pd.isna(g["last"][0]) else int(g["last"][0])
        for k_, chunk, s, f in zip(g["k"], g["chunk"], g["starts"], g["finals"]):
            yield k_, int(chunk), last
            if len(s):
                last = int(f[0]) if last is None else int(enter(numbers(s), numbers(f), np.array([last]), gap)[0])

    def emit(g):
        first = g["last"][0]
        for at in walk(numbers(g["us"]), None if pd.isna(first) else int(first), gap):
            yield (int(g["id"][at]),)

    levels = [store(by_group(d, ["k", "chunk"], "us", leaf, node), "cooldown-0")]
    span = levels[0].agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).first()  # one row
    lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)
    parent = F.floor(F.col("chunk") / FAN).alias("g")
    while lo != hi:
        lo, hi = lo // FAN, hi // FAN
        levels.append(store(by_group(levels[-1].select("*", parent), ["k", "g"], "chunk", join, node), f"cooldown-{len(levels)}"))
    entry = levels[-1].select("k", "chunk", F.lit(None).cast("bigint").alias("last"))
    for below in reversed(levels[:-1]):
        down = below.select("*", parent).join(entry.withColumnRenamed("chunk", "g"), ["k", "g"])
        entry = by_group(down, ["k", "g"], "chunk", descend, "k string, chunk bigint, last bigint")
    kept = by_group(d.join(entry, ["k", "chunk"]), ["k", "chunk"], "us", emit, "id bigint")
    return events.join(kept.withColumnRenamed("id", event_id), event_id, "left_semi")


def by_group(df: DataFrame, keys: Sequence[str], order: str, fn, schema: str) -> DataFrame:
    """Rows that ``fn`` yields for each group of ``keys``, given as arrays in ``order``.

    Groups stream past in sorted partitions, so many small ones cost no more than
    their rows; only the group at hand is held. Rows are dealt by a hash of the keys: a
    repartition by the keys themselves is left out after a join on them, and a join that
    turns into a broadcast while it runs then no longer keeps a group together.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            rest = yield from finished(pdf, False)
        if rest is not None:
            yield from finished(rest, True)

    def finished(pdf, last):
        if not len(pdf):
            return None
        fresh = np.zeros(len(pdf), bool)
        fresh[0] = True
        for key in keys:
            values = pdf[key].to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        bounds = [*np.flatnonzero(fresh).tolist(), len(pdf)]
        columns, rows = {c: pdf[c].to_numpy() for c in pdf.columns}, []
        for a, b in zip(bounds, bounds[1:] if last else bounds[1:-1]):
            rows.extend(fn({c: v[a:b] for c, v in columns.items()}))
        if rows:
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(last=out["last"].astype("Int64")) if "last" in names else out
        return None if last else pdf.iloc[bounds[-2] :]

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def in_session(alerts: DataFrame, cal: DataFrame, kind: str, ts: str) -> DataFrame:
    """Alerts of days that are not closed, and those that are never suppressed. ``cal`` has one row per date."""
    day = cal.select(F.col("date").alias("_day"), F.col("is_trading").alias("_open"))
    x = alerts.withColumn("_day", F.col(ts).cast("date")).join(day, "_day", "left")
    return x.where(F.col(kind).isin(*NEVER_SUPPRESS) | F.coalesce(F.col("_open"), F.lit(True))).drop("_day", "_open")


def rate_limited(alerts: DataFrame, cal: DataFrame, channel: str, kind: str, ts: str, event_id: str, seconds: int = RATE_LIMIT_SECONDS) -> DataFrame:
    """Alerts sent after holiday suppression and the minimum spacing per channel."""
    return spaced(in_session(alerts, cal, kind, ts), [channel], ts, event_id, seconds)


def prune_history(history: DataFrame, ts: str, as_of: Column, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    return history.where(F.col(ts) > as_of - F.expr(f"INTERVAL {seconds} SECONDS"))


def next_digest(local: Column, morning: int = MORNING, evening: int = EVENING) -> Column:
    """Digest an alert of this local time goes into."""
    day = F.date_trunc("DAY", local).cast("timestamp_ntz")
    h = F.hour(local)
    at = lambda hours: day + F.expr(f"INTERVAL {hours} HOURS")
    return F.when(h < morning, at(morning)).when(h < evening, at(evening)).otherwise(at(24 + morning))


def digests(alerts: DataFrame, kind: str, ts: str, message: str, offset_hours: int = 8) -> DataFrame:
    """Counts per digest and type; messages are counted, not collected, as a digest has no size bound."""
    local = F.col(ts) + F.expr(f"INTERVAL {offset_hours} HOURS")
    info = alerts.where(severity(F.col(kind)) == "info").withColumn("digest", next_digest(local))
    return info.groupBy("digest", kind).agg(F.count("*").alias("alerts"), F.count_distinct(message).alias("messages"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def changes(path: DataFrame, market: str, value: str) -> DataFrame:
    """Rows where the state differs from the one before (one row per date and market)."""
    prev = F.lag(value).over(Window.partitionBy(market).orderBy("date"))
    return path.withColumn("old", prev).where(F.col("old").isNotNull() & (F.col("old") != F.col(value))).withColumnRenamed(value, "new")
