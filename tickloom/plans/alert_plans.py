"""Alert, digest and report queries (section N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.typing import letter_grade, lookup, rnd
from tickloom.operators import alerts as al
from tickloom.plans.backtest_plans import results
from tickloom.plans.fundamental_plans import deep
from tickloom.plans.market_plans import REGIME_SQL, regimes
from tickloom.plans.registry import query
from tickloom.plans.screen_plans import screened
from tickloom.sources.sql_views import VIEWS
from tickloom.sources.store import fresh_path, store
from tickloom.streaming import rules

TYPES = {"error": "stop_loss_hit", "purchase": "new_entry", "signup": "regime_change", "click": "signal_detected", "view": "daily"}

VIEWS["v_alerts"] = """
SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'stop_loss_hit' WHEN 'purchase' THEN 'new_entry' WHEN 'signup' THEN 'regime_change' WHEN 'click' THEN 'signal_detected' WHEN 'view' THEN 'daily' END AS kind,
  user_id % 10 AS desk, 'desk ' || lpad(CAST(user_id AS VARCHAR), 4, '0') || ' ' || props AS message FROM events"""
VIEWS["v_alert_s"] = """
SELECT *, CASE kind WHEN 'stop_loss_hit' THEN 'critical' WHEN 'regime_change' THEN 'warning' WHEN 'signal_detected' THEN 'warning' ELSE 'info' END AS severity FROM v_alerts"""


def alerts(t, source=None):
    e = t.read("events") if source is None else source
    return e.select("event_id", "ts", lookup(F.col("event_type"), TYPES).alias("kind"), (F.col("user_id") % 10).alias("desk"),
                    F.concat_ws(" ", F.lit("desk"), F.lpad(F.col("user_id").cast("string"), 4, "0"), "props").alias("message"))


@query("N1_severity", "SELECT event_id, kind, severity, CAST(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS INT) AS level FROM v_alert_s")
def _(t):
    k = F.col("kind")
    return alerts(t).select("event_id", "kind", al.severity(k).alias("severity"), al.severity_level(k).alias("level"))


@query("N2_message_hash", "SELECT event_id, substr(sha256(message), 1, 16) AS hash FROM v_alerts")
def _(t):
    return alerts(t).select("event_id", al.message_hash(F.col("message")).alias("hash"))


VIEWS["v_ev"] = "SELECT kind || '|' || desk AS k, epoch_us(ts) AS us, min(event_id) AS event_id FROM v_alerts GROUP BY 1, 2"


def _chain(src, gap):
    return f"""WITH RECURSIVE acc AS (SELECT k, min(us) AS us FROM {src} GROUP BY k UNION ALL SELECT a.k, min(e.us) AS us FROM acc a JOIN {src} e ON e.k = a.k AND e.us >= a.us + {gap} GROUP BY a.k)
"""


N3_SQL = _chain("v_ev", 4 * 3600 * 1000000) + "SELECT e.event_id, e.k AS alert_key FROM acc JOIN v_ev e ON e.k = acc.k AND e.us = acc.us"


def deduped(t):
    return al.spaced(alerts(t), ["kind", "desk"], "ts", "event_id", al.COOLDOWN_SECONDS)


@query("N3_alert_cooldown", N3_SQL)
def _(t):
    return deduped(t).select("event_id", F.concat_ws("|", "kind", "desk").alias("alert_key"))


# rows that the final watermark (the latest time less the lateness, in whole milliseconds) has not passed are undecided
@query("N3_alert_cooldown_stream", N3_SQL + " WHERE e.us < ((SELECT max(us) FROM v_ev) // 1000 - 14400000) * 1000")
def _(t):
    schema = t.read("events").schema
    src = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.root)
    out = rules.dedupe_stream(alerts(t, src), ["kind", "desk"], "ts", "event_id", al.COOLDOWN_SECONDS)
    done = rules.drain(out, fresh_path(t.spark, "alerts-out"), fresh_path(t.spark, "alerts-state"))
    return done.select("event_id", F.replace("k", F.lit("\u0001"), F.lit("|")).alias("alert_key"))


@query("N4_history_pruning", N3_SQL.replace("SELECT e.event_id, e.k AS alert_key", "SELECT e.event_id") + " WHERE e.us > (SELECT max(us) FROM v_ev) - 14400000000")
def _(t):
    last = t.read("events").agg(F.max("ts").alias("as_of"))  # one row
    return al.prune_history(deduped(t).crossJoin(F.broadcast(last)), "ts", F.col("as_of")).select("event_id")


VIEWS["v_open_alerts"] = """
SELECT 'main' AS k, epoch_us(ts) AS us, min(event_id) AS event_id FROM v_alerts WHERE kind IN ('regime_change', 'stop_loss_hit') OR isodow(ts) < 6 GROUP BY 1, 2"""


@query("N5_rate_limit", _chain("v_open_alerts", 30 * 60 * 1000000) + "SELECT e.event_id FROM acc JOIN v_open_alerts e ON e.us = acc.us")
def _(t):
    # one channel for everything: a single key that the time chunks spread over tasks
    days = alerts(t).select(F.col("ts").cast("date").alias("date")).distinct().withColumn("is_trading", F.weekday("date") < 5)
    return al.rate_limited(alerts(t).withColumn("channel", F.lit("main")), days, "channel", "kind", "ts", "event_id").select("event_id")


@query("N6_digests", """
SELECT digest, kind, count(*) AS alerts, count(DISTINCT message) AS messages, min(ts) AS first_ts, max(ts) AS last_ts FROM (
 SELECT *, date_trunc('day', l) + CASE WHEN hour(l) < 8 THEN INTERVAL 8 HOUR WHEN hour(l) < 17 THEN INTERVAL 17 HOUR ELSE INTERVAL 32 HOUR END AS digest FROM (SELECT *, ts + INTERVAL 8 HOUR AS l FROM v_alert_s WHERE severity = 'info')) GROUP BY 1, 2""")
def _(t):
    return al.digests(alerts(t), "kind", "ts", "message")


@query("N7_routing", """
SELECT kind, CASE severity WHEN 'critical' THEN 'send_formatted' WHEN 'warning' THEN 'send' ELSE 'digest' END AS route, count(*) AS alerts FROM v_alert_s GROUP BY 1, 2""")
def _(t):
    return alerts(t).groupBy("kind", al.route(F.col("kind")).alias("route")).agg(F.count("*").alias("alerts"))


#: files that the events arrive in, and the latest an event may come after its time
ARRIVALS, DELAY_SECONDS = 6, 3 * 3600


def arriving(t, run) -> None:
    """Events as files in order of arrival, up to three hours late and so out of order; ``run(stream)`` is called
    when half of them are there, and again, as a restart, when all are."""
    events, folder = t.read("events"), fresh_path(t.spark, "arrivals")
    late = F.pmod(F.xxhash64("event_id"), F.lit(DELAY_SECONDS))
    timed = events.withColumn("_at", al.micros("ts") / 1e6 + late)
    span = timed.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    width = ((span["hi"] or 0) - (span["lo"] or 0)) / ARRIVALS + 1e-3
    chunk = F.least(F.floor((F.col("_at") - F.lit(span["lo"])) / width), F.lit(ARRIVALS - 1))
    for i in range(ARRIVALS):
        timed.where(chunk == i).drop("_at").repartition(1).write.mode("append").parquet(folder)
        if i in (ARRIVALS // 2 - 1, ARRIVALS - 1):
            run(t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder))


@query("N5_rate_limit_stream", _chain("v_open_alerts", 30 * 60 * 1000000) + "SELECT e.event_id FROM acc JOIN v_open_alerts e ON e.us = acc.us WHERE e.us < ((SELECT max(us) FROM v_open_alerts) // 1000 - 14400000) * 1000")
def _(t):
    days = alerts(t).select(F.col("ts").cast("date").alias("date")).distinct().withColumn("is_trading", F.weekday("date") < 5)
    days = store(days, "limited-days")  # every micro-batch joins it
    path, state = fresh_path(t.spark, "limited-out"), fresh_path(t.spark, "limited-state")
    parts, done = t.spark.sparkContext.defaultParallelism, []
    limited = lambda src: rules.rate_limit_stream(alerts(t, src).withColumn("channel", F.lit("main")), days, "channel", "kind", "ts", "event_id")
    arriving(t, lambda src: done.append(rules.drain(limited(src), path, state, parts)))
    return done[-1].select("event_id")


@query("N6_digests_stream", """
WITH d AS (
 SELECT digest, kind, count(*) AS alerts, count(DISTINCT message) AS messages, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT *, date_trunc('day', l) + CASE WHEN hour(l) < 8 THEN INTERVAL 8 HOUR WHEN hour(l) < 17 THEN INTERVAL 17 HOUR ELSE INTERVAL 32 HOUR END AS digest FROM (SELECT *, ts + INTERVAL 8 HOUR AS l FROM v_alert_s WHERE severity = 'info')) GROUP BY 1, 2)
SELECT * FROM d WHERE digest <= (SELECT max(digest) FROM d) - INTERVAL 4 HOUR""")
def _(t):
    path, state = fresh_path(t.spark, "digests-out"), fresh_path(t.spark, "digests-state")
    done = []
    arriving(t, lambda src: done.append(rules.drain(rules.digest_stream(alerts(t, src), "kind", "ts", "message"), path, state)))
    return done[-1].withColumn("digest", F.col("digest").cast("timestamp_ntz"))


@query("N7_routing_stream", """
SELECT event_id, kind, CASE severity WHEN 'critical' THEN 'send_formatted' WHEN 'warning' THEN 'send' ELSE 'digest' END AS route, substr(sha256(message), 1, 16) AS hash,
  CASE WHEN kind IN ('regime_change', 'daily') THEN '' ELSE regexp_extract(message, '\\b(\\d{4})\\b', 1) END AS code FROM v_alert_s""")
def _(t):
    root, state = fresh_path(t.spark, "routes"), fresh_path(t.spark, "routes-state")
    arriving(t, lambda src: rules.route_stream(alerts(t, src), root, state))
    return rules.routed(t.spark, root, alerts(t).schema).select("event_id", "kind", "route", "hash", "code")


@query("N8_regime_changes", REGIME_SQL.rsplit("SELECT", 1)[0] + """
SELECT date, old, regime AS new FROM (SELECT date, regime, lag(regime) OVER (ORDER BY date) AS old FROM f) WHERE old IS NOT NULL AND old <> regime""")
def _(t):
    return al.changes(regimes(t).select("market", "date", "regime"), "market", "regime").select("date", "old", "new")


@query("N9_instrument_code", """
SELECT event_id, CASE WHEN kind IN ('regime_change', 'daily') THEN '' ELSE regexp_extract(message, '\\b(\\d{4})\\b', 1) END AS code FROM v_alerts""")
def _(t):
    return alerts(t).select("event_id", al.instrument_code(F.col("message"), F.col("kind")).alias("code"))


@query("N10_ranked_candidates", """
SELECT d.instrument, s.sector, d.combined_score, d.outcome, CASE WHEN combined_score >= 90 THEN 'A' WHEN combined_score >= 80 THEN 'B' WHEN combined_score >= 70 THEN 'C' WHEN combined_score >= 60 THEN 'D' ELSE 'E' END AS grade
FROM v_deep d JOIN v_sectors s ON s.instrument = d.instrument WHERE outcome <> 'disqualified' ORDER BY combined_score DESC, d.instrument""")
def _(t):
    x = deep(t).where("outcome <> 'disqualified'").join(t.sectors, "instrument")
    return x.select("instrument", "sector", "combined_score", "outcome", letter_grade("combined_score").alias("grade")).orderBy(F.desc("combined_score"), "instrument")


@query("N10_disqualified", "SELECT instrument, flags AS red_flags, composite_score AS stage1_score FROM v_deep WHERE outcome = 'disqualified' ORDER BY composite_score DESC, instrument LIMIT 20")
def _(t):
    x = deep(t).where("outcome = 'disqualified'")
    return x.select("instrument", F.concat_ws(",", "red_flags").alias("red_flags"), "stage1_score").orderBy(F.desc("stage1_score"), "instrument").limit(20)


@query("N10_sector_report", """
SELECT s.sector, count(*) AS screened, count(*) FILTER (WHERE x.bucket = 'pass') AS passed, any_value(b.trades) AS trades, any_value(b.pnl) AS total_pnl_pct
FROM v_screen x JOIN v_sectors s ON s.instrument = x.instrument LEFT JOIN (SELECT sector, count(*) AS trades, round(sum(pnl_pct), 2) AS pnl FROM v_bt GROUP BY 1) b ON b.sector = s.sector GROUP BY s.sector""")
def _(t):
    pnl = results(t).groupBy("sector").agg(F.count("*").alias("trades"), rnd(F.sum("pnl_pct"), 2).alias("total_pnl_pct"))
    s = screened(t).join(t.sectors, "instrument").groupBy("sector").agg(F.count("*").alias("screened"), F.count_if(F.col("bucket") == "pass").alias("passed"))
    return s.join(pnl, "sector", "left")


@query("N10_recent_alerts", """
SELECT kind, severity, count(*) AS alerts, max(ts) AS last_ts, severity = 'info' AS pending FROM v_alert_s WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2""")
def _(t):
    last = t.read("events").agg(F.max("ts").alias("as_of"))  # one row
    x = al.prune_history(alerts(t).crossJoin(F.broadcast(last)), "ts", F.col("as_of"), 86400)
    sev = al.severity(F.col("kind"))
    return x.groupBy("kind", sev.alias("severity")).agg(F.count("*").alias("alerts"), F.max("ts").alias("last_ts")).withColumn("pending", F.col("severity") == "info")
