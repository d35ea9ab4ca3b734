"""Signal fusion queries (section M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import fusion as fx
from tickloom.functions.typing import clamp, dbl, rnd
from tickloom.operators import fusion as fo
from tickloom.operators import fundamentals as fun
from tickloom.plans.fundamental_plans import deep
from tickloom.plans.registry import query
from tickloom.plans.screen_plans import screened
from tickloom.sources.sql_views import VIEWS

# Monthly signal vectors: the first dimension from the month's price move, the others from fixed arithmetic on the month's bars.
_MULT = {d: 7 + 6 * i for i, d in enumerate(fx.DIMENSIONS[1:])}
VIEWS["v_sigs"] = "SELECT instrument, month, CASE WHEN n < 4 THEN NULL ELSE round(greatest(0.0e0, least(100.0e0, (c1 / c0 - 1.0e0) * 1000.0e0 + 50.0e0)), 2) END AS technical_momentum, " + ", ".join(
    f"CASE WHEN (instrument + n + {i}) % 7 = 0 THEN NULL ELSE CAST((instrument * {m} + n * {i + 3} + month(month)) % 101 AS DOUBLE) END AS {d}" for i, (d, m) in enumerate(_MULT.items())) + """
FROM (SELECT instrument, date_trunc('month', date)::DATE AS month, first(close ORDER BY date) AS c0, last(close ORDER BY date) AS c1, count(*) AS n FROM v_bars GROUP BY 1, 2)"""


def signals(t):
    b = t.bars.groupBy("instrument", F.trunc("date", "month").alias("month")).agg(F.min_by("close", "date").alias("c0"), F.max_by("close", "date").alias("c1"), F.count("*").alias("n"))
    i, n = F.col("instrument"), F.col("n")
    cols = {"technical_momentum": F.when(n >= 4, rnd(clamp((F.col("c1") / F.col("c0") - 1.0) * 1000.0 + 50.0, 0, 100), 2))}
    for k, (d, m) in enumerate(_MULT.items()):
        cols[d] = F.when((i + n + k) % 7 != 0, ((i * m + n * (k + 3) + F.month("month")) % 101).cast("double"))
    return b.select("instrument", "month", *[c.alias(d) for d, c in cols.items()])


_Z = "CASE WHEN {d} IS NULL THEN 0.0e0 ELSE round(greatest(-3.0e0, least(3.0e0, ({d} - 50.0e0) / 16.7e0)), 4) END"
VIEWS["v_z"] = "SELECT *, " + ", ".join(f"{_Z.format(d=d)} AS z_{d}" for d in fx.DIMENSIONS) + " FROM v_sigs"


def _wsum(skip=None):
    z = lambda d: "0.0e0" if d == skip else f"z_{d}"
    base = " + ".join(f"{z(d)} * {w!r}e0" for d, w in fx.DIMENSION_WEIGHTS.items())
    return base + " + (" + " + ".join(f"{z(a)} * {z(b)} * 0.1e0 * {w!r}e0" for a, b, w in fx.INTERACTIONS) + ")"


def _prob(ws):
    raw = f"round(greatest(0.0e0, least(100.0e0, 50.0e0 + (({ws}) / {fx.TOTAL_WEIGHT!r}e0) * 16.7e0)), 2)"
    return raw, f"round(greatest(0.01e0, least(0.99e0, 1.0e0 / (1.0e0 + exp(-({raw} - 50.0e0) * 1.0e0 / 25.0e0)))), 4)"


VIEWS["v_ens"] = "SELECT *, CASE WHEN ensemble_score >= 0.75e0 THEN 'strong_bullish' WHEN ensemble_score >= 0.6e0 THEN 'bullish' WHEN ensemble_score >= 0.45e0 THEN 'neutral' WHEN ensemble_score >= 0.3e0 THEN 'bearish' ELSE 'strong_bearish' END AS label FROM (SELECT *, " \
    + f"round(w, 4) AS raw_weighted_sum, {_prob('w')[0]} AS raw_score_equivalent, {_prob('w')[1]} AS ensemble_score FROM (SELECT *, {_wsum()} AS w, " \
    + " + ".join(f"CAST({d} IS NOT NULL AS INT)" for d in fx.DIMENSIONS) + " AS dimensions_used, concat_ws(',', " + ", ".join(f"CASE WHEN {d} IS NULL THEN '{d}' END" for d in fx.DIMENSIONS) \
    + ") AS dimensions_missing, round(" + " + ".join(f"z_{a} * z_{b} * 0.1e0 * {w!r}e0" for a, b, w in fx.INTERACTIONS) + ", 4) AS interaction_bonus FROM v_z))"


def scored(t):
    x, z, raw = fo.with_z(signals(t))
    return x.withColumn("e", fx.ensemble(z, raw)).select("*", "e.*").drop("e"), z, raw


_STATS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, avg({d}) AS mean, CASE WHEN stddev_pop({d}) > 0 THEN stddev_pop({d}) ELSE 1.0e0 END AS std, count({d}) AS n FROM v_sigs" for d in fx.DIMENSIONS)


@query("M1_normalize", "SELECT s.instrument, s.month, s.dimension, CASE WHEN s.score IS NULL THEN 0.0e0 ELSE round(greatest(-3.0e0, least(3.0e0, (s.score - t.mean) / t.std)), 4) END AS z FROM (" + " UNION ALL ".join(
    f"SELECT instrument, month, '{d}' AS dimension, {d} AS score FROM v_sigs" for d in fx.DIMENSIONS) + f") s JOIN ({_STATS}) t ON t.dimension = s.dimension")
def _(t):
    long = fo.to_long(signals(t), ["instrument", "month"])
    return fo.normalize_long(long, fo.rolling_stats(long)).select("instrument", "month", "dimension", "z")


@query("M2_rolling_stats", f"SELECT dimension, round(mean, 6) AS mean, round(std, 6) AS std, n FROM ({_STATS})")
def _(t):
    return fo.rolling_stats(fo.to_long(signals(t), ["instrument", "month"])).select("dimension", rnd("mean", 6).alias("mean"), rnd("std", 6).alias("std"), "n")


@query("M3_signal_extraction", """
SELECT d.instrument, s.s_mom AS technical_momentum, (ann + pen) / 2 AS fundamentals, s.s_rev AS revenue_quality, sh AS shareholders, plg AS pledge_ratio, div AS dividends, s.s_flow AS institutional_flow,
  round(greatest(0.0e0, least(100.0e0, combined_score)), 1) AS signal_quality, round(((50.0e0 + d.instrument % 50) + (c.sentiment * 60.0e0 + 60.0e0)) / 2, 1) AS microstructure, news AS news_sentiment,
  CASE WHEN xadj <> 0 THEN greatest(0.0e0, least(100.0e0, round(xadj * 10.0e0 + 60.0e0, 1))) END AS cross_asset, earn AS earnings_quality, greatest(0.0e0, least(100.0e0, round(sig * 133.0e0 + 60.0e0, 1))) AS risk_management
FROM v_deep d JOIN v_screen s ON s.instrument = d.instrument JOIN v_candle c ON c.instrument = s.instrument AND c.date = s.date""")
def _(t):
    from tickloom.operators import indicators as ind

    c = F.col
    kind = ind.candle(c("open"), c("high"), c("low"), c("close"))["sentiment"]
    last = t.panel.where("rn = 1").select("instrument", kind.alias("sentiment"))
    base = deep(t).join(screened(t).select("instrument", "momentum", "revenue", "flow"), "instrument").join(last, "instrument")
    sig = fx.extract_signals({
        "momentum": c("momentum"), "revenue": c("revenue"), "flow": c("flow"), "stage1_score": c("stage1_score"), "checks": fun.check_score,
        "combined_score": c("combined_score"), "sr_score": (c("instrument") % 50 + 50.0), "sentiment": c("sentiment"),
        "cross_asset_adjustment": c("cross_asset_adjustment"), "earnings_signal": c("earnings_signal")})
    return base.select("instrument", *[v.alias(k) for k, v in sig.items()])


@query("M4_ensemble_score", "SELECT instrument, month, ensemble_score, raw_weighted_sum, raw_score_equivalent, dimensions_used, dimensions_missing, interaction_bonus, label FROM v_ens")
def _(t):
    return scored(t)[0].select("instrument", "month", "ensemble_score", "raw_weighted_sum", "raw_score_equivalent", "dimensions_used",
                               F.concat_ws(",", "dimensions_missing").alias("dimensions_missing"), "interaction_bonus", "label")


VIEWS["v_samples"] = """
SELECT d.doc_id, d.lang AS model, d.n_chars * 1.0e0 / (d.n_chars + 3000.0e0) AS predicted, l.quality AS outcome FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
VIEWS["v_bins"] = """
SELECT model, bin, round(m, 4) AS predicted, CASE WHEN bin >= 2 THEN lag(round(m, 4)) OVER (PARTITION BY model ORDER BY bin) ELSE 0.0e0 END AS input_min, CASE WHEN bin < k - 1 THEN round(m, 4) ELSE 1.0e0 END AS input_max,
  round(rate, 4) AS output, sample_count
FROM (SELECT model, bin, any_value(k) AS k, avg(predicted) AS m, avg(outcome) AS rate, count(*) AS sample_count FROM (
  SELECT *, CAST(least(floor((pos - 1) / floor(n / k)), k - 1) AS INT) AS bin FROM (
   SELECT *, CAST(greatest(3, least(10, floor(n / 3))) AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY predicted, doc_id) AS pos, count(*) OVER (PARTITION BY model) AS n FROM v_samples))
  WHERE n >= 5) GROUP BY 1, 2)"""


def samples(t):
    return t.read("documents").join(t.read("labels"), "doc_id").select(
        "doc_id", F.col("lang").alias("model"), (F.col("n_chars") / (F.col("n_chars") + 3000.0)).alias("predicted"), F.col("quality").alias("outcome"))


@query("M5_apply_calibration", """
SELECT doc_id, model, round(greatest(0.01e0, least(0.99e0, coalesce(h.output, e.a + p * (e.b - e.a)))), 4) AS calibrated
FROM (SELECT doc_id, lang AS model, n_chars * 1.0e0 / (n_chars + 3000.0e0) AS p FROM documents) d
LEFT JOIN LATERAL (SELECT output FROM v_bins b WHERE b.model = d.model AND d.p BETWEEN b.input_min AND b.input_max ORDER BY bin LIMIT 1) h ON true
JOIN (SELECT model, first(output ORDER BY bin) AS a, last(output ORDER BY bin) AS b FROM v_bins GROUP BY model) e USING (model)""")
def _(t):
    bins = fo.fit_bins(samples(t), "model", "predicted", "outcome", ["doc_id"])
    docs = t.read("documents").select("doc_id", F.col("lang").alias("model"), (F.col("n_chars") / (F.col("n_chars") + 3000.0)).alias("p"))
    return fo.calibrate(docs, bins, "model", "p").select("doc_id", "model", "calibrated")


def _term(d):
    return f"(z_{d} * {fx.DIMENSION_WEIGHTS[d]!r}e0" + "".join(f" + z_{a} * z_{b} * 0.1e0 * {w!r}e0" for a, b, w in fx.INTERACTIONS if d in (a, b)) + ")"


_LOO = ", ".join(f"round(ensemble_score - {_prob('w - ' + _term(d))[1]}, 6) AS c_{d}" for d in fx.DIMENSIONS)


@query("M6_feature_importance", "SELECT * FROM (SELECT instrument, month, dimension, contribution, row_number() OVER (PARTITION BY instrument, month ORDER BY abs(contribution) DESC, i) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT instrument, month, {i} AS i, '{d}' AS dimension, c_{d} AS contribution FROM (SELECT instrument, month, {_LOO} FROM v_ens)" for i, d in enumerate(fx.DIMENSIONS)) + ")) WHERE rank <= 3")
def _(t):
    x, z, _ = scored(t)
    x = x.withColumn("w", fx.weighted_sum(z))
    top = F.slice(fx.importance(F.col("w"), F.col("ensemble_score"), z), 1, 3)
    return x.select("instrument", "month", F.explode(top).alias("r")).select("instrument", "month", "r.dimension", "r.contribution", F.col("r.rank").cast("long").alias("rank"))


@query("M7_calibration_fit", "SELECT * FROM v_bins")
def _(t):
    return fo.fit_bins(samples(t), "model", "predicted", "outcome", ["doc_id"])


@query("M7_monotone_fit", """
WITH s AS (SELECT a.model, a.bin AS lo, b.bin AS hi, sum(c.output * c.sample_count) / sum(c.sample_count) AS mean
  FROM v_bins a JOIN v_bins b ON a.model = b.model AND a.bin <= b.bin JOIN v_bins c ON c.model = a.model AND c.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2, 3),
f AS (SELECT v.model, v.bin, s.lo, min(s.mean) AS least FROM v_bins v JOIN s ON s.model = v.model AND s.lo <= v.bin AND s.hi >= v.bin GROUP BY 1, 2, 3)
SELECT v.model, v.bin, v.output, f.monotone FROM v_bins v JOIN (SELECT model, bin, round(max(least), 4) AS monotone FROM f GROUP BY 1, 2) f ON f.model = v.model AND f.bin = v.bin""")
def _(t):
    bins = fo.fit_bins(samples(t), "model", "predicted", "outcome", ["doc_id"])
    return fo.monotone_bins(bins, "model").select("model", "bin", "output", "monotone")


@query("M8_platt_fit", """
WITH RECURSIVE f AS (
  SELECT 0 AS i, 0.0e0 AS a, 0.0e0 AS b
  UNION ALL
  SELECT i + 1, a + (sw * gx - swx * g) / (sw * swxx - swx * swx), b + (swxx * g - swx * gx) / (sw * swxx - swx * swx)
  FROM (SELECT i, a, b, sum(p * (1 - p)) AS sw, sum(p * (1 - p) * x) AS swx, sum(p * (1 - p) * x * x) AS swxx, sum(y - p) AS g, sum((y - p) * x) AS gx
        FROM (SELECT f.i, f.a, f.b, s.predicted AS x, s.outcome AS y, 1 / (1 + exp(-(f.a * s.predicted + f.b))) AS p FROM f, v_samples s WHERE f.i < 30) GROUP BY 1, 2, 3))
SELECT round(a, 3) AS platt_a, round(b, 3) AS platt_b FROM f WHERE i = 30""")
def _(t):
    return fo.platt(samples(t), "predicted", "outcome").select(rnd("platt_a", 3).alias("platt_a"), rnd("platt_b", 3).alias("platt_b"))


_N = " + ".join(f"CAST({d} IS NOT NULL AS INT)" for d in fx.DIMENSIONS)


@query("M9_confidence_band", f"""
SELECT instrument, month, lower, upper, round(upper - lower, 4) AS width, round(agree, 4) AS agreement_score, CAST(13 - n AS INT) AS dimensions_missing FROM (
 SELECT *, round(greatest(0.01e0, ensemble_score - wd / 2), 4) AS lower, round(least(0.99e0, ensemble_score + wd / 2), 4) AS upper FROM (
  SELECT *, greatest(0.04e0, least(0.4e0, (1.0e0 - agree * 0.6e0) * 0.1e0 + (13 - n) / 13.0e0 * 0.15e0 + 0.05e0)) AS wd FROM (
   SELECT *, CASE WHEN n >= 2 THEN greatest(ps, ng) / (n * 1.0e0) * 0.6e0 + greatest(0.1e0, 1.0e0 / (1.0e0 + sqrt(var))) * 0.4e0 WHEN n = 1 THEN 0.3e0 ELSE 0.1e0 END AS agree FROM (
    SELECT *, ({' + '.join(f"CASE WHEN {d} IS NOT NULL THEN (z_{d} - mean) * (z_{d} - mean) ELSE 0.0e0 END" for d in fx.DIMENSIONS)}) / n AS var FROM (
     SELECT *, ({' + '.join('z_' + d for d in fx.DIMENSIONS)}) / nullif(n, 0) AS mean FROM (SELECT *, {_N} AS n, {' + '.join(f"CAST({d} IS NOT NULL AND z_{d} > 0 AS INT)" for d in fx.DIMENSIONS)} AS ps,
       {' + '.join(f"CAST({d} IS NOT NULL AND z_{d} < 0 AS INT)" for d in fx.DIMENSIONS)} AS ng FROM v_ens))))))""")
def _(t):
    x, z, raw = scored(t)
    return fo.with_confidence(x, "ensemble_score", z, raw).select("instrument", "month", "lower", "upper", "width", "agreement_score", "dimensions_missing")


@query("M10_fusion_ranking", "SELECT instrument, month, ensemble_score, row_number() OVER (PARTITION BY month ORDER BY ensemble_score DESC, instrument) AS rank FROM v_ens")
def _(t):
    # read twice, for the counts of its values and for its rows
    scores = t.shared("ensemble", ("lineitem",), lambda: scored(t)[0].select("instrument", "month", "ensemble_score"))
    r = fo.rank_batch(scores, "month", "ensemble_score", "instrument")
    return r.select("instrument", "month", "ensemble_score", F.col("rank").cast("long").alias("rank"))


@query("M10_fusion_summary", """
SELECT month, count(*) AS total, round(round(sum(ensemble_score), 6) / count(*), 4) AS avg_score, max(ensemble_score) AS max_score, min(ensemble_score) AS min_score,
  count(*) FILTER (WHERE ensemble_score >= 0.65e0) AS high_conviction, count(*) FILTER (WHERE ensemble_score < 0.35e0) AS low_conviction FROM v_ens GROUP BY month""")
def _(t):
    return fo.batch_summary(t.shared("ensemble", ("lineitem",), lambda: scored(t)[0].select("instrument", "month", "ensemble_score")), "month", "ensemble_score")
