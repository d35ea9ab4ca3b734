"""Fusion operators that need data movement: statistics, calibration, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import fusion as fx
from tickloom.functions.typing import clamp, dbl, rnd
from tickloom.operators.backtest import running


def to_long(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("score")) for d in fx.DIMENSIONS])
    return signals.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def rolling_stats(long: DataFrame) -> DataFrame:
    """Mean and population deviation per dimension; a flat dimension gets deviation 1."""
    sd = F.stddev_pop("score")
    return long.groupBy("dimension").agg(F.avg("score").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("std"), F.count("score").alias("n"))


def normalize_long(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Clamped z-scores; ``stats`` has one row per dimension."""
    x = long.join(stats.select("dimension", "mean", "std"), "dimension", "left")
    return x.withColumn("z", fx.zscore(F.col("score"), F.coalesce("mean", dbl(fx.DEFAULT_MEAN)), F.coalesce("std", dbl(fx.DEFAULT_STD)))).drop("mean", "std")


def with_z(signals: DataFrame) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Signals with ``z_<dimension>`` columns, plus the column maps for z and raw."""
    out = signals.withColumns({f"z_{d}": fx.zscore(F.col(d)) for d in fx.DIMENSIONS})
    return out, {d: F.col(f"z_{d}") for d in fx.DIMENSIONS}, {d: F.col(d) for d in fx.DIMENSIONS}


def with_confidence(df: DataFrame, score: str, z: dict[str, Column], raw: dict[str, Column], variance: Column | None = None) -> DataFrame:
    """Adds lower, upper, width, agreement_score and dimensions_missing, in stages so that no sum is repeated."""
    dims = fx.DIMENSIONS
    total = lambda parts: sum(parts[1:], parts[0])
    ok = {d: raw[d].isNotNull() for d in dims}
    x = df.withColumns({
        "_n": total([ok[d].cast("int") for d in dims]),
        "_pos": total([F.when(ok[d] & (z[d] > 0), 1).otherwise(0) for d in dims]),
        "_neg": total([F.when(ok[d] & (z[d] < 0), 1).otherwise(0) for d in dims]),
        "_zs": total([z[d] for d in dims]),  # a missing dimension has z = 0
    }).withColumn("_mean", F.col("_zs") / F.nullif(F.col("_n"), F.lit(0)))
    m = F.col("_mean")
    x = x.withColumn("_var", total([F.when(ok[d], (z[d] - m) * (z[d] - m)).otherwise(0.0) for d in dims]) / F.nullif(F.col("_n"), F.lit(0)))
    agree = F.when(F.col("_n") >= 2, F.greatest("_pos", "_neg") / F.col("_n").cast("double") * 0.6 + F.greatest(dbl(0.1), dbl(1) / (dbl(1) + F.sqrt("_var"))) * 0.4).when(
        F.col("_n") == 1, 0.3).otherwise(0.1)
    hist = F.when(variance > 0, F.sqrt(variance) * 0.5).otherwise(0.05) if variance is not None else dbl(0.05)
    x = x.withColumn("_agree", agree).withColumn("dimensions_missing", F.lit(len(dims)) - F.col("_n"))
    x = x.withColumn("_w", clamp((dbl(1) - F.col("_agree") * 0.6) * 0.10 + F.col("dimensions_missing") / float(len(dims)) * 0.15 + hist, 0.04, 0.40))
    x = x.withColumns({"lower": rnd(F.greatest(dbl(0.01), F.col(score) - F.col("_w") / 2), 4), "upper": rnd(F.least(dbl(0.99), F.col(score) + F.col("_w") / 2), 4),
                       "agreement_score": rnd("_agree", 4)})
    return x.withColumn("width", rnd(F.col("upper") - F.col("lower"), 4)).drop("_n", "_pos", "_neg", "_zs", "_mean", "_var", "_agree", "_w")


def fit_bins(samples: DataFrame, model: str, score: str, outcome: str, order: Sequence[str], width: float = 0.001) -> DataFrame:
    """Equal-count bins of the predicted score with their win rate, per model.

    The position of a sample comes from a two-level scan: score ranges of
    ``width`` first, then one row per range, so a large model is not sorted in
    one task. Bins overlap as in the original rule: a bin reaches down to the
    mean of the bin before the previous one.
    """
    s = samples.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_c", F.floor(F.col(score) / width)).withColumn("_one", F.lit(1))
    n = s.groupBy(model).agg(F.count("*").alias("n")).where("n >= 5")
    r = running(s, [model], "_c", [F.col(score), *[F.col(o) for o in order]], {"pos": "_one"}).join(n, model)
    k = F.greatest(F.lit(3), F.least(F.lit(10), F.floor(F.col("n") / 3))).cast("int")
    r = r.withColumn("k", k).withColumn("bin", F.least(F.floor((F.col("pos") - 1) / F.floor(F.col("n") / F.col("k"))), F.col("k") - 1).cast("int"))
    b = r.groupBy(model, "bin", "k").agg(F.avg(score).alias("m"), F.avg(F.col(outcome).cast("double")).alias("rate"), F.count("*").alias("sample_count"))
    w = Window.partitionBy(model).orderBy("bin")  # at most ten bins per model
    return b.select(
        model, "bin", rnd("m", 4).alias("predicted"),
        F.when(F.col("bin") >= 2, F.lag(rnd("m", 4)).over(w)).otherwise(0.0).alias("input_min"),
        F.when(F.col("bin") < F.col("k") - 1, rnd("m", 4)).otherwise(1.0).alias("input_max"),
        rnd("rate", 4).alias("output"), "sample_count")


def monotone_bins(bins: DataFrame, model: str) -> DataFrame:
    """``bins`` with ``monotone``: the non-decreasing outputs closest to theirs, weighted by sample_count.

    Pool-adjacent-violators as a fold over the ordered bins of a model (ten at most):
    a new bin joins the blocks before it for as long as their mean is not below its own.
    """
    block = "struct<s: double, w: double, bins: array<int>>"
    mean = lambda b: b["s"] / b["w"]

    def step(pooled, last):
        joins = (F.size(pooled["rest"]) == 0) & (mean(last) >= mean(pooled["top"]))
        both = F.struct((last["s"] + pooled["top"]["s"]).alias("s"), (last["w"] + pooled["top"]["w"]).alias("w"), F.concat(last["bins"], pooled["top"]["bins"]).alias("bins"))
        return F.struct(F.when(joins, both).otherwise(pooled["top"]).alias("top"), F.when(joins, pooled["rest"]).otherwise(F.concat(F.array(last), pooled["rest"])).alias("rest"))

    def add(blocks, b):
        start = F.struct(b.alias("top"), F.array().cast(f"array<{block}>").alias("rest"))
        return F.aggregate(F.reverse(blocks), start, step, lambda x: F.concat(x["rest"], F.array(x["top"])))

    weight = F.col("sample_count").cast("double")
    one = F.struct((F.col("output") * weight).alias("s"), weight.alias("w"), F.array(F.col("bin").cast("int")).alias("bins")).cast(block)
    ordered = bins.groupBy(model).agg(F.array_sort(F.collect_list(F.struct("bin", one.alias("b")))).alias("all"))
    blocks = ordered.select(model, F.explode(F.aggregate(F.transform("all", lambda x: x["b"]), F.array().cast(f"array<{block}>"), add)).alias("b"))
    fitted = blocks.select(model, F.explode("b.bins").alias("bin"), rnd(F.col("b.s") / F.col("b.w"), 4).alias("monotone"))
    return bins.join(fitted, [model, "bin"])


def calibrate(scores: DataFrame, bins: DataFrame, model: str, p: str) -> DataFrame:
    """Calibrated probability; the (at most ten) bins of a model travel as one array."""
    m = bins.groupBy(model).agg(F.array_sort(F.collect_list(F.struct("bin", "input_min", "input_max", "output"))).alias("_m"))
    return scores.join(m, model, "left").withColumn("calibrated", F.when(F.col("_m").isNotNull(), fx.apply_mapping(F.col(p), F.col("_m"))).otherwise(F.col(p))).drop("_m")


def platt(samples: DataFrame, score: str, outcome: str) -> DataFrame:
    """Slope and intercept of a logistic fit of the outcome on the score (distributed log-loss fit)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = samples.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.col(outcome).cast("double").alias("label"))
    fit = LogisticRegression(maxIter=500, tol=1e-12, regParam=0.0, standardization=True).fit(train)
    # two numbers of the fitted model, not data
    return samples.sparkSession.range(1).select(dbl(float(fit.coefficients[0])).alias("platt_a"), dbl(float(fit.intercept)).alias("platt_b"))


def rank_batch(scored: DataFrame, batch: str, score: str, key: str, digits: int = 4, width: int = 4096) -> DataFrame:
    """Rank within a batch by falling score, then by the numeric ``key``.

    A value's rank follows from the counts of the values above it (at most
    10**digits values of a probability rounded to ``digits``); rows of one value
    are numbered by ranges of the key. No batch is sorted in one task.
    """
    values = scored.groupBy(batch, score).agg(F.count("*").alias("_m"))
    above = Window.partitionBy(batch).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    values = values.select(batch, score, F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_above"))
    x = running(scored.withColumn("_c", F.floor(F.col(key) / width)).withColumn("_one", F.lit(1)), [batch, score], "_c", [key], {"_pos": "_one"})
    return x.join(values, [batch, score]).withColumn("rank", F.col("_above") + F.col("_pos")).drop("_c", "_one", "_pos", "_above")


def batch_summary(scored: DataFrame, batch: str, score: str) -> DataFrame:
    s = F.col(score)
    return scored.groupBy(batch).agg(
        F.count("*").alias("total"), rnd(rnd(F.sum(s), 6) / F.count("*"), 4).alias("avg_score"), F.max(s).alias("max_score"), F.min(s).alias("min_score"),
        F.count_if(s >= 0.65).alias("high_conviction"), F.count_if(s < 0.35).alias("low_conviction"))
