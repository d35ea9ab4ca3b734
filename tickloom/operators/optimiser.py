"""Rebalancing of portfolios, date after date, against the weights that were reached before.

What does not depend on earlier dates is computed for all dates at once: candidates,
covariance, weight vectors, their volatility and return, and how a vector's blended
return answers to the weights held. The rest is an ordered fold per book whose state is
a map instrument -> weight: the better of two weightings, limited in its step from the
state, is the next state. Books run in parallel; a task holds one date of a book.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.typing import dbl, rnd
from tickloom.operators.indicators import KEY
from tickloom.operators.risk import RISK_FREE, _ratio, aligned_panel, covariance, expected_from_score, scenario_weights
from tickloom.sources.workers import ship

# Fixed values.
MAX_CHANGE, MOST_CONFIDENCE, AVERSION, MIN_SCORE, FALLBACK = 0.05, 0.8, 2.5, 0.35, 10

OUT = f"book string, date date, {KEY} long, target double, previous double, change double, weight double, limited boolean, method string, sharpe double"


def rounded(x: float, digits: int) -> float:
    import math

    m = 10.0**digits
    return math.copysign(math.floor(abs(x) * m + 0.5), x) / m


def shares(weights: dict[int, float]) -> dict[int, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(weights)


def smoothed(old: dict[int, float], new: dict[int, float], most: float = MAX_CHANGE) -> tuple[dict[int, float], set[int]]:
    """Shares moved from old to new by ``most`` each at the most, as shares again; and which were held back."""
    old, new, out, held_back = shares(old), shares(new), {}, set()
    for k in sorted(old.keys() | new.keys()):
        a, b = old.get(k, 0.0), new.get(k, 0.0)
        if abs(b - a) > most:
            held_back.add(k)
            b = a + (most if b > a else -most)
        out[k] = b
    return {k: rounded(v, 6) for k, v in shares(out).items()}, held_back


def choose(held: dict[int, float], ids: list[int], options: list[dict]) -> tuple[dict[int, float], str, float]:
    """The better of the best vector by expected returns and the best by returns blended with those implied by ``held``."""
    import numpy as np

    now = np.array([held.get(i, 0.0) for i in ids])
    now = now / now.sum() if now.sum() > 0 else np.full(len(ids), 1.0 / len(ids))

    def best(sharpe):
        return max((rounded(s, 8), -o["scenario"], n) for n, (s, o) in enumerate(zip(sharpe, options, strict=True)))

    own = best([o["sharpe"] for o in options])
    blend = best([(float(o["fixed"] + np.dot(o["answers"], now)) * 252 - RISK_FREE) / o["volatility"] if o["volatility"] > 1e-10 else 0.0 for o in options])
    name, pick = ("blended", blend) if blend[0] > own[0] else ("mean_variance", own)
    return dict(zip(ids, options[pick[2]]["weights"], strict=True)), name, pick[0]


def _fold(batches) -> Iterator:
    """Rows of a book in order of their dates; the state is what the book holds."""
    import pyarrow as pa

    names = ["book", "date", KEY, "target", "previous", "change", "weight", "limited", "method", "sharpe"]
    types = [pa.string(), pa.date32(), pa.int64(), *[pa.float64()] * 4, pa.bool_(), pa.string(), pa.float64()]
    book, held = None, {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["book"] != book:
                book, held = r["book"], {}
            if r["stored"] is not None:  # weights kept elsewhere as of this date
                held = {k: v for k, v in zip(r["ids"], r["stored"], strict=True) if v > 0}
                continue
            old = shares(held)
            if r["options"] is None:  # too few returns: equal weights, as they are
                target, method, sharpe = dict.fromkeys(r["ids"], 1.0 / len(r["ids"])), "equal_weight", 0.0
                new, back = dict.fromkeys(r["ids"], rounded(1.0 / len(r["ids"]), 4)), set()
            else:
                target, method, sharpe = choose(held, r["ids"], r["options"])
                new, back = smoothed(held, target) if held else ({k: rounded(v, 6) for k, v in shares(target).items()}, set())
            for k in sorted(old.keys() | new.keys()):
                a, b = old.get(k, 0.0), new.get(k, 0.0)
                rows.append((book, r["date"], k, rounded(target.get(k, 0.0), 6), rounded(a, 6), rounded(b - a, 6), b, k in back, method, sharpe))
            held = {k: v for k, v in new.items() if v > 0}
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def options(chosen: DataFrame, cov: DataFrame, scenarios: DataFrame, portfolio: str) -> DataFrame:
    """(portfolio, ids, options): per weight vector its volatility, its Sharpe ratio by expected returns, and
    the two parts of its blended return: a fixed one, and what each unit of weight held adds."""
    views = chosen.select(portfolio, KEY, F.least(F.col("score"), dbl(MOST_CONFIDENCE)).alias("conf"), "expected")
    a = scenarios.join(views, [portfolio, KEY]).select(portfolio, "scenario", F.col(KEY).alias("a"), F.col("weight").alias("wa"), F.col("conf").alias("ca"))
    other = a.join(cov, [portfolio, "a"]).groupBy(portfolio, "scenario", F.col("b").alias(KEY)).agg(
        F.sum(F.col("wa") * F.col("cov")).alias("wc"), F.sum(F.col("wa") * (dbl(1) - F.col("ca")) * F.col("cov") * AVERSION).alias("answer"))
    x = scenarios.join(views, [portfolio, KEY]).join(other, [portfolio, "scenario", KEY])
    # a portfolio is bounded by its position limit, its vectors by their number
    x = x.groupBy(portfolio, "scenario").agg(
        F.sum(F.col("weight") * F.col("wc")).alias("var"), F.sum(F.col("weight") * F.col("expected")).alias("own"),
        F.sum(F.col("weight") * F.col("conf") * F.col("expected")).alias("fixed"), F.array_sort(F.collect_list(F.struct(KEY, "weight", "answer"))).alias("h"))
    r = _ratio(F.col("own"), F.col("var"))
    one = F.struct("scenario", r["annual_volatility"].alias("volatility"), r["sharpe"].alias("sharpe"), "fixed", F.col("h.weight").alias("weights"), F.col("h.answer").alias("answers"))
    return x.select(portfolio, F.col(f"h.{KEY}").alias("ids"), one.alias("o")).groupBy(portfolio).agg(F.first("ids").alias("ids"), F.array_sort(F.collect_list("o")).alias("options"))


def rebalance(
    candidates: DataFrame, returns: DataFrame, n_scenarios: int, cap: float, minimum: float = MIN_SCORE, fallback: int = FALLBACK,
    stored: DataFrame | None = None, portfolio: str = "portfolio", min_n: int = 30,
) -> DataFrame:
    """Weights of every book and date: candidates to expected returns, the better of two weightings, equal weights
    where returns are too few, and steps limited against the weights before.

    ``candidates`` are (book, date, portfolio, instrument, score), one portfolio per book and date; ``returns``
    are (portfolio, instrument, k, ret), newest first. ``stored`` (book, date, instrument, weight) are weights kept
    elsewhere: a date is compared with the latest weights before it, stored or reached here. Instruments that no
    longer are candidates leave in limited steps.
    """
    chosen = expected_from_score(candidates, portfolio, "score", minimum, fallback)
    panel = aligned_panel(returns.join(chosen.select(portfolio, KEY), [portfolio, KEY], "left_semi").select(portfolio, KEY, "k", "ret"), portfolio, min_n)
    vectors = scenario_weights(panel.select(portfolio, KEY).distinct(), portfolio, n_scenarios, cap)
    ready = options(chosen, covariance(panel, portfolio), vectors, portfolio)
    dates = chosen.groupBy("book", "date", portfolio).agg(F.array_sort(F.collect_list(KEY)).alias("all"))
    none = F.lit(None).cast("array<double>").alias("stored")
    rows = dates.join(ready, portfolio, "left").select(F.col("book").cast("string").alias("book"), "date", F.lit(0).alias("kind"), F.coalesce("ids", "all").cast("array<bigint>").alias("ids"), "options", none)
    if stored is not None:
        kept = stored.groupBy("book", "date").agg(F.array_sort(F.collect_list(F.struct(KEY, "weight"))).alias("h"))
        rows = rows.unionByName(kept.select(F.col("book").cast("string").alias("book"), "date", F.lit(1).alias("kind"), F.col(f"h.{KEY}").cast("array<bigint>").alias("ids"), F.lit(None).cast(rows.schema["options"].dataType).alias("options"), F.col("h.weight").cast("array<double>").alias("stored")))
    ship(candidates.sparkSession)
    return rows.repartition("book").sortWithinPartitions("book", "date", "kind").mapInArrow(_fold, OUT)
