import datetime as dt
import random

import numpy as np
import pytest

from tickloom.operators import optimiser as opt
from tickloom.operators.risk import scenario_weights


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_smoothing_limits_each_step_from_the_smoothed_weights():
    new, back = opt.smoothed({1: 0.5, 2: 0.5}, {2: 0.5, 3: 0.5})
    assert back == {1, 3} and new == {1: 0.45, 2: 0.5, 3: 0.05}
    again, back = opt.smoothed(new, {2: 0.5, 3: 0.5})
    assert again == {1: 0.4, 2: 0.5, 3: 0.1} and back == {1, 3}
    assert opt.smoothed({1: 2.0, 2: 2.0}, {1: 1.0, 2: 1.02}) == ({1: 0.49505, 2: 0.50495}, set())


@pytest.fixture(scope="module")
def inputs(spark):
    r = random.Random(7)
    candidates, returns = [], []
    for book in ("a", "b"):
        for date in range(5):
            name = f"{book}{date}"
            held = range(1, 7) if date != 3 else range(4, 9)
            for i in held:
                score = 0.2 if (book, date) == ("b", 1) else r.choice([0.3, 0.4, 0.6, 0.9])
                candidates.append((book, day(date), name, i, score))
                for k in range(1, 41 if date != 2 else 20):  # too few returns on one date
                    returns.append((name, i, k, r.gauss(0.001 * i, 0.02)))
    return (spark.createDataFrame(candidates, "book string, date date, portfolio string, instrument long, score double"),
            spark.createDataFrame(returns, "portfolio string, instrument long, k int, ret double"), candidates, returns)


def brute(spark, candidates, returns, stored, cap=0.4, n=25):
    """Date by date with matrices: chosen, covariance, vectors, the better weighting, limited steps."""
    out = {}
    for book in sorted({c[0] for c in candidates}):
        held = {}
        for date in sorted({c[1] for c in candidates if c[0] == book} | {s[1] for s in stored if s[0] == book}):
            mine = {c[3]: c[4] for c in candidates if c[:2] == (book, date)}
            if mine:
                name = next(c[2] for c in candidates if c[:2] == (book, date))
                chosen = {i: s for i, s in mine.items() if s >= 0.35} or dict(sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:10])
                ids = sorted(chosen)
                panel = {i: [x[3] for x in sorted(returns, key=lambda x: x[2]) if x[:2] == (name, i)] for i in ids}
                length = min(map(len, panel.values()))
                if length < 30:
                    new, method = {i: round(1 / len(ids), 4) for i in ids}, "equal_weight"
                else:
                    cov = np.atleast_2d(np.cov([panel[i][:length] for i in ids]))
                    frame = scenario_weights(spark.createDataFrame([(1, i) for i in ids], "portfolio long, instrument long"), "portfolio", n, cap)
                    table = {(r["scenario"], r["instrument"]): r["weight"] for r in frame.collect()}
                    vectors = np.array([[table[s, i] for i in ids] for s in range(n)])
                    expected = np.array([(chosen[i] - 0.5) * 0.002 for i in ids])
                    trust = np.array([min(chosen[i], 0.8) for i in ids])
                    now = np.array([held.get(i, 0.0) for i in ids])
                    now = now / now.sum() if now.sum() else np.full(len(ids), 1 / len(ids))
                    blended = (1 - trust) * 2.5 * (cov @ now) + trust * expected
                    vol = np.sqrt(np.einsum("si,ij,sj->s", vectors, cov, vectors) * 252)
                    picks = {m: max((round(float(v), 8), -s) for s, v in enumerate((vectors @ mu * 252 - 0.011) / vol)) for m, mu in (("mean_variance", expected), ("blended", blended))}
                    method = "blended" if picks["blended"][0] > picks["mean_variance"][0] else "mean_variance"
                    target = dict(zip(ids, vectors[-picks[method][1]].tolist(), strict=True))
                    new = opt.smoothed(held, target)[0] if held else {i: round(w, 6) for i, w in target.items()}
                out.update({(book, date, i): (new.get(i, 0.0), method) for i in new.keys() | held.keys()})
                held = {i: w for i, w in new.items() if w > 0}
            if kept := {s[2]: s[3] for s in stored if s[:2] == (book, date)}:
                held = kept
    return out


@pytest.mark.parametrize("stored", [[], [("a", day(0), 1, 0.7), ("a", day(0), 9, 0.3), ("b", day(-9), 2, 1.0), ("b", day(7), 2, 1.0)]])
def test_flow_against_matrices(spark, inputs, stored):
    candidates, returns, raw, series = inputs
    kept = spark.createDataFrame(stored, "book string, date date, instrument long, weight double") if stored else None
    rows = opt.rebalance(candidates, returns, 25, 0.4, stored=kept).collect()
    got = {(r["book"], r["date"], r["instrument"]): (r["weight"], r["method"]) for r in rows}
    want = brute(spark, raw, series, stored)
    assert got.keys() == want.keys() and len(rows) == len(got)
    for k, (w, method) in want.items():
        assert got[k][1] == method and abs(got[k][0] - w) < 2e-6, k
    assert {m for _, m in want.values()} == {"equal_weight", "mean_variance", "blended"}
    assert any(r["limited"] for r in rows)


def test_flow_of_no_candidates(spark, inputs):
    candidates, returns, *_ = inputs
    assert opt.rebalance(candidates.limit(0), returns, 5, 0.4).collect() == []
