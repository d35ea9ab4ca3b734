import datetime as dt
import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import fusion as fx
from tickloom.functions import scores as sc
from tickloom.operators import alerts as al
from tickloom.operators import fusion as fo
from tickloom.operators import fundamentals as fun
from tickloom.operators import market as mk
from tickloom.sources.store import fresh_path
from tickloom.streaming import rules

T0 = dt.datetime(2024, 1, 1)


def hot_events(seed, n=600):
    """One key holds most events; times repeat and cross many chunks."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.7 else f"k{i % 4}", T0 + dt.timedelta(seconds=rng.randrange(0, 6 * 86400, 300))) for i in range(n)]


def brute(rows, seconds):
    out, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() >= seconds:
            out.add(i)
            last[k] = t
    return out


@pytest.mark.parametrize("seed,seconds,chunk", [(1, 4 * 3600, 86400), (2, 1800, 86400), (3, 4 * 3600, 4 * 3600), (4, 3600, 7200)])
def test_spaced_matches_brute_force(spark, seed, seconds, chunk):
    rows = hot_events(seed)
    df = spark.createDataFrame(rows, "event_id long, kind string, ts timestamp_ntz")
    got = {r.event_id for r in al.spaced(df, ["kind"], "ts", "event_id", seconds, chunk).collect()}
    assert got == brute(rows, seconds)


def test_spaced_keeps_groups_together_when_a_join_turns_into_a_broadcast(spark):
    """The join of the events with their entry times is planned as a sort merge join and becomes a broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    r = random.Random(6)
    rows = [(i, f"k{i % 3}", T0 + dt.timedelta(seconds=r.randrange(3 * 86400))) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, kind string, ts timestamp_ntz").repartition(4)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {x.event_id for x in al.spaced(df, ["kind"], "ts", "event_id", 4 * 3600).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute(rows, 4 * 3600)


def decided(rows, seconds):
    """What the batch rule accepts of the rows that the final watermark (latest time less four hours) has passed."""
    end = max(t for _, _, t in rows) - dt.timedelta(hours=4)
    at = {i: t for i, _, t in rows}
    return {i for i in brute(rows, seconds) if at[i] < end}


def run_stream(spark, files, seconds):
    """One file per trigger, in the order given."""
    src = fresh_path(spark, "src")
    schema = "event_id long, kind string, ts timestamp_ntz"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the source takes files by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = rules.dedupe_stream(stream, ["kind"], "ts", "event_id", seconds)
    return sorted(r.event_id for r in rules.drain(out, fresh_path(spark, "out"), fresh_path(spark, "ck")).collect())


def test_stream_agrees_with_batch(spark):
    rows = hot_events(9, 300)
    assert run_stream(spark, [rows], 4 * 3600) == sorted(decided(rows, 4 * 3600))


def test_stream_waits_for_late_rows(spark):
    """Rows out of order within the lateness, over several triggers, are judged in time order."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    files = [[(1, "a", at(10)), (2, "b", at(10))], [(3, "a", at(8)), (4, "a", at(12))], [(5, "b", at(13.5)), (6, "c", at(30))]]
    rows = [r for f in files for r in f]
    assert run_stream(spark, files, 4 * 3600) == sorted(decided(rows, 4 * 3600)) == [2, 3, 4]
    rng = random.Random(4)
    rows = sorted(hot_events(5, 200), key=lambda r: r[2])
    shuffled = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(200)))  # late by less than four hours
    files = [shuffled[i : i + 70] for i in range(0, len(shuffled), 70)]
    assert run_stream(spark, files, 3600) == sorted(decided(rows, 3600))


def test_one_key_is_spread_over_tasks(spark):
    """A single key over a long time: no group of the tree holds a share that grows with the history."""
    rows = [(i, "only", T0 + dt.timedelta(minutes=37 * i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, kind string, ts timestamp_ntz")
    got = {r.event_id for r in al.spaced(df, ["kind"], "ts", "event_id", 4 * 3600).collect()}
    assert got == brute(rows, 4 * 3600)
    starts = [al.reduce_chunk(np.array([m * 37 * 60_000_000 for m in range(7 * c, 7 * c + 7)]), 7 * c * 37 * 60_000_000, 4 * 3600 * 1_000_000) for c in range(al.FAN)]
    assert len(al.compose(starts, 4 * 3600 * 1_000_000)[0]) <= 8  # one cooldown's events, however many chunks


def test_python_workers_find_the_package_from_any_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, '/root/repo' if not sys.argv[1:] else sys.argv[1])\n"
        "import __spark_entry__ as e\nfrom tickloom.session import local_session\n"
        "s = local_session('elsewhere', 2)\nprint('ROWS', e.queries()['N5_rate_limit'](s, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_regime_stream_agrees_with_batch(spark):
    rng = random.Random(2)
    names = ["normal", "caution", "stress", "black_swan"]
    rows = [("m", dt.date(2024, 1, 1) + dt.timedelta(days=i), rng.choice(names)) for i in range(60)]
    df = spark.createDataFrame(rows, "market string, date date, raw_regime string")
    batch = {r.date: (r.regime, r.days_in_regime) for r in mk.regime_path(df).collect()}
    src = fresh_path(spark, "regimes")
    df.coalesce(1).write.parquet(src)
    s = rules.regime_stream(spark.readStream.schema(df.schema).parquet(src))
    out = rules.drain(s, fresh_path(spark, "out"), fresh_path(spark, "ck"))
    assert {r.date: (r.regime, r.days_in_regime) for r in out.collect()} == batch
    assert all(v == ("black_swan", 1) for d, v in batch.items() if dict((r[1], r[2]) for r in rows)[d] == "black_swan")


def test_regime_step():
    assert mk.next_regime("normal", None, 0) == ("normal", 1)
    assert mk.next_regime("stress", "normal", 3) == ("normal", 4)
    assert mk.next_regime("stress", "normal", 5) == ("stress", 1)
    assert mk.next_regime("black_swan", "normal", 1) == ("black_swan", 1)
    assert mk.next_regime("normal", "bull", 2) == ("normal", 1)


def test_severity_and_codes(spark):
    df = spark.createDataFrame([("stop_loss_hit", "exit 2330 at 985"), ("regime_change", "2024 now"), ("odd", "no code 12345")], "k string, m string")
    r = df.select(al.severity(F.col("k")).alias("s"), al.severity_level(F.col("k")).alias("l"), al.instrument_code(F.col("m"), F.col("k")).alias("c")).collect()
    assert [(x.s, x.l, x.c) for x in r] == [("critical", 3, "2330"), ("warning", 2, ""), ("info", 1, "")]


def test_digest_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m),) for h, m in ((7, 59), (8, 0), (16, 59), (17, 0))], "t timestamp_ntz")
    got = [r.d for r in df.select(al.next_digest(F.col("t")).alias("d")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 17), dt.datetime(2024, 1, 1, 17), dt.datetime(2024, 1, 2, 8)]


def vector(spark, **given):
    row = [given.get(d) for d in fx.DIMENSIONS]
    return spark.createDataFrame([row], ", ".join(f"{d} double" for d in fx.DIMENSIONS))


def test_neutral_and_extreme_vectors(spark):
    def score(df):
        x, z, raw = fo.with_z(df)
        return x.select(fx.ensemble(z, raw).alias("e")).first().e

    n = score(vector(spark))
    assert n.ensemble_score == 0.5 and n.dimensions_used == 0 and len(n.dimensions_missing) == 13
    hi, lo = score(vector(spark, **dict.fromkeys(fx.DIMENSIONS, 95.0))), score(vector(spark, **dict.fromkeys(fx.DIMENSIONS, 5.0)))
    assert hi.ensemble_score > 0.8 and lo.ensemble_score < 0.2 and hi.label == "strong_bullish"


def test_importance_ranks_the_only_signal(spark):
    x, z, _ = fo.with_z(vector(spark, technical_momentum=95.0, dividends=45.0))
    x = x.withColumn("w", fx.weighted_sum(z)).withColumn("p", fx.final_probability(fx.probability(F.col("w"), fx.TOTAL_WEIGHT)))
    top = x.select(fx.importance(F.col("w"), F.col("p"), z).alias("i")).first().i
    assert top[0].dimension == "technical_momentum" and top[0].contribution > 0 and [t["rank"] for t in top] == list(range(1, 14))


def test_equal_count_bins(spark):
    rows = [("m", i, i / 50, int(i >= 25)) for i in range(50)]
    b = fo.fit_bins(spark.createDataFrame(rows, "model string, id long, p double, y int"), "model", "p", "y", ["id"]).orderBy("bin").collect()
    assert len(b) == 10 and all(r.sample_count == 5 for r in b) and b[0].output == 0.0 and b[-1].output == 1.0 and b[-1].input_max == 1.0


def test_sentiment_and_weights(spark):
    df = spark.createDataFrame([("good good", 0), ("bad news", 1), ("good bad", 9), ("none", None)], "t string, age int")
    r = df.select(fun.article_sentiment(F.col("t"), ("good",), ("bad",)).alias("s"),
                  fun.recency_weight(F.date_sub(F.lit(dt.date(2024, 1, 20)), F.col("age")), F.lit(dt.date(2024, 1, 20))).alias("w")).collect()
    assert [x.s for x in r] == [0.5, -0.5, -0.5, 0.0] and [x.w for x in r] == [1.0, 1.0, 0.05, 0.05]


def test_false_signal_flags(spark):
    df = spark.range(1)
    s = {k: F.lit(float(v)) for k, v in dict(revenue=20, profitability=20, valuation=20, flow=10, momentum=75).items()}
    x = df.select(sc.false_signals(s, F.lit(50.0), F.lit(100.0), F.lit(30), F.lit(5)).alias("x")).first().x
    assert [f.type for f in x.flags] == ["contrarian", "fading_momentum", "unconfirmed_momentum", "revenue_price_divergence", "recent_ex_dividend"]
    assert x.is_contradictory and x.high_severity_count == 3


def test_signal_strength_rounds_halves_as_decimals(spark):
    from decimal import ROUND_HALF_UP, Decimal
    from itertools import product

    names = ("revenue", "profitability", "valuation", "flow", "momentum")
    rows = [(*map(float, s), t / 10) for s in product((20, 90), (0, 75, 100), (12.5, 62.5, 100), (30, 100), (45, 60)) for t in (423, 517, 638, 661)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", total double")
    got = df.select("*", sc.signal_strength({n: F.col(n) for n in names}, F.col("total")).alias("x")).collect()
    for r in got:
        v = [Decimal(str(r[n])) for n in names]
        mean = sum(v) / 5
        al_ = max(Decimal(0), 1 - sum((x - mean) ** 2 for x in v) / 5 / 2500)
        want = Decimal(str(r["total"])) * Decimal("0.6") + 25 * al_ + 3 * sum(x >= 40 for x in v)
        assert Decimal(str(r["x"]["strength"])) == want.quantize(Decimal("0.1"), ROUND_HALF_UP), r
        assert Decimal(str(r["x"]["alignment"])) == al_.quantize(Decimal("0.001"), ROUND_HALF_UP), r


def test_importance_states_its_formula_once(spark):
    # rounding and clamping repeat their argument, so a formula that nests them grows threefold with each
    z = {d: F.col(f"z_{d}") for d in fx.DIMENSIONS}
    x = spark.range(1).select(F.rand().alias("w"), F.rand().alias("p"), *[F.rand().alias(f"z_{d}") for d in fx.DIMENSIONS])
    plan = x.select(fx.importance(F.col("w"), F.col("p"), z).alias("i"))._jdf.queryExecution().analyzed().expressions().mkString("")
    assert plan.upper().count("EXP(") == 1
