import collections
import datetime as dt
import random
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators import market as mk


def test_spans_make_up_the_days(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 42)] + [(0, 1 << 14), (5, 3000), (4095, 4097)]
    rows = mk.blocks(spark.createDataFrame([(*p, *p) for p in pairs], "x int, y int, a int, b int"), "a", "b").collect()
    found = collections.defaultdict(list)
    for r in rows:
        found[r["x"], r["y"]].append((r["level"], r["index"]))
    for a, b in pairs:
        own = found[a, b]
        assert sorted(d for k, i in own for d in range(i << k, (i + 1) << k)) == list(range(a, b))
        assert len(own) <= 2 * (b - a).bit_length() and (b - a > 1 or len(own) == 1)


def test_leaders_of_every_day(spark):
    """Gaps, late listings, a last bar long before the end, ties in volume."""
    r, last = random.Random(6), 90
    states = []
    for i in range(40):
        at = sorted(r.sample(range(last + 1), r.choice([1, 3, 30, 80])))
        for a, b in zip(at, [*at[1:], last + 1], strict=True):
            states.append((i, a, b, float(r.randrange(12))))
    state = spark.createDataFrame(states, "instrument long, from_t int, until_t int, vol20 double").withColumn("date", F.lit(None).cast("date"))
    days = spark.createDataFrame([(t, t, last) for t in range(last + 1)], "d int, t int, last_t int").select(F.date_add(F.lit("2024-01-01"), F.col("d")).alias("date"), "t", "last_t")
    got = mk.leaders(state, days, 5).select("date", "instrument", "vol20").join(days, "date")
    found = sorted((x["t"], -x["vol20"], x["instrument"]) for x in got.collect())
    want = sorted(x for t in range(last + 1) for x in sorted((t, -v, i) for i, a, b, v in states if a <= t < b)[:5])
    assert found == want
    assert mk.leaders(state.limit(0), days, 5).count() == 0


def test_moving_averages_of_all_periods(spark):
    """Sums of sums give what the sliding frame gives: short series, nulls, a constant series, odd periods."""
    r, rows = random.Random(8), []
    for i, n in enumerate((1, 9, 10, 60, 400)):
        rows += [(i, d, None if r.random() < 0.05 else (7.25 if i == 3 else r.uniform(10, 90))) for d in range(n)]
    rows += [(9, d, None) for d in range(30)]
    bars = spark.createDataFrame(rows, "instrument long, date int, adj_close double")
    for periods in ((5, 10, 20, 50, 150, 300), (50, 150, 300), (7, 20), (3, 37)):
        got = ind.with_sma(bars, periods).withColumns({f"want{p}": ind.sma("adj_close", p) for p in periods}).collect()
        for x in got:
            for p in periods:
                assert (x[f"sma{p}"] is None) == (x[f"want{p}"] is None) and (x[f"sma{p}"] is None or abs(x[f"sma{p}"] - x[f"want{p}"]) < 1e-9)
        assert sum(x[f"sma{periods[0]}"] is not None for x in got) > 300


def test_a_close_at_its_mean_is_not_above_it(spark):
    rng, found = random.Random(9), []
    while len(found) < 5:
        cents = [rng.randrange(200_000, 400_000) for _ in range(18)]
        last = rng.randrange(290_000, 310_000)
        closes = [x / 10_000 for x in [*cents, 19 * last - sum(cents), last]]
        if 0 < closes[-2] < 100 and closes[-1] > reduce(add, closes) / 20:
            found.append(closes)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), c) for k, closes in enumerate(found) for i, c in enumerate(closes)]
    out = mk.breadth(spark.createDataFrame(rows, "instrument long, date date, adj_close double")).orderBy("date").collect()[-1]
    assert (out["above"], out["total"]) == (0, 5)


def test_bars_are_dealt_over_partitions_that_grow_with_the_ticks(spark, monkeypatch):
    from tickloom.operators import market as mk
    from tickloom.sources import driver_tables as tables

    t = tables.Tables(spark, "/root/testdata/sf0.001")
    few = t.parts
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 10)
    many = tables.Tables(spark, "/root/testdata/sf0.001")
    assert many.parts > few and many.bars.rdd.getNumPartitions() == many.series.rdd.getNumPartitions() == many.adj.rdd.getNumPartitions() == many.parts
    state = lambda x: mk.market_state(x.panel, x.action_days, 15, parts=x.parts)
    assert mk.instrument_state(many.panel, many.action_days, 15, parts=many.parts).rdd.getNumPartitions() == many.parts
    assert sorted(map(tuple, state(many).select("date", "leaders", "breadth", "global_risk").collect())) == sorted(map(tuple, mk.market_state(t.panel, t.action_days, 15).select("date", "leaders", "breadth", "global_risk").collect()))
