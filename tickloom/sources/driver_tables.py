"""Panel-shaped views over the test tables (definitions in FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.typing import dbl, rnd
from tickloom.operators import actions as act
from tickloom.operators import calendar as cal
from tickloom.sources.store import shared as kept_table
from tickloom.sources.store import stored_bytes

#: bytes of the stored ticks whose bars one task holds
TASK_BYTES = 4 << 20

# The holiday feed of the test panel (first day, last day, name, description, flag, file).
HOLIDAY_RULES = (
    ("0101", "0101", "New Year", "", "N", 1),
    ("0203", "0210", "Spring break", "", "N", 1),
    ("0228", "0228", "Memorial day", "", "N", 1),
    ("0404", "0405", "Spring festival", "", "N", 1),
    ("0501", "0501", "Labour day", "", None, 1),
    ("0606", "0606", "Storm", "無交易", None, 1),
    ("0212", "0212", "First session", "開始交易日", None, 1),
    ("1010", "1011", "National day", "", "N", 1),
    ("1010", "1012", "Second list", "", "N", 2),
    ("1224", "1224", "Eve", "half day", "Y", 1),
    ("0117", "0118", "補行上班", "makeup", "Y", 1),
)


class Tables:
    """Lazy views; nothing is computed until a query uses one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def shared(self, name: str, tables: tuple[str, ...], build) -> DataFrame:
        return kept_table(self.spark, name, self.root, tuple(f"{self.root}/{t}.parquet" for t in tables), build)

    @cached_property
    def parts(self) -> int:
        """Partitions that bars are dealt over: as many as the ticks need, so that a task's share does not grow with them."""
        return max(self.spark.sparkContext.defaultParallelism, -(-stored_bytes(self.spark, f"{self.root}/lineitem.parquet") // TASK_BYTES))

    def deal(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows of a key in one of ``parts`` partitions, which stay apart where small ones would be merged."""
        return df.repartition(self.parts, *keys)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("instrument"),
            F.col("l_shipdate").cast("date").alias("date"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_discount", "l_tax",
            # the irrational scale keeps rounded results free of ties at the last digit
            ((dbl(100) * (dbl(1) + dbl(0.2) * (F.col("l_discount") - F.col("l_tax"))) + F.col("l_extendedprice") / dbl(1e5)) / F.sqrt(dbl(13))).alias("price"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        """One bar per (instrument, date); open and close come from ordered aggregates."""
        # ticks of a day by order, line and part; equal ones by price
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price")
        # few bars have several ticks, so ticks are dealt before they are aggregated: narrower than partial results, and sorted in small tasks
        ticks = self.deal(self.ticks.select("instrument", "date", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "price"), "instrument", "date")
        return ticks.groupBy("instrument", "date").agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            (F.sum("l_quantity") * 1e4).alias("volume"),
            F.count("*").alias("trades"),
        )

    @cached_property
    def days(self) -> DataFrame:
        return self.ticks.select("date").distinct()

    @cached_property
    def raw_holidays(self) -> DataFrame:
        rules = F.array(*[
            F.struct(
                F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(name).alias("name"), F.lit(desc).alias("description"),
                F.lit(flag).cast("string").alias("is_trading"), F.lit(no).alias("file_no"),
            )
            for lo, hi, name, desc, flag, no in HOLIDAY_RULES
        ])
        md = F.date_format("date", "MMdd")
        return (
            self.days.withColumn("r", F.explode(F.filter(rules, lambda x: md.between(x["lo"], x["hi"]))))
            .select(
                F.concat(F.lpad((F.year("date") - 1911).cast("string"), 3, "0"), md).alias("era_date"),
                "r.name", "r.description", "r.is_trading", "r.file_no",
            )
        )

    @cached_property
    def holidays(self) -> DataFrame:
        return cal.classify_holidays(self.raw_holidays)

    @cached_property
    def bounds(self) -> DataFrame:
        return self.ticks.agg(F.min("date").alias("first"), F.max("date").alias("last"))

    @cached_property
    def calendar(self) -> DataFrame:
        return cal.build_calendar(self.bounds, self.holidays)

    @cached_property
    def actions_all(self) -> DataFrame:
        return self.ticks.where("l_linenumber = 7 and l_returnflag = 'R' and l_discount >= 0.09D").select(
            "instrument",
            F.col("date").alias("ex_date"),
            rnd(dbl(1) + dbl(10) * F.col("l_tax"), 4).alias("cash_div"),
            rnd(dbl(5) * F.col("l_tax"), 4).alias("stock_div"),
            F.when(F.col("l_orderkey") % 2 == 0, "official").otherwise("declaration").alias("source"),
            F.col("l_orderkey").alias("seq"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        a = self.actions_all
        return act.merge_actions(a.where("source = 'official'"), a.where("source = 'declaration'"))

    @cached_property
    def action_days(self) -> DataFrame:
        return self.shared("action-days", ("lineitem",), lambda: act.one_action_per_day(self.actions))

    @cached_property
    def adj(self) -> DataFrame:
        return act.backward_adjust(self.bars, self.action_days, parts=self.parts)

    @cached_property
    def ranked(self) -> DataFrame:
        """Adjusted bars with ordinals from both ends."""
        w = Window.partitionBy("instrument")
        return (
            self.adj.withColumn("rn", F.row_number().over(w.orderBy(F.desc("date"))))
            .withColumn("n_bars", F.count("*").over(w))
            .withColumn("ord", F.col("n_bars") - F.col("rn") + 1)
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Ranked adjusted bars as the session's stored table, for plans that read the panel in several branches."""
        return self.shared("panel", ("lineitem",), lambda: self.ranked)

    @cached_property
    def series(self) -> DataFrame:
        """The panel dealt by instrument, for plans with windows per instrument."""
        return self.deal(self.panel, "instrument")

    @cached_property
    def trading_calendar(self) -> DataFrame:
        return self.shared("calendar", ("lineitem",), lambda: self.calendar)

    @cached_property
    def sectors(self) -> DataFrame:
        s, n, r = self.read("supplier"), self.read("nation"), self.read("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("instrument"), F.col("n_nationkey").alias("industry"), F.col("r_name").alias("sector"))
        )

    @cached_property
    def company(self) -> DataFrame:
        listed = self.ticks.groupBy("instrument").agg(F.min("date").alias("list_date"))
        return self.read("supplier").select(
            F.col("s_suppkey").alias("instrument"),
            F.col("s_name").alias("name"),
            ((F.col("s_acctbal") + 2000.0) * 1e6).alias("paid_in_capital"),
        ).join(listed, "instrument")

    @cached_property
    def valuation(self) -> DataFrame:
        return self.shared("valuation", ("lineitem", "part"), self._valuation)

    def _valuation(self) -> DataFrame:
        li = self.read("lineitem").select("l_suppkey", "l_partkey")
        p = self.read("part").select("p_partkey", "p_size", "p_retailprice")
        # lines are counted per (supplier, part) first, so a hot part joins once per supplier
        pairs = li.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
        return (
            pairs.join(p, pairs.l_partkey == p.p_partkey)
            .groupBy(F.col("l_suppkey").alias("instrument"))
            .agg(
                (F.sum(F.col("p_size") * F.col("n")) / F.sum("n")).alias("pe"),
                (F.sum(F.col("p_retailprice") * F.col("n")) / F.sum("n") / 300.0).alias("pb"),
            )
        )

    @cached_property
    def monthly_revenue(self) -> DataFrame:
        return self.shared("monthly-revenue", ("lineitem", "orders"), self._monthly_revenue)

    def _monthly_revenue(self) -> DataFrame:
        li = self.read("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("amount"))
        o = self.read("orders").select("o_orderkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
        return (
            li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy(F.col("l_suppkey").alias("instrument"), "month")
            .agg(rnd(F.sum("amount"), 2).alias("revenue"))
        )

    @cached_property
    def revenue(self) -> DataFrame:
        w = Window.partitionBy("instrument").orderBy("month")

        def growth(k: int):
            prev, at = F.lag("revenue", k).over(w), F.lag("month", k).over(w)
            return F.when((at == F.add_months("month", -k)) & (prev > 0), (F.col("revenue") / prev - 1.0) * 100.0)

        return self.monthly_revenue.withColumn("rev_yoy", growth(12)).withColumn("rev_mom", growth(1))

    # --- screening inputs -------------------------------------------------

    @cached_property
    def facts(self) -> DataFrame:
        return self.shared("facts", ("lineitem",), self._facts)

    def _facts(self) -> DataFrame:
        """What the screen takes from the lines of an instrument, in one pass; flow and margin are null where not reported."""
        k, q, day = F.col("l_suppkey"), F.col("l_quantity"), F.col("l_shipdate").cast("date")
        signed = lambda cond: F.when(k % 3 != 0, F.sum(F.when(F.expr(cond), q).otherwise(-q)))
        part = lambda f: F.when(k % 2 == 0, F.sum(F.when(F.col("l_returnflag") == f, q).otherwise(0.0)) * 1000.0)
        return self.read("lineitem").groupBy("l_suppkey").agg(
            F.min(day).alias("list_date"),
            F.max(F.when(F.expr("l_linenumber = 1 and l_returnflag = 'A' and l_quantity < 3"), F.col("l_extendedprice") * 1000.0)).alias("max_pledged"),
            F.max(F.when(F.expr("l_linenumber = 2 and l_returnflag = 'N' and l_quantity <= 2"), day)).alias("last_penalty"),
            signed("l_returnflag = 'A' or l_linenumber = 1").alias("foreign_net"), signed("l_linestatus = 'O'").alias("trust_net"), signed("l_linenumber % 2 = 0").alias("total_net"),
            part("A").alias("margin_buy"), part("R").alias("short_sell"),
        ).withColumnRenamed("l_suppkey", "instrument")

    @cached_property
    def pledges(self) -> DataFrame:
        li = self.read("lineitem").where("l_linenumber = 1 and l_returnflag = 'A' and l_quantity < 3")
        return li.select(F.col("l_suppkey").alias("instrument"), (F.col("l_extendedprice") * 1000.0).alias("pledged"))

    @cached_property
    def penalties(self) -> DataFrame:
        li = self.read("lineitem").where("l_linenumber = 2 and l_returnflag = 'N' and l_quantity <= 2")
        return li.select(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("penalty_date"))

    @cached_property
    def flow(self) -> DataFrame:
        return self.facts.select("instrument", "foreign_net", "trust_net", "total_net")

    @cached_property
    def margin(self) -> DataFrame:
        return self.facts.select("instrument", "margin_buy", "short_sell", (F.col("short_sell") * (F.col("instrument") % 5) / 10.0).alias("short_balance"))

    @cached_property
    def revenue_latest(self) -> DataFrame:
        return (
            self.revenue.groupBy("instrument")
            .agg(F.max_by(F.struct("rev_yoy", "rev_mom"), "month").alias("r")).select("instrument", "r.*")
        )

    @cached_property
    def valuation_latest(self) -> DataFrame:
        given = lambda c: F.when(F.col("instrument") % 29 != 11, c)
        return self.valuation.select("instrument", given((F.col("pe") - 25.5) * 10.0 + 20.0).alias("pe"), given(F.col("pb") / 2.0).alias("pb"))

    @cached_property
    def screen_rows(self) -> DataFrame:
        """One row per instrument with everything the screen needs."""
        from tickloom.operators import indicators as ind

        k = F.col("instrument")
        firm = self.read("supplier").select(
            F.col("s_suppkey").alias("instrument"), F.col("s_name").alias("name"),
            F.when(F.col("s_suppkey") % 31 != 4, (F.col("s_acctbal") + 2000.0) * 1e6).alias("paid_in_capital"))
        last_ex = self.action_days.groupBy("instrument").agg(F.max("ex_date").alias("last_ex"))
        rows = ind.latest_features(self.series)
        for part in (firm, self.facts, self.revenue_latest.withColumn("has_rev", F.lit(True)), self.valuation_latest, last_ex):
            rows = rows.join(part, "instrument", "left")
        given = lambda c: F.col(c).isNotNull()
        rows = rows.withColumns({
            "list_date": F.when(given("paid_in_capital"), F.col("list_date")), "short_balance": F.col("short_sell") * (k % 5) / 10.0,
            "has_company": given("paid_in_capital"), "has_val": given("pe"), "has_flow": given("total_net"), "has_margin": given("margin_buy")})
        code = F.lpad((F.col("instrument") * 83 % 10000).cast("string"), 4, "0")
        reason = F.when(k % 17 == 3, "sanctioned").when(k % 19 == 5, "trading_halt").when(k % 37 == 2, "margin_suspended")
        return rows.withColumn("has_rev", F.coalesce("has_rev", F.lit(False))).withColumn("code", code).withColumn("list_reason", reason)
