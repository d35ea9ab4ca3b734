"""Deep-dive, text and earnings queries (section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.typing import dbl, rnd
from tickloom.operators import fundamentals as fun
from tickloom.plans.registry import query
from tickloom.plans.screen_plans import AS_OF, screened
from tickloom.sources.sql_views import VIEWS

# Keyword lists for the invented prose of the test tables.
POS = ("blest", "ouand", "ering", "heon", "tioned")
NEG = ("erst", "ndst", "ntly", "eaes")
DOC_DAY = "2024-03-01"


def _any(words, col="text"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _hits(words, col="text"):
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words) + ")"


VIEWS["v_net_profit"] = """
SELECT instrument, (revenue - 300000.0e0) * 10.0e0 AS net_profit FROM v_revenue QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY month DESC) = 1"""
VIEWS["v_i1"] = """
SELECT instrument, 'ok' AS status, round(least(100.0e0, greatest(0.0e0, 50.0e0 + CASE WHEN cash_div > 0 THEN least(25.0e0, cash_div * 1.5e0 + 10.0e0) ELSE -10.0e0 END
  + CASE WHEN stock_div > 0 THEN least(15.0e0, stock_div * 3.0e0) ELSE 0.0e0 END
  + CASE WHEN net_profit > 0 THEN least(25.0e0, log10(greatest(net_profit, 1.0e0)) * 3.0e0 + 10.0e0) ELSE -20.0e0 END + least(10.0e0, n * 3.0e0))), 2) AS score
FROM (SELECT a.*, count(*) OVER (PARTITION BY a.instrument) AS n, row_number() OVER (PARTITION BY a.instrument ORDER BY ex_date DESC, seq DESC, cash_div DESC) AS rn FROM v_actions a)
LEFT JOIN v_net_profit USING (instrument) WHERE rn = 1"""
VIEWS["v_i2"] = f"""
SELECT instrument, 'ok' AS status, round(least(100.0e0, greatest(0.0e0, 50.0e0 - count(*) FILTER (WHERE n) * 8.0e0 + count(*) FILTER (WHERE p) * 3.5e0)), 2) AS score
FROM (SELECT doc_id % 100 AS instrument, {_any(NEG)} AS n, {_any(POS)} AS p, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) AS r FROM documents) WHERE r <= 10 GROUP BY 1"""
VIEWS["v_i3"] = """
SELECT instrument, 'ok' AS status, round(least(100.0e0, greatest(0.0e0, 50.0e0 + least(20.0e0, n * 4.0e0) - CASE WHEN n < 2 THEN 10 ELSE 0 END)), 2) AS score FROM (
  SELECT l_suppkey AS instrument, count(DISTINCT o_orderpriority) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 AND l_linenumber = 7 GROUP BY 1)"""
VIEWS["v_i4"] = """
SELECT instrument, CASE WHEN s > 0 THEN round(x, 2) ELSE 100.0e0 END AS score, CASE WHEN NOT s > 0 THEN 'no_pledge' WHEN x < 40 THEN 'high_pledge' WHEN x < 70 THEN 'moderate_pledge' ELSE 'low_pledge' END AS status
FROM (SELECT instrument, sum(pledged) AS s, greatest(15.0e0, least(80.0e0, 90.0e0 - (log10(sum(pledged)) - 6.0e0) * 12.0e0)) AS x FROM v_pledge GROUP BY 1)"""
VIEWS["v_i5"] = """
SELECT instrument, round(CASE WHEN r > 0 THEN greatest(5.0e0, least(60.0e0, 100.0e0 - r * 25.0e0)) ELSE greatest(80.0e0, least(100.0e0, 100.0e0 - n * 5.0e0)) END, 2) AS score,
  CASE WHEN r >= 3 THEN 'multiple_recent_penalties' WHEN r > 0 THEN 'recent_penalty' ELSE 'old_penalties_only' END AS status
FROM (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE DATE '2001-11-05' - penalty_date < 365) AS r FROM v_penalty GROUP BY 1)"""


def dividends(t):
    profit = t.monthly_revenue.groupBy("instrument").agg(((F.max_by("revenue", "month") - 300000.0) * 10.0).alias("net_profit"))
    return fun.dividend_check(t.actions.join(profit, "instrument", "left"))


def documents(t):
    return t.read("documents").withColumn("instrument", F.col("doc_id") % 100)


def announcements(t):
    return fun.announcement_check(documents(t).select("instrument", "doc_id", "text"), [F.col("doc_id")], negative=NEG, positive=POS)


def holders(t):
    li = t.read("lineitem").where("l_quantity >= 49 and l_linenumber = 7").select("l_orderkey", F.col("l_suppkey").alias("instrument"))
    o = t.read("orders").select("o_orderkey", F.col("o_orderpriority").alias("holder"))
    return fun.shareholder_check(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")))


@query("I1_dividend_check", "SELECT * FROM v_i1")
def _(t):
    return dividends(t)


@query("I2_announcement_check", "SELECT * FROM v_i2")
def _(t):
    return announcements(t)


@query("I3_shareholder_check", "SELECT * FROM v_i3")
def _(t):
    return holders(t)


@query("I4_pledge_check", "SELECT * FROM v_i4")
def _(t):
    return fun.pledge_check(t.pledges)


@query("I5_penalty_check", "SELECT * FROM v_i5")
def _(t):
    return fun.penalty_check(t.penalties, AS_OF)


VIEWS["v_articles"] = f"""
SELECT doc_id, doc_id % 100 AS instrument, split_part(text, chr(10), 1) AS title, text, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '{DOC_DAY}' - CAST(doc_id % 9 AS INT) END AS published FROM documents"""
VIEWS["v_article_s"] = f"""
SELECT *, CASE WHEN pos > neg * 1.3e0 THEN 0.5e0 WHEN neg * 1.3e0 > pos THEN -0.5e0 ELSE 0.0e0 END AS sentiment,
  CASE WHEN published IS NULL THEN 0.05e0 WHEN DATE '{DOC_DAY}' - published <= 1 THEN 1.0e0 WHEN DATE '{DOC_DAY}' - published <= 2 THEN 0.85e0 WHEN DATE '{DOC_DAY}' - published <= 3 THEN 0.7e0
   WHEN DATE '{DOC_DAY}' - published <= 4 THEN 0.55e0 WHEN DATE '{DOC_DAY}' - published <= 5 THEN 0.4e0 WHEN DATE '{DOC_DAY}' - published <= 6 THEN 0.25e0 WHEN DATE '{DOC_DAY}' - published <= 7 THEN 0.1e0 ELSE 0.05e0 END AS weight
FROM (SELECT *, {_hits(POS)} AS pos, {_hits(NEG)} AS neg FROM v_articles)"""
VIEWS["v_article_one"] = """
SELECT * FROM v_article_s QUALIFY row_number() OVER (PARTITION BY instrument, lower(trim(title)) ORDER BY doc_id) = 1"""


def _sent_sql(src, keys):
    return f"""SELECT {keys}, articles, positive, negative, neutral, weighted_sentiment, score, CASE WHEN score >= 75 THEN 'positive' WHEN score >= 50 THEN 'neutral' ELSE 'negative' END AS status
FROM (SELECT {keys}, count(*) AS articles, count(*) FILTER (WHERE sentiment > 0) AS positive, count(*) FILTER (WHERE sentiment < 0) AS negative, count(*) FILTER (WHERE sentiment = 0) AS neutral,
  round(sum(sentiment * weight) / sum(weight), 3) AS weighted_sentiment, round(least(100.0e0, greatest(0.0e0, 60.0e0 + sum(sentiment * weight) / sum(weight) * 60.0e0)), 2) AS score FROM {src} GROUP BY {keys})"""


def articles(t):
    d = F.date_sub(F.lit(DOC_DAY).cast("date"), (F.col("doc_id") % 9).cast("int"))
    return documents(t).select(
        "doc_id", "instrument", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.when(F.col("doc_id") % 17 != 0, d).alias("published"),
        fun.article_sentiment(F.col("text"), POS, NEG).alias("sentiment"),
    ).withColumn("weight", fun.recency_weight(F.col("published"), F.lit(DOC_DAY).cast("date")))


def articles_once(t):
    return fun.dedupe_articles(articles(t), ["instrument"], "title", ["doc_id"])


@query("I9_article_sentiment", "SELECT doc_id, sentiment FROM v_article_s")
def _(t):
    return articles(t).select("doc_id", "sentiment")


@query("I10_recency_weight", "SELECT doc_id, published, weight FROM v_article_s")
def _(t):
    return articles(t).select("doc_id", "published", "weight")


@query("I11_sentiment_by_source", _sent_sql("(SELECT s.*, d.source FROM v_article_s s JOIN documents d ON d.doc_id = s.doc_id)", "source"))
def _(t):
    d = F.date_sub(F.lit(DOC_DAY).cast("date"), (F.col("doc_id") % 9).cast("int"))
    a = documents(t).select("source", fun.article_sentiment(F.col("text"), POS, NEG).alias("sentiment"),
                            fun.recency_weight(F.when(F.col("doc_id") % 17 != 0, d), F.lit(DOC_DAY).cast("date")).alias("weight"))
    return fun.sentiment_by(a, ["source"])


@query("I12_article_dedupe", "SELECT instrument, doc_id, title FROM v_article_one")
def _(t):
    return articles_once(t).select("instrument", "doc_id", "title").orderBy(F.desc("doc_id"))


VIEWS["v_news"] = _sent_sql("v_article_one", "instrument")


@query("I13_batch_sentiment", "SELECT * FROM v_news")
def _(t):
    return fun.sentiment_by(articles_once(t), ["instrument"])


PAGE_DATES = r"<time[^>]*>\s*(\d{4}-\d{2}-\d{2})"
PAGE_TITLES = "(?is)<(?:h1|title|a href)[^>]*>(.*?)</(?:h1|title|a)>"


@query("I14_headline_extraction", f"""
SELECT page_id, pos, title, '2024-03-01' AS date FROM (
  SELECT page_id, CAST(i - 1 AS INT) AS pos, trim(regexp_replace(titles[i], '<[^>]+>', '', 'g')) AS title FROM (
    SELECT page_id, titles, unnest(generate_series(1, len(titles))) AS i FROM (SELECT page_id, regexp_extract_all(html, '{PAGE_TITLES}', 1) AS titles FROM pages)))
WHERE length(title) >= 6""")
def _(t):
    p = t.read("pages").select("page_id", "html")
    return fun.extract_headlines(p, PAGE_TITLES, PAGE_DATES, default_date=DOC_DAY, must_match=None).select("page_id", "pos", "title", "date")


VIEWS["v_q0"] = """
SELECT instrument, year(month) AS year, quarter(month) AS quarter, round(sum(revenue), 2) AS revenue, round(sum(revenue) - 900000.0e0, 2) AS profit, (sum(revenue) - 900000.0e0) / 100000.0e0 AS eps
FROM v_revenue GROUP BY 1, 2, 3"""
VIEWS["v_q"] = """
SELECT q.*, p.revenue AS prior_revenue, p.profit AS prior_profit, p.eps AS prior_eps, y.revenue AS yoy_revenue, y.profit AS yoy_profit, y.eps AS yoy_eps
FROM v_q0 q LEFT JOIN v_q0 p ON p.instrument = q.instrument AND p.year * 4 + p.quarter = q.year * 4 + q.quarter - 1
LEFT JOIN v_q0 y ON y.instrument = q.instrument AND y.year = q.year - 1 AND y.quarter = q.quarter"""
VIEWS["v_growth"] = "SELECT *, " + ", ".join(
    f"CASE WHEN {o}_{m} > 0 THEN round(({m} - {o}_{m}) / {o}_{m} * 100, 2) END AS {m}_{n}_pct"
    for m in ("revenue", "profit", "eps") for o, n in (("yoy", "yoy"), ("prior", "qoq"))) + " FROM v_q"
VIEWS["v_surprise"] = """
SELECT *, CASE WHEN surprise_pct IS NULL THEN 'no_consensus' WHEN surprise_pct > 3 THEN 'beat' WHEN surprise_pct < -3 THEN 'miss' ELSE 'in-line' END AS grade
FROM (SELECT *, CASE WHEN consensus > 0 THEN round((eps - consensus) / consensus * 100, 2) END AS surprise_pct FROM (
   SELECT *, CASE WHEN instrument % 11 <> 0 THEN eps * (1.0e0 + ((instrument * 7 + quarter) % 31 - 15) / 100.0e0) END AS consensus FROM v_growth))"""
VIEWS["v_earn"] = """
SELECT *, least(0.15e0, greatest(-0.15e0, round(
    CASE WHEN eps_yoy_pct > 50 THEN 0.05e0 WHEN eps_yoy_pct > 20 THEN 0.04e0 WHEN eps_yoy_pct > 10 THEN 0.03e0 WHEN eps_yoy_pct > 0 THEN 0.01e0 WHEN eps_yoy_pct < -20 THEN -0.05e0 WHEN eps_yoy_pct < -10 THEN -0.03e0 WHEN eps_yoy_pct < 0 THEN -0.01e0 ELSE 0.0e0 END
  + CASE WHEN eps_yoy_pct > 0 AND eps_qoq_pct > 0 THEN 0.02e0 WHEN eps_yoy_pct > 0 AND eps_qoq_pct < 0 THEN -0.01e0 WHEN eps_yoy_pct < 0 AND eps_qoq_pct < 0 THEN -0.02e0 ELSE 0.0e0 END
  + CASE grade WHEN 'beat' THEN 0.04e0 WHEN 'miss' THEN -0.05e0 WHEN 'in-line' THEN 0.01e0 ELSE 0.0e0 END
  + CASE WHEN instrument % 5 >= 3 THEN 0.03e0 WHEN instrument % 5 >= 2 THEN 0.01e0 ELSE 0.0e0 END
  + CASE quarter WHEN 4 THEN 0.02e0 WHEN 1 THEN 0.01e0 WHEN 2 THEN -0.01e0 ELSE 0.0e0 END, 4))) AS signal,
  round(least(100.0e0, greatest(0.0e0, CASE WHEN revenue_yoy_pct > 0 AND (eps_yoy_pct IS NULL OR eps_yoy_pct > 0) THEN least(35.0e0, b + 2) WHEN revenue_yoy_pct < 0 AND (eps_yoy_pct IS NULL OR eps_yoy_pct < 0) THEN greatest(0.0e0, b - 3) ELSE b END
   + CASE WHEN eps_qoq_pct IS NULL THEN 10.0e0 WHEN eps_qoq_pct > 30 THEN 20 WHEN eps_qoq_pct > 15 THEN 16 WHEN eps_qoq_pct > 5 THEN 13 WHEN eps_qoq_pct > 0 THEN 11 WHEN eps_qoq_pct > -10 THEN 8 WHEN eps_qoq_pct > -20 THEN 4 ELSE 0 END
   + CASE grade WHEN 'beat' THEN CASE WHEN surprise_pct > 10 THEN 25.0e0 WHEN surprise_pct > 5 THEN 22 ELSE 18 END WHEN 'in-line' THEN 13 WHEN 'miss' THEN CASE WHEN surprise_pct < -10 THEN 0 WHEN surprise_pct < -5 THEN 4 ELSE 7 END ELSE 12.5e0 END
   + CASE WHEN eps_yoy_pct > 0 AND eps_qoq_pct > 0 THEN 20.0e0 WHEN eps_yoy_pct > 0 AND eps_qoq_pct < 0 THEN 8 WHEN eps_yoy_pct < 0 AND eps_qoq_pct > 0 THEN 12 WHEN eps_yoy_pct < 0 AND eps_qoq_pct < 0 THEN 0 ELSE 10 END)), 2) AS quality
FROM (SELECT *, CASE WHEN eps_yoy_pct IS NULL THEN 17.5e0 WHEN eps_yoy_pct > 50 THEN 35 WHEN eps_yoy_pct > 30 THEN 30 WHEN eps_yoy_pct > 15 THEN 25 WHEN eps_yoy_pct > 5 THEN 20 WHEN eps_yoy_pct > 0 THEN 18 WHEN eps_yoy_pct > -10 THEN 12 WHEN eps_yoy_pct > -20 THEN 7 ELSE 0 END AS b FROM v_surprise)"""
METRICS = ("revenue", "profit", "eps")


def quarters(t):
    q = t.monthly_revenue.groupBy("instrument", F.year("month").alias("year"), F.quarter("month").alias("quarter")).agg(F.sum("revenue").alias("r"))
    q = q.select("instrument", "year", "quarter", rnd("r", 2).alias("revenue"), rnd(F.col("r") - 900000.0, 2).alias("profit"), ((F.col("r") - 900000.0) / 100000.0).alias("eps"))
    return fun.with_quarters(q, METRICS)


def earnings(t):
    c = F.col
    g = fun.growth(quarters(t), METRICS)
    cons = F.when(c("instrument") % 11 != 0, c("eps") * (dbl(1) + ((c("instrument") * 7 + c("quarter")) % 31 - 15) / 100.0))
    s = g.withColumn("consensus", cons).withColumn("sp", fun.surprise(c("eps"), c("consensus"))).select("*", "sp.*").drop("sp")
    return s.withColumns({
        "signal": fun.earnings_signal(c("eps_yoy_pct"), c("eps_qoq_pct"), c("grade"), c("instrument") % 5, c("quarter")),
        "q": fun.earnings_quality(c("eps_yoy_pct"), c("revenue_yoy_pct"), c("eps_qoq_pct"), c("surprise_pct"), c("grade"))})


@query("I15_quarter_lookup", "SELECT instrument, year, quarter, revenue, prior_revenue, yoy_revenue, profit, prior_profit, yoy_profit FROM v_q")
def _(t):
    return quarters(t).select("instrument", F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"),
                              "revenue", "prior_revenue", "yoy_revenue", "profit", "prior_profit", "yoy_profit")


@query("I16_growth", "SELECT instrument, year, quarter, " + ", ".join(f"{m}_{n}_pct" for m in METRICS for n in ("yoy", "qoq")) + " FROM v_growth")
def _(t):
    return fun.growth(quarters(t), METRICS).select("instrument", "year", "quarter", *[f"{m}_{n}_pct" for m in METRICS for n in ("yoy", "qoq")])


@query("I17_estimate_surprise", "SELECT instrument, year, quarter, surprise_pct, grade FROM v_surprise")
def _(t):
    return earnings(t).select("instrument", "year", "quarter", "surprise_pct", "grade")


@query("I18_earnings_signal", "SELECT instrument, year, quarter, signal FROM v_earn")
def _(t):
    return earnings(t).select("instrument", "year", "quarter", "signal")


@query("I19_earnings_quality", """
SELECT instrument, year, quarter, quality AS score, CASE WHEN quality >= 75 THEN 'strong_growth' WHEN quality >= 55 THEN 'moderate_growth' WHEN quality >= 40 THEN 'flat' ELSE 'declining' END AS status FROM v_earn""")
def _(t):
    return earnings(t).select("instrument", "year", "quarter", "q.score", "q.status")


VIEWS["v_deep"] = """
SELECT *, 'x' AS tag, CASE WHEN flags <> '' THEN 0.0e0 ELSE round(f, 1) END AS stage2_score,
  CASE WHEN flags <> '' THEN 0.0e0 ELSE round(composite_score * 0.6e0 + f * 0.4e0 + xadj + greatest(-2.25e0, least(2.25e0, round(sig * 15.0e0, 1))), 1) END AS combined_score,
  CASE WHEN flags <> '' THEN 'disqualified' WHEN f >= 58 THEN 'pass' ELSE 'below_minimum' END AS outcome
FROM (SELECT *, concat_ws(',', CASE WHEN plg < 40 THEN 'pledge' END, CASE WHEN pen < 50 THEN 'penalties' END, CASE WHEN ann < 30 THEN 'announcements' END, CASE WHEN news < 35 THEN 'news_sentiment' END, CASE WHEN earn < 20 THEN 'earnings_growth' END) AS flags,
   div * 0.2e0 + ann * 0.16e0 + sh * 0.12e0 + plg * 0.16e0 + pen * 0.12e0 + news * 0.12e0 + earn * 0.12e0 AS f
 FROM (SELECT s.instrument, s.composite_score, s.bucket, coalesce(d.score, 25.0e0) AS div, coalesce(a.score, 50.0e0) AS ann, coalesce(h.score, 25.0e0) AS sh, coalesce(p.score, 100.0e0) AS plg, coalesce(q.score, 100.0e0) AS pen,
    coalesce(n.score, 60.0e0) AS news, coalesce(e.quality, 50.0e0) AS earn, coalesce(e.signal, 0.0e0) AS sig, (s.instrument % 7 - 3) * 1.0e0 AS xadj
   FROM v_screen s LEFT JOIN v_i1 d USING (instrument) LEFT JOIN v_i2 a USING (instrument) LEFT JOIN v_i3 h USING (instrument) LEFT JOIN v_i4 p USING (instrument) LEFT JOIN v_i5 q USING (instrument)
   LEFT JOIN v_news n USING (instrument) LEFT JOIN (SELECT * FROM v_earn QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY year DESC, quarter DESC) = 1) e USING (instrument)))"""


def latest_earnings(t):
    """One row per instrument, stored: the checks take it twice."""
    return t.shared("latest-earnings", ("lineitem", "orders"), lambda: earnings(t).groupBy("instrument").agg(
        F.max_by(F.struct("signal", "q"), F.struct("year", "quarter")).alias("e")).select(
        "instrument", "e.signal", F.col("e.q.score").alias("score"), F.col("e.q.status").alias("status")))


def checked(t):
    earn = latest_earnings(t)
    base = screened(t).select("instrument", F.col("composite_score").alias("stage1_score"), "bucket").withColumn(
        "cross_asset_adjustment", (F.col("instrument") % 7 - 3).cast("double"))
    base = base.join(earn.select("instrument", F.col("signal").alias("earnings_signal")), "instrument", "left").fillna(0.0, ["earnings_signal"])
    return fun.gather_checks(base, {
        "dividend": dividends(t), "announcements": announcements(t), "shareholders": holders(t), "pledge": fun.pledge_check(t.pledges),
        "penalties": fun.penalty_check(t.penalties, AS_OF), "news_sentiment": fun.sentiment_by(articles_once(t), ["instrument"]), "earnings_growth": earn})


def deep(t):
    return fun.deep_dive(checked(t), minimum=58.0)


@query("I6_red_flags", "SELECT instrument, flags AS red_flags FROM v_deep")
def _(t):
    return checked(t).select("instrument", F.concat_ws(",", fun.red_flags()).alias("red_flags"))


@query("I7_deep_dive", "SELECT instrument, stage2_score, combined_score, outcome FROM v_deep")
def _(t):
    return deep(t).select("instrument", "stage2_score", "combined_score", "outcome")


@query("I8_check_diagnostics", " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", count({c}) AS n, round(min({c}), 4) AS min_score, round(max({c}), 4) AS max_score, round(avg({c}), 4) AS mean_score, count(*) - count({c}) AS errors FROM v_deep"
    for n, c in (("dividend", "div"), ("announcements", "ann"), ("shareholders", "sh"), ("pledge", "plg"), ("penalties", "pen"), ("news_sentiment", "news"), ("earnings_growth", "earn"))))
def _(t):
    return fun.diagnostics(checked(t))
