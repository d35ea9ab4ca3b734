"""ANSI SQL of the derived views, used only to check query results.

Every view is a plain SELECT over the test tables or over other views.
``with_views`` puts the views a statement mentions in front of it as CTEs.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["v_ticks"] = """
SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey,
       l_quantity, l_returnflag, l_discount, l_tax,
       (100.0e0 * (1.0e0 + 0.2e0 * (l_discount - l_tax)) + l_extendedprice / 1.0e5) / sqrt(13.0e0) AS price
FROM lineitem"""

VIEWS["v_bars"] = """
SELECT instrument, date,
       first(price ORDER BY l_orderkey, l_linenumber, l_partkey, price) AS open,
       max(price) AS high, min(price) AS low,
       last(price ORDER BY l_orderkey, l_linenumber, l_partkey, price) AS close,
       sum(l_quantity) * 1.0e4 AS volume, count(*) AS trades
FROM v_ticks GROUP BY instrument, date"""

VIEWS["v_days"] = "SELECT DISTINCT date FROM v_ticks"

VIEWS["v_raw_hol"] = """
SELECT lpad(CAST(year(date) - 1911 AS VARCHAR), 3, '0') || strftime(date, '%m%d') AS era_date, x.name, x.description, x.is_trading, x.file_no
FROM (SELECT date, strftime(date, '%m%d') AS md FROM v_days) d
JOIN (
  SELECT '0101' AS lo, '0101' AS hi, 'New Year' AS name, '' AS description, 'N' AS is_trading, 1 AS file_no
  UNION ALL SELECT '0203', '0210', 'Spring break', '', 'N', 1
  UNION ALL SELECT '0228', '0228', 'Memorial day', '', 'N', 1
  UNION ALL SELECT '0404', '0405', 'Spring festival', '', 'N', 1
  UNION ALL SELECT '0501', '0501', 'Labour day', '', NULL, 1
  UNION ALL SELECT '0606', '0606', 'Storm', '無交易', NULL, 1
  UNION ALL SELECT '0212', '0212', 'First session', '開始交易日', NULL, 1
  UNION ALL SELECT '1010', '1011', 'National day', '', 'N', 1
  UNION ALL SELECT '1010', '1012', 'Second list', '', 'N', 2
  UNION ALL SELECT '1224', '1224', 'Eve', 'half day', 'Y', 1
  UNION ALL SELECT '0117', '0118', '補行上班', 'makeup', 'Y', 1
) x ON d.md BETWEEN x.lo AND x.hi"""

VIEWS["v_hol"] = """
SELECT date, name,
       (is_trading = 'N' OR (is_trading IS NULL AND (contains(txt, '無交易') OR NOT (contains(txt, '開始交易日') OR contains(txt, '最後交易日'))))) IS TRUE AS closed,
       (is_trading = 'Y' AND (contains(txt, '僅上午交易') OR contains(txt, 'half'))) IS TRUE AS partial,
       (contains(name, '補行上班') OR contains(description, '調整上班') OR contains(txt, 'makeup')) AS makeup
FROM (
  SELECT *, lower(name || ' ' || description) AS txt,
         CAST(strptime(CAST(CAST(substr(era_date, 1, 3) AS INT) + 1911 AS VARCHAR) || substr(era_date, 4, 4), '%Y%m%d') AS DATE) AS date,
         row_number() OVER (PARTITION BY era_date ORDER BY file_no, name) AS rn
  FROM v_raw_hol)
WHERE rn = 1"""

VIEWS["v_cal"] = """
SELECT c.*, sum(CASE WHEN is_trading THEN 1 ELSE 0 END) OVER (ORDER BY date) AS ordinal,
       max(CASE WHEN is_trading THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_trading,
       min(CASE WHEN is_trading THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_trading
FROM (
  SELECT d.date, h.name, coalesce(h.closed, false) AS closed, coalesce(h.partial, false) AS partial, coalesce(h.makeup, false) AS makeup,
         CASE WHEN coalesce(h.makeup, false) THEN true WHEN isodow(d.date) >= 6 THEN false ELSE NOT coalesce(h.closed, false) END AS is_trading
  FROM (SELECT CAST(unnest(generate_series(mn, mx, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) mn, max(date) mx FROM v_days)) d
  LEFT JOIN v_hol h ON h.date = d.date) c"""

VIEWS["v_cal_wide"] = VIEWS["v_cal"].replace(
    "(SELECT min(date) mn, max(date) mx FROM v_days)",
    """(SELECT min(date) mn, max(date) mx FROM (SELECT date FROM v_days UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders
      UNION ALL SELECT CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) FROM orders))""")

VIEWS["v_actions_all"] = """
SELECT instrument, date AS ex_date, round(1.0e0 + 10.0e0 * l_tax, 4) AS cash_div, round(5.0e0 * l_tax, 4) AS stock_div,
       CASE WHEN l_orderkey % 2 = 0 THEN 'official' ELSE 'declaration' END AS source, l_orderkey AS seq
FROM v_ticks WHERE l_linenumber = 7 AND l_returnflag = 'R' AND l_discount >= 0.09e0"""

VIEWS["v_actions"] = """
SELECT * FROM v_actions_all WHERE source = 'official'
UNION ALL
SELECT * FROM v_actions_all d WHERE source = 'declaration'
 AND NOT EXISTS (SELECT 1 FROM v_actions_all o WHERE o.source = 'official' AND o.instrument = d.instrument AND o.ex_date = d.ex_date)"""

VIEWS["v_action_day"] = """
SELECT instrument, ex_date,
       last(cash_div ORDER BY seq, cash_div, stock_div) AS cash_div, last(stock_div ORDER BY seq, cash_div, stock_div) AS stock_div
FROM v_actions GROUP BY instrument, ex_date"""

VIEWS["v_factors"] = """
SELECT b.*, a.cash_div, a.stock_div,
  CASE WHEN a.ex_date IS NOT NULL AND lag(close) OVER w > 0 THEN
    CASE WHEN cash_div > 0 AND (lag(close) OVER w - cash_div) / (1.0e0 + stock_div / 10.0e0) > 0
         THEN ((lag(close) OVER w - cash_div) / (1.0e0 + stock_div / 10.0e0)) / lag(close) OVER w
         WHEN cash_div > 0 THEN 1.0e0
         WHEN stock_div > 0 THEN 1.0e0 / (1.0e0 + stock_div / 10.0e0) ELSE 1.0e0 END
  ELSE 1.0e0 END AS factor
FROM v_bars b LEFT JOIN v_action_day a ON a.instrument = b.instrument AND a.ex_date = b.date
WINDOW w AS (PARTITION BY b.instrument ORDER BY b.date)"""

VIEWS["v_adj"] = """
SELECT instrument, date, open, high, low, close, volume, trades,
       CASE WHEN close > 0 THEN round(close * cum, 4) ELSE 0.0e0 END AS adj_close, round(volume / cum, 0) AS adj_volume, round(cum, 6) AS cumulative_factor,
       cash_div, stock_div
FROM (SELECT *, coalesce(product(factor) OVER (PARTITION BY instrument ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0e0) AS cum FROM v_factors)"""

VIEWS["v_rank"] = """
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS rn,
       row_number() OVER (PARTITION BY instrument ORDER BY date) AS ord,
       count(*) OVER (PARTITION BY instrument) AS n_bars
FROM v_adj"""

VIEWS["v_sectors"] = """
SELECT s_suppkey AS instrument, n_nationkey AS industry, r_name AS sector
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["v_company"] = """
SELECT s_suppkey AS instrument, s_name AS name, (s_acctbal + 2000.0e0) * 1.0e6 AS paid_in_capital, list_date
FROM supplier JOIN (SELECT instrument, min(date) AS list_date FROM v_days_inst GROUP BY instrument) x ON x.instrument = s_suppkey"""
VIEWS["v_days_inst"] = "SELECT instrument, date FROM v_ticks"

VIEWS["v_valuation"] = """
SELECT l_suppkey AS instrument, avg(p_size) AS pe, avg(p_retailprice) / 300.0e0 AS pb
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey"""

VIEWS["v_revenue"] = """
SELECT instrument, month, revenue,
       CASE WHEN lag(month, 12) OVER w = month - INTERVAL 12 MONTH AND lag(revenue, 12) OVER w > 0 THEN (revenue / lag(revenue, 12) OVER w - 1.0e0) * 100.0e0 END AS rev_yoy,
       CASE WHEN lag(month) OVER w = month - INTERVAL 1 MONTH AND lag(revenue) OVER w > 0 THEN (revenue / lag(revenue) OVER w - 1.0e0) * 100.0e0 END AS rev_mom
FROM (SELECT l_suppkey AS instrument, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(l_extendedprice), 2) AS revenue
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
WINDOW w AS (PARTITION BY instrument ORDER BY month)"""

_WORD = re.compile(r"\bv_[a-z0-9_]+\b")


def _positive_zero(sql: str) -> str:
    """Add 0.0 to every round(...) so that a rounded negative never prints as -0.0."""
    out, i = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < i:
            continue
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(sql[i:m.start()] + "(round(" + _positive_zero(sql[m.end():j - 1]) + ") + 0.0e0)")
        i = j
    return "".join(out) + sql[i:]


def with_views(sql: str) -> str:
    return _positive_zero(_expand(sql))


def _expand(sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in VIEWS:
            return
        for dep in dict.fromkeys(_WORD.findall(VIEWS[name])):
            visit(dep)
        order.append(name)

    for name in dict.fromkeys(_WORD.findall(sql)):
        visit(name)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

VIEWS["v_pledge"] = """
SELECT l_suppkey AS instrument, l_extendedprice * 1000.0e0 AS pledged FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_quantity < 3"""
VIEWS["v_penalty"] = """
SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS penalty_date FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'N' AND l_quantity <= 2"""
VIEWS["v_flow"] = """
SELECT l_suppkey AS instrument, CASE WHEN l_suppkey % 3 <> 0 THEN sum(CASE WHEN l_returnflag = 'A' OR l_linenumber = 1 THEN l_quantity ELSE -l_quantity END) END AS foreign_net,
  CASE WHEN l_suppkey % 3 <> 0 THEN sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) END AS trust_net,
  CASE WHEN l_suppkey % 3 <> 0 THEN sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) END AS total_net FROM lineitem GROUP BY 1"""
VIEWS["v_margin"] = """
SELECT instrument, buy AS margin_buy, sell AS short_sell, sell * (instrument % 5) / 10.0e0 AS short_balance FROM (
  SELECT l_suppkey AS instrument, CASE WHEN l_suppkey % 2 = 0 THEN sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) * 1000.0e0 END AS buy,
    CASE WHEN l_suppkey % 2 = 0 THEN sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) * 1000.0e0 END AS sell FROM lineitem GROUP BY 1)"""
VIEWS["v_rev_latest"] = """
SELECT instrument, rev_yoy, rev_mom FROM v_revenue QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY month DESC) = 1"""
VIEWS["v_val_latest"] = """
SELECT instrument, CASE WHEN instrument % 29 <> 11 THEN (pe - 25.5e0) * 10.0e0 + 20.0e0 END AS pe, CASE WHEN instrument % 29 <> 11 THEN pb / 2.0e0 END AS pb FROM v_valuation"""
VIEWS["v_screen_in"] = """
SELECT m.instrument, lpad(CAST(m.instrument * 83 % 10000 AS VARCHAR), 4, '0') AS code, m.date, m.close, m.n_bars, m.momentum, m.vol5, m.vol_prev5, a.adv,
  c.name, c.paid_in_capital, CASE WHEN c.paid_in_capital IS NOT NULL THEN c.list_date END AS list_date, c.paid_in_capital IS NOT NULL AS has_company, p.max_pledged, q.last_penalty,
  r.rev_yoy, r.rev_mom, r.instrument IS NOT NULL AS has_rev, v.pe, v.pb, v.pe IS NOT NULL AS has_val,
  f.foreign_net, f.trust_net, f.total_net, f.total_net IS NOT NULL AS has_flow, g.margin_buy, g.short_sell, g.short_balance, g.margin_buy IS NOT NULL AS has_margin,
  coalesce(gf.timing_adjustment, 0.0e0) AS timing_adjustment, coalesce(va.score_adjustment, 0.0e0) AS volume_adjustment, x.last_ex,
  CASE WHEN m.instrument % 17 = 3 THEN 'sanctioned' WHEN m.instrument % 19 = 5 THEN 'trading_halt' WHEN m.instrument % 37 = 2 THEN 'margin_suspended' END AS list_reason
FROM v_mom m LEFT JOIN v_adv a ON a.instrument = m.instrument
LEFT JOIN (SELECT instrument, name, list_date, CASE WHEN instrument % 31 <> 4 THEN paid_in_capital END AS paid_in_capital FROM v_company) c ON c.instrument = m.instrument
LEFT JOIN (SELECT instrument, max(pledged) AS max_pledged FROM v_pledge GROUP BY 1) p ON p.instrument = m.instrument
LEFT JOIN (SELECT instrument, max(penalty_date) AS last_penalty FROM v_penalty GROUP BY 1) q ON q.instrument = m.instrument
LEFT JOIN v_rev_latest r ON r.instrument = m.instrument LEFT JOIN v_val_latest v ON v.instrument = m.instrument
LEFT JOIN v_flow f ON f.instrument = m.instrument LEFT JOIN v_margin g ON g.instrument = m.instrument
LEFT JOIN v_gap_fill gf ON gf.instrument = m.instrument LEFT JOIN v_vol_anom va ON va.instrument = m.instrument
LEFT JOIN (SELECT instrument, max(ex_date) AS last_ex FROM v_action_day GROUP BY 1) x ON x.instrument = m.instrument
WHERE m.rn = 1"""
