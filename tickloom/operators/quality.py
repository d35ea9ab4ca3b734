"""Ingestion quality: row rules, batch rates and gates. One pass over the rows, no per-row Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.typing import dbl, failing, first_nonzero, lookup, parse_float, rnd, second_board

# Feed field names and their canonical names.
FIELD_ALIASES = {
    "證券代號": "code", "證券名稱": "name", "收盤價": "closing_price", "開盤價": "opening_price", "最高價": "highest_price", "最低價": "lowest_price",
    "成交股數": "trade_volume", "成交額": "trade_value", "成交筆數": "transactions", "本益比": "pe_ratio", "股價淨值比": "pb_ratio", "殖利率(%)": "dividend_yield",
    "公司代號": "company_code", "實收資本額": "paid_in_capital", "每股盈餘": "eps", "淨值": "book_value",
    "當月營收": "current_month_revenue", "去年同月增減(%)": "yoy_change_pct", "上月比較增減(%)": "mom_change_pct",
}
REGIMES = ("normal", "caution", "stress", "crisis", "black_swan", "unknown")


def _some(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit(""))) >= 1


def _nonneg(c: str, required: bool = False) -> Column:
    v = parse_float(c)
    ok = v >= 0
    return ok if required else F.col(c).isNull() | ok


def daily_rules() -> dict[str, Column]:
    return {
        "code": _some("code"), "closing_price": parse_float("closing_price") > 0, "trade_volume": _nonneg("trade_volume", True),
        "opening_price": _nonneg("opening_price"), "highest_price": _nonneg("highest_price"), "lowest_price": _nonneg("lowest_price"),
    }


def valuation_rules() -> dict[str, Column]:
    return {"code": _some("code"), "pb_ratio": _nonneg("pb_ratio")}


def company_rules() -> dict[str, Column]:
    return {"code": _some("code"), "paid_in_capital": _nonneg("paid_in_capital")}


def revenue_rules() -> dict[str, Column]:
    return {"code": _some("code"), "revenue": _nonneg("revenue", True)}


def action_rules() -> dict[str, Column]:
    return {"code": _some("code"), "ex_date": F.col("ex_date").isNotNull(), "cash_div": _nonneg("cash_div"), "stock_div": _nonneg("stock_div")}


def price_point_rules() -> dict[str, Column]:
    return {"date": F.try_to_date("date", "yyyy-MM-dd").isNotNull(), "close": _nonneg("close", True), "adj_close": _nonneg("adj_close"), "volume": _nonneg("volume")}


def default_adj_close() -> Column:
    return F.coalesce(parse_float("adj_close"), F.when(parse_float("close") > 0, parse_float("close")))


def score_rules(names: Sequence[str]) -> dict[str, Column]:
    return {n: F.col(n).isNotNull() & F.col(n).between(0, 100) for n in names}


def regime_rules() -> dict[str, Column]:
    return {"regime": F.col("regime").isin(*REGIMES), "confidence": F.col("confidence").isin("high", "medium", "low"), "days_in_regime": F.col("days_in_regime") >= 0}


def holiday_rules() -> dict[str, Column]:
    return {"era_date": F.col("era_date").rlike(r"^\d{7}$"), "name": _some("name")}


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``errors`` (names of the failed rules) and ``valid``."""
    return df.withColumn("errors", failing(rules)).withColumn("valid", F.size("errors") == 0)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("valid").drop("valid", "errors"), checked.where("not valid")


def batch_report(checked: DataFrame, by: Sequence[str] = (), warn: float = 0.05) -> DataFrame:
    n, bad = F.count("*"), F.count_if(~F.col("valid"))
    return checked.groupBy(*by).agg(
        n.alias("rows"), (n - bad).alias("valid_rows"), bad.alias("error_rows"), rnd(bad / n, 6).alias("error_rate"), (bad / n > warn).alias("warn"))


def quality_gate(report: DataFrame, dataset: str = "dataset", key: str = "daily", limit: float = 0.10) -> DataFrame:
    """Dataset rates, the total rate and whether ingestion must stop (rate of the key dataset)."""
    total = report.agg(F.sum("rows").alias("rows"), F.sum("error_rows").alias("error_rows")).select(
        F.lit("total").alias(dataset), "rows", "error_rows", rnd(F.col("error_rows") / F.col("rows"), 6).alias("error_rate"))
    each = report.select(dataset, "rows", "error_rows", "error_rate")
    return each.unionByName(total).withColumn("abort", (F.col(dataset) == key) & (F.col("error_rate") > limit))


def enforce_gate(gate: DataFrame) -> DataFrame:
    """Fails the job when a gate row asks for it."""
    msg = F.concat(F.lit("quality gate: "), F.col("dataset"))
    return gate.withColumn("abort", F.when(F.col("abort"), F.raise_error(msg).cast("boolean")).otherwise(F.lit(False)))


def completeness(report: DataFrame, required: Mapping[str, int], dataset: str = "dataset") -> DataFrame:
    need = lookup(F.col(dataset), required, 0)
    return report.select(dataset, "rows", need.alias("required"), (F.col("rows") >= need).alias("complete"))


def classify_payload(payload: Column | str) -> Column:
    """Kind of a raw response: null, html, text, error, wrapped, record, list or empty_list."""
    p = F.trim(F.col(payload) if isinstance(payload, str) else payload)
    return (
        F.when(p.isNull() | (p == "") | (p == "null"), "null")
        .when(p.rlike(r"(?is)^(?:<!--.*?-->\s*)*<(?:!doctype|html)\b"), "html")
        .when(p.startswith("["), F.when(p.rlike(r"^\[\s*\]$"), "empty_list").otherwise("list"))
        .when(p.startswith("{"), F.when(F.coalesce(F.get_json_object(p, "$.error"), F.get_json_object(p, "$.Error")).isNotNull(), "error")
              .when(F.get_json_object(p, "$.data").startswith("["), "wrapped").otherwise("record"))
        .otherwise("text")
    )


def unwrap_payloads(df: DataFrame, payload: str, record: str) -> DataFrame:
    """Records of usable payloads: lists, single records and ``{"data": [...]}``."""
    k = classify_payload(payload)
    body = F.when(k == "list", F.col(payload)).when(k == "wrapped", F.get_json_object(payload, "$.data")).when(k == "record", F.concat(F.lit("["), F.col(payload), F.lit("]")))
    return df.withColumn("_b", body).where(F.col("_b").isNotNull()).select(
        *[c for c in df.columns if c != payload], F.explode(F.from_json("_b", f"array<{record}>")).alias("r")).select("*", "r.*").drop("r")


def check_payloads(df: DataFrame, payload: str, required: Sequence[str] = (), usual: str = r"^[^_]") -> DataFrame:
    """``df`` with kind, n_records and reason; a null reason means that the payload can be loaded.

    Nulls, pages, texts and error objects are rejected by kind, a list that is not
    one of records as ``malformed``, a list whose first record has no field that
    matches ``usual`` as ``unexpected fields``, and a payload in which a record
    lacks a required field or holds null there as ``null: field, ...``. An empty list is fine.
    """
    body = F.when(F.col("kind") == "wrapped", F.get_json_object(payload, "$.data")).when(F.col("kind") == "record", F.concat(F.lit("["), F.col(payload), F.lit("]"))).when(
        F.col("kind").isin("list", "empty_list"), F.col(payload))
    records = F.from_json(body, "array<map<string,string>>")
    first = F.map_keys(F.get("_r", F.lit(0)))
    unusual = F.col("kind").isin("list", "wrapped") & (F.size("_r") > 0) & ~F.coalesce(F.exists(first, lambda k: k.rlike(usual)), F.lit(False))
    lacking = F.filter(F.array(*[F.lit(c) for c in required]).cast("array<string>"), lambda c: F.exists("_r", lambda r: F.try_element_at(r, c).isNull()))
    reason = (
        F.when(F.col("kind").isin("null", "html", "text", "error"), F.col("kind"))
        .when(F.col("_r").isNull() | F.exists("_r", lambda r: r.isNull()), "malformed")
        .when(unusual, "unexpected fields")
        .when(F.size(lacking) > 0, F.concat(F.lit("null: "), F.array_join(lacking, ", ")))
    )
    out = df.withColumn("kind", classify_payload(payload)).withColumn("_r", records)
    return out.select(*df.columns, "kind", F.when(F.col("_r").isNotNull(), F.size("_r")).alias("n_records"), reason.alias("reason"))


def nested(payload: Column | str, path: str, default: str | None = None) -> Column:
    """Dotted path in a JSON text with a default."""
    return F.coalesce(F.get_json_object(payload, "$." + path), F.lit(default))


def board_label(code: Column, sector: Column) -> Column:
    board = F.concat(code, F.when(second_board(code), "(second)").otherwise("(main)"))
    return F.when(~code.rlike(r"^\d+$"), code).when(sector.isNotNull(), F.concat(board, F.lit(" ["), sector, F.lit("]"))).otherwise(board)


def price_change(current: Column, previous: Column) -> Column:
    """struct(change, change_pct, text)."""
    ch = current - previous
    pct = ch / F.nullif(previous, dbl(0)) * 100
    sign = F.when(ch >= 0, "+").otherwise("")
    text = F.when(previous > 0, F.concat(F.format_string("NT$%.1f (", current), sign, F.format_string("%.1f / ", ch), sign, F.format_string("%.2f%%)", pct)))
    return F.struct(rnd(ch, 4).alias("change"), rnd(pct, 4).alias("change_pct"), text.alias("text"))


def money_text(v: Column) -> Column:
    return F.concat(F.lit("NT$"), F.format_number(v, 0))


def percent_text(v: Column) -> Column:
    return F.coalesce(F.concat(F.when(v > 0, "+").otherwise(""), F.format_string("%.2f%%", v)), F.lit("N/A"))


def era_text(d: Column) -> Column:
    return F.concat(F.lit("民國"), (F.year(d) - 1911).cast("string"), F.lit("年"), F.date_format(d, "MM"), F.lit("月"), F.date_format(d, "dd"), F.lit("日"))


def fiscal(d: Column) -> Column:
    """struct(quarter, year, prior_quarter, prior_year, last_year)."""
    q, y = F.quarter(d), F.year(d)
    return F.struct(q.alias("quarter"), y.alias("year"), F.when(q == 1, 4).otherwise(q - 1).alias("prior_quarter"), F.when(q == 1, y - 1).otherwise(y).alias("prior_year"), (y - 1).alias("last_year"))


def metric(named: Sequence[str], fallback: Sequence[str]) -> Column:
    """First filled column of ``named`` (unparseable counts as zero), else the first non-zero fallback."""
    texts = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in named])
    return F.when(texts.isNotNull(), F.coalesce(texts.try_cast("double"), dbl(0))).otherwise(first_nonzero(*[F.col(c).try_cast("double") for c in fallback]))
