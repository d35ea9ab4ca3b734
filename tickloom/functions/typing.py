"""Type coercion and small scalar expressions. Everything here is a Column, nothing shuffles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    return F.lit(float(x))


def rnd(c: Column | str, digits: int = 0) -> Column:
    """Round half away from zero in plain double arithmetic (stays inside codegen)."""
    c, m = col(c).cast("double"), dbl(10.0**digits)
    return F.when(c < 0, -F.floor(-c * m + 0.5)).otherwise(F.floor(c * m + 0.5)) / m


def safe_float(c: Column | str, default: float = 0.0) -> Column:
    """Text to double; anything unparseable becomes ``default``."""
    return F.coalesce(col(c).try_cast("double"), dbl(default))


def parse_float(c: Column | str) -> Column:
    """Text to double; unparseable text and NaN become null."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def first_filled(*cols: Column | str, default: str | None = None) -> Column:
    """First column that is neither null nor empty."""
    picks = [F.nullif(col(c), F.lit("")) for c in cols]
    return F.coalesce(*picks, F.lit(default)) if default is not None else F.coalesce(*picks)


def first_nonzero(*cols: Column | str, default: float = 0.0) -> Column:
    """First column that is neither null nor zero (a zero price means "missing")."""
    return F.coalesce(*[F.nullif(col(c), dbl(0)) for c in cols], dbl(default))


def first_numeric(*cols: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(*[col(c).try_cast("double") for c in cols], dbl(default))


def rename_aliases(columns: Sequence[str], aliases: Mapping[str, str]) -> list[Column]:
    """Select list that merges every alias into its canonical name; the leftmost alias wins."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(aliases.get(c, c), []).append(c)
    return [F.coalesce(*[F.col(s) for s in srcs]).alias(name) for name, srcs in groups.items()]


def era_to_date(c: Column | str, offset: int = 1911) -> Column:
    """``YYYMMDD`` in an offset era to a date; bad text gives null."""
    c = F.trim(col(c))
    year = F.substring(c, 1, 3).try_cast("int") + F.lit(offset)
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.substring(c, 4, 4))
    return F.when(F.length(c) == 7, F.try_to_date(text, "yyyyMMdd"))


def date_to_era(c: Column | str, offset: int = 1911) -> Column:
    c = col(c)
    return F.concat(F.lpad((F.year(c) - F.lit(offset)).cast("string"), 3, "0"), F.date_format(c, "MMdd"))


def parse_date(c: Column | str, formats: Iterable[str] = ("yyyy/MM/dd", "yyyyMMdd")) -> Column:
    return F.coalesce(*[F.try_to_date(col(c), f) for f in formats])


def normalize_code(c: Column | str, width: int = 4) -> Column:
    """Numeric ids are zero padded to ``width`` and never cut; other text is only trimmed."""
    t = F.trim(col(c))
    n = t.try_cast("bigint").cast("string")
    return F.when(n.isNotNull() & (F.length(n) < width), F.lpad(n, width, "0")).otherwise(F.coalesce(n, t))


def second_board(c: Column | str) -> Column:
    """True for codes of the second market segment."""
    n = F.coalesce(col(c).try_cast("int"), F.lit(0))
    return (n >= 9900) | n.between(6000, 7999)


def round_trip_cost(c: Column | str, main: float = 0.006, second: float = 0.007) -> Column:
    return F.when(second_board(c), dbl(second)).otherwise(dbl(main))


#: prices have four decimals, so a price and a mean of up to 300 of them, or such means over nested rows, are 3e-7 apart or equal
TIE = 1e-7


def above(a: Column | str, b: Column | str) -> Column:
    """a > b for prices and their means, whatever the order in which the means were added up."""
    return col(a) - col(b) > TIE


def pct_change(now: Column | str, before: Column | str, digits: int = 2) -> Column:
    """Percent change, null unless the base is positive."""
    now, before = col(now), col(before)
    return F.when(before > 0, rnd((now - before) / before * 100, digits))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Null stays null; greatest and least alone would turn it into a bound."""
    return F.when(c < lo, dbl(lo)).when(c > hi, dbl(hi)).otherwise(c)


def bands(c: Column, steps: Sequence[tuple[float, float]], otherwise, op: str = ">") -> Column:
    """``steps`` is an ordered list of (limit, value): the first limit that is passed decides."""
    test = {">": lambda x: c > x, ">=": lambda x: c >= x, "<": lambda x: c < x, "<=": lambda x: c <= x}[op]
    out = None
    for limit, value in steps:
        v = F.lit(value)
        out = F.when(test(dbl(limit)), v) if out is None else out.when(test(dbl(limit)), v)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def letter_grade(c: Column | str) -> Column:
    v = col(c).try_cast("double")
    return F.when(v.isNull(), F.lit("E")).otherwise(bands(v, GRADES, "E", ">="))


def lookup(c: Column, table: Mapping[str, object], default=None) -> Column:
    """Small fixed table as an expression (no join)."""
    out = None
    for k, v in table.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def failing(rules: Mapping[str, Column]) -> Column:
    """Names of the rules whose condition is not true, in declaration order."""
    tests = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def present(items: Sequence[Column]) -> Column:
    """Array of the non-null items."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
