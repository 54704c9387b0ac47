"""Predicates on a row, or a row and the one before; null operands give false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .series import BARS, Series, false_if_null, value


def compare(a, op: str, b, tol: float = 0.0) -> Column:
    x, y = value(a), value(b)
    if op == "ne" and not tol:
        return F.coalesce(x != y, F.lit(True))
    return false_if_null({
        "gt": lambda: x > y + tol, "ge": lambda: x >= y - tol, "lt": lambda: x < y - tol, "le": lambda: x <= y + tol,
        "eq": lambda: F.abs(x - y) <= tol, "ne": lambda: F.abs(x - y) > tol,
    }[op]())


def with_relation(df: DataFrame, a, op: str, b, tol: float = 0.0, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{a}__{op}__{b}", compare(a, op, b, tol))


def crosses(a, b, up: bool = True, series: Series = BARS) -> Column:
    now, then = value(a) - value(b), series.lag(value(a) - value(b))
    return false_if_null((now > 0) & (then <= 0) if up else (now < 0) & (then >= 0))


def within(x, low, high) -> Column:
    return false_if_null(value(x).between(value(low), value(high)))


def with_bar_relations(df: DataFrame, series: Series = BARS) -> DataFrame:
    """Each price against the previous bar's."""
    out = {}
    for name, column, op in (("higher_high", "high", "gt"), ("lower_low", "low", "lt"), ("higher_close", "close", "gt"), ("lower_close", "close", "lt"), ("higher_open", "open", "gt"), ("lower_open", "open", "lt")):
        out[f"{column}__{name}"] = compare(column, op, series.lag(column))
    return df.withColumns(out)


def with_inside_outside(df: DataFrame, inclusive: bool = True, series: Series = BARS) -> DataFrame:
    """The range within, or around, the previous bar's."""
    le, ge = ("le", "ge") if inclusive else ("lt", "gt")
    high, low = series.lag("high"), series.lag("low")
    return df.withColumns({
        "inside_bar": compare("high", le, high) & compare("low", ge, low),
        "outside_bar": compare("high", ge, high) & compare("low", le, low),
    })


def with_body(df: DataFrame, allow_equal: bool = False) -> DataFrame:
    return df.withColumns({"bullish_bar": compare("close", "ge" if allow_equal else "gt", "open"), "bearish_bar": compare("close", "le" if allow_equal else "lt", "open")})


def true_range(series: Series = BARS) -> Column:
    before = series.lag("close")
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_true_range(df: DataFrame, series: Series = BARS) -> DataFrame:
    return df.withColumn("true_range", true_range(series))


def with_range_expansion(df: DataFrame, method: str = "highlow", series: Series = BARS) -> DataFrame:
    df = df.withColumn("_range", true_range(series) if method == "tr" else F.col("high") - F.col("low"))
    return df.withColumn("range_expansion", compare("_range", "gt", series.lag("_range"))).drop("_range")
