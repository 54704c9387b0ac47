"""Ordered series: which columns tell series apart, and what orders a series.

Every ordered operator takes a ``Series``.  All windows of one series share one
distribution (its keys) and one order, so that a chain of operators plans one
exchange and one sort; windows over parts of a series (legs, groups) keep the
keys first and reuse that exchange.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

FIRST, HERE, LAST = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...] = ("symbol",)
    ts: str = "tz_start"
    tie: tuple[str, ...] = ()

    def over(self, *parts: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *parts).orderBy(self.ts, *self.tie)

    def cum(self, *parts: str) -> WindowSpec:
        return self.over(*parts).rowsBetween(FIRST, HERE)

    def before(self, *parts: str) -> WindowSpec:
        return self.over(*parts).rowsBetween(FIRST, -1)

    def last(self, n: int, *parts: str) -> WindowSpec:
        return self.over(*parts).rowsBetween(1 - n, HERE)

    def whole(self, *parts: str) -> WindowSpec:
        return self.over(*parts).rowsBetween(FIRST, LAST)

    def lag(self, c: str | Column, n: int = 1, *parts: str) -> Column:
        return F.lag(c, n).over(self.over(*parts)) if n >= 0 else F.lead(c, -n).over(self.over(*parts))


BARS = Series()


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def both(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def flag(c: Column) -> Column:
    """1 or 0; null counts as false."""
    return F.when(c, 1).otherwise(0)


def value(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Comparisons with NaN are true in Spark; a series has nulls in their place."""
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c, t in df.dtypes if t in ("double", "float")})


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def require_type(df: DataFrame, kinds: tuple[str, ...], *columns: str) -> None:
    require(df, *columns)
    wrong = {c: t for c, t in df.dtypes if c in columns and not t.startswith(kinds)}
    if wrong:
        raise TypeError(f"expected {kinds}: {wrong}")


def numeric(df: DataFrame, columns=None) -> list[str]:
    """The named columns that exist, or all numeric ones."""
    return [c for c, t in df.dtypes if (c in columns if columns is not None else t.startswith(("double", "float", "int", "bigint", "long", "decimal", "smallint", "tinyint")))]


def joined(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """a with the other columns of b, joined on keys where null equals null."""
    own = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return a.join(own, both([F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), how).drop(*[f"_of_{k}" for k in keys])
