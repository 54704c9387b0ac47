"""Derived columns of single rows and of a row and an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .series import BARS, Series, false_if_null, numeric, require, value

BPS, PCT = 1e4, 100.0


def with_diff(df: DataFrame, columns=None, n: int = 1, series: Series = BARS) -> DataFrame:
    return df.withColumns({f"{c}__diff_{n}": F.col(c) - series.lag(c, n) for c in numeric(df, columns)})


def with_pct_change(df: DataFrame, columns=None, n: int = 1, pad: bool = True, series: Series = BARS) -> DataFrame:
    """x / x[t - n] - 1; a zero divisor gives null; pad carries the last value over nulls first."""
    filled = lambda c: F.last(c, ignorenulls=True).over(series.cum()) if pad else F.col(c)
    names = numeric(df, columns)
    df = df.withColumns({f"_pad_{c}": filled(c) for c in names})
    return df.withColumns({f"{c}__pct_{n}": F.try_divide(f"_pad_{c}", series.lag(f"_pad_{c}", n)) - 1 for c in names}).drop(*[f"_pad_{c}" for c in names])


def with_log_return(df: DataFrame, columns=None, n: int = 1, epsilon: float = 0.0, series: Series = BARS) -> DataFrame:
    names = numeric(df, columns)
    log = lambda c: F.when(F.col(c) + epsilon > 0, F.log(F.col(c) + epsilon))
    return df.withColumns({f"{c}__logret_{n}": log(c) - series.lag(log(c), n) for c in names})


def with_shift(df: DataFrame, columns=None, n: int = 1, series: Series = BARS) -> DataFrame:
    return df.withColumns({f"{c}__shift_{n}": series.lag(c, n) for c in numeric(df, columns)})


def with_bar_direction(df: DataFrame, column: str, n: int = 1, series: Series = BARS) -> DataFrame:
    df = with_diff(df, [column], n, series)
    return df.withColumn(f"{column}__diff_{n}__direction", F.signum(f"{column}__diff_{n}").cast("tinyint"))


def with_sign(df: DataFrame, columns=None, zero_as_zero: bool = True) -> DataFrame:
    sign = lambda c: F.signum(c) if zero_as_zero else F.when(F.col(c) < 0, -1).when(F.col(c) >= 0, 1)
    return df.withColumns({f"{c}__sign": sign(c).cast("tinyint") for c in numeric(df, columns)})


def with_abs(df: DataFrame, columns=None) -> DataFrame:
    return df.withColumns({f"{c}__abs": F.abs(c) for c in numeric(df, columns)})


def in_units(delta, reference, unit: str) -> Column:
    """delta as a share of reference, in "bps" or "pct"."""
    return F.try_divide(value(delta), value(reference)) * {"bps": BPS, "pct": PCT}[unit]


def abs_to_unit(df: DataFrame, column: str, reference: str, unit: str, out: str, group: str | None = None, series: Series = BARS) -> DataFrame:
    """Each row against its own reference, or with a group against the reference of the group's first row."""
    ref = F.first(reference).over(series.whole(group)) if group else F.col(reference)
    return df.withColumn(out, in_units(column, ref, unit))


def null_if(df: DataFrame, condition: Column, targets, negate: bool = True) -> DataFrame:
    """targets, null where the condition holds (negate) or where it does not."""
    keep = ~false_if_null(condition) if negate else false_if_null(condition)
    return df.withColumns({c: F.when(keep, F.col(c)) for c in targets})


def with_path_length(df: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    return df.withColumns({"path_len": span, "path_len_pct": in_units(span, "open", "pct"), "path_len_bps": in_units(span, "open", "bps")})


def move_column(df: DataFrame, column: str, to: int) -> DataFrame:
    require(df, column)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest[:to], column, *rest[to:])


def insert_column(df: DataFrame, column: str, expression: Column, at: int) -> DataFrame:
    return move_column(df.withColumn(column, expression), column, at)


def drop_columns(df: DataFrame, columns) -> DataFrame:
    require(df, *columns)
    return df.drop(*columns)


def keep_policy(df: DataFrame, final: str, candidates, keep_all: bool = False) -> DataFrame:
    """Only the final column of an operator, or its intermediate ones too."""
    if final in candidates:
        raise ValueError("the final column cannot be dropped")
    return df if keep_all else df.drop(*candidates)


def one(names):
    if len(names) != 1:
        raise ValueError(f"exactly one name expected, not {len(names)}")
    return names[0]


def as_int8(df: DataFrame, columns) -> DataFrame:
    require(df, *columns)
    return df.withColumns({c: F.col(c).cast("tinyint") for c in columns})


def rename_by_index(df: DataFrame, names: dict[int, str]) -> DataFrame:
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns)])


def guarded(df: DataFrame, run, frozen, key) -> DataFrame:
    """run(df), where the frozen columns of each row (told apart by key) are still what they were and no row is gone or new; raises where it is read otherwise."""
    require(df, *frozen, *key)
    was = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.struct(*frozen).alias("_was"))
    out = run(df)
    names = out.columns
    same = F.struct(*[F.col(c) for c in frozen]).eqNullSafe(F.col("_was")) & F.col("_there").isNotNull()
    rule = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    both_ = out.withColumn("_there", F.lit(True)).join(was, rule, "full")
    checked = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("a frozen column or the rows have changed")).cast("boolean"))
    return both_.where(checked).select(*names)
