"""Boolean columns combined, contiguous runs of them numbered, and rows counted since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .series import BARS, Series, both, either, false_if_null, flag, require, require_type


def _ready(df: DataFrame, columns, out: str | None, strict: bool) -> list[Column]:
    require(df, *columns)
    if strict:
        require_type(df, ("boolean",), *columns)
    if out in df.columns:
        raise ValueError(f"{out} exists")
    return [false_if_null(F.col(c)) for c in columns]


def all_of(df: DataFrame, columns, out: str, strict: bool = True) -> DataFrame:
    return df.withColumn(out, both(_ready(df, columns, out, strict)))


def any_of(df: DataFrame, columns, out: str, strict: bool = True) -> DataFrame:
    return df.withColumn(out, either(_ready(df, columns, out, strict)))


def _sum(flags) -> Column:
    out = F.lit(0)
    for c in flags:
        out = out + flag(c)
    return out


def at_least(df: DataFrame, columns, out: str, k: int, strict: bool = True) -> DataFrame:
    if not 1 <= k <= len(columns):
        raise ValueError("k must be between 1 and the number of columns")
    return df.withColumn(out, _sum(_ready(df, columns, out, strict)) >= k)


def negate(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, ~_ready(df, [column], out, True)[0])


def with_group_id(df: DataFrame, condition: str, out: str, series: Series = BARS) -> DataFrame:
    """1, 2, ... for each contiguous run of true rows; null elsewhere."""
    c = false_if_null(F.col(condition))
    start = c & ~F.coalesce(series.lag(c), F.lit(False))
    df = df.withColumn("_start", flag(start))
    return df.withColumn(out, F.when(c, F.sum("_start").over(series.cum()))).drop("_start")


def with_id_between(df: DataFrame, start: Column, end: Column, out: str, with_start: bool = True, with_end: bool = False, series: Series = BARS) -> DataFrame:
    """The number of the segment from a start row to the next end row; a row may not be both."""
    if with_start and with_end:
        raise ValueError("not both ends can be inclusive")
    s, e = false_if_null(start), false_if_null(end)
    mark = F.when(s & e, F.raise_error(F.lit("a row is both start and end"))).when(s, 1).when(e, -1).cast("int")
    df = df.withColumns({"_mark": mark})
    df = df.withColumns({"_seg": F.sum(F.when(F.col("_mark") == 1, 1).otherwise(0)).over(series.cum()), "_on": F.last("_mark", ignorenulls=True).over(series.cum())})
    inside = false_if_null(F.col("_on") == 1)
    if not with_start:
        inside = inside & F.col("_mark").isNull()
    if with_end:
        inside = inside | false_if_null((F.col("_mark") == -1) & (F.last("_mark", ignorenulls=True).over(series.before()) == 1))
    return df.withColumn(out, F.when(inside, F.col("_seg"))).drop("_mark", "_seg", "_on")


def _streak(df: DataFrame, c: Column, out: str, series: Series) -> DataFrame:
    df = df.withColumn("_true", flag(c))
    df = df.withColumn("_island", F.sum(1 - F.col("_true")).over(series.cum()))
    return df.withColumn(out, F.sum("_true").over(series.cum("_island"))).drop("_true", "_island")


def with_running_true(df: DataFrame, column: str, name: str | None = None, series: Series = BARS) -> DataFrame:
    require_type(df, ("boolean",), column)
    return _streak(df, false_if_null(F.col(column)), name or f"{column}__run_true", series)


def _since(df: DataFrame, c: Column, out: str, series: Series) -> DataFrame:
    df = df.withColumn("_row", F.row_number().over(series.over()))
    return df.withColumn(out, F.col("_row") - F.last(F.when(c, F.col("_row")), ignorenulls=True).over(series.cum())).drop("_row")


def with_bars_since(df: DataFrame, column: str, name: str | None = None, series: Series = BARS) -> DataFrame:
    """Rows since the last true one; null before the first."""
    return _since(df, false_if_null(F.col(column)), name or f"{column}__bars_since_true", series)


def _truth(df: DataFrame, c: str) -> Column:
    """Booleans as they are, numbers other than 0, and other values that are there."""
    kind = dict(df.dtypes)[c]
    return false_if_null(F.col(c) if kind == "boolean" else F.col(c) != 0 if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") else F.col(c).isNotNull())


def with_running_all(df: DataFrame, columns, name: str, series: Series = BARS) -> DataFrame:
    return _streak(df, both([_truth(df, c) for c in columns]), name, series)


def with_running_at_least(df: DataFrame, columns, k: int, name: str, series: Series = BARS) -> DataFrame:
    return _streak(df, _sum([_truth(df, c) for c in columns]) >= k, name, series)


def with_bars_since_any(df: DataFrame, columns, name: str, series: Series = BARS) -> DataFrame:
    return _since(df, either([_truth(df, c) for c in columns]), name, series)


def with_counts_running(df: DataFrame, group: str, relation: str, prefix: str = "count", series: Series = BARS) -> DataFrame:
    """How often each relation has held so far in the group."""
    return df.withColumns({f"{prefix}_{k}": F.count_if(F.col(relation) == k).over(series.cum(group)).cast("int") for k in ("above", "below", "touch")})


def with_streaks(df: DataFrame, relation: str, group: str, series: Series = BARS, out_id: str = "streak_id", out_len: str = "streak_len") -> DataFrame:
    """Runs of equal values within a group; a null row begins a run of its own."""
    change = ~(false_if_null(F.col(relation) == series.lag(relation)) & false_if_null(F.col(group) == series.lag(group)))
    df = df.withColumn("_change", flag(change))
    df = df.withColumn(out_id, F.sum("_change").over(series.cum())).drop("_change")
    return df.withColumn(out_len, F.row_number().over(series.over(out_id)))
