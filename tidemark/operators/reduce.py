"""Fewer rows: events, time chunks, condition paths, histograms, survival of run lengths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import BARS, Series, joined, require, require_type

NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


@dataclass(frozen=True)
class Metric:
    column: str
    how: str
    name: str | None = None

    def check(self, df: DataFrame) -> None:
        kinds = {"count_true": ("boolean",), "sum": NUMBERS, "median": NUMBERS}.get(self.how)
        require(df, self.column)
        if self.how not in ("min", "max", "first", "last", "sum", "median", "count_true"):
            raise ValueError(f"unknown aggregation {self.how}")
        if kinds:
            require_type(df, kinds, self.column)

    def expression(self, order: Column) -> Column:
        """first and last are those of the values that are not null."""
        c = F.col(self.column)
        there = F.when(c.isNotNull(), order)
        made = {"min": F.min(c), "max": F.max(c), "first": F.min_by(c, there), "last": F.max_by(c, there), "sum": F.sum(c), "median": F.median(c), "count_true": F.count_if(c)}[self.how]
        return made.alias(self.name or f"{self.column}_{self.how}")


def _metrics(df: DataFrame, metrics, series: Series) -> list[Column]:
    for m in metrics:
        m.check(df)
    order = F.struct(series.ts, *series.tie)
    return [m.expression(order) for m in metrics]


def per_event(df: DataFrame, event: str, metrics, with_count: bool = True, series: Series = BARS) -> DataFrame:
    """One row for each event id; rows without one are left out."""
    count = [F.count("*").alias("src_row_count")] if with_count else []
    return df.where(F.col(event).isNotNull()).groupBy(*series.keys, event).agg(*count, *_metrics(df, metrics, series))


def bucket_start(ts: Column, seconds: int, origin: Column) -> Column:
    """The start of the bucket of a time, counted from the midnight of the series' first day."""
    at, zero = F.unix_micros(ts.cast("timestamp")), F.unix_micros(F.date_trunc("day", origin.cast("timestamp")))
    size = seconds * 1_000_000
    return F.timestamp_micros(zero + F.floor((at - zero) / size) * size)


def with_bucket(df: DataFrame, seconds: int, out: str, series: Series = BARS) -> DataFrame:
    first = df.groupBy(*series.keys).agg(F.min(series.ts).alias("_first"))
    return joined(df, first, series.keys).withColumn(out, bucket_start(F.col(series.ts), seconds, F.col("_first"))).drop("_first")


def per_time_chunk(df: DataFrame, seconds: int, metrics, with_empty: bool = False, series: Series = BARS) -> DataFrame:
    """One row for each time chunk; with_empty: also for chunks of the span without rows (sums and counts 0)."""
    made = with_bucket(df, seconds, "chunk", series).groupBy(*series.keys, "chunk").agg(F.count("*").alias("src_row_count"), *_metrics(df, metrics, series))
    if not with_empty:
        return made
    step = F.make_dt_interval(secs=F.lit(seconds))
    spine = made.groupBy(*series.keys).agg(F.explode(F.sequence(F.min("chunk"), F.max("chunk"), step)).alias("chunk"))
    zero = ["src_row_count", *[m.name or f"{m.column}_{m.how}" for m in metrics if m.how in ("sum", "count_true")]]
    return joined(spine, made, [*series.keys, "chunk"], "left").fillna(0, zero)


def condition_paths(df: DataFrame, group: str, series: Series = BARS) -> DataFrame:
    """One row for each run of a condition: times, bars, and the path's prices."""
    order = F.struct(series.ts, *series.tie)
    ends = [f(c, order).alias(f"{n}_{c}") for c in ("open", "high", "low", "close") for n, f in (("first", F.min_by), ("last", F.max_by))]
    return df.where(F.col(group).isNotNull()).groupBy(*series.keys, group).agg(F.min(series.ts).alias("start_ts"), F.max(series.ts).alias("end_ts"), F.count("*").alias("bars"), *ends, F.max("high").alias("max_high"), F.min("low").alias("min_low"))


def equal_width(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Histogram of n equal bins, the last closed on the right: bucket, lower, upper, count, pct, cum_pct."""
    x = F.col(column).cast("double")
    span = df.where(x.isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n
    spine = span.where("lo is not null").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bins = spine.select("bucket", (F.col("lo") + F.col("bucket") * width).alias("lower"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("upper"))
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(n - 1), F.floor((x - F.col("lo")) / width))).cast("int")
    counted = df.where(x.isNotNull()).join(F.broadcast(span)).groupBy(at.alias("bucket")).agg(F.count("*").alias("count"))
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = bins.join(counted, "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    out = out.withColumns({"pct": F.col("count") / total, "cum_pct": F.sum("count").over(every) / total})
    return out.withColumn("pct_text", F.format_string("%.2f%%", F.col("pct") * 100))


def zoom(df: DataFrame, column: str, n: int = 20, threshold: float = 0.9, depth: int = 6) -> list[DataFrame]:
    """Histograms; while one bin holds the threshold of all rows, that bin is cut into bins again."""
    out, total, own = [], df.where(F.col(column).isNotNull()).count(), df
    for level in range(depth):
        made = equal_width(own, column, n).withColumns({"depth": F.lit(level), "bucket_id": F.concat_ws(".", F.lit(level), "bucket")})
        out.append(made)
        top = made.orderBy(F.desc("count"), "bucket").select("bucket", "lower", "upper", "count").head(1)
        if not top or top[0]["count"] < threshold * total or top[0]["lower"] == top[0]["upper"]:
            break
        # The last bin is closed on the right.
        own = own.where((F.col(column) >= top[0]["lower"]) & (F.lit(top[0]["bucket"] == n - 1) | (F.col(column) < top[0]["upper"])))
    return out


def run_lengths(df: DataFrame, length: str) -> DataFrame:
    """Distribution of lengths: n, count, pct, and the share of runs that reach n."""
    by = df.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("n")).agg(F.count("*").alias("count"))
    tail = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.withColumns({"pct": F.col("count") / total, "survival": F.sum("count").over(tail) / total})


def condition_persistence(df: DataFrame, group: str, run: str, series: Series = BARS) -> DataFrame:
    """Runs of a condition, one row each."""
    order = F.struct(series.ts, *series.tie)
    return df.where(F.col(group).isNotNull()).groupBy(*series.keys, group).agg(F.min(series.ts).alias("start_ts"), F.max(series.ts).alias("end_ts"), F.min_by("open", order).alias("first_open"), F.max_by("open", order).alias("last_open"), F.max(run).alias("run_len"))


def complete_domain(lengths: DataFrame) -> None:
    """Raises unless the column n is unique and without gaps."""
    r = lengths.agg(F.min("n"), F.max("n"), F.count("n"), F.countDistinct("n")).first()
    if r[2] and not r[1] - r[0] + 1 == r[2] == r[3]:
        raise ValueError("run lengths are not a complete domain")


def survival_marks(lengths: DataFrame, thresholds) -> DataFrame:
    """For each threshold the smallest length that at most that share of runs reaches."""
    marks = F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds, reverse=True)])).alias("threshold")
    return lengths.select("n", "survival", marks).groupBy("threshold").agg(F.min(F.when(F.col("survival") <= F.col("threshold"), F.col("n"))).alias("n"))


def distinct_per_period(df: DataFrame, what: str, days: int, series: Series = BARS) -> DataFrame:
    return with_bucket(df, 86400 * days, "period", series).groupBy(*series.keys, "period").agg(F.countDistinct(what).alias("n_distinct"))
