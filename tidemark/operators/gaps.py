"""Quality of bars: duplicates, implausible prices, gaps, and filling them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .indicators import rolling
from .series import BARS, Series, both, flag

OHLC = ("open", "high", "low", "close")


def dedupe(df: DataFrame, series: Series = BARS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): of rows of one time with equal prices the first stays; rows whose prices differ all stay and are conflicts, or fail if strict."""
    prices = [c for c in (*OHLC, "volume") if c in df.columns]
    at = [*series.keys, series.ts]
    here, all_ = Window.partitionBy(*at), F.struct(*prices)
    rows = df.withColumns({"_differ": F.min(all_).over(here) != F.max(all_).over(here), "_nth": F.row_number().over(Series((*at,), prices[0], series.tie).over())})
    conflicts = rows.where("_differ").drop("_differ", "_nth")
    if strict:
        rows = rows.withColumn("_differ", F.when(F.col("_differ"), F.raise_error(F.lit("bars of one time differ")).cast("boolean")).otherwise(F.lit(False)))
    return rows.where("_differ or _nth = 1").drop("_differ", "_nth"), conflicts


def seconds_since(series: Series) -> Column:
    at = F.unix_micros(F.col(series.ts).cast("timestamp"))
    return (at - F.lag(at).over(series.over())) / 1_000_000


def infer_seconds(df: DataFrame, series: Series = BARS) -> DataFrame:
    """The distance of the first two times of each series."""
    first = df.select(*series.keys, series.ts).distinct().withColumns({"seconds": seconds_since(series), "_row": F.row_number().over(series.over())})
    return first.where("_row = 2").select(*series.keys, "seconds")


def gaps(df: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    """(start, end, missing) of each gap, from the distance of neighbours."""
    step = F.make_dt_interval(secs=F.lit(seconds))
    rows = df.withColumns({"_since": seconds_since(series), "_before": series.lag(series.ts)})
    return rows.where(F.col("_since") > seconds).select(*series.keys, (F.col("_before") + step).alias("gap_start"), (F.col(series.ts) - step).alias("gap_end"), (F.floor(F.col("_since") / seconds) - 1).alias("missing"))


def missing_times(df: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    step = F.make_dt_interval(secs=F.lit(seconds))
    return gaps(df, seconds, series).select(*series.keys, F.explode(F.sequence("gap_start", "gap_end", step)).alias(series.ts))


def gap_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("missing").agg(F.count("*").alias("gaps")).orderBy(F.desc("missing"))


def zeros(df: DataFrame) -> DataFrame:
    return df.where(" or ".join(f"{c} = 0" for c in OHLC))


def unrealistic(df: DataFrame, most: float | None = None, most_share: float | None = None) -> DataFrame:
    span, mid = F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2
    bad = F.lit(False)
    if most is not None:
        bad = bad | (span > most)
    if most_share is not None:
        bad = bad | (F.try_divide(span, mid) > most_share)
    return df.where(bad)


def inconsistent(df: DataFrame) -> DataFrame:
    """Bars whose prices contradict each other, with a flag for each rule; a null price is a violation."""
    rules = {"open_below_low": F.col("low") <= F.col("open"), "close_below_low": F.col("low") <= F.col("close"), "open_above_high": F.col("open") <= F.col("high"), "close_above_high": F.col("close") <= F.col("high"), "high_below_low": F.col("high") >= F.col("low")}
    df = df.withColumns({n: ~F.coalesce(ok, F.lit(False)) for n, ok in rules.items()})
    return df.where(" or ".join(rules))


def require_homogeneous(df: DataFrame, series: Series = BARS) -> None:
    steps = df.withColumn("s", seconds_since(series)).agg(F.countDistinct("s")).first()[0]
    if steps > 1:
        raise ValueError(f"bars have {steps} distances")


def report(df: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    """One row for each series: counts of all findings, in one pass over windows of the series."""
    rows = df.withColumns({"_since": seconds_since(series), "_ok": F.coalesce(both([F.col("low") <= F.col("open"), F.col("low") <= F.col("close"), F.col("open") <= F.col("high"), F.col("close") <= F.col("high")]), F.lit(False))})
    gap = F.col("_since") > seconds
    return rows.groupBy(*series.keys).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_since") == 0).alias("n_duplicate_ts"), F.count_if(gap).alias("n_gaps"),
        F.coalesce(F.sum(F.when(gap, F.floor(F.col("_since") / seconds) - 1)), F.lit(0)).alias("n_missing"),
        F.count_if(~F.col("_ok")).alias("n_inconsistent"), F.count_if(F.expr(" or ".join(f"{c} = 0" for c in OHLC))).alias("n_zero"), F.max("_since").alias("max_step"),
    )


def materialize(df: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    """The dense spine of each series: missing times as rows of nulls, marked row_materialized."""
    new = missing_times(df, seconds, series).withColumn("row_materialized", F.lit(True))
    return df.withColumn("row_materialized", F.lit(False)).unionByName(new, allowMissingColumns=True)


def with_missing_blocks(df: DataFrame, series: Series = BARS) -> DataFrame:
    """block_id, place (1, 2, ...) and size of contiguous materialised rows."""
    m = F.col("row_materialized")
    df = df.withColumn("_start", flag(m & ~F.coalesce(series.lag(m), F.lit(False))))
    df = df.withColumn("block_id", F.when(m, F.sum("_start").over(series.cum()))).drop("_start")
    return df.withColumns({"block_place": F.when(m, F.row_number().over(series.over("block_id"))), "block_size": F.when(m, F.count(F.lit(1)).over(series.whole("block_id")))})


@dataclass(frozen=True)
class ConstantFill:
    """All prices at the last close."""

    name = "constant"

    def prices(self, series: Series) -> dict[str, Column]:
        last = F.last("close", ignorenulls=True).over(series.cum())
        return dict.fromkeys(OHLC, last)


@dataclass(frozen=True)
class LinearFill:
    """Closes on the line from the last close to the next open; the range is scaled by the mean move of the real bars before, or by the distance to cover."""

    window: int | None = None
    scale: float = 1.0
    least: float = 0.0
    name = "windowed_linear"

    def __post_init__(self):
        if self.window is not None and self.window < 1 or self.scale < 0 or self.least < 0:
            raise ValueError("a window has a row at least, and no scale is negative")

    def prices(self, series: Series) -> dict[str, Column]:
        after = series.over().rowsBetween(0, 2**31 - 1)
        a, b = F.last("close", ignorenulls=True).over(series.cum()), F.first("open", ignorenulls=True).over(after)
        line = lambda k: a + (b - a) * k / (F.col("block_size") + 1)
        move = rolling(F.avg, F.abs(F.col("close") - F.lag("close").over(series.over())), self.window, series, 1) if self.window else F.lit(None)
        sigma = F.greatest(F.coalesce(F.last(move, ignorenulls=True).over(series.cum()) if self.window else move, F.abs(b - a)), F.lit(self.least)) * self.scale
        start, end = line(F.col("block_place") - 1), line(F.col("block_place"))
        return {"open": start, "close": end, "high": F.greatest(start, end) + sigma, "low": F.least(start, end) - sigma}


def fill(df: DataFrame, policy, series: Series = BARS) -> DataFrame:
    """Prices for materialised rows by a policy; gaps at a series' ends cannot occur."""
    if "row_materialized" not in df.columns:
        raise ValueError("materialize the missing rows first")
    df = with_missing_blocks(df, series)
    made = policy.prices(series)
    df = df.withColumns({f"_fill_{c}": e for c, e in made.items()})
    m = F.col("row_materialized")
    df = df.withColumns({c: F.when(m, F.col(f"_fill_{c}")).otherwise(F.col(c)) for c in made} | {"is_synthetic": m, "fill_policy": F.when(m, F.lit(policy.name))})
    return df.drop(*[f"_fill_{c}" for c in made], "block_id", "block_place", "block_size")


def fill_from_sources(df: DataFrame, sources: dict[str, DataFrame], series: Series = BARS) -> DataFrame:
    """Materialised rows from the first source that has all prices of the time; its name is the fill policy."""
    at = [*series.keys, series.ts]
    for k, (_, source) in enumerate(sources.items()):
        have = source.dropna(subset=list(OHLC)).select(*at, F.struct(*OHLC).alias(f"_s{k}"))
        df = df.join(have, at, "left")
    found = F.coalesce(*[F.when(F.col(f"_s{k}").isNotNull(), F.struct(F.lit(n).alias("name"), F.col(f"_s{k}").alias("p"))) for k, n in enumerate(sources)])
    m = F.col("row_materialized") & found.isNotNull()
    df = df.withColumns({c: F.when(m, found["p"][c]).otherwise(F.col(c)) for c in OHLC} | {"is_synthetic": m, "fill_policy": F.when(m, found["name"])})
    return df.drop(*[f"_s{k}" for k in range(len(sources))])


def verify_filled(filled: DataFrame, missing: int) -> None:
    n = filled.agg(F.count_if("is_synthetic")).first()[0]
    if n != missing:
        raise AssertionError(f"{missing} rows were missing, {n} are filled")


def validate(df: DataFrame, seconds: int, series: Series = BARS) -> None:
    """Raises unless each series rises by exactly seconds."""
    bad = df.withColumn("_s", seconds_since(series)).where(F.col("_s") != seconds).limit(1).count()
    if bad:
        raise ValueError("bars are not at a fixed interval")


def unexpected_interval(df: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    return df.withColumn("unexpected_interval", F.coalesce(seconds_since(series) != seconds, F.lit(True)))


def fetch_windows(missing: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    """Contiguous missing times as (from, to) windows."""
    rows = missing.withColumn("_new", flag(F.coalesce(seconds_since(series) != seconds, F.lit(True))))
    rows = rows.withColumn("_id", F.sum("_new").over(series.cum()))
    return rows.groupBy(*series.keys, "_id").agg(F.min(series.ts).alias("from_ts"), F.max(series.ts).alias("to_ts")).drop("_id")


def staleness(df: DataFrame, now: Column, series: Series = BARS) -> DataFrame:
    return df.groupBy(*series.keys).agg((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max(series.ts).cast("timestamp"))).alias("seconds_stale"))


def issues(df: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    """(keys, time, issue): what is wrong with each row, a row for each finding."""
    prices = [c for c in (*OHLC, "volume") if c in df.columns]
    here, all_ = Window.partitionBy(*series.keys, series.ts), F.struct(*prices)
    ok = F.coalesce(both([F.col("low") <= F.col("open"), F.col("low") <= F.col("close"), F.col("open") <= F.col("high"), F.col("close") <= F.col("high"), F.col("low") <= F.col("high")]), F.lit(False))
    rules = {
        "duplicate": F.count(F.lit(1)).over(here) > 1, "conflict": F.min(all_).over(here) != F.max(all_).over(here), "zero": F.expr(" or ".join(f"{c} = 0" for c in OHLC)),
        "inconsistent": ~ok, "gap_before": seconds_since(series) > seconds,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("_found", found).select(*series.keys, series.ts, F.explode("_found").alias("issue"))


def quality(df: DataFrame, seconds: int, series: Series = BARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, report, issues): without repetitions and without rows whose prices conflict, are zero or contradict each other; counts for each series; what is wrong with each row."""
    rows, _ = dedupe(df, series)
    prices = [c for c in (*OHLC, "volume") if c in df.columns]
    here, all_ = Window.partitionBy(*series.keys, series.ts), F.struct(*prices)
    ok = both([F.col("low") <= F.col("open"), F.col("low") <= F.col("close"), F.col("open") <= F.col("high"), F.col("close") <= F.col("high")] + [F.col(c) != 0 for c in OHLC])
    clean = rows.withColumn("_differ", F.min(all_).over(here) != F.max(all_).over(here)).where(~F.col("_differ") & ok).drop("_differ")
    return clean, report(df, seconds, series), issues(df, seconds, series)


def require_complete(df: DataFrame, seconds: int, series: Series = BARS) -> None:
    """Raises unless every series starts with that step, has no other, and so has no gaps."""
    wrong = infer_seconds(df, series).where(F.col("seconds") != seconds).limit(1).count()
    if wrong:
        raise ValueError(f"bars are not {seconds} seconds apart")
    require_homogeneous(df, series)
    if gaps(df, seconds, series).limit(1).count():
        raise ValueError("bars have gaps")
