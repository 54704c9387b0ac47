"""Coarser bars, phase-shifted bars, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .gaps import require_complete
from .reduce import with_bucket
from .series import BARS, Series


def from_events(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of event values for each event type; ties in time are ordered by event_id."""
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("tz_start")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("num_trades")
    )


def _bars(df: DataFrame, by: list[str], series: Series) -> DataFrame:
    order = F.struct(series.ts, *series.tie)
    made = df.groupBy(*series.keys, *by).agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))
    return made.dropna(subset=["open", "high", "low", "close", "volume"])


def resample(df: DataFrame, seconds: int, series: Series = BARS) -> DataFrame:
    """Bars of a coarser size, counted from the midnight of the series' first day; incomplete bars are left out."""
    return _bars(with_bucket(df, seconds, "bucket", series), ["bucket"], series).withColumnRenamed("bucket", series.ts).withColumn("candle_seconds", F.lit(seconds))


def resample_all(df: DataFrame, sizes, series: Series = BARS) -> dict[int, DataFrame]:
    return {s: resample(df, s, series) for s in sizes}


def offset_bars(df: DataFrame, period: int, unit_seconds: int, series: Series = BARS) -> DataFrame:
    """Bars of period units in each of their period alignments: times are shifted forward by the offset first."""
    rows = df.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(period - 1))))
    shifted = F.timestamp_micros(F.unix_micros(F.col(series.ts).cast("timestamp")) + F.col("offset").cast("long") * unit_seconds * 1_000_000)
    own = Series((*series.keys, "offset"), series.ts, series.tie)
    return _bars(with_bucket(rows.withColumn(series.ts, shifted), period * unit_seconds, "bucket", own), ["bucket"], own)


def union_granularities(frames: dict[tuple[int, str], DataFrame], column: str = "granularity") -> DataFrame:
    """Frames of several bar sizes, told apart by a count and a label such as 5m."""
    made = [df.withColumns({f"{column}_n": F.lit(n), column: F.lit(f"{n}{u}")}) for (n, u), df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def union_distinct(frames, order) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).dropDuplicates().orderBy(*order)


def generate(df: DataFrame, sizes, base_seconds: int = 60, series: Series = BARS) -> dict[int, DataFrame]:
    """Bars of coarser sizes from complete bars of base_seconds; raises where these have another step, several steps or gaps, or a size is no multiple."""
    if bad := [s for s in sizes if s % base_seconds]:
        raise ValueError(f"not multiples of {base_seconds}: {bad}")
    require_complete(df, base_seconds, series)
    return resample_all(df, sizes, series)
