"""Rolling, expanding and recursive indicators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .relations import true_range
from .series import BARS, Series, value


def rolling(aggregate, column, n: int, series: Series = BARS, least: int | None = None) -> Column:
    """An aggregate of the last n rows, null with fewer than least (n) values among them."""
    c = value(column)
    w = series.last(n)
    return F.when(F.count(c).over(w) >= (n if least is None else least), aggregate(c).over(w))


def with_sma(df: DataFrame, column: str, n: int, name: str | None = None, least: int | None = None, decimals: int | None = None, series: Series = BARS) -> DataFrame:
    mean = rolling(F.avg, column, n, series, least)
    return df.withColumn(name or f"{column}_sma_{n}", mean if decimals is None else F.bround(mean, decimals))


def with_arp(df: DataFrame, n: int, name: str | None = None, series: Series = BARS) -> DataFrame:
    """Mean range in percent of the open."""
    span = F.try_divide(F.col("high") - F.col("low"), F.col("open")) * 100
    return df.withColumn(name or f"arp_{n}", rolling(F.avg, span, n, series))


def with_ewm(df: DataFrame, column: str, alpha: float, out: str, series: Series = BARS) -> DataFrame:
    """y[0] = x[0], y[t] = (1 - alpha) y[t - 1] + alpha x[t]; leading nulls are skipped, inner ones are left out of the recursion.

    Values are summed with weights within blocks of rows so long that what a block hands to
    the one after the next is below 1e-16 of it; two windows carry the rest over.
    All in the JVM, with the series' own exchange and sort.
    """
    q = 1 - alpha
    if q <= 0:
        return df.withColumn(out, F.col(column))
    block = max(2, math.ceil(18.5 / -math.log(q)))
    x = F.col(column)
    df = df.withColumn("_i", F.when(x.isNotNull(), F.count(x).over(series.cum()) - 1))
    df = df.withColumns({"_b": F.floor(F.col("_i") / block), "_j": F.col("_i") % block})
    weight = lambda n: F.pow(F.lit(q), n)
    df = df.withColumn("_u", F.when(F.col("_i") == 0, x).otherwise(alpha * x) * weight(-F.col("_j")))
    df = df.withColumn("_local", weight(F.col("_j")) * F.sum("_u").over(series.cum("_b")))
    full = F.col("_j") == block - 1
    df = df.withColumn("_end", F.last(F.when(full, F.col("_local")), ignorenulls=True).over(series.before()))
    df = df.withColumn("_end", F.last(F.when(full, F.col("_local") + q**block * F.coalesce("_end", F.lit(0.0))), ignorenulls=True).over(series.before()))
    return df.withColumn(out, F.when(x.isNotNull(), F.col("_local") + weight(F.col("_j") + 1) * F.coalesce("_end", F.lit(0.0)))).drop("_i", "_b", "_j", "_u", "_local", "_end")


def with_atr(df: DataFrame, n: int = 14, name: str | None = None, series: Series = BARS) -> DataFrame:
    """Wilder's average true range: the mean of the first n, then (previous * (n - 1) + true range) / n."""
    df = df.withColumns({"_tr": true_range(series), "_row": F.row_number().over(series.over())})
    df = df.withColumn("_seed", F.when(F.col("_row") == n, F.avg("_tr").over(series.last(n))).when(F.col("_row") > n, F.col("_tr")))
    return with_ewm(df, "_seed", 1 / n, name or f"atr_{n}", series).drop("_tr", "_row", "_seed")


def with_bollinger(df: DataFrame, column: str = "close", n: int = 20, k: float = 2.0, prefix: str = "boll", series: Series = BARS) -> DataFrame:
    least = n // 2
    df = df.withColumns({f"{prefix}_mid": rolling(F.avg, column, n, series, least), "_sd": rolling(F.stddev_pop, column, n, series, least), f"{prefix}_valid": F.row_number().over(series.over()) >= n})
    return df.withColumns({f"{prefix}_upper": F.col(f"{prefix}_mid") + k * F.col("_sd"), f"{prefix}_lower": F.col(f"{prefix}_mid") - k * F.col("_sd")}).drop("_sd")


def with_macd(df: DataFrame, column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, series: Series = BARS) -> DataFrame:
    df = with_ewm(df, column, 2 / (fast + 1), "ema_fast", series)
    df = with_ewm(df, column, 2 / (slow + 1), "ema_slow", series)
    df = df.withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    df = with_ewm(df, "macd", 2 / (signal + 1), "macd_signal", series)
    row = F.row_number().over(series.over())
    return df.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "macd_ready": row >= slow, "macd_signal_ready": row >= slow + signal})


def with_rsi(df: DataFrame, column: str = "close", n: int = 14, name: str | None = None, series: Series = BARS) -> DataFrame:
    """Wilder's relative strength; null for the first n rows and without losses."""
    df = df.withColumn("_d", F.col(column) - series.lag(column))
    df = df.withColumns({"_up": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), "_down": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))})
    df = with_ewm(with_ewm(df, "_up", 1 / n, "_gain", series), "_down", 1 / n, "_loss", series)
    ready = F.count("_d").over(series.cum()) >= n
    strength = F.try_divide("_gain", F.when(F.col("_loss") != 0, F.col("_loss")))
    return df.withColumn(name or f"rsi_{n}", F.when(ready, 100 - 100 / (1 + strength))).drop("_d", "_up", "_down", "_gain", "_loss")


def with_vwap(df: DataFrame, group: str | None = None, name: str = "vwap", series: Series = BARS) -> DataFrame:
    """Cumulative volume-weighted (high + low + close) / 3, over the series or its groups; null while there is no volume."""
    parts = (group,) if group else ()
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    paid, volume = F.sum(typical * F.col("volume")).over(series.cum(*parts)), F.sum("volume").over(series.cum(*parts))
    return df.withColumn(name, F.when(volume != 0, F.try_divide(paid, volume)))


def session_day(ts: str, tz: str = "UTC") -> Column:
    """The local calendar day of a UTC time."""
    return F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz))


def with_session_vwap(df: DataFrame, tz: str = "UTC", name: str = "vwap_session", series: Series = BARS) -> DataFrame:
    return with_vwap(df.withColumn("_day", session_day(series.ts, tz)), "_day", name, series).drop("_day")


def with_angle(df: DataFrame, column: str, n: int, log: bool = True, degrees: bool = True, series: Series = BARS) -> DataFrame:
    x = F.when(F.col(column) > 0, F.log(column)) if log else F.col(column)
    angle = F.atan((x - series.lag(x, n)) / n)
    return df.withColumn(f"{column}_angle_{n}", F.degrees(angle) if degrees else angle)


def with_distance_z(df: DataFrame, column: str, n: int = 200, population: bool = True, name: str | None = None, series: Series = BARS) -> DataFrame:
    """x over its rolling standard deviation (the mean is not taken off)."""
    sd = rolling(F.stddev_pop if population else F.stddev_samp, column, n, series, max(5, n // 5))
    return df.withColumn(name or f"{column}_z", F.try_divide(F.col(column), F.when(sd != 0, sd)))


def with_expanding(df: DataFrame, column: str, series: Series = BARS) -> DataFrame:
    return df.withColumns({f"{column}_mean_so_far": F.avg(column).over(series.cum()), f"{column}_max_so_far": F.max(column).over(series.cum())})


def rolling_quantile(column: str, share: float, n: int, series: Series = BARS) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(share)), column, n, series)


INDICATORS = {"sma": with_sma, "arp": with_arp, "rsi": with_rsi, "atr": with_atr, "bollinger": with_bollinger, "macd": with_macd, "vwap": with_vwap}


def apply_indicator(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in INDICATORS:
        raise ValueError(f"unknown indicator {name}; there are {sorted(INDICATORS)}")
    return INDICATORS[name](df, **options)
