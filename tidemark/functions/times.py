"""Times as numbers and names: epochs, intervals, frequencies."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

# Units of bar sizes.
SECONDS = {"s": 1, "m": 60, "h": 3600, "D": 86400}
NAMES = {"second": "s", "minute": "m", "hour": "h", "day": "D", "min": "m", "sec": "s", "d": "D", "H": "h", "T": "m", "S": "s"}


@dataclass(frozen=True)
class TimeFreq:
    n: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> TimeFreq:
        m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", text)
        unit = m and (m[2] if m[2] in SECONDS else NAMES.get(m[2]) or NAMES.get(m[2].rstrip("s")))
        if not unit:
            raise ValueError(f"not a frequency: {text}")
        return cls(int(m[1] or 1), unit)

    @property
    def seconds(self) -> int:
        return self.n * SECONDS[self.unit]

    def __str__(self) -> str:
        return f"{self.n}{self.unit}"


def interval_ms(text: str) -> int:
    return TimeFreq.parse(text).seconds * 1000


def to_utc(c: Column, kind: str) -> Column:
    """A UTC time from a time, epoch seconds or milliseconds (told apart by size), or strict text."""
    if kind.startswith("timestamp"):
        return c.cast("timestamp")
    if kind in ("bigint", "int", "double"):
        return F.when(F.abs(c) > 10**12 - 1, F.timestamp_millis(c.cast("long"))).otherwise(F.timestamp_seconds(c))
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def with_utc(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, to_utc(F.col(column), dict(df.dtypes)[column]))


def with_utc_seconds(df: DataFrame, epoch: str, out: str) -> DataFrame:
    return df.withColumn(out, F.timestamp_seconds(F.floor(epoch)))


def not_drifted(c: Column) -> Column:
    """The time, or an error before 2000, as from a wrong epoch unit."""
    return F.when(F.year(c) < 2000, F.raise_error(F.lit("time before 2000")).cast("timestamp")).otherwise(c)


def floor_to(c: Column, step: int) -> Column:
    return F.floor(c / step) * step


def whole_intervals(start: Column, end: Column, step: int) -> Column:
    return F.floor((end - start) / step)


def exact_intervals(start: Column, end: Column, step: int) -> Column:
    return (end - start) / step


def now_utc() -> datetime:
    return datetime.now(timezone.utc)


def iso(t: datetime) -> str:
    """Seconds and a Z; a time without zone is taken as UTC."""
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_iso(text: str) -> datetime:
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def span_text(seconds: float) -> str:
    """1d 2h 3m 4s, without leading zeros."""
    left, out = int(abs(seconds)), []
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n, left = divmod(left, size)
        if n or out or unit == "s":
            out.append(f"{n}{unit}")
    return "-" * (seconds < 0) + " ".join(out)
