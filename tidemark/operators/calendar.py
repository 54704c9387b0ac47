"""Calendar, session and event predicates over UTC times, and filters and labels made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import both, either


def _ts(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_year(ts, year: int) -> Column:
    return F.year(_ts(ts)) == year


def in_quarter(ts, year: int, quarter: int) -> Column:
    if quarter not in (1, 2, 3, 4):
        raise ValueError("quarter must be 1 to 4")
    return in_year(ts, year) & (F.quarter(_ts(ts)) == quarter)


def in_month(ts, year: int, month: int) -> Column:
    return in_year(ts, year) & (F.month(_ts(ts)) == month)


def in_month_of_year(ts, months) -> Column:
    return F.month(_ts(ts)).isin(*months)


def in_week_of_year(ts, year: int, week: int) -> Column:
    """ISO year and week."""
    return (F.extract(F.lit("YEAROFWEEK"), _ts(ts)) == year) & (F.weekofyear(_ts(ts)) == week)


def in_day_of_week(ts, days) -> Column:
    """Monday is 0."""
    return F.weekday(_ts(ts)).isin(*days)


def in_hour_of_day(ts, hours) -> Column:
    return F.hour(_ts(ts)).isin(*hours)


def in_minute_of_hour(ts, minutes) -> Column:
    return F.minute(_ts(ts)).isin(*minutes)


def between(ts, start: Column, end: Column) -> Column:
    """start <= ts < end."""
    return (_ts(ts) >= start) & (_ts(ts) < end)


def last_n_days(ts, n: int, now: Column) -> Column:
    return (_ts(ts) >= now - F.make_dt_interval(days=F.lit(n))) & (_ts(ts) <= now)


def to_date_of(ts, unit: str, now: Column) -> Column:
    """From the start of now's year or month to now."""
    return (_ts(ts) >= F.date_trunc(unit, now)) & (_ts(ts) <= now)


def with_calendar_labels(df: DataFrame, ts: str, minute: bool = False) -> DataFrame:
    c = F.col(ts)
    labels = {"year": F.year(c), "quarter": F.quarter(c), "month": F.month(c), "dow": F.weekday(c), "hour": F.hour(c)}
    return df.withColumns(labels | ({"minute": F.minute(c)} if minute else {}))


def in_session(ts, start: str, end: str, tz: str) -> Column:
    """Local time of day in [start, end), past midnight where start >= end."""
    local = F.from_utc_timestamp(_ts(ts).cast("timestamp"), tz)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    a, b = (sum(int(x) * k for x, k in zip(t.split(":"), (3600, 60), strict=True)) for t in (start, end))
    return (second >= a) & (second < b) if a < b else (second >= a) | (second < b)


# Session hours in local time.
SESSIONS = {
    "ny_cash": ("09:30", "16:00", "America/New_York"),
    "ny_premarket": ("04:00", "09:30", "America/New_York"),
    "ny_afterhours": ("16:00", "20:00", "America/New_York"),
    "frankfurt": ("09:00", "17:00", "Europe/Berlin"),
    "london": ("08:00", "16:30", "Europe/London"),
    "tokyo": ("09:00", "15:00", "Asia/Tokyo"),
}


def session(ts, name: str) -> Column:
    if name == "ny_extended":
        return session(ts, "ny_premarket") | session(ts, "ny_cash") | session(ts, "ny_afterhours")
    if name == "london_ny_overlap":
        return session(ts, "london") & in_session(ts, "08:00", "17:00", "America/New_York")
    return in_session(ts, *SESSIONS[name])


def with_session_marks(df: DataFrame, ts: str, names=(*SESSIONS, "ny_extended", "london_ny_overlap")) -> DataFrame:
    return df.withColumns({f"in_{n}": session(ts, n) for n in names})


def windows_around(events: DataFrame, ts: str, before: int = 0, after: int = 0) -> DataFrame:
    """(event_id, from_ts, to_ts) about each event, seconds before and after."""
    d = lambda s: F.make_dt_interval(secs=F.lit(s))
    return events.select("event_id", (F.col(ts) - d(before)).alias("from_ts"), (F.col(ts) + d(after)).alias("to_ts"))


def mark_around(df: DataFrame, ts: str, windows: DataFrame, key: list[str], out: str = "event_id", span: int = 86400) -> DataFrame:
    """The smallest event whose closed window holds the row's time, null without one.

    Windows are cut at multiples of span seconds, so that the range join is an equi-join on the
    slice; each row of df (told apart by key) gets one event.
    """
    slice_ = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / span)
    cut = windows.withColumn("slice_", F.explode(F.sequence(slice_("from_ts"), slice_("to_ts")))).withColumnRenamed("event_id", "found_")
    near = df.select(*key, ts).withColumn("slice_", slice_(ts)).join(cut, "slice_").where(F.col(ts).between(F.col("from_ts"), F.col("to_ts")))
    first = near.groupBy(*key).agg(F.min("found_").alias(out))
    return df.join(first, key, "left")


def around(df: DataFrame, ts: str, windows: DataFrame, key: list[str], out: str = "event_id") -> DataFrame:
    return mark_around(df, ts, windows, key, out).where(F.col(out).isNotNull())


def before_anchors(df: DataFrame, ts: str, events: DataFrame, seconds: int, key: list[str], at: str = "ts", out: str = "event_id") -> DataFrame:
    """The rows in the seconds up to an event."""
    return around(df, ts, windows_around(events, at, seconds, 0), key, out)


def after_anchors(df: DataFrame, ts: str, events: DataFrame, seconds: int, key: list[str], at: str = "ts", out: str = "event_id") -> DataFrame:
    """The rows in the seconds from an event on."""
    return around(df, ts, windows_around(events, at, 0, seconds), key, out)


def where_all(df: DataFrame, conditions) -> DataFrame:
    return df.where(both(list(conditions)))


def where_any(df: DataFrame, conditions) -> DataFrame:
    return df.where(either(list(conditions)))


def combine_events(*lists: DataFrame, key: str = "ts") -> DataFrame:
    """Of rows of one key that of the first list stays, within a list the smallest."""
    out = None
    for k, x in enumerate(lists):
        own = x.withColumn("_list", F.lit(k))
        out = own if out is None else out.unionByName(own)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_list", *lists[0].columns))
    return out.withColumn("_nth", first).where("_nth = 1").drop("_list", "_nth")
