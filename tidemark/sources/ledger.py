"""The ledger of raw slices: what is expected, what has come, what it holds, what is wrong."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import files

# States of a slice, and the state that a reason stands for where the fetch succeeded or failed.
STATUSES = ("missing", "complete", "partial", "empty", "needs_refresh", "failed", "in_progress")
AFTER_SUCCESS = {"none": "complete", "historical_sparsity": "complete", "still_forming": "partial", "awaiting_upstream": "partial"}
AFTER_FAILURE = {"http_error": "failed", "exception": "failed", "network_unavailable": "failed"}


def split_key(c: str | Column = "slice_key") -> dict[str, Column]:
    parts = F.split(F.col(c) if isinstance(c, str) else c, ":")
    return {"symbol": F.get(parts, F.lit(0)), "interval": F.get(parts, F.lit(1)), "start_ms": F.get(parts, F.lit(2)).try_cast("long"), "limit": F.get(parts, F.lit(3)).try_cast("int")}


def slice_hash(key: str) -> str:
    return hashlib.blake2b(key.encode(), digest_size=16).hexdigest()


def current_slice(start: int, now: int, span: int) -> int:
    """The start of the slice of span ms that now falls in."""
    return start + (now - start) // span * span


def classify(expected: DataFrame, ledger: DataFrame, current: str | None = None) -> DataFrame:
    """Each expected slice with its status; the current one is always partial."""
    state = F.when(F.col("slice_key") == F.lit(current), "partial") if current else F.lit(None)
    joined = expected.join(ledger.select("slice_key", F.col("status").alias("_s")), "slice_key", "left")
    return joined.withColumn("status", F.coalesce(state, F.when(F.col("_s").isNull(), "missing").when(F.col("_s").isin(*STATUSES), F.col("_s")).otherwise("needs_refresh"))).drop("_s")


def integrity(bars: DataFrame, step: int, expected: int, now: int, key: str = "slice_key", t: str = "open_time") -> DataFrame:
    """Counts, deltas and gaps of each slice, its status, and the reason if it is not complete (times in ms)."""
    w = Window.partitionBy(key).orderBy(t)
    rows = bars.select(key, t).distinct().withColumn("_d", F.col(t) - F.lag(t).over(w))
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), F.min("_d").alias("min_delta"), F.max("_d").alias("max_delta"), F.count_if(F.col("_d") > step).alias("n_gaps"))
    span = step * expected
    reason = (
        F.when(F.col("n") == expected, None).when(F.col("n_gaps") > 0, "historical_sparsity").when(F.col("first") + span > now, "still_forming")
        .when(F.lit(now) - F.col("last") > 2.5 * span, "historical_sparsity").otherwise("awaiting_upstream")
    )
    return per.withColumns({"status": F.when(F.col("n") == expected, "complete").otherwise("partial"), "reason": reason})


def apply_deltas(ledger: DataFrame, deltas: DataFrame, key: str = "slice_key", seq: str = "seq") -> DataFrame:
    """The last word on each key; deltas come after the ledger."""
    rest = [c for c in ledger.columns if c != key]
    both = ledger.withColumn(seq, F.lit(-1).cast("long")).unionByName(deltas)
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}") for c in rest])


def seed(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    new = expected.join(ledger, "slice_key", "left_anti").select("slice_key", F.lit("missing").alias("status"))
    return ledger.unionByName(new, allowMissingColumns=True)


def summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("slices"))


def violations(ledger: DataFrame, step: int, limit: int) -> DataFrame:
    """(rule, slice_key, message): malformed keys, other limits, starts off the grid, keys that contradict their request."""
    rows = ledger.withColumns({f"_{k}": c for k, c in split_key().items()})
    asked = F.regexp_extract("query", r"startTime=(\d+)", 1).try_cast("long") if "query" in ledger.columns else F.col("_start_ms")
    w = Window.partitionBy("_symbol", "_interval").orderBy("_start_ms")
    delta = F.col("_start_ms") - F.lag("_start_ms").over(w)
    rules = {"key": F.col("_start_ms").isNull() | F.col("_limit").isNull(), "limit": F.col("_limit") != limit, "request": F.coalesce(asked, F.lit(-1)) != F.col("_start_ms"), "spacing": delta % (step * limit) != 0}
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(f"{n} rule broken").alias("message"))) for n, c in rules.items()]))
    return rows.withColumn("_v", found).select("slice_key", F.explode("_v").alias("v")).select("v.rule", "slice_key", "v.message")


def files_against_ledger(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Keys that only one of both has."""
    a = ledger.join(files, "slice_key", "left_anti").select("slice_key", F.lit("file_missing").alias("rule"))
    return a.unionByName(files.join(ledger, "slice_key", "left_anti").select("slice_key", F.lit("not_in_ledger").alias("rule")))


def backoff(previous: float, first: float = 30, most: float = 900, factor: float = 2) -> float:
    return first if previous <= 0 else min(most, previous * factor)


# When a ledger's deltas are folded into a new snapshot.
EVENTS, SECONDS, BYTES = 5, 120, 100 * 1024 * 1024


def due(events: int, seconds: float, size: int) -> bool:
    """Whether deltas are enough, old enough or large enough for a new snapshot; never without any."""
    return events > 0 and (events >= EVENTS or seconds >= SECONDS or size >= BYTES)


def compact(spark: SparkSession, snapshot: str, deltas: DataFrame, key: str = "slice_key", seq: str = "seq") -> DataFrame:
    """A new snapshot with the last word of the deltas, put in place of the old one; the ledger as it then is."""
    files.recover(spark, snapshot)
    old = spark.read.parquet(snapshot)
    files.write(apply_deltas(old, deltas, key, seq), f"{snapshot}.new.parquet")
    files.rename(spark, f"{snapshot}.new.parquet", snapshot)
    return spark.read.parquet(snapshot)


def status_of(reason: str, succeeded: bool = True) -> str:
    """The state that a reason stands for; raises on one that cannot be."""
    known = AFTER_SUCCESS if succeeded else AFTER_FAILURE
    if reason not in known:
        raise ValueError(f"{reason} is no reason of a fetch that {'succeeded' if succeeded else 'failed'}")
    return known[reason]


def by_elapsed_time(expected: DataFrame, bars: DataFrame, step: int, now: int, t: str = "open_time") -> DataFrame:
    """For markets that close: expected slices (slice_key, start_ms, last_ms) with n, first, last, status and reason; one is complete once its last bar's time is over, however few bars it has."""
    own = bars.groupBy("slice_key").agg(F.countDistinct(t).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    out = expected.join(own, "slice_key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    over = F.col("last_ms") + step <= now
    reason = F.when(~over, "still_forming").when(F.col("n") == 0, "historical_sparsity").otherwise("none")
    return out.withColumns({"status": F.when(over, "complete").otherwise("partial"), "reason": reason})


def facts(ledger: DataFrame) -> DataFrame:
    """What key, entry and request say of each slice (symbol, interval, start, limit), and whether all agree; entry columns and query may be missing."""
    own = split_key()
    asked = {"symbol": r"[?&]symbol=([^&]*)", "interval": r"[?&]interval=([^&]*)", "start_ms": r"[?&]startTime=([0-9]+)", "limit": r"[?&]limit=([0-9]+)"}
    out, agree = ledger, F.lit(True)
    for name, c in own.items():
        out = out.withColumn(f"key_{name}", c)
        for side, other in (("entry", F.col(name).cast("string") if name in ledger.columns else None), ("query", F.nullif(F.regexp_extract("query", asked[name], 1), F.lit("")) if "query" in ledger.columns else None)):
            if other is not None:
                out = out.withColumn(f"{side}_{name}", other)
                agree = agree & F.coalesce(F.col(f"{side}_{name}") == F.col(f"key_{name}").cast("string"), F.lit(False))
    return out.withColumn("agree", agree & F.coalesce(F.col("key_start_ms").isNotNull(), F.lit(False)))
