"""Incremental bars: file streams, upserts, overlap and splice, alerts, replay."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.series import BARS, Series
from ..sources.ledger import backoff
from ..sources.raw_bars import KLINE, SLICE, explode_slices


@dataclass(frozen=True)
class Pipeline:
    """A transform of clean bars, and how many rows before a row it reads (at most); incremental only if its ids do not depend on all earlier rows."""

    run: Callable[[DataFrame], DataFrame]
    overlap: int
    incremental_safe: bool = True


def slice_stream(spark: SparkSession, path: str, fields=KLINE, files_per_batch: int = 100) -> DataFrame:
    """New raw slices as they arrive."""
    raw = spark.readStream.schema(SLICE).option("maxFilesPerTrigger", files_per_batch).option("multiLine", True).json(path)
    return explode_slices(raw, fields)


def deduplicated(bars: DataFrame, lag: str = "1 day", series: Series = BARS) -> DataFrame:
    return bars.withWatermark(series.ts, lag).dropDuplicatesWithinWatermark([*series.keys, series.ts])


def sealed(bars: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends to Parquet by the streaming commit log."""
    out = bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def recompute(pipeline: Pipeline, clean: DataFrame, since, series: Series = BARS) -> DataFrame:
    """The pipeline's rows after a time, from that stretch and the overlap rows before it."""
    if not pipeline.incremental_safe:
        return pipeline.run(clean).where(F.col(series.ts) > since)
    old = clean.where(F.col(series.ts) <= since)
    near = old.withColumn("_r", F.row_number().over(series.over().orderBy(F.col(series.ts).desc(), *series.tie))).where(F.col("_r") <= pipeline.overlap).drop("_r")
    return pipeline.run(near.unionByName(clean.where(F.col(series.ts) > since))).where(F.col(series.ts) > since)


def splice(old: DataFrame, new: DataFrame, since, series: Series = BARS) -> DataFrame:
    return old.where(F.col(series.ts) <= since).unionByName(new)


def parity(pipeline: Pipeline, clean: DataFrame, cuts, series: Series = BARS) -> None:
    """Raises unless replaying the bars cut by cut gives what one run gives."""
    out = None
    for cut in cuts:
        seen = clean.where(F.col(series.ts) <= cut)
        out = pipeline.run(seen) if out is None else splice(out, recompute(pipeline, seen, last, series), last, series)
        last = cut
    full = pipeline.run(clean.where(F.col(series.ts) <= last))
    if full.exceptAll(out.select(full.columns)).limit(1).count() or out.select(full.columns).exceptAll(full).limit(1).count():
        raise AssertionError("incremental and full results differ")


def holds(required, found, how: str = "ALL", n: int | None = None) -> bool:
    """Whether the required events have occurred: ALL, ANY, or N_OF_M."""
    hit = len(set(required) & set(found))
    if how == "N_OF_M":
        if n is None:
            raise ValueError("N_OF_M needs n")
        return hit >= n
    if how not in ("ALL", "ANY"):
        raise ValueError(f"unknown condition {how}")
    return hit == len(set(required)) if how == "ALL" else hit > 0


@dataclass
class AlertState:
    """When an alert may be sent again: at once, then after growing pauses, anew once it has cleared."""

    pause: float = 0.0
    next_at: float = 0.0

    def step(self, firing: bool, now: float) -> bool:
        if not firing:
            self.pause = self.next_at = 0.0
            return False
        if now < self.next_at:
            return False
        self.pause = backoff(self.pause)
        self.next_at = now + self.pause
        return True


def emit(alerts: DataFrame, outbox: str) -> None:
    """Alerts as JSON lines, appended to a folder queue."""
    alerts.write.mode("append").json(outbox)


def validate_triggers(registry: dict, active, outboxes) -> None:
    """Raises on triggers that are unknown or whose outbox is."""
    for name in active:
        if name not in registry:
            raise KeyError(f"unknown trigger {name}")
        if registry[name]["outbox"] not in outboxes:
            raise KeyError(f"unknown outbox {registry[name]['outbox']}")


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], ["value"]).coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict:
    from ..sources.files import names

    return json.loads(spark.read.text(path).first()[0]) if names(spark, path) else {}


def run_frames(batch: DataFrame, builders: dict, triggers: dict, outbox: str) -> None:
    """The body of foreachBatch: builds the frames that active triggers need, once each, and emits their rows."""
    made = {frame: builders[frame](batch) for frame in {t["frame"] for t in triggers.values()}}
    for name, trigger in triggers.items():
        emit(made[trigger["frame"]].where(trigger["column"]).withColumn("trigger", F.lit(name)), outbox)


class CleanProvider:
    """Rows of a pipeline over the bars of a folder: all of them each time, or the rows after the last time anew and the sealed ones from a table.

    Nothing is computed while the folder's fingerprint stays the same.
    """

    def __init__(self, spark: SparkSession, folder: str, sealed: str, pipeline: Pipeline, incremental: bool = True, series: Series = BARS):
        self.spark, self.folder, self.sealed_path, self.pipeline, self.incremental, self.series = spark, folder, sealed, pipeline, incremental, series
        self.seen = self.last = None

    def changed(self) -> bool:
        from ..sources.files import fingerprint

        return fingerprint(self.spark, self.folder) != self.seen

    def frame(self) -> DataFrame:
        """The pipeline's rows for all bars that there are now."""
        from ..sources.files import fingerprint, recover, rename, union_folder, write

        now = fingerprint(self.spark, self.folder)
        if now != self.seen:
            bars = union_folder(self.spark, self.folder)
            if self.incremental and self.last is not None:
                out = splice(self.spark.read.parquet(self.sealed_path), recompute(self.pipeline, bars, self.last, self.series), self.last, self.series)
            else:
                out = self.pipeline.run(bars)
            write(out, f"{self.sealed_path}.new.parquet")
            recover(self.spark, self.sealed_path)
            rename(self.spark, f"{self.sealed_path}.new.parquet", self.sealed_path)
            self.seen, self.last = now, self.spark.read.parquet(self.sealed_path).agg(F.max(self.series.ts)).first()[0]
        return self.spark.read.parquet(self.sealed_path)


def set_state(state: dict, path: str, value) -> dict:
    """state with a value at a dotted path."""
    head, _, rest = path.partition(".")
    return state | {head: set_state(state.get(head, {}), rest, value) if rest else value}


def refresh_head(spark: SparkSession, folder: str, rows: DataFrame, head: str = "head.parquet") -> int:
    """Rebuilds the head from its raw rows; it may only grow. Returns how many rows it has."""
    from ..sources.files import names, recover, rename, write

    path = f"{folder}/{head}"
    recover(spark, path)
    had = spark.read.parquet(path).count() if head in names(spark, folder) else 0
    write(rows, f"{folder}/.{head}.new.parquet")
    now = spark.read.parquet(f"{folder}/.{head}.new.parquet").count()
    if now < had:
        raise ValueError(f"the head would shrink from {had} to {now} rows")
    rename(spark, f"{folder}/.{head}.new.parquet", path)
    return now


def append_slices(spark: SparkSession, folder: str, new: DataFrame, per_part: int = 100, key: str = "slice_key", order: str = "open_time", head: str = "head.parquet") -> dict:
    """Adds whole slices to the head, and seals every per_part slices, in the order of their first bars, as a part of their own; returns the manifest.

    Parts are written before the head and the manifest, so that a break leaves parts that no manifest names.
    """
    from ..sources.files import names, recover, rename, write

    recover(spark, f"{folder}/{head}")
    state = load_state(spark, f"{folder}/.manifest") or {"parts": [], "head_slices": 0}
    if head in names(spark, folder):
        new = spark.read.parquet(f"{folder}/{head}").unionByName(new)
    starts = [(r[key], r["first"]) for r in new.groupBy(key).agg(F.min(order).alias("first")).collect()]  # a row for each slice of the head and one batch
    keys = [k for k, _ in sorted(starts, key=lambda x: (x[1], x[0]))]
    sealed = len(keys) // per_part * per_part
    for at in range(0, sealed, per_part):
        own, name = keys[at : at + per_part], f"part-{len(state['parts']):06d}.parquet"
        write(new.where(F.col(key).isin(own)).orderBy(order), f"{folder}/{name}")
        state["parts"].append({"name": name, "first": own[0], "last": own[-1], "slices": len(own)})
    write(new.where(F.col(key).isin(keys[sealed:])).orderBy(order), f"{folder}/.{head}.new.parquet")
    rename(spark, f"{folder}/.{head}.new.parquet", f"{folder}/{head}")
    state["head_slices"] = len(keys) - sealed
    save_state(spark, f"{folder}/.manifest", state)
    return state


def load_clean(spark: SparkSession, folder: str, seconds: int, last: int = 0, wait: float = 0, every: float = 1.0, series: Series = BARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, report, issues) of a folder's bars, or of its newest files; waits for the first file."""
    import time

    from ..operators.gaps import quality
    from ..sources.files import has_files, latest, union_folder

    until = time.monotonic() + wait
    while not has_files(spark, folder):
        if time.monotonic() >= until:
            raise FileNotFoundError(folder)
        time.sleep(every)
    return quality(latest(spark, folder, last) if last else union_folder(spark, folder), seconds, series)
