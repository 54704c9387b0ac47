"""One long series over many tasks: blocks of consecutive rows, and what a block needs of its neighbours.

A plain window makes one task of a whole series.  Here each row first gets its position in its
series: rows are numbered within slices of time, and the slices' counts, a small table, are added up.
Blocks are equal ranges of positions, so that neither busy days nor gaps make them uneven.  A window
over so many rows before and after is exact where a block also holds copies of them (in_blocks);
a running value is that of the block joined with the blocks' totals before it (with_running).
Both cost an exchange for the positions and one for the blocks, where a plain window has one, and are meant for
series too long for a task.

Defined cases: rows that tie in time and tie columns are ordered by a hash of their other columns (maps
left out); rows that are equal in all of them are interchangeable; a null key is a key, null times come first; an empty
table gives no rows.  A slice of time is one task: slice_seconds is to be small enough for the busiest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from .conditions import false_if_null
from .series import BARS, FIRST, HERE, Series, flag

ROWS, SLICE_SECONDS = 1 << 20, 86_400
OWN = ("_slice", "_row", "_lead", "_of", "_pos", "_at", "_mine")
CARRIED = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def deal(df: DataFrame, series: Series = BARS, rows: int = ROWS, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """df with _pos, each row's position in its series from 0, and _at, its series and block of rows."""
    if rows < 1 or slice_seconds <= 0:
        raise ValueError("blocks and slices must be longer than nothing")
    if clash := sorted({*OWN} & {*df.columns}):
        raise ValueError(f"columns exist: {clash}")
    kinds = dict(df.dtypes)
    at = F.unix_micros(F.col(series.ts).cast("timestamp")) / 1_000_000 if kinds[series.ts].startswith(("timestamp", "date")) else F.col(series.ts)
    rest = [c for c, t in df.dtypes if c not in (*series.keys, series.ts, *series.tie) and "map<" not in t and t != "variant"]
    sliced = df.withColumn("_slice", F.struct(*series.keys, F.floor(at / slice_seconds).alias("_n")))
    order = [series.ts, *series.tie, *([F.xxhash64(*rest)] if rest else [])]
    numbered = sliced.withColumn("_row", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1)
    keys = [F.col("_slice")[k] for k in series.keys]
    earlier = Window.partitionBy(*keys).orderBy(F.col("_slice")["_n"]).rowsBetween(FIRST, -1)
    counts = sliced.groupBy("_slice").count()
    lead = counts.select(F.col("_slice").alias("_of"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_lead"))
    out = numbered.join(lead, F.col("_slice") == F.col("_of")).withColumn("_pos", F.col("_lead") + F.col("_row"))
    return out.withColumn("_at", F.struct(*series.keys, F.floor(F.col("_pos") / rows).alias("_block"))).drop("_slice", "_of", "_lead", "_row")


def in_blocks(df: DataFrame, run, before: int = 0, after: int = 0, series: Series = BARS, rows: int = ROWS, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """run(df, series), which adds columns to rows, over each block with the rows before and after it that its windows read.

    Exact for windows of so many rows; with_ewm and what is built of it come as close as its weight after before rows is small.
    """
    rows = max(rows, before, after)
    dealt = deal(df, series, rows, slice_seconds)
    block, place = F.col("_at._block"), F.col("_pos") % rows
    blocks = F.array(block, F.when(place >= rows - before, block + 1), F.when((place < after) & (block > 0), block - 1))
    dealt = dealt.withColumn("_block", block).withColumn("_to", F.explode(F.filter(blocks, lambda b: b.isNotNull())))
    dealt = dealt.withColumns({"_mine": F.col("_to") == F.col("_block"), "_at": F.struct(*series.keys, F.col("_to").alias("_block"))}).drop("_to", "_block")
    return run(dealt, replace(series, keys=("_at",), tie=(*series.tie, "_pos"))).where("_mine").drop("_mine", "_at", "_pos")


@dataclass(frozen=True)
class Running:
    """A running value: what is carried from block to block (sum, count, max, min or last value that is not null, of expressions that may read _pos), and what is made of it."""

    carried: dict[str, tuple[str, Column]]
    made: Callable[..., Column]


def so_far(kind: str, c: Column) -> Running:
    if kind not in (*CARRIED, "last"):
        raise ValueError(f"cannot be carried: {kind}")
    return Running({"it": (kind, c)}, lambda it: it)


def running_true(column: str) -> Running:
    """That of conditions.with_running_true."""
    c, pos = false_if_null(F.col(column)), F.col("_pos")
    return Running({"broke": ("last", F.when(~c, pos))}, lambda broke: F.when(c, pos - F.coalesce(broke, F.lit(-1))).otherwise(0))


def bars_since(column: str) -> Running:
    """That of conditions.with_bars_since."""
    return Running({"held": ("last", F.when(F.col(column), F.col("_pos")))}, lambda held: F.col("_pos") - held)


def vwap() -> Running:
    """That of indicators.with_vwap over whole series."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return Running({"paid": ("sum", typical * F.col("volume")), "volume": ("sum", F.col("volume"))}, lambda paid, volume: F.when(volume != 0, F.try_divide(paid, volume)))


def with_running(df: DataFrame, values: dict[str, Running], series: Series = BARS, rows: int = ROWS, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """df with running values, all in one pass: rows are dealt once, however many there are.

    df is read for the positions and for the blocks' totals, so that a call on the result of another doubles
    the plan: ask for all values at once, or write a table in between.
    """
    dealt = deal(df, series, rows, slice_seconds)
    here = Window.partitionBy("_at").orderBy("_pos").rowsBetween(FIRST, HERE)
    earlier = Window.partitionBy(*[F.col("_at")[k] for k in series.keys]).orderBy(F.col("_at")["_block"]).rowsBetween(FIRST, -1)
    own, whole, carry, made = {}, [], [], {}
    for i, (out, value) in enumerate(values.items()):
        parts = {}
        for name, (kind, c) in value.carried.items():
            at, all_, was = (f"_{x}_{i}_{name}" for x in ("own", "all", "was"))
            if kind == "last":
                own[at] = F.last(c, ignorenulls=True).over(here)
                whole.append(F.max_by(c, F.when(c.isNotNull(), F.col("_pos"))).alias(all_))
                before, parts[name] = F.last(all_, ignorenulls=True), F.coalesce(at, was)
            else:
                own[at] = CARRIED[kind](c).over(here)
                whole.append(CARRIED[kind](c).alias(all_))
                added = F.coalesce(F.col(at) + F.col(was), at, was)
                before, parts[name] = {**CARRIED, "count": F.sum}[kind](all_), {"max": F.greatest(at, was), "min": F.least(at, was)}.get(kind, added)
            carry.append(before.over(earlier).alias(was))
        made[out] = value.made(**parts)
    totals = dealt.groupBy("_at").agg(*whole).select(F.col("_at").alias("_of"), *carry)
    out = dealt.withColumns(own).join(totals, F.col("_at") == F.col("_of"))
    return out.withColumns(made).select(*df.columns, *[n for n in values if n not in df.columns])


def with_group_id(df: DataFrame, condition: str, out: str, **blocks) -> DataFrame:
    """conditions.with_group_id over blocks."""
    c = false_if_null(F.col(condition))
    marked = in_blocks(df, lambda rows, series: rows.withColumn("_start", flag(c & ~F.coalesce(series.lag(c), F.lit(False)))), 1, **blocks)
    return with_running(marked, {out: so_far("sum", F.col("_start"))}, **blocks).withColumn(out, F.when(c, F.col(out))).drop("_start")
