"""Legs: contiguous runs of one direction, their extents, survival and excursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .conditions import with_group_id, with_running_true
from .indicators import with_sma
from .pointwise import in_units, with_bar_direction
from .reduce import zoom
from .series import BARS, Series, false_if_null


def with_persistence(df: DataFrame, condition: Column, prefix: str, series: Series = BARS) -> DataFrame:
    """Ids, running lengths and total lengths of the runs of a condition."""
    df = df.withColumn(f"{prefix}_on", false_if_null(condition))
    df = with_group_id(df, f"{prefix}_on", f"{prefix}_leg_id", series)
    df = with_running_true(df, f"{prefix}_on", f"{prefix}_leg_run", series)
    return df.withColumn(f"{prefix}_leg_run_len", F.when(F.col(f"{prefix}_on"), F.max(f"{prefix}_leg_run").over(series.whole(f"{prefix}_leg_id"))))


def directional_legs(df: DataFrame, line: str, series: Series = BARS) -> DataFrame:
    """Rising and falling legs of a line."""
    df = with_bar_direction(df, line, 1, series)
    d = F.col(f"{line}__diff_1__direction")
    return with_persistence(with_persistence(df, d == 1, f"{line}_up", series), d == -1, f"{line}_down", series)


def sma_legs(df: DataFrame, n: int, series: Series = BARS) -> DataFrame:
    return directional_legs(with_sma(df, "open", n, decimals=6, series=series), f"open_sma_{n}", series)


def excursion(df: DataFrame, leg: str, up: bool, favourable: bool, prefix: str = "exc", series: Series = BARS) -> DataFrame:
    """How far each bar of a leg is from the leg's first open, in the favourable or adverse direction, and which bar is farthest."""
    rows = df.where(F.col(leg).isNotNull())
    whole = series.whole(leg)
    price = F.col("high") if up == favourable else F.col("low")
    rows = rows.withColumns({f"{prefix}_idx": F.row_number().over(series.over(leg)) - 1, f"{prefix}_n_bars": F.count(F.lit(1)).over(whole), f"{prefix}_open": F.first("open").over(whole)})
    start = F.col(f"{prefix}_open")
    rows = rows.withColumn(f"{prefix}_val", price - start if up else start - price)
    rows = rows.withColumn(f"{prefix}_bps", in_units(f"{prefix}_val", f"{prefix}_open", "bps"))
    best = F.col(f"{prefix}_bps") if favourable else -F.col(f"{prefix}_bps")
    # The first of the farthest; null is the smallest.
    first = F.max_by(f"{prefix}_idx", F.struct(best, -F.col(f"{prefix}_idx"))).over(whole) == F.col(f"{prefix}_idx")
    rows = rows.withColumns({f"{prefix}_is_max": first, f"{prefix}_from_start": F.col(f"{prefix}_idx"), f"{prefix}_from_end": F.col(f"{prefix}_n_bars") - 1 - F.col(f"{prefix}_idx")})
    return rows.withColumn(f"{prefix}_pct_of_leg", F.when(F.col(f"{prefix}_n_bars") > 1, F.col(f"{prefix}_from_start") / (F.col(f"{prefix}_n_bars") - 1)).otherwise(1.0))


def mfe_rows(df: DataFrame, leg: str, up: bool = True, series: Series = BARS) -> DataFrame:
    """The row of each leg's greatest favourable excursion."""
    return excursion(df, leg, up, True, "mfe", series).where("mfe_is_max")


def mfe_survival(legs: DataFrame, length: str, index: str, most: int | None = None) -> DataFrame:
    """For t = 1 .. most (the longest leg's length where none is given): legs at least t long, and the share of them whose extreme lies at t or before."""
    by = legs.groupBy(F.col(length).alias("len"), F.col(index).alias("idx")).count()
    end = F.lit(most) if most else F.coalesce(F.max("len"), F.lit(0))
    spine = by.agg(end.cast("int").alias("most")).where("most > 0").select(F.explode(F.sequence(F.lit(1), "most")).alias("t"))
    hit = by.join(F.broadcast(spine), F.col("len") >= F.col("t"))
    out = hit.groupBy("t").agg(F.sum("count").alias("survivors"), F.sum(F.when(F.col("idx") <= F.col("t"), F.col("count")).otherwise(0)).alias("reached"))
    return spine.join(out, "t", "left").select("t", F.coalesce("survivors", F.lit(0)).alias("survivors"), F.try_divide("reached", "survivors").alias("rate"))


def mfe_already_at(legs: DataFrame, length: str, index: str, t: int) -> DataFrame:
    alive = legs.where(F.col(length) >= t + 1)
    return alive.agg(F.count("*").alias("survivors"), F.avg((F.col(index) <= t).cast("double")).alias("rate"))


def line_distance(df: DataFrame, line: str, leg: str, series: Series = BARS) -> DataFrame:
    """Distance of the close from a line within each leg, and the leg's farthest row."""
    rows = df.where(F.col(leg).isNotNull()).withColumn("dist_bps", in_units(F.col("close") - F.col(line), line, "bps"))
    rows = rows.withColumn("_idx", F.row_number().over(series.over(leg)))
    farthest = F.max_by("_idx", F.struct(F.abs("dist_bps"), -F.col("_idx"))).over(series.whole(leg))
    rows = rows.withColumns({"is_max_stretch": farthest == F.col("_idx"), "_most": F.max(F.abs("dist_bps")).over(series.whole(leg))})
    return rows.withColumn("stretch_pct", F.try_divide(F.abs("dist_bps"), "_most")).drop("_most", "_idx")


def with_survival_marks(df: DataFrame, run: str, marks, prefix: str) -> DataFrame:
    """A flag for each mark: the run has just reached that length."""
    return df.withColumns({f"{prefix}_{m}_survive": false_if_null(F.col(run) == m) for m in marks})


#: Run lengths at which a leg counts as having survived.
UP_MARKS, DOWN_MARKS = (21, 28, 42, 70), (20, 27, 41, 62)


def sma_survival(df: DataFrame, n: int, series: Series = BARS) -> DataFrame:
    df, line = sma_legs(df, n, series), f"open_sma_{n}"
    for side, marks in (("up", UP_MARKS), ("down", DOWN_MARKS)):
        df = with_survival_marks(df, f"{line}_{side}_leg_run", marks, side).withColumn(f"{side}_leg_start", F.col(f"{line}_{side}_leg_run") == 1)
    return df


def execution_by_length(paths: DataFrame) -> DataFrame:
    return paths.groupBy("bars").agg(F.count("*").alias("n"), F.median("pnl").alias("median_pnl"), F.percentile("mfe", F.lit(0.9)).alias("p90_mfe"), F.percentile("mae", F.lit(0.9)).alias("p90_mae"), F.min("pnl").alias("min_pnl"), F.max("pnl").alias("max_pnl"))


def mfe_distribution(rows: DataFrame, position: str, length: str, n: int = 20, threshold: float = 0.9) -> tuple[list[DataFrame], DataFrame]:
    """(histograms of where in the leg the extreme lies, frequency of the legs' lengths with cumulative share)."""
    by = rows.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("n")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    so_far = F.sum("count").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return zoom(rows, position, n, threshold), by.withColumns({"pct": F.col("count") / total, "cum_pct": so_far / total})
