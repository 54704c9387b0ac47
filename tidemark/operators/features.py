"""Features and signals over indicators: bands, histogram colours and patterns, distances, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .conditions import with_counts_running, with_streaks
from .indicators import rolling_quantile, session_day, with_bollinger, with_distance_z, with_expanding, with_macd, with_rsi, with_session_vwap
from .pointwise import with_pct_change
from .relations import compare, crosses
from .series import BARS, Series, false_if_null, flag


def with_distance(df: DataFrame, a: str, b: str, prefix: str | None = None) -> DataFrame:
    """b - a, also as a share of a and in basis points."""
    p = prefix or f"{a}_to_{b}"
    d = F.col(b).try_cast("double") - F.col(a).try_cast("double")
    share = F.try_divide(d, F.col(a).try_cast("double"))
    return df.withColumns({f"{p}_dist": d, f"{p}_pct": share, f"{p}_bps": share * 1e4})


def with_session_id(df: DataFrame, tz: str = "UTC", name: str = "session_id", series: Series = BARS) -> DataFrame:
    return df.withColumn(name, session_day(series.ts, tz))


def with_line_relation(df: DataFrame, line: str, width: Column, out: str, series: Series = BARS) -> DataFrame:
    """The close below, at, or above a line, with a tolerance of 0.1 % of the width; null where the line is."""
    eps = F.greatest(0.001 * width, F.lit(1e-9))
    d = F.col("close") - F.col(line)
    return df.withColumn(out, F.when(d.isNull(), None).when(F.abs(d) <= eps, "touch").when(d > 0, "above").otherwise("below"))


def with_band_position(df: DataFrame, prefix: str = "boll") -> DataFrame:
    """Where a bar lies against its bands: one of ten labels, and a flag for each band's touch."""
    low, mid, up = (F.col(f"{prefix}_{x}") for x in ("lower", "mid", "upper"))
    eps = F.greatest(0.001 * (up - low), F.lit(1e-9))
    bit = lambda line, n: F.when((F.col("low") - eps <= line) & (F.col("high") + eps >= line), n).otherwise(0)
    df = df.withColumn("_bits", bit(low, 1) + bit(mid, 2) + bit(up, 4))
    b, close = F.col("_bits"), F.col("close")
    label = (
        F.when(up.isNull() | close.isNull(), None).when(b == 7, "touch_all").when(b == 3, "touch_lower_mid").when(b == 6, "touch_mid_upper")
        .when(b == 1, "touch_lower").when(b == 2, "touch_mid").when(b == 4, "touch_upper")
        .when((F.col("low") > low) & (F.col("high") < mid), "within_lower").when((F.col("low") > mid) & (F.col("high") < up), "within_upper")
        .when(F.col("high") < low, "below_lower").when(F.col("low") > up, "above_upper")
        .when(close < mid, "within_lower").otherwise("within_upper")
    )
    return df.withColumns({f"{prefix}_position": label, f"{prefix}_touch_lower": b.bitwiseAND(1) != 0, f"{prefix}_touch_mid": b.bitwiseAND(2) != 0, f"{prefix}_touch_upper": b.bitwiseAND(4) != 0}).drop("_bits")


def with_width_step(df: DataFrame, column: str, eps: float = 1.0, name: str = "width_step") -> DataFrame:
    """Sign of a change of at least eps, else 0."""
    return df.withColumn(name, F.when(F.abs(column) >= eps, F.signum(column)).otherwise(0).cast("tinyint"))


def with_width_pressure(df: DataFrame, step: str = "width_step", m: int = 5, k: int = 3, series: Series = BARS) -> DataFrame:
    """k of the last m steps in one direction; false until there are m rows."""
    w = series.last(m)
    full = F.count(F.lit(1)).over(w) == m
    return df.withColumns({"width_pressure_up": full & (F.count_if(F.col(step) == 1).over(w) >= k), "width_pressure_down": full & (F.count_if(F.col(step) == -1).over(w) >= k)})


def with_squeeze(df: DataFrame, n: int = 20, prefix: str = "boll", series: Series = BARS) -> DataFrame:
    """Touches by high and low, width over |mid|, and whether it is in the lowest fifth of the last n (equal up to rounding is in it)."""
    df = df.withColumns({
        "touch_upper": compare("high", "ge", f"{prefix}_upper"), "touch_lower": compare("low", "le", f"{prefix}_lower"),
        "band_width": F.try_divide(F.col(f"{prefix}_upper") - F.col(f"{prefix}_lower"), F.abs(f"{prefix}_mid")),
    })
    fifth = rolling_quantile("band_width", 0.2, n, series)
    return df.withColumn("squeeze", compare("band_width", "le", fifth + 1e-12 * F.abs(fifth)))


def boll_block(df: DataFrame, n: int = 20, k: float = 2.0, series: Series = BARS) -> DataFrame:
    df = with_bollinger(df, "close", n, k, series=series)
    df = with_distance(df, "boll_lower", "boll_upper", "boll_width")
    df = df.withColumn("boll_width_change", F.col("boll_width_bps") - series.lag("boll_width_bps"))
    df = with_band_position(with_width_step(df, "boll_width_change"))
    for line in ("lower", "mid", "upper"):
        df = with_line_relation(df, f"boll_{line}", F.col("boll_upper") - F.col("boll_lower"), f"close_vs_{line}", series)
    return df


def with_macd_flags(df: DataFrame, series: Series = BARS) -> DataFrame:
    zero = F.lit(0.0)
    return df.withColumns({"cross_up": flag(crosses("macd_hist", zero, True, series)), "cross_down": flag(crosses("macd_hist", zero, False, series)), "hist_pos": flag(F.col("macd_hist") > 0), "hist_neg": flag(F.col("macd_hist") < 0)})


def macd_block(df: DataFrame, series: Series = BARS) -> DataFrame:
    return with_macd_flags(with_macd(df, series=series), series)


def with_hist_color(df: DataFrame, hist: str = "macd_hist", out: str = "hist_color", series: Series = BARS) -> DataFrame:
    """dark while |h| grows, green above 0; also as 2, 1, -1, -2."""
    dark = false_if_null(F.abs(hist) > series.lag(F.abs(hist)))
    green = false_if_null(F.col(hist) > 0)
    return df.withColumns({out: F.concat(F.when(dark, "dark_").otherwise("light_"), F.when(green, "green").otherwise("red")), f"{out}_code": F.when(green, 1).otherwise(-1) * F.when(dark, 2).otherwise(1)})


def with_segments(df: DataFrame, value: Column, out: str, series: Series = BARS) -> DataFrame:
    """Numbers of the runs of equal values; null is a run of its own."""
    df = df.withColumn("_v", value)
    df = df.withColumn("_new", flag(~F.col("_v").eqNullSafe(series.lag("_v")) | (F.row_number().over(series.over()) == 1)))
    return df.withColumn(out, F.sum("_new").over(series.cum())).drop("_v", "_new")


def with_segment_extreme(df: DataFrame, column: str, least: int = 3, out: str = "is_extreme", series: Series = BARS) -> DataFrame:
    """The first row of greatest |value| in each run of one sign of at least so many rows."""
    df = with_segments(df, F.signum(column), "_run", series)
    order = F.row_number().over(series.over("_run").orderBy(F.abs(column).desc_nulls_last(), series.ts, *series.tie))
    long = F.count(F.lit(1)).over(series.whole("_run")) >= least
    return df.withColumn(out, (order == 1) & long & F.coalesce(F.signum(column) != 0, F.lit(False))).drop("_run")


def with_run_pattern(df: DataFrame, column: str, patterns, take, out: str, series: Series = BARS) -> DataFrame:
    """Rows of the runs at positions ``take`` of a match of consecutive runs.

    patterns: sequences of sets of values, None for any run (or none, at an end).  The runs
    of a series are one row each; a match is found with the runs before and after.
    """
    df = with_segments(df, F.col(column), "_run", series)
    runs = df.groupBy(*series.keys, "_run").agg(F.first(column).alias("_c"))
    own = Series(series.keys, "_run")
    hit = F.lit(False)
    for pattern in patterns:
        for at in take:
            same = F.lit(True)
            for k, allowed in enumerate(pattern):
                if allowed is not None:
                    same = same & false_if_null(own.lag("_c", at - k).isin(*sorted(allowed)) if k != at else F.col("_c").isin(*sorted(allowed)))
            hit = hit | same
    marked = runs.select(*series.keys, "_run", hit.alias(out))
    return df.join(marked, [*series.keys, "_run"], "left").drop("_run")


GREEN, RED = {"dark_green", "light_green"}, {"dark_red", "light_red"}


def with_pyramids(df: DataFrame, color: str = "hist_color", out: str = "pyramid", series: Series = BARS) -> DataFrame:
    """Dark then light runs of one colour between runs of the other."""
    return with_run_pattern(df, color, [(RED, {"dark_green"}, {"light_green"}, RED), (GREEN, {"dark_red"}, {"light_red"}, GREEN)], (1, 2), out, series)


def with_strict_pyramids(df: DataFrame, color: str = "hist_color", series: Series = BARS) -> DataFrame:
    df = with_pyramids(df, color, "_p", series)
    return df.withColumns({"green_pyramid": F.col("_p") & F.col(color).isin(*GREEN), "red_pyramid": F.col("_p") & F.col(color).isin(*RED)}).drop("_p")


def with_loose_pyramids(df: DataFrame, color: str = "hist_color", series: Series = BARS) -> DataFrame:
    """Runs of one colour, dark or light, that hold both shades."""
    green = F.col(color).isin(*GREEN)
    df = with_segments(df, green, "_run", series)
    w = series.whole("_run")
    loose = F.bool_or(F.col(color).startswith("dark")).over(w) & F.bool_or(F.col(color).startswith("light")).over(w)
    return df.withColumns({"loose_green": false_if_null(loose & green), "loose_red": false_if_null(loose & ~green)}).drop("_run")


def with_crossings(df: DataFrame, color: str = "hist_color", extrema: bool = False, out: str = "crossing", series: Series = BARS) -> DataFrame:
    """A light run of one colour that turns into a dark run of the other; extrema: with a dark run before and a light one after."""
    down, up = ({"light_green"}, {"dark_red"}), ({"light_red"}, {"dark_green"})
    if extrema:
        return with_run_pattern(df, color, [({"dark_green"}, *down, {"light_red"}), ({"dark_red"}, *up, {"light_green"})], (1, 2), out, series)
    return with_run_pattern(df, color, [down, up], (0, 1), out, series)


def pyramid_annotation(df: DataFrame, hist: str = "macd_hist", group: str = "pyr_id", color: str = "hist_color", p: str = "pyr", series: Series = BARS) -> DataFrame:
    """Each row's place against the apex of its group: order, side, violations of monotony, and side events."""
    whole = series.whole(group)
    size = F.abs(hist)
    df = df.withColumn(f"{p}_ord", F.row_number().over(series.over(group)) - 1)
    df = df.withColumn(f"{p}_apex_val", F.max(size).over(whole))
    df = df.withColumn(f"{p}_apex_ord", F.min(F.when(size == F.col(f"{p}_apex_val"), F.col(f"{p}_ord"))).over(whole))
    front = F.col(f"{p}_ord") <= F.col(f"{p}_apex_ord")
    df = df.withColumn(f"{p}_side", F.when(front, "front").otherwise("back"))
    side = f"{p}_side"
    df = df.withColumn("_side_ord", F.row_number().over(series.over(group, side)) - 1)
    fell = size < series.lag(size, 1, group, side)
    rose = size > series.lag(size, 1, group, side)
    df = df.withColumns({
        f"{p}_front_ord": F.when(F.col(side) == "front", F.col("_side_ord")), f"{p}_back_ord": F.when(F.col(side) == "back", F.col("_side_ord")),
        f"{p}_side_len": F.count(F.lit(1)).over(series.whole(group, side)),
        f"{p}_front_viol": flag((F.col(side) == "front") & fell), f"{p}_back_viol": flag((F.col(side) == "back") & rose),
    }).drop("_side_ord")
    was, now = series.lag(color, 1, group), F.col(color)
    turned = lambda a, b: false_if_null(was.startswith(a) & now.startswith(b))
    df = df.withColumns({
        f"{p}_front_event": flag((F.col(side) == "front") & (turned("dark", "light") | (F.col(f"{p}_ord") == F.col(f"{p}_apex_ord")))),
        f"{p}_back_event": flag((F.col(side) == "back") & turned("light", "dark")),
    })
    cum = series.cum(group)
    df = df.withColumns({f"{p}_{s}_event_n": F.sum(f"{p}_{s}_event").over(cum) for s in ("front", "back")} | {f"{p}_{s}_viol_n": F.sum(f"{p}_{s}_viol").over(cum) for s in ("front", "back")})
    return df.withColumns({f"{p}_{s}_viol_total": F.max(f"{p}_{s}_viol_n").over(whole) for s in ("front", "back")} | {f"{p}_viol": F.col(f"{p}_front_viol") + F.col(f"{p}_back_viol")})


def macd_pyramids(df: DataFrame, series: Series = BARS) -> DataFrame:
    df = with_hist_color(macd_block(df, series), series=series)
    df = df.withColumn("macd_bps", F.try_divide("macd", "close") * 1e4)
    df = with_segments(df, F.signum("macd_hist"), "pyr_id", series)
    return pyramid_annotation(df, series=series)


def with_perfect_front(df: DataFrame, p: str = "pyr", color: str = "hist_color", group: str = "pyr_id") -> DataFrame:
    """Groups whose front never falls, and the first row behind such a front if it is light."""
    perfect = F.col(f"{p}_front_viol_total") == 0
    return df.withColumns({"perfect_frontside": perfect, "perfect_frontside_plus_1_light": perfect & (F.col(f"{p}_ord") == F.col(f"{p}_apex_ord") + 1) & F.col(color).startswith("light")})


def with_breakouts(df: DataFrame, least: float, n: int = 20, series: Series = BARS) -> DataFrame:
    df = with_pct_change(df, ["close"], n, series=series)
    return df.withColumns({"breakout_up": compare(f"close__pct_{n}", "ge", least), "breakout_down": compare(f"close__pct_{n}", "le", -least)})


def with_vwap_relation(df: DataFrame, vwap: str = "vwap_session", eps: float = 1e-4, least: float = 1e-9, series: Series = BARS) -> DataFrame:
    d, tol = F.col("close") - F.col(vwap), F.greatest(F.abs(vwap) * eps, F.lit(least))
    df = df.withColumn("relation", F.when(d.isNull(), None).when(F.abs(d) <= tol, "touch").when(d > 0, "above").otherwise("below"))
    was = series.lag("relation")
    return df.withColumns({
        "vwap_cross_up": false_if_null((was == "below") & (F.col("relation") == "above")), "vwap_cross_down": false_if_null((was == "above") & (F.col("relation") == "below")),
        "reject_up": false_if_null((F.col("low") <= F.col(vwap)) & (F.col("relation") == "above") & (was == "above")), "reject_down": false_if_null((F.col("high") >= F.col(vwap)) & (F.col("relation") == "below") & (was == "below")),
    })


def with_vwap_distance(df: DataFrame, vwap: str = "vwap_session", n: int = 200, series: Series = BARS) -> DataFrame:
    df = df.withColumn("vwap_dist", F.col("close") - F.col(vwap))
    df = df.withColumns({"vwap_dist_pct": F.try_divide("vwap_dist", vwap) * 100, "vwap_dist_abs": F.abs("vwap_dist")})
    df = with_expanding(df, "vwap_dist_abs", series)
    df = df.withColumn("price_rel_vwap", F.when(F.col("vwap_dist") > 0, "above").when(F.col("vwap_dist") < 0, "below").otherwise("equal"))
    return with_distance_z(df, "vwap_dist", n, series=series)


def vwap_block(df: DataFrame, tz: str = "UTC", series: Series = BARS) -> DataFrame:
    df = with_vwap_relation(with_session_vwap(df, tz, series=series), series=series)
    df = with_counts_running(with_session_id(df, tz, series=series), "session_id", "relation", series=series)
    df = with_streaks(df, "relation", "session_id", series)
    df = df.withColumn("vwap_slope", F.col("vwap_session") - series.lag("vwap_session"))
    return with_vwap_distance(df, series=series)


def rsi_block(df: DataFrame, n: int = 14, high: float = 70, low: float = 30, series: Series = BARS) -> DataFrame:
    df = with_rsi(df, "close", n, "rsi", series)
    return df.withColumns({"rsi_overbought": compare("rsi", "ge", high), "rsi_oversold": compare("rsi", "le", low), "rsi_regime": F.when(F.col("rsi") >= high, 1).when(F.col("rsi") <= low, -1).otherwise(0)})


def with_vwap_signal(df: DataFrame, with_slope: bool = True) -> DataFrame:
    long, short = F.col("reject_up"), F.col("reject_down")
    if with_slope:
        long, short = long & false_if_null(F.col("vwap_slope") >= 0), short & false_if_null(F.col("vwap_slope") <= 0)
    return df.withColumn("vwap_signal", F.when(short, -1).when(long, 1).otherwise(0))


def with_combo_signal(df: DataFrame) -> DataFrame:
    up = F.col("reject_up") & (F.col("rsi_regime") >= 0) & (F.col("macd_hist") > 0)
    down = F.col("reject_down") & (F.col("rsi_regime") <= 0) & (F.col("macd_hist") < 0)
    return df.withColumn("combo_signal", F.when(down, -1).when(up, 1).otherwise(0))


BLOCKS = {"vwap": vwap_block, "rsi": rsi_block, "macd": macd_block, "boll": boll_block}


def apply_block(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in BLOCKS:
        raise ValueError(f"unknown block {name}; there are {sorted(BLOCKS)}")
    return BLOCKS[name](df, **options)
