"""Queries over the series operators, each with DuckDB SQL for the same rows.

Floating-point results that depend on the order of additions are rounded to six
decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import times
from ..operators import blocks, calendar, conditions, execution, features, gaps, indicators, legs, pointwise, reduce, relations, resample
from ..operators.series import BARS, flag
from ..sources import ledger, raw_bars

AT = ["symbol", "tz_start"]
W = "window w as (partition by symbol order by tz_start)"
SQL_BARS = """bars as (
  select event_type as symbol, date_trunc('hour', ts) as tz_start, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
         arg_max(value, (ts, event_id)) as close, sum(value) as volume, count(*) as num_trades
  from events group by 1, 2)"""
SQL_SLICES = f"""sl as (select symbol || ':1h:' || cast(epoch_ms(tz_start) // {24 * 3_600_000} * {24 * 3_600_000} as varchar) || ':24' as slice_key, epoch_ms(tz_start) as open_time from bars)"""
ALL: dict[str, tuple] = {}


def bars(spark, sf_dir: str, unit: str = "hour") -> DataFrame:
    return resample.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), unit)


def query(sql: str | None, recursive: bool = False):
    def keep(f):
        ALL[f.__name__] = (f, sql and f"with {'recursive ' if recursive else ''}{SQL_BARS}{'' if sql.lstrip().startswith('select') else ', '} {sql}")
        return f

    return keep


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    """Times without zone and the named columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, n).alias(c) if kinds[c] == "double" else F.col(c).cast("timestamp_ntz").alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in names])


def flagship(spark, sf_dir: str) -> DataFrame:
    return leg_run_lengths(spark, sf_dir)


@query("select symbol, tz_start, open, high, low, close, round(volume, 6) as volume, num_trades from bars")
def bars_hourly(spark, d):
    return rounded(bars(spark, d), *AT, "open", "high", "low", "close", "volume", "num_trades")


@query(f"""select symbol, tz_start, round(close - lag(close, 2) over w, 6) as close__diff_2, round(close / nullif(lag(close) over w, 0) - 1, 6) as close__pct_1,
  round(ln(case when close > 0 then close end) - ln(case when lag(close) over w > 0 then lag(close) over w end), 6) as close__logret_1,
  lag(close, 3) over w as close__shift_3, lead(close) over w as "close__shift_-1", cast(sign(close - lag(close) over w) as tinyint) as close__diff_1__direction,
  cast(sign(close) as tinyint) as close__sign, abs(close) as close__abs, round((high - low) / nullif(open, 0) * 10000, 6) as path_len_bps,
  round((close - open) / nullif(open, 0) * 100, 6) as move_pct
  from bars {W}""")
def pointwise_columns(spark, d):
    df = bars(spark, d)
    df = pointwise.with_pct_change(pointwise.with_diff(df, ["close"], 2), ["close"])
    df = pointwise.with_log_return(df, ["close"])
    df = pointwise.with_shift(pointwise.with_shift(df, ["close"], 3), ["close"], -1)
    df = pointwise.with_abs(pointwise.with_sign(pointwise.with_bar_direction(df, "close"), ["close"]), ["close"])
    df = pointwise.with_path_length(df).withColumn("move", F.col("close") - F.col("open"))
    df = pointwise.abs_to_unit(df, "move", "open", "pct", "move_pct")
    return rounded(df, *AT, "close__diff_2", "close__pct_1", "close__logret_1", "close__shift_3", "close__shift_-1", "close__diff_1__direction", "close__sign", "close__abs", "path_len_bps", "move_pct")


@query(f"""select symbol, tz_start, close > open + 5 as gt, close >= open - 5 as ge, close < open - 5 as lt, close <= open + 5 as le, abs(close - open) <= 5 as eq, abs(close - open) > 5 as ne,
  coalesce(close - 50 > 0 and lag(close) over w - 50 <= 0, false) as crossed_up, coalesce(close - 50 < 0 and lag(close) over w - 50 >= 0, false) as crossed_down, close between low and open as inside_body from bars {W}""")
def relation_columns(spark, d):
    df = bars(spark, d)
    for op in ("gt", "ge", "lt", "le", "eq", "ne"):
        df = relations.with_relation(df, "close", op, "open", 5.0, op)
    df = df.withColumns({"crossed_up": relations.crosses("close", 50.0), "crossed_down": relations.crosses("close", 50.0, False), "inside_body": relations.within("close", "low", "open")})
    return df.select(*AT, "gt", "ge", "lt", "le", "eq", "ne", "crossed_up", "crossed_down", "inside_body")


_TR = "greatest(abs(high - low), abs(high - lag(close) over w), abs(low - lag(close) over w))"


@query(f"""select symbol, tz_start, coalesce(high > lag(high) over w, false) as high__higher_high, coalesce(low < lag(low) over w, false) as low__lower_low,
  coalesce(close > lag(close) over w, false) as close__higher_close, coalesce(close < lag(close) over w, false) as close__lower_close, coalesce(open > lag(open) over w, false) as open__higher_open,
  coalesce(open < lag(open) over w, false) as open__lower_open, coalesce(high <= lag(high) over w and low >= lag(low) over w, false) as inside_bar, coalesce(high >= lag(high) over w and low <= lag(low) over w, false) as outside_bar,
  close > open as bullish_bar, close < open as bearish_bar, round({_TR}, 6) as true_range, coalesce(high - low > lag(high - low) over w, false) as range_expansion from bars {W}""")
def bar_relations(spark, d):
    df = relations.with_bar_relations(bars(spark, d))
    df = relations.with_range_expansion(relations.with_true_range(relations.with_body(relations.with_inside_outside(df))))
    return rounded(df, *AT, "high__higher_high", "low__lower_low", "close__higher_close", "close__lower_close", "open__higher_open", "open__lower_open", "inside_bar", "outside_bar", "bullish_bar", "bearish_bar", "true_range", "range_expansion")


_ABC = "f as (select *, close > open as a, high > 80 as b, low < 20 as c from bars)"


def _abc(spark, d):
    return bars(spark, d).withColumns({"a": F.col("close") > F.col("open"), "b": F.col("high") > 80, "c": F.col("low") < 20})


@query(f"""{_ABC} select symbol, tz_start, a and b and c as all_abc, a or b or c as any_abc, a::int + b::int + c::int >= 2 as two_abc, not a as not_a from f""")
def condition_sets(spark, d):
    df = conditions.all_of(_abc(spark, d), ["a", "b", "c"], "all_abc")
    df = conditions.at_least(conditions.any_of(df, ["a", "b", "c"], "any_abc"), ["a", "b", "c"], "two_abc", 2)
    return conditions.negate(df, "a", "not_a").select(*AT, "all_abc", "any_abc", "two_abc", "not_a")


@query(f"""{_ABC}, s as (select *, (a and not coalesce(lag(a) over w, false))::int as st from f {W}) select symbol, tz_start, case when a then cast(sum(st) over w as bigint) end as leg_id from s {W}""")
def condition_group_ids(spark, d):
    return conditions.with_group_id(_abc(spark, d), "a", "leg_id").select(*AT, F.col("leg_id").cast("long"))


@query(f"""m as (select *, case when high > 95 then 1 when low < 5 then -1 end as mark from bars), t as (select *, cast(sum(case when mark = 1 then 1 else 0 end) over w as bigint) as seg, last_value(mark ignore nulls) over w as on_ from m {W})
  select symbol, tz_start, case when on_ = 1 and mark is null then seg end as after_start, case when on_ = 1 then seg end as with_start from t""")
def segments_between(spark, d):
    start, end = F.col("high") > 95, (F.col("low") < 5) & ~(F.col("high") > 95)
    df = conditions.with_id_between(bars(spark, d), start, end, "after_start", with_start=False)
    df = conditions.with_id_between(df, start, end, "with_start")
    return df.select(*AT, F.col("after_start").cast("long"), F.col("with_start").cast("long"))


@query(f"""{_ABC}, i as (select *, row_number() over w as rn, sum((not a)::int) over w as ia, sum((not (a and b))::int) over w as iab, sum((a::int + b::int + c::int < 2)::int) over w as i2 from f {W})
  select symbol, tz_start, cast(sum(a::int) over (partition by symbol, ia order by tz_start) as bigint) as a__run_true, cast(sum((a and b)::int) over (partition by symbol, iab order by tz_start) as bigint) as ab_run,
  cast(sum((a::int + b::int + c::int >= 2)::int) over (partition by symbol, i2 order by tz_start) as bigint) as two_run,
  rn - max(case when b then rn end) over w as b__bars_since_true, rn - max(case when b or c then rn end) over w as bc_since from i {W}""")
def counters(spark, d):
    df = conditions.with_bars_since(conditions.with_running_true(_abc(spark, d), "a"), "b")
    df = conditions.with_running_at_least(conditions.with_running_all(df, ["a", "b"], "ab_run"), ["a", "b", "c"], 2, "two_run")
    df = conditions.with_bars_since_any(df, ["b", "c"], "bc_since")
    return df.select(*AT, "a__run_true", "ab_run", "two_run", "b__bars_since_true", "bc_since")


@query(f"""select symbol, tz_start, case when count(open) over w3 >= 14 then round(avg(open) over w3, 6) end as open_sma_14, case when count(open) over w3 >= 14 then round(avg((high - low) / nullif(open, 0) * 100) over w3, 6) end as arp_14
  from bars window w3 as (partition by symbol order by tz_start rows 13 preceding)""")
def moving_averages(spark, d):
    df = indicators.apply_indicator(indicators.with_sma(bars(spark, d), "open", 14), "arp", n=14)
    return rounded(df, *AT, "open_sma_14", "arp_14")


@query("""b as (select *, count(close) over w as n, avg(close) over w as m, stddev_pop(close) over w as s, row_number() over (partition by symbol order by tz_start) as rn from bars window w as (partition by symbol order by tz_start rows 19 preceding))
  select symbol, tz_start, case when n >= 10 then round(m, 6) end as boll_mid, case when n >= 10 then round(m + 2 * s, 6) end as boll_upper, case when n >= 10 then round(m - 2 * s, 6) end as boll_lower, rn >= 20 as boll_valid from b""")
def bollinger(spark, d):
    return rounded(indicators.with_bollinger(bars(spark, d)), *AT, "boll_mid", "boll_upper", "boll_lower", "boll_valid")


SQL_MACD = """n as (select *, row_number() over (partition by symbol order by tz_start) as rn from bars),
e as (select symbol, rn, close as f, close as s from n where rn = 1 union all
      select n.symbol, n.rn, e.f + 2.0 / 13 * (n.close - e.f), e.s + 2.0 / 27 * (n.close - e.s) from e join n on n.symbol = e.symbol and n.rn = e.rn + 1),
g as (select symbol, rn, f - s as sig from e where rn = 1 union all select e.symbol, e.rn, g.sig + 0.2 * (e.f - e.s - g.sig) from g join e on e.symbol = g.symbol and e.rn = g.rn + 1),
macd as (select n.*, f as ema_fast, s as ema_slow, f - s as macd, sig as macd_signal, f - s - sig as macd_hist from n join e using (symbol, rn) join g using (symbol, rn))"""
SQL_COLOR = SQL_MACD + f""", color as (select *, case when coalesce(abs(macd_hist) > lag(abs(macd_hist)) over w, false) then 'dark_' else 'light_' end || case when macd_hist > 0 then 'green' else 'red' end as hist_color from macd {W})"""
SQL_RUNS = SQL_COLOR + f""", ch as (select *, (coalesce(hist_color <> lag(hist_color) over w, true))::int as new from color {W}), rid as (select *, sum(new) over w as run from ch {W}),
runs as (select symbol, run, any_value(hist_color) as c from rid group by 1, 2), pat as (select *, lag(c) over r as p1, lag(c, 2) over r as p2, lead(c) over r as n1, lead(c, 2) over r as n2 from runs window r as (partition by symbol order by run))"""


def _macd(spark, d):
    return features.macd_block(bars(spark, d))


def _color(spark, d):
    return features.with_hist_color(_macd(spark, d))


@query(f"""{SQL_MACD} select symbol, tz_start, round(ema_fast, 6) as ema_fast, round(ema_slow, 6) as ema_slow, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(macd_hist, 6) as macd_hist, rn >= 26 as macd_ready, rn >= 35 as macd_signal_ready from macd""", True)
def macd(spark, d):
    return rounded(indicators.with_macd(bars(spark, d)), *AT, "ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist", "macd_ready", "macd_signal_ready")


@query(f"""d as (select *, row_number() over w as rn, close - lag(close) over w as dl from bars {W}),
e as (select symbol, rn, greatest(dl, 0) as g, greatest(-dl, 0) as l from d where rn = 2 union all select d.symbol, d.rn, e.g + 1.0 / 14 * (greatest(d.dl, 0) - e.g), e.l + 1.0 / 14 * (greatest(-d.dl, 0) - e.l) from e join d on d.symbol = e.symbol and d.rn = e.rn + 1),
r as (select d.symbol, d.tz_start, case when d.rn >= 15 and l <> 0 then 100 - 100 / (1 + g / l) end as rsi from d left join e using (symbol, rn))
select symbol, tz_start, round(rsi, 6) as rsi, coalesce(rsi >= 70, false) as rsi_overbought, coalesce(rsi <= 30, false) as rsi_oversold, case when rsi >= 70 then 1 when rsi <= 30 then -1 else 0 end as rsi_regime from r""", True)
def rsi_regimes(spark, d):
    return rounded(features.rsi_block(bars(spark, d)), *AT, "rsi", "rsi_overbought", "rsi_oversold", "rsi_regime")


@query(f"""t as (select *, row_number() over w as rn, {_TR} as tr from bars {W}), s as (select *, avg(tr) over (partition by symbol order by tz_start rows 13 preceding) as m from t),
e as (select symbol, rn, m as atr from s where rn = 14 union all select s.symbol, s.rn, (e.atr * 13 + s.tr) / 14 from e join s on s.symbol = e.symbol and s.rn = e.rn + 1)
select s.symbol, s.tz_start, round(atr, 6) as atr_14 from s left join e using (symbol, rn)""", True)
def average_true_range(spark, d):
    return rounded(indicators.with_atr(bars(spark, d)), *AT, "atr_14")


_VWAP = "round(sum((high + low + close) / 3 * volume) over {w} / nullif(sum(volume) over {w}, 0), 6)"


@query(f"""select symbol, tz_start, {_VWAP.format(w="w")} as vwap, {_VWAP.format(w="s")} as vwap_session from bars {W}, s as (partition by symbol, cast(tz_start as date) order by tz_start)""")
def vwaps(spark, d):
    return rounded(indicators.with_session_vwap(indicators.with_vwap(bars(spark, d))), *AT, "vwap", "vwap_session")


@query(f"""q as (select *, count(close) over r as n, quantile_cont(close, 0.2) over r as q20, count(close) over z as nz, stddev_pop(close) over z as sd, ln(case when close > 0 then close end) as l from bars
  window r as (partition by symbol order by tz_start rows 19 preceding), z as (partition by symbol order by tz_start rows 49 preceding))
select symbol, tz_start, case when n >= 20 then round(q20, 6) end as q20, case when nz >= 10 and sd <> 0 then round(close / sd, 6) end as close_z, round(degrees(atan((l - lag(l, 5) over w) / 5)), 6) as close_angle_5,
  round(avg(close) over w * count(close) over w, 4) as close_total_so_far, max(close) over w as close_max_so_far from q {W}""")
def rolling_shapes(spark, d):
    df = bars(spark, d).withColumn("q20", indicators.rolling_quantile("close", 0.2, 20))
    df = indicators.with_expanding(indicators.with_angle(indicators.with_distance_z(df, "close", 50), "close", 5), "close")
    return df.select(*AT, *[F.round(c, 6).alias(c) for c in ("q20", "close_z", "close_angle_5")], F.round(F.col("close_mean_so_far") * F.count("close").over(BARS.cum()), 4).alias("close_total_so_far"), "close_max_so_far")


SQL_BOLL = """b0 as (select *, count(close) over w as n, avg(close) over w as m, stddev_pop(close) over w as s from bars window w as (partition by symbol order by tz_start rows 19 preceding)),
b as (select *, case when n >= 10 then m end as mid, case when n >= 10 then m + 2 * s end as up, case when n >= 10 then m - 2 * s end as lo from b0)"""


@query(f"""{SQL_BOLL}, x as (select *, (up - lo) / nullif(abs(mid), 0) as bw, (up - lo) / nullif(lo, 0) * 10000 as bps from b), y as (select *, bps - lag(bps) over w as ch from x {W}),
z as (select *, case when abs(ch) >= 1 then cast(sign(ch) as int) else 0 end as step, count(bw) over r as nb, quantile_cont(bw, 0.2) over r as q from y window r as (partition by symbol order by tz_start rows 19 preceding))
select symbol, tz_start, coalesce(high >= up, false) as touch_upper, coalesce(low <= lo, false) as touch_lower, coalesce(nb >= 20 and bw <= q + 1e-12 * abs(q), false) as squeeze, step as width_step,
 count(*) over p = 5 and count(*) filter (step = 1) over p >= 3 as width_pressure_up, count(*) over p = 5 and count(*) filter (step = -1) over p >= 3 as width_pressure_down
from z window p as (partition by symbol order by tz_start rows 4 preceding)""")
def band_pressure(spark, d):
    df = features.with_width_pressure(features.boll_block(bars(spark, d)))
    return features.with_squeeze(df).select(*AT, "touch_upper", "touch_lower", "squeeze", F.col("width_step").cast("int"), "width_pressure_up", "width_pressure_down")


@query(f"""{SQL_BOLL}, p as (select *, greatest(0.001 * (up - lo), 1e-9) as eps from b), q as (select *, case when low - eps <= lo and high + eps >= lo then 1 else 0 end + case when low - eps <= mid and high + eps >= mid then 2 else 0 end + case when low - eps <= up and high + eps >= up then 4 else 0 end as bits from p)
select symbol, tz_start, case when up is null then null when bits = 7 then 'touch_all' when bits = 3 then 'touch_lower_mid' when bits = 6 then 'touch_mid_upper' when bits = 1 then 'touch_lower' when bits = 2 then 'touch_mid' when bits = 4 then 'touch_upper'
 when low > lo and high < mid then 'within_lower' when low > mid and high < up then 'within_upper' when high < lo then 'below_lower' when low > up then 'above_upper' when close < mid then 'within_lower' else 'within_upper' end as boll_position,
 case when mid is null then null when abs(close - mid) <= eps then 'touch' when close > mid then 'above' else 'below' end as close_vs_mid from q""")
def band_positions(spark, d):
    return features.boll_block(bars(spark, d)).select(*AT, "boll_position", "close_vs_mid")


@query(f"""{SQL_COLOR} select symbol, tz_start, hist_color, (coalesce(macd_hist > 0 and lag(macd_hist) over w <= 0, false))::int as cross_up, (coalesce(macd_hist < 0 and lag(macd_hist) over w >= 0, false))::int as cross_down,
 (macd_hist > 0)::int as hist_pos, (macd_hist < 0)::int as hist_neg from color {W}""", True)
def macd_colors(spark, d):
    return _color(spark, d).select(*AT, "hist_color", "cross_up", "cross_down", "hist_pos", "hist_neg")


@query(f"""{SQL_MACD}, s as (select *, sign(macd_hist) as sg from macd), c as (select *, (coalesce(sg <> lag(sg) over w, true))::int as new from s {W}), i as (select *, sum(new) over w as run from c {W}),
o as (select *, row_number() over (partition by symbol, run order by abs(macd_hist) desc, tz_start) as k, count(*) over (partition by symbol, run) as len from i)
select symbol, tz_start, k = 1 and len >= 3 and sg <> 0 as is_extreme from o""", True)
def segment_extremes(spark, d):
    return features.with_segment_extreme(_macd(spark, d), "macd_hist").select(*AT, "is_extreme")


_G, _R = "('dark_green', 'light_green')", "('dark_red', 'light_red')"


@query(f"""{SQL_RUNS}, hit as (select *, coalesce((c = 'dark_green' and p1 in {_R} and n1 = 'light_green' and n2 in {_R}) or (c = 'light_green' and p1 = 'dark_green' and p2 in {_R} and n1 in {_R})
 or (c = 'dark_red' and p1 in {_G} and n1 = 'light_red' and n2 in {_G}) or (c = 'light_red' and p1 = 'dark_red' and p2 in {_G} and n1 in {_G}), false) as pyr,
 coalesce((c = 'light_green' and n1 = 'dark_red') or (c = 'dark_red' and p1 = 'light_green') or (c = 'light_red' and n1 = 'dark_green') or (c = 'dark_green' and p1 = 'light_red'), false) as crossing from pat),
gr as (select *, (coalesce((hist_color in {_G}) <> (lag(hist_color) over w in {_G}), true))::int as gnew from rid {W}), gi as (select *, sum(gnew) over w as grun from gr {W}),
lo as (select *, bool_or(starts_with(hist_color, 'dark')) over q and bool_or(starts_with(hist_color, 'light')) over q as loose from gi window q as (partition by symbol, grun))
select lo.symbol, tz_start, pyr and c in {_G} as green_pyramid, pyr and c in {_R} as red_pyramid, crossing, loose and c in {_G} as loose_green, loose and c in {_R} as loose_red from lo join hit on lo.symbol = hit.symbol and lo.run = hit.run""", True)
def color_patterns(spark, d):
    df = features.with_crossings(features.with_strict_pyramids(_color(spark, d)))
    return features.with_loose_pyramids(df).select(*AT, "green_pyramid", "red_pyramid", "crossing", "loose_green", "loose_red")


@query(f"""{SQL_COLOR}, s as (select *, (coalesce(sign(macd_hist) <> lag(sign(macd_hist)) over w, true))::int as new from color {W}), i as (select *, sum(new) over w as g from s {W}),
o as (select *, row_number() over (partition by symbol, g order by tz_start) - 1 as ord, max(abs(macd_hist)) over (partition by symbol, g) as apex from i),
a as (select *, min(case when abs(macd_hist) = apex then ord end) over (partition by symbol, g) as apex_ord from o), d as (select *, case when ord <= apex_ord then 'front' else 'back' end as side from a),
v as (select *, (side = 'front' and coalesce(abs(macd_hist) < lag(abs(macd_hist)) over sw, false))::int as fv, (side = 'back' and coalesce(abs(macd_hist) > lag(abs(macd_hist)) over sw, false))::int as bv,
 (side = 'front' and (ord = apex_ord or coalesce(starts_with(lag(hist_color) over gw, 'dark') and starts_with(hist_color, 'light'), false)))::int as fe, (side = 'back' and coalesce(starts_with(lag(hist_color) over gw, 'light') and starts_with(hist_color, 'dark'), false))::int as be,
 count(*) over (partition by symbol, g, side) as side_len from d window sw as (partition by symbol, g, side order by tz_start), gw as (partition by symbol, g order by tz_start))
select symbol, tz_start, ord as pyr_ord, apex_ord as pyr_apex_ord, round(apex, 6) as pyr_apex_val, side as pyr_side, side_len as pyr_side_len, fv as pyr_front_viol, bv as pyr_back_viol, cast(sum(fe) over gw as bigint) as pyr_front_event_n, cast(sum(be) over gw as bigint) as pyr_back_event_n,
 cast(sum(fv) over (partition by symbol, g) as bigint) as pyr_front_viol_total, cast(sum(bv) over (partition by symbol, g) as bigint) as pyr_back_viol_total,
 sum(fv) over (partition by symbol, g) = 0 and ord = apex_ord + 1 and starts_with(hist_color, 'light') as perfect_frontside_plus_1_light from v window gw as (partition by symbol, g order by tz_start)""", True)
def pyramid_annotations(spark, d):
    df = features.with_perfect_front(features.macd_pyramids(bars(spark, d)))
    return rounded(df, *AT, "pyr_ord", "pyr_apex_ord", "pyr_apex_val", "pyr_side", "pyr_side_len", "pyr_front_viol", "pyr_back_viol", "pyr_front_event_n", "pyr_back_event_n", "pyr_front_viol_total", "pyr_back_viol_total", "perfect_frontside_plus_1_light")


SQL_VWAP = """v as (select *, sum((high + low + close) / 3 * volume) over s / nullif(sum(volume) over s, 0) as vw, cast(tz_start as date) as session_id from bars window s as (partition by symbol, cast(tz_start as date) order by tz_start)),
r as (select *, round(close - vw, 9) as d, case when vw is null then null when abs(round(close - vw, 9)) <= greatest(abs(vw) * 0.0001, 1e-9) then 'touch' when round(close - vw, 9) > 0 then 'above' else 'below' end as relation from v)"""


@query(f"""{SQL_VWAP}, x as (select *, lag(relation) over w as was, (not coalesce(relation = lag(relation) over w and session_id = lag(session_id) over w, false))::int as new, vw - lag(vw) over w as slope from r {W}), y as (select *, cast(sum(new) over w as bigint) as streak_id from x {W}),
z as (select *, coalesce(low <= vw and relation = 'above' and was = 'above', false) as ru, coalesce(high >= vw and relation = 'below' and was = 'below', false) as rd from y)
select symbol, tz_start, relation, coalesce(was = 'below' and relation = 'above', false) as vwap_cross_up, coalesce(was = 'above' and relation = 'below', false) as vwap_cross_down, ru as reject_up, rd as reject_down,
 cast(count(*) filter (relation = 'above') over s as int) as count_above, cast(count(*) filter (relation = 'below') over s as int) as count_below, cast(count(*) filter (relation = 'touch') over s as int) as count_touch,
 case when d > 0 then 'above' when d < 0 then 'below' end as price_rel_vwap, streak_id, row_number() over (partition by symbol, streak_id order by tz_start) as streak_len,
 round(slope, 6) as vwap_slope, round(d / nullif(vw, 0) * 100, 4) + 0.0 as vwap_dist_pct, case when rd and coalesce(slope <= 0, false) then -1 when ru and coalesce(slope >= 0, false) then 1 else 0 end as vwap_signal
from z window s as (partition by symbol, session_id order by tz_start)""")
def vwap_features(spark, d):
    """The distance as a share is compared at four places, and its side not below nine: it is a small difference of two sums."""
    df = features.with_vwap_signal(features.vwap_block(bars(spark, d)))
    df = df.withColumn("price_rel_vwap", F.when(F.round("vwap_dist", 9) != 0, F.col("price_rel_vwap")))
    df = df.withColumn("vwap_dist_pct", F.round("vwap_dist_pct", 4) + F.lit(0.0))
    return rounded(df, *AT, "relation", "vwap_cross_up", "vwap_cross_down", "reject_up", "reject_down", "count_above", "count_below", "count_touch", "price_rel_vwap", "streak_id", "streak_len", "vwap_slope", "vwap_dist_pct", "vwap_signal")


@query(f"""{SQL_MACD}, rd as (select *, row_number() over w as rrn, close - lag(close) over w as dl from bars {W}),
re as (select symbol, rrn, greatest(dl, 0) as gg, greatest(-dl, 0) as ll from rd where rrn = 2 union all select rd.symbol, rd.rrn, re.gg + 1.0 / 14 * (greatest(rd.dl, 0) - re.gg), re.ll + 1.0 / 14 * (greatest(-rd.dl, 0) - re.ll) from re join rd on rd.symbol = re.symbol and rd.rrn = re.rrn + 1),
rs as (select rd.symbol, rd.tz_start, case when rd.rrn >= 15 and ll <> 0 then 100 - 100 / (1 + gg / ll) end as rsi from rd left join re using (symbol, rrn)), {SQL_VWAP}, q as (select *, lag(relation) over w as was from r {W}),
z as (select symbol, tz_start, coalesce(low <= vw and relation = 'above' and was = 'above', false) as ru, coalesce(high >= vw and relation = 'below' and was = 'below', false) as rdn from q)
select symbol, tz_start, case when rdn and not coalesce(rsi >= 70, false) and macd_hist < 0 then -1 when ru and not coalesce(rsi <= 30, false) and macd_hist > 0 then 1 else 0 end as combo_signal from z join rs using (symbol, tz_start) join macd using (symbol, tz_start)""", True)
def combo_signals(spark, d):
    df = features.with_combo_signal(features.rsi_block(features.macd_block(features.vwap_block(bars(spark, d)))))
    return df.select(*AT, "combo_signal")


@query(f"""select symbol, tz_start, coalesce(close / nullif(lag(close, 20) over w, 0) - 1 >= 0.5, false) as breakout_up, coalesce(close / nullif(lag(close, 20) over w, 0) - 1 <= -0.5, false) as breakout_down, round((close - open) / nullif(open, 0) * 10000, 6) as oc_bps from bars {W}""")
def breakouts(spark, d):
    df = features.with_distance(features.with_breakouts(bars(spark, d), 0.5), "open", "close", "oc")
    return rounded(df, *AT, "breakout_up", "breakout_down", "oc_bps")


SQL_LEGS = f"""m as (select *, case when count(open) over r >= 14 then round_even(avg(open) over r, 6) end as sma from bars window r as (partition by symbol order by tz_start rows 13 preceding)),
u as (select *, coalesce(sma > lag(sma) over w, false) as up from m {W}), s as (select *, (up and not coalesce(lag(up) over w, false))::int as st, sum((not up)::int) over w as isl from u {W}),
l as (select *, case when up then cast(sum(st) over w as bigint) end as leg, cast(sum(up::int) over (partition by symbol, isl order by tz_start) as bigint) as run from s {W})"""
LEG = "open_sma_14_up_leg_id"


def _legs(spark, d):
    return legs.sma_legs(bars(spark, d), 14)


@query(f"""{SQL_LEGS} select symbol, tz_start, up as open_sma_14_up_on, leg as {LEG}, run as open_sma_14_up_leg_run, case when up then max(run) over (partition by symbol, leg) end as open_sma_14_up_leg_run_len from l""")
def leg_persistence(spark, d):
    return _legs(spark, d).select(*AT, "open_sma_14_up_on", LEG, "open_sma_14_up_leg_run", "open_sma_14_up_leg_run_len")


@query(f"""{SQL_LEGS}, k as (select symbol, leg, max(run) as n from l where leg is not null group by 1, 2), c as (select n, count(*) as "count" from k group by 1)
select n, "count", round("count" / sum("count") over (), 6) as pct, round(sum("count") over (order by n desc) / sum("count") over (), 6) as survival from c""")
def leg_run_lengths(spark, d):
    runs = reduce.condition_persistence(_legs(spark, d), LEG, "open_sma_14_up_leg_run")
    return rounded(reduce.run_lengths(runs, "run_len"), "n", "count", "pct", "survival")


@query(f"""{SQL_LEGS}, k as (select symbol, leg, max(run) as n from l where leg is not null group by 1, 2), c as (select n, count(*) as k from k group by 1), reach as (select n, sum(k) over (order by n desc) / sum(k) over () as sv from c)
select t as threshold, min(case when sv <= t then n end) as n from reach, (values (0.5::double), (0.1::double), (0.02::double)) v(t) group by 1""")
def survival_marks(spark, d):
    runs = reduce.condition_persistence(_legs(spark, d), LEG, "open_sma_14_up_leg_run")
    return reduce.survival_marks(reduce.run_lengths(runs, "run_len"), [0.5, 0.1, 0.02])


SQL_EXC = SQL_LEGS + """, e0 as (select *, row_number() over g - 1 as idx, count(*) over (partition by symbol, leg) as n_bars, first_value(open) over g as o from l where leg is not null window g as (partition by symbol, leg order by tz_start)),
e as (select *, (high - o) / nullif(o, 0) * 10000 as bps, row_number() over (partition by symbol, leg order by (high - o) / nullif(o, 0) * 10000 desc nulls last, tz_start) as k from e0)"""


@query(f"""{SQL_EXC} select symbol, tz_start, leg as {LEG}, idx as mfe_idx, n_bars as mfe_n_bars, round(bps, 6) as mfe_bps, k = 1 as mfe_is_max, n_bars - 1 - idx as mfe_from_end, round(case when n_bars > 1 then idx / (n_bars - 1) else 1 end, 6) as mfe_pct_of_leg from e""")
def excursions(spark, d):
    return rounded(legs.excursion(_legs(spark, d), LEG, True, True, "mfe"), *AT, LEG, "mfe_idx", "mfe_n_bars", "mfe_bps", "mfe_is_max", "mfe_from_end", "mfe_pct_of_leg")


@query(f"""{SQL_EXC}, x as (select idx, n_bars from e where k = 1) select cast(t as int) as t, count(n_bars) as survivors, round(sum((idx <= t)::int) / nullif(count(n_bars), 0), 6) as rate from (select unnest(range(1, max(n_bars) + 1)) as t from x) left join x on n_bars >= t group by 1""")
def mfe_survival_curve(spark, d):
    return rounded(legs.mfe_survival(legs.mfe_rows(_legs(spark, d), LEG), "mfe_n_bars", "mfe_idx"), "t", "survivors", "rate")


@query(f"""{SQL_LEGS}, x as (select *, (close - sma) / nullif(sma, 0) * 10000 as b from l where leg is not null) select symbol, tz_start, round(b, 6) as dist_bps, row_number() over (partition by symbol, leg order by abs(b) desc nulls last, tz_start) = 1 as is_max_stretch,
 round(abs(b) / nullif(max(abs(b)) over (partition by symbol, leg), 0), 6) as stretch_pct from x""")
def line_distances(spark, d):
    return rounded(legs.line_distance(_legs(spark, d), "open_sma_14", LEG), *AT, "dist_bps", "is_max_stretch", "stretch_pct")


SQL_BOTH = f"""m as (select *, case when count(open) over r >= 14 then round_even(avg(open) over r, 6) end as sma from bars window r as (partition by symbol order by tz_start rows 13 preceding)),
u as (select *, coalesce(sma > lag(sma) over w, false) as up, coalesce(sma < lag(sma) over w, false) as down from m {W}), s as (select *, sum((not up)::int) over w as iu, sum((not down)::int) over w as idn from u {W}),
l as (select *, sum(up::int) over (partition by symbol, iu order by tz_start) as up_run, sum(down::int) over (partition by symbol, idn order by tz_start) as down_run from s)"""
_FLAGS = [f"{side}_{m}_survive" for side, marks in (("up", legs.UP_MARKS), ("down", legs.DOWN_MARKS)) for m in marks] + ["up_leg_start", "down_leg_start"]


@query(f"""{SQL_BOTH} select symbol, tz_start, {", ".join(f"{n.split('_')[0]} and {n.split('_')[0]}_run = {n.split('_')[1] if n.endswith('survive') else 1} as {n}" for n in _FLAGS)} from l""")
def survival_flags(spark, d):
    return legs.sma_survival(bars(spark, d), 14).select(*AT, *_FLAGS)


SQL_DOWN, DOWN_LEG = SQL_LEGS.replace("sma > lag(sma)", "sma < lag(sma)"), "open_sma_14_down_leg_id"


@query(f"""{SQL_DOWN} select symbol, tz_start, up as open_sma_14_down_on, leg as {DOWN_LEG}, run as open_sma_14_down_leg_run, case when up then max(run) over (partition by symbol, leg) end as open_sma_14_down_leg_run_len from l""")
def falling_leg_persistence(spark, d):
    return _legs(spark, d).select(*AT, "open_sma_14_down_on", DOWN_LEG, "open_sma_14_down_leg_run", "open_sma_14_down_leg_run_len")


@query(f"""{SQL_DOWN}, k as (select symbol, leg, max(run) as n from l where leg is not null group by 1, 2), c as (select n, count(*) as "count" from k group by 1)
select n, "count", round("count" / sum("count") over (), 6) as pct, round(sum("count") over (order by n desc) / sum("count") over (), 6) as survival from c""")
def falling_leg_run_lengths(spark, d):
    runs = reduce.condition_persistence(_legs(spark, d), DOWN_LEG, "open_sma_14_down_leg_run")
    return rounded(reduce.run_lengths(runs, "run_len"), "n", "count", "pct", "survival")


def _excursion_query(up: bool, favourable: bool):
    price, order = "high" if up == favourable else "low", "desc" if favourable else "asc"
    move = f"({price} - o)" if up else f"(o - {price})"
    sql = f"""{SQL_LEGS if up else SQL_DOWN}, e0 as (select *, row_number() over g - 1 as idx, count(*) over (partition by symbol, leg) as n_bars, first_value(open) over g as o from l where leg is not null window g as (partition by symbol, leg order by tz_start)),
    e as (select *, {move} as val, {move} / nullif(o, 0) * 10000 as bps from e0)
    select symbol, tz_start, leg, idx as exc_idx, n_bars as exc_n_bars, round(val, 6) as exc_val, round(bps, 6) as exc_bps, row_number() over (partition by symbol, leg order by bps {order} nulls last, tz_start) = 1 as exc_is_max, idx as exc_from_start, n_bars - 1 - idx as exc_from_end,
    round(case when n_bars > 1 then idx / (n_bars - 1) else 1 end, 6) as exc_pct_of_leg from e"""

    def run(spark, d):
        df = legs.excursion(_legs(spark, d), LEG if up else DOWN_LEG, up, favourable).withColumnRenamed(LEG if up else DOWN_LEG, "leg")
        return rounded(df, *AT, "leg", "exc_idx", "exc_n_bars", "exc_val", "exc_bps", "exc_is_max", "exc_from_start", "exc_from_end", "exc_pct_of_leg")

    run.__name__ = f"excursions_{'up' if up else 'down'}_{'favourable' if favourable else 'adverse'}"
    return query(sql)(run)


for _up, _favourable in ((True, False), (False, True), (False, False)):
    _excursion_query(_up, _favourable)


@query(f"""{SQL_EXC}, x as (select idx, n_bars from e where k = 1 and n_bars >= 6) select count(*) as survivors, round(avg((idx <= 5)::int), 6) as rate from x""")
def mfe_already_at_five(spark, d):
    return rounded(legs.mfe_already_at(legs.mfe_rows(_legs(spark, d), LEG), "mfe_n_bars", "mfe_idx", 5), "survivors", "rate")


@query(f"""{SQL_EXC}, x as (select n_bars as n, count(*) as "count" from e where k = 1 group by 1) select n, "count", round("count" / sum("count") over (), 6) as pct, round(sum("count") over (order by n) / sum("count") over (), 6) as cum_pct from x""")
def mfe_leg_lengths(spark, d):
    return rounded(legs.mfe_distribution(legs.mfe_rows(_legs(spark, d), LEG), "mfe_pct_of_leg", "mfe_n_bars")[1], "n", "count", "pct", "cum_pct")


@query(f"""{SQL_EXC}, v as (select case when n_bars > 1 then idx / (n_bars - 1) else 1 end as v from e where k = 1), span as (select min(v) as lo, max(v) as hi from v), c as (select cast(least(19, floor((v - lo) / ((hi - lo) / 20))) as int) as bucket, count(*) as k from v, span group by 1)
select cast(b as int) as bucket, coalesce(k, 0) as "count", round(coalesce(k, 0) / sum(k) over (), 6) as pct from range(20) r(b) left join c on bucket = b""")
def mfe_positions(spark, d):
    return rounded(legs.mfe_distribution(legs.mfe_rows(_legs(spark, d), LEG), "mfe_pct_of_leg", "mfe_n_bars", threshold=2.0)[0][0], "bucket", "count", "pct")


@query(f"""{SQL_LEGS}, o as (select *, first_value(open) over (partition by symbol, leg order by tz_start) as o from l where leg is not null) select symbol, tz_start, round((close - open) / nullif(o, 0) * 10000, 6) as move_bps from o""")
def moves_against_leg_start(spark, d):
    df = _legs(spark, d).where(F.col(LEG).isNotNull()).withColumn("move", F.col("close") - F.col("open"))
    return rounded(pointwise.abs_to_unit(df, "move", "open", "bps", "move_bps", group=LEG), *AT, "move_bps")


_AGG = "count(*) as src_row_count, max(high) as high_max, min(low) as low_min, arg_min(open, tz_start) as open_first, arg_max(close, tz_start) as close_last, round(sum(volume), 6) as volume_sum, round(median(close), 6) as close_median"
_METRICS = [reduce.Metric(c, h) for c, h in (("high", "max"), ("low", "min"), ("open", "first"), ("close", "last"), ("volume", "sum"), ("close", "median"))]
_NAMES = ["src_row_count", "high_max", "low_min", "open_first", "close_last", "volume_sum", "close_median"]


@query(f"""{SQL_LEGS} select symbol, leg as {LEG}, {_AGG}, count(*) filter (close > open) as rising_count_true from l where leg is not null group by 1, 2""")
def rows_per_event(spark, d):
    df = _legs(spark, d).withColumn("rising", F.col("close") > F.col("open"))
    return rounded(reduce.per_event(df, LEG, [*_METRICS, reduce.Metric("rising", "count_true")]), "symbol", LEG, *_NAMES, "rising_count_true")


@query(f"""c as (select *, time_bucket(interval '3 hours', tz_start, (select min(date_trunc('day', tz_start)) from bars b where b.symbol = bars.symbol)) as chunk from bars), g as (select symbol, chunk, {_AGG} from c group by 1, 2),
s as (select symbol, unnest(generate_series(min(chunk), max(chunk), interval '3 hours')) as chunk from g group by 1)
select s.symbol, s.chunk, coalesce(src_row_count, 0) as src_row_count, high_max, low_min, open_first, close_last, coalesce(volume_sum, 0) as volume_sum, close_median from s left join g using (symbol, chunk)""")
def rows_per_time_chunk(spark, d):
    return rounded(reduce.per_time_chunk(bars(spark, d), 3 * 3600, _METRICS, with_empty=True), "symbol", "chunk", *_NAMES)


@query("""d as (select symbol, date_trunc('day', tz_start) as chunk, sum(high - low) as path, count(*) as n from bars group by 1, 2) select symbol, chunk, n as src_row_count, round(path, 6) as path_len_sum from d""")
def daily_path_lengths(spark, d):
    df = pointwise.with_path_length(bars(spark, d))
    return rounded(reduce.per_time_chunk(df, 86400, [reduce.Metric("path_len", "sum")]), "symbol", "chunk", "src_row_count", "path_len_sum")


@query(f"""{SQL_SLICES}, n as (select slice_key, count(*) as n, min(open_time) as first, max(open_time) as last from sl group by 1), x as (select *, cast(split_part(slice_key, ':', 3) as bigint) as start_ms from n), now as (select max(start_ms) + {12 * 3_600_000} as now from x)
select slice_key, n, first, last, case when start_ms + {24 * 3_600_000} <= now then 'complete' else 'partial' end as status, case when start_ms + {24 * 3_600_000} <= now then 'none' else 'still_forming' end as reason from x, now""")
def slices_by_elapsed_time(spark, d):
    slices, step = _slices(spark, d), 3_600_000
    expected = slices.select("slice_key").distinct().withColumn("start_ms", ledger.split_key()["start_ms"])
    expected = expected.withColumn("last_ms", F.col("start_ms") + 23 * step)
    now = expected.agg(F.max("start_ms")).first()[0] + 12 * step
    return ledger.by_elapsed_time(expected, slices, step, now).select("slice_key", "n", "first", "last", "status", "reason")


SQL_PATHS = SQL_LEGS + """, p as (select symbol, leg, min(tz_start) as start_ts, max(tz_start) as end_ts, count(*) as bars, arg_min(open, tz_start) as first_open, arg_max(close, tz_start) as last_close, arg_min(high, tz_start) as first_high, arg_min(low, tz_start) as first_low, max(high) as max_high, min(low) as min_low from l where leg is not null group by 1, 2)"""


@query(f"""{SQL_PATHS} select symbol, leg as {LEG}, start_ts, end_ts, bars, first_open, last_close, max_high, min_low from p""")
def condition_paths(spark, d):
    return rounded(reduce.condition_paths(_legs(spark, d), LEG), "symbol", LEG, "start_ts", "end_ts", "bars", "first_open", "last_close", "max_high", "min_low", n=9)


def _models(model, up):
    sign = 1 if up else -1
    entry = {"best": "first_low" if up else "first_high", "mid": "(first_high + first_low) / 2", "worst": "first_high" if up else "first_low"}[model]
    adverse, favourable = ("min_low", "max_high") if up else ("max_high", "min_low")
    return f"select symbol, leg, '{model}' as model, {str(up).lower()} as is_up, round({sign} * (last_close - ({entry})) + 0.0, 6) as pnl, round({sign} * ({adverse} - ({entry})) + 0.0, 6) as mae, round({sign} * ({favourable} - ({entry})) + 0.0, 6) as mfe from p"


@query(f"""{SQL_PATHS} {" union all ".join(_models(m, u) for m in ("best", "mid", "worst") for u in (True, False))}""")
def execution_models(spark, d):
    paths, out = reduce.condition_paths(_legs(spark, d), LEG).withColumnRenamed(LEG, "leg"), None
    for model in ("best", "mid", "worst"):
        for up in (True, False):
            df = execution.summary(paths, model, up).select("symbol", "leg", F.lit(model).alias("model"), F.lit(up).alias("is_up"), *[F.round(c, 6).alias(c) for c in ("pnl", "mae", "mfe")])
            out = df if out is None else out.unionByName(df)
    return out


@query(f"""{SQL_PATHS}, x as (select bars, last_close - (first_high + first_low) / 2 as pnl, max_high - (first_high + first_low) / 2 as mfe, min_low - (first_high + first_low) / 2 as mae from p)
select bars, count(*) as n, round(median(pnl), 6) + 0.0 as median_pnl, round(quantile_cont(mfe, 0.9), 6) + 0.0 as p90_mfe, round(quantile_cont(mae, 0.9), 6) + 0.0 as p90_mae, round(min(pnl), 6) + 0.0 as min_pnl, round(max(pnl), 6) + 0.0 as max_pnl from x group by 1""")
def execution_by_length(spark, d):
    paths = reduce.condition_paths(_legs(spark, d), LEG)
    return rounded(legs.execution_by_length(execution.summary(paths, "mid")), "bars", "n", "median_pnl", "p90_mfe", "p90_mae", "min_pnl", "max_pnl")


@query("""s as (select min(close) as lo, max(close) as hi from bars), c as (select cast(least(19, floor((close - lo) / ((hi - lo) / 20))) as int) as bucket, count(*) as k from bars, s group by 1)
select cast(b as int) as bucket, round(lo + b * ((hi - lo) / 20), 6) as lower, round(lo + (b + 1) * ((hi - lo) / 20), 6) as upper, coalesce(k, 0) as "count", round(coalesce(k, 0) / sum(k) over (), 6) as pct, round(coalesce(sum(k) over (order by b), 0) / sum(k) over (), 6) as cum_pct from s, range(20) r(b) left join c on bucket = b""")
def histogram(spark, d):
    return rounded(reduce.equal_width(bars(spark, d), "close"), "bucket", "lower", "upper", "count", "pct", "cum_pct")


@query("""b as (select symbol, time_bucket(interval '7 hours', tz_start, (select min(date_trunc('day', tz_start)) from bars b where b.symbol = bars.symbol)) as t, * exclude (symbol) from bars)
select symbol, t as tz_start, arg_min(open, tz_start) as open, max(high) as high, min(low) as low, arg_max(close, tz_start) as close, round(sum(volume), 6) as volume from b group by 1, 2""")
def resampled(spark, d):
    return rounded(resample.resample(bars(spark, d), 7 * 3600), *AT, "open", "high", "low", "close", "volume")


@query("""s as (select symbol, cast(o as int) as "offset", tz_start + to_hours(cast(o as int)) as ts, open, high, low, close, volume from bars, range(3) r(o)), f as (select symbol, "offset", date_trunc('day', min(ts)) as org from s group by 1, 2)
select s.symbol, s."offset", time_bucket(interval '3 hours', ts, org) as tz_start, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close from s join f on s.symbol = f.symbol and s."offset" = f."offset" group by 1, 2, 3""")
def offset_candles(spark, d):
    out = resample.offset_bars(bars(spark, d), 3, 3600).withColumnRenamed("bucket", "tz_start")
    return rounded(out, "symbol", "offset", "tz_start", "open", "high", "low", "close", n=9)


@query("""d as (select symbol, date_trunc('day', tz_start) as t, max(high) as high from bars group by 1, 2)
select symbol, tz_start, high, 1 as granularity_n, '1h' as granularity from bars union all select symbol, t, high, 1, '1D' from d""")
def granularity_union(spark, d):
    a = bars(spark, d).select(*AT, "high")
    b = resample.resample(bars(spark, d), 86400).select(*AT, "high").withColumn("tz_start", F.col("tz_start").cast("timestamp_ntz"))
    return resample.union_granularities({(1, "h"): a, (1, "D"): b})


@query(f"""s as (select *, epoch(tz_start) - epoch(lag(tz_start) over w) as dt, lag(tz_start) over w as before from bars {W}) select symbol, before + interval '1 hour' as gap_start, tz_start - interval '1 hour' as gap_end, cast(floor(dt / 3600) - 1 as bigint) as missing from s where dt > 3600""")
def gap_list(spark, d):
    return rounded(gaps.gaps(bars(spark, d), 3600), "symbol", "gap_start", "gap_end", "missing")


@query(f"""s as (select *, epoch(tz_start) - epoch(lag(tz_start) over w) as dt from bars {W}) select symbol, count(*) as n_rows, count(*) filter (dt = 0) as n_duplicate_ts, count(*) filter (dt > 3600) as n_gaps, cast(coalesce(sum(floor(dt / 3600) - 1) filter (dt > 3600), 0) as bigint) as n_missing,
 count(*) filter (not (low <= open and low <= close and open <= high and close <= high)) as n_inconsistent, count(*) filter (open = 0 or high = 0 or low = 0 or close = 0) as n_zero, max(dt) as max_step from s group by 1""")
def quality_report(spark, d):
    return rounded(gaps.report(bars(spark, d), 3600), "symbol", "n_rows", "n_duplicate_ts", "n_gaps", "n_missing", "n_inconsistent", "n_zero", "max_step")


SQL_SPINE = f"""sp as (select symbol, unnest(generate_series(min(tz_start), max(tz_start), interval '1 hour')) as tz_start from bars group by 1), m as (select sp.symbol, sp.tz_start, open, high, low, close, bars.symbol is null as mat from sp left join bars using (symbol, tz_start)),
k as (select *, (mat and not coalesce(lag(mat) over w, false))::int as st from m {W}), bl as (select *, case when mat then sum(st) over w end as block from k {W}),
f as (select *, last_value(close ignore nulls) over w as a, first_value(open ignore nulls) over (partition by symbol order by tz_start rows between current row and unbounded following) as b, row_number() over (partition by symbol, block order by tz_start) as i, count(*) over (partition by symbol, block) as n from bl {W})"""


@query(f"""{SQL_SPINE} select symbol, tz_start, case when mat then a else open end as open, case when mat then a else high end as high, case when mat then a else low end as low, case when mat then a else close end as close, mat as is_synthetic, case when mat then 'constant' end as fill_policy from f""")
def filled_constant(spark, d):
    df = gaps.fill(gaps.materialize(bars(spark, d), 3600), gaps.ConstantFill())
    return rounded(df, *AT, "open", "high", "low", "close", "is_synthetic", "fill_policy", n=9)


@query(f"""{SQL_SPINE}, g as (select *, a + (b - a) * (i - 1) / (n + 1) as o1, a + (b - a) * i / (n + 1) as c1, abs(b - a) as sg from f)
select symbol, tz_start, round(case when mat then o1 else open end, 6) as open, round(case when mat then greatest(o1, c1) + sg else high end, 6) as high, round(case when mat then least(o1, c1) - sg else low end, 6) as low, round(case when mat then c1 else close end, 6) as close from g""")
def filled_linear(spark, d):
    return rounded(gaps.fill(gaps.materialize(bars(spark, d), 3600), gaps.LinearFill()), *AT, "open", "high", "low", "close")


@query(f"""{SQL_SPINE}, dd as (select symbol, date_trunc('day', tz_start) as t, arg_min(open, tz_start) as o, max(high) as h, min(low) as l, arg_max(close, tz_start) as c from bars group by 1, 2)
select m.symbol, tz_start, {", ".join(f"case when mat and o is not null then {c[0]} else {c} end as {c}" for c in ("open", "high", "low", "close"))}, mat and o is not null as is_synthetic, case when mat and o is not null then 'daily' end as fill_policy from m left join dd on m.symbol = dd.symbol and m.tz_start = dd.t""")
def filled_from_sources(spark, d):
    df = gaps.materialize(bars(spark, d), 3600)
    daily = bars(spark, d, "day")
    return gaps.fill_from_sources(df, {"daily": daily}).select(*AT, "open", "high", "low", "close", "is_synthetic", "fill_policy")


_TWICE = """u0 as (select symbol, tz_start, open, high, low, close, round(volume, 6) as volume, num_trades from bars), u as (select * exclude (num_trades) from u0 union all select * exclude (num_trades) from u0 where num_trades > 3 union all select symbol, tz_start, open + 1, high, low, close, volume from u0 where num_trades > 5),
c as (select *, count(*) over k as n, count(distinct (open, high, low, close, volume)) over k as kinds from u window k as (partition by symbol, tz_start))"""


def _twice(spark, d):
    b = bars(spark, d).withColumn("volume", F.round("volume", 6))
    prices = [*AT, "open", "high", "low", "close", "volume"]
    return b.select(*prices).unionByName(b.where("num_trades > 3").select(*prices)).unionByName(b.where("num_trades > 5").withColumn("open", F.col("open") + 1).select(*prices))


@query(f"""{_TWICE} select 'kept' as part, * exclude (n, kinds) from (select distinct * from c where kinds = 1) union all select 'kept', * exclude (n, kinds) from c where kinds > 1 union all select 'conflict', * exclude (n, kinds) from c where kinds > 1""")
def deduplicated(spark, d):
    rows, conflicts = gaps.dedupe(_twice(spark, d))
    return rows.withColumn("part", F.lit("kept")).unionByName(conflicts.withColumn("part", F.lit("conflict")))


@query(f"""{_TWICE}, g as (select *, epoch(tz_start) - epoch(lag(tz_start) over w) as dt from c {W}), i as (
select symbol, tz_start, unnest(list_filter([case when n > 1 then 'duplicate' end, case when kinds > 1 then 'conflict' end, case when open = 0 or high = 0 or low = 0 or close = 0 then 'zero' end,
  case when not (low <= open and low <= close and open <= high and close <= high) then 'inconsistent' end, case when dt > 3600 then 'gap_before' end], lambda x: x is not null)) as issue from g)
select symbol, issue, count(*) as n, count(distinct tz_start) as times from i group by 1, 2""")
def quality_issues(spark, d):
    """Of rows of one time any may be the first after a gap, so that rows are counted."""
    found = gaps.quality(_twice(spark, d), 3600)[2]
    return found.groupBy("symbol", "issue").agg(F.count("*").alias("n"), F.countDistinct("tz_start").alias("times"))


@query(f"""{_TWICE} select distinct symbol, tz_start, open, high, low, close, volume from c where kinds = 1 and low <= open and low <= close and open <= high and close <= high and open <> 0 and high <> 0 and low <> 0 and close <> 0""")
def quality_clean(spark, d):
    return gaps.quality(_twice(spark, d), 3600)[0].select(*AT, "open", "high", "low", "close", "volume")


@query("""s as (select distinct symbol, tz_start from bars), r as (select *, row_number() over w as rn, epoch(tz_start) - epoch(lag(tz_start) over w) as seconds from s window w as (partition by symbol order by tz_start)) select symbol, cast(seconds as double) as seconds from r where rn = 2""")
def first_steps(spark, d):
    return gaps.infer_seconds(bars(spark, d))


SQL_GAPS = f"""gp as (select *, epoch(tz_start) - epoch(lag(tz_start) over w) as dt, lag(tz_start) over w as before from bars {W}), gl as (select symbol, before + interval '1 hour' as gap_start, tz_start - interval '1 hour' as gap_end, cast(floor(dt / 3600) - 1 as bigint) as missing from gp where dt > 3600)"""


@query(f"{SQL_GAPS} select missing, count(*) as gaps from gl group by 1")
def gap_size_counts(spark, d):
    return gaps.gap_sizes(gaps.gaps(bars(spark, d), 3600))


@query(f"{SQL_GAPS} select symbol, unnest(generate_series(gap_start, gap_end, interval '1 hour')) as tz_start from gl")
def missing_hours(spark, d):
    return rounded(gaps.missing_times(bars(spark, d), 3600), *AT)


@query(f"{SQL_GAPS} select symbol, gap_start as from_ts, gap_end as to_ts from gl")
def fetch_plan(spark, d):
    return rounded(gaps.fetch_windows(gaps.missing_times(bars(spark, d), 3600), 3600), "symbol", "from_ts", "to_ts")


@query(f"select symbol, tz_start, coalesce(epoch(tz_start) - epoch(lag(tz_start) over w) <> 3600, true) as unexpected_interval from bars {W}")
def unexpected_intervals(spark, d):
    return gaps.unexpected_interval(bars(spark, d), 3600).select(*AT, "unexpected_interval")


@query("select symbol, cast(epoch(timestamp '2030-01-01') - epoch(max(tz_start)) as bigint) as seconds_stale from bars group by 1")
def stale_series(spark, d):
    return gaps.staleness(bars(spark, d), F.lit("2030-01-01").cast("timestamp_ntz"))


_ODD = "o as (select symbol, tz_start, case when num_trades % 5 = 0 then 0 else open end as open, case when num_trades % 3 = 0 then high - 30 else high end as high, low, case when num_trades % 7 = 0 then null else close end as close from bars)"


def _odd(spark, d):
    when = lambda n, x, c: F.when(F.col("num_trades") % n == 0, x).otherwise(F.col(c))
    return bars(spark, d).withColumns({"open": when(5, F.lit(0.0), "open"), "high": when(3, F.col("high") - 30, "high"), "close": when(7, F.lit(None), "close")}).select(*AT, "open", "high", "low", "close")


@query(f"{_ODD} select symbol, tz_start, open, high, low, close from o where open = 0 or high = 0 or low = 0 or close = 0")
def zero_bars(spark, d):
    return gaps.zeros(_odd(spark, d))


@query(f"{_ODD} select symbol, tz_start, open, high, low, close from o where high - low > 90 or (high - low) / nullif((high + low) / 2, 0) > 1.5")
def unrealistic_bars(spark, d):
    return gaps.unrealistic(_odd(spark, d), 90, 1.5)


@query(f"""{_ODD}, f as (select symbol, tz_start, not coalesce(low <= open, false) as open_below_low, not coalesce(low <= close, false) as close_below_low, not coalesce(open <= high, false) as open_above_high, not coalesce(close <= high, false) as close_above_high, not coalesce(high >= low, false) as high_below_low from o)
select * from f where open_below_low or close_below_low or open_above_high or close_above_high or high_below_low""")
def inconsistent_bars(spark, d):
    return gaps.inconsistent(_odd(spark, d)).drop("open", "high", "low", "close")


@query("""select symbol, tz_start, year(tz_start) = 2024 as in_2024, year(tz_start) = 2024 and quarter(tz_start) = 1 as in_q1, year(tz_start) = 2024 and month(tz_start) = 2 as in_february, month(tz_start) in (1, 12) as in_winter, hour(tz_start) in (0, 13) as at_hours, minute(tz_start) in (0, 30) as at_minutes,
 tz_start >= timestamp '2024-01-20' - interval '3 days' and tz_start <= timestamp '2024-01-20' as last_days, tz_start >= timestamp '2024-01-01' and tz_start <= timestamp '2024-01-20' as month_to_date, tz_start >= timestamp '2024-01-01' and tz_start <= timestamp '2024-01-20' as year_to_date from bars""")
def calendar_parts(spark, d):
    ts, now = F.col("tz_start"), F.lit("2024-01-20").cast("timestamp_ntz")
    parts = {
        "in_2024": calendar.in_year(ts, 2024), "in_q1": calendar.in_quarter(ts, 2024, 1), "in_february": calendar.in_month(ts, 2024, 2), "in_winter": calendar.in_month_of_year(ts, (1, 12)), "at_hours": calendar.in_hour_of_day(ts, (0, 13)),
        "at_minutes": calendar.in_minute_of_hour(ts, (0, 30)), "last_days": calendar.last_n_days(ts, 3, now), "month_to_date": calendar.to_date_of(ts, "month", now), "year_to_date": calendar.to_date_of(ts, "year", now),
    }
    return bars(spark, d).withColumns(parts).select(*AT, *parts)


_EVENT = "select event_id, event_type, ts, value from events"


@query(f"""a as ({_EVENT} where value > 50 and event_type = 'error'), b as ({_EVENT} where value > 95 or event_type = 'error'), u as (select *, 0 as k from a union all select *, 1 from b)
select * exclude (k, nth) from (select *, row_number() over (partition by ts order by k, event_id) as nth from u) where nth = 1""")
def combined_events(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "ts", "value")
    error = F.col("event_type") == "error"
    found = calendar.combine_events(calendar.where_all(events, [F.col("value") > 50, error]), calendar.where_any(events, [F.col("value") > 95, error]))
    return rounded(found, "event_id", "event_type", "ts", "value", n=9)


@query("""a as (select event_id, ts from events where event_type = 'error'), b as (select 'before' as side, symbol, tz_start, min(event_id) as event_id from bars join a on tz_start between ts - interval '1 hour' and ts group by 2, 3),
c as (select 'after' as side, symbol, tz_start, min(event_id) as event_id from bars join a on tz_start between ts and ts + interval '1 hour' group by 2, 3) select * from b union all select * from c""")
def one_sided_events(spark, d):
    events, own = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'"), bars(spark, d)
    before = calendar.before_anchors(own, "tz_start", events, 3600, AT).withColumn("side", F.lit("before"))
    after = calendar.after_anchors(own, "tz_start", events, 3600, AT).withColumn("side", F.lit("after"))
    return before.unionByName(after).select("side", *AT, "event_id")


@query(f"""{" union all ".join(f"select symbol, {h * 3600} as candle_seconds, time_bucket(interval '{h} hours', tz_start, (select min(date_trunc('day', tz_start)) from bars b where b.symbol = bars.symbol)) as tz_start, arg_min(open, tz_start) as open, max(high) as high, min(low) as low, arg_max(close, tz_start) as close from bars group by 1, 2, 3".replace("select symbol", "select bars.symbol", 1) for h in (2, 5))}""")
def resampled_sizes(spark, d):
    made = resample.resample_all(bars(spark, d), (7200, 18000))
    return rounded(made[7200].unionByName(made[18000]), "symbol", "candle_seconds", "tz_start", "open", "high", "low", "close", n=9)


@query("""select symbol, tz_start, year(tz_start) as year, quarter(tz_start) as quarter, month(tz_start) as month, isodow(tz_start) - 1 as dow, hour(tz_start) as hour from bars
where isoyear(tz_start) = 2024 and weekofyear(tz_start) in (2, 3) and isodow(tz_start) - 1 in (0, 1, 2, 3, 4) and tz_start >= timestamp '2024-01-09' and tz_start < timestamp '2024-01-20'""")
def calendar_filters(spark, d):
    ts = F.col("tz_start")
    df = bars(spark, d).where((calendar.in_week_of_year(ts, 2024, 2) | calendar.in_week_of_year(ts, 2024, 3)) & calendar.in_day_of_week(ts, range(5)))
    df = df.where(calendar.between(ts, F.lit("2024-01-09").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))
    return calendar.with_calendar_labels(df, "tz_start").select(*AT, "year", "quarter", "month", "dow", "hour")


def _local(tz: str) -> str:
    return f"cast(timezone('{tz}', timezone('UTC', tz_start)) as time)"


def _session_sql(name: str) -> str:
    a, b, tz = calendar.SESSIONS[name]
    return f"({_local(tz)} >= time '{a}:00' and {_local(tz)} < time '{b}:00')"


@query(f"""select symbol, tz_start, {", ".join(f"{_session_sql(n)} as in_{n}" for n in calendar.SESSIONS)}, {_session_sql("ny_premarket")} or {_session_sql("ny_cash")} or {_session_sql("ny_afterhours")} as in_ny_extended,
 {_session_sql("london")} and {_local("America/New_York")} >= time '08:00:00' and {_local("America/New_York")} < time '17:00:00' as in_london_ny_overlap from bars""")
def session_marks(spark, d):
    return calendar.with_session_marks(bars(spark, d), "tz_start").select(*AT, *[f"in_{n}" for n in (*calendar.SESSIONS, "ny_extended", "london_ny_overlap")])


@query("""a as (select event_id, ts from events where event_type = 'error') select symbol, tz_start, min(event_id) as event_id from bars join a on tz_start between ts - interval '2 hours' and ts + interval '1 hour' group by 1, 2""")
def around_events(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'")
    return calendar.around(bars(spark, d), "tz_start", calendar.windows_around(events, "ts", 7200, 3600), AT).select(*AT, "event_id")


_STEP = 3_600_000


def _slices(spark, d):
    t = F.unix_millis(F.col("tz_start").cast("timestamp"))
    return bars(spark, d).select(F.concat_ws(":", "symbol", F.lit("1h"), F.floor(t / (24 * _STEP)) * 24 * _STEP, F.lit(24)).alias("slice_key"), t.alias("open_time"))




@query(f"""{SQL_SLICES}, dl as (select *, open_time - lag(open_time) over (partition by slice_key order by open_time) as dt from sl)
select slice_key, count(*) as n, min(open_time) as first, max(open_time) as last, count(*) filter (dt > {_STEP}) as n_gaps, case when count(*) = 24 then 'complete' else 'partial' end as status from dl group by 1""")
def slice_integrity(spark, d):
    return ledger.integrity(_slices(spark, d), _STEP, 24, 1_800_000_000_000).select("slice_key", "n", "first", "last", "n_gaps", "status")


@query(f"""{SQL_SLICES}, led as (select slice_key, case when count(*) = 24 then 'complete' else 'partial' end as status from sl group by 1), sp as (select min(epoch_ms(tz_start)) // {24 * _STEP} * {24 * _STEP} as a, max(epoch_ms(tz_start)) as b from bars), ex as (select symbol || ':1h:' || cast(s as varchar) || ':24' as slice_key from (select distinct symbol from bars), (select unnest(range(a, b + {3 * 24 * _STEP}, {24 * _STEP})) as s from sp))
select coalesce(status, 'missing') as status, count(*) as slices from ex left join led using (slice_key) group by 1""")
def slice_summary(spark, d):
    slices, span = _slices(spark, d), 24 * _STEP
    have = ledger.integrity(slices, _STEP, 24, 1_800_000_000_000).select("slice_key", "status")
    symbols = bars(spark, d).select("symbol").distinct()
    first, last = slices.agg(F.min("open_time"), F.max("open_time")).first()
    starts = raw_bars.slice_plan(spark, "x", "1h", first // span * span, last + 3 * span, _STEP, 24).select("start_ms")  # and two more, that are missing
    expected = symbols.join(F.broadcast(starts)).select(F.concat_ws(":", "symbol", F.lit("1h"), "start_ms", F.lit(24)).alias("slice_key"))
    return ledger.summary(ledger.classify(expected, have))


@query("""select symbol, tz_start, epoch_ms(tz_start) // 25200000 * 25200000 as floored, epoch_ms(tz_start) // 25200000 as whole from bars""")
def interval_math(spark, d):
    ms = F.unix_millis(F.col("tz_start").cast("timestamp"))
    step = times.interval_ms("7h")
    return bars(spark, d).select(*AT, times.floor_to(ms, step).alias("floored"), times.whole_intervals(F.lit(0), ms, step).alias("whole"))


@query("""select date_trunc('day', tz_start) as period, symbol, count(distinct num_trades) as n_distinct from bars group by 1, 2""")
def distinct_per_day(spark, d):
    return rounded(reduce.distinct_per_period(bars(spark, d), "num_trades", 1), "period", "symbol", "n_distinct")


def same_rows_as(name: str):
    def keep(f):
        ALL[f.__name__] = (f, ALL[name][1])
        return f

    return keep


@same_rows_as("bollinger")
def bollinger_in_blocks(spark, d):
    df = blocks.in_blocks(bars(spark, d), lambda df, series: indicators.with_bollinger(df, series=series), 19, rows=64)
    return rounded(df, *AT, "boll_mid", "boll_upper", "boll_lower", "boll_valid")


@same_rows_as("macd")
def macd_in_blocks(spark, d):
    """500 rows before weigh less than 1e-16 in the slowest of the averages."""
    df = blocks.in_blocks(bars(spark, d), lambda df, series: indicators.with_macd(df, series=series), 500, rows=512)
    return rounded(df, *AT, "ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist", "macd_ready", "macd_signal_ready")


@same_rows_as("counters")
def counters_in_blocks(spark, d):
    df = _abc(spark, d).withColumns({"ab": F.col("a") & F.col("b"), "two": flag(F.col("a")) + flag(F.col("b")) + flag(F.col("c")) >= 2, "bc": F.col("b") | F.col("c")})
    streaks = {"a__run_true": "a", "ab_run": "ab", "two_run": "two"}
    since = {"b__bars_since_true": "b", "bc_since": "bc"}
    df = blocks.with_running(df, {n: blocks.running_true(c) for n, c in streaks.items()} | {n: blocks.bars_since(c) for n, c in since.items()}, rows=64)
    return df.select(*AT, "a__run_true", "ab_run", "two_run", "b__bars_since_true", "bc_since")


@same_rows_as("condition_group_ids")
def group_ids_in_blocks(spark, d):
    return blocks.with_group_id(_abc(spark, d), "a", "leg_id", rows=64).select(*AT, "leg_id")


@same_rows_as("vwaps")
def vwaps_in_blocks(spark, d):
    return rounded(indicators.with_session_vwap(blocks.with_running(bars(spark, d), {"vwap": blocks.vwap()}, rows=64)), *AT, "vwap", "vwap_session")


def queries() -> dict:
    return {n: f for n, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in ALL.items() if sql}
