"""Operators over ordered series, against literal vectors."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditions, execution, features, gaps, indicators, legs, pointwise, reduce, relations, resample
from tidemark.operators.series import Series

S = Series(("k",), "i")


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(["k string", "i long", *(f"{c} {kinds[type(next(x for x in v if x is not None))]}" for c, v in columns.items())])
    return spark.createDataFrame([("a", i, *(v[i] for v in columns.values())) for i in range(n)], schema)


def column(df, name):
    return [r[0] for r in df.orderBy("i").select(name).collect()]


def test_pointwise(spark):
    df = frame(spark, open=[10.0, 10.0, 11.0, 10.0, 0.0, 0.0], close=[10.0, 11.0, 11.0, 12.0, 12.0, 0.0], txt=list("abcdef"))
    out = pointwise.with_diff(df.drop("i").withColumn("i", F.col("close") * 0) if False else df, ["open", "close"], 1, S)
    assert column(out, "open__diff_1")[2] == 1 and column(out, "close__diff_1")[3] == 1
    assert column(pointwise.with_diff(df, ["close"], 2, S), "close__diff_2")[2:4] == [1, 1]
    assert column(pointwise.with_pct_change(df, ["close"], 3, series=S), "close__pct_3")[3] == pytest.approx(0.2)
    assert column(pointwise.with_pct_change(df, ["open"], 1, series=S), "open__pct_1")[5] is None
    assert column(pointwise.with_bar_direction(df, "close", 1, S), "close__diff_1__direction") == [None, 1, 0, 1, 0, -1]
    assert column(pointwise.with_sign(df, ["open"], zero_as_zero=False), "open__sign")[-1] == 1
    assert column(pointwise.null_if(df, F.col("open") == 0, ["close"]), "close")[-2:] == [None, None]
    assert pointwise.move_column(df, "txt", 0).columns[0] == "txt"
    with pytest.raises(ValueError):
        pointwise.keep_policy(df, "open", ["open"])


def test_bar_relations(spark):
    df = frame(spark, open=[10.0, 10.5, 10.0, 10.7, 10.7], high=[11.0, 11.5, 10.8, 12.0, 12.0], low=[9.0, 9.5, 9.8, 9.2, 10.0], close=[10.5, 10.3, 10.6, 11.9, 10.7])
    out = relations.with_bar_relations(df, S)
    assert column(out, "high__higher_high") == [False, True, False, True, False]
    assert column(out, "low__lower_low") == [False, False, False, True, False]
    assert column(out, "open__higher_open") == [False, True, False, True, False]
    assert column(relations.with_true_range(df, S), "true_range")[0] == 2.0


def test_comparators_take_null_as_false(spark):
    df = frame(spark, a=[1.0, 2.0, None, 5.0, 5.0], b=[0.5, 2.0, 3.0, 4.0, 5.1])
    assert column(relations.with_relation(df, "a", "gt", "b"), "a__gt__b") == [True, False, False, True, False]
    assert column(relations.with_relation(df, "a", "eq", "b", 0.2), "a__eq__b") == [False, True, False, False, True]
    assert column(relations.with_relation(df, "a", "ne", "b"), "a__ne__b") == [True, False, True, True, True]


def test_conditions_and_counters(spark):
    df = frame(spark, a=[True, True, False, True, None, True], b=[True, False, False, None, True, True])
    assert column(conditions.with_running_true(df, "a", series=S), "a__run_true") == [1, 2, 0, 1, 0, 1]
    since = frame(spark, c=[False, None, False, True, False, False, True])
    assert column(conditions.with_bars_since(since, "c", series=S), "c__bars_since_true") == [None, None, None, 0, 1, 2, 0]
    assert column(conditions.all_of(df, ["a", "b"], "x"), "x") == [True, False, False, False, False, True]
    assert column(conditions.with_group_id(df, "a", "g", S), "g") == [1, 1, None, 2, None, 3]
    with pytest.raises(TypeError):
        conditions.all_of(df, ["i"], "x")
    with pytest.raises(ValueError):
        conditions.at_least(df, ["a"], "x", 2)
    seg = frame(spark, m=["", "s", "", "e", "", "s", ""])
    start, end = F.col("m") == "s", F.col("m") == "e"
    assert column(conditions.with_id_between(seg, start, end, "x", series=S), "x") == [None, 1, 1, None, None, 2, 2]
    assert column(conditions.with_id_between(seg, start, end, "x", False, True, S), "x") == [None, None, 1, 1, None, None, 2]
    rel = frame(spark, r=["above", "above", None, None, "below"], g=[1, 1, 1, 1, 1])
    assert column(conditions.with_streaks(rel, "r", "g", S), "streak_id") == [1, 1, 2, 3, 4]


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 13, 0.9])
def test_ewm_equals_the_recursion(spark, alpha):
    x = [None, None] + [math.sin(i * 1.7) * 50 + i for i in range(900)]
    got, y = column(indicators.with_ewm(frame(spark, x=x), "x", alpha, "y", S), "y"), None
    for value, out in zip(x, got, strict=True):
        if value is None:
            assert out is None
            continue
        y = value if y is None else (1 - alpha) * y + alpha * value
        assert out == pytest.approx(y, rel=1e-12)


def test_atr_and_vwap(spark):
    df = frame(spark, high=[10.0, 11.0, 12.0, 11.5, 12.2], low=[9.0, 9.5, 10.5, 10.8, 11.7], close=[9.5, 10.5, 11.0, 11.2, 12.0], volume=[0.0, 2.0, 0.0, 3.0, 4.0])
    tr = column(relations.with_true_range(df, S), "true_range")
    want = [None, None, sum(tr[:3]) / 3]
    for t in tr[3:]:
        want.append((want[-1] * 2 + t) / 3)
    assert column(indicators.with_atr(df, 3, "atr", S), "atr") == [None, None, *(pytest.approx(w) for w in want[2:])]
    vwap = column(indicators.with_vwap(df, series=S), "vwap")
    assert vwap[0] is None and vwap[1] == vwap[2] == pytest.approx((11 + 9.5 + 10.5) / 3)


def test_width_pressure(spark):
    out = features.with_width_pressure(frame(spark, width_step=[1, 1, 0, 1, -1, -1, -1]), m=3, k=2, series=S)
    assert column(out, "width_pressure_up") == [False, False, True, True, False, False, False]
    assert column(out, "width_pressure_down") == [False, False, False, False, False, True, True]


def test_histogram_colors_and_patterns(spark):
    out = features.with_hist_color(frame(spark, h=[1.0, 2.0, 1.0, -1.0]), "h", series=S)
    assert column(out, "hist_color") == ["light_green", "dark_green", "light_green", "light_red"]
    colors = ["light_red", "dark_green", "dark_green", "light_green", "dark_red", "light_red", "dark_green"]
    df = frame(spark, hist_color=colors)
    assert column(features.with_pyramids(df, series=S), "pyramid") == [False, True, True, True, True, True, False]
    assert column(features.with_crossings(df, series=S), "crossing") == [False if c == "x" else v for c, v in zip(colors, [True, True, True, True, True, True, True], strict=True)]
    assert column(features.with_loose_pyramids(df, series=S), "loose_green") == [False, True, True, True, False, False, False]


def test_pyramid_annotation(spark):
    df = frame(spark, h=[-1.0, -2.0, -3.0, -2.0, 1.0, 2.0, 5.0, 4.0], g=[1, 1, 1, 1, 2, 2, 2, 2])
    out = features.pyramid_annotation(features.with_hist_color(df, "h", series=S), "h", "g", series=S)
    assert column(out, "pyr_apex_ord") == [2] * 8 and column(out, "pyr_apex_val") == [3.0] * 4 + [5.0] * 4
    one = features.with_hist_color(frame(spark, h=[-1.0, -3.0, -2.0, -5.0, -4.0], g=[1] * 5), "h", series=S)
    assert column(features.pyramid_annotation(one, "h", "g", series=S), "pyr_front_viol") == [0, 0, 1, 0, 0]
    two = features.with_hist_color(frame(spark, h=[-1.0, -2.0, -5.0, -3.0, -4.0], g=[1] * 5), "h", series=S)
    assert column(features.pyramid_annotation(two, "h", "g", series=S), "pyr_back_viol") == [0, 0, 0, 0, 1]


def test_segment_extreme(spark):
    out = features.with_segment_extreme(frame(spark, v=[1.0, 3.0, 3.0, -1.0, -2.0, 4.0]), "v", 2, series=S)
    assert column(out, "is_extreme") == [False, True, False, False, True, False]


def test_excursion_and_events(spark):
    df = frame(spark, leg=[1, 1, 1, 2, 2], open=[100.0, 100.0, 100.0, 200.0, 200.0], high=[101.0, 103.0, 105.0, 201.0, 205.0], low=[99.0, 99.0, 99.0, 198.0, 198.0])
    out = legs.excursion(df, "leg", True, True, series=S)
    assert column(out, "exc_is_max") == [False, False, True, False, True] and column(out, "exc_n_bars") == [3, 3, 3, 2, 2]
    ev = frame(spark, leg=[1, 1, 1, 2, 2, None], ts=[10, 11, 12, 20, 21, 30], mae=[1.0, 2.0, 4.0, 0.5, 3.5, 9.0], flag=[False, False, True, False, True, True])
    metrics = [reduce.Metric("ts", "first"), reduce.Metric("ts", "last"), reduce.Metric("mae", "max"), reduce.Metric("flag", "count_true")]
    rows = reduce.per_event(ev, "leg", metrics, series=S).orderBy("leg").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 3, 10, 12, 4.0, 1), (2, 2, 20, 21, 3.5, 1)]
    with pytest.raises(TypeError):
        reduce.per_event(ev, "leg", [reduce.Metric("mae", "count_true")], series=S)
    mfe = spark.createDataFrame([(3, 2), (2, 1), (1, 0)], "len int, idx int")
    got = legs.mfe_survival(mfe, "len", "idx", 4).orderBy("t").collect()
    assert [(r.survivors, r.rate) for r in got] == [(3, pytest.approx(2 / 3)), (2, 1.0), (1, 1.0), (0, None)]


def test_histogram_and_zoom(spark):
    df = frame(spark, x=[float(v) for v in [0] * 95 + [1, 2, 3, 4, 100]])
    out = reduce.equal_width(df, "x", 10).orderBy("bucket").collect()
    assert [r["count"] for r in out] == [99, 0, 0, 0, 0, 0, 0, 0, 0, 1] and out[-1].cum_pct == 1.0
    assert len(reduce.zoom(df, "x", 10, 0.9, 4)) >= 2
    reduce.complete_domain(spark.createDataFrame([(1,), (2,)], "n long"))
    with pytest.raises(ValueError):
        reduce.complete_domain(spark.createDataFrame([(1,), (3,)], "n long"))


TIMES = ["2024-01-01 10:00:00", "2024-01-01 10:03:00", "2024-01-01 10:04:00"]


def bars(spark, close=(101.0, 107.0, 108.0), times=TIMES):
    rows = [("a", t, c, c + 1, c - 1, c, 1.0) for t, c in zip(times, close, strict=True)]
    return spark.createDataFrame(rows, "symbol string, t string, open double, high double, low double, close double, volume double").withColumn("tz_start", F.col("t").cast("timestamp")).drop("t")


def test_gaps_and_fill(spark):
    df = bars(spark)
    spine = gaps.materialize(df, 60)
    out = gaps.fill(spine, gaps.ConstantFill()).orderBy("tz_start").collect()
    assert [r.is_synthetic for r in out] == [False, True, True, False, False]
    assert all(r.open == r.high == r.low == r.close == 101.0 and r.fill_policy == "constant" for r in out[1:3])
    line = gaps.fill(spine, gaps.LinearFill()).orderBy("tz_start").collect()
    assert [r.close for r in line] == [101.0, 103.0, 105.0, 107.0, 108.0] and line[1].open == 101.0
    assert gaps.gaps(df, 60).first().missing == 2
    gaps.verify_filled(gaps.fill(spine, gaps.ConstantFill()), 2)
    with pytest.raises(ValueError):
        gaps.validate(df, 60)
    with pytest.raises(ValueError):
        gaps.fill(df, gaps.ConstantFill())
    assert gaps.fetch_windows(gaps.missing_times(df, 60), 60).count() == 1


def test_dedupe(spark):
    df = bars(spark, (1.0, 1.0, 999.0), [TIMES[0]] * 2 + [TIMES[0]])
    same, none = gaps.dedupe(df.where("close = 1"))
    assert same.count() == 1 and none.count() == 0
    rows, conflicts = gaps.dedupe(df)
    assert rows.count() == conflicts.count() == 3
    with pytest.raises(Exception, match="differ"):
        gaps.dedupe(df, strict=True)[0].collect()


def test_resample_and_paths(spark):
    times = [f"2024-01-01 00:{m:02d}:00" for m in range(10)]
    df = bars(spark, [float(m) for m in range(10)], times)
    out = resample.resample(df, 300).orderBy("tz_start").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in out] == [(0.0, 5.0, -1.0, 4.0, 5.0), (5.0, 10.0, 4.0, 9.0, 5.0)]
    assert resample.offset_bars(df, 5, 60).select("offset").distinct().count() == 5
    paths = reduce.condition_paths(df.withColumn("g", F.lit(1)), "g")
    r = execution.summary(paths, "worst", True).first()
    assert (r.pnl, r.mae, r.mfe) == (8.0, -2.0, 9.0)
    execution.register("half", lambda p: p.withColumn("pnl", F.col("last_close") / 2))
    assert execution.summary(paths, ("diy", "half")).first().pnl == 4.5
