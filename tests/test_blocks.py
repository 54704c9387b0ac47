"""Series over blocks of rows give what plain windows over whole series give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, conditions, indicators
from tidemark.operators.series import BARS, Series

KEY = Series(tie=("i",))


@pytest.fixture(scope="module")
def long(spark):
    """One series of 3000 rows, half of them on one day, a short one, one under a null key; nulls among the values."""
    rng, rows, start = random.Random(3), [], dt.datetime(2024, 1, 1)
    for symbol, n in (("a", 3000), ("b", 7), (None, 120)):
        for i in range(n):
            at = start + dt.timedelta(hours=i) if i < n // 2 else start + dt.timedelta(days=200, seconds=i // 3)
            v = rng.uniform(1, 100)
            rows.append((symbol, at, i, v, v + 1, v - 1, None if rng.random() < 0.05 else v, float(rng.randint(0, 9)), None if rng.random() < 0.1 else rng.random() < 0.7))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, tz_start timestamp, i int, open double, high double, low double, close double, volume double, up boolean").repartition(4).cache()


def same(a, b, *names):
    order = lambda df: sorted(((r.symbol or "", r.i, *(None if r[n] is None else round(r[n], 7) if isinstance(r[n], float) else r[n] for n in names)) for r in df.collect()), key=lambda r: r[:2])
    got, want = order(a), order(b)
    assert got == want


@pytest.mark.parametrize("rows", [1, 50, 1 << 20])
def test_windows_with_their_neighbours(long, rows):
    def run(df, series):
        df = indicators.with_bollinger(df, n=20, series=series)
        return df.withColumns({"was": series.lag("close", 3), "next": series.lag("close", -2), "ew_in": F.lit(1)})

    got = blocks.in_blocks(long, run, 19, 2, series=KEY, rows=rows)
    assert set(got.columns) == {*long.columns, "boll_mid", "boll_upper", "boll_lower", "boll_valid", "was", "next", "ew_in"}
    same(got, run(long, KEY), "boll_mid", "boll_upper", "boll_lower", "boll_valid", "was", "next")


@pytest.mark.parametrize("rows", [1, 64])
def test_running_values_are_carried(long, rows):
    opts = {"series": KEY, "rows": rows}
    same(blocks.with_group_id(long, "up", "g", **opts), conditions.with_group_id(long, "up", "g", series=KEY), "g")
    c, w = F.col("close"), KEY.cum()
    plain = indicators.with_vwap(conditions.with_bars_since(conditions.with_running_true(long, "up", series=KEY), "up", series=KEY), series=KEY)
    plain = plain.withColumns({"n": F.count("close").over(w), "top": F.max("close").over(w), "least": F.min("close").over(w), "last": F.last("close", ignorenulls=True).over(w)})
    values = {"up__run_true": blocks.running_true("up"), "up__bars_since_true": blocks.bars_since("up"), "vwap": blocks.vwap()}
    values |= {"n": blocks.so_far("count", c), "top": blocks.so_far("max", c), "least": blocks.so_far("min", c), "last": blocks.so_far("last", c)}
    got = blocks.with_running(long, values, **opts)
    assert got.columns == [*long.columns, *values]
    same(got, plain, *values)


def test_recursive_average_comes_as_close_as_its_weights(long):
    run = lambda df, series: indicators.with_ewm(df, "open", 0.3, "e", series)
    same(blocks.in_blocks(long, run, 110, series=KEY, rows=200), run(long, KEY), "e")


def test_no_task_holds_a_series(long):
    dealt = blocks.deal(long, KEY, 100)
    sizes = [r["count"] for r in dealt.groupBy("_at").count().collect()]
    assert max(sizes) == 100 and sum(sizes) == 3127
    assert [r.p for r in dealt.where("symbol = 'a'").select(F.col("_pos").alias("p")).orderBy("i").collect()] == list(range(3000))


def test_defined_cases(spark, long):
    empty = long.limit(0)
    assert blocks.with_running(empty, {"vwap": blocks.vwap()}).count() == 0 == blocks.in_blocks(empty, lambda df, series: df, 3).count()
    # Rows that tie are told apart by their other columns, whatever the partitions; whole rows that repeat all stay.
    twice = long.withColumn("tz_start", F.lit("2024-01-01").cast("timestamp")).unionByName(long.withColumn("tz_start", F.lit("2024-01-01").cast("timestamp")))
    order = lambda n: [r.i for r in blocks.deal(twice.repartition(n), BARS, 10).where("symbol = 'a'").orderBy("_pos").collect()]
    assert order(2) == order(5) and len(order(3)) == 6000
    for wrong in ({"rows": 0}, {"slice_seconds": 0}):
        with pytest.raises(ValueError):
            blocks.deal(long, KEY, **wrong)
    with pytest.raises(ValueError):
        blocks.deal(long.withColumn("_pos", F.lit(1)))
    with pytest.raises(ValueError):
        blocks.so_far("median", F.col("open"))
