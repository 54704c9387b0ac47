"""Calendar, sources, ledger, streaming, and the queries against DuckDB."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import times
from tidemark.functions.registry import Registry
from tidemark.operators import calendar, conditions, gaps, legs, pointwise, reduce, resample
from tidemark.plans import registry
from tidemark.sources import files, ledger, raw_bars
from tidemark.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"set timezone = 'UTC'; create view events as select * from '{SF}/events.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    order = sorted(got.columns)
    plain = lambda df: sorted(tuple("" if pd.isna(v) else f"{float(v):.6g}" if not isinstance(v, str | pd.Timestamp) and not hasattr(v, "year") else str(v)[:19] for v in r) for r in df[order].itertuples(index=False))
    assert len(got) == len(want)
    same = sum(a == b for a, b in zip(plain(got), plain(want), strict=True))
    assert same == len(got), f"{len(got) - same} of {len(got)} rows differ"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sessions_follow_daylight_saving(spark):
    df = spark.sql("select timestamp '2024-03-08 14:30:00' as t union all select timestamp '2024-03-11 13:30:00' union all select timestamp '2024-03-11 20:00:00'")
    assert [r[0] for r in df.select(calendar.session("t", "ny_cash"), "t").orderBy("t").collect()] == [True, True, False]
    late = spark.sql("select timestamp '2024-01-01 23:30:00' as t").select(calendar.in_session("t", "22:00", "02:00", "UTC")).first()[0]
    assert late


def test_times(spark):
    assert str(times.TimeFreq.parse("5min")) == "5m" and times.interval_ms("1h") == 3_600_000
    with pytest.raises(ValueError):
        times.TimeFreq.parse("5 parsecs")
    df = spark.createDataFrame([(1_700_000_000, "2024-01-01 00:00:00"), (1_700_000_000_000, "bad")], "e long, s string")
    assert [r[0].year for r in df.select(times.to_utc(F.col("e"), "bigint")).collect()] == [2023, 2023]
    assert [r[0] is None for r in df.select(times.to_utc(F.col("s"), "string")).collect()] == [False, True]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for kind in ("parquet", "json", "csv", "orc"):
        files.write(df, f"{tmp_path}/t.{kind}")
        assert files.read(spark, f"{tmp_path}/t.{kind}").count() == 1
    for n in ("001", "002", "003", "head"):
        files.write(df.withColumn("n", F.lit(n)), f"{tmp_path}/w/{n}.parquet")
    got = {r.n for r in files.latest(spark, f"{tmp_path}/w", 3).collect()}
    assert got == {"002", "003", "head"} and files.homogeneous_kind(spark, f"{tmp_path}/w") == "parquet"
    assert files.union_folder(spark, f"{tmp_path}/w").count() == 4
    files.write_meta(spark, f"{tmp_path}/t.parquet", {"instrument": "x"})
    assert files.identity(spark, f"{tmp_path}/t.parquet", df) == {"instrument": "x"}
    assert files.split_name(files.bar_file("sol-perp", "1m")) == ("sol-perp", "1m")
    with pytest.raises(ValueError):
        files.read(spark, f"{tmp_path}/t.xyz")


def slice_file(path, start, n=3):
    rows = [[start + k * 60_000, "1", "2", "0.5", "1.5", "10", start + (k + 1) * 60_000 - 1, "15", 3, "5", "7", "0"] for k in range(n)]
    path.write_text(json.dumps({"meta": {"symbol": "s"}, "data": rows}))


def test_raw_bars_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    slice_file(tmp_path / "in/a.json", 600_000)
    slice_file(tmp_path / "in/b.json", 720_000)
    rows = raw_bars.read_slices(spark, f"{tmp_path}/in")
    assert rows.count() == 6 and dict(rows.dtypes)["open"] == "double"
    bars = incremental.slice_stream(spark, f"{tmp_path}/in").select(F.lit("s").alias("symbol"), F.timestamp_millis("open_time").alias("tz_start"), "close")
    incremental.sealed(incremental.deduplicated(bars), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_normalise_and_append(spark):
    raw = spark.createDataFrame([(1_700_000_000, *[1.0] * 4, *[2.0] * 4, 5.0, 6.0)], "ts long, fillOpen double, fillHigh double, fillLow double, fillClose double, oracleOpen double, oracleHigh double, oracleLow double, oracleClose double, quoteVolume double, baseVolume double")
    out = raw_bars.normalise(raw, 60).first()
    assert (out.open, out.volume, (out.tz_end - out.tz_start).seconds) == (1.0, 6.0, 60)
    assert "oracle_open" in raw_bars.normalise(raw, 60, True, True).columns
    old = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0)], "symbol string, tz_start int, close double")
    new = spark.createDataFrame([("s", 2, 9.0), ("s", 3, 3.0)], "symbol string, tz_start int, close double")
    assert sorted(r.close for r in raw_bars.append_bars(old, new).collect()) == [1.0, 3.0, 9.0]


def test_ledger(spark):
    plan = raw_bars.slice_plan(spark, "s", "1m", 0, 500_000, 60_000, 3)
    assert [(r.start_ms, r.end_ms) for r in plan.orderBy("start_ms").collect()] == [(0, 179_999), (180_000, 359_999), (360_000, 500_000)]
    have = spark.createDataFrame([("s:1m:0:3", "complete"), ("s:1m:180000:3", "odd")], "slice_key string, status string")
    got = {r.slice_key: r.status for r in ledger.classify(plan, have, "s:1m:360000:3").collect()}
    assert got == {"s:1m:0:3": "complete", "s:1m:180000:3": "needs_refresh", "s:1m:360000:3": "partial"}
    deltas = spark.createDataFrame([("s:1m:0:3", "failed", 1), ("s:1m:0:3", "complete", 2), ("n", "partial", 1)], "slice_key string, status string, seq long")
    assert {r.slice_key: r.status for r in ledger.apply_deltas(have, deltas).collect()}["s:1m:0:3"] == "complete"
    bad = spark.createDataFrame([("s:1m:0:3",), ("s:1m:5:4",), ("junk",)], "slice_key string")
    rules = {(r.rule, r.slice_key) for r in ledger.violations(bad, 60_000, 3).collect()}
    assert {("limit", "s:1m:5:4"), ("spacing", "s:1m:5:4"), ("key", "junk")} <= rules
    assert ledger.current_slice(0, 500, 100) == 500 and len(ledger.slice_hash("x")) == 32
    assert [ledger.backoff(x) for x in (0, 30, 600)] == [30, 60, 900]


def test_incremental_equals_full(spark):
    rows = [("s", i, float(i * i % 7)) for i in range(25)]
    df = spark.createDataFrame(rows, "symbol string, tz_start int, close double")
    local = incremental.Pipeline(lambda d: pointwise.with_diff(d, ["close"], 2), overlap=2)
    incremental.parity(local, df, [8, 16, 24])
    short = incremental.Pipeline(lambda d: pointwise.with_diff(d, ["close"], 2), overlap=1)
    with pytest.raises(AssertionError):
        incremental.parity(short, df, [8, 16, 24])
    ids = lambda d: conditions.with_group_id(d.withColumn("c", F.col("close") > 2), "c", "g")
    incremental.parity(incremental.Pipeline(ids, 1, incremental_safe=False), df, [8, 24])


def test_alerts_and_registries():
    assert incremental.holds(["a", "b"], ["a"], "ANY") and not incremental.holds(["a", "b"], ["a"])
    assert incremental.holds(["a", "b", "c"], ["a", "b"], "N_OF_M", 2)
    with pytest.raises(ValueError):
        incremental.holds(["a"], ["a"], "SOME")
    state = incremental.AlertState()
    assert [state.step(f, t) for f, t in ((True, 0), (True, 10), (True, 31), (True, 60), (False, 61), (True, 62))] == [True, False, True, False, False, True]
    known = Registry("frame")
    known.register("path_length")(lambda d: d)
    with pytest.raises(KeyError, match="did you mean path_length"):
        known.get("path_lenght")
    with pytest.raises(KeyError):
        incremental.validate_triggers({"t": {"outbox": "x"}}, ["t"], ["y"])


def test_null_keys_stay(spark):
    rows = [("s", 0, 1.0), (None, 0, 2.0), (None, 3600, 3.0), ("s", 3600, 4.0), ("s", 3600, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, t int, x double").select("symbol", F.timestamp_seconds("t").alias("tz_start"), *[F.col("x").alias(c) for c in ("open", "high", "low", "close", "volume")])
    assert {(r.symbol, r.open) for r in resample.resample(df, 7200).collect()} == {("s", 1.0), (None, 2.0)}
    kept, conflicts = gaps.dedupe(df)
    assert kept.count() == 4 and conflicts.count() == 0
    assert {(r.symbol, r.src_row_count) for r in reduce.per_time_chunk(df, 3600, [], with_empty=True).collect()} == {("s", 1), ("s", 2), (None, 1)}


def test_zoom_keeps_the_maximum(spark):
    df = spark.createDataFrame([(float(k),) for k in range(5)] + [(100.0,)] * 95, "x double")
    first, second = reduce.zoom(df, "x")[:2]
    assert first.agg(F.sum("count")).first()[0] == 100 and second.agg(F.sum("count")).first()[0] == 95


def test_combined_events_keep_the_first_list(spark):
    a, b = (spark.createDataFrame(r, "ts int, name string") for r in ([(1, "z"), (2, "y")], [(1, "a"), (3, "c"), (3, "b")]))
    assert sorted(map(tuple, calendar.combine_events(a, b).collect())) == [(1, "z"), (2, "y"), (3, "b")]


def test_rename_loses_nothing(spark, tmp_path):
    one, two = (spark.createDataFrame([(k,)], "a int") for k in (1, 2))
    files.write(one, f"{tmp_path}/t.parquet")
    files.write(two, f"{tmp_path}/new.parquet")
    with pytest.raises(FileNotFoundError):
        files.rename(spark, f"{tmp_path}/none.parquet", f"{tmp_path}/t.parquet")
    files.rename(spark, f"{tmp_path}/new.parquet", f"{tmp_path}/t.parquet")
    assert files.read(spark, f"{tmp_path}/t.parquet").first().a == 2 and files.names(spark, str(tmp_path)) == ["t.parquet"]
    (tmp_path / "t.parquet").rename(tmp_path / ".t.parquet.old")  # as a crash between both steps leaves it
    assert files.recover(spark, f"{tmp_path}/t.parquet") and files.read(spark, f"{tmp_path}/t.parquet").first().a == 2
    assert not files.recover(spark, f"{tmp_path}/t.parquet")
    files.delete(spark, f"{tmp_path}/t.parquet")
    assert not files.has_files(spark, str(tmp_path)) and files.fingerprint(spark, f"{tmp_path}/nowhere") == (0, 0)
    assert files.checkpoint(one, str(tmp_path), "c").startswith(f"{tmp_path}/c_")


def test_bars_that_are_not_complete_are_refused(spark):
    rows = lambda ts: spark.createDataFrame([("s", t, 1.0) for t in ts], "symbol string, t int, x double").select("symbol", F.timestamp_seconds("t").alias("tz_start"), *[F.col("x").alias(c) for c in ("open", "high", "low", "close", "volume")])
    made = resample.generate(rows(range(0, 600, 60)), (120, 300))
    assert {k: v.count() for k, v in made.items()} == {120: 5, 300: 2}
    for bad, sizes in ((range(0, 600, 30), (120,)), ([0, 60, 240], (120,)), (range(0, 600, 60), (90,))):
        with pytest.raises(ValueError):
            resample.generate(rows(bad), sizes)
    for wrong in ({"window": 0}, {"scale": -1.0}, {"least": -1.0}):
        with pytest.raises(ValueError):
            gaps.LinearFill(**wrong)


def test_load_bars(spark, tmp_path):
    rows = [("s", 0, 1.0, 2.0, 1.0, 2.0), ("s", 60, 1.0, 2.0, 1.0, 2.0), ("s", 60, 1.0, 2.0, 1.0, 2.0), ("s", 120, 0.0, 2.0, 0.0, 1.0), ("s", 300, 3.0, 2.0, 1.0, 2.0), ("s", 360, 1.0, 2.0, 1.0, 2.0), ("s", 360, 1.5, 2.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, t int, open double, high double, low double, close double").select("symbol", F.timestamp_seconds("t").alias("tz_start"), "open", "high", "low", "close")
    files.write(df, f"{tmp_path}/b.parquet")
    clean, report, issues = files.load_bars(spark, f"{tmp_path}/b.parquet", 60)
    assert clean.count() == 2 and report.first().n_gaps == 1
    found = [r.issue for r in issues.collect()]
    assert sorted(set(found)) == ["conflict", "duplicate", "gap_before", "inconsistent", "zero"] and found.count("duplicate") == 4 and found.count("conflict") == 2


def test_symbols_and_snapshots(spark, tmp_path):
    names = raw_bars.SymbolMap((("SOL-PERP", "0"), ("BTC-PERP", "1")))
    assert names.to_venue("BTC-PERP") == "1" and names.to_ours("0") == "SOL-PERP"
    df = names.rename(names.frame(spark).drop("venue_id"))
    assert sorted(r.symbol for r in df.collect()) == ["0", "1"] and sorted(r.symbol for r in names.rename(df, back=True).collect()) == ["BTC-PERP", "SOL-PERP"]
    with pytest.raises(ValueError):
        raw_bars.SymbolMap((("a", "0"), ("b", "0")))
    assert ledger.due(5, 0, 0) and ledger.due(1, 120, 0) and ledger.due(1, 0, 2**30) and not ledger.due(0, 999, 0) and not ledger.due(4, 60, 1)
    files.write(spark.createDataFrame([("a", "partial"), ("b", "complete")], "slice_key string, status string"), f"{tmp_path}/l.parquet")
    deltas = spark.createDataFrame([("a", "failed", 1), ("a", "complete", 2), ("c", "partial", 3)], "slice_key string, status string, seq long")
    assert {r.slice_key: r.status for r in ledger.compact(spark, f"{tmp_path}/l.parquet", deltas).collect()} == {"a": "complete", "b": "complete", "c": "partial"}


def test_provider_recomputes_only_what_is_new(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([("s", i, float(i * i % 7)) for i in range(a, b)], "symbol string, tz_start int, close double")
    pipeline = incremental.Pipeline(lambda d: pointwise.with_diff(d, ["close"], 2), overlap=2)
    own = incremental.CleanProvider(spark, f"{tmp_path}/in", f"{tmp_path}/sealed.parquet", pipeline)
    for k in range(3):
        files.write(rows(10 * k, 10 * k + 10), f"{tmp_path}/in/{k}.parquet")
        assert own.changed()
        got = {(r.tz_start, r.close__diff_2) for r in own.frame().collect()}
        assert got == {(r.tz_start, r.close__diff_2) for r in pipeline.run(rows(0, 10 * k + 10)).collect()} and not own.changed()


def test_frames_are_built_once(spark, tmp_path):
    built = []
    builders = {"f": lambda d: built.append(1) or d.withColumn("up", F.col("x") > 1)}
    incremental.run_frames(spark.createDataFrame([(1,), (2,)], "x int"), builders, {"a": {"frame": "f", "column": "up"}, "b": {"frame": "f", "column": "up"}}, f"{tmp_path}/out")
    assert len(built) == 1 and sorted(r.trigger for r in spark.read.json(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_columns_and_paths(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert pointwise.insert_column(df, "c", F.lit(3), 1).columns == ["a", "c", "b"] and pointwise.move_column(df, "b", 0).columns == ["b", "a"]
    assert pointwise.one(["x"]) == "x" and files.bars_path("r", "s", "e", "raw", "x", "1m", 9) == "r/s/e/raw/x/1m/limit=9"
    with pytest.raises(ValueError):
        pointwise.one(["x", "y"])
    assert files.from_records(spark, [{"a": 1}, {"a": None, "b": 2}], ["a", "b"]).count() == 2
    paths = legs.mfe_survival(spark.createDataFrame([(3, 1), (1, 0)], "len int, idx int"), "len", "idx")
    assert [(r.t, r.survivors) for r in paths.orderBy("t").collect()] == [(1, 2), (2, 1), (3, 1)]


def test_states_and_facts_of_slices(spark):
    assert ledger.status_of("historical_sparsity") == "complete" and ledger.status_of("http_error", False) == "failed"
    for reason, ok in (("http_error", True), ("none", False), ("odd", True)):
        with pytest.raises(ValueError):
            ledger.status_of(reason, ok)
    expected = spark.createDataFrame([("a", 0, 120), ("b", 180, 300), ("c", 360, 480)], "slice_key string, start_ms long, last_ms long")
    bars = spark.createDataFrame([("a", 0), ("a", 60), ("a", 60), ("c", 360)], "slice_key string, open_time long")
    got = {r.slice_key: (r.n, r.status, r.reason) for r in ledger.by_elapsed_time(expected, bars, 60, 400).collect()}
    assert got == {"a": (2, "complete", "none"), "b": (0, "complete", "historical_sparsity"), "c": (1, "partial", "still_forming")}
    rows = [("s:1m:60:3", "?symbol=s&interval=1m&limit=3&startTime=60", 60), ("s:1m:60:3", "?symbol=s&interval=1m&limit=3&startTime=0", 60), ("s:1m:60:3", "?symbol=s&interval=1m&limit=3&startTime=60", 61), ("junk", "", 0)]
    found = ledger.facts(spark.createDataFrame(rows, "slice_key string, query string, start_ms long"))
    assert [r.agree for r in found.collect()] == [True, False, False, False]


def test_probes_and_coercion(spark):
    asked = []
    assert raw_bars.first_with_data(lambda t: asked.append(t) or t >= 700, 0, 1000, 100) == 700 and len(asked) <= 5
    assert raw_bars.first_with_data(lambda t: False, 0, 1000, 100) is None and raw_bars.first_with_data(lambda t: True, 5, 0, 1) is None
    df = spark.createDataFrame([("1", "2", "3", "4", "5"), ("x", "2", "3", "4", "5")], "open string, high string, low string, close string, volume string")
    assert [r.open for r in raw_bars.coerce(df).collect()] == [1.0]
    with pytest.raises(ValueError):
        raw_bars.coerce(df.drop("low"))


def test_time_texts():
    t = times.parse_iso("2024-01-02T03:04:05Z")
    assert times.iso(t) == "2024-01-02T03:04:05Z" == times.iso(t.replace(tzinfo=None)) and times.parse_iso("2024-01-02T04:04:05+01:00") == t
    assert times.now_utc().tzinfo and [times.span_text(x) for x in (0, 59, -3661, 90061)] == ["0s", "59s", "-1h 1m 1s", "1d 1h 1m 1s"]


def test_columns_are_declared_and_guarded(spark):
    from tidemark.functions.registry import LINEAGE, new_columns, rows_text

    df = spark.createDataFrame([(1, 2.0, None), (2, 3.5, "x" * 50)], "a int, b double, c string")

    @new_columns("d")
    def twice(x, n=2):
        return x.withColumn("d", F.col("b") * n)

    assert twice(df, n=3).first().d == 6.0 and twice.columns == ("d",) and any(k.endswith("twice") for k in LINEAGE)
    for bad in (lambda x: x.drop("a").withColumn("d", F.lit(1)), lambda x: x):
        with pytest.raises(ValueError):
            new_columns("d")(bad)(df)
    assert rows_text(df, 1, ("a", "b")) == "a  b\n1  2" and len(rows_text(df, 5).split("\n")) == 3
    assert dict(pointwise.as_int8(df, ["a"]).dtypes)["a"] == "tinyint" and pointwise.rename_by_index(df, {1: "z"}).columns == ["a", "z", "c"]
    assert pointwise.guarded(df, lambda x: x.withColumn("e", F.lit(1)), ["b", "c"], ["a"]).count() == 2
    for wrong in (lambda x: x.withColumn("b", F.col("b") + 1), lambda x: x.where("a = 1"), lambda x: x.unionByName(x.withColumn("a", F.lit(9)))):
        with pytest.raises(Exception, match="changed"):
            pointwise.guarded(df, wrong, ["b"], ["a"]).collect()
    assert pointwise.keep_policy(df, "a", ["b"]).columns == ["a", "c"] and pointwise.drop_columns(df, ["c"]).columns == ["a", "b"]
    assert [r.b for r in pointwise.null_if(df, F.col("a") == 1, ["b"]).collect()] == [None, 3.5]


def test_parts_hold_whole_slices(spark, tmp_path):
    folder = f"{tmp_path}/agg"
    rows = lambda a, b: spark.createDataFrame([(f"s{k}", 10 * k + i) for k in range(a, b) for i in range(3)], "slice_key string, open_time long")
    first = incremental.append_slices(spark, folder, rows(0, 5), per_part=2)
    assert [(p["first"], p["last"]) for p in first["parts"]] == [("s0", "s1"), ("s2", "s3")] and first["head_slices"] == 1
    second = incremental.append_slices(spark, folder, rows(5, 8), per_part=2)
    assert [p["name"] for p in second["parts"]] == [f"part-00000{k}.parquet" for k in range(4)] and second["head_slices"] == 0
    assert sorted(r.open_time for r in files.union_folder(spark, folder).collect()) == sorted(10 * k + i for k in range(8) for i in range(3))
    assert incremental.refresh_head(spark, folder, rows(8, 9)) == 3 and incremental.refresh_head(spark, folder, rows(8, 10)) == 6
    with pytest.raises(ValueError):
        incremental.refresh_head(spark, folder, rows(8, 9))
    assert files.latest(spark, folder, 2).count() == 12
    state = incremental.set_state(incremental.set_state({}, "a.b", 1), "a.c.d", 2)
    assert state == {"a": {"b": 1, "c": {"d": 2}}}
    incremental.save_state(spark, f"{tmp_path}/state", state)
    assert incremental.load_state(spark, f"{tmp_path}/state") == state and incremental.load_state(spark, f"{tmp_path}/nowhere") == {}


def test_load_clean_waits_for_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        incremental.load_clean(spark, f"{tmp_path}/none", 60)
    df = spark.createDataFrame([("s", 0), ("s", 60)], "symbol string, t int").select("symbol", F.timestamp_seconds("t").alias("tz_start"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")])
    files.write(df, f"{tmp_path}/in/1.parquet")
    assert [incremental.load_clean(spark, f"{tmp_path}/in", 60, last=n)[0].count() for n in (0, 2)] == [2, 2]
