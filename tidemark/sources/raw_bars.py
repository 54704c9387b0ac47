"""Raw responses of bar services: JSON slices with positional rows, and a record form with fill and oracle prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# Positional fields.
KLINE = (("open_time", "long"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "double"), ("close_time", "long"), ("quote_asset_volume", "double"), ("num_trades", "long"), ("taker_buy_base_asset_volume", "double"), ("taker_buy_quote_asset_volume", "double"), ("ignore", "string"))
BAR8 = (("open_time", "long"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "double"), ("average", "double"), ("bar_count", "long"))

SLICE = "meta map<string,string>, data array<array<string>>"


def read_slices(spark: SparkSession, path: str, fields=KLINE) -> DataFrame:
    """One row for each bar of {"meta": ..., "data": [[...], ...]} files, with the file's meta and name."""
    raw = spark.read.schema(SLICE).json(path, multiLine=True)
    return explode_slices(raw.withColumn("file", F.input_file_name()), fields)


def explode_slices(raw: DataFrame, fields=KLINE) -> DataFrame:
    rows = raw.withColumn("bar", F.explode("data"))
    typed = [F.get("bar", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]
    return rows.select(*[c for c in raw.columns if c != "data"], *typed)


def normalise(df: DataFrame, seconds: int, fills: bool = True, oracle: bool = False) -> DataFrame:
    """Bars with tz_start and tz_end from epoch seconds or milliseconds, with fill or oracle prices (or both, prefixed)."""
    start = F.when(F.col("ts") < 10**11, F.timestamp_seconds("ts")).otherwise(F.timestamp_millis("ts"))
    df = df.withColumns({"tz_start": start, "tz_end": start + F.make_dt_interval(secs=F.lit(seconds))})
    names = [c for c in ("symbol", "tz_start", "tz_end") if c in df.columns]
    many = fills and oracle
    price = lambda kind: [F.col(f"{kind}{p.title()}").alias(f"{kind}_{p}" if many else p) for p in ("open", "high", "low", "close")]
    return df.select(*names, *(price("fill") if fills else []), *(price("oracle") if oracle else []), F.col("baseVolume").alias("volume"), F.col("quoteVolume").alias("quote_volume"))


def append_bars(old: DataFrame, new: DataFrame, keys=("symbol",), ts: str = "tz_start") -> DataFrame:
    """Of bars of one time the newest stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    at = [*keys, ts]
    rest = [c for c in old.columns if c not in at]
    best = both.groupBy(*at).agg(F.max_by(F.struct(*rest), "_new").alias("_b"))
    return best.select(*at, *[F.col(f"_b.{c}") for c in rest]).select(*old.columns)


def slice_plan(spark: SparkSession, symbol: str, interval: str, start: int, end: int, span: int, limit: int) -> DataFrame:
    """Requests that cover [start, end] without overlap, in ms; the last is cut at the end."""
    n = max(0, -(-(end - start) // (span * limit)))
    rows = spark.range(n).select((F.lit(start) + F.col("id") * span * limit).alias("start_ms"))
    rows = rows.withColumn("end_ms", F.least(F.col("start_ms") + span * limit - 1, F.lit(end)))
    key = F.concat_ws(":", F.lit(symbol), F.lit(interval), "start_ms", F.lit(limit))
    return rows.select(key.alias("slice_key"), "start_ms", "end_ms", F.concat(F.lit(f"?symbol={symbol}&interval={interval}&limit={limit}&startTime="), "start_ms", F.lit("&endTime="), "end_ms").alias("query"))


def diff_symbols(ours: DataFrame, venue: DataFrame, key: str = "venue_id") -> tuple[DataFrame, DataFrame]:
    """(supported, unsupported) venue ids."""
    return venue.join(ours, key, "left_semi"), venue.join(ours, key, "left_anti")


@dataclass(frozen=True)
class SymbolMap:
    """Our names of instruments and those of a venue, each way; neither side may repeat."""

    pairs: tuple[tuple[str, str], ...]

    def __post_init__(self):
        if len({a for a, _ in self.pairs}) < len(self.pairs) or len({b for _, b in self.pairs}) < len(self.pairs):
            raise ValueError("a symbol is mapped twice")

    def to_venue(self, name: str) -> str:
        return dict(self.pairs)[name]

    def to_ours(self, name: str) -> str:
        return {b: a for a, b in self.pairs}[name]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.pairs), "symbol string, venue_id string")

    def rename(self, df: DataFrame, column: str = "symbol", back: bool = False) -> DataFrame:
        """df with the other side's names; null where there is none."""
        pairs = [(b, a) if back else (a, b) for a, b in self.pairs]
        if not pairs:
            return df.withColumn(column, F.lit(None).cast("string"))
        return df.withColumn(column, F.coalesce(*[F.when(F.col(column) == a, b) for a, b in pairs]))


def first_with_data(has_data, start: int, end: int, step: int) -> int | None:
    """The first of start, start + step, ... up to end for which has_data holds, where it holds for all later ones; asks a logarithm of times."""
    low, high = 0, (end - start) // step
    if high < 0 or not has_data(start + high * step):
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if has_data(start + mid * step) else (mid + 1, high)
    return start + low * step


def coerce(df: DataFrame, required=("open", "high", "low", "close", "volume")) -> DataFrame:
    """Prices as doubles; raises on missing columns and leaves out rows that lack a value."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumns({c: F.col(c).try_cast("double") for c in required}).dropna(subset=list(required))
