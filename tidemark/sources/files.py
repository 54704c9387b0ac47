"""Reading and writing by file kind, windows of the newest files, sidecars and names."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession

READERS = {"csv": lambda r, p, **k: r.csv(p, header=True, **k), "test_csv": lambda r, p, **k: r.csv(p, header=True, **k), "parquet": lambda r, p, **k: r.parquet(*([p] if isinstance(p, str) else p), **k), "json": lambda r, p, **k: r.json(p, **k), "jsonl": lambda r, p, **k: r.json(p, **k), "orc": lambda r, p, **k: r.orc(p, **k)}


def kind_of(path: str) -> str:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"unknown kind of file: {path}")
    return kind


def read(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """A file or folder of files, by suffix; give a schema to spare a pass for inference."""
    reader = spark.read.schema(schema) if schema else spark.read
    return READERS[kind_of(path)](reader, path, **options)


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    kind = kind_of(path)
    out = df.write.mode(mode)
    out.csv(path, header=True) if kind in ("csv", "test_csv") else out.json(path) if kind in ("json", "jsonl") else out.orc(path) if kind == "orc" else out.parquet(path)


def checkpoint(df: DataFrame, folder: str, prefix: str, kind: str = "parquet") -> str:
    path = f"{folder}/{prefix}_{int(time.time() * 1000)}.{kind}"
    write(df, path)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    """True if there was something to delete."""
    p, fs = _fs(spark, path)
    return fs.delete(p, True)


def _aside(spark: SparkSession, to: str):
    head, _, name = to.rstrip("/").rpartition("/")
    return _fs(spark, f"{head}/.{name}.old" if head else f".{name}.old")[0]


def recover(spark: SparkSession, to: str) -> bool:
    """Puts back what a broken rename has set aside; True if there was something to put back."""
    q, fs = _fs(spark, to)
    old = _aside(spark, to)
    if not fs.exists(old):
        return False
    if fs.exists(q):
        fs.delete(old, True)
        return False
    return fs.rename(old, q)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Puts a finished file or folder in place of another, which is set aside under a hidden name until the new one is there.

    Whenever it breaks off, one of both is whole under its own or the hidden name; recover puts it back.
    """
    p, fs = _fs(spark, path)
    q, _ = _fs(spark, to)
    recover(spark, to)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    old = _aside(spark, to)
    if fs.exists(q) and not fs.rename(q, old):
        raise OSError(f"cannot set {to} aside")
    if not fs.rename(p, q):
        recover(spark, to)
        raise OSError(f"cannot rename {path}")
    fs.delete(old, True)


def fingerprint(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(files, latest time of change in ms) of a folder: equal means that nothing new has come."""
    p, fs = _fs(spark, folder)
    found = [s for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))] if fs.exists(p) else []
    return len(found), max((s.getModificationTime() for s in found), default=0)


def has_files(spark: SparkSession, folder: str) -> bool:
    return fingerprint(spark, folder)[0] > 0


def homogeneous_kind(spark: SparkSession, folder: str) -> str | None:
    kinds = {n.rsplit(".", 1)[-1] for n in names(spark, folder) if not n.startswith(("_", "."))}
    return kinds.pop() if len(kinds) == 1 else None


def latest(spark: SparkSession, folder: str, window: int, head: str = "head.parquet") -> DataFrame:
    """The newest window - 1 chunks by name, and the head."""
    found = [n for n in names(spark, folder) if n.endswith(".parquet")]
    chunks = [n for n in found if n != head]
    chosen = (chunks[-(window - 1) :] if window > 1 else []) + [head] * (head in found)
    if not chosen:
        raise FileNotFoundError(folder)
    return spark.read.parquet(*[f"{folder}/{n}" for n in chosen])


def union_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder; of several kinds, each by its own reader."""
    kinds: dict[str, list[str]] = {}
    for n in names(spark, folder):
        if not n.startswith(("_", ".")):
            kinds.setdefault(kind_of(n), []).append(f"{folder}/{n}")
    out = None
    for kind, paths in kinds.items():
        df = READERS[kind](spark.read, paths)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(folder)
    return out


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """A sidecar of one JSON line beside a dataset."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], ["value"]).coalesce(1).write.mode("overwrite").text(f"{path}.meta.json")


def read_meta(spark: SparkSession, path: str) -> dict | None:
    if not names(spark, f"{path}.meta.json"):
        return None
    return json.loads(spark.read.text(f"{path}.meta.json").first()[0])


NAME = re.compile(r"(?P<id>.+)_(?P<size>\d+[smhD])(?:\.\w+)?")


def bar_file(instrument: str, size: str, kind: str = "parquet") -> str:
    return f"{instrument}_{size}.{kind}"


def split_name(name: str) -> tuple[str, str] | None:
    m = NAME.fullmatch(name)
    return (m["id"], m["size"]) if m else None


def identity(spark: SparkSession, path: str, df: DataFrame) -> dict:
    """Instrument and bar size: from the sidecar, else the file name, else a column."""
    if meta := read_meta(spark, path):
        return meta
    if found := split_name(path.rstrip("/").rsplit("/", 1)[-1]):
        return {"instrument": found[0], "resolution": found[1]}
    if "symbol" in df.columns:
        own = [r[0] for r in df.select("symbol").distinct().limit(2).collect()]
        return {"instrument": own[0] if len(own) == 1 else None, "resolution": None}
    return {"instrument": None, "resolution": None}


def bars_path(root: str, source: str, endpoint: str, stage: str, symbol: str, interval: str, limit: int) -> str:
    return f"{root}/{source}/{endpoint}/{stage}/{symbol}/{interval}/limit={limit}"


def from_records(spark: SparkSession, records, columns, order=None) -> DataFrame:
    rows = [tuple(r.get(c) if isinstance(r, dict) else getattr(r, c, None) for c in columns) for r in records]
    df = spark.createDataFrame(rows, list(columns))
    return df.orderBy(*order) if order else df


def load_bars(spark: SparkSession, path: str, seconds: int, series=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, report, issues) of the bars of a file or folder."""
    from ..operators.gaps import quality
    from ..operators.series import BARS

    return quality(read(spark, path), seconds, series or BARS)
