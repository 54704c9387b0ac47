"""What the corpus operators share: tables of the input folder and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints"
#: Bytes that a task holds of a table that it writes, and of one that it reads, so that many tasks share a small heap.
ROW_GROUP = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "tidemark_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    sc.addPyFile(target)
    sc._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where a session on one machine names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_SHARED
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Intermediate tables, written once to the shared folder and read again: this cuts the lineage, survives lost executors and gives the planner true sizes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        where = self.path()
        df.write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch = where
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        jvm = self.spark._jvm
        for df in dfs:
            where = jvm.org.apache.hadoop.fs.Path(getattr(df, "_scratch", df))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
