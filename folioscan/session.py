"""Session construction and the shared folder for lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker while an intermediate table is written; Spark's own default is 64 MB.
BATCH_BYTES = 4 << 20


def build_session(app: str = "folioscan", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one where that is unset and the session is local (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioscan-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or tree through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within this, plans send batches of BATCH_BYTES at most to Python, so that wide rows don't fill a worker; then as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Intermediate tables of one run, each written once to the shared folder: cuts lineage and survives lost executors.

    A table is deleted with `drop` when its last reader has been written; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, fresh_path(spark, name)
        self.held: list[tuple[DataFrame, str]] = []
        self.written = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{self.written}-{name}"
        self.written += 1
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            remove_path(self.spark, path)
        self.held = [x for x in self.held if not any(x[0] is t for t in tables)]

    def free_shuffles(self) -> None:
        """Let Spark delete the shuffle files of the tables written so far: its cleaner does so once plans that nothing refers to are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop_all(self) -> None:
        remove_path(self.spark, self.base)
        self.held = []
