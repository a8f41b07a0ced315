"""Shared scratch space for intermediate tables and binary output."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_open: list[Scratch] = []


@atexit.register
def _close_all() -> None:
    for scratch in _open[:]:
        with contextlib.suppress(Exception):  # the session may have ended
            scratch.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        folder = tempfile.mkdtemp(prefix="firnline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _fallback[key] = f"file://{folder}"
    return _fallback[key]


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive a lost executor.

    ``put`` writes a frame and reads it back; ``drop`` removes tables that nothing reads any more.
    A table that the caller's result still reads lazily stays until ``close``, or else until the driver's end.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.drop("")
        _open.remove(self)
