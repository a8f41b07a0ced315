"""Tables of one computation in the shared folder: what a loop over rounds reads again, written so that plans stay short."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}

#: Rows of one part of a dealt table, about.
DEALT_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="firnline-rounds-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


class Rounds:
    """``put`` writes a frame and reads it back; tables go when the driver ends, or with ``drop`` once nothing reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in names:
            path = hadoop.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            self.drop("")


def dealt(df: DataFrame, rows: int = DEALT_ROWS) -> DataFrame:
    """The same rows as a table in parts of about so many, for work that is long for the bytes of its rows.

    A small file of many rows is read by one task, which would do all of that work. The rows are written, because Spark
    moves filters, with what they work out, in front of a mere repartition. Give it columns as they were read.
    """
    parts = max(1, math.ceil(df.count() / rows))
    return Rounds(df.sparkSession, "dealt").put(df.repartition(parts), "rows")
