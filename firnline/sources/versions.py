"""Tables that change together: a version names the files of every table, and taking a version is one step.

Files of a new state are written first, under names of their own. Then a manifest with the next number is moved into
place, which fails if another writer has that number already. Readers take the highest manifest. A writer that dies in
between leaves files that nothing names; a writer that was too slow has changed nothing and may plan again.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has taken the next version."""


class Version(NamedTuple):
    number: int
    tables: dict[str, str]
    note: dict


class Versions:
    """Versioned tables under a folder that the driver and all executors share.

    The move refuses an existing name: on HDFS as one step of the name node. On a plain local disk it is a check and then
    a move, which is enough for one driver.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, number: int):
        return self._path(f"{self.root}/_versions/{number:012d}.json")

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, by default the last; number 0 is the empty state before any."""
        numbers = self.numbers()
        number = (numbers[-1] if numbers else 0) if number is None else number
        if not number:
            return Version(0, {}, {})
        found = json.loads(self._text(self._at(number)))
        return Version(number, found["tables"], found["note"])

    def read(self, name: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version(number).tables[name]}")

    def stage(self, name: str, df: DataFrame) -> str:
        """Writes the next state of a table where nothing names it yet; returns what ``commit`` wants to know of it."""
        place = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{place}")
        return place

    def staged(self, place: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{place}")

    def commit(self, base: Version, tables: dict[str, str], note: dict) -> Version:
        """Makes the tables (those not given stay as in ``base``) the version after ``base``, or raises ``Conflict``."""
        number, whole = base.number + 1, base.tables | tables
        draft = self._path(f"{self.root}/_versions/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"tables": whole, "note": note}, sort_keys=True).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(number)), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} is taken") from e
            raise
        return Version(number, whole, note)
