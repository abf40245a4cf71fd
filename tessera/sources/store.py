"""Small tables kept between runs: versions that are committed whole, and readers and writers that don't disturb each other.

A table is a folder of Parquet folders, one for each version, and of marks.  A version counts once its
mark is there: a file named by the version's number, which is made only if there is none of that name, and
holds the name of the version's data.  So a writer that is killed leaves the last version as it is, a
reader sees one version whole, and of two writers that start from the same version the second one
finds the number taken and repeats its change on what the first one has written.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

GRACE = 10.0  #: seconds after which a mark without content is that of a writer that died


class Store:
    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):  # noqa: ANN202
        return self._path("/".join((self.folder, *parts)))

    def _marks(self) -> dict[int, str]:
        """The data folder of every version; an empty name for a mark that is not written yet, or never will be."""
        marks = self._at("versions")
        if not self._fs.exists(marks):
            return {}
        out = {}
        for status in self._fs.listStatus(marks):
            name = status.getPath().getName()
            if name.isdigit():
                out[int(name)] = self._read(status.getPath()) if status.getLen() else ""
        return out

    def _read(self, path) -> str:  # noqa: ANN001
        stream = self._fs.open(path)
        try:
            return bytes(stream.readNBytes(1 << 10)).decode()
        finally:
            stream.close()

    def _state(self) -> tuple[int, str]:
        """The highest number taken, and the data of the last version; waits for a mark that is being written."""
        began = time.monotonic()
        while True:
            marks = self._marks()
            if not marks or marks[max(marks)] or time.monotonic() - began > GRACE:
                break
            time.sleep(0.2)
        done = [n for n, data in marks.items() if data.endswith(";")]
        return max(marks, default=0), marks[max(done)][:-1] if done else ""

    def read(self) -> DataFrame:
        """The last version; no rows if there is none."""
        return self._table(self._state()[1])

    def _table(self, data: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{data}") if data else self.spark.createDataFrame([], self.schema)

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Write what `change` makes of the last version as the next one; its number."""
        for _ in range(tries):
            number, before = self._state()
            data = f"data-{uuid.uuid4().hex}"
            change(self._table(before)).write.parquet(f"{self.folder}/{data}")
            if self._commit(number + 1, data):
                return number + 1
            self._fs.delete(self._at(data), True)
        raise RuntimeError(f"{self.folder}: other writers were first {tries} times")

    def _commit(self, number: int, data: str) -> bool:
        try:
            out = self._fs.create(self._at("versions", f"{number:012d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.toString()):
                return False
            raise
        out.write(bytearray(f"{data};".encode()))  # the end says that it is whole
        out.close()
        return True

    def tidy(self, keep: int = 2) -> None:
        """Delete the data and marks of all but the last `keep` versions, and data of writers that died a day ago or before."""
        marks = self._marks()
        kept = {marks[n][:-1] for n in sorted(n for n, data in marks.items() if data.endswith(";"))[-keep:]}
        for number in sorted(marks)[:-keep]:
            if marks[number][:-1] not in kept:
                self._fs.delete(self._at("versions", f"{number:012d}"), False)
        old = (time.time() - 86_400) * 1000
        dropped = {data[:-1] for data in marks.values()} - kept
        for status in self._fs.listStatus(self._at("")) if self._fs.exists(self._at("")) else ():
            name = status.getPath().getName()
            if name.startswith("data-") and name not in kept and (name in dropped or status.getModificationTime() < old):
                self._fs.delete(status.getPath(), True)
