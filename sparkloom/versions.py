"""Published versions of tables: immutable folders, and a chain of small files of which the newest complete one counts.

Publishing is a compare-and-set: version n + 1 is created only by who has seen
n, and creating a file that exists fails. Folders are written before, so a run
that fails or comes second leaves what is published as it was.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another version was published in between."""


class Versions:
    """The versions under a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.root}/versions"))

    def numbers(self) -> list[int]:
        """The numbers of all versions, complete or not."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.root}/versions"))]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def latest(self) -> tuple[int, dict]:
        """Number and content of the newest complete version; 0 and nothing where there is none."""
        for n in reversed(self.numbers()):
            text = "".join(r[0] for r in self.spark.read.text(self._file(n), wholetext=True).collect())
            if text.endswith("\n"):  # else its writer has not come to the end
                return n, json.loads(text)
        return 0, {}

    def repair(self) -> None:
        """Delete versions after the newest complete one: their writers stopped half-way. Only for when no writer runs."""
        n, _ = self.latest()
        for m in self.numbers():
            if m > n:
                self._files.delete(self._path(self._file(m)), False)

    def _file(self, n: int) -> str:
        return f"{self.root}/versions/{n:012d}.json"

    def publish(self, seen: int, content: dict) -> int:
        """Make the content version ``seen`` + 1; raises Conflict if that exists. Atomic where creating a new file is."""
        path = self._path(self._file(seen + 1))
        if seen != (self.numbers() or [0])[-1]:
            raise Conflict(f"version {seen} is not the newest")
        try:
            out = self._files.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {seen + 1} exists") from e
            raise
        out.write(bytearray((json.dumps(content, sort_keys=True) + "\n").encode()))
        out.close()
        return seen + 1

    def write(self, df: DataFrame, table: str, by: str | None = None) -> str:
        """Write the rows to a new folder, which no version names yet; its name is returned."""
        name = f"data/{table}-{uuid.uuid4().hex[:12]}"
        writer = df.write.option("compression", "zstd")
        try:
            (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}")
        except BaseException:
            self.drop(name)
            raise
        return name

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete folders that no reader asks for any more."""
        for name in names:
            self._files.delete(self._path(f"{self.root}/{name}"), True)
