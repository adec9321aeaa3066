"""Small files beside tables, through Spark's own file systems, so that any store Spark reaches will do."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

EXISTS = ("FileAlreadyExistsException", "already exists")


class Folder:
    """A folder that holds numbered JSON files, each written once and by one writer only."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the files there are, whole or not, in order."""
        if not self.files.exists(self.root):
            return []
        names = [status.getPath().getName() for status in self.files.listStatus(self.root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _file(self, number: int):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, f"{number:08d}.json")

    def read(self, number: int) -> dict | None:
        """What a file holds; None if its writer didn't get to its end."""
        source = self.files.open(self._file(number))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def create(self, number: int, content: dict) -> bool:
        """Write a file that must not exist yet; False if another writer has made it."""
        try:
            out = self.files.create(self._file(number), False)
        except Py4JJavaError as failure:
            if any(word in str(failure.java_exception) for word in EXISTS):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        return True
