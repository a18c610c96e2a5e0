"""Small files and folders in the store Spark writes to, by Hadoop's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class SharedFiles:
    """Paths below ``root``, in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._hadoop.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        """Names inside a folder, none if it is not there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder))) if self.exists(folder) else []

    def size(self, name: str) -> int:
        """Bytes of a file or of all files below a folder."""
        return self._fs.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> dict:
        if not self.exists(name):
            raise FileNotFoundError(self.path(name))
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def replace_json(self, name: str, content: dict) -> None:
        """Put a file in place of an earlier one: readers see that one or this one, never a part."""
        folder, _, last = name.rpartition("/")
        side = self._at(f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}")
        stream = self._fs.create(side, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        rename = self._hadoop.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        side, target = self._fs.makeQualified(side), self._fs.makeQualified(self._at(name))
        self._hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(side, target, how)
