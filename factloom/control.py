"""Small control files: numbered JSON documents that appear at once or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Control:
    """Numbered JSON files below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.system.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.system.listStatus(self._path(folder))) if self.exists(folder) else []

    def numbers(self, folder: str) -> list[int]:
        return [int(n[:-5]) for n in self.names(folder) if n.endswith(".json")]

    def put(self, folder: str, number: int, value: object) -> None:
        """Write under another name, then rename."""
        draft, path = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:012}.json")
        out = self.system.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self.system.delete(path, False)
        if not self.system.rename(draft, path):
            raise OSError(f"could not write {path}")

    def get(self, folder: str, number: int):
        stream = self.system.open(self._path(f"{folder}/{number:012}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
