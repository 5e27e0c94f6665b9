"""Names and small files in whatever store Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Names and small files of a folder in whatever store Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def qualified(self) -> str:
        return self.fs.makeQualified(self._path("")).toString()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{self.root}/{old} could not be renamed to {new}")
