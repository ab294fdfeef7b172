"""Small files and folders in whatever store Spark reads, by Hadoop's FileSystem."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Overwrite a small file and sync it."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def delete_at_end(self, path: str) -> None:
        fs, p = self._at(path)
        fs.deleteOnExit(p)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared folder that ``spark.checkpoint.dir`` names; a local
    temporary one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = named.rstrip("/") if named else f"file://{os.path.join(tempfile.gettempdir(), 'tidemark-shared')}"
    path = f"{root}/{what}-{uuid.uuid4().hex}"
    Files(spark).delete_at_end(path)
    return path
