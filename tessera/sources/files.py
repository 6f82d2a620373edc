"""Files on any store that Hadoop knows, through the session: local disks and remote stores alike."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..errors import StorageError


class Files:
    def __init__(self, spark: SparkSession):
        self.sc, self.jvm, self.conf = spark.sparkContext, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def children(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds since it was changed) of what a folder holds; nothing if there is no such folder."""
        p, fs = self._at(path)
        now = self.jvm.java.lang.System.currentTimeMillis()
        return [(x.getPath().getName(), (now - x.getModificationTime()) / 1000) for x in fs.listStatus(p)] if fs.exists(p) else []

    def create(self, path: str, text: str) -> bool:
        """A whole new file, or False if there is one: of several writers one wins. The store's rename must not replace files (as on HDFS); on
        local disks a hard link takes its place."""
        p, fs = self._at(path)
        q, _ = self._at(f"{path}.{uuid.uuid4().hex}")
        try:
            fs.mkdirs(p.getParent())
            stream = fs.create(q, False)
            stream.write(bytearray(text.encode()))
            stream.close()
            if fs.getScheme() == "file":
                os.link(*(fs.makeQualified(x).toUri().getPath() for x in (q, p)))
            else:
                none = self.sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(fs.makeQualified(q), fs.makeQualified(p), none)
            return True
        except Exception as e:
            if isinstance(e, FileExistsError) or "FileAlreadyExistsException" in str(e):
                return False
            raise StorageError(f"{path}: {e}") from e
        finally:
            fs.delete(q, False)
