"""Small text files on any file system that Spark reads."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Reads and replaces small files.  A replaced file is written aside and renamed over the old one,
    which readers see whole: the old text or the new one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, path: str) -> str | None:
        """The text, or None if there is no such file."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        whole = fs.makeQualified(p)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), whole, options)

    def names(self, path: str) -> list[str]:
        """Names of a folder's files, sorted; those in the making don't count."""
        fs, p = self._at(path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if not n.startswith("."))

    def claim(self, path: str) -> bool:
        """Make an empty file; False if it is there already.  Of several callers one gets True."""
        fs, p = self._at(path)
        try:
            fs.create(p, False).close()
            return True
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise

    def remove(self, path: str) -> None:
        """Delete a file or folder, if it is there."""
        fs, p = self._at(path)
        fs.delete(p, True)
