"""Small files of any file system that Spark knows: read, replace at once, create only if new."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder by its Hadoop path; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._of("").getFileSystem(self._conf)

    def _of(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder that are not hidden, in order; none if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(n for f in self._fs.listStatus(self._of(name)) if not (n := f.getPath().getName()).startswith((".", "_")))

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return (self._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(self._of(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._of(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._of(name), True)

    def move(self, name: str, to: str, over: bool = False) -> None:
        """Rename; a file of the new name is an error unless it may be written ``over``."""
        self._move(name, to, *(["OVERWRITE"] if over else []))

    def _written(self, text: str) -> str:
        """A hidden file of its own with ``text``."""
        name = f".{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._of(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return name

    def _move(self, held: str, name: str, *how: str) -> None:
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, len(how))
        for i, h in enumerate(how):
            options[i] = getattr(rename, h)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._of(held), self._of(name), options)

    def replace(self, name: str, text: str) -> None:
        """The file has either its old text or all of the new one, whenever this is cut off."""
        self._move(self._written(text), name, "OVERWRITE")

    def create(self, name: str, text: str) -> bool:
        """Make the file with all of its text; False if there is one already. Of several writers one succeeds."""
        self._fs.mkdirs(self._of(name).getParent())
        held = self._written(text)
        try:
            if self._fs.getScheme() == "file":  # its rename looks first and moves then; a hard link does both at once
                paths = self._jvm.java.nio.file.Paths
                at = lambda n: paths.get(self._fs.makeQualified(self._of(n)).toUri())
                self._jvm.java.nio.file.Files.createLink(at(name), at(held))
            else:
                self._move(held, name)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.delete(held)
        return True
