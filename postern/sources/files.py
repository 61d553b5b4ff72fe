"""Small files through Spark's own file system layer, so tables live wherever Spark can write."""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from postern.errors import ConcurrentWriteError


class Files:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.base = base.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def at(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read_json(self, name: str) -> Any:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create_json(self, name: str, value: Any) -> None:
        """Creates the file, or ConcurrentWriteError if it exists: the one commit point of a table.

        The text is complete before the name exists, because it is written to a draft that is then given the
        name.  That step is exclusive: a hard link on local disks, elsewhere a rename that the file system's
        own metadata refuses if the name is taken (HDFS and file systems with its rename).  Stores without
        such a rename cannot hold tables that several writers change.
        """
        target = self._path(name)
        parent, draft = target.getParent(), self._path(f"{name}.{self._jvm.java.util.UUID.randomUUID()}.draft")
        self._fs.mkdirs(parent)
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        try:
            self._name(draft, target)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise ConcurrentWriteError(f"{name} was written by another") from None
        finally:
            self._fs.delete(draft, False)

    def _name(self, draft: Any, target: Any) -> None:
        """Gives the draft the target's name too, or fails if there is such a name."""
        if self._fs.getScheme() == "file":
            at = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri().getPath(), self._none(self._jvm.java.lang.String))
            self._jvm.java.nio.file.Files.createLink(at(target), at(draft))
        else:
            options = self._none(self._jvm.org.apache.hadoop.fs.Options.Rename)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)

    def _none(self, kind: Any) -> Any:
        """An empty array for a method with a variable number of arguments."""
        return self._gateway.new_array(kind, 0)
