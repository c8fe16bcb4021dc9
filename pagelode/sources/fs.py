"""Small files in a shared folder through Hadoop's file systems, and folders as tasks see them through pyarrow's."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import SparkSession


class SharedFolder:
    """The driver's view of one folder, by any URI the session's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        at = self._path("")
        self._fs = self._jvm.org.apache.hadoop.fs.FileSystem.newInstance(at.toUri(), self._conf)
        self._fs.setVerifyChecksum(False)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        """A file or a whole folder; nothing happens where there is none."""
        self._fs.delete(self._path(name), True)

    def read_json(self, name: str) -> dict[str, Any] | None:
        """The object in a file; None where it is missing or is no JSON object."""
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            got = json.loads(text)
        except ValueError:
            return None
        return got if isinstance(got, dict) else None

    def write_json(self, name: str, value: Any) -> None:
        """Written beside and renamed over, so a reader sees the old file or the new one."""
        fs = self._jvm.org.apache.hadoop.fs
        path, beside = (self._fs.makeQualified(self._path(n)) for n in (name, f"{name}.tmp-{os.getpid()}"))
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
        finally:
            out.close()
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        over = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
        over[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(path.toUri(), self._conf).rename(beside, path, over)


def open_folder(uri: str):
    """(file system, path in it) of a folder or file, for use within tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)
