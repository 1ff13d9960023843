"""Small files on any store that Spark reaches, with one exclusive operation.

``publish`` makes a complete file appear under a name, or says that the name is taken. On
a local disk that is a hard link of a finished temporary file; elsewhere it is the
file system's rename that refuses to overwrite, which HDFS does atomically. A bare
object store needs a committer with put-if-absent in front of it.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    if parts.scheme == "":
        return path
    return unquote(parts.path) if parts.scheme == "file" else None


class Files:
    """Text files below a root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _jvm(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, name: str, text: str) -> bool:
        """Whether ``name`` now holds ``text``; False if the name was taken."""
        path = self.path(name)
        temporary = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp"
        if (local := _local(path)) is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            made = _local(temporary)
            try:
                with open(made, "x", encoding="utf-8") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(made, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
        jvm, target, fs = self._jvm(path)
        fs.mkdirs(target.getParent())
        source = jvm.org.apache.hadoop.fs.Path(temporary)
        out = fs.create(source, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(source, False)
            return False

    def names(self, folder: str, after: str = "") -> list[str]:
        """Names in a folder greater than ``after``, in order."""
        path = self.path(folder)
        if (local := _local(path)) is not None:
            found = os.listdir(local) if os.path.isdir(local) else []
        else:
            _, target, fs = self._jvm(path)
            found = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(n for n in found if not n.startswith(".") and n > after)

    def read(self, name: str) -> str | None:
        """A file's text; None if there is none."""
        path = self.path(name)
        if (local := _local(path)) is not None:
            try:
                with open(local, encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        jvm, target, fs = self._jvm(path)
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        """Remove a file or a folder; False if there was none."""
        _, target, fs = self._jvm(self.path(name))
        return bool(fs.delete(target, True))
