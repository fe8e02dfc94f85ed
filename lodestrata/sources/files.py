"""Small files on any Hadoop file system: the few moves a commit needs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """Reads, exclusive creates, renames and listings below one root.

    Exclusive creation is what all commits rest on: a hard link on a local file system, elsewhere the
    rename of a file, which HDFS refuses if the name is taken. Folders are renamed only by the writer
    whose exclusive record names them, because a rename of a folder may not fail but nest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._path("")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(path) if not (n := s.getPath().getName()).startswith("_"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, text: str) -> None:
        """Writes a new file whole; FileExistsError if the name is taken, so one writer wins."""
        folder, _, last = name.rpartition("/")
        staged, target = self._path(f"{folder}/_{last}.{uuid.uuid4().hex}".lstrip("/")), self._path(name)
        out = self._fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                self._link(staged.toUri().getPath(), target.toUri().getPath(), text)
            elif self._fs.exists(target) or not self._fs.rename(staged, target):
                raise FileExistsError(name)
        finally:
            self._fs.delete(staged, False)

    @staticmethod
    def _link(staged: str, target: str, text: str) -> None:
        try:
            os.link(staged, target)
        except FileExistsError:
            raise
        except OSError:  # a mount without hard links: exclusive still, if not whole at once; checksums tell a cut record
            with open(target, "x", encoding="utf-8", newline="") as f:
                f.write(text)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """Moves a folder to the name its record gives; done already by another is fine."""
        self._fs.mkdirs(self._path(new).getParent())
        if not self.exists(new) and self.exists(old) and not self._fs.rename(self._path(old), self._path(new)) and not self.exists(new):
            raise OSError(f"cannot move {old} to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self, name: str = "") -> int:
        path = self._path(name)
        return int(self._fs.getContentSummary(path).getLength()) if self._fs.exists(path) else 0
