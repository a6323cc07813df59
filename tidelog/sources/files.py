"""Small files on any Hadoop file system: the manifest's commits, the configuration and write-ahead files."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, data: bytes) -> bool:
        """All of the file or nothing, and False if the file is there already. It is written aside and then takes its
        name by a step that fails if the name is taken: a hard link on a local disk, else a rename without overwriting
        (atomic on HDFS and the like; an object store needs a committer of its own)."""
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.{last}.{uuid.uuid4().hex}"
        self.replace(aside, data)
        try:
            if self.local:
                plain = lambda n: self._path(n).toUri().getPath()
                try:
                    os.link(plain(aside), plain(name))
                except FileExistsError:
                    return False
            else:
                kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                none = self.gateway.new_array(kinds, 1)
                none[0] = kinds.NONE
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
                try:
                    context.rename(self._path(aside), self._path(name), none)
                except Exception as e:
                    if "AlreadyExists" in str(e) or "already exists" in str(e):
                        return False
                    raise
            return True
        finally:
            self.delete(aside)

    def move(self, name: str, to: str) -> bool:
        return bool(self.fs.rename(self._path(name), self._path(to)))

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))

    def replace(self, name: str, data: bytes) -> None:
        out = self.fs.create(self._path(name), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, name: str) -> bytes | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def ages(self, folder: str) -> dict[str, float]:
        """Seconds since each file of the folder was written."""
        path, now = self._path(folder), time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self.fs.listStatus(path)} if self.fs.exists(path) else {}

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
