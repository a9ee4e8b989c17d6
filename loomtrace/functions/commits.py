"""Numbered commits in a folder, each of which only one of several writers can make."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


class CommitLog:
    """``{root}/commits/{number}.json``. A commit is written aside and then takes its number in one step, which fails
    where the number is taken: a hard link on a local file system, elsewhere a rename that doesn't overwrite (HDFS does
    both atomically; a store without such a rename needs a lock around publish)."""

    def __init__(self, spark: SparkSession, root: str, linked: bool | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = f"{self.root}/commits"
        self._linked = self._fs.getUri().getScheme() == "file" if linked is None else linked

    def _local(self, path: str) -> Path:
        return Path(self._path(path).toUri().getPath())

    def numbers(self) -> list[int]:
        """The numbers taken, ascending."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict[str, Any]:
        stream = self._fs.open(self._path(f"{self.folder}/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, payload: dict[str, Any]) -> bool:
        """Whether the commit took the number; False where another writer was first."""
        text = json.dumps(payload, ensure_ascii=False).encode()
        draft, target = f"{self.folder}/_draft-{uuid.uuid4().hex}", f"{self.folder}/{number:012d}.json"
        self._fs.mkdirs(self._path(self.folder))
        if self._linked:
            aside = self._local(draft)
            with open(aside, "wb") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(aside, self._local(target))
                return True
            except FileExistsError:
                return False
            finally:
                aside.unlink()
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(text))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(target), options)
            return True
        except Exception:  # noqa: BLE001
            self._fs.delete(self._path(draft), False)
            if self._fs.exists(self._path(target)):
                return False
            raise

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def children(self, path: str) -> list[str]:
        """Names in a folder; none where there is no folder."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))
