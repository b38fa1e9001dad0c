"""Small files on any store that Spark reaches, through Hadoop's file system API on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file, never over another: FileExistsError where the path is taken."""
        p, fs = self._path(path)
        if fs.exists(p):
            raise FileExistsError(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise FileExistsError(path) from None
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def commit(self, base: str, version: int, text: str) -> None:
        """Version `version` of a document as <base>-<version>.json; FileExistsError where another writer was first. Nothing is replaced or deleted, so a crash at any point leaves the versions before it as they were."""
        self.create(f"{base}-{version}.json", text)

    def newest(self, base: str) -> tuple[int, int, dict]:
        """(its version, the highest version begun, content) of the newest whole version; (0, begun, {}) if there is none. A version that a crash cut short is passed over."""
        folder, name = base.rsplit("/", 1)
        at = sorted((int(m[1]) for f in self.list(folder) if (m := re.fullmatch(re.escape(name) + r"-(\d+)\.json", f))), reverse=True)
        for v in at:
            try:
                return v, at[0], json.loads(self.read(f"{base}-{v}.json"))
            except ValueError:
                continue
        return 0, at[0] if at else 0, {}

    def write(self, path: str, text: str) -> None:
        """A file that no other writer touches, replaced if it is there."""
        p, fs = self._path(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def size(self, path: str) -> int:
        """Bytes below a path."""
        p, fs = self._path(path)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def list(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def copy(self, source: str, target: str) -> None:
        s, fs = self._path(source)
        t, ft = self._path(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, s, ft, t, False, True, self.conf)
