"""Small files, states of outputs and names under a folder: on the driver's disk, or on whatever file system Spark reads."""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Local:
    """Paths of the machine that the driver runs on."""

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def state(self, path: str) -> dict:
        """Time and size of a file, or the latest time and whole size of a folder's files."""
        files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names] if os.path.isdir(path) else [path]
        stats = [os.stat(f) for f in files]
        return {"path": path, "mtime": max((s.st_mtime for s in stats), default=0.0), "size": sum(s.st_size for s in stats)}

    def named(self, pattern: str) -> list[str]:
        return sorted(glob.glob(pattern))

    def below(self, folder: str, ending: str) -> list[str]:
        """Files at any depth whose names end so."""
        return sorted(str(p) for p in Path(folder).rglob(f"*{ending}"))

    def same(self, path: str) -> str:
        """One spelling of a path."""
        return os.path.abspath(path)

    def link(self, path: str) -> bool:
        return os.path.islink(path)

    def read(self, path: str) -> str:
        return Path(path).read_text()

    def write(self, path: str, text: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        part = Path(f"{path}.{uuid.uuid4().hex}.part")
        part.write_text(text)
        part.replace(path)

    def drop(self, path: str) -> None:
        shutil.rmtree(path) if os.path.isdir(path) else Path(path).unlink(missing_ok=True)


class Shared:
    """Paths of any scheme that Spark reads. Small files go through Hadoop's FileSystem; the files of a table, which may be many, are
    listed and summed up by Spark, so that no listing of a large table passes through the driver."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._hadoop = spark._jvm.org.apache.hadoop

    def _at(self, path: str):
        p = self._hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def state(self, path: str) -> dict:
        """Latest time, whole size and number of a file's or folder's files, and a digest of their names, times and sizes, which also
        shows that one of them was replaced by an older one. Names that begin with _ or . are no data."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        ms = F.unix_millis("modificationTime")
        r = files.agg(F.max(ms).alias("t"), F.sum("length").alias("n"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("path", ms, "length")).alias("x")).first()
        return {"path": path, "mtime": (r["t"] or 0) / 1000, "size": r["n"] or 0, "files": r["k"], "digest": r["x"] or 0}

    def named(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    def below(self, folder: str, ending: str) -> list[str]:
        """Files at any depth whose names end so. Only folders that hold small files are asked for them."""
        fs, p = self._at(folder)
        found, names = fs.listFiles(p, True), []
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(ending):
                names.append(name)
        return sorted(names)

    def same(self, path: str) -> str:
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()

    def link(self, path: str) -> bool:
        return False

    def age(self, path: str) -> float:
        """Seconds since a file was written, by the clock of the driver."""
        fs, p = self._at(path)
        return self.spark._jvm.System.currentTimeMillis() / 1000 - fs.getFileStatus(p).getModificationTime() / 1000

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The file has its name only when it is whole."""
        fs, p = self._at(path)
        part = self._hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(part, p):  # some file systems do not rename onto a file
            fs.delete(p, False)
            if not fs.rename(part, p):
                raise OSError(f"{path} could not be written")

    def drop(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


Folders = Local | Shared
LOCAL = Local()


def expanded(folders: Folders, paths: Iterable[str]) -> list[str]:
    return [x for p in map(str, paths) for x in (folders.named(p) if any(c in p for c in "*?[") else [p])]
