"""What the corpus operators share: word rules, table readers and intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.shared import ship

#: Word separators, as Java and RE2 patterns understand them.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """array<string> of the words of a text; null or blank: empty."""
    t = F.trim(c, F.lit(WS_CHARS))
    return F.when(F.length(t) > 0, F.split(t, WS)).otherwise(F.array().cast("array<string>"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Local masters alone may go without; they get one of their own."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark)}/quillgraph/{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already; the folder is temporary either way
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once into a table in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A broadcast hint behind a count; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


@contextmanager
def shuffled_joins(spark: SparkSession, most: int = 1 << 20) -> Iterator[None]:
    """Inside, Spark broadcasts by itself only tables of up to most bytes. Its own bound counts compressed bytes of a file, of which the driver
    holds the rows several times over: collected, hashed and serialised."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, most)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8; bytes.split() splits at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


class Hashes(dict):
    """64-bit hashes of words; a bounded cache."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        import xxhash

        self.h, self.seed, self.most = xxhash.xxh3_64_intdigest, seed, most

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[w] = x = self.h(w, self.seed)
        return x

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def single_threaded() -> None:
    """A task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
