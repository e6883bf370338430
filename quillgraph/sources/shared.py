"""Lineage cuts in the shared folder that the session names, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="quillgraph-code-")) / "quillgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "quillgraph").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_folder(sc: SparkContext) -> str:
    """The folder that the session names. Local masters alone may go without; they get a folder of their own."""
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillgraph-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(sc))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its plan becomes a scan, with sizes that the planner can use."""
    path = f"{shared_folder(df.sparkSession.sparkContext)}/quillgraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A broadcast hint, if a count allows it."""
    return F.broadcast(df) if df.count() <= most else df
