"""Token counts from flat, unindexed token files by a scan for separators.

A file holds little-endian unsigned 16-bit ids, nothing else; the end-of-document id closes each document. Files are
cut into blocks of any size; a task finds the separators of its blocks in one vectorised comparison. What a block cannot
know, where its first document began and how many ended before, comes from a prefix scan over the few numbers of each block:
a running maximum of the last separator's place and a running sum of separators.

Cases. Null or empty text: a document of no tokens. Null doc_id: kept. Repeated rows: each is a document. Empty table:
no files, empty result. Documents longer than a block: stitched. Ids after the last separator of a file: an
unfinished document, not counted. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shared_path, table, written
from .encoding import encoder
from .shards import Reader, Shard

END, BLOCK_IDS = 50_256, 1 << 20


def write_flat(docs: DataFrame, vocabulary: str, end: int = END) -> tuple[DataFrame, DataFrame, str]:
    """Writes a flat file for each partition of docs. Returns the files (file, ids), the order of documents in them
    (file, ordinal, doc_id), which the files themselves do not tell, and the folder."""
    folder = shared_path(docs.sparkSession, "flat")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, ordinal = encoder(vocabulary, plain=True), None, 0  # only a document's end is a separator
        ending = np.array([end], "<u2").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                shard = Shard(folder, TaskContext.get().partitionId(), TaskContext.get().taskAttemptId())
            for ids in enc.encode_all(text.as_py() for text in batch.column(1)):
                shard.write(ids + ending)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([shard.name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0), pa.nulls(n, pa.int64())], names=["file", "ordinal", "doc_id", "ids"])
            ordinal += n
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard.name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([shard.size // 2])], names=["file", "ordinal", "doc_id", "ids"])

    made = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "file string, ordinal long, doc_id long, ids long"), "flat-order")
    return made.filter("ids IS NOT NULL").select("file", "ids"), made.filter("ids IS NULL").select("file", "ordinal", "doc_id"), folder


def scan(files: DataFrame, folder: str, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, ordinal, start, n_tokens (without the separator) of each document that the files hold."""
    blocks = files.filter("ids > 0").select("file", "ids", F.explode(F.expr(f"sequence(0L, (ids - 1) div {block_ids})")).alias("block"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["block"] * block_ids
                ids = np.frombuffer(reader.read(row["file"], 2 * at, 2 * min(block_ids, row["ids"] - at)), "<u2")
                seps = np.flatnonzero(ids == end) + at
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]]), pa.array([len(seps)]), pa.array([int(seps[-1]) if len(seps) else None], pa.int64()), pa.array([seps], pa.list_(pa.int64()))], names=["file", "block", "n", "last", "seps"])

    n = 4 * files.sparkSession.sparkContext.defaultParallelism
    found = written(blocks.repartition(n).mapInArrow(find, "file string, block long, n long, last long, seps array<long>"), "separators")
    by = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitch = found.select("file", "block", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(by), F.lit(-1)).alias("previous"))
    f = found.filter("n > 0").join(stitch, ["file", "block"])
    # starts of the block's documents: after the separator before each
    f = f.select("file", "before", "seps", F.concat(F.array(F.col("previous") + 1), F.transform(F.expr("slice(seps, 1, size(seps) - 1)"), lambda x: x + 1)).alias("starts"))
    f = f.select("file", "before", F.posexplode(F.arrays_zip("seps", "starts")).alias("k", "d"))
    return f.select("file", (F.col("before") + F.col("k")).alias("ordinal"), F.col("d.starts").alias("start"), (F.col("d.seps") - F.col("d.starts")).alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every document, counted in the files."""
    files, order, folder = write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return scan(files, folder).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict = {}
