"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file is a row of blocks. Each block ranks its own ids by frequency, so the frequent ones take one byte, and holds:
magic, counts, document ids (with null flags) and lengths, the table from rank to id, control bytes (four 2-bit lengths
each) and data bytes. Blocks are decoded without a loop: a table gives the four lengths of each control byte, a running
sum the offsets, and shifted gathers the ranks.

Documents are range-partitioned and sorted by id; a task streams its range into one shard, so memory is bounded by a
block. Shards stand in ascending order of document ids.

Cases. Null text: empty, its end id alone. Null doc_id: sorts first. Repeated ids: each document is written, in order
of the texts. Empty table: no files, empty result. A text longer than a block makes a longer block. A special token's string
in a text: that token, as a plain call of the library has it. Extra columns: ignored.
"""

from __future__ import annotations

import struct
import zlib
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

MAGIC, HEAD = b"QVB1", struct.Struct("<4sIQIQ")
BLOCK_IDS, END = 2_000_000, 2
#: A task's share of the texts, at most, unless more partitions are asked for anyway.
SHARD_BYTES = 256_000_000
#: Ids below are counted in a table, others sorted.
DENSE = 1 << 20
#: Lengths of the four values of each control byte.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1


def encode_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """ids: unsigned 32-bit, of all the documents one after another."""
    if int(ids.max(initial=0)) < DENSE:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts).astype(np.uint32)
        counts, where = counts[values], None
    else:
        values, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    if where is None:
        table = np.zeros(DENSE, np.uint32)
        table[values] = rank
        r = table[ids]
    else:
        r = rank[where]
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    quads = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    quads[: len(r)] = size - 1
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    data[start] = r & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        data[start[more] + k] = r[more] >> np.uint32(8 * k) & 0xFF
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(values), len(data))
    return b"".join([head, null.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and the ids of all of them."""
    magic, n_docs, n, n_values, n_data = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of a token file")
    at = HEAD.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, k, at)
        at += out.nbytes
        return out

    null, docs, lengths, values = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs), take("<u4", n_values)
    size = LENGTHS[take("u1", -(-n // 4))].ravel()[:n]
    data = np.concatenate([take("u1", n_data), np.zeros(3, np.uint8)])
    start = np.cumsum(size, dtype=np.int64) - size
    r = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        r[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else int(d) for z, d in zip(null, docs)], lengths.astype(np.int64), values[r] if n else np.zeros(0, np.uint32)


def write_files(docs: DataFrame, vocabulary: str, end: int = END, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, str]:
    """Writes docs in ascending order of doc_id. Returns the blocks (file, shard, block, at, bytes, docs, ids) and the folder."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, rows = encoder(vocabulary), None, []
        ending = np.array([end], "<u2").tobytes()
        ids: list[bytes] = []
        held: list[tuple] = []
        count = 0

        def flush() -> None:
            nonlocal count
            b = encode_block([d for d, _ in held], [n for _, n in held], np.frombuffer(b"".join(ids), "<u2").astype(np.uint32))
            rows.append((shard.name, TaskContext.get().partitionId(), len(rows), shard.write(b), len(b), len(held), count))
            ids.clear(), held.clear()
            count = 0

        for batch in batches:
            for doc_id, b in zip(batch.column(0).to_pylist(), enc.encode_all(text.as_py() for text in batch.column(1))):
                if shard is None:
                    shard = Shard(folder, TaskContext.get().partitionId(), TaskContext.get().taskAttemptId())
                b += ending
                ids.append(b)
                held.append((doc_id, len(b) // 2))
                count += len(b) // 2
                if count >= block_ids:
                    flush()
        if held:
            flush()
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["file", "shard", "block", "at", "bytes", "docs", "ids"])

    d = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(d.mapInArrow(write, "file string, shard long, block long, at long, bytes long, docs long, ids long"), "blocks"), folder


def read_files(blocks: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths, ids = decode_block(reader.read(row["file"], row["at"], row["bytes"]))
                ends, raw = np.cumsum(lengths), memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - lengths + row["before"]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # ids before a block: a scan over the shards, then one inside each shard
    per = blocks.groupBy("shard").agg(F.sum("ids").alias("all"))
    per = per.select("shard", (F.sum("all").over(W.orderBy("shard")) - F.col("all")).alias("shards_before"))
    b = blocks.withColumn("inside", F.sum("ids").over(W.partitionBy("shard").orderBy("block")) - F.col("ids"))
    b = b.join(per, "shard").select("file", "at", "bytes", (F.col("shards_before") + F.col("inside")).alias("before"))
    n = max(1, min(blocks.count(), 4 * blocks.sparkSession.sparkContext.defaultParallelism))
    return b.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(*write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op7_token_files": op7_token_files}
SQL: dict = {}
