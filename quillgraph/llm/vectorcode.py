"""Product codes of vectors: codebooks trained by a reduction tree over columnar blocks.

Vectors are kept as blocks, dimension by dimension. An RDD of blocks is folded by treeAggregate: a task adds up each part's
distances to the codebook's entries one dimension after another, and collects integer sums and counts of each entry by
np.add.at; the tree merges tensors of parts x entries x dimensions, whatever the number of vectors. Integers make the
result the same under every partitioning.

Cases. A vector that is null, or holds a null or non-finite component, is left out. A null vec_id is coded, and comes last where ids
are ordered; rows that share an id are coded each, and stand in order of their components for the first codebook. Vectors of unlike length:
missing components count as 0, as do those that fill the last part up. Fewer vectors than entries: as many entries. Ties: the lower
index. Null labels are one label. Empty table: empty result. Extra columns: ignored. Distances are exact as long as they fit a long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .packing import pack, unpack
from .vectors import SCALE, floored, matrix, whole, width_of

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components a block, and rows at once in the inner loops.
BLOCK, TILE = 1 << 20, 4_096
#: A label with more than such a share of all rows is joined by broadcast; there are at most so many.
HOT = 10_000


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    return vectors.filter(whole()).select("vec_id", "label", floored(scale=scale).alias("w"))


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """vec_ids, labels and columns of blocks of rows: columns holds the components dimension by dimension."""
    at_once = max(64, BLOCK // max(width, 1))
    label = rows.schema["label"].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                b = batch.slice(a, at_once)
                columns = pack(np.ascontiguousarray(matrix(b.column("w"), width).T).ravel())
                one = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*one, pa.array([columns], pa.binary())], names=["vec_id", "label", "columns"])

    return rows.mapInArrow(f, f"vec_id array<long>, label array<{label}>, columns binary")


def first_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x dimensions: the parts of the vectors of smallest ids."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "w").limit(entries).select("w").collect()
    out = np.zeros((len(least), width), np.int64)
    for k, r in enumerate(least):
        out[k, : len(r["w"])] = r["w"]
    return np.ascontiguousarray(out.reshape(len(least), parts, width // parts).transpose(1, 0, 2))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one part, dimensions by rows: each row's nearest entry and its squared distance, summed dimension by dimension."""
    n = x.shape[1]
    code, least = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(0, n, TILE):
        tile = x[:, a : a + TILE]
        d = np.zeros((len(book), tile.shape[1]), np.int64)
        for dim in range(len(tile)):
            gap = tile[dim] - book[:, dim, None]
            d += gap * gap
        code[a : a + TILE] = k = d.argmin(axis=0)
        least[a : a + TILE] = d[k, np.arange(d.shape[1])]
    return code, least


def by_part(columns: bytes, books: np.ndarray) -> np.ndarray:
    return unpack(columns)[0].reshape(len(books), books.shape[2], -1)


def trained(made: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds of assignment and means; made: blocks."""
    rdd = made.select("columns").rdd.map(lambda r: bytes(r["columns"]))
    depth = max(2, math.ceil(math.log(max(rdd.getNumPartitions(), 2), 32)))
    for _ in range(rounds):
        held = rdd.context.broadcast(books)

        def fold(acc: tuple[np.ndarray, np.ndarray], columns: bytes) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = acc
            for p, x in enumerate(by_part(columns, held.value)):
                code, _ = nearest(x, held.value[p])
                np.add.at(counts[p], code, 1)
                for dim in range(len(x)):
                    np.add.at(sums[p, :, dim], code, x[dim])
            return acc

        def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return a[0] + b[0], a[1] + b[1]

        sums, counts = rdd.treeAggregate((np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)), fold, merged, depth)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        held.unpersist()
    return books


def coded(made: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each vector of the blocks."""
    held = made.sparkSession.sparkContext.broadcast(books)
    label = made.schema["label"].dataType.elementType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = by_part(batch.column("columns")[k].as_py(), held.value)
                codes, error = np.empty((x.shape[2], len(x)), np.uint8), np.zeros(x.shape[2], np.int64)
                for p in range(len(x)):
                    codes[:, p], d = nearest(x[p], held.value[p])
                    error += d
                text = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[k].values, batch.column("label")[k].values, pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return made.mapInArrow(f, f"vec_id long, label {label}, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """label_error: errors summed over equal labels. Labels of very many rows are joined by broadcast (at most HOT), others by shuffle."""
    sums = written(codes.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n_")), "label-errors")
    total = sums.agg(F.sum("n_")).first()[0] or 0
    hot = F.broadcast(sums.filter(F.col("n_") * HOT > total))
    same = F.col("label").eqNullSafe(F.col("label_"))
    often = codes.join(hot, same)
    return often.unionByName(codes.join(hot, same, "left_anti").join(sums.filter(F.col("n_") * HOT <= total), same)).drop("label_", "n_")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes with errors (vec_id, label, code, error) of all whole vectors, and the codebooks. At most 256 entries."""
    rows = written(quantised(vectors), "vectors")
    width = -(-width_of(rows) // parts) * parts
    if not width:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    made = written(blocks(rows, width), "vector-blocks")
    books = trained(made, first_codebooks(rows, width, parts, entries), rounds)
    return written(coded(made, books), "codes"), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the integer components that a code stands for."""
    held = codes.sparkSession.sparkContext.broadcast(books)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = held.value
            k = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, len(b))
            w = np.concatenate([b[p][k[:, p]] for p in range(len(b))], axis=1)
            offs = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(offs, pa.array(w.ravel()))], names=["vec_id", "w"])

    return codes.select("vec_id", "code").mapInArrow(f, "vec_id long, w array<long>")


def digest_of(books: np.ndarray) -> str:
    """sha256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        """v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "e AS (SELECT r, p, j, w[p * (len(w) // 16) + j + 1] AS x FROM v, range(16) a(p), range((SELECT max(len(w)) // 16 FROM v)) b(j))",
        "c0 AS (SELECT p, r - 1 AS k, j, x FROM e WHERE r <= 64)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT e.r, e.p, c.k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{n} c ON c.p = e.p AND c.j = e.j GROUP BY 1, 2, 3)")
        steps.append(f"a{n} AS (SELECT r, p, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1)")
        if n < ROUNDS:
            steps.append(f"m{n} AS (SELECT a.p, a.k, e.j, floor(sum(e.x)::DOUBLE / count(*))::BIGINT AS x FROM a{n} a JOIN e ON e.r = a.r AND e.p = a.p GROUP BY 1, 2, 3)")
            steps.append(f"c{n + 1} AS (SELECT c.p, c.k, c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.p = c.p AND m.k = c.k AND m.j = c.j)")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, k, j)) FROM c{ROUNDS}) AS codebooks_sha256 FROM o JOIN v ON v.r = o.r"""


SQL = {"op13_vector_codes": _sql()}
QUERIES = {"op13_vector_codes": op13_vector_codes}
