"""Exact top-k search by inner product, term at a time.

Vectors and queries are cut into blocks; each query block meets each vector block once. A task inverts its vector block
into postings (for each term the rows that hold it, with weights), and for each term of the sparse queries
scatters query weight times posting weights into a dense array of scores, queries by rows. Partition selection finds each
query's k best of the block, and a window merges the blocks' bests.

Cases. A vector that is null, or holds a null or non-finite component, takes no part, nor does a row of null id. Vectors
of unlike length: missing components count as 0. Ties: smaller vec_id. Rows that share a vec_id: each may be found; a
query does not find rows of its own id, and is answered once. Empty tables: empty result. Extra columns: ignored.
Scores are integers and exact as long as they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

K, EVERY, SCALE = 5, 50, 256
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK, TILE = 2_048, 65_536, 512, 2_048


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and integer weights of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(ok).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("w"))


def packed(df: DataFrame, key: str) -> DataFrame:
    """One row a block: ids, and weights one after another with their lengths; blocks hold a bounded number of rows."""
    return df.groupBy(key).agg(F.collect_list(F.struct("vec_id", "w")).alias("rows"))


def dense(rows) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and weights, a row each, of a block."""
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    lists = rows.field("w")
    flat, offs = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    length = np.diff(offs)
    w = np.zeros((len(ids), int(length.max(initial=0))), np.int64)
    w[np.repeat(np.arange(len(ids)), length), np.arange(len(flat)) - np.repeat(offs[:-1], length)] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], w[order]


def kind_of(q: np.ndarray, v: np.ndarray) -> type:
    """Floats where they hold every score exactly, below 2**53; else integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(min(q.shape[1], v.shape[1]), 1)
    return np.float64 if most < 2**53 else np.int64


def inverted(v: np.ndarray, kind: type) -> list[tuple]:
    """The postings of each term: rows, ascending, and their weights. Of a term that more than half of the rows hold, rows are
    None and the weights those of all rows, zeros too: adding them as a whole costs less than a scatter."""
    out = []
    for t in range(v.shape[1]):
        rows, weights = np.flatnonzero(v[:, t]), v[:, t].astype(kind)
        out.append((None, weights) if 2 * len(rows) > len(v) else (rows, weights[rows]))
    return out


def accumulate(q: np.ndarray, postings: list[tuple], n: int) -> np.ndarray:
    """Scores of query rows (of the postings' kind) against n vector rows, term at a time."""
    scores, room = np.zeros((len(q), n), q.dtype), np.empty((len(q), n), q.dtype)
    for t, (posting, weight) in enumerate(postings[: q.shape[1]]):
        rows = np.flatnonzero(q[:, t])
        if not len(rows) or not len(weight):
            continue
        if posting is not None:
            scores[np.ix_(rows, posting)] += q[rows, t, None] * weight
        elif 2 * len(rows) > len(q):
            scores += np.multiply(q[:, t, None], weight, out=room)
        else:
            scores[rows] += q[rows, t, None] * weight
    return scores.astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best allowed scores; columns stand in order of ids, so the first of equals win."""
    cols = np.flatnonzero(allowed)
    if len(cols) <= k:
        return cols
    s = scores[cols]
    least = np.partition(s, len(s) - k)[len(s) - k]
    above = np.flatnonzero(s > least)
    return cols[np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])]


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have vec_id and integer weights w."""
    spark = vectors.sparkSession
    n, nq = vectors.count(), queries.count()
    rows = min(MOST_BLOCK, max(LEAST_BLOCK, n // (3 * spark.sparkContext.defaultParallelism) + 1))
    nv, qb = max(1, -(-n // rows)), max(1, -(-nq // QUERY_BLOCK))
    v = packed(vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id", "w"), F.lit(nv)).cast("int")), "vb").withColumnRenamed("rows", "v")
    q = packed(queries.dropDuplicates(["vec_id"]).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(qb)).cast("int")), "qb").withColumnRenamed("rows", "q")
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))  # each vector block gets each query block

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qw = dense(batch.column("q").slice(i, 1).flatten())
                vi, vw = dense(batch.column("v").slice(i, 1).flatten())
                out: list[tuple] = []
                # tiles keep the scores in the processor's cache; each tile is inverted once and meets all queries
                kind = kind_of(qw, vw)
                tiles = [(inverted(vw[b : b + TILE], kind), len(vw[b : b + TILE])) for b in range(0, len(vi), TILE)]
                qw = qw.astype(kind)
                for a in range(0, len(qi), 64):
                    parts = [accumulate(qw[a : a + 64], postings, n_rows) for postings, n_rows in tiles]
                    s = np.concatenate(parts, axis=1)
                    for j in range(len(s)):
                        cols = best(s[j], vi != qi[a + j], k)
                        out.append((np.full(len(cols), qi[a + j]), vi[cols], s[j][cols]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    found = q.join(v, "vb").select("q", "v").mapInArrow(scored, "query_id long, vec_id long, score long")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(quantised(table(spark, sf_dir, "embeddings")), "weights")
    return search(v.filter(F.col("vec_id") % EVERY == 0), v)


SQL = {
    "op5_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, v.vec_id, list_sum(list_transform(range(1, 1 + least(len(q.w), len(v.w))), lambda i: q.w[i] * v.w[i]))::BIGINT score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op5_exact_topk": op5_exact_topk}
