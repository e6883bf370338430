"""Hard negatives by exact search in inverted lists: clusters by k-means, each with the radius around its centroid.

Centroids are fitted on a bounded sample (SAMPLE rows at most, those of least hash, and K_MOST centroids at most); every row
enters the list of its nearest centroid. By Cauchy-Schwarz no row of a cluster scores above q.c + |q| radius, nor below
q.c - |q| radius. A query visits clusters in descending order of that upper bound, in waves: it skips clusters that its windows of
scores exclude, and ends as soon as the next bound falls strictly below its k-th score (a tie might still win by its id).
So the result is that of a search through all rows. A list is cut into parts of bounded size; a part is read once a wave, and
the packed queries that visit it stream past it.

Cases. Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows of null id. Rows that share
an id: each may be found, never by an anchor of that id; of equal anchor ids the least (label, vector) is the anchor. Vectors of unlike
length: missing components count as 0. Ties: smaller vec_id. Fewer than k: all. A negative positive score opens no window. Empty
tables: empty result. Extra columns: ignored. Scores are integers, exact as long as they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written
from .packing import pack, unpack
from .vectors import floored, matrix, whole, width_of

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
SAMPLE, K_MOST, LLOYD = 16_384, 1_024, 8
LEAST_PART, MOST_PART, TILE, QUERIES_AT_ONCE = 2_048, 65_536, 2_048, 256
#: Clusters that a query visits before each test of its bounds; the last wave visits all that are left.
WAVES = (4, 32, K_MOST)
NO_LEAST, NO_MOST = -(2**62), 2**62
LISTED = "list long, kind int, ids array<long>, labels array<long>, weights binary, queries binary"
QUERY = "query_id long, label long, w array<long>, tags array<int>, lo array<long>, hi array<long>, kth array<long>"
FOUND = "query_id long, tag int, vec_id long, score long"


def centroids_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; a centroid without rows stays."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].astype(float)
    x, square = sample.astype(float), (sample.astype(float) ** 2).sum(axis=1)
    for _ in range(LLOYD):
        a = nearest(x, square, c)[0]
        sums, n = np.zeros_like(c), np.bincount(a, minlength=k)
        np.add.at(sums, a, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, square: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and its distance, which is computed apart for precision."""
    a = (square[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return a, np.sqrt(((x - c[a]) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Index:
    """centroids, radii and parts by cluster (at most K_MOST of them), and a table of the lists' parts."""

    lists: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    width: int


def build(rows: DataFrame) -> Index | None:
    """An index of rows (vec_id, label, w); None without any."""
    spark = rows.sparkSession
    n, width = rows.count(), width_of(rows)
    if not n or not width:
        return None
    least = rows.select("w", F.xxhash64("w", "vec_id").alias("h")).orderBy("h", "w").limit(SAMPLE).select("w").toArrow()
    sample = matrix(pa.chunked_array(least.column("w")).combine_chunks(), width)
    c = centroids_of(sample, min(K_MOST, max(1, int(min(n, SAMPLE) ** 0.5))))
    held = spark.sparkContext.broadcast(c)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, TILE) for b in batches for a in range(0, b.num_rows, TILE)):
            x = matrix(batch.column("w"), width).astype(float)
            a, d = nearest(x, (x * x).sum(axis=1), held.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("vec_id", "label", "w")), pa.array(a.astype(np.int64)), pa.array(d)], names=["vec_id", "label", "w", "cluster", "distance"])

    near = written(rows.mapInArrow(assigned, "vec_id long, label long, w array<long>, cluster long, distance double"), "assigned")
    sizes = {r["cluster"]: r for r in near.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # a row a cluster
    most = min(MOST_PART, max(LEAST_PART, n // (3 * spark.sparkContext.defaultParallelism) + 1))
    parts = np.array([-(-sizes[k]["n"] // most) if k in sizes else 0 for k in range(len(c))], np.int64)
    radii = np.array([sizes[k]["radius"] if k in sizes else 0.0 for k in range(len(c))])
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    lookup = F.array(*(F.lit(int(x)) for x in parts))
    start = F.array(*(F.lit(int(x)) for x in first))
    at = F.element_at(start, F.col("cluster").cast("int") + 1) + F.pmod(F.xxhash64("vec_id", "w"), F.element_at(lookup, F.col("cluster").cast("int") + 1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("rows").slice(k, 1).flatten()
                ids, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                order = np.lexsort((ids, labels))
                w = matrix(rows.field("w"), width)[order]
                one = [pa.array([batch.column("list")[k].as_py()], pa.int64()), pa.array([0], pa.int32()), pa.array([ids[order]], pa.list_(pa.int64())), pa.array([labels[order]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*one, pa.array([pack(w.ravel())], pa.binary()), pa.array([None], pa.binary())], names=["list", "kind", "ids", "labels", "weights", "queries"])

    lists = near.withColumn("list", at.cast("long")).groupBy("list").agg(F.collect_list(F.struct("vec_id", "label", "w")).alias("rows")).mapInArrow(packed, LISTED)
    return Index(written(lists, "lists"), c, radii, parts, first, width)


def visits(index: Index, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: list[np.ndarray], wanted: list[tuple], after: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and clusters of this wave, as two arrays. wanted: a query's windows as slices of lo and hi; kth: its k-th scores."""
    x = w.astype(float)
    mid, reach = x @ index.centroids.T, np.sqrt((x * x).sum(axis=1))[:, None] * index.radii
    slack = 1e-9 * (np.abs(mid) + reach) + 1e-6
    upper, lower = mid + reach + slack, mid - reach - slack
    order = np.argsort(-upper, axis=1, kind="stable")[:, after:upto]
    who, which = [], []
    for q in range(len(w)):
        c = order[q]
        a, b = wanted[q]
        u, v = upper[q, c], lower[q, c]
        # a window asks for a cluster that may hold a score inside it, unless its bound is strictly below the k-th score
        ask = ((u[:, None] >= lo[None, a:b]) & (v[:, None] <= hi[None, a:b]) & (u[:, None] >= kth[q][None, :])).any(axis=1)
        c = c[ask & (index.parts[c] > 0)]
        who.append(np.full(len(c), q))
        which.append(c)
    return np.concatenate(who), np.concatenate(which)


def scored(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products: by floats where they hold every partial sum exactly, else by integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(float) @ v.T.astype(float)).astype(np.int64) if most < 2**53 else q @ v.T


def leading(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, of equals the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search(queries: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """query_id, tag, vec_id, score: the k best rows of each of a query's windows, of its own label (same) or of others.
    queries: query_id, label, w, and of each window tags, lo and hi; ids are unique."""
    best, after = None, 0
    light = Index(None, index.centroids, index.radii, index.parts, index.first, index.width)
    held = queries.sparkSession.sparkContext.broadcast(light)
    width, sc = index.width, queries.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, min(int(index.parts.sum()), 20_000))

    def routed(after: int, upto: int):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = held.value
            for whole_batch in batches:
                for a in range(0, whole_batch.num_rows, QUERIES_AT_ONCE):
                    b = whole_batch.slice(a, QUERIES_AT_ONCE)
                    ids, labels, w = *(b.column(c).to_numpy(zero_copy_only=False) for c in ("query_id", "label")), matrix(b.column("w"), width)
                    tags, lo, hi, kth = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tags", "lo", "hi", "kth"))
                    ends = np.cumsum(b.column("tags").value_lengths().to_numpy(zero_copy_only=False))
                    spans = list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()))
                    who, which = visits(ix, w, lo, hi, [kth[s:e] for s, e in spans], spans, after, upto)
                    for c in np.unique(which):
                        mine = who[which == c]
                        n = np.array([spans[q][1] - spans[q][0] for q in mine])
                        at = np.concatenate([np.arange(*spans[q]) for q in mine])
                        sent = pack(ids[mine].astype(np.int64), labels[mine].astype(np.int64), w[mine].ravel(), n, tags[at].astype(np.int64), lo[at], hi[at], kth[at])
                        to = np.arange(ix.parts[c]) + ix.first[c]
                        none = [None] * len(to)
                        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([1] * len(to), pa.int32()), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.binary()), pa.array([sent] * len(to), pa.binary())], names=["list", "kind", "ids", "labels", "weights", "queries"])

        return f

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for r in range(batch.num_rows):
                here = batch.column("list")[r].as_py()
                if batch.column("kind")[r].as_py() == 0:
                    at, packed = here, batch.column("weights")[r].as_py()
                    ids, labels = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                    v = None  # unpacked for the first query
                elif at == here:
                    v = unpack(packed)[0].reshape(len(ids), width) if v is None else v
                    out = answers(unpack(batch.column("queries")[r].as_py()), ids, labels, v)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["query_id", "tag", "vec_id", "score"])

    def answers(sent: list[np.ndarray], ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> list[tuple]:
        qid, ql, qw, n, tags, lo, hi, kth = sent
        qw, out = qw.reshape(len(qid), width), []
        ends = np.cumsum(n)
        starts, least = ends - n, np.maximum(lo, kth)
        # of all a query's windows together: what no window can take is put aside for whole blocks of queries
        low, high = np.minimum.reduceat(least, starts), np.maximum.reduceat(hi, starts)
        for a in range(0, len(qid), 64):
            part = slice(a, a + 64)
            s = np.concatenate([scored(qw[part], v[t : t + TILE]) for t in range(0, len(v), TILE)], axis=1)
            fits = (s >= low[part, None]) & (s <= high[part, None]) & (ids != qid[part, None]) & ((labels == ql[part, None]) == same)
            for j in np.flatnonzero(fits.any(axis=1)):
                q, cols = a + j, np.flatnonzero(fits[j])
                mine = s[j][cols]
                for x in range(starts[q], ends[q]):
                    inside = cols[(mine >= least[x]) & (mine <= hi[x])]
                    top = inside[leading(s[j][inside], ids[inside], k)]
                    out.append((np.full(len(top), qid[q]), np.full(len(top), tags[x]), ids[top], s[j][top]))
        return out

    order = W.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    for upto in WAVES:
        if after >= len(index.centroids):
            break
        known = queries.withColumn("kth", F.transform("tags", lambda _: F.lit(NO_LEAST).cast("long")))
        if best is not None:
            last = best.filter(F.col("rank") == k).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("m"))
            known = queries.join(last, "query_id", "left").withColumn("kth", F.transform("tags", lambda t: F.coalesce(F.col("m")[t], F.lit(NO_LEAST).cast("long"))))
        sent = known.select(*(x.split()[0] for x in QUERY.split(", "))).mapInArrow(routed(after, upto), LISTED)
        both = index.lists.unionByName(sent).repartition(tasks, "list").sortWithinPartitions("list", "kind")
        found = both.mapInArrow(met, FOUND)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        after = upto
    return best


def labelled(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and integer components of the rows that take part."""
    return vectors.filter(whole() & F.col("vec_id").isNotNull() & label.isNotNull()).select("vec_id", label.cast("long").alias("label"), floored().alias("w"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are rows (vec_id, label, w); negatives score between
    the window's hundredths of the positive's score."""
    low, high = window
    index = build(rows)
    if index is None:
        none = rows.limit(0)
        long = lambda c: F.col("vec_id").alias(c)
        return none.select(long("anchor_id"), long("positive_id"), F.lit(0).alias("rank"), long("negative_id"), long("positive_score"), long("negative_score"))
    a = anchors.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "w")).alias("s")).select("query_id", "s.label", "s.w")
    a = written(a, "anchors")
    all_of = lambda x: F.array(F.lit(x).cast("long"))
    pos = search(a.select("*", F.array(F.lit(0)).alias("tags"), all_of(NO_LEAST).alias("lo"), all_of(NO_MOST).alias("hi")), index, positives, True)
    pos = written(pos.select("query_id", F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    s = F.col("positive_score")
    edges = pos.filter(s >= 0)  # below 0 a window ends before it begins
    edges = edges.withColumns({"lo": F.expr(f"(positive_score * {low} + 99) div 100"), "hi": F.expr(f"positive_score * {high} div 100")})
    windows = edges.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("tag", "lo", "hi"))).alias("x"))
    asked = a.join(windows, "query_id").select("query_id", "label", "w", F.col("x.tag").alias("tags"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    neg = search(written(asked, "windows"), index, negatives, False)
    out = neg.join(pos, ["query_id", "tag"])
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = written(labelled(table(spark, sf_dir, "embeddings"), label), "labelled")
    return mine(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = {
    "op12_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, 1 + len(a.w)), lambda i: a.w[i] * b.w[i]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
