"""Near-duplicate documents by circulant MinHash and exact Jaccard verification.

A document's set holds the 64-bit hashes of its distinct shingles. Two permutations of the 32-bit universe make
all coordinates of the signature: one breaks the order of the hashes, the other, circularly shifted by one more step for
each coordinate, is minimised over the set. Coordinates are banded; documents that share a band are candidates. A pair at
the threshold is missed with probability (1 - 0.8**4)**28 < 4e-7.

Documents of equal sets form a class, and only classes go on. Candidates are never expanded to all pairs of a band's
bucket at once: classes first meet their bucket's least class, links found join components, and only classes of one
bucket that are still in different components, and whose sizes allow the threshold, meet one another. Every link is
confirmed on full sets.

Cases. Null text or no words: empty set, linked with nothing, not even with a row of its id. Fewer words than a shingle: the
whole sequence is one shingle. Null doc_id: no document to name, left out of components (component_id null, kept). Repeated
ids: the texts of one id are linked, so all get one component. Ties: the least id names and represents a component. Very long
texts: their whole sets count. Empty table: empty result. Extra columns, of any name: ignored by `components`, kept by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, broadcast_if_small, byte_words, mix64, shuffled_joins, table, written


@dataclass(frozen=True)
class Near:
    shingle: int = 4
    bands: int = 28
    rows: int = 4
    percent: int = 80


PRODUCTION = Near()
#: Classes that a task compares with as many others at once.
CHUNK = 128
#: Rows of a table that may be broadcast: some MB of the driver's memory, whatever the corpus.
SMALL = 20_000
#: Odd step of the circular shift.
SHIFT = np.uint32(0x9E3779B1)


def shingle_sets(texts: list[str | None], n: int, hashes: Hashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    ws = [byte_words(t) for t in texts]
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    h = hashes.of([w for x in ws for w in x])
    ends = np.cumsum(lengths)
    out = []
    rolled = h.copy()  # rolled[i]: of the n words from i on
    for k in range(1, n):
        rolled = mix64(rolled * np.uint64(3) + np.uint64(k))
        rolled[: max(0, len(h) - k)] += h[k:]
    rolled = mix64(rolled)
    for e, m in zip(ends, lengths):
        if m >= n:
            out.append(np.unique(rolled[e - m : e - n + 1]))
        elif m:  # all words, and how many
            x = np.uint64(m)
            for w in h[e - m : e]:
                x = mix64(np.array([x], np.uint64) * np.uint64(3) + w)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def band_keys(sets: list[np.ndarray], p: Near) -> np.ndarray:
    """64-bit keys of the bands, a row for each (non-empty) set."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    start = np.cumsum(lengths) - lengths
    # the first permutation, of the universe to which the hashes are folded
    base = permuted((flat ^ (flat >> np.uint64(32))).astype(np.uint32) * np.uint32(0x2C1B3C6D) + np.uint32(0x297A2D39))
    keys = np.empty((len(sets), p.bands), np.uint64)
    for b in range(p.bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(p.rows):
            k = b * p.rows + r
            least = np.minimum.reduceat(permuted(base + np.uint32(k * int(SHIFT) & 0xFFFFFFFF)), start)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        keys[:, b] = key
    return keys


def features(docs: DataFrame, p: Near) -> DataFrame:
    """doc_id, n_shingles, node (64 bits of the set, which name its class; null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = shingle_sets(batch.column(1).to_pylist(), p.shingle, hashes)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, band_keys([sets[i] for i in full], p).view(np.int64)):
                        bands[i] = k
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(node_of, sets), pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long, bands array<long>")


def node_of(s: np.ndarray) -> int | None:
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) * np.uint64(3) + np.uint64(len(s))]))[0].astype(np.int64))


def sets_of(docs: DataFrame, nodes: DataFrame, p: Near, repeated: bool) -> DataFrame:
    """node, set (packed) of the classes that nodes names by node and rep, a document of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = shingle_sets(batch.column(0).to_pylist(), p.shingle, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets])], names=["node", "set"])

    nodes = nodes.select("node", "rep")
    near = broadcast_if_small(nodes, nodes.count(), SMALL)
    picked = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(near, "rep", "left_semi").select("text").mapInArrow(run, "node long, set binary")
    if repeated:  # other texts of the id, and more rows of the same text, are not wanted
        picked = picked.join(near, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))
    return picked


def confirmed(pairs: DataFrame, sets: DataFrame, p: Near) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * same >= p.percent * (len(x) + len(y) - same)
            t = pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(ok))
            yield from t.to_batches()

    j = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return j.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component that the edges (a, b) make. Distributed: each step joins every node's
    label with the least label of its neighbours, and then follows labels to labels, so steps grow with the logarithm."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("l"))
        # a label that a neighbour improves is told to the label itself too
        new = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("l"))
        hook = new.filter("l < label").select(F.col("label").alias("node"), "l").groupBy("node").agg(F.min("l").alias("h"))
        new = new.join(hook, "node", "left").select("node", "label", F.least("l", F.coalesce("h", "l")).alias("new"))
        new = written(new, "labels")
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("j"))
        nxt = written(new.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("j", "new")).alias("to")), "labels")
        if nxt.filter("to < label").limit(1).count() == 0:
            return nxt.select("node", F.col("to").alias("label"))
        labels = nxt.select("node", F.col("to").alias("label"))


def class_links(docs: DataFrame, members: DataFrame, p: Near, repeated: bool = False) -> DataFrame:
    """Links (a, b) between classes that connect every pair of classes joined by a chain of links.
    members: bucket, node, n, rep."""
    size_ok = lambda x, y: (100 * F.least(x, y) >= p.percent * F.greatest(x, y))
    buckets = members.groupBy("bucket").agg(F.min(F.struct("rep", "node", "n")).alias("c"), F.count("*").alias("k")).filter("k > 1")
    shared = written(members.join(buckets.select("bucket", "c"), "bucket"), "buckets")
    nodes = written(shared.select("node", "rep").distinct(), "nodes")
    sets = written(sets_of(docs, nodes, p, repeated), "sets")
    # each class meets the least class of one bucket, then those of all, then what is left
    star = shared.filter((F.col("node") != F.col("c.node")) & size_ok(F.col("n"), F.col("c.n"))).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    star = written(star, "star")
    links = written(confirmed(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, p), "links")
    labels = connected(links)

    def label(df: DataFrame, at: str) -> DataFrame:
        lab = labels.toDF(at, f"l_{at}")
        return df.join(lab, at, "left").withColumn(f"l_{at}", F.coalesce(f"l_{at}", at))

    more = label(label(star, "a"), "b").filter("l_a <> l_b").select("a", "b")
    links = written(links.union(confirmed(more, sets, p)), "links")
    labels = connected(links)
    m = written(still_open(label(shared.select("bucket", "node", "n"), "node").withColumnRenamed("l_node", "l")), "open")
    # shingles that no other class still open holds are in no intersection: q is what a class can share
    rest = written(m.groupBy("node").agg(F.max("n").alias("n")), "rest")
    alone = shingles(sets.join(rest, "node", "left_semi")).groupBy("shingle").agg(F.count("*").alias("k"), F.max("node").alias("node")).filter("k = 1")
    q = rest.join(alone.groupBy("node").agg(F.count("*").alias("p")), "node", "left").select("node", (F.col("n") - F.coalesce("p", F.lit(0))).alias("q"))
    m = written(still_open(m.join(q, "node").filter(100 * F.col("q") >= p.percent * F.col("n"))), "open")
    near = m.groupBy("bucket").agg(F.min("node").alias("a")).join(m.select("bucket", F.col("node").alias("b")), "bucket")
    groups = connected(near.select("a", "b").distinct()).withColumnRenamed("label", "group")
    m = written(m.select("node", "l", "n").distinct().join(groups, "node"), "open")
    # classes outside their group's main component meet all of the group, chunk by chunk
    k = m.groupBy("group", "l").agg(F.count("*").alias("k")).groupBy("group").agg(F.max_by("l", F.struct("k", "l")).alias("main"), F.sum("k").alias("all"))
    k = written(k.select("group", "main", (F.floor(F.col("all") / CHUNK) + 1).alias("chunks")), "groups")
    m = spread_join(m, k, "group").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).join(sets, "node")
    chunks = lambda df, name: df.groupBy("group", "chunk").agg(F.max("chunks").alias("chunks"), F.collect_list(F.struct("node", "l", "set")).alias(name))
    x = chunks(m.filter("l <> main"), "x").select("group", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), "x")
    met = x.join(chunks(m, "y"), ["group", "chunk"]).select("x", "y")
    return links.union(met.mapInArrow(lambda batches: across(batches, p.percent), "a long, b long"))


def spread_join(df: DataFrame, dim: DataFrame, key: str, shares: int = 1000) -> DataFrame:
    """df joined with dim, of one row a key. A small dim goes to all tasks. Of a larger one only the rows of hot keys do, which hold more than
    one in shares of df's rows each, so that there are at most shares of them; the rest meets by key."""
    if dim.count() <= SMALL:
        return df.join(F.broadcast(dim), key)
    least = max(df.count() // shares, 100)
    hot = [r[0] for r in df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key).collect()]
    if not hot:
        return df.join(dim.hint("merge"), key)
    is_hot = F.col(key).isin(hot)
    return df.filter(~is_hot).join(dim.filter(~is_hot).hint("merge"), key).unionByName(df.filter(is_hot).join(F.broadcast(dim.filter(is_hot)), key))


def across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the classes of two chunks that are in different components."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for name in ("x", "y"):
                rows = batch.column(name).slice(i, 1).flatten()
                sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.field("set")]
                sides.append((rows.field("node").to_numpy(), rows.field("l").to_numpy(), np.array([len(v) for v in sets]), np.concatenate(sets)))
            (xn, xl, xk, xs), (yn, yl, yk, ys) = sides
            common = np.intersect1d(xs, ys)
            owner = [np.repeat(np.arange(len(k)), k) for k in (xk, yk)]
            same = np.zeros((len(xn), len(yn)))
            for at in range(0, len(common), 8192):
                part, dense = common[at : at + 8192], []
                for own, flat, n in ((owner[0], xs, len(xn)), (owner[1], ys, len(yn))):
                    where = np.minimum(np.searchsorted(part, flat), len(part) - 1)
                    hit = part[where] == flat
                    held = np.zeros((n, len(part)), np.float32)
                    held[own[hit], where[hit]] = 1
                    dense.append(held)
                same += dense[0] @ dense[1].T
            linked = (100 * same >= percent * (xk[:, None] + yk[None, :] - same)) & (xl[:, None] != yl[None, :])
            a, b = np.nonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(xn[a], yn[b])), pa.array(np.maximum(xn[a], yn[b]))], names=["a", "b"])


def still_open(m: DataFrame) -> DataFrame:
    """The members of buckets that hold classes of different components (l)."""
    return m.join(m.groupBy("bucket").agg(F.min("l").alias("x"), F.max("l").alias("y")).filter("x < y").select("bucket"), "bucket", "left_semi")


def shingles(sets: DataFrame) -> DataFrame:
    """shingle, node: a row for each element of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("set")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(flat)), pa.array(np.repeat(part.column("node").to_numpy(), [len(x) for x in flat]))], names=["shingle", "node"])

    return sets.select("node", "set").mapInArrow(run, "shingle long, node long")


def components(docs: DataFrame, p: Near = PRODUCTION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    with shuffled_joins(docs.sparkSession):
        return _components(docs, p)


def _components(docs: DataFrame, p: Near) -> DataFrame:
    f = written(features(docs, p), "features")
    named = f.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.max("bands").alias("bands")), "classes")
    # an id of several texts links their classes
    ids = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("k")).filter("k > 1")
    ids = written(ids.select("doc_id", "a", "b"), "ids")
    more = named.select("doc_id", F.col("node").alias("b")).join(ids.filter("a < b").select("doc_id", "a"), "doc_id").filter("a < b").select("a", "b")
    members = classes.select(F.explode("bands").alias("bucket"), "node", "n", "rep")
    labels = connected(class_links(docs, members, p, not ids.isEmpty()).union(more.distinct()))
    to = written(classes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")), "members")
    least = to.groupBy("label").agg(F.min("rep").alias("component"))
    to = written(spread_join(to, written(least, "least"), "label").select("node", "component"), "components")
    # a class of very many copies is dealt to many tasks
    lone = f.filter("node IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = spread_join(named.select("doc_id", "n_shingles", "node"), to, "node").select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(lone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def filter_documents(docs: DataFrame, p: Near = PRODUCTION) -> DataFrame:
    """docs without those that a document of a lesser id links to; one of each component stays. Of rows with one id all stay or
    go together."""
    gone = written(components(docs, p).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    d = docs.select(F.struct(*docs.columns).alias("doc"))
    return d.join(broadcast_if_small(gone, gone.count(), SMALL), F.col("doc.doc_id").cast("long") == gone["gone"], "left_anti").select("doc.*")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
SQL: dict = {}
