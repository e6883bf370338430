"""Titles: terms that lift a part of a field over the rest, and topics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.operators.iteration import fixed_plans
from quillgraph.sources.shared import cut, stored


def term_rows(docs: DataFrame, stop: set[str], bigrams: bool = True) -> DataFrame:
    """group, doc, term, tf. Words of two or more word characters, lower case, stop words out before pairs are formed."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\b\w\w+\b)"), 1), lambda x: ~x.isin(*sorted(stop)) if stop else F.lit(True))
    d = docs.select("group", "doc", w.alias("w"))
    terms = F.col("w")
    if bigrams:
        pairs = F.expr("CASE WHEN size(w) > 1 THEN transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) ELSE array() END")
        terms = F.concat(F.col("w"), pairs)
    return d.select("group", "doc", F.explode(terms).alias("term")).groupBy("group", "doc", "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, stop: set[str] = frozenset(), min_df: int = 2, max_df: float = 0.95, bigrams: bool = True) -> DataFrame:
    """group, doc, term, w: sublinear tf times smoothed idf, each document of length 1."""
    t = term_rows(docs, set(stop), bigrams)
    n = docs.groupBy("group").agg(F.count("*").alias("n"))
    df = t.groupBy("group", "term").agg(F.count("*").alias("df")).join(n, "group").filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    t = t.join(df, ["group", "term"]).withColumn("w", (1 + F.log("tf")) * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1))
    return t.select("group", "doc", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("group", "doc")))).alias("w"))


def lift(docs: DataFrame, top: int, least: int = 10, **options) -> DataFrame:
    """The top terms of each group by lift of documents `inside` over the others, where both have enough documents."""
    flag = F.coalesce("inside", F.lit(False))
    n = docs.groupBy("group").agg(F.count(F.when(flag, 1)).alias("n_in"), F.count(F.when(~flag, 1)).alias("n_out")).filter((F.col("n_in") >= least) & (F.col("n_out") >= least))
    w = tfidf(docs.join(n.select("group"), "group", "left_semi"), **options).join(docs.select("group", "doc", flag.alias("inside")), ["group", "doc"])
    s = w.groupBy("group", "term").agg(F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("inside"), 0.0).otherwise(F.col("w"))).alias("b")).join(n, "group")
    s = s.withColumns({"mean_enc": F.col("a") / F.col("n_in"), "mean_non": F.col("b") / F.col("n_out")})
    s = s.withColumn("lift", F.col("mean_enc") / (F.col("mean_non") + 1e-9)).withColumn("score", F.col("lift") * F.col("mean_enc"))
    by = W.partitionBy("group").orderBy(F.desc(F.round("score", 9)), "term")
    return s.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select("group", "term", "mean_enc", "mean_non", "lift", "score", "rank")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _start(*parts: str, k: Column) -> Column:
    """k numbers in (0, 1] that hang on the row's key alone."""
    return F.transform(F.sequence(F.lit(1), k), lambda i: (F.pmod(F.xxhash64(*parts, i), F.lit(1 << 20)) + 1) / float(1 << 20))


def _gram(factor: DataFrame, x: str) -> DataFrame:
    """group, g: the k x k products of a factor's columns, summed over its rows, as rows of a matrix."""
    pairs = F.posexplode(F.flatten(F.transform(x, lambda p: F.transform(x, lambda q: p * q))))
    d = factor.select("group", F.size(x).alias("k"), pairs.alias("at", "v")).groupBy("group", "k", "at").agg(F.sum("v").alias("v"))
    flat = d.groupBy("group", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("f"))
    return flat.select("group", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.slice("f", i * F.col("k") + 1, F.col("k"))).alias("g"))


def _products(weights: DataFrame, factor: DataFrame, on: str, by: str, x: str, most: int) -> DataFrame:
    """group, by, p: each row of weights times the other factor. Sums combine before the shuffle."""
    j = weights.join(factor, ["group", on]).select("group", by, *((F.col("w") * F.get(x, F.lit(i))).alias(f"_{i}") for i in range(most)))
    d = j.groupBy("group", by).agg(*(F.sum(f"_{i}").alias(f"_{i}") for i in range(most)))
    return d.select("group", by, F.filter(F.array(*(f"_{i}" for i in range(most))), lambda v: v.isNotNull()).alias("p"))


def _descent(passes: int):
    """A function of a factor's row x, products p and gram g (its rows end to end): the row after some passes over its columns, each set to
    its best non-negative value. Rows of a batch step together; sums run in the order of columns."""

    def dense(rows: pa.ListArray, shape: tuple[int, ...], keep: np.ndarray) -> np.ndarray:
        """Rows of lists as one array, the row's number last; where a list is shorter there are zeros."""
        out = np.zeros((len(rows), *shape))
        out[keep] = rows.flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(np.moveaxis(out, 0, -1))

    @F.arrow_udf("array<double>")
    def step(x: pa.Array, p: pa.Array, g: pa.Array) -> pa.Array:
        size = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        k = int(size.max(initial=0))
        keep = np.arange(k) < size[:, None]
        gram = dense(g, (k, k), keep[:, :, None] & keep[:, None, :])
        row, want = dense(x, (k,), keep), dense(p, (k,), keep)
        for j in [*range(k)] * passes:
            own, dot = gram[j, j], np.zeros(len(size))
            for i in range(k):
                dot += row[i] * gram[j, i]
            best = np.maximum(0.0, row[j] + np.divide(want[j] - dot, own, out=np.zeros(len(size)), where=own > 0))
            row[j] = np.where(own > 0, best, row[j])
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(row.T[keep]))

    return step


@dataclass(frozen=True)
class Topics:
    """least: documents of a group, below which it has no topics; a topic per `each` documents, 2 to `most`; sweeps end when no
    group's squared error falls by more than tol of it, or after `sweeps`."""

    least: int = 30
    each: int = 20
    most: int = 10
    sweeps: int = 12
    tol: float = 1e-3
    passes: int = 3  # of a row over its columns in a half sweep: these need no join
    together: int = 2  # sweeps between two looks at the error


def factors(weights: DataFrame, c: Topics = Topics()) -> tuple[DataFrame, DataFrame]:
    """The non-negative factors of each group's document-term weights: (group, doc, a) and (group, term, b).

    Rows of either factor are updated in turn by coordinate descent from the rows of weights times the other factor, one join and
    one sum, and from that factor's k x k gram matrix, the only thing that all rows of a group share. A group may be of any size.
    Weights lie in memory and (group, doc, a) in the shared folder, both partitioned by document, so that a sweep shuffles sums and a, not weights.
    """
    spark = weights.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = stored(weights.select("group", "doc", "term", F.col("w").cast("double").alias("w")))
    with fixed_plans(spark):  # partitions that a plan may still change are not kept
        w = w.repartition(n, "group", "doc").sortWithinPartitions("group", "doc").persist()
    docs = w.select("group", "doc").distinct().groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") >= c.least)
    k = F.least(F.lit(c.most), F.greatest(F.lit(2), F.floor(F.col("n") / c.each))).cast("int")
    docs = F.broadcast(stored(docs.select("group", k.alias("k"))))
    with fixed_plans(spark):
        a = cut(w.select("group", "doc").distinct().join(docs, "group").select("group", "doc", _start("group", "doc", k=F.col("k")).alias("a")))
    b = stored(w.select("group", "term").distinct().join(docs, "group").select("group", "term", _start("group", "term", k=F.col("k")).alias("b")))
    few = b.count() <= 200_000
    whole = {r["group"]: r["s"] for r in w.groupBy("group").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()}
    descent = _descent(c.passes)
    before: dict = {}
    for done in range(0, c.sweeps, c.together):
        for _ in range(min(c.together, c.sweeps - done)):
            p = _products(w, F.broadcast(b) if few else b, "term", "doc", "b", c.most).join(F.broadcast(_gram(b, "b")), "group")
            with fixed_plans(spark):
                a = cut(p.join(a, ["group", "doc"]).select("group", "doc", descent("a", "p", F.flatten("g")).alias("a")).repartition(n, "group", "doc"))
            p = _products(w, a, "doc", "term", "a", c.most).join(F.broadcast(_gram(a, "a")), "group")
            full = stored(p.join(b, ["group", "term"]).select("group", "term", "p", "g", descent("b", "p", F.flatten("g")).alias("b")))
            b = full.select("group", "term", "b")
        # |W - AB|^2 from the products of the last half step, one number a group
        turned = F.transform("g", lambda r: _dot(F.col("b"), r))
        fit = full.select("group", (_dot(F.col("b"), turned) - 2 * _dot(F.col("b"), F.col("p"))).alias("e"))
        error = {r["group"]: whole[r["group"]] + r["e"] for r in fit.groupBy("group").agg(F.sum("e").alias("e")).collect()}
        if before and all(before[g] - e <= c.tol * whole[g] for g, e in error.items()):
            break
        before = error
    w.unpersist()
    return a, b


def nmf(weights: DataFrame, c: Topics = Topics()) -> DataFrame:
    """group, doc, topic, label: topics of each group's documents by size, from 0, each document in its heaviest; a label is a topic's five
    heaviest terms. The start hangs on hashes of keys, so that runs agree; topics are not canonical. Ties: the lesser topic or term."""
    a, b = factors(weights, c)
    best = F.array_position("a", F.array_max("a")).cast("int") - 1
    d = stored(a.select("group", "doc", best.alias("t")))
    size = d.groupBy("group", "t").agg(F.count("*").alias("n"))
    place = size.withColumn("topic", F.row_number().over(W.partitionBy("group").orderBy(F.desc("n"), "t")) - 1)
    heavy = b.select("group", "term", F.posexplode("b").alias("t", "x")).withColumn("r", F.row_number().over(W.partitionBy("group", "t").orderBy(F.desc("x"), "term"))).filter("r <= 5")
    label = heavy.groupBy("group", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda e: e["term"]), ", ").alias("label"))
    named = place.join(label, ["group", "t"]).select("group", "t", "topic", "label")
    return d.join(F.broadcast(named), ["group", "t"]).select("group", "doc", "topic", "label")
