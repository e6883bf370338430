"""Ranks, row numbers and percentiles without a task that sees a whole group.

Equal values are counted first, so that copies combine before they are shuffled. The distinct values are range-partitioned
by group and value and written with the number of their partition, their block. A row's place is then what stands before its
block in the group, a prefix sum of one row a block, and what stands before it inside the block. A hot group lies over many
blocks; rows of one value never part, so that ties need no joining over borders.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.sources.shared import stored


def steady(c: Column) -> Column:
    """A sum or mean of doubles to 12 places, for comparisons alone. Its last bits are those of the order in which its rows came; a mean of
    exactly 1 must reach a bound of 1 in every order. What is shown is not rounded twice."""
    return F.round(c, 12)


def in_blocks(df: DataFrame, *order: Column | str) -> DataFrame:
    """df range-partitioned in this order and written, with its partition as _block."""
    return stored(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))


def before_blocks(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows (keys, _block, n) with _before, the sum of n over the group's earlier blocks. The rows of the sums are at most one a
    block and one a group; without keys the driver adds them up, one number a block."""
    sums = rows.groupBy(*keys, "_block").agg(F.sum(n).cast("long").alias("_s"))
    if keys:
        places = sums.select(*keys, "_block", (F.sum("_s").over(W.partitionBy(*keys).orderBy("_block")) - F.col("_s")).alias("_before"))
        same = [rows[k].eqNullSafe(places[k]) for k in (*keys, "_block")]
        return rows.join(places, same).drop(*(places[k] for k in (*keys, "_block")))
    got = sorted((r["_block"], r["_s"]) for r in sums.collect())
    places = list(zip((b for b, _ in got), accumulate((s for _, s in got), initial=0)))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(places, "_block int, _before long")), "_block")


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with row numbers from 1 in a stated order, which should leave no ties: rows of one place lie in one task."""
    d = in_blocks(df, *order)
    d = before_blocks(d.withColumn("_one", F.lit(1)), [], "_one")
    by = W.partitionBy("_block").orderBy(*order)
    return d.withColumn(name, F.col("_before") + F.row_number().over(by)).drop("_block", "_before", "_one")


def distribution(df: DataFrame, keys: list[str], value: str, **counts: Column) -> DataFrame:
    """keys, value, n, below of each different value of a group: rows that have it and rows that have less. counts name further
    sums. Null values have no place."""
    d = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in counts.items()))
    d = before_blocks(in_blocks(d, *keys, value), keys, "n")
    inside = F.sum("n").over(W.partitionBy(*keys, "_block").orderBy(value)) - F.col("n")
    return d.select(*keys, value, "n", *counts, (F.col("_before") + inside).alias("below"))


def mean_rank() -> Column:
    """The ascending rank that rows of a distribution share, from 1."""
    return F.col("below") + (F.col("n") + 1) / 2.0


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with ascending ranks inside keys, ties sharing their mean; null for null values."""
    places = distribution(df, keys, value).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).alias("_v"), mean_rank().alias(name))
    same = F.col(value) == F.col("_v")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(places, same, "left").drop("_v", *(f"_k{i}" for i in range(len(keys))))


def rank_sums(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """keys, n_pos, n_neg, r, ties of a 0/1 label: its counts, the sum of the ranks of the ones by score, and the sum of t^3 - t over
    tied groups. No row goes back to its rank."""
    d = distribution(df.filter(F.col(label).isNotNull()), keys, score, pos=F.col(label).cast("long"))
    n = F.col("n").cast("double")
    return d.groupBy(*keys).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).cast("long").alias("n_pos"), F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).cast("long").alias("n_neg"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * mean_rank())).alias("r"), F.coalesce(F.sum(n * n * n - n), F.lit(0.0)).alias("ties"),
    )


def percentiles(df: DataFrame, keys: list[str], value: str, **at: Column) -> DataFrame:
    """keys and the percentiles of value that the columns name: exact, linear between neighbours. A share may depend on keys and on
    `total`, the number of the group's rows that have a value; a group without any has no row."""
    d = distribution(df, keys, value)
    total = d.groupBy(*keys).agg(F.sum("n").cast("long").alias("total"))
    total = total.select(*keys, *(((F.col("total") - 1) * share).alias(f"_h_{name}") for name, share in at.items()))
    if keys:
        d = d.join(total, [d[k].eqNullSafe(total[k]) for k in keys]).drop(*(total[k] for k in keys))
    else:
        d = d.crossJoin(F.broadcast(total))
    aggs = []
    for name in at:
        h = f"_h_{name}"
        for end, place in (("a", F.floor(h)), ("b", F.ceil(h))):
            has = (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(has, F.col(value).cast("double"))).alias(f"_{end}_{name}"))
        aggs.append(F.max(h).alias(h))
    s = d.groupBy(*keys).agg(*aggs)
    return s.select(*keys, *((F.col(f"_a_{x}") + (F.col(f"_b_{x}") - F.col(f"_a_{x}")) * (F.col(f"_h_{x}") - F.floor(f"_h_{x}"))).alias(x) for x in at))
