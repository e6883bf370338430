"""Mixing sources to target weights by a time-varying curriculum.

Sources in order of their code points (null last) get the weights 5, 2, 1, repeating, and share a budget of words: all
words of the input. A source's target stops at 3 times its words; the excess goes to the others by weight until none is
above (the water level of a sorted prefix sum, no iteration). Each source also has a schedule, a piecewise linear weight
over training time 0 to 1. Its integral, scaled to the target, is the source's cumulative demand; inverting it at a
document's offset in the source's stream gives the training time at which the document comes. Documents are
range-sorted by that time. A source's stream repeats its documents, in an order of hashed ids and texts, until its target.

Offsets in a source are prefix sums over hash buckets, so that no source is ordered in one task: sums of buckets are
scanned first, then rows inside each bucket.

Cases. Null text: size 0, taken 0. Null source: a source of its own, last. Null or equal ids: ordered by their texts. Repeated
rows: each is a document. Ties: of two sources the lesser name is filled first; of documents with one key the shorter comes first.
Very long text: one document, whatever its size. Empty table: empty result. Extra columns, of any name: kept by `mix_documents`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if_small, table, words, written


@dataclass(frozen=True)
class Curriculum:
    weights: tuple = (5, 2, 1)
    most: int = 3
    #: for each weight, knots (time, relative weight) of its schedule: early, even, late
    schedules: tuple = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
    bucket_rows: int = 20_000


PRODUCTION = Curriculum()


def segments(knots: tuple) -> list[tuple[float, float, float, float]]:
    """Start time, weight at start, slope and share of demand before it, of each linear piece; all demand is 1."""
    total = sum((t2 - t1) * (w1 + w2) / 2 for (t1, w1), (t2, w2) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t1, w1), (t2, w2) in zip(knots, knots[1:]):
        out.append((t1, w1 / total, (w2 - w1) / (t2 - t1) / total, before))
        before += (t2 - t1) * (w1 + w2) / 2 / total
    return out


def time_of(share: Column, kind: Column, c: Curriculum) -> Column:
    """Inverts the cumulative demand: the time at which this share of a source's target has been taken."""

    def piece(t: float, w: float, slope: float, before: float) -> Column:
        u = share - F.lit(before)
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * u, F.lit(0.0)))
        return F.lit(t) + F.when(root > 0, 2 * u / F.when(root > 0, root)).otherwise(F.lit(0.0))

    out = None
    for k, knots in enumerate(c.schedules):
        pieces = segments(knots)
        e = piece(*pieces[0])
        for p in pieces[1:]:
            e = F.when(share >= F.lit(p[3]), piece(*p)).otherwise(e)
        out = F.when(kind == k, e) if out is None else out.when(kind == k, e)
    return out


def targets(sizes: DataFrame, c: Curriculum = PRODUCTION) -> DataFrame:
    """source_, kind (which weight), source_size and target of each source. One row a source from here on."""
    s = sizes.groupBy("source_").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("kind", (F.row_number().over(W.orderBy(F.col("source_").asc_nulls_last())) - 1) % len(c.weights))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(x).cast("long") for x in c.weights)), F.col("kind") + 1))
    s = s.withColumn("cap", c.most * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source_").asc_nulls_last())
    s = s.withColumns({
        "all": F.sum("source_size").over(W.partitionBy()), "weights": F.sum("weight").over(W.partitionBy()),
        "capped": F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "passed": F.coalesce(F.sum("weight").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    s = s.withColumn("level", (F.col("all") - F.col("capped")).cast("double") / (F.col("weights") - F.col("passed")))
    # the first source, by cap over weight, that the level doesn't fill to its cap sets the level of all after it
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy())["level"])
    return s.select("source_", "kind", "source_size", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def key_of(doc_id: Column, text: Column) -> Column:
    """The hash whose order is that of a source's stream; rows that share an id, or have none, part by their text."""
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat(plain(doc_id), F.lit("|"), F.md5(plain(text).cast("binary"))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source_, size and key of each document, written: the texts are read once for all that follows."""
    size = F.size(words(F.col("text"))).cast("long")
    return written(docs.select("doc_id", F.col("source").alias("source_"), size.alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key")), "sizes")


def bucket_sums(small: DataFrame, goals: DataFrame, c: Curriculum) -> tuple[DataFrame, int]:
    """source__, bucket_, the words of the source before and in the bucket, and the source's goals; and the key digits that
    make a bucket. There are 65,536 buckets a source at most."""
    digits = min(4, max(1, math.ceil(math.log(max(small.count(), 1) / c.bucket_rows + 1, 16))))
    sums = small.groupBy("source_", F.substring("key", 1, digits).alias("bucket_")).agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn("before", F.sum("bucket_size").over(W.partitionBy("source_").orderBy("bucket_")) - F.col("bucket_size"))
    g = goals.withColumnRenamed("source_", "source__")
    sums = sums.join(g, sums["source_"].eqNullSafe(g["source__"])).drop("source__").withColumnRenamed("source_", "source__")
    sums = sums.withColumn("goal", F.floor(F.col("target") + 0.5))
    passes = F.when(F.col("source_size") > 0, F.expr("goal div nullif(source_size, 0)")).otherwise(F.lit(0)).cast("long")
    return written(sums.withColumn("passes", passes), "buckets"), digits


def located(d: DataFrame, sums: DataFrame, digits: int) -> DataFrame:
    """d (source_, key) with its bucket's columns. The sums are broadcast only where a count allows it."""
    d, sums = d.withColumn("bucket", F.substring("key", 1, digits)), broadcast_if_small(sums, sums.count())
    return d.join(sums, d["source_"].eqNullSafe(sums["source__"]) & (d["bucket"] == sums["bucket_"]))


def planned(small: DataFrame, whole: bool, c: Curriculum = PRODUCTION) -> tuple[DataFrame, DataFrame, int]:
    """small with source_size, target, kind, goal (whole words), offset in a pass, passes and taken; the buckets, and their digits."""
    sums, digits = bucket_sums(small, written(targets(small, c), "targets"), c)
    d = located(small, sums, digits)
    by = W.partitionBy("source_", "bucket").orderBy("key", "size")
    d = d.withColumn("offset", F.col("before") + F.sum("size").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    left = F.greatest(F.least(F.col("goal") - F.col("passes") * F.col("source_size") - F.col("offset"), F.col("size")), F.lit(0).cast("long"))
    if whole:  # the one document of each source at the end of its stream is taken if half of it fits
        left = F.when((left > 0) & (2 * left >= F.col("size")), F.col("size")).otherwise(F.lit(0).cast("long"))
        same = W.partitionBy("source_", "bucket", "key")
        d = d.withColumns({"nth": F.row_number().over(same.orderBy("size")), "same": F.count("*").over(same)})
    return d.withColumn("last", left).withColumn("taken", F.col("passes") * F.col("size") + F.col("last")), sums, digits


def position(n: Column, c: Curriculum = PRODUCTION) -> Column:
    """Training time of the n-th pass (from 0) over a planned document."""
    share = F.when(F.col("goal") > 0, (n * F.col("source_size") + F.col("offset")).cast("double") / F.when(F.col("goal") > 0, F.col("goal")))
    return time_of(F.least(share, F.lit(1.0)), F.col("kind"), c)


def mix(docs: DataFrame, c: Curriculum = PRODUCTION) -> DataFrame:
    """The plan of the mix: one row a document, sorted by the time at which it first comes, those never taken last.

    A source's stream ends exactly at its target; at most one document a source is taken in part in its last pass.
    """
    d, _, _ = planned(sized(docs), False, c)
    d = d.withColumn("position", F.when(F.col("taken") > 0, position(F.lit(0), c)))
    d = d.select("doc_id", "size", "source_size", "target", "taken", "position")
    return d.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def numbered(d: DataFrame) -> DataFrame:
    """d with nth, numbers from 1 inside a source: rows are written with the task that wrote them, and numbered inside each task's rows
    after all earlier tasks' ones, so that copies of one text, however many, stay spread."""
    d = written(d.withColumn("part", F.spark_partition_id()), "copies")
    n = d.groupBy(F.col("source_").alias("of"), F.col("part").alias("of_part")).agg(F.count("*").alias("n"))
    n = written(n.select("of", "of_part", (F.sum("n").over(W.partitionBy("of").orderBy("of_part")) - F.col("n")).alias("earlier")), "copies")
    d = d.join(broadcast_if_small(n, n.count()), d["source_"].eqNullSafe(n["of"]) & (d["part"] == n["of_part"]))
    place = F.row_number().over(W.partitionBy("source_", "part").orderBy("key"))
    return d.withColumn("nth", F.col("earlier") + place).drop("of", "of_part", "earlier", "part")


def mix_documents(docs: DataFrame, c: Curriculum = PRODUCTION) -> DataFrame:
    """The mix itself: rows of docs, whole, once for each time they are taken, range-sorted by training time.

    Whole rows pass one shuffle, that of the sort. What they need for it is known before: their key, the sums of its bucket, and
    the last key that the source's last pass takes. Inside a bucket the offset is read off the key, as hashes are even; a
    source's documents keep the order of `mix`. Of rows equal in id and text the last pass takes as many as the target asks for;
    which of them is not fixed, should they differ in other columns.
    """
    plan, sums, digits = planned(sized(docs), True, c)
    # the last key of the last pass, the rows of it that are taken, and all that have it
    ends = plan.filter("last > 0").groupBy("source__").agg(F.max(F.struct("key", "nth", "same")).alias("e"))
    ends = written(ends.select(F.col("source__").alias("source___"), F.col("e.key").alias("end_key"), F.col("e.nth").alias("copies"), (F.col("e.same") > F.col("e.nth")).alias("parted")), "ends")
    sums = written(sums.join(ends, sums["source__"].eqNullSafe(ends["source___"]), "left").drop("source___"), "buckets")
    # a document of no words is in no pass
    d = docs.select(F.struct(*docs.columns).alias("doc")).filter(F.coalesce(F.col("doc.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    d = located(d.select("doc", F.col("doc.source").alias("source_"), key_of(F.col("doc.doc_id"), F.col("doc.text")).alias("key")), sums, digits)
    if not ends.filter("parted").isEmpty():
        parted = F.col("parted") & (F.col("key") == F.col("end_key"))
        d = d.filter(~F.coalesce(parted, F.lit(False))).unionByName(numbered(d.filter(parted)), allowMissingColumns=True)
        times = F.col("passes") + F.when((F.col("key") < F.col("end_key")) | ((F.col("key") == F.col("end_key")) & (F.coalesce("nth", F.lit(0)) <= F.col("copies"))), 1).otherwise(0)
    else:
        times = F.col("passes") + F.when(F.col("key") <= F.col("end_key"), 1).otherwise(0)
    inside = F.conv(F.substring("key", digits + 1, 8), 16, 10).cast("double") / float(16**8)
    d = d.withColumn("times", times).filter("times > 0").withColumn("offset", F.col("before") + inside * F.col("bucket_size"))
    d = d.withColumn("pass", F.explode(F.expr("sequence(0L, times - 1)")))
    return d.select("doc", "key", position(F.col("pass"), c).alias("position")).orderBy("position", "key").select("doc.*")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    c = PRODUCTION

    def inverse(k: int) -> str:
        out = ""
        for t, w, slope, before in segments(c.schedules[k]):
            u = f"(share - {before!r}::DOUBLE)"
            root = f"({w!r}::DOUBLE + sqrt(greatest({w * w!r}::DOUBLE + {2 * slope!r}::DOUBLE * {u}, 0.0::DOUBLE)))"
            out = f"CASE WHEN share >= {before!r}::DOUBLE THEN {t!r}::DOUBLE + 2 * {u} / {root} ELSE {out or 'NULL'} END"
        return out

    return rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT size,
  md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) k FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 kind FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][kind + 1]::BIGINT weight, 3 * source_size cap FROM s),
p AS (SELECT *, sum(source_size) OVER () total, sum(weight) OVER () ws, coalesce(sum(cap) OVER b, 0) capped, coalesce(sum(weight) OVER b, 0) passed
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped)::DOUBLE / (ws - passed)::DOUBLE lv FROM p),
v AS (SELECT *, (SELECT lv FROM l WHERE lv * weight <= cap ORDER BY cap::DOUBLE / weight, lv LIMIT 1) f FROM l),
t AS (SELECT source, kind, source_size, least(cap::DOUBLE, coalesce(f, 0) * weight) target FROM v),
o AS (SELECT doc_id, size, t.*, floor(target + 0.5)::BIGINT goal,
  (sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT off FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END passes FROM o),
r AS (SELECT *, (passes * size + greatest(least(goal - passes * source_size - off, size), 0))::BIGINT taken, least(off::DOUBLE / nullif(goal, 0), 1.0) share FROM q)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE kind WHEN 0 THEN {inverse(0)} WHEN 1 THEN {inverse(1)} ELSE {inverse(2)} END END AS position
FROM r
"""


QUERIES = {"op2_source_mix": op2_source_mix}
SQL = {"op2_source_mix": _sql()}
