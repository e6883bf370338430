"""Authors of highly cited works: extraction, scores across fields, co-author evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.order import percentiles, steady
from quillgraph.sources.shared import stored

#: Authors of a cluster whose co-authors meet in one task.
TOGETHER = 64


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the most frequent value of each key; of equals the least."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return c.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), value))).filter("_r = 1").drop("_r")


def top_authors(membership: DataFrame, auth: DataFrame, n: int) -> DataFrame:
    """The n authors with most works of each (field, enclave)."""
    c = membership.join(auth.select("work_idx", "author_idx"), "work_idx").groupBy("field_idx", "enclave", "author_idx").agg(F.countDistinct("work_idx").alias("n_works"))
    by = W.partitionBy("field_idx", "enclave").orderBy(F.desc("n_works"), "author_idx")
    return c.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def calibrated(scores: DataFrame, target: int, value: str) -> DataFrame:
    """field_idx, threshold: at least 1, the linear quantile at which about target authors of a field lie above."""
    p = percentiles(scores, ["field_idx"], value, threshold=F.greatest(F.lit(0.0), 1 - F.lit(float(target)) / F.col("total")))
    return p.withColumn("threshold", F.greatest(F.lit(1.0), "threshold"))


def crossfield(papers: DataFrame, cites: DataFrame, target: int) -> DataFrame:
    """Author scores over fields: sums of counts over calibrated thresholds; qualified if both reach 1.
    papers: field_idx, author_idx, n_hcw. cites: field_idx, author_idx, n_cites."""

    def score(df: DataFrame, value: str, name: str) -> DataFrame:
        j = df.join(calibrated(df, target, value), "field_idx")
        return j.groupBy("author_idx").agg(F.sum(F.col(value) / F.col("threshold")).alias(name), F.count("*").alias(f"n_{name}"))

    j = score(papers, "n_hcw", "cf_paper_score").join(score(cites, "n_cites", "cf_cite_score"), "author_idx", "full")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("author_idx", F.coalesce("n_cf_paper_score", F.lit(0)).alias("n_fields"), z("cf_paper_score").alias("cf_paper_score"), z("cf_cite_score").alias("cf_cite_score"), ((steady(z("cf_paper_score")) >= 1) & (steady(z("cf_cite_score")) >= 1)).alias("qualified"))


def coauthor_evidence(clusters: DataFrame, auth: DataFrame) -> DataFrame:
    """Pairs of authors in one cluster with their co-authors in common. clusters: cluster, author_idx. jaccard is over at least one
    co-author. A work's authors carry their clusters, so that all co-authors are shuffled once, to their author's cluster: there authors meet
    at a co-author, and one that meets itself counts its own. Clusters of many authors are dealt to several tasks by co-author."""
    c = stored(clusters.filter("cluster IS NOT NULL").withColumn("k", F.count("*").over(W.partitionBy("cluster"))).filter("k > 1").select("cluster", "author_idx", "k"))
    mine = auth.select("work_idx", "author_idx").filter("work_idx IS NOT NULL AND author_idx IS NOT NULL").repartition("author_idx").distinct()
    works = mine.join(c.distinct(), "author_idx", "left").repartition("work_idx").groupBy("work_idx").agg(F.collect_list(F.struct("cluster", "k", "author_idx")).alias("all"))
    co = works.select(F.array_distinct("all.author_idx").alias("others"), F.explode(F.filter("all", lambda x: x["cluster"].isNotNull())).alias("x"))
    co = co.select("x.*", F.explode("others").alias("coauthor")).filter("author_idx <> coauthor")
    part = F.pmod(F.xxhash64("coauthor"), F.ceil(F.col("k") / TOGETHER)).cast("int")
    meet = co.select("cluster", part.alias("part"), "coauthor", "author_idx").repartition("cluster", "part").distinct()
    upto = W.partitionBy("cluster", "part", "coauthor").orderBy("author_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    meet = meet.select("cluster", F.col("author_idx").alias("b"), F.collect_list("author_idx").over(upto).alias("g")).select("cluster", F.explode("g").alias("a"), "b")
    met = stored(meet.groupBy("cluster", "a", "b").agg(F.count("*").alias("n")))
    z = lambda x: F.coalesce(x, F.lit(0))
    own = c.join(met.filter("a = b").select("cluster", F.col("a").alias("author_idx"), "n"), ["cluster", "author_idx"], "left").select("cluster", "author_idx", z("n").alias("n"))
    pairs = own.toDF("cluster", "a", "n_a").join(own.toDF("cluster", "b", "n_b"), "cluster").filter("a < b")
    j = pairs.join(met.filter("a < b").withColumnRenamed("n", "n_shared"), ["cluster", "a", "b"], "left").select("cluster", "a", "b", "n_a", "n_b", z("n_shared").alias("n_shared"))
    return j.withColumn("jaccard", F.col("n_shared") / F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - F.col("n_shared")))
