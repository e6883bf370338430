"""Report tables: shares, pivots, benchmarks, national ranks, whitelist matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rank_shares(cands: DataFrame, cutoffs: list[int]) -> DataFrame:
    """group_idx, n_units and the share of weight that the first so many units hold."""
    unit = next(c for c in cands.columns if c not in ("group_idx", "weighted_works"))
    r = cands.withColumn("r", F.row_number().over(W.partitionBy("group_idx").orderBy(F.desc(F.round("weighted_works", 9)), unit)))
    total = F.sum("weighted_works")
    return r.groupBy("group_idx").agg(F.count("*").alias("n_units"), *((F.sum(F.when(F.col("r") <= c, F.col("weighted_works"))) / total).alias(f"top_{c}") for c in cutoffs))


def cross_field_pairs(fw: DataFrame, n: int) -> DataFrame:
    """The field pairs that most works share."""
    f = fw.select("work_idx", "field_idx").distinct()
    j = f.toDF("work_idx", "field_a").join(f.toDF("work_idx", "field_b"), "work_idx").filter("field_a < field_b")
    return j.groupBy("field_a", "field_b").agg(F.count("*").alias("n_works")).orderBy(F.desc("n_works"), "field_a", "field_b").limit(n)


def country_report(fw: DataFrame) -> DataFrame:
    recent = F.col("publication_year") >= 2000
    return fw.groupBy("country_code").agg(
        F.countDistinct("work_idx").alias("n_works"), F.countDistinct("institution_idx").alias("n_inst"), F.countDistinct("source_idx").alias("n_sources"),
        F.countDistinct(F.when(recent, F.col("work_idx"))).alias("n_recent"), F.countDistinct(F.when(F.col("leiden_idx") == 4, F.col("work_idx"))).alias("n_health"),
    )


def share_by_year(fw: DataFrame, years: list[int], split: int) -> DataFrame:
    """A country's share of all works by year, its sums before and from a year on, and growth between them."""
    w = fw.select("country_code", "publication_year", "work_idx").distinct()
    total = w.groupBy("publication_year").agg(F.countDistinct("work_idx").alias("all"))
    c = w.groupBy("country_code", "publication_year").agg(F.count("*").alias("k")).join(F.broadcast(total), "publication_year")
    cols = [F.round(F.max(F.when(F.col("publication_year") == y, F.col("k") / F.col("all"))), 9).alias(f"y{y}") for y in years]
    a, b = F.sum(F.when(F.col("publication_year") < split, F.col("k")).otherwise(0)), F.sum(F.when(F.col("publication_year") >= split, F.col("k")).otherwise(0))
    return c.groupBy("country_code").agg(*cols, a.alias("early"), b.alias("late")).withColumn("growth", F.when(F.col("early") > 0, F.round(F.col("late") / F.col("early") - 1, 9)))


def unit_pivot(scores: DataFrame, fields: list[int]) -> DataFrame:
    """unit_idx by field, rounded, with the sum over fields (null if all are)."""
    p = scores.groupBy("unit_idx").pivot("field_idx", fields).agg(F.first("v"))
    for f in fields:
        p = p.withColumnRenamed(str(f), f"f{f}")
    got = [F.col(f"f{f}") for f in fields]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in got), F.lit(0.0))
    return p.select("unit_idx", *(F.round(c, 6).alias(f"f{f}") for c, f in zip(got, fields)), F.when(F.coalesce(*got).isNotNull(), F.round(total, 6)).alias("total"))


def country_benchmark(ranked: DataFrame) -> DataFrame:
    """Per country: units, percent with v of 1 or more, mean, median and sum of v."""
    v = F.col("v")
    return ranked.filter(v.isNotNull()).groupBy("country_code").agg(F.count("*").alias("n_units"), F.round(100 * F.avg(F.when(v >= 1, 1.0).otherwise(0.0)), 2).alias("pct_ge_1"), F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.median("v"), 6).alias("median_v"), F.round(F.sum("v"), 6).alias("sum_v"))


def national_rank(ranked: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Rank of v inside a country (and the keys), ties sharing the least."""
    return ranked.withColumn("national_rank", F.rank().over(W.partitionBy(*keys, "country_code").orderBy(F.desc_nulls_last(F.round("v", 9)))).cast("int"))


def whitelist_match(listed: DataFrame, sources: DataFrame) -> DataFrame:
    """listed (list_id, issn, title) to sources (source_idx, issn array, display_name): by ISSN, else by title."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    code = lambda c: F.upper(F.replace(c, F.lit("-"), F.lit("")))
    s = sources.select("source_idx", F.explode("issn").alias("i")).select("source_idx", code(F.col("i")).alias("key")).distinct()
    one = listed.filter("issn IS NOT NULL").select("list_id", code(F.col("issn")).alias("key")).join(s, "key").groupBy("list_id").agg(F.min("source_idx").alias("source_idx")).withColumn("match_method", F.lit("issn"))
    rest = listed.join(one, "list_id", "left_anti").select("list_id", norm(F.col("title")).alias("key"))
    two = rest.join(sources.select("source_idx", norm(F.col("display_name")).alias("key")), "key").groupBy("list_id").agg(F.min("source_idx").alias("source_idx")).withColumn("match_method", F.lit("title"))
    return one.unionByName(two)
