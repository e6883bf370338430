"""Highly cited works by citation percentiles, and their authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.order import percentiles
from quillgraph.operators.authors import modal
from quillgraph.operators.works import share_of

KEPT = ["work_idx", "publication_year", "cited_by_count", "authors_count", "institutions_distinct_count"]


def works_by_topic(fw: DataFrame, topics: DataFrame, horizon: int) -> DataFrame:
    """Works cited more often than once a year of their life up to horizon, by topic score and field. Equal scores of one field
    collapse, as the rows are distinct."""
    w = fw.select(*KEPT).distinct().filter(F.col("cited_by_count") > horizon - F.col("publication_year"))
    return w.join(topics.select("work_idx", F.col("score").alias("field_score"), "field_idx"), "work_idx").distinct()


def shared_by_field(works: DataFrame) -> DataFrame:
    """One row a work and field with field_share, rounded to 3 places."""
    share = F.col("field_score") / F.sum("field_score").over(W.partitionBy("work_idx"))
    return works.withColumn("s", share).groupBy(*KEPT, "field_idx").agg(F.round(F.round(F.sum("s"), 9), 3).alias("field_share"))


def highly_cited(works: DataFrame, share: float, overrides: dict[int, float]) -> DataFrame:
    """Works at or above the percentile of citations of their field and year; some fields have a percentile of their own."""
    t = percentiles(works, ["field_idx", "publication_year"], "cited_by_count", threshold=share_of(share, overrides))
    return works.join(F.broadcast(t), ["field_idx", "publication_year"]).filter(F.col("cited_by_count") >= F.col("threshold")).select("work_idx", "publication_year", "cited_by_count", "field_idx", "field_share")


def authors(hcw: DataFrame, auth: DataFrame, institutions: DataFrame, people: DataFrame, years: tuple[int, int]) -> DataFrame:
    """row_idx, field_idx, author_idx, n_hcw, the author's columns of people, and the most frequent institution with its country.
    Of equally frequent ones the first by name. The key numbers rows by field, count and author."""
    h = hcw.filter(F.col("publication_year").between(*years)).select("work_idx", "field_idx").distinct()
    raw = auth.filter("author_idx IS NOT NULL").join(h, "work_idx").join(institutions.select("institution_idx", F.col("display_name").alias("inst_name"), F.col("country_code").alias("inst_country")), "institution_idx", "left")
    n = raw.groupBy("field_idx", "author_idx").agg(F.countDistinct("work_idx").alias("n_hcw"))
    named = raw.filter("inst_name IS NOT NULL").withColumn("inst", F.struct("inst_name", "inst_country"))
    mode = modal(named, ["field_idx", "author_idx"], "inst").select("field_idx", "author_idx", "inst.inst_name", "inst.inst_country")
    out = n.join(mode, ["field_idx", "author_idx"], "left").join(people, "author_idx")
    # numbers inside fields first, so that no task sees more than a field
    by = W.partitionBy("field_idx").orderBy(F.desc("n_hcw"), "author_idx")
    before = out.groupBy("field_idx").agg(F.count("*").alias("k")).select("field_idx", (F.sum("k").over(W.orderBy("field_idx")) - F.col("k")).alias("before"))
    return out.withColumn("r", F.row_number().over(by)).join(F.broadcast(before), "field_idx").withColumn("row_idx", F.col("before") + F.col("r")).drop("r", "before")


def authorships(hcw: DataFrame, auth: DataFrame) -> DataFrame:
    return auth.filter("author_idx IS NOT NULL").join(hcw.select("work_idx").distinct(), "work_idx", "left_semi").select("work_idx", "author_idx").distinct()


def thresholds(found: DataFrame, share: float = 0.9) -> DataFrame:
    """field_idx, thresh: the whole part of the percentile of n_hcw, 1 at least."""
    return percentiles(found, ["field_idx"], "n_hcw", p=F.lit(share)).select("field_idx", F.greatest(F.lit(1), F.floor("p")).cast("long").alias("thresh"))


def prolific(found: DataFrame, share: float = 0.9) -> DataFrame:
    """Author rows of a field that reach its threshold."""
    return found.join(F.broadcast(thresholds(found, share)), "field_idx").filter(F.col("n_hcw") >= F.col("thresh")).drop("thresh")


def one_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def overlay(matches: DataFrame, clusters: DataFrame, pairs: DataFrame, hcw: DataFrame) -> DataFrame:
    """Highly cited works of the authors whose cluster a listed person was matched to, once for each author."""
    ok = matches.filter(F.col("match_status").isin("unique", "inst_resolved")).select(F.col("hca_cluster_hash").alias("cluster_hash")).distinct()
    people = clusters.join(ok, "cluster_hash", "left_semi").select("author_idx").distinct()
    return hcw.join(pairs.join(people, "author_idx", "left_semi"), "work_idx")


def pool_means(works: DataFrame, x: str, y: str) -> DataFrame:
    """Mean log10 of both scores over works, and over persons' means; works without both, or not above 0, are left out."""
    w = works.filter((F.col(x) > 0) & (F.col(y) > 0)).select("author_idx", F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    pool = w.agg(F.avg("lx").alias("pool_x"), F.avg("ly").alias("pool_y"))
    person = w.groupBy("author_idx").agg(F.avg("lx").alias("lx"), F.avg("ly").alias("ly")).agg(F.avg("lx").alias("person_x"), F.avg("ly").alias("person_y"))
    return pool.crossJoin(F.broadcast(person))
