"""Work scores, highly cited works and the enclave measures that build on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.order import percentiles, steady


def work_v(fw: DataFrame, rankings: DataFrame) -> DataFrame:
    """work_idx, field_idx, source_v, mean_inst_v and work_v of works whose source is ranked. rankings: field_idx, unit_idx,
    unit_type, v. Institutions without v do not count; without any, the source's v stands alone."""
    s = rankings.filter((F.col("unit_type") == "S") & F.col("v").isNotNull()).select("field_idx", F.col("unit_idx").alias("source_idx"), F.col("v").alias("source_v"))
    u = rankings.filter((F.col("unit_type") == "U") & F.col("v").isNotNull()).select("field_idx", F.col("unit_idx").alias("institution_idx"), F.col("v").alias("inst_v"))
    rows = fw.select("work_idx", "field_idx", "source_idx", "institution_idx").distinct()
    j = rows.join(s, ["field_idx", "source_idx"]).join(u, ["field_idx", "institution_idx"], "left")
    out = j.groupBy("work_idx", "field_idx").agg(F.max("source_v").alias("source_v"), F.avg("inst_v").alias("mean_inst_v"))
    return out.withColumn("work_v", (F.col("source_v") + F.coalesce("mean_inst_v", "source_v")) / 2)


def citer_counts(scored: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations of each (field, work) from scored works of any field: n_intra, mean_citer_v, n_citer_hi, n_citer_lo."""
    citers = scored.groupBy(F.col("work_idx").alias("citer_idx")).agg(F.max("source_v").alias("v"))
    cited = scored.select("field_idx", F.col("work_idx").alias("cited_idx"))
    j = refs.join(citers, "citer_idx").join(cited, "cited_idx")
    return j.groupBy("field_idx", F.col("cited_idx").alias("work_idx")).agg(F.count("*").alias("n_intra"), F.avg("v").alias("mean_citer_v"), F.count(F.when(F.col("v") > 1, 1)).alias("n_citer_hi"), F.count(F.when(F.col("v") < 1, 1)).alias("n_citer_lo"))


def hcw_flags(works: DataFrame, share: float = 0.99, n: str = "n_intra", year: str = "publication_year") -> DataFrame:
    """works (field_idx, work_idx, year, n) with threshold and is_hcw: at least the exact percentile of field and year."""
    t = percentiles(works, ["field_idx", year], n, threshold=F.lit(share))
    return works.join(t, ["field_idx", year]).withColumn("is_hcw", F.col(n) >= F.col("threshold"))


def share_of(share: float, overrides: dict[int, float]) -> Column:
    """The percentile of a field."""
    at = F.lit(share)
    for f, s in overrides.items():
        at = F.when(F.col("field_idx") == f, F.lit(s)).otherwise(at)
    return at


def override_thresholds(works: DataFrame, share: float, overrides: dict[int, float], n: str) -> DataFrame:
    """field_idx, threshold with a percentile of its own for some fields."""
    return percentiles(works, ["field_idx"], n, threshold=share_of(share, overrides))


QUADRANTS = {"++": "n_pp", "+-": "n_pm", "-+": "n_mp", "--": "n_mm"}


def quadrant(source_v: Column, citer_v: Column) -> Column:
    """++, +-, -+ or -- by both scores against 1; null if either is."""
    side = lambda c: F.when(steady(c) >= 1, "+").when(steady(c) < 1, "-")
    return F.concat(side(source_v), side(citer_v))


def quadrant_pools(labelled: DataFrame) -> DataFrame:
    """field_idx and the number of works of each quadrant."""
    return labelled.groupBy("field_idx").agg(*(F.count(F.when(F.col("quadrant") == q, 1)).alias(name) for q, name in QUADRANTS.items()))


def field_shares(topics: DataFrame) -> DataFrame:
    """A work's share of each field, rounded to 3 places."""
    t = topics.groupBy("work_idx", "field_idx").agg(F.sum("score").alias("s"))
    return t.select("work_idx", "field_idx", F.round(F.col("s") / F.sum("s").over(W.partitionBy("work_idx")), 3).alias("share"))


def enclave(hcw: DataFrame, works: DataFrame, counts: DataFrame, mean_inst_v: DataFrame) -> DataFrame:
    """Highly cited works with their citers' and institutions' scores, and the gap between source and institutions."""
    j = hcw.join(counts, ["field_idx", "work_idx"], "left").join(mean_inst_v, ["field_idx", "work_idx"], "left").join(works, "work_idx", "left")
    return j.withColumn("gap", F.col("source_v") - F.col("mean_inst_v")).withColumn("quadrant", quadrant(F.col("source_v"), F.col("mean_citer_v")))
