"""The corpus: works by institution by subfield with fractional weights, and references inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.model import Corpus, group_of



def filtered_works(works: DataFrame, sources: DataFrame, c: Corpus) -> DataFrame:
    """Works of the corpus. All predicates but the semi join reach the scan."""
    w = works.filter(
        F.col("publication_year").between(*c.years) & F.col("type").isin(*c.work_types) & ~F.col("is_paratext") & ~F.col("is_retracted")
        & (F.col("referenced_works_count") > 0) & F.col("title").isNotNull() & (F.col("authors_count") <= c.max_authors)
    )
    ok = sources.filter(F.col("type").isin(*c.source_types)).select(F.col("source_idx").alias("source_id"))
    return w.join(ok, "source_id", "left_semi").withColumnRenamed("source_id", "source_idx")


def title_dedup(works: DataFrame) -> DataFrame:
    """The earliest work of each title; exact repetitions of it stay."""
    by = W.partitionBy("title").orderBy("publication_year", "work_idx")
    return works.withColumn("_r", F.dense_rank().over(by)).filter("_r = 1").drop("_r")


def inst_weights(auth: DataFrame, institutions: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """work_idx, institution_idx, country_code, inst_weight (by authors) and direct_inst_weight (equal shares)."""
    a = auth.filter("author_idx IS NOT NULL")
    if works is not None:
        a = a.join(works.select("work_idx"), "work_idx", "left_semi")
    a = a.join(institutions.select("institution_idx", "country_code"), "institution_idx")
    # one partitioning by work serves all steps; a work has few authorships
    a = a.repartition("work_idx").groupBy("work_idx", "author_idx", "institution_idx").agg(F.max("country_code").alias("country_code"), F.count("*").alias("k"))
    author = W.partitionBy("work_idx", "author_idx")
    a = a.withColumns({"n_inst": F.count("*").over(author), "first": (F.row_number().over(author.orderBy("institution_idx")) == 1).cast("int")})
    a = a.withColumn("n_authors", F.sum("first").over(W.partitionBy("work_idx")))
    iw = a.groupBy("work_idx", "institution_idx").agg(F.max("country_code").alias("country_code"), F.sum(F.col("k") / F.col("n_authors") / F.col("n_inst")).alias("inst_weight"))
    return iw.withColumn("direct_inst_weight", F.lit(1.0) / F.count("*").over(W.partitionBy("work_idx")))


def topic_layout(topics: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Flat topics from either layout; the schema tells which, no job runs."""
    if "topics" not in topics.columns:
        return topics.select("work_idx", "subfield_idx", "subfield_name", "field_idx", F.col("score").cast("double").alias("score"))
    t = topics.select("work_idx", F.explode("topics").alias("t")).select("work_idx", "t.topic_idx", F.col("t.score").cast("double").alias("score"))
    number = lambda c, what: F.regexp_extract(c, rf"{what}/([0-9]+)$", 1).cast("long")
    m = meta.select("topic_idx", number("subfield.id", "subfields").alias("subfield_idx"), F.col("subfield.display_name").alias("subfield_name"), number("field.id", "fields").alias("field_idx"))
    return t.join(m, "topic_idx").drop("topic_idx")


def topic_weights(topics: DataFrame) -> DataFrame:
    """work_idx, subfield_idx, subfield_name, field_idx, field_weight (sums to 1 a work)."""
    t = topics.groupBy("work_idx", "subfield_idx", "subfield_name", "field_idx").agg(F.sum("score").alias("s"))
    t = t.withColumn("total", F.sum("s").over(W.partitionBy("work_idx")))
    return t.select("work_idx", "subfield_idx", "subfield_name", "field_idx", F.when(F.col("total") != 0, F.col("s") / F.col("total")).alias("field_weight"))


def flat_works(works: DataFrame, sources: DataFrame, auth: DataFrame, institutions: DataFrame, topics: DataFrame, c: Corpus) -> DataFrame:
    return flattened(title_dedup(filtered_works(works, sources, c)), auth, institutions, topics)


def flattened(w: DataFrame, auth: DataFrame, institutions: DataFrame, topics: DataFrame) -> DataFrame:
    """Flat rows of the corpus's works. w is read three times, so it should be stored."""
    number, name = group_of(F.col("field_idx"))
    tw = topic_weights(topics.join(w.select("work_idx"), "work_idx", "left_semi")).withColumns({"leiden_idx": number, "leiden_name": name})
    out = w.join(inst_weights(auth, institutions, w), "work_idx").join(tw, "work_idx")
    return out.select(
        "work_idx", "publication_year", "source_idx", "institution_idx", "country_code", "inst_weight", "direct_inst_weight", "subfield_idx", "subfield_name",
        "field_idx", "field_weight", "leiden_idx", "leiden_name", "referenced_works_count", "title", "cited_by_count", "authors_count", "institutions_distinct_count",
    )


def corpus_references(refs: DataFrame, works: DataFrame) -> DataFrame:
    """Pairs with both ends in the corpus; repeated pairs and self-references stay. Takes flat pairs or lists."""
    if "cited_idx" not in refs.columns:
        refs = refs.select("citer_idx", F.explode("cited_list").alias("cited_idx"))
    ids = works.select("work_idx").distinct()
    return refs.join(ids.withColumnRenamed("work_idx", "citer_idx"), "citer_idx", "left_semi").join(ids.withColumnRenamed("work_idx", "cited_idx"), "cited_idx", "left_semi").select("citer_idx", "cited_idx")


def candidacy(fw: DataFrame, group: str, window: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Weighted works of each (group, source) and (group, institution); sources count a work's topic once, not per institution."""
    f = fw.filter(F.col("publication_year").between(*window) & F.col(group).isNotNull())
    s = f.select("work_idx", "source_idx", F.col(group).alias("group_idx"), "subfield_idx", "field_weight").distinct()
    s = s.groupBy("group_idx", "source_idx").agg(F.sum("field_weight").alias("weighted_works"))
    u = f.groupBy(F.col(group).alias("group_idx"), "institution_idx").agg(F.sum(F.col("field_weight") * F.col("inst_weight")).alias("weighted_works"))
    return s, u


def roll_up(cands: DataFrame, unit: str, mapping: dict[int, list[int]]) -> DataFrame:
    """Candidacy of coarser groups from finer ones, all groups in one pass; groups may overlap."""
    rows = [(k, m) for k, ms in mapping.items() for m in ms]
    dim = cands.sparkSession.createDataFrame(rows, "to_idx long, group_idx long")
    return cands.join(F.broadcast(dim), "group_idx").groupBy(F.col("to_idx").alias("group_idx"), unit).agg(F.sum("weighted_works").alias("weighted_works"))
