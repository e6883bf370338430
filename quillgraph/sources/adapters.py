"""The order-and-parts test tables read as a bibliometric corpus.

Orders are works, customers sources, lines authorships (part: author, supplier: institution), brands subfields. An
order's first line cites the earlier orders whose first line has the same part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.model import Corpus, Run

CORPUS = Corpus(years=(1995, 2001), work_types=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), source_types=("HOUSEHOLD", "FURNITURE", "MACHINERY", "BUILDING"))
RUN = Run(group_col="leiden_idx", members=(4,), window=(1996, 2000), tau_s=0.05, tau_u=0.5, sentinel=10**12)


class Tables:
    """Lazily read model tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def authorships(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("work_idx"), F.col("l_partkey").alias("author_idx"), F.col("l_suppkey").alias("institution_idx"))

    def institutions(self) -> DataFrame:
        n = self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        s = self.raw("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(F.col("s_suppkey").alias("institution_idx"), F.col("n_name").alias("country_code"), F.col("r_name").alias("region"), F.col("s_name").alias("display_name"))

    def sources(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("source_idx"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("display_name"))

    def topics(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", F.regexp_extract("p_brand", "#([0-9]+)$", 1).cast("long").alias("subfield_idx"), F.col("p_brand").alias("subfield_name"))
        t = self.raw("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
        return t.select(F.col("l_orderkey").alias("work_idx"), "subfield_idx", "subfield_name", (F.col("subfield_idx") + 11).alias("field_idx"), F.col("l_quantity").alias("score"))

    def references(self) -> DataFrame:
        """Pairs are distinct without a shuffle of all of them: only two works that both have several first parts can meet twice."""
        first = self.raw("lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("w"))
        first = first.repartition("w").distinct().withColumn("many", F.count("*").over(W.partitionBy("w")) > 1)
        both = lambda d: d.toDF("p", "citer_idx", "citer_many").join(d.toDF("p", "cited_idx", "cited_many"), "p").filter("citer_idx > cited_idx")
        once = both(first).filter("NOT (citer_many AND cited_many)").select("citer_idx", "cited_idx")
        return once.unionByName(both(first.filter("many")).select("citer_idx", "cited_idx").distinct())

    def years(self) -> DataFrame:
        """Works' years alone, which need no references."""
        return self.raw("orders").select(F.col("o_orderkey").alias("work_idx"), F.year("o_orderdate").cast("long").alias("publication_year"))

    def works(self, refs: DataFrame | None = None) -> DataFrame:
        """Works; refs are the references where they are stored already."""
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("work_idx"), F.col("o_custkey").alias("source_id"), F.year("o_orderdate").cast("long").alias("publication_year"), F.col("o_orderpriority").alias("type"),
            (F.col("o_orderkey") % 97 == 0).alias("is_paratext"), (F.col("o_orderkey") % 101 == 0).alias("is_retracted"),
            F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("-"), F.floor(F.col("o_totalprice") / 50).cast("string")).alias("title"),
        )
        refs = self.references() if refs is None else refs
        given = refs.groupBy(F.col("citer_idx").alias("work_idx")).agg(F.count("*").alias("referenced_works_count"))
        got = refs.groupBy(F.col("cited_idx").alias("work_idx")).agg(F.count("*").alias("cited_by_count"))
        # first rows of an author and of an institution are flagged where the work's lines lie, so that its lines are shuffled once and not
        # copied for each count; a work has few
        first = lambda c: (F.col(c).isNotNull() & (F.row_number().over(W.partitionBy("work_idx", c).orderBy(F.lit(0))) == 1)).cast("long")
        au = self.authorships().repartition("work_idx").select("work_idx", first("author_idx").alias("a"), first("institution_idx").alias("i"))
        au = au.groupBy("work_idx").agg(F.sum("a").alias("authors_count"), F.sum("i").alias("institutions_distinct_count"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        w = o.join(given, "work_idx", "left").join(got, "work_idx", "left").join(au, "work_idx", "left")
        return w.select(*o.columns, zero("referenced_works_count"), zero("cited_by_count"), zero("authors_count"), zero("institutions_distinct_count"))
