"""Record linkage over keys that very many rows share: the work follows the rows and the pairs of the result, not all pairs of a key."""

from contextlib import contextmanager
from threading import Timer

from pyspark.sql import functions as F

from quillgraph.functions import names, persons


@contextmanager
def within(spark, seconds):
    """Cancels the jobs of a block that takes longer, which fails it."""
    timer = Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_resolved_counts_candidates_of_a_hot_key(spark):
    n, word = 100_000, lambda c: F.concat(F.lit("a"), c.cast("string"))
    shared = [F.lit("a").alias("fi"), F.lit("smith").alias("last")]
    people = spark.range(n).select(F.col("id").alias("person"), F.concat(F.lit("of Place "), F.when(F.col("id") < 5, F.col("id")).otherwise(9).cast("string"), F.lit(", X")).alias("affil"), F.concat(word(F.col("id")), F.lit("p")).alias("first"), *shared)
    place = F.concat(F.lit("place "), F.when(F.col("id") == 7, 0).when(F.col("id") < 3, 1).otherwise(8).cast("string"))
    known = spark.range(n).select(F.col("id").alias("candidate"), place.alias("inst_modal"), F.lit(None).cast("string").alias("inst_recent"), F.when(F.col("id") == 50, "a3p").otherwise(F.concat(word(F.col("id")), F.lit("c"))).alias("first"), *shared)
    with within(spark, 60):
        rows = persons.resolved(people, known, [("first", "last"), ("fi", "last")]).collect()
    got = {r["person"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(got) == n
    assert got[0] == (2, 1, "inst_resolved", 7)
    assert got[1] == got[2] == (2, n, "ambiguous", None)
    assert got[3] == (1, 1, "unique", 50)
    assert got[n - 1] == (2, n, "ambiguous", None)


def test_members_meet_distinct_authors(spark):
    n, k = 200_000, F.col("id")
    same = [F.lit("ann").alias("first_norm"), F.lit("lee").alias("last_norm"), F.lit("a").alias("initial")]
    roster = spark.range(n).select(k.alias("person_id"), *same, F.when(k == 3, "unit two").otherwise("unit one").alias("affil"))
    roster = roster.union(spark.createDataFrame([(3, "zoe", "ray", "z", "unit one"), (n, "ann", "nobody", "a", "unit one")], roster.schema))
    inst = F.when(k % 2 == 0, "the one").otherwise("elsewhere")
    known = spark.range(n).select(k.alias("author_idx"), F.when(k % 4 == 0, "al lee").otherwise("ann lee").alias("display_name"), F.lit(1).alias("works_count"), (k % 1000).alias("cited_by_count"), inst.alias("institutions"))
    with within(spark, 60):
        rows = persons.members_to_authors(roster, known, [("one", "One"), ("two", "Two")]).collect()
    got = {r["person_id"]: (r["author_idx"], r["match_status"]) for r in rows}
    assert len(rows) == n + 2 and len(got) == n + 1
    assert got[0] == got[n - 1] == (998, "exact_inst")
    assert got[3] == (999, "first_only")  # of both of its rows
    assert got[n] == (None, None)


def test_waterfall_joins_the_deciding_stage_alone(spark):
    n, k = 100_000, F.col("id")
    people = spark.range(n).select(k.alias("person"), F.when(k > 2, k).alias("first"), F.lit("lee").alias("last"))
    people = people.union(spark.createDataFrame([(0, 10**6, "x"), (0, 10**6 + 1, "x"), (n, 3, "lee")], people.schema))
    known = spark.range(3, n).select(k.alias("candidate"), k.alias("first"), F.when(k > 4, "lee").otherwise("ray").alias("last"))
    known = known.union(spark.createDataFrame([(7, 10**6, "x"), (7, 10**6 + 1, "x")], known.schema))
    with within(spark, 60):
        rows = [tuple(r) for r in names.waterfall(people, known, [("first", "last"), ("first",)]).collect()]
    assert len(rows) == len(set(rows)) == n - 3 + 2
    assert sorted(r for r in rows if r[0] in (0, 1, 3, 5, n)) == [(0, 7, 1), (3, 3, 2), (5, 5, 1), (n, 3, 2)]
    with within(spark, 60):
        late = names.waterfall(people, known, [("first", "last"), ("last",)]).filter("stage = 1")
        assert late.count() == n - 5 + 1


def test_equal_texts_are_compared_once(spark):
    n, k = 24_000, F.col("id")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("w"), (k % 10).cast("string"), F.lit("x"), i.cast("string"))), " ")
    left = spark.range(n).select("id", F.when(k == 0, "").otherwise(text).alias("text"))
    with within(spark, 60):
        out = names.token_jaccard(left, left, 0.5).agg(F.count("*").alias("n"), F.min("jaccard").alias("j"), F.min("id_a").alias("a"), F.sum((F.col("id_a") % 10 != F.col("id_b") % 10).cast("int")).alias("wrong")).collect()[0]
    assert tuple(out) == (9 * 2400**2 + 2399**2, 1.0, 1, 0)
