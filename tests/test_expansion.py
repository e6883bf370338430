"""The expansion of work pairs to institutions: against one in plain Python, and with works that half of all references name."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from quillgraph.model import Run
from quillgraph.operators import edges

FW = "work_idx long, publication_year long, source_idx long, institution_idx long, country_code string, inst_weight double, direct_inst_weight double, subfield_idx long, field_idx long, field_weight double, leiden_idx long"
RUN = Run("field_idx", (25,), (2020, 2024), tau_s=0.0, tau_u=0.0)


@pytest.fixture(scope="module")
def planted(spark):
    """60 works of one to four institutions; work 3 is cited by all, work 5 cites all."""
    rng = random.Random(5)
    rows = [(w, 2022, w % 7, u, "NZ", 1 / (1 + w % 4), 0.5, 2501, 25, (w % 3 + 1) / 4, 2) for w in range(60) for u in rng.sample(range(9), 1 + w % 4)]
    refs = {(w, 3) for w in range(60) if w != 3} | {(5, w) for w in range(60) if w != 5} | {(rng.randrange(60), rng.randrange(60)) for _ in range(80)}
    fw, r = spark.createDataFrame(rows, FW), spark.createDataFrame(sorted(refs), "citer_idx long, cited_idx long")
    s = fw.select("source_idx", F.lit(1.0).alias("weighted_works")).distinct()
    return rows, refs, fw, r, s, fw.select("institution_idx", F.lit(1.0).alias("weighted_works")).distinct()


def expanded(rows, refs):
    at, weight = {}, {}
    for w, _, s, u, _, iw, dw, _, _, f, _ in rows:
        at.setdefault(w, []).append((s, u, iw, dw))
        weight[w] = f
    total = {}
    for a, b in refs:
        total[a] = total.get(a, 0.0) + (weight[a] + weight[b]) / 2
    return sorted((a, *x, b, *y, round((weight[a] + weight[b]) / 2, 9), round(total[a], 9)) for a, b in refs for x in at[a] for y in at[b])


@pytest.mark.parametrize("hot", [None, ([], []), ([5], [3]), ([5, 999], [3, 5])])
def test_edges_equal_the_plain_expansion(planted, hot):
    rows, refs, fw, r, s, u = planted
    got = edges.edge_list(fw, r, RUN, s, u, hot=hot).select("citer_work_idx", "citer_source_idx", "citer_inst_idx", "inst_weight", "direct_inst_weight", "cited_work_idx", "cited_source_idx", "cited_inst_idx", "cited_inst_weight", "direct_cited_inst_weight", F.round("edge_field_weight", 9), F.round("R_i", 9))
    assert sorted(map(tuple, got.collect())) == expanded(rows, refs)


def test_hot_works_are_few(planted):
    _, refs, _, r, _, _ = planted
    assert edges.hot_works(r, "cited_idx", shares=5, fewest=10) == [3] and edges.hot_works(r, "citer_idx", shares=5, fewest=10) == [5]
    assert edges.hot_works(r, "cited_idx") == []  # a table this small has no task to spare


def test_references_to_one_work_stay_spread(spark):
    refs = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("citer_work_idx"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("cited_work_idx"))
    works = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("cited_work_idx"), F.lit(1).alias("x"))
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # partitions as the shuffle makes them
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        largest = {}
        for hot in ([], [7]):
            d = edges.with_works(refs, works, "cited_work_idx", hot)
            n = [x["count"] for x in d.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(n) == 40_000
            largest[bool(hot)] = max(n) / median(n)
            if not hot:
                assert max(n) > 20_000  # half of all rows are one task's
        assert largest[True] < 3
    finally:
        for k in plain:
            spark.conf.unset(k)
