"""Scores on a bound fall on one side of it in every order of their rows."""

import pytest

from pyspark.sql import functions as F

from quillgraph.model import Run
from quillgraph.operators import authors, corpus, edges, enclaves, works


@pytest.mark.parametrize("order", [[0.1, 0.2, 2.7], [2.7, 0.2, 0.1], [0.7, 0.1, 0.3, 0.9, 3.0], [3.0, 0.7, 0.1, 0.9, 0.3]])
def test_a_mean_of_one_is_one(spark, order):
    n = len(order)
    scored = spark.createDataFrame([(20, k, v) for k, v in enumerate(order)] + [(20, 99, 1.0)], "field_idx long, work_idx long, source_v double").coalesce(1)
    refs = spark.createDataFrame([(k, 99) for k in range(n)], "citer_idx long, cited_idx long").coalesce(1)
    c = works.citer_counts(scored, refs)
    assert [(r["n_intra"], r["q"]) for r in c.withColumn("q", works.quadrant(F.lit(1.0), F.col("mean_citer_v"))).collect()] == [(n, "++")]
    s = enclaves.summary(c.withColumns({"source_v": F.lit(0.5), "mean_inst_v": F.lit(1.0)})).first()
    assert (s["n_enclave"], s["n_lo_hi"]) == (0, 0)


def test_weighted_works_reach_their_threshold_in_every_order(spark):
    weights = [0.1, 0.7, 0.2]
    rows = [(g * 10 + k, 1, 1, 1998, 7, 5, weights[(k + g) % 3], 1.0, g) for g in range(3) for k in range(3)]
    fw = spark.createDataFrame(rows, "work_idx long, source_idx long, institution_idx long, publication_year long, subfield_idx long, field_idx long, field_weight double, inst_weight double, group_idx long").coalesce(1)
    run = Run(group_col="group_idx", members=(0, 1, 2), window=(1996, 2000), tau_s=0.2, tau_u=0.2)  # times five years: 1
    assert run.least_s == run.least_u == 1
    for df in edges.retained(*corpus.candidacy(fw, "group_idx", run.window), run, None):
        assert sorted(r["group_idx"] for r in df.collect()) == [0, 1, 2]


def test_a_crossfield_score_of_one_qualifies(spark):
    rows = [(f, 1, n) for f, n in ((1, 0.1), (2, 0.2), (3, 0.7))] + [(f, 2, n) for f, n in ((1, 0.7), (2, 0.2), (3, 0.1))] + [(f, 3, n) for f, n in ((1, 0.2), (2, 0.7), (3, 0.1))]
    n = lambda name: spark.createDataFrame(rows, f"field_idx long, author_idx long, {name} double").coalesce(1)
    got = authors.crossfield(n("n_hcw"), n("n_cites"), 20).collect()
    assert sorted((r["author_idx"], r["qualified"]) for r in got) == [(1, True), (2, True), (3, True)]
