"""Co-author evidence and first institutions: what is read and exchanged follows the rows, not pairs times co-authors."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillgraph.functions import persons
from quillgraph.operators import authors
from quillgraph.plans import evaluation
from quillgraph.sources.adapters import Tables


def test_first_of_group_needs_no_references(spark, monkeypatch):
    def never(*_):
        raise AssertionError("references are not needed")

    monkeypatch.setattr(Tables, "references", never)
    monkeypatch.setattr(evaluation, "all_works", never)
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = evaluation.first_of_group(t)
    assert rows.count() == t.authorships().select("author_idx").distinct().count()
    assert t.years().count() == t.raw("orders").count()


def test_shared_coauthors_are_counted_in_each_cluster(spark):
    auth = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (2, 3), (3, 1), (3, 4)], "work_idx long, author_idx long")
    clusters = spark.createDataFrame([(10, 1), (10, 2), (20, 1), (20, 2), (20, 4)], "cluster long, author_idx long")
    got = {(r["cluster"], r["a"], r["b"]): (r["n_a"], r["n_b"], r["n_shared"]) for r in authors.coauthor_evidence(clusters, auth).collect()}
    assert got == {(10, 1, 2): (2, 1, 1), (20, 1, 2): (2, 1, 1), (20, 1, 4): (2, 1, 0), (20, 2, 4): (1, 1, 0)}


def test_lines_are_read_once_for_refined_clusters(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    lines = [(w, a) for w in range(40) for a in (w % 10, (w * 3 + 1) % 10)]
    auth = spark.createDataFrame(lines, "work_idx long, author_idx long").select("work_idx", counted.asNondeterministic()("author_idx").alias("author_idx"))
    c = spark.createDataFrame([(a // 5, a) for a in range(10)], "cluster long, author_idx long")
    assert len(persons.refined(c, authors.coauthor_evidence(c, auth), 0.02).collect()) == 10
    assert read.value == len(lines)


def test_evidence_of_clusters_of_any_size_equals_brute_force(spark):
    r = random.Random(4)
    lines = [(r.randrange(60), r.randrange(220)) for _ in range(400)] + [(None, 1), (3, None)]
    clusters = [(a % 220 // 200, a) for a in range(215)] + [(7, a) for a in range(0, 200, 40)] + [(8, 1), (None, 2), (None, 3)]
    auth = spark.createDataFrame(lines, "work_idx long, author_idx long")
    got = authors.coauthor_evidence(spark.createDataFrame(clusters, "cluster long, author_idx long"), auth).collect()
    of, co, by = defaultdict(set), defaultdict(set), defaultdict(set)
    for w, a in lines:
        if w is not None and a is not None:
            of[w].add(a)
    for g in of.values():
        for a in g:
            co[a] |= g - {a}
    for c, a in clusters:
        if c is not None:
            by[c].add(a)
    assert max(map(len, by.values())) > 2 * authors.TOGETHER
    want = {(c, a, b): (len(co[a]), len(co[b]), len(co[a] & co[b])) for c, g in by.items() for a in g for b in g if a < b}
    assert len(got) == len(want) and {(x["cluster"], x["a"], x["b"]): (x["n_a"], x["n_b"], x["n_shared"]) for x in got} == want
