"""Factors by joins against dense coordinate descent from the same start."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import text


def dense(w, a, b, sweeps, passes):
    def one(x, p, g):
        for j in [*range(x.shape[1])] * passes:
            if g[j, j] > 0:
                x[:, j] = np.maximum(0, x[:, j] + (p[:, j] - x @ g[:, j]) / g[j, j])

    for _ in range(sweeps):
        one(a, w @ b, b.T @ b)
        one(b, w.T @ a, a.T @ a)
    return a, b


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for g, n in ((1, 45), (2, 130), (3, 29)):  # 2 topics, 6, and too few documents for any
        for d in range(n):
            kind = d % 3
            terms = {f"t{kind}{r.randint(0, 9)}" for _ in range(6)} | {f"all{r.randint(0, 3)}"}
            out += [(g, d, t, r.uniform(0.2, 1)) for t in sorted(terms)]
    return out


def test_factors_equal_dense_descent(spark, rows):
    w = spark.createDataFrame(rows, "group long, doc long, term string, w double").repartition(3)
    start = text.factors(w, text.Topics(sweeps=0))
    got = text.factors(w, text.Topics(sweeps=2, tol=-1.0))
    errors = []
    for g, k in ((1, 2), (2, 6)):
        key = lambda df, c: {r[c]: np.array(r[-1]) for r in df.filter(f"group = {g}").collect()}
        (a0, b0), (a1, b1) = ((key(x[0], "doc"), key(x[1], "term")) for x in (start, got))
        docs, terms = sorted(a0), sorted(b0)
        m = np.zeros((len(docs), len(terms)))
        for h, d, t, x in rows:
            if h == g:
                m[docs.index(d), terms.index(t)] = x
        a, b = dense(m, np.stack([a0[d] for d in docs]), np.stack([b0[t] for t in terms]), 2, 3)
        assert a.shape[1] == k and a.min() >= 0
        assert np.allclose(a, np.stack([a1[d] for d in docs])) and np.allclose(b, np.stack([b1[t] for t in terms]))
        errors.append(((m - a @ b.T) ** 2).sum() / (m**2).sum())
    assert max(errors) < 0.9 and not got[0].filter("group = 3").count()


def test_topics_part_the_kinds(spark):
    w = spark.createDataFrame([(7, d, f"t{d % 4 == 0}{k}", 0.5) for d in range(40) for k in range(4)], "group long, doc long, term string, w double")
    n = text.nmf(w, text.Topics(sweeps=4)).collect()
    assert len(n) == 40 and {(r["doc"] % 4 == 0, r["topic"], r["label"]) for r in n} == {(True, 1, "tTrue0, tTrue1, tTrue2, tTrue3, tFalse0"), (False, 0, "tFalse0, tFalse1, tFalse2, tFalse3, tTrue0")}
    assert text.nmf(w.filter("doc < 20")).count() == 0


def test_weights_are_computed_once_and_stay_with_their_documents(spark, rows, monkeypatch):
    read, shuffles = spark.sparkContext.accumulator(0), {}

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    def products(*args):
        found = made(*args)
        shuffles[args[3]] = found._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].count("Exchange hashpartitioning")
        return found

    made = text._products
    monkeypatch.setattr(text, "_products", products)
    w = spark.createDataFrame(rows, "group long, doc long, term string, w double").withColumn("w", counted.asNondeterministic()("w"))
    text.factors(w, text.Topics(sweeps=1, together=1))
    assert read.value == len(rows)
    assert shuffles == {"doc": 0, "term": 1}
