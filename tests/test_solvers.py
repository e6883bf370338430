"""Graphs that a task holds are solved there, to the same scores as by joins."""

import numpy as np
import pytest

from quillgraph.operators import graph, iteration, solvers, spectral


def graphs(spark, n=12):
    r = np.random.default_rng(3)
    rows = [(g, a, b, float(r.random() + 0.1)) for g in (1, 2) for a in range(n) for b in range(n) if b == (a + 1) % n or r.random() < 0.3]
    units = spark.createDataFrame([(g, a, 1.0) for g in (1, 2) for a in range(n)], "g long, unit_idx long, a_p double")
    return spark.createDataFrame(rows, "g long, src long, dst long, w double"), units


def scores(df):
    return {(r["g"], r["unit_idx"]): r["pi"] for r in df.collect()}


def perron(m):
    x = np.full(len(m), 1 / len(m))
    for _ in range(2_000):
        x = 0.1 * x + 0.9 * m.T @ x
    return x / x.sum()


def test_small_graphs_take_no_step_by_joins(spark, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("a step by joins")

    monkeypatch.setattr(iteration, "advanced", never)
    monkeypatch.setattr(graph, "spread", never)
    h, u = graphs(spark)
    dense = {}
    for g in (1, 2):
        m = np.zeros((12, 12))
        for r in h.filter(h.g == g).collect():
            m[r["src"], r["dst"]] = r["w"]
        dense[g] = m / m.sum(axis=1, keepdims=True)
    want = lambda f, to: {(g, k): to * x for g, m in dense.items() for k, x in enumerate(perron(f(m)))}
    assert scores(spectral.power(h, u, tol=1e-12, keys=["g"])) == pytest.approx(want(lambda m: m, 1), abs=1e-9)
    assert scores(spectral.bipartite(h, h, u, u, tol=1e-12, keys=["g"])[0]) == pytest.approx(want(lambda m: m @ m, 0.5), abs=1e-9)
    assert sorted((r["g"], r["node"]) for r in graph.giant_scc(h, ["g"]).collect()) == [(g, k) for g in (1, 2) for k in range(12)]
    values = iteration.leading_values(h.filter("g = 1").drop("g"), u.filter("g = 1").drop("g"), 3, 1e-6, 10**6)
    assert np.abs(values) == pytest.approx(np.sort(np.abs(np.linalg.eigvals(dense[1])))[::-1][:3], abs=1e-5)


def test_graphs_part_by_size(spark, monkeypatch):
    h, u = graphs(spark)
    h = h.filter("g = 1 OR dst = (src + 1) % 12")  # the second graph is a ring
    monkeypatch.setattr(spectral, "LOCAL_EDGES", 24)
    both = scores(spectral.power(h, u, tol=1e-12, keys=["g"]))
    monkeypatch.setattr(spectral, "LOCAL_EDGES", 10**6)
    assert both == pytest.approx(scores(spectral.power(h, u, tol=1e-12, keys=["g"])), abs=1e-9) and len(both) == 24


def test_the_giant_of_many_small_components_comes_in_linear_time(spark):
    n = 60_000  # rings of two and one of three; peeling one component after the other took the square of their number
    src = np.arange(2 * n)
    dst = src ^ 1
    src, dst = np.append(src, [2 * n, 2 * n + 1, 2 * n + 2]), np.append(dst, [2 * n + 1, 2 * n + 2, 2 * n])
    assert solvers.giant(src, dst).tolist() == [2 * n, 2 * n + 1, 2 * n + 2]
