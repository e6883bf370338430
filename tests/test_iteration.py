"""Many graphs solved at once by joins: against numpy, the driver's search for components, and runs of one group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, iteration, spectral

EDGES = "g long, src long, dst long, w double"


def chain(n, seed, degree=3, groups=1):
    """A row-normalised matrix whose units cite the next group most; strongly connected by a ring."""
    r = np.random.default_rng(seed)
    a = np.zeros((n, n))
    for i in range(n):
        near = np.flatnonzero(np.arange(n) % groups == (i + 1) % groups)
        a[i, r.choice(near, min(degree, len(near)), replace=False)] += r.random(min(degree, len(near))) + 0.5
        a[i, (i + 1) % n] += 0.3
        a[i, i] += 0.4 * (groups > 1)
    return a / a.sum(axis=1, keepdims=True)


def frames(spark, matrices):
    rows = [(g, int(i), int(j), float(a[i, j])) for g, a in matrices.items() for i, j in zip(*np.nonzero(a))]
    units = [(g, i) for g, a in matrices.items() for i in range(len(a))]
    return spark.createDataFrame(rows, EDGES), spark.createDataFrame(units, "g long, unit_idx long")


def perron(a):
    values, vectors = np.linalg.eig(a.T)
    p = np.abs(vectors[:, values.real.argmax()].real)
    return p / p.sum()


def test_many_graphs_step_together(spark):
    """One of period 2, one that loses mass, and two others; damped and not."""
    pair = np.array([[0, 1, 0], [0.25, 0, 0.75], [0, 1, 0]])
    leak = chain(12, 5)
    leak[3] = 0
    matrices = {1: chain(25, 1), 2: chain(40, 2, 4, 5), 3: pair, 4: leak}
    h, u = frames(spark, matrices)
    got = {(r["g"], r["unit_idx"]): r["pi"] for r in spectral.power(h, u, tol=1e-12, keys=["g"]).collect()}
    for g in (1, 2, 3):
        assert [got[g, i] for i in range(len(matrices[g]))] == pytest.approx(perron(matrices[g]), abs=1e-10)
    assert [got[4, i] for i in range(12)] == pytest.approx(perron(leak), abs=1e-9)
    damped = {(r["g"], r["unit_idx"]): r["pi"] for r in spectral.katz(h, u, 0.85, tol=1e-12, keys=["g"]).collect()}
    for g, a in matrices.items():
        x = np.linalg.solve(np.eye(len(a)) - 0.85 * a.T, np.ones(len(a)))
        assert [damped[g, i] for i in range(len(a))] == pytest.approx(x / x.sum(), abs=1e-10)


@pytest.mark.parametrize("n,groups", [(30, 1), (70, 5), (3, 1), (1, 1)])
def test_leading_values(spark, n, groups):
    a = chain(n, 7, 6, groups)
    h, u = frames(spark, {0: a})
    got = iteration.leading_values(h.drop("g"), u.drop("g"))
    want = sorted(np.linalg.eigvals(a.T), key=lambda z: (-round(abs(z), 9), -z.imag))[: min(4, n)]
    assert len(got) == len(want) and np.abs(np.array(got) - want).max() < 1e-6


def strong(pairs):
    """Components by brute force."""
    nodes = {x for p in pairs for x in p}
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    return {frozenset(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}


def test_giant_components_of_many_graphs(spark):
    r = np.random.default_rng(11)
    graphs = {g: sorted({(int(a), int(b)) for a, b in r.integers(0, 30, (n, 2))}) for g, n in ((1, 30), (2, 45), (3, 70))}
    graphs[4] = [(k, k + 1) for k in range(39)] + [(39, 0)]  # one long cycle
    graphs[5] = [(9, 8), (8, 9), (8, 1), (1, 2), (2, 3), (3, 1)]  # upstream of the giant lies a smaller one of greater names
    graphs[6] = [(1, 2), (2, 3)]  # no cycle
    graphs[7] = [(5, 5), (5, 6)]  # a loop
    e = spark.createDataFrame([(g, a, b) for g, ps in graphs.items() for a, b in ps], "g long, src long, dst long")
    got = {g: set() for g in graphs}
    for row in graph.giant_scc(e, ["g"]).collect():
        got[row["g"]].add(row["node"])
    for g, pairs in graphs.items():
        loops = {a for a, b in pairs if a == b}
        cyclic = [c for c in strong(pairs) if len(c) > 1 or c & loops]
        most = max(map(len, cyclic), default=0)
        assert (got[g] in [set(c) for c in cyclic if len(c) == most]) if cyclic else not got[g]


def test_steps_grow_slowly_with_length(spark, monkeypatch):
    """Equal cycles all fall in one round, and labels leap along a long one."""
    rounds, steps, real, cut = [], [], graph.components_of_roots, graph.cut
    monkeypatch.setattr(graph, "components_of_roots", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(graph, "cut", lambda df: steps.append(1) or cut(df))
    pairs = [(100 * c + k, 100 * c + (k + 1) % 100) for c in range(4) for k in range(100)]
    e = spark.createDataFrame([(0, a, b) for a, b in pairs], "g long, src long, dst long")
    assert graph.giant_scc(e, ["g"]).count() == 100 and len(rounds) == 1 and len(steps) < 60


def test_a_sweep_equals_runs_of_one_group(spark):
    import __spark_entry__ as e

    q, d = e.queries(), "/root/testdata/sf0.001"
    rows = q["sweep_variants"](spark, d).filter("group_idx = 4")
    for run, name in (("rho1", "rank_rho1"), ("beta1", "rank_beta1"), ("om1", "rank_omega1"), ("baseline", "rank_by_mask"), ("eps1", "rank_sentinel"), ("tau20", "rank_tau")):
        key = lambda df: sorted(map(str, df.select("unit_type", "unit_idx", F.round("pi", 7), F.round("v", 4)).collect()))
        assert key(rows.filter(F.col("run") == run)) == key(q[name](spark, d)), run


def test_steps_read_held_edges(spark):
    """Every cycle's plan must read the edges in memory, not make and shuffle them again."""
    h = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    units = spark.createDataFrame([(k, 1 / 3) for k in range(3)], "unit_idx long, p0 double")
    with iteration.carried_edges(h, units, ()) as held:
        for _ in range(2):
            plan = iteration.advanced(units, held, (), ["p0"], times=2)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("InMemoryTableScan") >= 2
    assert held.name not in [t.name for t in spark.catalog.listTables()]
