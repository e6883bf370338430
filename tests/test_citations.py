"""Hand-computed cases of the citation analytics, and a sample of queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names, stats
from quillgraph.model import Corpus, Run
from quillgraph.operators import authors, corpus, edges, graph, iteration, spectral, works
from quillgraph.sources.shared import stored

FW = "work_idx long, publication_year long, source_idx long, institution_idx long, country_code string, inst_weight double, direct_inst_weight double, subfield_idx long, field_idx long, field_weight double, leiden_idx long"


@pytest.fixture(scope="module")
def toy(spark):
    """Works 11 to 15 of field 25: sources 7, 7, 8, 9, 8; all of institution 31 but 14, which is of 32. Source 9 and
    institution 32 are too small. Citations 11-12, 11-13, 11-15, 11-14, 13-12, 15-11; so R is 3, 1, 1 and its mean 5/3."""
    rows = [(w, 2022, s, u, c, 1.0, 1.0, 2501, 25, 1.0, 2) for w, s, u, c in ((11, 7, 31, "NZ"), (12, 7, 31, "NZ"), (13, 8, 31, "NZ"), (14, 9, 32, "FJ"), (15, 8, 31, "NZ"))]
    refs = spark.createDataFrame([(11, 12), (11, 13), (11, 15), (11, 14), (13, 12), (15, 11)], "citer_idx long, cited_idx long")
    sc = spark.createDataFrame([(25, 7, 70.0), (25, 8, 80.0), (25, 9, 5.0)], "group_idx long, source_idx long, weighted_works double")
    ic = spark.createDataFrame([(25, 31, 150.0), (25, 32, 5.0)], "group_idx long, institution_idx long, weighted_works double")
    return spark.createDataFrame(rows, FW), refs, sc, ic


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("options,expected", [({}, {7: 35 / 9, 8: 10 / 9}), ({"rho": 1}, {7: 3.0, 8: 2.0}), ({"beta": 1}, {7: 10 / 3, 8: 10 / 9})])
def test_block_weights(toy, options, expected):
    fw, refs, sc, ic = toy
    run = Run("field_idx", (25,), **options)
    s, u = edges.retained(sc, ic, run, 25)
    el = edges.edge_list(fw, refs, run, s, u)
    assert el.count() == 5
    got = {r["dst"]: r["w"] for r in edges.blocks(el, s, u, run).blocks["is"].collect()}
    assert got == pytest.approx(expected)


def test_sentinel_edges_and_masked_score(toy):
    fw, refs, sc, ic = toy
    run = Run("field_idx", (25,), epsilon=1)
    s, u = edges.retained(sc, ic, run, 25)
    el = stored(edges.edge_list(fw, refs, run, s, u))
    assert el.filter("cited_source_idx = 1").count() == 1
    raw = edges.blocks(el, s, u, run)
    b = edges.giant(edges.Blocks({k: stored(d) for k, d in raw.blocks.items()}, stored(raw.sources), stored(raw.institutions)), run)
    b = edges.Blocks({k: stored(d) for k, d in b.blocks.items()}, stored(b.sources), stored(b.institutions))
    assert {r[0] for r in b.sources.select("unit_idx").collect()} == {1, 7, 8}  # the sentinel, which nothing leaves, stays
    r = as_dict(spectral.rank(b, run, 1e-6), "unit_type", "unit_idx")
    assert r["S", 1]["v"] is None and sum(x["pi"] for x in r.values()) == pytest.approx(1)
    real = [x for k, x in r.items() if k[1] != 1]
    assert sum(x["v"] * x["a_p"] for x in real) == pytest.approx(sum(x["a_p"] for x in real))  # over both sides together


def test_priors_and_joint_scaling(spark):
    unit = lambda *x: spark.createDataFrame([(k, float(k)) for k in x], "unit_idx long, a_p double")
    s, u = spectral.joint_prior(unit(1, 2, 3), unit(4), "uniform")
    assert {r["pi"] for r in s.union(u).collect()} == {0.25}
    s, u = spectral.joint_prior(unit(1, 2, 3), unit(4), "unit_scaled")
    assert {round(r["pi"], 9) for r in s.collect()} == {round(1 / 6, 9)} and u.first()["pi"] == 0.5
    one = spark.createDataFrame([(2, 2, 1.0)], "src long, dst long, w double")
    b = edges.Blocks({k: one for k in ("ss", "si", "is", "ii")}, unit(2), unit(2, 5, 6))
    h, us = spectral.joint_graph(b)
    assert {(r["src"], r["dst"]): r["w"] for r in h.collect()} == pytest.approx({(4, 4): 1.0, (4, 5): 3 / 16, (5, 4): 3 / 16, (5, 5): 1.0}) and us.count() == 4


@pytest.mark.parametrize("local", [10**6, 0])
def test_damped_scores_of_both_sides(spark, monkeypatch, local):
    """One source and one institution more than the chain between sources 1, 2 and institutions 3, 4 keeps apart."""
    monkeypatch.setattr(spectral, "LOCAL_EDGES", local)
    si = spark.createDataFrame([(1, 3, 1.0), (2, 3, 1.0), (2, 4, 1.0)], "src long, dst long, w double")
    is_ = spark.createDataFrame([(3, 1, 1.0), (4, 2, 1.0)], "src long, dst long, w double")
    unit = lambda *x: spark.createDataFrame([(k, 1.0) for k in x], "unit_idx long, a_p double")
    a, m = 0.5, 0.25
    # by hand: the prior of sources is m + a m each, scaled to a half each; x1 = a^2 (x1 + x2 / 2) + (1 - a^2) / 2
    x2 = (1 - a * a) / 2 / (1 - a * a / 2)
    x1 = 1 - x2
    u = [a * (x1 + x2 / 2) + (1 - a) * m, a * x2 / 2 + (1 - a) * m]
    s, i = spectral.bipartite(si, is_, unit(1, 2), unit(3, 4), a)
    assert {r["unit_idx"]: r["pi"] for r in s.collect()} == pytest.approx({1: x1 / 2, 2: x2 / 2}, abs=1e-6)
    assert {r["unit_idx"]: r["pi"] for r in i.collect()} == pytest.approx({3: u[0] / sum(u) / 2, 4: u[1] / sum(u) / 2}, abs=1e-6)


def test_bloc_keeps_unknown_countries(toy):
    fw = toy[0].withColumn("country_code", F.when(F.col("work_idx") == 12, None).otherwise(F.col("country_code")))
    assert {r[0] for r in edges.bloc_excluded(fw, Run("field_idx", (25,)), frozenset({"NZ"})).collect()} == {14}


def test_author_fractions(spark):
    """Three authors of one work: one at three places, one at the first of them, one at a fourth that nobody knows."""
    rows = [(7, 90, 41), (7, 90, 42), (7, 90, 43), (7, 91, 41), (7, 92, 44), (7, None, 42)]
    auth = spark.createDataFrame(rows, "work_idx long, author_idx long, institution_idx long")
    inst = spark.createDataFrame([(41, "PT"), (42, "PE"), (43, None)], "institution_idx long, country_code string")
    got = as_dict(corpus.inst_weights(auth, inst), "institution_idx")
    # two authors remain, a half each: the first's is split in three
    assert {k[0]: r["inst_weight"] for k, r in got.items()} == pytest.approx({41: 1 / 6 + 1 / 2, 42: 1 / 6, 43: 1 / 6})
    assert {r["direct_inst_weight"] for r in got.values()} == {1 / 3}


def test_nested_topics_and_references(spark):
    t = spark.createDataFrame([(1, [(7, 0.6), (8, 0.4)])], "work_idx long, topics array<struct<topic_idx:long,score:float>>")
    meta = spark.createDataFrame([(7, ("x/subfields/1102", "A"), ("x/fields/11", "F")), (8, ("x/subfields/1302", "B"), ("x/fields/13", "G"))], "topic_idx long, subfield struct<id:string,display_name:string>, field struct<id:string,display_name:string>")
    got = as_dict(corpus.topic_weights(corpus.topic_layout(t, meta)), "field_idx")
    assert got[11,]["field_weight"] == pytest.approx(0.6, abs=1e-6)
    refs = spark.createDataFrame([(1, [2, 9, 1])], "citer_idx long, cited_list array<long>")
    w = spark.createDataFrame([(1,), (2,)], "work_idx long")
    assert sorted(map(tuple, corpus.corpus_references(refs, w).collect())) == [(1, 1), (1, 2)]


def test_candidacy_counts_a_source_once(spark):
    """A work of three institutions and two subfields, a smaller one, and one before the window."""
    rows = [(3, 1999, 60, u, "CL", w, 1 / 3, s, 25, f, 2) for u, w in ((71, 0.5), (72, 0.375), (73, 0.125)) for s, f in ((2501, 0.5), (2502, 0.25))]
    rows += [(4, 2001, 60, 72, "CL", 1.0, 1.0, 2501, 25, 0.125, 2), (5, 1990, 60, 71, "CL", 1.0, 1.0, 2501, 25, 1.0, 2)]
    s, u = corpus.candidacy(spark.createDataFrame(rows, FW), "field_idx", (1995, 2001))
    assert s.first()["weighted_works"] == 0.75 + 0.125
    assert {k[0]: r["weighted_works"] for k, r in as_dict(u, "institution_idx").items()} == {71: 0.375, 72: 0.75 * 0.375 + 0.125, 73: 0.75 * 0.125}


@pytest.mark.parametrize("local", [10**6, 0])
def test_toy_graphs(spark, monkeypatch, local):
    monkeypatch.setattr(spectral, "LOCAL_EDGES", local)
    k3 = spark.createDataFrame([(a, b, 1.0) for a in range(3) for b in range(3) if a != b], "src long, dst long, w double")
    units = spark.createDataFrame([(k, 1.0) for k in range(3)], "unit_idx long, a_p double")
    assert [r["pi"] for r in spectral.power(k3, units).collect()] == pytest.approx([1 / 3] * 3)
    k22 = spark.createDataFrame([(a, b, 1.0) for a in (0, 1) for b in (0, 1)], "src long, dst long, w double")
    two = units.filter("unit_idx < 2")
    for side in spectral.bipartite(k22, k22, two, two):
        assert [r["pi"] for r in side.collect()] == pytest.approx([0.25, 0.25])


@pytest.mark.parametrize("local", [10**6, 0])
def test_katz_returns_dangling_mass(spark, monkeypatch, local):
    """With damping a half a unit that points to one without links has m = (x / 2 + 1 / 2) / 2 of x there, where x is m and a half m."""
    monkeypatch.setattr(spectral, "LOCAL_EDGES", local)
    h = spark.createDataFrame([(5, 6, 2.0)], "src long, dst long, w double")
    units = spark.createDataFrame([(5, 1.0), (6, 1.0)], "unit_idx long, a_p double")
    got = {r["unit_idx"]: r["pi"] for r in spectral.katz(h, units, 0.5).collect()}
    assert got == pytest.approx({5: 0.4, 6: 0.6}, abs=1e-7)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.connected_components(e.select("a").union(e.select("b")), e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)], "src long, dst long")
    assert sorted(r[0] for r in graph.giant_scc(d).collect()) == [1, 2, 3]


def test_ranking_is_cut_to_the_giant_component(spark):
    cycle = [(1, 2), (2, 3), (3, 1), (2, 1), (3, 9), (8, 1)]  # 9 is a sink, 8 is never reached
    units = spark.createDataFrame([(k, 1.0) for k in (1, 2, 3, 7, 8, 9)], "unit_idx long, a_p double")
    h = spark.createDataFrame([(a, b, 1.0) for a, b in cycle], "src long, dst long, w double")
    b = edges.Blocks({"ii": h}, units, units)
    g = edges.giant(b, Run(mask="0001"))
    assert sorted(r[0] for r in g.institutions.select("unit_idx").collect()) == [1, 2, 3] and g.sources.count() == 6
    assert sorted((r["src"], r["dst"]) for r in g.blocks["ii"].collect()) == sorted(cycle[:4])
    si = spark.createDataFrame([(1, 4, 1.0), (5, 4, 1.0)], "src long, dst long, w double")
    is_ = spark.createDataFrame([(4, 5, 1.0), (4, 6, 1.0)], "src long, dst long, w double")
    unit = lambda *x: spark.createDataFrame([(k, 1.0) for k in x], "unit_idx long, a_p double")
    for epsilon, want in ((0, [5]), (1, [1, 5])):  # the sentinel, 1, lies outside the component
        g = edges.giant(edges.Blocks({"si": si, "is": is_}, unit(1, 5, 6), unit(4, 7)), Run(epsilon=epsilon))
        assert sorted(r[0] for r in g.sources.select("unit_idx").collect()) == want and [r[0] for r in g.institutions.collect()] == [4]


@pytest.mark.parametrize("local", [10**6, 0])
def test_rankings_reach_the_tolerance_or_fail(spark, monkeypatch, local):
    monkeypatch.setattr(spectral, "LOCAL_EDGES", local)
    # two pairs hardly joined, of period 2
    slow = [(0, 1, 0.95), (1, 0, 0.95), (2, 3, 0.85), (3, 2, 0.85), (0, 3, 0.05), (1, 2, 0.05), (2, 1, 0.15), (3, 0, 0.15)]
    h = spark.createDataFrame(slow, "src long, dst long, w double")
    units = spark.createDataFrame([(k, 1.0) for k in range(4)], "unit_idx long, a_p double")
    want = {0: 0.375, 1: 0.375, 2: 0.125, 3: 0.125}
    b = edges.Blocks({"ii": h}, units, units)
    got = {r["unit_idx"]: r["pi"] for r in spectral.rank(b, Run(mask="0001")).collect()}
    assert got == pytest.approx(want, abs=1e-7)
    one = spark.createDataFrame([(k, k, 1.0) for k in range(4)], "src long, dst long, w double")
    assert {r["unit_idx"]: r["pi"] for r in spectral.bipartite(h, one, units, units)[0].collect()} == pytest.approx({k: x / 2 for k, x in want.items()}, abs=1e-7)
    path = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 3.0), (2, 1, 1.0)], "src long, dst long, w double")
    got = {r["unit_idx"]: r["pi"] for r in spectral.power(path, units.filter("unit_idx < 3")).collect()}
    assert got == pytest.approx({0: 0.125, 1: 0.5, 2: 0.375}, abs=1e-7)  # of period 2
    monkeypatch.setattr(iteration, "MOST", 5)
    for f in (lambda: spectral.power(h, units, tol=0), lambda: spectral.bipartite(h, h, units, units, tol=0)):
        with pytest.raises(iteration.NotConverged):
            f()


def test_flagship_ranks_the_giant_component(spark):
    from quillgraph.plans import queries as q

    d = "/root/testdata/sf0.001"
    assert q.flagship(spark, d).count() == 10
    s = {r[0] for r in q.QUERIES["giant_scc"](spark, d).collect()}
    assert {r[0] for r in q.QUERIES["power_ss"](spark, d).collect()} == s


def test_hcw_all_equal_are_flagged(spark):
    w = spark.createDataFrame([(17, k, 2020, 0) for k in range(5)], "field_idx long, work_idx long, publication_year long, n_intra long")
    assert works.hcw_flags(w).filter("is_hcw").count() == 5


def test_names(spark):
    d = spark.createDataFrame([("Zoë  Brontë",), ("Óscar Ruiz‑Peña",)], "n string")
    got = [r[0] for r in d.select(names.last_norm(names.folded(names.clean_name(F.col("n"))))).collect()]
    assert got == ["bronte", "ruiz-pena"]


def test_statistics(spark):
    d = spark.createDataFrame([(float(x), float(2 * x + (x % 3))) for x in range(20)], "x double, y double")
    fit = stats.ols(d, ["x"], "y")
    assert fit["coef"][1] == pytest.approx(2, abs=0.05) and fit["p"][1] < 1e-10
    assert stats.t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert sum(stats.shapley_r2(d, ["x"], "y").values()) == pytest.approx(fit["r2"])


def test_calibration_is_a_linear_quantile(spark):
    d = spark.createDataFrame([(1, float(k)) for k in range(11)], "field_idx long, n double")
    assert authors.calibrated(d, 1, "n").first()["threshold"] == pytest.approx(10 * (1 - 1 / 11))


def test_run_checks_its_parameters():
    assert Run(tau_s=2, window=(2020, 2024)).least_s == 10 and math.isclose(Corpus((2016, 2025), ("article",), ("journal",)).max_authors, 29)
    with pytest.raises(ValueError):
        Run(mask="2222")


@pytest.mark.parametrize("name", ["flat_works", "edge_list_epsilon", "bipartite_unit_scaled", "rank_joint", "rank_sentinel", "hcw_flags", "waterfall_match", "enclave_networks"])
def test_query_against_sql(spark, name):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = e.queries()[name](spark, d).toPandas(), con.execute(e.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda f: sorted(map(str, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
