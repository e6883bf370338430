"""Tests of significance, sinks and readers, schedule and records, topics, and a group ranked end to end."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillgraph import runs
from quillgraph.functions import compare
from quillgraph.model import Run
from quillgraph.operators import edges, enclaves, ranking, spectral
from quillgraph.sources import files
from quillgraph.sources.shared import stored


def test_p_values():
    assert compare.t_test_p(2.0, 10, 12) == pytest.approx(0.0593, abs=2e-4)
    assert compare.fisher_p([[3, 1], [1, 3]]) == pytest.approx(34 / 70) and compare.fisher_p([[5, 0], [0, 5]]) == pytest.approx(2 / 252)
    assert compare.chi2_p([[10, 20], [30, 40]]) == pytest.approx(0.5040, abs=2e-3)
    assert compare.mann_whitney_p(2, 5, 5, 0) == pytest.approx(0.0367, abs=2e-3)


def test_tiers_codes_and_logs(spark):
    d = spark.createDataFrame([(1.4, 5), (1.39, 4), (0.8, 3), (0.5, 2), (0.1, 1), (None, None)], "v double, t int")
    assert all(r["t"] == r["x"] for r in d.withColumn("x", compare.tier(F.col("v"))).collect())
    logs = [r[0] for r in spark.createDataFrame([(10.0,), (0.0,), (None,)], "v double").select(compare.floored_log10(F.col("v"))).collect()]
    assert logs == [1.0, -3.0, None]
    c = spark.createDataFrame([(" A ", "1", "3"), ("B", "101", "5"), ("C", "0101", "n/a"), ("D", "12", "1 ")], "hep string, code string, value string")
    assert sorted(map(tuple, compare.rating_codes(c).collect())) == [("A", "01", 3), ("B", "0101", 5), ("D", "12", 1)]


def test_schedule_and_blocs(tmp_path):
    head = "skip,tc0,tc1,tt0,tt1,tau_u,tau_s,rho,omega,m,chi,alpha,mu_type,label,epsilon,beta,bloc\n"
    p = tmp_path / "s.csv"
    p.write_text(head + "0,2020,2024,2020,2024,5,6,1,0,0110,0.5,1.0,,first,0,0,\n1,2020,2024,,,1,1,0,0,0110,0.5,1.0,,no,0,0,\n0,2019,2020,,,1,1,0,0,1111,-1,0.9,uniform,damped,1,1,OECD\n")
    a, b = runs.schedule(str(p))
    assert (a.label, a.run.rho, a.run.least_s, a.name) == ("first", 1, 30.0, "2020_2024_first") and (b.bloc, b.run.alpha, b.run.prior, b.run.epsilon) == ("OECD", 0.9, "uniform", 1)
    for bad in ("0,2020,2024,,,1,1,0,0,0111,0,1.0,,x,0,0,", "0,2020,2024,,,1,1,0,0,0110,0,0.5,,x,0,0,", "0,2020,2024,,,1,1,0,0,0110,0,1.0,uniform,x,0,0,"):
        p.write_text(head + bad + "\n")
        with pytest.raises(ValueError, match="line 2"):
            runs.schedule(str(p))
    found = runs.blocs([("OECD", "AU"), ("OECD", "US "), ("G20", "CN"), (None, "XX")])
    assert found["OECDG20"] == {"AU", "US", "CN"} and found["OECDG20-CIA"] == {"AU"} and found["AU"] == {"AU"}


def test_records_of_builds(tmp_path):
    src, out, built = tmp_path / "in.txt", str(tmp_path / "out.txt"), []

    def build():
        built.append(1)
        open(out, "w").write("x")

    src.write_text("1")
    assert runs.stale(out, [str(src)]) == ["output does not exist"]
    assert runs.ensure(out, [str(src)], build) and not runs.ensure(out, [str(src)], build) and len(built) == 1
    os.utime(src, (time.time() + 5, time.time() + 5))
    assert "changed" in runs.stale(out, [str(src)])[0]
    assert not runs.ensure(out, [str(src)], build, allow=lambda o, s: False)
    assert runs.ensure(out, [str(src)], build, allow=lambda o, s: s is not None)
    assert "not in the record" in runs.stale(out, [str(src), str(tmp_path / "out.txt")])[0]
    (tmp_path / "loose.txt").write_text("y")
    s = runs.status(str(tmp_path), ["*.txt"])
    assert s["fresh"] == [out] and sorted(map(os.path.basename, s["unmanaged"])) == ["in.txt", "loose.txt"]
    src.unlink()
    assert "missing" in runs.stale(out, [str(src)])[0]
    assert runs.collect_garbage(str(tmp_path)) == [out] and not os.path.exists(out)

    def work(n):
        if n == "b":
            raise RuntimeError("no")

    assert runs.each("abc", lambda n: n == "a", work) == {"a": "skipped", "b": "RuntimeError: no", "c": "done"}


def test_readers_and_sinks(spark, tmp_path):
    d = spark.range(30).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") / 2).alias("x"))
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    files.write_parquet(d, a, ["g", "id"], 2)
    files.write_parquet(d, b)
    assert files.parquet(spark, a, b).count() == 60 and files.parquet(spark, str(tmp_path / "*.parquet")).count() == 60
    parts = [[(r["g"], r["id"]) for r in spark.read.parquet(f"{a}/{f}").collect()] for f in sorted(os.listdir(a)) if f.endswith(".parquet")]
    assert sum(parts, []) == sorted((r["g"], r["id"]) for r in d.collect())
    files.write_csv(d, str(tmp_path / "c"))
    assert files.delimited(spark, str(tmp_path / "c"), "id long, g long, x double").agg(F.sum("x")).first()[0] == 217.5
    (tmp_path / "t.tsv").write_text("k\tv\na\t1\n")
    assert files.delimited(spark, str(tmp_path / "t.tsv"), "k string, v long", "\t").first()["v"] == 1
    (tmp_path / "s.yaml").write_text("corpus: {year_min: 2000}\n")
    assert files.settings(str(tmp_path / "s.yaml"))["corpus"]["year_min"] == 2000
    (tmp_path / "r.json").write_text(json.dumps({"P1": {"committee_name": "One", "chair": {"name": "A B", "affiliation": "X"}, "members": [{"name": "C D", "affiliation": "Y"}]}, "P2": {"committee_name": "Two", "chair": None}}))
    assert sorted(map(tuple, files.rosters(spark, str(tmp_path / "r.json")).collect())) == [("P1", "One", "Chair", "A B", "X"), ("P1", "One", "Member", "C D", "Y")]
    r = spark.createDataFrame([('{"id": "W1", "title": "T", "publication_year": 2001, "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": "B"}}], "abstract_inverted_index": {"x": [0]}}',)], "value string")
    got = files.records(r).first()
    assert (got["work_id"], got["year"], got["authors"], got["venue"], got["abstract_index"]) == ("W1", 2001, "A; B", None, {"x": [0]})
    small = spark.createDataFrame([("a|b_c", 1.5, 2000)], "k string, x double, n long")
    assert "| a\\|b_c | 1.500 | 2,000 |" in files.markdown(small, "T") and r"a|b\_c & 1.500 & 2,000 \\" in files.latex(small, "C", "tab:t")
    with pytest.raises(ValueError):
        files.markdown(d, "T", most=5)
    files.write_json({"a": 1}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": 1}


def test_topics(spark):
    t = spark.createDataFrame([(20, 1, "x, y"), (20, 3, "z"), (11, 1, "q")], "field_idx long, topic_idx long, topic_label string")
    got = sorted(map(tuple, enclaves.topic_names(t, 20, [[3, 1]], {1: "one"}).select("field_idx", "topic_idx", "topic_name").collect()))
    assert got == [(11, 1, ""), (20, 1, "one"), (20, 1, "one")]
    assert "  1: n=1  x, y" in enclaves.topic_prompt(t, 20, "Economics")


def test_group_end_to_end(spark):
    fw = "work_idx long, publication_year long, source_idx long, institution_idx long, country_code string, inst_weight double, direct_inst_weight double, subfield_idx long, field_idx long, field_weight double, leiden_idx long"
    rows = [(w, 2022, 7 + w % 3, 31 + w % 2, "NZ", 1.0, 1.0, 2501 + w % 2, 25, 1.0, 2) for w in range(12)]
    refs = spark.createDataFrame([(w, (w * 5 + 1) % 12) for w in range(12)] + [(w, (w + 5) % 12) for w in range(12)], "citer_idx long, cited_idx long")
    run = Run("subfield_idx", (2501, 2502), (2020, 2024), tau_s=0.1, tau_u=0.1)
    d = spark.createDataFrame(rows, fw)
    out = ranking.rank_units(d, refs, run, {1: [2501, 2502], 2: [9999], 3: [2501, 2502]}).collect()
    r, again = ([x for x in out if x["group_idx"] == k] for k in (1, 3))  # units may share their subfields
    assert {x["group_idx"] for x in out} == {1, 3} and sum(x["pi"] for x in r) == pytest.approx(1) and min(x["rank_v"] for x in r) == 1
    assert {(x["unit_type"], x["unit_idx"], round(x["v"], 6)) for x in r} == {(x["unit_type"], x["unit_idx"], round(x["v"], 6)) for x in again}
    cands = ranking.unit_candidates(d, run.window, {1: [2501, 2502]})
    b = ranking.group_blocks(d, refs, cands, run, 1, keep=stored)
    b = edges.Blocks({k: stored(x) for k, x in b.blocks.items()}, stored(b.sources), stored(b.institutions))
    diag = ranking.diagnostics(b, cands, run, 1)
    assert (diag["n_s_cands"], diag["n_u_cands"]) == (3, 2) and diag["lam1"] == pytest.approx(1) and abs(diag["lam2"]) < 1
    v = ranking.variants(run)
    assert set(v) == {"tau20", "rho1", "eps1", "om1", "beta1"} and v["tau20"].tau_s == 0.2
