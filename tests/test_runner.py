"""Catalogue, records and the runner on the shared file system."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillgraph import runs
from quillgraph.model import Run
from quillgraph.operators import ranking, runner
from quillgraph.sources.catalogue import Catalogue
from quillgraph.sources.folders import Shared


def put(spark, path, n):
    spark.range(n).write.mode("overwrite").parquet(path)


def test_a_changed_input_builds_another_table(spark, tmp_path):
    src, made = f"file://{tmp_path}/in", []
    put(spark, src, 5)
    c = Catalogue(spark, f"file://{tmp_path}/tables")

    def make():
        made.append(1)
        return spark.read.parquet(src).select((F.col("id") * 2).alias("x"))

    total = lambda cat, **p: cat.table("double", [src], make, **p).agg(F.sum("x")).first()[0]
    assert [total(c), total(c), len(made)] == [20, 20, 1]
    other = Catalogue(spark, f"file://{tmp_path}/tables")  # what another application would hold
    assert [total(other), len(made)] == [20, 1]
    assert [total(c, factor=2), len(made)] == [20, 2]  # parameters tell entries apart
    put(spark, src, 7)
    assert [total(c), len(made)] == [42, 3]


def test_tables_go_when_nobody_uses_them(spark, tmp_path):
    src, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/tables"
    put(spark, src, 3)
    a, b = Catalogue(spark, folder), Catalogue(spark, folder)
    for c in (a, b):
        c.table("same", [src], lambda: spark.read.parquet(src))
    assert a.expire() == []
    a.release()
    assert a.expire() == []  # b still reads it
    b.release()
    assert a.expire(age=3600) == []  # too young
    assert len(a.expire()) == 1 and os.listdir(tmp_path / "tables") == []
    b.table("same", [src], lambda: spark.read.parquet(src))
    assert len(Catalogue(spark, folder, lease=-1.0).expire()) == 1  # its holder let the lease pass


def test_an_unfinished_build_is_no_table(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    put(spark, src, 3)
    c = Catalogue(spark, f"file://{tmp_path}/tables")
    entry = f"{c.folder}/same-{c.fingerprint('same', [src], {})}"
    spark.range(99).write.parquet(f"{entry}/data-dead")  # its builder died before the note
    assert c.table("same", [src], lambda: spark.read.parquet(src)).count() == 3


def test_records_on_the_shared_file_system(spark, tmp_path):
    f = Shared(spark)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, src, 4)
    build = lambda: spark.read.parquet(src).write.mode("overwrite").parquet(out)
    assert runs.ensure(out, [src], build, folders=f) and not runs.ensure(out, [src], build, folders=f)
    put(spark, f"file://{tmp_path}/loose", 1)
    s = runs.status(f"file://{tmp_path}", ["*"], f)
    assert s["fresh"] == [out] and sorted(map(os.path.basename, s["unmanaged"])) == ["in", "loose"]
    time.sleep(0.01)
    put(spark, src, 4)  # as large as before
    assert "changed" in runs.stale(out, [src], folders=f)[0]
    assert runs.collect_garbage(f"file://{tmp_path}", f) == [out] and not f.exists(out)


def table(spark, units, rows=2):
    d = spark.createDataFrame([(u, k) for u in units for k in range(rows)], "unit string, k long")
    return d, d.groupBy("unit").agg(F.sum("k").alias("total"))


def test_a_second_run_goes_on_where_the_first_was_killed(spark, tmp_path):
    asked = []

    def work(units):
        asked.append(units)
        if len(asked) == 2:
            raise KeyboardInterrupt  # the driver ends here
        return table(spark, units)

    at = f"file://{tmp_path}/out"
    with pytest.raises(KeyboardInterrupt):
        runner.Runner(spark, at, "v1").run(["01", "02", "03"], work, batch=1)
    r = runner.Runner(spark, at, "v1")
    assert set(r.markers()) == {"01"} and r.committed().count() == 2
    assert r.run(["01", "02", "03"], work, batch=1) == {"01": "skipped", "02": "done", "03": "done"}
    assert asked == [["01"], ["02"], ["02"], ["03"]]
    assert {x["unit"] for x in r.committed("diagnostics").collect()} == {"01", "02", "03"}
    newer = runner.Runner(spark, at, "v2")  # another basis: all is done again, nothing twice
    assert set(newer.run(["01", "02", "03"], work).values()) == {"done"} and newer.committed().count() == 6


def test_rows_without_a_marker_are_not_read(spark, tmp_path):
    r = runner.Runner(spark, f"file://{tmp_path}/out")
    r.run(["a", "b"], lambda units: table(spark, units))
    r.files.drop(f"{r.folder}/markers/b.json")  # killed between rows and marker
    assert {x["unit"] for x in r.committed().collect()} == {"a"}
    assert r.run(["a", "b"], lambda units: table(spark, units)) == {"a": "skipped", "b": "done"}
    assert r.committed().filter("unit = 'b'").count() == 2


def test_a_failed_unit_is_reported_and_leaves_the_others(spark, tmp_path):
    broken = ["b"]

    def work(units):
        if set(units) & set(broken):
            raise ValueError("no such field")
        return table(spark, units, rows=0 if units == ["c"] else 1)

    r = runner.Runner(spark, f"file://{tmp_path}/out")
    assert r.run(["a", "b", "c"], work) == {"a": "done", "b": "ValueError: no such field", "c": "done"}
    assert {x["unit"]: x["rows"] for x in r.report().collect()} == {"a": 1, "b": 0, "c": 0}
    broken.clear()
    assert r.run(["a", "b", "c"], work) == {"a": "skipped", "b": "done", "c": "skipped"}


def test_units_ranked_by_the_runner(spark, tmp_path):
    fw = "work_idx long, publication_year long, source_idx long, institution_idx long, country_code string, inst_weight double, direct_inst_weight double, subfield_idx long, field_idx long, field_weight double, leiden_idx long"
    d = spark.createDataFrame([(w, 2022, 7 + w % 3, 31 + w % 2, "NZ", 1.0, 1.0, 2501 + w % 2, 25, 1.0, 2) for w in range(12)], fw)
    refs = spark.createDataFrame([(w, (w * 5 + 1) % 12) for w in range(12)] + [(w, (w + 5) % 12) for w in range(12)], "citer_idx long, cited_idx long")
    run = Run("subfield_idx", (2501, 2502), (2020, 2024), tau_s=0.1, tau_u=0.1)
    members = {1: [2501, 2502], 2: [9999], 3: [2501, 2502]}
    r = runner.Runner(spark, f"file://{tmp_path}/out")
    assert set(r.run(["1", "2", "3"], runner.unit_rankings(d, refs, run, members, 1e-6)).values()) == {"done"}
    got = {(x["unit"], x["unit_type"], x["unit_idx"]): round(x["pi"], 5) for x in r.committed().collect()}
    want = {(str(x["group_idx"]), x["unit_type"], x["unit_idx"]): round(x["pi"], 5) for x in ranking.rank_units(d, refs, run, members, 1e-6).collect()}
    assert got == want and r.markers()["2"].rows == 0
    diag = {x["unit"]: x for x in r.committed("diagnostics").collect()}
    assert set(diag) == {"1", "3"} and (diag["1"]["n_s_cands"], diag["1"]["n_u_cands"], diag["1"]["n_s_ranked"], diag["1"]["n_u_ranked"]) == (3, 2, 3, 2) and diag["1"]["mass"] == pytest.approx(1)
