"""Ranks, row numbers and percentiles by blocks against plain Python, with a hot group and many ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import compare, order, stats


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(1, float(r.randint(0, 400)), r.randint(0, 1)) for _ in range(3000)]  # a hot group
    out += [(r.choice([2, 3, None]), r.choice([r.random(), 0.5, -1.0]), r.choice([0, 1, None])) for _ in range(600)]
    return out + [(4, 7.0, 1), (5, None, 0), (2, None, None)]


@pytest.fixture(scope="module", autouse=True)
def many_blocks(spark):
    """Small partitions would be merged into one block."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g int, x double, y int").repartition(5)


def ranks(xs):
    xs = np.sort(np.array(xs))
    return lambda x: (np.searchsorted(xs, x, "left") + np.searchsorted(xs, x, "right") + 1) / 2


def test_average_ranks_by_blocks(table, rows):
    for keys in ([], ["g"]):
        got = order.average_rank(table, keys, "x", "r").collect()
        assert len(got) == len(rows)
        at = {g: ranks([x for k, x, _ in rows if x is not None and (not keys or k == g)]) for g in {k for k, _, _ in rows}}
        assert all(r["r"] == (None if r["x"] is None else at[r["g"]](r["x"])) for r in got)


def test_blocks_split_a_hot_group(table):
    d = order.in_blocks(table.filter("x IS NOT NULL").groupBy("g", "x").count(), "g", "x")
    assert d.filter("g = 1").select("_block").distinct().count() > 1


def test_numbers_follow_the_order(spark, table):
    got = order.numbered(table.select("g", "x").distinct(), [F.desc_nulls_last("x"), F.asc_nulls_first("g")], "k").orderBy("k").collect()
    key = lambda r: (r["x"] is None, -(r["x"] or 0), r["g"] is not None, r["g"] or 0)
    assert [r["k"] for r in got] == list(range(1, len(got) + 1)) and sorted(got, key=key) == got
    assert order.numbered(spark.createDataFrame([], "x int"), ["x"], "k").count() == 0


def test_percentiles_are_linear(spark, table, rows):
    for keys in ([], ["g"]):
        got = order.percentiles(table, keys, "x", a=F.lit(0.9), b=F.greatest(F.lit(0.0), 1 - 20.0 / F.col("total"))).collect()
        for r in got:
            xs = [x for g, x, _ in rows if x is not None and (not keys or g == r["g"])]
            assert r["a"] == pytest.approx(np.quantile(xs, 0.9)) and r["b"] == pytest.approx(np.quantile(xs, max(0, 1 - 20 / len(xs))))
        assert len(got) == (5 if keys else 1)
    assert order.percentiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", a=F.lit(0.5)).count() == 0


def test_rank_sums_and_significance(table, rows):
    pairs = [(x, y) for _, x, y in rows if x is not None and y is not None]
    one, nil = ([x for x, y in pairs if y == k] for k in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in one for b in nil)
    a = stats.auc(table, "y", "x").first()
    assert (a["n_pos"], a["n_neg"]) == (len(one), len(nil)) and a["auc"] == pytest.approx(wins / len(one) / len(nil))
    t = compare.two_groups(table, "y", "x").first()
    tied = np.unique([x for x, _ in pairs], return_counts=True)[1].astype(float)
    assert t["u"] == pytest.approx(wins) and t["ties"] == pytest.approx((tied**3 - tied).sum())
    by = {r["g"]: r["auc"] for r in compare.group_auc(table, "g", "y", "x").collect()}
    one, nil = ([x for g, x, y in rows if g == 1 and y == k] for k in (1, 0))
    assert by[4] is None and by[1] == pytest.approx(sum((a > b) + (a == b) / 2 for a in one for b in nil) / len(one) / len(nil))
    p = compare.significance(table.filter("g = 1").withColumn("bad", (F.col("x") % 2).cast("int")), "y", "x", "bad").first()
    m1, m0 = np.array(one), np.array(nil)
    z = (m1.mean() - m0.mean()) / np.sqrt(m1.var(ddof=1) / len(m1) + m0.var(ddof=1) / len(m0))
    assert p["t_p"] == pytest.approx(compare.normal_tail(z), abs=5e-3) and p["u_p"] == pytest.approx(p["t_p"], abs=0.05) and p["fisher_p"] == pytest.approx(p["chi2_p"], abs=0.02)
    lone = compare.significance(table.filter("g = 4").withColumn("bad", F.lit(0)), "y", "x", "bad").first()
    assert tuple(lone) == (None,) * 4
