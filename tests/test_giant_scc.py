"""The giant component past the size that the driver solves."""

import pytest

from quillgraph.operators import graph


@pytest.mark.parametrize("local", [10**6, 0])
def test_hubs_in_no_cycle_do_not_hide_the_giant(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    hubs = [e for h in range(100, 122) for k in (1, 2) for e in ((1000 * h + k, h), (h, 2000 * h + k))]  # more than 20
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 1), *hubs], "src long, dst long")
    assert sorted(r[0] for r in graph.giant_scc(d).collect()) == [1, 2, 3]


@pytest.mark.parametrize("local", [10**6, 0])
def test_of_equal_components_the_busiest_node_decides(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rings = [(b + x, b + (x + 1) % 4) for b in (50, 10, 30, 70) for x in range(4)]
    out = [(32, 900), (901, 32), (902, 32), (71, 900), (903, 71), (904, 71)]  # 32 and 71 have the most ways through them
    d = spark.createDataFrame([*rings, *out], "src long, dst long")
    assert sorted(r[0] for r in graph.giant_scc(d).collect()) == [30, 31, 32, 33]
