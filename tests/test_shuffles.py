"""Steps on which most queries build: no copies of lines for each count, and pairs that are distinct without a shuffle of all of them."""

import itertools

from quillgraph.sources.adapters import Tables


class Given(Tables):
    def __init__(self, spark, **tables):
        super().__init__(spark, "")
        self.tables = tables

    def raw(self, name):
        return self.tables[name]


LINES = [(1, 1, 7, 3), (1, 1, 8, 3), (2, 1, 7, 3), (2, 1, 8, 4), (3, 1, 7, 3), (3, 2, 9, 5), (3, 3, 9, 3), (3, 3, None, 5), (4, 1, 8, None), (4, 1, 8, None), (5, 2, 7, 3)]


def given(spark):
    lines = spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    orders = spark.createDataFrame([(k, 1, "1-URGENT", 100.0) for k in range(1, 7)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double")
    return Given(spark, lineitem=lines, orders=orders.selectExpr("*", "DATE'1996-01-01' AS o_orderdate"))


def test_references_of_works_with_several_first_parts_are_distinct(spark):
    parts = {}
    for order, number, part, _ in LINES:
        if number == 1:
            parts.setdefault(order, set()).add(part)
    want = sorted((a, b) for a, b in itertools.permutations(parts, 2) if a > b and parts[a] & parts[b])
    assert sorted(tuple(r) for r in given(spark).references().collect()) == want


def test_distinct_ends_are_counted_without_copies(spark):
    works = given(spark).works()
    assert "Expand" not in works._jdf.queryExecution().executedPlan().toString()
    got = {r["work_idx"]: (r["authors_count"], r["institutions_distinct_count"]) for r in works.collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (2, 2), 4: (1, 0), 5: (1, 1), 6: (0, 0)}
