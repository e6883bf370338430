"""Near-dedup: what the driver broadcasts does not grow with the corpus."""

from pyspark.sql import functions as F

from quillgraph.llm import common, minhash


def test_only_hot_keys_of_a_large_table_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 50)
    df = spark.range(4000).select(F.when(F.col("id") < 3000, F.lit(7).cast("long")).otherwise(F.col("id")).alias("node"), "id")
    dim = spark.range(4000).select(F.col("id").alias("node"), (F.col("id") * 2).alias("x"))
    out = minhash.spread_join(df, dim, "node")
    assert sorted(map(tuple, out.select("id", "node", "x").collect())) == [(i, 7 if i < 3000 else i, 14 if i < 3000 else 2 * i) for i in range(4000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 0 and "SortMergeJoin" in plan and "IN (7)" in plan.replace("INSET 7", "IN (7)").replace("= 7", "IN (7)")


def test_rows_of_a_corpus_are_not_broadcast(spark):
    assert minhash.SMALL <= 20_000
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    with common.shuffled_joins(spark):
        assert int(spark.conf.get(name)) <= 1 << 20
    assert spark.conf.get(name, None) == before


def test_components_past_the_bound(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    rows = [(k, " ".join(f"w{k % 30}x{i}" for i in range(20))) for k in range(300)] + [(1000 + k, "one text of very many copies here") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.components(docs).collect()}
    assert got == {k: k % 30 for k in range(300)} | {1000 + k: 1000 for k in range(300)}
