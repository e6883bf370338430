"""Highly cited works with their scores, and the citation networks around groups of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.order import steady
from quillgraph.operators import graph
from quillgraph.operators.works import QUADRANTS, citer_counts, hcw_flags, quadrant


def field_citations(works: DataFrame, refs: DataFrame) -> DataFrame:
    """field_idx, work_idx, n_intra: citations of works (field_idx, work_idx) by works of the same field; those of none are absent."""
    citer = works.select("field_idx", F.col("work_idx").alias("citer_idx")).distinct()
    cited = works.select("field_idx", F.col("work_idx").alias("cited_idx")).distinct()
    j = refs.join(citer, "citer_idx").join(cited, ["cited_idx", "field_idx"])
    return j.groupBy("field_idx", F.col("cited_idx").alias("work_idx")).agg(F.count("*").alias("n_intra"))


def mean_institution_v(works: DataFrame, fw: DataFrame, rankings: DataFrame) -> DataFrame:
    """field_idx, work_idx, mean_inst_v over a work's distinct ranked institutions; works without any are absent."""
    inst = fw.select("work_idx", "institution_idx").distinct()
    v = rankings.filter("unit_type = 'U' AND v IS NOT NULL").select("field_idx", F.col("unit_idx").alias("institution_idx"), "v")
    return works.select("field_idx", "work_idx").join(inst, "work_idx").join(v, ["field_idx", "institution_idx"]).groupBy("field_idx", "work_idx").agg(F.avg("v").alias("mean_inst_v"))


def assemble(fw: DataFrame, refs: DataFrame, rankings: DataFrame, years: tuple[int, int], share: float = 0.99) -> DataFrame:
    """The highly cited works of ranked sources: counts, threshold of field and year, scores of source, citers and institutions,
    the gap between source and institutions, and the title."""
    s = rankings.filter("unit_type = 'S' AND v IS NOT NULL").select("field_idx", F.col("unit_idx").alias("source_idx"), F.col("v").alias("source_v"))
    base = fw.filter(F.col("publication_year").between(*years)).select("field_idx", "work_idx", "source_idx", "publication_year", "title").distinct().join(s, ["field_idx", "source_idx"])
    counted = base.join(citer_counts(base, refs), ["field_idx", "work_idx"], "left").fillna(0, ["n_intra", "n_citer_hi", "n_citer_lo"])
    hcw = hcw_flags(counted, share).filter("is_hcw").withColumnRenamed("threshold", "year_threshold")
    hcw = hcw.join(mean_institution_v(hcw, fw, rankings), ["field_idx", "work_idx"], "left")
    return hcw.select(
        "field_idx", "work_idx", "publication_year", "source_idx", "n_intra", "year_threshold", "source_v", "mean_citer_v", "n_citer_hi", "n_citer_lo", "mean_inst_v",
        (F.col("source_v") - F.col("mean_inst_v")).alias("gap"), "title",
    )


def summary(hcw: DataFrame) -> DataFrame:
    """Per field: works, medians, works below 1 on both sides, and those only of low sources."""
    low, citers = F.col("source_v") < 1, steady(F.col("mean_citer_v"))
    n = lambda c: F.count(F.when(c, 1))
    s = hcw.groupBy("field_idx").agg(
        F.count("*").alias("n_hcw"), F.median("source_v").alias("median_src_v"), F.median("mean_citer_v").alias("median_citer_v"), F.median("mean_inst_v").alias("median_inst_v"),
        n(low & (citers < 1)).alias("n_enclave"), n(low & (citers > 1)).alias("n_lo_hi"),
    )
    return s.withColumn("enc_rate", F.col("n_enclave") / F.col("n_hcw"))


def networks(members: DataFrame, refs: DataFrame, hcw: DataFrame, scores: DataFrame) -> DataFrame:
    """Of each (field_idx, enclave) of members (with work_idx): its citation edges, distinct citers, percent of edges that come
    from inside, citers outside it by quadrant and their percent of the field's pool, mean work_v of the members and of the whole
    network, components that hold members, and the largest's members. All enclaves in one pass; hcw: field_idx, work_idx, source_v,
    mean_citer_v; scores: field_idx, work_idx, work_v."""
    key = ["field_idx", "enclave"]
    seeds = members.select(*key, "work_idx").distinct()
    edges = refs.join(seeds.withColumnRenamed("work_idx", "cited_idx"), "cited_idx")
    inside = seeds.select(*key, F.col("work_idx").alias("citer_idx"), F.lit(True).alias("own"))
    edges = edges.join(inside, [*key, "citer_idx"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    flow = edges.groupBy(*key).agg(F.count("*").alias("n_edges"), F.countDistinct("citer_idx").alias("n_citers"), F.count(F.when(F.col("own"), 1)).alias("n_loop"))
    q = hcw.select("field_idx", F.col("work_idx").alias("citer_idx"), quadrant(F.col("source_v"), F.col("mean_citer_v")).alias("q")).distinct()
    outside = edges.filter("NOT own").select(*key, "citer_idx").distinct().join(q, ["field_idx", "citer_idx"])
    outside = outside.groupBy(*key).agg(*(F.count(F.when(F.col("q") == k, 1)).alias(n) for k, n in QUADRANTS.items()))
    pools = q.groupBy("field_idx").agg(*(F.count(F.when(F.col("q") == k, 1)).alias(f"pool{n[1:]}") for k, n in QUADRANTS.items()))
    v = scores.select("field_idx", "work_idx", "work_v")
    own_v = seeds.join(v, ["field_idx", "work_idx"]).groupBy(*key).agg(F.avg("work_v").alias("mean_wv_seeds"))
    net = seeds.union(edges.select(*key, F.col("citer_idx").alias("work_idx"))).distinct()
    net_v = net.join(v, ["field_idx", "work_idx"]).groupBy(*key).agg(F.avg("work_v").alias("mean_wv_net"))
    # components of all networks at once: a node is a work in an enclave
    nodes = net.select(F.xxhash64(*key, "work_idx").alias("node"), *key, "work_idx")
    pairs = edges.select(F.xxhash64(*key, "citer_idx").alias("a"), F.xxhash64(*key, "cited_idx").alias("b"))
    labels = graph.connected_components(nodes.select("node"), pairs)
    sizes = nodes.join(labels, "node").join(seeds.select(*key, "work_idx"), [*key, "work_idx"], "left_semi").groupBy(*key, "label").agg(F.count("*").alias("k"))
    comps = sizes.groupBy(*key).agg(F.count("*").alias("n_comp"), F.max("k").alias("lg_hcw"))
    out = seeds.groupBy(*key).agg(F.count("*").alias("n_hcw"))
    for other in (flow, outside, own_v, net_v, comps):
        out = out.join(other, key, "left")
    out = out.join(pools, "field_idx", "left").fillna(0, ["n_edges", "n_citers", "n_loop", *QUADRANTS.values(), *(f"pool{n[1:]}" for n in QUADRANTS.values())])
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    return out.select(
        *key, "n_hcw", "n_edges", "n_citers", share("n_loop", "n_edges").alias("loop_pct"), "n_mp", share("n_mp", "pool_mp").alias("pct_mp"), "n_pm", share("n_pm", "pool_pm").alias("pct_pm"),
        "n_pp", share("n_pp", "pool_pp").alias("pct_pp"), "mean_wv_seeds", "mean_wv_net", "n_comp", "lg_hcw", (F.col("lg_hcw") / F.col("n_hcw")).alias("lg_pct"),
    )


def top_sources(members: DataFrame, n: int = 4) -> DataFrame:
    """The n sources with most works of each enclave. members: field_idx, enclave, work_idx, source_idx."""
    c = members.select("field_idx", "enclave", "work_idx", "source_idx").distinct().groupBy("field_idx", "enclave", "source_idx").agg(F.count("*").alias("n_works"))
    by = W.partitionBy("field_idx", "enclave").orderBy(F.desc("n_works"), "source_idx")
    return c.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def topic_names(topics: DataFrame, field: int, merges: list[list[int]], names: dict[int, str]) -> DataFrame:
    """topics (field_idx, topic_idx, ...) of a field with merged topics under their least index, and topic_name; others keep ''."""
    spark, here = topics.sparkSession, F.col("field_idx") == field
    moved = F.col("topic_idx")
    for group in merges:
        moved = F.when(F.col("topic_idx").isin(*group), F.lit(min(group)).cast("long")).otherwise(moved)
    out = topics.withColumn("topic_idx", F.when(here, moved).otherwise(F.col("topic_idx")))
    dim = spark.createDataFrame([(field, k, v) for k, v in names.items()] or [(None, None, None)], "field_idx long, topic_idx long, topic_name string")
    return out.join(F.broadcast(dim), ["field_idx", "topic_idx"], "left").withColumn("topic_name", F.coalesce("topic_name", F.lit("")))


def topic_prompt(topics: DataFrame, field: int, name: str) -> str:
    """A request to merge and name a field's topics: one line for each, of which there are ten at most."""
    rows = topics.filter(F.col("field_idx") == field).groupBy("topic_idx").agg(F.count("*").alias("n"), F.min("topic_label").alias("terms")).orderBy("topic_idx").collect()
    lines = [f"  {r['topic_idx']}: n={r['n']:,}  {r['terms']}" for r in rows]
    return "\n".join([f"Field {field}, {name}. Topics of enclave works, by the leading terms of their titles:", *lines, 'Answer with JSON: "merges", lists of topics that are one; "names", a name of three words at most for each that is left.'])


def member_works(members: DataFrame, auth: DataFrame, fw: DataFrame, scores: DataFrame, hcw: DataFrame, topics: DataFrame) -> DataFrame:
    """Works of members (person_id, author_idx) by field and institution, with scores, quadrant of highly cited ones and topic; all
    three are optional."""
    w = auth.join(F.broadcast(members.select("person_id", "author_idx")), "author_idx").select("person_id", "author_idx", "work_idx")
    # made distinct only when joined, as the members have few of all works
    w = w.join(fw.select("work_idx", "publication_year", "source_idx", "institution_idx", "field_idx"), "work_idx").distinct()
    w = w.join(scores.select("work_idx", "field_idx", "source_v", "mean_inst_v", "work_v"), ["work_idx", "field_idx"], "left")
    h = hcw.select("work_idx", "field_idx", "mean_citer_v", "n_intra", "n_citer_hi", "n_citer_lo", F.lit(True).alias("is_hcw"))
    w = w.join(h, ["work_idx", "field_idx"], "left").join(topics.select("work_idx", "field_idx", F.col("topic_name").alias("enclave_name")), ["work_idx", "field_idx"], "left")
    return w.withColumn("hcw_quadrant", F.when(F.col("is_hcw"), quadrant(F.col("source_v"), F.col("mean_citer_v")))).drop("is_hcw")


def member_profiles(works: DataFrame) -> DataFrame:
    """One row a person of member_works: counts, means and medians of scores, share of high citers, quadrants and topics."""
    n = lambda c: F.countDistinct(F.when(c, F.col("work_idx")))
    hi, lo = F.coalesce(F.sum("n_citer_hi"), F.lit(0)), F.coalesce(F.sum("n_citer_lo"), F.lit(0))
    return works.groupBy("person_id").agg(
        F.countDistinct("work_idx").alias("n_works_corpus"), n(F.col("source_v").isNotNull()).alias("n_ranked_works"), *(F.avg(c).alias(f"avg_{c}") for c in ("source_v", "mean_inst_v", "work_v", "mean_citer_v")),
        *(F.median(c).alias(f"median_{c}") for c in ("source_v", "work_v", "mean_citer_v")), hi.alias("tot_citer_hi"), lo.alias("tot_citer_lo"),
        F.when(hi + lo > 0, hi.cast("double") / F.when(hi + lo > 0, hi + lo)).alias("high_citer_ratio"), *(n(F.col("hcw_quadrant") == q).alias(f"n_hcw{x[1:]}") for q, x in QUADRANTS.items()),
        n(F.col("hcw_quadrant").isNotNull()).alias("n_hcw_total"), n(F.col("enclave_name").isNotNull()).alias("n_enclave_works"), F.array_join(F.sort_array(F.collect_set("enclave_name")), "; ").alias("enclave_topics"),
    )
