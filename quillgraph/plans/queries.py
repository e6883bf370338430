"""The registered queries of the citation analytics. Doubles are rounded so that the order of sums does not show."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions import names, order, stats
from quillgraph.model import Run, group_of
from quillgraph.operators import authors, corpus, edges, graph, reports, spectral, text, works
from quillgraph.sources.adapters import CORPUS, RUN, Tables
from quillgraph.sources.shared import stored

#: The rankings' tolerance: tighter than the default, so that rounded scores do not depend on the steps taken.
TOL = 1e-12
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def r9(*cols: str) -> list:
    return [F.round(c, 9).alias(c) for c in cols]


_kept: dict[tuple, DataFrame] = {}


def kept(t: Tables, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries build on, written once a session and data folder. It also keeps plans short."""
    key = (t.spark.sparkContext.applicationId, id(t.spark), t.dir, name)
    if key not in _kept:
        _kept[key] = stored(make())
    return _kept[key]


def all_references(t: Tables) -> DataFrame:
    return kept(t, "all references", t.references)


def all_works(t: Tables) -> DataFrame:
    return kept(t, "works", lambda: t.works(all_references(t)))


def corpus_works(t: Tables) -> DataFrame:
    return kept(t, "corpus", lambda: corpus.title_dedup(corpus.filtered_works(all_works(t), t.sources(), CORPUS)))


def flat(t: Tables) -> DataFrame:
    return kept(t, "flat", lambda: corpus.flattened(corpus_works(t), t.authorships(), t.institutions(), t.topics()))


def references(t: Tables) -> DataFrame:
    return kept(t, "references", lambda: corpus.corpus_references(all_references(t), corpus_works(t)))


def candidates(t: Tables, group_col: str, window: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    s, u = corpus.candidacy(flat(t), group_col, window)
    return kept(t, f"s-{group_col}-{window}", lambda: s), kept(t, f"u-{group_col}-{window}", lambda: u)


def units(t: Tables, run=RUN) -> tuple[DataFrame, DataFrame]:
    return edges.retained(*candidates(t, run.group_col, run.window), run, run.members[0])


def edge_list(t: Tables, run=RUN) -> DataFrame:
    made = replace(run, rho=0, omega=0, beta=0, mask="0110", alpha=1.0, chi=-1.0, prior="uniform")  # what the list does not depend on
    return kept(t, f"edges-{made}", lambda: edges.edge_list(flat(t), references(t), run, *units(t, run), keep=stored))


def made_blocks(t: Tables, run) -> edges.Blocks:
    b, key = edges.blocks(edge_list(t, run), *units(t, run), run), replace(run, mask="0110", alpha=1.0, chi=-1.0, prior="uniform")
    sides = {n: kept(t, f"{n}-{key}", lambda d=d: d) for n, d in (("sources", b.sources), ("institutions", b.institutions))}
    return edges.Blocks({k: kept(t, f"{k}-{key}", lambda d=d: d) for k, d in b.blocks.items()}, **sides)


def giant_blocks(t: Tables, run) -> edges.Blocks:
    g = edges.giant(made_blocks(t, run), run)
    sides = {n: kept(t, f"giant-{n}-{run}", lambda d=d: d) for n, d in (("sources", g.sources), ("institutions", g.institutions))}
    return edges.Blocks({k: kept(t, f"giant-{k}-{run}", lambda d=d: d) for k, d in g.blocks.items()}, **sides)


# corpus


@query
def work_filter_semi(t):
    return corpus.filtered_works(all_works(t), t.sources(), CORPUS).select("work_idx", "source_idx", "publication_year", "title")


@query
def title_dedup(t):
    return corpus.title_dedup(all_works(t)).select("work_idx", "title")


@query
def inst_weights(t):
    return corpus.inst_weights(t.authorships(), t.institutions()).select("work_idx", "institution_idx", "country_code", *r9("inst_weight", "direct_inst_weight"))


@query
def topic_weights(t):
    return corpus.topic_weights(t.topics()).select("work_idx", "subfield_idx", "subfield_name", "field_idx", *r9("field_weight"))


@query
def taxonomy_case(t):
    number, name = group_of(F.col("field_idx"))
    return t.topics().select("field_idx", number.alias("leiden_idx"), name.alias("leiden_name")).distinct()


@query
def flat_works(t):
    return flat(t).withColumns({c: F.round(c, 9) for c in ("inst_weight", "direct_inst_weight", "field_weight")})


@query
def corpus_refs(t):
    return references(t)


@query
def refs_nested_explode(t):
    nested = all_references(t).groupBy("citer_idx").agg(F.collect_list("cited_idx").alias("cited_list"))
    return corpus.corpus_references(nested, corpus.filtered_works(all_works(t), t.sources(), CORPUS))


@query
def cand_source(t):
    return corpus.candidacy(flat(t), "field_idx", RUN.window)[0].select("group_idx", "source_idx", *r9("weighted_works"))


@query
def cand_inst(t):
    return corpus.candidacy(flat(t), "field_idx", RUN.window)[1].select("group_idx", "institution_idx", *r9("weighted_works"))


@query
def cand_rollup(t):
    return corpus.roll_up(corpus.candidacy(flat(t), "field_idx", RUN.window)[1], "institution_idx", {1: list(range(11, 25)), 2: list(range(20, 37))}).select("group_idx", "institution_idx", *r9("weighted_works"))


@query
def retained_units_whitelist(t):
    white = t.sources().filter("source_idx % 10 = 0")
    s, u = edges.retained(*corpus.candidacy(flat(t), RUN.group_col, RUN.window), replace(RUN, tau_s=0.3), 4, white, 0.2)
    return s.select(F.lit("S").alias("unit_type"), F.col("source_idx").alias("unit_idx"), *r9("weighted_works")).union(u.select(F.lit("U"), "institution_idx", *r9("weighted_works")))


# edges and blocks


@query
def bloc_excluded_works(t):
    return edges.bloc_excluded(flat(t), RUN, frozenset(f"NATION_{k}" for k in range(20)))


@query
def work_pairs(t):
    return edges.work_pairs(edges.work_ends(edges.group_works(flat(t), RUN, *units(t))), references(t)).select("citer_work_idx", "cited_work_idx", *r9("edge_field_weight"))


@query
def ref_sums(t):
    pairs = edges.work_pairs(edges.work_ends(edges.group_works(flat(t), RUN, *units(t))), references(t))
    return edges.reference_sums(pairs).select("citer_work_idx", *r9("R_i"))


def rounded_edges(e: DataFrame) -> DataFrame:
    return e.withColumns({c: F.round(c, 9) for c in e.columns if "weight" in c or c == "R_i"})


@query
def edge_list_plain(t):
    return rounded_edges(edge_list(t))


@query
def edge_list_epsilon(t):
    return rounded_edges(edge_list(t, replace(RUN, epsilon=1)))


def _block(name: str, kind: str, mask: str, **options) -> None:
    def f(t):
        return made_blocks(t, replace(RUN, mask=mask, **options)).blocks[kind].select("src", "dst", *r9("w"))

    f.__name__ = name
    query(f)


for _kind, _mask in (("ss", "1000"), ("si", "0110"), ("is", "0110"), ("ii", "0001")):
    _block(f"block_{_kind}", _kind, _mask)
_block("block_is_rho1", "is", "0110", rho=1)
_block("block_si_omega1", "si", "0110", omega=1)
_block("block_ii_beta1", "ii", "0001", beta=1)


@query
def active_units(t):
    s, u = edges.active(edge_list(t), *units(t), RUN)
    return s.select(F.lit("S").alias("unit_type"), "unit_idx", *r9("a_p")).union(u.select(F.lit("U"), "unit_idx", *r9("a_p")))


# ranking


def ranking(**options) -> Callable:
    """Registers a ranking of a run: over the giant strong component of its blocks, iterated to the tolerance."""

    def register(f: Callable[[edges.Blocks, Run], DataFrame]) -> Callable:
        run = replace(RUN, **options)
        QUERIES[f.__name__] = lambda spark, sf_dir: f(giant_blocks(Tables(spark, sf_dir), run), run)
        return f

    return register


def both_sides(s: DataFrame, u: DataFrame) -> DataFrame:
    return s.select(F.lit("S").alias("unit_type"), "unit_idx", *r9("pi")).union(u.select(F.lit("U"), "unit_idx", *r9("pi")))


@ranking(mask="0001")
def power_ii(b, run):
    return spectral.power(b.blocks["ii"], b.institutions, tol=TOL).select("unit_idx", *r9("pi"))


@ranking(mask="1000")
def power_ss(b, run):
    return spectral.power(b.blocks["ss"], b.sources, tol=TOL).select("unit_idx", *r9("pi"))


@ranking(mask="0001")
def katz_uniform(b, run):
    return spectral.katz(b.blocks["ii"], b.institutions, 0.85, tol=TOL).select("unit_idx", *r9("pi"))


@ranking(mask="0001")
def katz_by_size(b, run):
    """Katz scores under a prior in proportion to the units' sizes."""
    prior = b.institutions.select("unit_idx", F.col("a_p").alias("pi"))
    return spectral.katz(b.blocks["ii"], b.institutions, 0.85, prior, TOL).select("unit_idx", *r9("pi"))


@ranking()
def bipartite_perron(b, run):
    return both_sides(*spectral.bipartite(b.blocks["si"], b.blocks["is"], b.sources, b.institutions, tol=TOL))


@ranking(alpha=0.85)
def bipartite_uniform(b, run):
    return both_sides(*spectral.bipartite(b.blocks["si"], b.blocks["is"], b.sources, b.institutions, run.alpha, "uniform", TOL))


@ranking(alpha=0.85, prior="unit_scaled")
def bipartite_unit_scaled(b, run):
    return both_sides(*spectral.bipartite(b.blocks["si"], b.blocks["is"], b.sources, b.institutions, run.alpha, "unit_scaled", TOL))


@ranking(alpha=0.85)
def bipartite_resolvent(b, run):
    return both_sides(*spectral.resolvent(b.blocks["si"], b.blocks["is"], b.sources, b.institutions, run.alpha, TOL))


@ranking(mask="1111")
def joint_chi(b, run):
    h, us = spectral.joint_graph(b, run.chi)
    return spectral.power(h, us, tol=TOL).select("unit_idx", *r9("pi"))


@ranking(mask="0001")
def rank_dense(b, run):
    v = spectral.size_adjusted((spectral.power(b.blocks["ii"], b.institutions, tol=TOL), b.institutions, "U"))
    return spectral.dense_ranks(v.select("unit_idx", "unit_type", *r9("pi"), F.round("v", 6).alias("v")))


def ranked(b: edges.Blocks, run: Run) -> DataFrame:
    return spectral.rank(b, run, tol=TOL).select("unit_idx", "unit_type", *r9("pi"), F.round("v", 6).alias("v"))


@ranking()
def rank_by_mask(b, run):
    return ranked(b, run)


@ranking(mask="1111")
def rank_joint(b, run):
    return ranked(b, run)


@ranking(mask="1000")
def rank_sources(b, run):
    return ranked(b, run)


@query
def giant_scc(t):
    return graph.giant_scc(made_blocks(t, replace(RUN, mask="1000")).blocks["ss"])


# works


def rankings(t: Tables) -> DataFrame:
    """Closed-form stand-ins for scores, so that what builds on them can be checked apart."""
    fields = t.topics().select("field_idx").distinct()
    v = lambda c: (F.pmod(F.col(c) * 7 + F.col("field_idx") * 3, F.lit(20)) / 10.0).alias("v")
    keep = lambda c: F.pmod(F.col(c) + F.col("field_idx"), F.lit(11)) != 0
    s = t.sources().crossJoin(F.broadcast(fields)).filter(keep("source_idx")).select("field_idx", F.col("source_idx").alias("unit_idx"), F.lit("S").alias("unit_type"), v("source_idx"))
    u = t.institutions().crossJoin(F.broadcast(fields)).filter(keep("institution_idx")).select("field_idx", F.col("institution_idx").alias("unit_idx"), F.lit("U").alias("unit_type"), v("institution_idx"))
    return s.union(u)


def scored(t: Tables) -> DataFrame:
    return kept(t, "scored", lambda: works.work_v(flat(t), rankings(t)))


@query
def work_v(t):
    return scored(t).select("work_idx", "field_idx", *r9("source_v", "mean_inst_v", "work_v"))


@query
def citer_counts(t):
    return works.citer_counts(scored(t), references(t)).select("field_idx", "work_idx", "n_intra", *r9("mean_citer_v"), "n_citer_hi", "n_citer_lo")


def flagged(t: Tables) -> DataFrame:
    years = corpus.filtered_works(all_works(t), t.sources(), CORPUS).select("work_idx", "publication_year")
    w = scored(t).join(years, "work_idx").join(works.citer_counts(scored(t), references(t)), ["field_idx", "work_idx"], "left").fillna(0, ["n_intra"])
    return kept(t, "flagged", lambda: works.hcw_flags(w, 0.9))


@query
def hcw_flags(t):
    return flagged(t).select("field_idx", "work_idx", "publication_year", "n_intra", *r9("threshold"), "is_hcw")


@query
def quadrants(t):
    return flagged(t).select("field_idx", "work_idx", works.quadrant(F.col("source_v"), F.col("mean_citer_v")).alias("quadrant"))


@query
def quadrant_pools(t):
    return works.quadrant_pools(flagged(t).withColumn("quadrant", works.quadrant(F.col("source_v"), F.col("mean_citer_v"))))


@query
def hcw_pctile_overrides(t):
    w = flat(t).select("field_idx", "work_idx", "cited_by_count").distinct()
    return works.override_thresholds(w, 0.99, {12: 0.9, 20: 0.5}, "cited_by_count").select("field_idx", *r9("threshold"))


@query
def field_shares(t):
    return works.field_shares(t.topics())


# authors


@query
def author_counts_mode(t):
    return authors.modal(t.authorships(), ["author_idx"], "institution_idx")


@query
def surrogate_key(t):
    c = t.authorships().groupBy("author_idx").agg(F.countDistinct("work_idx").alias("n_works"))
    return order.numbered(c, [F.desc("n_works"), "author_idx"], "key")


def _counts(t: Tables) -> tuple[DataFrame, DataFrame]:
    fw = flat(t).select("work_idx", "field_idx", "cited_by_count").distinct()
    j = t.authorships().select("work_idx", "author_idx").distinct().join(fw, "work_idx")
    return j.filter("cited_by_count > 0").groupBy("field_idx", "author_idx").agg(F.count("*").alias("n_hcw")), j.groupBy("field_idx", "author_idx").agg(F.sum("cited_by_count").alias("n_cites"))


@query
def crossfield_scores(t):
    return authors.crossfield(*_counts(t), 20).select("author_idx", "n_fields", *(F.round(c, 6).alias(c) for c in ("cf_paper_score", "cf_cite_score")), "qualified")


@query
def coauthor_evidence(t):
    c = t.authorships().select((F.floor(F.col("author_idx") / 10)).alias("cluster"), "author_idx").distinct()
    return authors.coauthor_evidence(c, t.authorships()).select("cluster", "a", "b", "n_a", "n_b", "n_shared", *r9("jaccard"))


@query
def connected_components(t):
    r = all_references(t)
    nodes = r.select("citer_idx").union(r.select("cited_idx")).distinct()
    return graph.connected_components(nodes, r)


@query
def seed_citations(t):
    return graph.seed_citations(references(t), all_works(t).filter("cited_by_count >= 3"))


@query
def top_researchers(t):
    m = flagged(t).select("field_idx", "work_idx", works.quadrant(F.col("source_v"), F.col("mean_citer_v")).alias("enclave")).filter("enclave IS NOT NULL")
    return authors.top_authors(m, t.authorships(), 3)


# reports


@query
def unit_rank_share(t):
    s = reports.rank_shares(corpus.candidacy(flat(t), "field_idx", RUN.window)[1], [1, 10, 50])
    return s.select("group_idx", "n_units", *r9("top_1", "top_10", "top_50"))


@query
def cross_field_pairs(t):
    return reports.cross_field_pairs(flat(t), 20)


@query
def country_report(t):
    return reports.country_report(flat(t))


@query
def share_by_year(t):
    return reports.share_by_year(flat(t), list(range(1995, 2002)), 1999)


@query
def pivot_units(t):
    return reports.unit_pivot(rankings(t).filter("unit_type = 'U'"), list(range(11, 37)))


@query
def country_benchmark(t):
    r = rankings(t).filter("unit_type = 'U'").join(t.institutions().select(F.col("institution_idx").alias("unit_idx"), "country_code"), "unit_idx")
    return reports.country_benchmark(r)


@query
def national_rank(t):
    r = rankings(t).filter("unit_type = 'U'").join(t.institutions().select(F.col("institution_idx").alias("unit_idx"), "country_code"), "unit_idx")
    return reports.national_rank(r, ["field_idx"]).select("field_idx", "unit_idx", "country_code", "v", "national_rank")


@query
def issn_title_match(t):
    issn = lambda k: F.concat(F.lpad(F.floor(k / 7).cast("string"), 4, "0"), F.lit("-"), F.lpad((k % 977).cast("string"), 4, "0"))
    k = F.col("source_idx")
    src = t.sources().select("source_idx", F.array(issn(k), issn(k + 3)).alias("issn"), "display_name")
    listed = t.sources().filter("source_idx % 5 = 0").select(k.alias("list_id"), F.when(k % 10 == 0, issn(k + 1)).alias("issn"), F.upper(F.replace("display_name", F.lit("#"), F.lit(" - "))).alias("title"))
    return reports.whitelist_match(listed, src)


@query
def person_profile(t):
    # an author's rows meet once, and a work is counted by its first row, so that counts of different works copy no rows
    mine = t.authorships().join(corpus_works(t).select("work_idx"), "work_idx", "left_semi").select("work_idx", "author_idx").distinct()
    hi = F.coalesce(F.round("work_v", 9) >= 1, F.lit(False)).alias("hi")
    w = scored(t).join(mine, "work_idx").select("author_idx", "work_idx", "field_idx", "work_v", "mean_inst_v", hi).repartition("author_idx")
    first = F.row_number().over(W.partitionBy("author_idx", "work_idx").orderBy(F.desc("hi"))) == 1
    return w.withColumn("first", first).groupBy("author_idx").agg(
        F.count(F.when(F.col("first"), 1)).alias("n_works"), F.count(F.when(F.col("first") & F.col("hi"), 1)).alias("n_hi"), F.round(F.median("work_v"), 9).alias("median_v"),
        F.round(F.coalesce(F.avg("mean_inst_v"), F.lit(0.0)), 9).alias("mean_inst_v"), F.array_join(F.sort_array(F.collect_set(F.col("field_idx").cast("string"))), "; ").alias("fields"),
    ).withColumn("share_hi", F.round(F.col("n_hi") / F.col("n_works"), 9))


# linkage and statistics


@query
def waterfall_match(t):
    key = lambda df, name: df.select(F.col("p_partkey").alias(name), F.split("p_name", " ")[0].alias("first"), F.split("p_name", " ")[1].alias("last"), F.substring("p_name", 1, 1).alias("fi"), F.col("p_brand").alias("mid"))
    p = t.raw("part")
    return names.waterfall(key(p.filter("p_partkey % 2 = 0"), "person"), key(p.filter("p_partkey % 2 = 1"), "candidate"), [("first", "mid", "last"), ("first", "last"), ("fi", "mid", "last"), ("fi", "last")])


@query
def token_jaccard(t):
    d = t.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return names.token_jaccard(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), 0.5).withColumn("jaccard", F.round("jaccard", 9))


@query
def spearman(t):
    c = stats.correlations(t.raw("part"), ["p_brand"], "p_size", "p_retailprice")
    return c.select("p_brand", "n", *(F.round(x, 6).alias(x) for x in ("pearson", "spearman")))


@query
def ols(t):
    fit = stats.ols(t.raw("lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    rows = [(name, round(float(b), 4)) for name, b in zip(["intercept", "l_quantity", "l_discount"], fit["coef"])]
    return t.spark.createDataFrame(rows, "term string, coef double")


@query
def auc_somers_d(t):
    a = stats.auc(t.raw("orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice"), "y", "o_totalprice")
    return a.select("n_pos", "n_neg", *(F.round(x, 6).alias(x) for x in ("auc", "somers_d")))


@query
def tfidf_terms(t):
    d = t.raw("part").select((F.col("p_size") % 5).cast("long").alias("group"), F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_retailprice") > 950).alias("inside"))
    return text.lift(d, 5, stop={"small"}).select("group", "term", *(F.round(x, 6).alias(x) for x in ("mean_enc", "mean_non")), "rank")


@query
def nmf_topics(t):
    d = t.raw("part").select((F.col("p_size") % 5).cast("long").alias("group"), F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return text.nmf(text.tfidf(d)).groupBy("group", "topic").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions of the giant component ranked by the Perron vector of their citation graph."""
    return QUERIES["rank_dense"](spark, sf_dir)
