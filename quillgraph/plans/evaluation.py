"""Registered queries of the enclaves, authors, persons and comparisons. Where the test tables have no like of an input, closed
formulas of their keys stand in for it."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions import compare, names, order, persons, stats
from quillgraph.model import GROUPS
from quillgraph.operators import authors, corpus, enclaves, extraction, graph, ranking, reports, spectral
from quillgraph.operators.runner import Runner, unit_rankings
from quillgraph.plans.queries import QUERIES, TOL, all_references, all_works, candidates, flat, giant_blocks, kept, query, r9, ranked, rankings, references, scored  # noqa: F401
from quillgraph.sources.adapters import RUN, Tables
from quillgraph.sources.shared import shared_folder

YEARS, HORIZON, BLOC = (1996, 2000), 2002, frozenset(f"NATION_{k}" for k in range(20))


def rounded(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


# enclaves


def hcw(t: Tables) -> DataFrame:
    return kept(t, "hcw", lambda: enclaves.assemble(flat(t), references(t), rankings(t), YEARS, 0.9))


@query
def field_citations(t):
    return enclaves.field_citations(scored(t), references(t))


@query
def hcw_assembly(t):
    return rounded(hcw(t), "year_threshold", "source_v", "mean_citer_v", "mean_inst_v", "gap", to=9)


@query
def hcw_summary(t):
    return rounded(enclaves.summary(hcw(t)), "median_src_v", "median_citer_v", "median_inst_v", "enc_rate")


def enclave_members(t: Tables) -> DataFrame:
    """Works low on both sides, of a topic that a formula names."""
    low = hcw(t).filter((F.col("source_v") < 1) & (order.steady(F.col("mean_citer_v")) < 1))
    return low.select("field_idx", (F.col("work_idx") % 3).alias("enclave"), "work_idx", "source_idx")


@query
def enclave_networks(t):
    n = enclaves.networks(enclave_members(t), references(t), hcw(t), scored(t))
    return rounded(n, "loop_pct", "pct_mp", "pct_pm", "pct_pp", "mean_wv_seeds", "mean_wv_net", "lg_pct")


@query
def enclave_sources(t):
    return enclaves.top_sources(enclave_members(t))


def topics_of(t: Tables) -> DataFrame:
    return hcw(t).select("field_idx", "work_idx", (F.col("work_idx") % 5).alias("topic_idx"))


@query
def topic_naming(t):
    return enclaves.topic_names(topics_of(t), 20, [[1, 3], [2, 4]], {0: "none", 1: "odd", 2: "even"})


def members(t: Tables) -> DataFrame:
    return t.authorships().select("author_idx").distinct().filter("author_idx % 50 = 0").select((F.col("author_idx") / 50).cast("long").alias("person_id"), "author_idx")


def labelled(t: Tables) -> DataFrame:
    topics = enclaves.topic_names(topics_of(t), 20, [[1, 3], [2, 4]], {0: "none", 1: "odd", 2: "even"}).filter("topic_name <> ''")
    return kept(t, "labelled", lambda: enclaves.member_works(members(t), t.authorships(), flat(t), scored(t), hcw(t), topics))


@query
def member_works(t):
    counts = {c: F.col(c).cast("double") for c in ("n_intra", "n_citer_hi", "n_citer_lo")}
    return rounded(labelled(t), "source_v", "mean_inst_v", "work_v", "mean_citer_v", to=9).withColumns(counts)


@query
def member_profiles(t):
    p = enclaves.member_profiles(labelled(t))
    return rounded(p, *(c for c, k in p.dtypes if k == "double"))


# highly cited works and their authors


def by_field(t: Tables) -> DataFrame:
    return kept(t, "by_field", lambda: extraction.shared_by_field(extraction.works_by_topic(flat(t), t.topics(), HORIZON)))


def cited(t: Tables) -> DataFrame:
    return kept(t, "cited", lambda: extraction.highly_cited(by_field(t), 0.9, {20: 0.5, 31: 0.75}))


def people(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("author_idx"), F.col("p_name").alias("display_name"), F.col("p_size").cast("long").alias("h_index"))


def found_authors(t: Tables) -> DataFrame:
    return kept(t, "found_authors", lambda: extraction.authors(cited(t), t.authorships(), t.institutions(), people(t), YEARS))


@query
def works_by_topic(t):
    return extraction.works_by_topic(flat(t), t.topics(), HORIZON)


@query
def works_by_field(t):
    return by_field(t)


@query
def highly_cited_works(t):
    return cited(t)


@query
def highly_cited_authors(t):
    return found_authors(t)


@query
def highly_cited_authorships(t):
    return extraction.authorships(cited(t), t.authorships())


@query
def author_thresholds(t):
    return extraction.thresholds(found_authors(t))


@query
def prolific_authors(t):
    p = extraction.prolific(found_authors(t))
    return extraction.one_each(p, "author_idx", [F.desc("n_hcw"), "field_idx"]).select("author_idx", "field_idx", "n_hcw", "display_name")


def matches(t: Tables) -> DataFrame:
    k = F.col("author_idx")
    status = F.when(k % 3 == 0, "unique").when(k % 3 == 1, "inst_resolved").otherwise("ambiguous")
    return found_authors(t).select("author_idx").distinct().select((k % 40).alias("hca_cluster_hash"), status.alias("match_status")).distinct()


def listed_works(t: Tables) -> DataFrame:
    clusters = found_authors(t).select("author_idx", (F.col("author_idx") % 40).alias("cluster_hash")).distinct()
    return extraction.overlay(matches(t).filter("hca_cluster_hash < 30"), clusters, extraction.authorships(cited(t), t.authorships()), hcw(t))


@query
def listed_overlay(t):
    return rounded(listed_works(t).select("author_idx", "work_idx", "field_idx", "source_v", "mean_citer_v"), "source_v", "mean_citer_v", to=9)


@query
def pool_means(t):
    return rounded(extraction.pool_means(listed_works(t), "source_v", "mean_citer_v"), "pool_x", "pool_y", "person_x", "person_y")


# persons


def named(t: Tables) -> DataFrame:
    """Parts as persons: the first word of the name, an initial, the second word."""
    p = t.raw("part")
    first = F.when(F.col("p_partkey") % 4 == 0, F.substring("p_name", 1, 1)).otherwise(F.split("p_name", " ")[0])
    middle = F.when(F.col("p_partkey") % 3 == 0, F.lower(F.substring("p_type", 1, 1)))
    return p.select(F.col("p_partkey").alias("id"), first.alias("first"), middle.alias("middle"), F.split("p_name", " ")[1].alias("last"), F.col("p_brand").alias("affil"), F.col("p_type").alias("category"))


@query
def name_keys(t):
    n = named(t).select("id", F.concat_ws(" ", F.lit("Dr."), F.initcap("first"), F.initcap("middle"), F.initcap("last"), F.when(F.col("id") % 5 == 0, "Jr")).alias("full"))
    return persons.keys(n.withColumn("folded", names.folded(names.clean_name(F.col("full")))), "folded").select("id", "first_norm", "last_norm", "initial")


@query
def two_tier_match(t):
    n = named(t).select("id", F.col("first").alias("first_norm"), F.col("last").alias("last_norm"), F.substring("first", 1, 1).alias("initial"))
    known = n.filter("id % 2 = 1 AND id % 7 < 3").select(F.concat_ws(" ", "first_norm", "last_norm").alias("display_name"), (F.col("id") % 26 + 11).alias("field_idx"), "first_norm", "last_norm", "initial").distinct()
    m = persons.two_tiers(n.filter("id % 2 = 0").withColumnRenamed("id", "person"), known)
    return m.select("person", "tier", "n_ambiguous", F.size("matches").alias("n_matches"), F.col("matches")[0]["display_name"].alias("first_match"))


@query
def name_clusters(t):
    return persons.clusters(named(t))


@query
def clusters_table(t):
    """Parts as authors whose works are orders; the institution last known is that of the latest order."""
    n = named(t).select(F.col("id").alias("author_idx"), F.concat_ws(" ", F.initcap("first"), F.initcap("last")).alias("display_name"), F.col("last").alias("last_norm"), F.substring("first", 1, 1).alias("initial"))
    at = t.authorships().join(t.institutions().select("institution_idx", F.col("display_name").alias("inst_name"), F.col("country_code").alias("inst_country")), "institution_idx")
    latest = at.groupBy("author_idx").agg(F.max_by(F.struct(F.col("inst_name").alias("display_name"), F.col("inst_country").alias("country_code")), F.struct("work_idx", "institution_idx")).alias("r"))
    a = n.join(latest, "author_idx", "left").withColumn("institutions", F.when(F.col("r").isNotNull(), F.array("r")))
    return persons.clusters_table(a, at).select("*", F.col("hn.first").alias("first_part"), F.col("hn.last").alias("last_part")).drop("hn")


@query
def person_categories(t):
    n = named(t).select(F.initcap("first").alias("first_name"), F.initcap("last").alias("last_name"), "affil", "category", F.col("last").alias("last_norm"), F.substring("first", 1, 1).alias("initial"))
    p = persons.persons(n)
    return p.select("person_hash", "cluster_hash", "sub_cluster_hash", "first_name", "last_name", "affil", F.array_join("categories", "; ").alias("categories"), "n_categories", "multi_category")


@query
def refined_clusters(t):
    c = kept(t, "refined clusters", lambda: t.authorships().select(F.floor(F.col("author_idx") / 10).alias("cluster"), "author_idx").distinct())
    return persons.refined(c, authors.coauthor_evidence(c, t.authorships()), 0.02)


STAGES = [("first", "middle", "last"), ("first", "last"), ("fi", "middle", "last"), ("fi", "last")]


@query
def waterfall_institutions(t):
    n = named(t).withColumn("fi", F.substring("first", 1, 1))
    a = n.filter("id % 2 = 0").select(F.col("id").alias("person"), F.concat("affil", F.lit(", Nowhere")).alias("affil"), "first", "middle", "last", "fi")
    b = n.filter("id % 2 = 1").select(F.col("id").alias("candidate"), F.col("affil").alias("inst_modal"), F.lit(None).cast("string").alias("inst_recent"), "first", "middle", "last", "fi")
    return persons.resolved(a, b, STAGES).fillna(-1, ["candidate"])


@query
def cluster_scores(t):
    """Authors' counts rolled up to clusters, and the share of clusters' authors that have any."""
    c = t.authorships().select("author_idx").distinct().withColumn("cluster", F.floor(F.col("author_idx") / 10))
    n = found_authors(t).groupBy("author_idx").agg(F.sum("n_hcw").alias("n_hcw"))
    g = c.join(n, "author_idx", "left").groupBy("cluster").agg(F.count("*").alias("n_authors"), F.count("n_hcw").alias("n_found"), F.coalesce(F.sum("n_hcw"), F.lit(0)).alias("n_hcw"))
    return g.withColumn("miss_rate", F.round(1 - F.col("n_found") / F.col("n_authors"), 6))


KEYWORDS = [("brand#1", "One"), ("brand#12", "Never"), ("brand#2", "Two"), ("#3", "Three")]


@query
def affiliation_keywords(t):
    return t.raw("part").select("p_partkey", persons.ordered_keyword(F.col("p_brand"), KEYWORDS).alias("keyword"))


@query
def committee_authors(t):
    n = named(t)
    roster = n.filter("id % 40 = 1").select(F.col("id").alias("person_id"), F.col("first").alias("first_norm"), F.col("last").alias("last_norm"), F.substring("first", 1, 1).alias("initial"), "affil")
    p = t.raw("part")
    known = p.select(F.col("p_partkey").alias("author_idx"), F.col("p_name").alias("display_name"), F.col("p_size").alias("works_count"), F.floor("p_retailprice").alias("cited_by_count"), F.concat(F.lit("dept of "), F.when(F.col("p_brand").contains("#1"), "One").otherwise(F.col("p_type"))).alias("institutions"))
    return persons.members_to_authors(roster, known, KEYWORDS)


@query
def institution_tiers(t):
    s = t.raw("supplier")
    cc = F.concat(F.lit("C"), F.col("s_nationkey").cast("string"))
    base = s.select(F.col("s_suppkey").alias("institution_idx"), F.concat(F.lit("Institute of Branch "), F.col("s_suppkey").cast("string")).alias("display_name"), F.array(F.concat(F.lit("Branch no "), F.col("s_suppkey").cast("string"))).alias("alternatives"), F.array(F.concat(F.lit("BR"), F.col("s_suppkey").cast("string"))).alias("acronyms"), cc.alias("country_code"))
    k = F.col("s_suppkey")
    asked = F.when(k % 5 == 0, F.concat(F.lit("INSTITUTE of branch, "), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("branch-no "), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("Somewhere (BR"), k.cast("string"), F.lit(")"))).when(k % 5 == 3, F.concat(F.lit("Old Institute Branch "), k.cast("string"))).otherwise(F.lit("Unknown place"))
    found = persons.institution_tiers(s.select(k.alias("id"), asked.alias("inst"), F.when(k % 2 == 0, cc).alias("country_code")), base, by_hand=s.filter("s_suppkey % 15 = 4").select(F.lit("Unknown Place").alias("inst"), k.alias("institution_idx")))
    return rounded(found, "score")


@query
def mnemonic_codes(t):
    return persons.unique_mnemonics(t.raw("part").select(F.col("p_name").alias("name")))


@query
def abstracts(t):
    """Names written as maps from words to places, and back."""
    w = t.raw("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w")).groupBy("p_partkey", "w").agg(F.collect_list("i").alias("i"))
    m = w.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("w", "i"))).alias("m"))
    return m.select("p_partkey", persons.abstract(F.col("m")).alias("abstract"))


@query
def cite_keys(t):
    return t.raw("part").select("p_partkey", persons.cite_key(F.col("p_name"), F.when(F.col("p_size") > 5, F.col("p_size") + 1950), F.col("p_type")).alias("cite_key"))


# rankings of groups and variants


@query
def cand_subfield(t):
    return corpus.candidacy(flat(t), "subfield_idx", RUN.window)[0].select("group_idx", "source_idx", *r9("weighted_works"))


@query
def division_members(t):
    """Subfields of each two-digit division of a code that a formula gives them."""
    d = t.topics().select("subfield_idx").distinct().withColumn("code", F.lpad((F.col("subfield_idx") * 37 % 2200 + 100).cast("string"), 4, "0"))
    return d.groupBy(F.substring("code", 1, 2).alias("division")).agg(F.array_join(F.sort_array(F.collect_list(F.lpad(F.col("subfield_idx").cast("string"), 2, "0"))), ",").alias("subfields"), F.min("code").alias("first_code"))


@query
def rank_diagnostics(t):
    b = giant_blocks(t, replace(RUN))
    d = ranking.diagnostics(b, candidates(t, RUN.group_col, RUN.window), RUN, RUN.members[0], values=False)
    return t.spark.createDataFrame([tuple(d[k] for k in ("n_s_cands", "n_u_cands", "n_s_ranked", "n_u_ranked"))], "n_s_cands long, n_u_cands long, n_s_ranked long, n_u_ranked long")


@query
def spectral_gap(t):
    """The leading eigenvalues of the ranking's graph, by descending real part; found by iteration, so there is no SQL."""
    d = ranking.diagnostics(giant_blocks(t, replace(RUN, mask="0001")), candidates(t, RUN.group_col, RUN.window), replace(RUN, mask="0001"), RUN.members[0])
    return t.spark.createDataFrame([(k, round(a, 5), round(b, 5)) for k, (a, b) in enumerate(d["values"], 1)], "place int, real_part double, imaginary_part double")


def _variant(name: str, **options) -> None:
    def f(t):
        run = replace(RUN, **options)
        return ranked(giant_blocks(t, run), run)

    f.__name__ = name
    query(f)


_variant("rank_rho1", rho=1)
_variant("rank_omega1", omega=1)
_variant("rank_beta1", beta=1)
_variant("rank_tau", tau_s=2 * RUN.tau_s, tau_u=2 * RUN.tau_u)
_variant("rank_bloc", bloc=BLOC)
_variant("rank_sentinel", epsilon=1)

UNITS = {1: [16, 17, 18, 19], 2: [18, 21, 24]}


@query
def rank_unit(t):
    """Units made of subfields, with a white list, ranked end to end."""
    white = t.sources().filter("source_idx % 10 = 0").select("source_idx")
    out = ranking.rank_units(flat(t), references(t), replace(RUN, tau_s=0.1), UNITS, TOL, white=white, white_least=0.2)
    return out.select("group_idx", "unit_idx", "unit_type", *r9("pi"), F.round("v", 6).alias("v"))


@query
def unit_runs(t):
    """Units worked through by the runner, one batch; read back from what it committed: diagnostics and the sum of scores."""
    run = Runner(t.spark, f"{shared_folder(t.spark.sparkContext)}/quillgraph/runs-{uuid.uuid4().hex}", basis=repr(RUN))
    become = run.run([str(u) for u in UNITS], unit_rankings(flat(t), references(t), RUN, UNITS, 1e-9))
    if set(become.values()) != {"done"}:
        raise RuntimeError(f"units failed: {become}")
    mass = run.committed().groupBy("unit").agg(F.round(F.sum("pi"), 6).alias("mass"))
    return run.committed("diagnostics").drop("mass").join(mass, "unit").select(F.col("unit").cast("long").alias("group_idx"), "n_s_cands", "n_u_cands", "mass")


ALL = replace(RUN, members=tuple(GROUPS))


def grouped(t: Tables) -> DataFrame:
    return flat(t).withColumn("group_idx", F.col(RUN.group_col))


def swept(t: Tables, name: str, runs: dict) -> DataFrame:
    return kept(t, f"sweep-{name}", lambda: ranking.sweep(grouped(t), references(t), candidates(t, RUN.group_col, RUN.window), runs, TOL))


def shown_sweep(df: DataFrame) -> DataFrame:
    return df.select("run", "group_idx", "unit_idx", "unit_type", *r9("pi"), F.round("v", 6).alias("v"))


@query
def sweep_blocs(t):
    """Every group, with works of all countries and with those of one bloc alone, in one sweep."""
    return shown_sweep(swept(t, "blocs", ranking.bloc_runs(ALL, {"world": frozenset(), "bloc": BLOC})))


def sensitivity(t: Tables) -> DataFrame:
    return swept(t, "variants", {"baseline": ALL} | ranking.variants(ALL))


@query
def sweep_variants(t):
    """Every group under the baseline and the five sensitivity runs, in one sweep."""
    return shown_sweep(sensitivity(t))


@query
def variant_agreement(t):
    """Agreement of each variant's scores with the baseline's, in every group and on both sides."""
    return rounded(ranking.agreement(sensitivity(t)), "pearson", "spearman", to=4)


@query
def rank_all_fields(t):
    """Institution graphs of all fields, of each the giant component, ranked in the same jobs."""
    w = flat(t).select("work_idx", F.col("field_idx").alias("group_idx"), "institution_idx", (F.col("inst_weight") * F.col("field_weight")).alias("w"))
    a, b = w.toDF("citer_idx", "group_idx", "src", "wa"), w.toDF("cited_idx", "group_idx", "dst", "wb")
    e = references(t).join(a, "citer_idx").join(b, ["cited_idx", "group_idx"]).groupBy("group_idx", "src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
    e = kept(t, "field graphs", lambda: e)
    nodes = graph.giant_scc(e, ["group_idx"]).withColumnRenamed("node", "unit_idx")
    inside = e.join(nodes.withColumnRenamed("unit_idx", "src"), ["group_idx", "src"], "left_semi").join(nodes.withColumnRenamed("unit_idx", "dst"), ["group_idx", "dst"], "left_semi")
    return spectral.power(kept(t, "field giants", lambda: inside), nodes, tol=TOL, keys=["group_idx"]).select("group_idx", "unit_idx", *r9("pi"))


def with_ranks(t: Tables, shift: int = 0) -> DataFrame:
    """The closed-form scores with sizes and ranks; a shift makes another snapshot of them."""
    r = rankings(t).withColumnRenamed("field_idx", "group_idx")
    k = F.col("unit_idx")
    v = F.col("v") if not shift else F.pmod(k * 7 + F.col("group_idx") * 3 + F.pmod(k * shift, F.lit(5)), F.lit(20)) / 10.0
    r = r.withColumns({"v": v, "a_p": F.pmod(k * (3 + shift), F.lit(17)) + 1.5})
    return spectral.dense_ranks(r.withColumn("unit_type", F.concat_ws("/", "unit_type", F.col("group_idx").cast("string"))).withColumn("pi", F.col("v"))).withColumn("unit_type", F.substring("unit_type", 1, 1))


@query
def ranking_display(t):
    return ranking.shown(with_ranks(t).filter("group_idx = 20"), t.institutions().select(F.col("institution_idx").alias("unit_idx"), "display_name"), "U", 20)


@query
def national_report(t):
    listed = t.institutions().filter("country_code < 'NATION_2'").select(F.col("institution_idx").alias("unit_idx"), F.concat(F.lit("H"), F.col("institution_idx").cast("string")).alias("hep"))
    return ranking.national_report(with_ranks(t), listed)


# comparisons


def institutions_v(t: Tables, shift: int = 0) -> DataFrame:
    r = with_ranks(t, shift).filter("unit_type = 'U'")
    return r.select(F.col("group_idx").alias("div"), "unit_idx", "v", "rank_v", "a_p")


def rated(t: Tables) -> DataFrame:
    k, d = F.col("unit_idx"), F.col("div")
    u = institutions_v(t)
    return u.withColumn("rating", F.when((k + d) % 4 != 0, (k * 3 + d) % 5 + 1).cast("int"))


def diag(t: Tables, shift: int = 0) -> DataFrame:
    n = institutions_v(t).groupBy("div").agg(F.count("*").alias("n"))
    total = t.institutions().agg(F.count("*").alias("all"))
    d = F.col("div")
    return n.crossJoin(F.broadcast(total)).select("div", (100.0 * F.col("n") / F.col("all") - F.when(d % 6 == 0, 60.0).otherwise(0.0)).alias("retained_pct"), (F.pmod(d * 7 + shift, F.lit(20)) / 40.0).alias("gap"), (F.pmod(d * 13, F.lit(60)) / 10.0).alias("pairs_per_work"), (F.col("n") + F.lit(shift)).alias("n_u"), (F.col("n") * 2 + shift * d).alias("n_s"))


@query
def v_tiers(t):
    return institutions_v(t).select("div", "unit_idx", compare.tier(F.col("v")).alias("tier"), compare.rating_label(compare.tier(F.col("v"))).alias("label"))


@query
def rating_codes(t):
    s = t.raw("supplier").select(F.concat(F.lit(" H"), F.col("s_suppkey").cast("string")).alias("hep"), (F.col("s_suppkey") * 31 % 1300).cast("string").alias("code"), (F.col("s_suppkey") % 8).cast("string").alias("value"))
    return compare.rating_codes(s)


@query
def division_indicators(t):
    d = compare.division_indicators(rated(t), diag(t).drop("n_u", "n_s"))
    return rounded(d, "median_3", "median_4", "median_5", "auc", "retained_pct", "gap", "pairs_per_work")


@query
def supplement_roles(t):
    """Cited, citing or both: works outside the corpus that corpus works are linked with."""
    inside, refs = flat(t).select("work_idx").distinct(), all_references(t)
    one = refs.join(inside.toDF("citer_idx"), "citer_idx", "left_semi").select(F.col("cited_idx").alias("work_idx"), F.lit(1).alias("cited"), F.lit(0).alias("citer"))
    two = refs.join(inside.toDF("cited_idx"), "cited_idx", "left_semi").select(F.col("citer_idx").alias("work_idx"), F.lit(0).alias("cited"), F.lit(1).alias("citer"))
    g = one.union(two).join(inside, "work_idx", "left_anti").groupBy("work_idx").agg(F.max("cited").alias("a"), F.max("citer").alias("b"))
    return g.select("work_idx", F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "cited").otherwise("citer").alias("role"))


@query
def concat_key_join(t):
    s = t.raw("supplier")
    asked = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://ror.example/"), (F.col("s_suppkey") * 2).cast("string")).alias("ror"))
    known = s.select(F.col("s_suppkey").cast("string").alias("ror_id"), F.col("s_name").alias("name"))
    return asked.join(known.withColumn("ror", F.concat(F.lit("https://ror.example/"), "ror_id")), "ror").select("id", "ror_id", "name")


@query
def first_of_group(t):
    """Each author's institution on the earliest work."""
    a = t.authorships().join(t.years(), "work_idx")
    return a.groupBy("author_idx").agg(F.min_by("institution_idx", F.struct("publication_year", "work_idx", "institution_idx")).alias("first_inst"), F.min("publication_year").alias("first_year"))


@query
def dashboard_row(t):
    f, r = flat(t), references(t)
    out = f.agg(F.countDistinct("work_idx").alias("n_works"), F.countDistinct("source_idx").alias("n_sources"), F.countDistinct("institution_idx").alias("n_inst"), F.countDistinct("country_code").alias("n_countries"), F.count("*").alias("n_rows"))
    return out.crossJoin(F.broadcast(r.agg(F.count("*").alias("n_refs"), F.countDistinct("citer_idx").alias("n_citing"))))


@query
def windowed_percentile(t):
    w = all_works(t).select("work_idx", "publication_year", "cited_by_count")
    return w.withColumn("p90", F.round(F.percentile("cited_by_count", F.lit(0.9)).over(W.partitionBy("publication_year")), 9)).filter("cited_by_count >= p90")


@query
def percent_of_total(t):
    c = flat(t).groupBy("field_idx").agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6))


@query
def score_residuals(t):
    d = compare.residuals(rated(t).withColumns({"log_v": compare.floored_log10(F.col("v")), "y": F.col("rating").cast("double")}), "log_v", "y")
    return rounded(d.select("div", "unit_idx", "expected", "residual", "deficit"), "expected", "residual", "deficit")


def flagged_units(t: Tables) -> DataFrame:
    return rated(t).filter("rating IS NOT NULL").withColumns({"seat": (F.pmod(F.col("unit_idx") * 5 + F.col("div"), F.lit(3)) == 0).cast("int"), "low": (F.col("rating") <= 3).cast("int")})


@query
def group_tests(t):
    return rounded(compare.two_groups(flagged_units(t), "seat", "v"), "mean_1", "mean_0", "t", "u").drop("ties")


@query
def significance_tests(t):
    return rounded(compare.significance(flagged_units(t), "seat", "v", "low"), "t_p", "u_p", "chi2_p", "fisher_p")


@query
def relative_risks(t):
    return rounded(compare.risks(flagged_units(t).filter("v >= 1"), "seat", "low"), "rate_with", "rate_without", "relative_risk", "excess", "attributable_pct")


@query
def percentile_shifts(t):
    return rounded(compare.percentile_shift(flagged_units(t), "div", "v", "rating").select("div", "unit_idx", "pct_a", "pct_b", "delta_pct"), "pct_a", "pct_b", "delta_pct")


@query
def quantile_tiers(t):
    return compare.quantile_mapped(flagged_units(t), "v", "rating").select("div", "unit_idx", F.col("cat").cast("int").alias("cat"))


def snapshots(t: Tables) -> DataFrame:
    g = F.pmod(F.col("unit_idx"), F.lit(4)).alias("mission")
    return compare.deltas(institutions_v(t), institutions_v(t, 2), ["div", "unit_idx"]).select("*", g)


@query
def snapshot_deltas(t):
    return rounded(snapshots(t), "v_old", "v_new", "delta_v", "pct_change_v")


@query
def deltas_by_mission(t):
    return rounded(compare.by_group(snapshots(t), "mission"), "mean_old", "mean_new", "mean_delta", "pct_gain")


@query
def gainers_and_decliners(t):
    g = snapshots(t).groupBy("unit_idx").agg(F.count("*").alias("n_divs"), F.avg("delta_v").alias("mean_delta")).filter("n_divs >= 10")
    return rounded(compare.extremes(g, "mean_delta", "unit_idx", 5), "mean_delta")


@query
def growth_by_division(t):
    side = lambda s: with_ranks(t, s).withColumnRenamed("group_idx", "div")
    d = compare.growth(side(0), side(2).filter("unit_idx % 9 <> 0"))
    return rounded(d, *(c for c, k in d.dtypes if k == "double"))


@query
def class_crosstab(t):
    s = flat(t).select("subfield_idx", "leiden_idx").distinct().withColumn("division", F.floor(F.col("subfield_idx") / 4))
    return s.groupBy("division", (F.col("division") >= 5).alias("late"), "leiden_idx").agg(F.count("*").alias("n"))


@query
def facet_rows(t):
    r = institutions_v(t).withColumn("panel", F.col("div").cast("string"))
    return rounded(compare.facets(r, "20"), "v", "log_v")


@query
def variant_changes(t):
    one = lambda s: with_ranks(t, s).filter("group_idx = 20")
    return rounded(compare.variant_deltas(one(0), one(2)), "v_base", "v_var", "log_base", "log_var", "delta_v", "delta_log")


@query
def heat_rescale(t):
    return rounded(compare.rescaled(institutions_v(t).select("div", "unit_idx", "v"), "div"), "v", "scaled")


@query
def snapshot_diagnostics(t):
    area = lambda s: diag(t, s).withColumnRenamed("div", "area")
    d = compare.diag_deltas(area(0), area(3))
    return rounded(d, "gap_old", "gap_new", "pct_s", "pct_u", "delta_gap")


@query
def institution_means(t):
    area = lambda s: institutions_v(t, s).withColumnRenamed("div", "area")
    return rounded(compare.mean_over_areas(area(0), area(2)), "mean_old", "mean_new", "delta_mean")


@query
def area_correlations(t):
    """Agreement of two snapshots in each area."""
    j = compare.deltas(institutions_v(t), institutions_v(t, 2), ["div", "unit_idx"])
    return rounded(stats.correlations(j, ["div"], "v_old", "v_new"), "pearson", "spearman")


@query
def committee_units(t):
    hep = F.concat(F.lit("H"), F.col("unit_idx").cast("string"))
    u = rated(t)
    heps = t.institutions().filter("institution_idx % 3 = 0").select(F.col("institution_idx").alias("unit_idx")).withColumn("hep", hep)
    ratings = u.filter("rating IS NOT NULL").select(hep.alias("hep"), F.col("div").alias("for_code"), "rating")
    seats = u.filter("unit_idx % 6 = 0 AND div % 2 = 0").select("div", hep.alias("hep"), (F.col("unit_idx") % 2 + 1).alias("n"))
    return rounded(compare.unit_dataset(u.select("div", "unit_idx", "v"), heps, ratings, seats, ["H3", "H6", "H9"]), "v", "log_v")
