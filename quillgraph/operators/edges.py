"""Citation edge lists between retained units, and the unit-by-unit blocks made of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.order import steady
from quillgraph.model import MASKS, Run
from quillgraph.operators import graph
from quillgraph.operators.iteration import joined


Keys = Sequence[str]


def retained(sc: DataFrame, ic: DataFrame, run: Run, group: int | None, whitelist: DataFrame | None = None, whitelist_least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Sources and institutions of a group, or without one of each group_idx, whose weighted works reach the thresholds; whitelisted
    sources have their own."""
    mine, keys = (F.lit(True), ["group_idx"]) if group is None else (F.col("group_idx") == group, [])
    s = sc.filter(mine)
    size = steady(F.col("weighted_works"))
    big = size >= run.least_s
    if whitelist is not None:
        s = s.join(whitelist.select("source_idx").distinct().withColumn("_w", F.lit(True)), "source_idx", "left")
        big = big | (F.coalesce("_w", F.lit(False)) & (size >= whitelist_least))
    return s.filter(big).select(*keys, "source_idx", "weighted_works"), ic.filter(mine & (size >= run.least_u)).select(*keys, "institution_idx", "weighted_works")


def in_window(fw: DataFrame, run: Run) -> DataFrame:
    return fw.filter(F.col("publication_year").between(*run.window) & F.col(run.group_col).isin(*run.members))


def bloc_excluded(fw: DataFrame, run: Run, bloc: frozenset[str], keys: Keys = ()) -> DataFrame:
    """Works with an institution outside the bloc; an unknown country does not exclude."""
    return in_window(fw, run).filter(~F.col("country_code").isin(*sorted(bloc))).select(*keys, "work_idx").distinct()


def group_works(fw: DataFrame, run: Run, s: DataFrame, u: DataFrame, keys: Keys = ()) -> DataFrame:
    """Work by institution rows of retained units, with the work's weight in the group summed over subfields."""
    f = in_window(fw, run).join(s.select(*keys, "source_idx"), [*keys, "source_idx"], "left_semi").join(u.select(*keys, "institution_idx"), [*keys, "institution_idx"], "left_semi")
    if run.bloc:
        f = f.join(bloc_excluded(fw, run, run.bloc, keys), [*keys, "work_idx"], "left_anti")
    return f.groupBy(*keys, "work_idx", "source_idx", "institution_idx").agg(F.max("inst_weight").alias("inst_weight"), F.max("direct_inst_weight").alias("direct_inst_weight"), F.sum("field_weight").alias("field_weight"))


def reference_sums(pairs: DataFrame, keys: Keys = ()) -> DataFrame:
    return pairs.groupBy(*keys, "citer_work_idx").agg(F.sum("edge_field_weight").alias("R_i"))


CITER = {"work_idx": "citer_work_idx", "source_idx": "citer_source_idx", "institution_idx": "citer_inst_idx", "inst_weight": "inst_weight", "direct_inst_weight": "direct_inst_weight"}
CITED = {"work_idx": "cited_work_idx", "source_idx": "cited_source_idx", "institution_idx": "cited_inst_idx", "inst_weight": "cited_inst_weight", "direct_inst_weight": "direct_cited_inst_weight"}
COLUMNS = [*CITER.values(), *CITED.values(), "edge_field_weight", "R_i"]


def _side(fi: DataFrame, names: dict[str, str], keys: Keys = ()) -> DataFrame:
    return fi.select(*keys, *(F.col(k).alias(v) for k, v in names.items()))


def _sentinel(names: dict[str, str], number: int) -> list:
    work, source, inst, w, dw = names.values()
    return [F.lit(number).cast("long").alias(source), F.lit(number).cast("long").alias(inst), F.lit(1.0).alias(w), F.lit(1.0).alias(dw)]


#: A work is hot if more than one in SHARES of all references name it, and more than FEWEST: at most SHARES works are.
SHARES, FEWEST = 1000, 100_000


def hot_works(refs: DataFrame, column: str, shares: int = SHARES, fewest: int = FEWEST) -> list[int]:
    """Works that a column of the references names so often that they would be most of a task: at most shares of them."""
    total = refs.count()
    if total <= fewest:
        return []
    n = refs.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(max(total // shares, fewest)))
    return [r[0] for r in n.select(column).collect()]


def with_works(refs: DataFrame, works: DataFrame, column: str, hot: Sequence[int], keys: Keys = ()) -> DataFrame:
    """Inner join of rows with one row a work, under the work's name on both sides. Rows of hot works stay where they are, and these works,
    whose number is bounded, go to all tasks; the rest meets by work."""
    on = [c for c in keys if c in refs.columns] + [column]
    if not hot:
        return refs.join(works, on)
    is_hot = F.col(column).isin(list(hot))
    return refs.filter(~is_hot).join(works.filter(~is_hot), on).unionByName(refs.filter(is_hot).join(F.broadcast(works.filter(is_hot)), on))


def work_ends(fi: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row a work: field_weight and ends, its sources and institutions with their weights. A work has few, so rows stay small, and what
    meets the references is as long as the works, not as their institutions."""
    end = F.struct("source_idx", "institution_idx", "inst_weight", "direct_inst_weight")
    return fi.groupBy(*keys, "work_idx").agg(F.max("field_weight").alias("field_weight"), F.sort_array(F.collect_list(end)).alias("ends"))


def _expanded(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """df with its ends as columns of one side."""
    rest = [c for c in df.columns if c != column]
    d = df.select(*rest, F.explode(column).alias("_e"))
    return d.select(*rest, *(F.col(f"_e.{k}").alias(v) for k, v in names.items() if k != "work_idx"))


def work_pairs(works: DataFrame, refs: DataFrame, keys: Keys = (), hot: tuple[Sequence[int], Sequence[int]] = ((), ())) -> DataFrame:
    """Citing and cited works of the group, before any expansion to institutions. works: work_idx, field_weight, a row each."""
    side = lambda name: works.select(*keys, F.col("work_idx").alias(f"{name}_work_idx"), F.col("field_weight").alias(f"{name}_fw"))
    r = refs.toDF("citer_work_idx", "cited_work_idx")
    p = with_works(with_works(r, side("citer"), "citer_work_idx", hot[0]), side("cited"), "cited_work_idx", hot[1], keys)
    return p.withColumn("edge_field_weight", (F.col("citer_fw") + F.col("cited_fw")) / 2)


def edge_list(fw: DataFrame, refs: DataFrame, run: Run, s: DataFrame, u: DataFrame, keys: Keys = (), keep: Callable[[DataFrame], DataFrame] | None = None, hot: tuple[Sequence[int], Sequence[int]] | None = None) -> DataFrame:
    """Edges citer institution by cited institution. Only work pairs and sums by work come before the expansion, which happens inside
    tasks after the last shuffle. keep stores what is used several times. hot: citing and cited works that are most of a task (else looked for)."""
    keep = keep or (lambda d: d)
    r = refs.toDF("citer_work_idx", "cited_work_idx")
    citing, cited = hot or (hot_works(r, "citer_work_idx"), hot_works(r, "cited_work_idx"))
    ends = keep(work_ends(group_works(fw, run, s, u, keys), keys))
    pairs = keep(work_pairs(ends, r, keys, (citing, cited)).select(*keys, "citer_work_idx", "cited_work_idx", "edge_field_weight"))
    sums = reference_sums(pairs, keys)
    citers = ends.select(*keys, F.col("work_idx").alias("citer_work_idx"), F.col("ends").alias("from")).join(sums, [*keys, "citer_work_idx"])
    targets = ends.select(*keys, F.col("work_idx").alias("cited_work_idx"), F.col("ends").alias("to"))
    met = with_works(with_works(pairs, citers, "citer_work_idx", citing, keys), targets, "cited_work_idx", cited, keys)
    el = _expanded(_expanded(met, "from", CITER), "to", CITED).select(*keys, *COLUMNS)
    if not run.epsilon:
        return el
    fi = _expanded(ends, "ends", {k: k for k in CITER})
    return el.unionByName(sentinel_edges(fi, ends.select(*keys, "work_idx", "field_weight"), refs, sums, run.sentinel, keys))


def sentinel_edges(fi: DataFrame, works: DataFrame, refs: DataFrame, sums: DataFrame, number: int, keys: Keys = ()) -> DataFrame:
    """Edges to and from works outside the group, all of which one sentinel stands for; the outer end weighs nothing."""
    citer = works.select(*keys, F.col("work_idx").alias("citer_work_idx"), (F.col("field_weight") / 2).alias("edge_field_weight"))
    cited = works.select(*keys, F.col("work_idx").alias("cited_work_idx"), (F.col("field_weight") / 2).alias("edge_field_weight"))
    r = refs.toDF("citer_work_idx", "cited_work_idx")
    out = r.join(citer, "citer_work_idx").join(cited.drop("edge_field_weight"), [*keys, "cited_work_idx"], "left_anti")
    to = out.join(sums, [*keys, "citer_work_idx"]).join(_side(fi, CITER, keys), [*keys, "citer_work_idx"]).select("*", *_sentinel(CITED, number)).select(*keys, *COLUMNS)
    into = r.join(cited, "cited_work_idx").join(citer.drop("edge_field_weight"), [*keys, "citer_work_idx"], "left_anti")
    outer = into.groupBy(*keys, "citer_work_idx").agg(F.sum("edge_field_weight").alias("R_i"))
    into = into.join(outer, [*keys, "citer_work_idx"]).join(_side(fi, CITED, keys), [*keys, "cited_work_idx"]).select("*", *_sentinel(CITER, number)).select(*keys, *COLUMNS)
    return to.unionByName(into)


def weighted_edges(el: DataFrame, run: Run, keys: Keys = ()) -> DataFrame:
    """Edges with weight ew: for rho 0 scaled by the mean of R_i over its citer's R_i; omega picks the institution weights,
    beta leaves out edges of a unit pair to itself."""
    e = el
    if run.rho == 0:
        mean = el.select(*keys, "citer_work_idx", "R_i").distinct().groupBy(*keys).agg(F.avg("R_i").alias("mean"))
        e = joined(e, mean, keys).withColumn("ew", F.when(F.col("R_i") == 0, 0.0).otherwise(F.col("edge_field_weight") * F.col("mean") / F.when(F.col("R_i") != 0, F.col("R_i"))))
    else:
        e = e.withColumn("ew", F.col("edge_field_weight"))
    if run.beta:
        e = e.filter(~((F.col("citer_source_idx") == F.col("cited_source_idx")) & (F.col("citer_inst_idx") == F.col("cited_inst_idx"))))
    iw, ciw = ("direct_inst_weight", "direct_cited_inst_weight") if run.omega else ("inst_weight", "cited_inst_weight")
    return e.select(*keys, "citer_work_idx", "citer_source_idx", "citer_inst_idx", "cited_work_idx", "cited_source_idx", "cited_inst_idx", F.col(iw).alias("iw"), F.col(ciw).alias("ciw"), "ew")


def block(e: DataFrame, kind: str, keys: Keys = ()) -> DataFrame:
    """src, dst, w of one block. The side that enters by its source must not count once per institution, so its
    institutions are made distinct away first."""
    cs, ds, ci, di = "citer_source_idx", "cited_source_idx", "citer_inst_idx", "cited_inst_idx"
    works = [*keys, "citer_work_idx", "cited_work_idx"]
    if kind == "ss":
        d, src, dst, w = e.groupBy(*works, cs, ds).agg(F.max("ew").alias("w")), cs, ds, F.col("w")
    elif kind == "si":
        d, src, dst, w = e.groupBy(*works, cs, di, "ciw").agg(F.max("ew").alias("w")), cs, di, F.col("w") * F.col("ciw")
    elif kind == "is":
        d, src, dst, w = e.groupBy(*works, ci, ds, "iw").agg(F.max("ew").alias("w")), ci, ds, F.col("w") * F.col("iw")
    else:
        d, src, dst, w = e, ci, di, F.col("ew") * F.col("iw") * F.col("ciw")
    return d.groupBy(*keys, F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum(w).alias("w"))


@dataclass
class Blocks:
    blocks: dict[str, DataFrame]
    sources: DataFrame
    institutions: DataFrame


def with_sentinel(units: DataFrame, run: Run, keys: Keys = ()) -> DataFrame:
    """unit_idx, a_p, and in each graph the sentinel of size 1."""
    one = units.select(*keys).distinct() if keys else units.sparkSession.range(1).select()
    return units.unionByName(one.select("*", F.lit(run.sentinel).cast("long").alias("unit_idx"), F.lit(1.0).alias("a_p")))


def active(el: DataFrame, s: DataFrame, u: DataFrame, run: Run, keys: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """Retained units that the edge list holds on either end, with their size a_p; the sentinel has size 1."""

    def of(units: DataFrame, name: str, a: str, b: str) -> DataFrame:
        ends = el.select(*keys, F.col(a).alias("unit_idx")).union(el.select(*keys, F.col(b).alias("unit_idx"))).distinct()
        found = units.select(*keys, F.col(name).alias("unit_idx"), F.col("weighted_works").alias("a_p")).join(ends, [*keys, "unit_idx"], "left_semi")
        return with_sentinel(found.filter(F.col("unit_idx") != run.sentinel), run, keys) if run.epsilon else found

    return of(s, "source_idx", "citer_source_idx", "cited_source_idx"), of(u, "institution_idx", "citer_inst_idx", "cited_inst_idx")


def blocks(el: DataFrame, s: DataFrame, u: DataFrame, run: Run, keys: Keys = ()) -> Blocks:
    """The blocks that the run's mask asks for, between active units."""
    e = weighted_edges(el, run, keys)
    src, inst = active(el, s, u, run, keys)
    side = {"s": src.select(*keys, "unit_idx"), "i": inst.select(*keys, "unit_idx")}
    out = {}
    for kind in MASKS[run.mask]:
        b = block(e, kind, keys)
        b = b.join(side[kind[0]].withColumnRenamed("unit_idx", "src"), [*keys, "src"], "left_semi")
        out[kind] = b.join(side[kind[1]].withColumnRenamed("unit_idx", "dst"), [*keys, "dst"], "left_semi").select(*keys, "src", "dst", "w")
    return Blocks(out, src, inst)


def giant(b: Blocks, run: Run, keys: Keys = ()) -> Blocks:
    """Units and blocks cut to the giant strongly connected component of all blocks together; the sentinel stays. A side that no
    block has is left alone. Units are (type, idx) folded to 2 idx + type."""
    kinds = {"s": 0, "i": 1}
    code = lambda c, side: (2 * F.col(c) + kinds[side]).alias(c)
    parts = [df.select(*keys, code("src", k[0]), code("dst", k[1])) for k, df in b.blocks.items()]
    h = parts[0]
    for p in parts[1:]:
        h = h.unionByName(p)
    nodes = graph.giant_scc(h, keys)
    keep = {}
    for side, t in kinds.items():
        units = b.sources if side == "s" else b.institutions
        ids = nodes.filter(F.col("node") % 2 == t).select(*keys, F.shiftright("node", 1).alias("unit_idx"))
        keep[side] = ids.union(units.filter(F.col("unit_idx") == run.sentinel).select(*keys, "unit_idx")).distinct() if run.epsilon else ids
    out = {}
    for k, df in b.blocks.items():
        d = df.join(keep[k[0]].withColumnRenamed("unit_idx", "src"), [*keys, "src"], "left_semi")
        out[k] = d.join(keep[k[1]].withColumnRenamed("unit_idx", "dst"), [*keys, "dst"], "left_semi").select(*keys, "src", "dst", "w")
    of = lambda units, side: units.join(keep[side], [*keys, "unit_idx"], "left_semi") if any(side in k for k in b.blocks) else units
    return Blocks(out, of(b.sources, "s"), of(b.institutions, "i"))


def row_normalised(b: DataFrame, keys: Keys = ()) -> DataFrame:
    """Rows that sum to 1; rows without weight stay empty."""
    total = F.sum("w").over(W.partitionBy(*keys, "src"))
    return b.withColumn("t", total).filter("t > 0").select(*keys, "src", "dst", (F.col("w") / F.col("t")).alias("w"))
