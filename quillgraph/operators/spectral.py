"""Spectral scores: power iteration, bipartite ranking, Katz scores, masks and size-adjusted ranks.

Every operator takes keys, the columns that tell many graphs apart; all of them are then solved in the same jobs (`iteration`). A graph
of up to LOCAL_EDGES edges is solved whole by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.model import Run
from quillgraph.operators import iteration, solvers
from quillgraph.operators.edges import Blocks, row_normalised
from quillgraph.operators.iteration import HELD, TOL, joined, unit_sum

#: A graph of up to so many edges and units, which counts check, is solved in numpy by one task; beyond, by joins. Both ways give the same
#: scores; 0 always joins.
LOCAL_EDGES = solvers.TASK_EDGES

Keys = Sequence[str]


def matvec(h: DataFrame, x: DataFrame, units: DataFrame, keys: Keys = ()) -> DataFrame:
    """The units' scores after one step along h: keys, unit_idx, pi."""
    y = h.join(x.select(*keys, F.col("unit_idx").alias("src"), "pi"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("unit_idx")).agg(F.sum(F.col("w") * F.col("pi")).alias("pi"))
    return units.select(*keys, "unit_idx").join(y, [*keys, "unit_idx"], "left").select(*keys, "unit_idx", F.coalesce("pi", F.lit(0.0)).alias("pi"))


def uniform(units: DataFrame, keys: Keys = ()) -> DataFrame:
    n = units.groupBy(*keys).agg(F.count("*").alias("n_"))
    return joined(units, n, keys).select(*keys, "unit_idx", (F.lit(1.0) / F.col("n_")).alias("pi"))


def joint_prior(sources: DataFrame, institutions: DataFrame, kind: str, keys: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """Priors of both sides that sum to 1 together: uniform, the same for every unit; unit_scaled, half to each side."""
    n = [units.groupBy(*keys).agg(F.count("*").alias(c)) for units, c in ((sources, "n_s"), (institutions, "n_u"))]
    n = n[0].join(n[1], list(keys), "full").fillna(0, ["n_s", "n_u"]) if keys else n[0].crossJoin(F.broadcast(n[1]))
    if kind == "uniform":
        each = [1 / F.greatest(F.col("n_s") + F.col("n_u"), F.lit(1))] * 2
    elif kind == "unit_scaled":
        each = [0.5 / F.greatest(F.col(k), F.lit(1)) for k in ("n_s", "n_u")]
    else:
        raise ValueError(f"unknown prior {kind}")
    return tuple(joined(units, n, keys).select(*keys, "unit_idx", x.cast("double").alias("pi")) for units, x in zip((sources, institutions), each))


def power(h: DataFrame, units: DataFrame, alpha: float = 1.0, prior: DataFrame | None = None, tol: float = TOL, keys: Keys = ()) -> DataFrame:
    """The fixed point of x <- alpha h'x + (1 - alpha) prior, scaled to sum 1: the Perron vector for alpha 1."""
    held = HELD if alpha == 1 else 0.0
    mu = prior if prior is not None else uniform(units, keys)
    if alpha < 1:
        mu = mu.withColumn("b", (1 - alpha) * F.col("pi"))
    return unit_sum(iteration.fixed_point(row_normalised(h, keys), mu, keys, 1, alpha, held, alpha < 1, tol, local=LOCAL_EDGES), 1.0, keys)


def katz(h: DataFrame, units: DataFrame, alpha: float, prior: DataFrame | None = None, tol: float = TOL, keys: Keys = ()) -> DataFrame:
    """Katz-Hubbell: what dangling units hold returns through the prior. That only scales the damped scores, so these are solved and
    then scaled to sum 1."""
    return power(h, units, alpha, unit_sum(prior, 1.0, keys) if prior is not None else None, tol, keys)


def bipartite(si: DataFrame, is_: DataFrame, sources: DataFrame, institutions: DataFrame, alpha: float = 1.0, prior: str = "uniform", tol: float = TOL, keys: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """Scores of sources and institutions, each side summing to a half. The two-step chain is never formed: a step goes to
    institutions and back. alpha damps each hop; below 1 the prior is that of sources plus alpha times that of institutions, one
    hop on."""
    held = HELD if alpha == 1 else 0.0
    mu_s, mu_u = joint_prior(sources, institutions, prior, keys) if alpha < 1 else (uniform(sources, keys), None)
    h_si, h_is = row_normalised(si, keys), row_normalised(is_, keys)
    mu = mu_s
    if mu_u is not None:
        n = matvec(h_is, mu_u, sources, keys).withColumnRenamed("pi", "n_")
        mu = unit_sum(mu.join(n, [*keys, "unit_idx"]).select(*keys, "unit_idx", (F.col("pi") + alpha * F.col("n_")).alias("pi")), 1.0, keys)
    # one graph of both sides, on which two hops lead from sources to sources; institutions begin with nothing and get nothing
    code = lambda c, t: (2 * F.col(c) + t).alias(c)
    h = h_si.select(*keys, code("src", 0), code("dst", 1), "w").unionByName(h_is.select(*keys, code("src", 1), code("dst", 0), "w"))
    x = mu.select(*keys, code("unit_idx", 0), "pi").unionByName(institutions.select(*keys, code("unit_idx", 1), F.lit(0.0).alias("pi")))
    if alpha < 1:
        x = x.withColumn("b", (1 - alpha * alpha) * F.col("pi"))
    x = iteration.fixed_point(h, x, keys, 2, alpha * alpha, held, alpha < 1, tol, local=LOCAL_EDGES)
    x = unit_sum(x.filter("unit_idx % 2 = 0").select(*keys, F.shiftright("unit_idx", 1).alias("unit_idx"), "pi"), 1.0, keys)
    u = matvec(h_si, x, institutions, keys)
    if mu_u is not None:
        u = u.join(mu_u.withColumnRenamed("pi", "mu"), [*keys, "unit_idx"]).select(*keys, "unit_idx", (alpha * F.col("pi") + (1 - alpha) * F.col("mu")).alias("pi"))
    return unit_sum(x, 0.5, keys), unit_sum(u, 0.5, keys)


def resolvent(si: DataFrame, is_: DataFrame, sources: DataFrame, institutions: DataFrame, alpha: float, tol: float = TOL) -> tuple[DataFrame, DataFrame]:
    """Scores of both sides, together summing to 1, damped by the root of alpha each hop under the uniform prior: the resolvent,
    as the sum of its series to the tolerance, on the graph of both sides at once."""
    root = alpha**0.5
    code = lambda c, t: (2 * F.col(c) + t).alias(c)
    h = si.select(code("src", 0), code("dst", 1), "w").unionByName(is_.select(code("src", 1), code("dst", 0), "w"))
    units = sources.select(code("unit_idx", 0)).union(institutions.select(code("unit_idx", 1)))
    x = power(h, units, root, None, tol)
    side = lambda t: x.filter(F.col("unit_idx") % 2 == t).select(F.shiftright("unit_idx", 1).alias("unit_idx"), "pi")
    return side(0), side(1)


def joint_graph(b: Blocks, chi: float | None = None, keys: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """All four blocks as one graph; units are (type, idx) folded to 2 idx + type. chi (1 - chi) weighs the blocks between the
    sides; by default chi is the institutions' share of units."""
    code = lambda c, t: 2 * F.col(c) + (0 if t == "s" else 1)
    h = None
    for k, df in b.blocks.items():
        part = df.select(*keys, code("src", k[0]).alias("src"), code("dst", k[1]).alias("dst"), "w", F.lit(k in ("si", "is")).alias("cross_"))
        h = part if h is None else h.unionByName(part)
    units = b.sources.select(*keys, code("unit_idx", "s").alias("unit_idx"), "a_p").union(b.institutions.select(*keys, code("unit_idx", "i").alias("unit_idx"), "a_p"))
    if chi is None or chi < 0:
        share = units.groupBy(*keys).agg(F.avg((F.col("unit_idx") % 2).cast("double")).alias("chi_"))
        h = joined(h, share, keys)
    else:
        h = h.withColumn("chi_", F.lit(float(chi)))
    w = F.when(F.col("cross_"), F.col("chi_") * (1 - F.col("chi_")) * F.col("w")).otherwise(F.col("w"))
    return h.select(*keys, "src", "dst", w.alias("w")), units


def size_adjusted(*sides: tuple[DataFrame, DataFrame, str], sentinel: int | None = None, keys: Keys = ()) -> DataFrame:
    """unit_idx, unit_type, pi, v, a_p of sides (scores, units, type). v: a unit's score per size over that of all sides
    together. The sentinel, of runs that have one, is left out of the sums and has no v."""
    out = None
    for x, units, kind in sides:
        j = x.join(units.select(*keys, "unit_idx", "a_p"), [*keys, "unit_idx"]).withColumn("unit_type", F.lit(kind))
        out = j if out is None else out.unionByName(j)
    real = F.lit(True) if sentinel is None else F.col("unit_idx") != sentinel
    t = out.filter(real).groupBy(*keys).agg(F.sum("a_p").alias("A"), F.sum("pi").alias("P"))
    v = F.when(real & (F.col("P") * F.col("a_p") > 0), F.col("A") * F.col("pi") / F.when(F.col("P") * F.col("a_p") > 0, F.col("P") * F.col("a_p")))
    return joined(out, t, keys).select(*keys, "unit_idx", "unit_type", "pi", v.alias("v"), "a_p")


def dense_ranks(r: DataFrame, keys: Keys = ()) -> DataFrame:
    """rank_pi and rank_v inside each unit_type, missing values last."""
    by = lambda c: W.partitionBy(*keys, "unit_type").orderBy(F.col(c).desc_nulls_last())
    return r.withColumns({"rank_pi": F.dense_rank().over(by("pi")).cast("int"), "rank_v": F.dense_rank().over(by("v")).cast("int")})


def rank(b: Blocks, run: Run, tol: float = TOL, keys: Keys = ()) -> DataFrame:
    """unit_idx, unit_type (S or U), pi, v, a_p and ranks, by the run's mask. The prior enters the ranking between the sides alone; on
    the others damping without a prior changes nothing."""
    adjust = lambda *sides: size_adjusted(*sides, sentinel=run.sentinel if run.epsilon else None, keys=keys)
    if run.mask == "1000":
        out = adjust((power(b.blocks["ss"], b.sources, tol=tol, keys=keys), b.sources, "S"))
    elif run.mask == "0001":
        out = adjust((power(b.blocks["ii"], b.institutions, tol=tol, keys=keys), b.institutions, "U"))
    elif run.mask == "0110":
        s, u = bipartite(b.blocks["si"], b.blocks["is"], b.sources, b.institutions, run.alpha, run.prior, tol, keys)
        out = adjust((s, b.sources, "S"), (u, b.institutions, "U"))
    else:
        h, units = joint_graph(b, run.chi, keys)
        x = power(h, units, tol=tol, keys=keys)
        half = lambda t: x.filter(F.col("unit_idx") % 2 == t).select(*keys, F.shiftright("unit_idx", 1).alias("unit_idx"), "pi")
        out = adjust((half(0), b.sources, "S"), (half(1), b.institutions, "U"))
    return dense_ranks(out, keys)


def mask_graph(b: Blocks, run: Run) -> tuple[DataFrame, DataFrame]:
    """The one graph on which the run's mask walks, and its units, folded to 2 idx + type."""
    return joint_graph(b, run.chi if run.mask == "1111" else 0.5)
