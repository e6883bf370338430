"""Comparisons of rankings and ratings: tiers, residuals, tests, deltas between snapshots and variants, and datasets of figures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions import order
from quillgraph.functions.order import rank_sums
from quillgraph.functions.stats import average_rank, incomplete_beta

# The least v of each rating from the best down, and what the ratings say.
TIERS = ((1.40, 5), (1.10, 4), (0.80, 3), (0.50, 2))
RATINGS = {5: "Well above world standard", 4: "Above world standard", 3: "At world standard", 2: "Below world standard", 1: "Well below world standard"}


def tier(v: Column) -> Column:
    out = F.lit(1)
    for least, rating in reversed(TIERS):
        out = F.when(v >= least, rating).otherwise(out)
    return F.when(v.isNotNull(), out)


def rating_label(rating: Column) -> Column:
    out = F.lit("Not assessed")
    for k, text in RATINGS.items():
        out = F.when(rating == k, text).otherwise(out)
    return out


def floored_log10(v: Column, floor: float = -3.0) -> Column:
    """log10, and the floor for what is not above 0; null stays null."""
    return F.when(v > 0, F.log10(F.when(v > 0, v))).when(v.isNotNull(), F.lit(floor))


def rating_codes(rows: DataFrame) -> DataFrame:
    """hep, for_code (two digits at least, three become four), rating of rows whose rating is 1 to 5. rows: hep, code, value as text."""
    code = F.lpad(F.trim("code"), 2, "0")
    code = F.when(F.length(F.trim("code")) >= 2, F.trim("code")).otherwise(code)
    code = F.when(F.length(code) == 3, F.concat(F.lit("0"), code)).otherwise(code)
    return rows.filter(F.trim("value").isin(*"12345")).select(F.trim("hep").alias("hep"), code.alias("for_code"), F.trim("value").cast("int").alias("rating"))


def verdict() -> Column:
    """Reliability of a division's ranking, from retained_pct, pairs_per_work, n_units, gap, auc and median_3."""
    return (
        F.when((F.col("retained_pct") < 50) | (F.col("pairs_per_work") < 0.2) | (F.col("n_units") <= 2), "Collapsed (Non-viable)")
        .when((F.col("gap") < 0.10) | (F.col("n_units") < 15), "Fragile / Low coverage")
        .when((F.col("auc") >= 0.75) & (F.abs("median_3") <= 0.15), "Highly Reliable")
        .when((F.col("retained_pct") >= 90) & (F.col("gap") >= 0.20), "Structurally Sound")
        .otherwise("Moderate")
    )


def group_auc(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """key, n_pos, n_neg, auc of a 0/1 label inside each group; null where a side has fewer than two."""
    s = rank_sums(df, [key], label, score)
    ok = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    return s.select(key, "n_pos", "n_neg", F.when(ok, (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / F.when(ok, F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def division_indicators(units: DataFrame, diag: DataFrame) -> DataFrame:
    """Per division of units (div, v, rating): counts, AUC of ratings of 4 and more by v, median log10 v by rating, and the verdict.
    diag: div, retained_pct, gap, pairs_per_work."""
    u = units.withColumns({"log_v": floored_log10(F.col("v")), "high": (F.col("rating") >= 4).cast("int")})
    med = lambda k: F.median(F.when(F.col("rating") == k, F.col("log_v"))).alias(f"median_{k}")
    s = u.groupBy("div").agg(F.count("*").alias("n_units"), F.count("rating").alias("n_rated"), med(3), med(4), med(5))
    return s.join(group_auc(u, "div", "high", "v"), "div", "left").join(diag, "div").withColumn("verdict", verdict())


def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with expected, residual and deficit of y under the line fitted on x; one aggregation, no rows leave their task."""
    fit = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    d = df.crossJoin(F.broadcast(fit)).withColumn("expected", F.col("_a") + F.col("_b") * F.col(x))
    return d.withColumns({"residual": F.col(y) - F.col("expected"), "deficit": F.col("expected") - F.col(y)}).drop("_a", "_b")


def percentile_shift(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """df with pct_a, pct_b (average ranks over the group's size) and delta_pct."""
    d = average_rank(average_rank(df, [key], a, "_ra"), [key], b, "_rb").withColumn("_n", F.count("*").over(W.partitionBy(key)))
    d = d.withColumns({"pct_a": F.col("_ra") / F.col("_n"), "pct_b": F.col("_rb") / F.col("_n")})
    return d.withColumn("delta_pct", F.col("pct_b") - F.col("pct_a")).drop("_ra", "_rb", "_n")


def quantile_mapped(df: DataFrame, v: str, rating: str) -> DataFrame:
    """df with cat: the rating that v would have, were ratings dealt in their own proportions by v. Ratings are few; their
    cumulative shares and v's quantiles at these are one small row."""
    shares = [(r[0], r[1]) for r in df.groupBy(rating).agg(F.count("*").alias("n")).orderBy(rating).collect()]
    total, cum, at = sum(n for _, n in shares), 0, []
    for _, n in shares[:-1]:
        cum += n
        at.append(cum / total)
    if not at:
        return df.withColumn("cat", F.lit(1))
    cuts = df.agg(F.percentile(v, F.array(*map(F.lit, at))).alias("_q"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("cat", F.size(F.filter("_q", lambda q: q < F.col(v))) + 1).drop("_q")


def two_groups(df: DataFrame, flag: str, value: str) -> DataFrame:
    """n, mean and variance of both groups of a 0/1 flag, Student's t of equal variances, and Mann-Whitney's U of the first (1)
    with the sum of t^3 - t over its ties."""
    d = df.filter(F.col(flag).isNotNull() & F.col(value).isNotNull())
    of = lambda k, c: F.when(F.col(flag) == k, F.col(c))
    s = d.agg(*(f(of(k, value)).alias(f"{n}_{k}") for k in (1, 0) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    s = s.crossJoin(F.broadcast(rank_sums(d, [], flag, value).select("r", "ties")))
    pooled = ((F.col("n_1") - 1) * F.col("var_1") + (F.col("n_0") - 1) * F.col("var_0")) / (F.col("n_1") + F.col("n_0") - 2)
    t = (F.col("mean_1") - F.col("mean_0")) / F.sqrt(pooled * (1 / F.col("n_1") + 1 / F.col("n_0")))
    return s.select("n_1", "n_0", "mean_1", "mean_0", t.alias("t"), (F.col("r") - F.col("n_1") * (F.col("n_1") + 1) / 2).alias("u"), "ties")


def significance(df: DataFrame, flag: str, value: str, bad: str) -> DataFrame:
    """One row: p of Student's t and of Mann-Whitney's U for the value in both groups of a 0/1 flag, and of chi-squared and Fisher
    for a 0/1 outcome. Spark reduces to moments, rank sums and four counts; the driver turns these into tails. A p that a sample
    does not define (a group of fewer than two, an empty margin) is null."""
    s, r = two_groups(df, flag, value).first(), risks(df, flag, bad).first()
    table = [[r["n_10"], r["n_11"]], [r["n_00"], r["n_01"]]]
    both = min(s["n_1"], s["n_0"]) >= 2
    n = s["n_1"] + s["n_0"]
    apart = both and s["ties"] < n**3 - n  # not all values equal
    full = all(sum(x) for x in (*table, *zip(*table)))
    row = (
        t_test_p(s["t"], s["n_1"], s["n_0"]) if both and s["t"] is not None else None,
        mann_whitney_p(s["u"], s["n_1"], s["n_0"], s["ties"]) if apart else None,
        chi2_p(table) if full else None, fisher_p(table) if full else None,
    )
    return df.sparkSession.createDataFrame([row], "t_p double, u_p double, chi2_p double, fisher_p double")


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_test_p(t: float, n1: int, n0: int) -> float:
    free = n1 + n0 - 2
    return incomplete_beta(free / 2, 0.5, free / (free + t * t))


def mann_whitney_p(u: float, n1: int, n0: int, ties: float) -> float:
    """Two-sided, by the normal approximation with corrections for ties (the sum of t^3 - t over tied groups) and continuity."""
    n = n1 + n0
    var = n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))
    return min(1.0, normal_tail((max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / math.sqrt(var)))


def chi2_p(table: list[list[int]]) -> float:
    """Of a two by two table, with Yates's correction."""
    (a, b), (c, d) = table
    n = a + b + c + d
    expected = [(a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n]
    x = sum((max(abs(o - e) - min(0.5, abs(o - e)), 0)) ** 2 / e for o, e in zip((a, b, c, d), expected))
    return normal_tail(math.sqrt(x))


def fisher_p(table: list[list[int]]) -> float:
    """Two-sided: all tables of the same margins that are no likelier."""
    (a, b), (c, d) = table
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log = lambda x: choose(a + b, x) + choose(c + d, a + c - x) - choose(a + b + c + d, a + c)
    ps = np.exp([log(x) for x in range(max(0, a + c - c - d), min(a + b, a + c) + 1)])
    return float(min(1.0, ps[ps <= math.exp(log(a)) * (1 + 1e-7)].sum()))


def risks(df: DataFrame, flag: str, bad: str) -> DataFrame:
    """Rates of a 0/1 outcome with and without a 0/1 flag in percent, their ratio and difference, and the share of the latter that
    the lack explains; and the counts of the two by two table."""
    rate = lambda k: 100 * F.avg(F.when(F.col(flag) == k, F.col(bad).cast("double")))
    n = lambda k, o: F.count(F.when((F.col(flag) == k) & (F.col(bad) == o), 1)).alias(f"n_{k}{o}")
    s = df.agg(rate(1).alias("rate_with"), rate(0).alias("rate_without"), n(1, 0), n(1, 1), n(0, 0), n(0, 1))
    gap = F.col("rate_without") - F.col("rate_with")
    return s.withColumns({"relative_risk": F.col("rate_without") / F.greatest("rate_with", F.lit(0.001)), "excess": gap, "attributable_pct": F.when(F.col("rate_without") > 0, 100 * gap / F.greatest("rate_without", F.lit(0.001))).otherwise(0.0)})


def deltas(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, v_old, v_new, delta_v and pct_change_v of units in both snapshots."""
    j = old.select(*key, F.col("v").alias("v_old")).join(new.select(*key, F.col("v").alias("v_new")), key)
    d = F.col("v_new") - F.col("v_old")
    return j.withColumns({"delta_v": d, "pct_change_v": F.when(F.col("v_old") != 0, 100 * d / F.when(F.col("v_old") != 0, F.col("v_old")))})


def by_group(d: DataFrame, group: str) -> DataFrame:
    return d.groupBy(group).agg(F.count("*").alias("n"), F.avg("v_old").alias("mean_old"), F.avg("v_new").alias("mean_new"), F.avg("delta_v").alias("mean_delta"), F.avg("pct_change_v").alias("pct_gain"))


def extremes(d: DataFrame, order: str, key: str, n: int) -> DataFrame:
    """The n first and last rows of a small result, with side."""
    top = d.orderBy(F.desc(F.round(order, 9)), key).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(d.orderBy(F.asc(F.round(order, 9)), F.desc(key)).limit(n).withColumn("side", F.lit("bottom")))


def growth(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per division: units of both types in two rankings (div, unit_type, v, a_p), shares of v from 1 on, mean and total size, and
    growth in percent."""

    def one(df: DataFrame, x: str) -> DataFrame:
        of = lambda t, c: F.when(F.col("unit_type") == t, c)
        n = lambda t: F.count(of(t, F.lit(1)))
        aggs = [n("U").alias(f"n_u_{x}"), n("S").alias(f"n_s_{x}"), F.sum(of("U", F.col("a_p"))).alias(f"total_{x}")]
        aggs += [(100 * F.avg(of(t, (F.coalesce(F.col("v") >= 1, F.lit(False))).cast("double")))).alias(f"ge1_{t.lower()}_{x}") for t in "US"] + [F.avg(of(t, F.col("a_p"))).alias(f"mean_{t.lower()}_{x}") for t in "US"]
        return df.groupBy("div").agg(*aggs)

    j = one(old, "old").join(one(new, "new"), "div")
    g = lambda c: F.when(F.col(f"{c}_old") > 0, 100 * (F.col(f"{c}_new") - F.col(f"{c}_old")) / F.when(F.col(f"{c}_old") > 0, F.col(f"{c}_old")))
    j = j.withColumns({f"growth_{c}": g(c) for c in ("n_u", "n_s", "mean_u", "mean_s", "total")})
    return j.withColumns({f"ratio_{x}": F.when(F.col(f"n_s_{x}") > 0, F.col(f"n_u_{x}") / F.when(F.col(f"n_s_{x}") > 0, F.col(f"n_s_{x}"))) for x in ("old", "new")})


def variant_deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """Units of both rankings (unit_idx, unit_type, v, rank_v): log10 v of each, differences, and ranks gained."""
    j = base.select("unit_idx", "unit_type", F.col("v").alias("v_base"), F.col("rank_v").alias("rank_base")).join(other.select("unit_idx", "unit_type", F.col("v").alias("v_var"), F.col("rank_v").alias("rank_var")), ["unit_idx", "unit_type"])
    j = j.withColumns({"log_base": floored_log10(F.col("v_base")), "log_var": floored_log10(F.col("v_var"))})
    return j.withColumns({"delta_v": F.col("v_var") - F.col("v_base"), "delta_log": F.col("log_var") - F.col("log_base"), "delta_rank": F.col("rank_base") - F.col("rank_var")})


def facets(panels: DataFrame, base: str) -> DataFrame:
    """Institutions of panels (panel, unit_idx, rank_v, v) that the base panel ranks, with their rank there and log10 v."""
    b = panels.filter(F.col("panel") == base).select("unit_idx", F.col("rank_v").alias("rank_base"))
    return panels.join(b, "unit_idx").select("panel", "unit_idx", F.col("rank_v").alias("rank_panel"), "rank_base", "v", floored_log10(F.col("v")).alias("log_v"))


def rescaled(scores: DataFrame, key: str) -> DataFrame:
    """scores (key, v) with scaled: 0 to a half below v 1, a half to 1 above, by the key's least and greatest v."""
    by = W.partitionBy(key)
    lo, hi = F.greatest(1 - F.min("v").over(by), F.lit(1e-9)), F.greatest(F.max("v").over(by) - 1, F.lit(1e-9))
    x = F.when(F.col("v") <= 1, 0.5 * (F.col("v") - F.min("v").over(by)) / lo).when(F.col("v") > 1, 0.5 + 0.5 * (F.col("v") - 1) / hi)
    return scores.withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def diag_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per area: n_s, n_u in two snapshots with percent changes, and the change of the spectral gap."""
    pct = lambda c: F.when(F.col(f"{c}_old") != 0, 100 * (F.col(f"{c}_new") - F.col(f"{c}_old")) / F.when(F.col(f"{c}_old") != 0, F.col(f"{c}_old"))).otherwise(0.0)
    side = lambda d, x: d.select("area", *(F.col(c).alias(f"{c}_{x}") for c in ("n_s", "n_u", "gap")))
    j = side(old, "old").join(side(new, "new"), "area")
    return j.withColumns({"pct_s": pct("n_s"), "pct_u": pct("n_u"), "delta_gap": F.col("gap_new") - F.col("gap_old")})


def mean_over_areas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Units with a mean v over areas in both snapshots (unit_idx, area, v), ranks of the means (averages of ties cut to whole
    numbers) and ranks gained."""
    m = lambda d, x: d.groupBy("unit_idx").agg(F.avg("v").alias(f"mean_{x}"))
    j = m(old, "old").join(m(new, "new"), "unit_idx").dropna()
    for x in ("old", "new"):
        j = order.average_rank(j.withColumn("_n", -F.round(f"mean_{x}", 9)), [], "_n", f"rank_{x}").withColumn(f"rank_{x}", F.floor(f"rank_{x}").cast("int"))
    return j.select("unit_idx", "mean_old", "mean_new", (F.col("mean_new") - F.col("mean_old")).alias("delta_mean"), "rank_old", "rank_new", (F.col("rank_old") - F.col("rank_new")).alias("delta_rank"))


def unit_dataset(ranked: DataFrame, heps: DataFrame, ratings: DataFrame, seats: DataFrame, group: list[str]) -> DataFrame:
    """Rated units of listed institutions: score, log10 score, rating, seats on the division's committee, and whether the
    institution is of a group. ranked: div, unit_idx, v; heps: unit_idx, hep; ratings: hep, for_code, rating; seats: div, hep, n."""
    j = ranked.join(F.broadcast(heps), "unit_idx").join(ratings.withColumnRenamed("for_code", "div"), ["hep", "div"])
    j = j.join(seats.groupBy("div", "hep").agg(F.sum("n").alias("n_seats")), ["div", "hep"], "left").fillna(0, ["n_seats"])
    return j.select("div", "hep", "v", floored_log10(F.col("v")).alias("log_v"), "rating", "n_seats", (F.col("n_seats") > 0).cast("int").alias("has_seat"), F.col("hep").isin(*group).cast("int").alias("in_group"))
