"""Fixed points and leading eigenvalues of many sparse graphs at once, by joins.

A graph is a set of rows (keys, src, dst, w); keys tell graphs apart, and all of them step in the same jobs. A cycle applies the map
several times in one plan and keeps the iterates side by side as columns of one table, which is checkpointed. Sums of products
of their differences (one aggregation, a row a graph) are all that the driver sees: it solves a system of the size of a
cycle for the combination of least residual (reduced rank extrapolation), which takes tens of steps where plain iteration takes
hundreds. Graphs that have settled leave the iteration.

A step is one join and one aggregation. Edges stay partitioned by their source; each unit has a row to itself among them that carries its
columns through the step, so that the table of iterates enters a step once and the plan grows by its length alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import solvers
from quillgraph.sources.shared import cut

#: Applications of the map in a cycle.
CYCLE = 8
#: Iterations end when the scores' summed change is below TOL, and fail after MOST applications.
TOL, MOST = 1e-9, 500
#: A graph that a task holds may take so many times MOST, since a step is no job there.
PATIENCE = 40
#: The share of the last scores that stays in a step of an undamped chain, so that graphs of even period converge too.
HELD = 0.1
#: Vectors of the leading eigenspace, their powers in a cycle, and cycles at most.
BLOCK, POWERS, CYCLES = 8, 5, 40

Keys = Sequence[str]


class NotConverged(RuntimeError):
    pass


@contextmanager
def fixed_plans(spark: SparkSession) -> Iterator[None]:
    """Steps of an iteration are alike and their partitions fixed, so planning each of a cycle's stages anew at run time gains nothing
    and takes most of a small step's time."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Held:
    """Edges in memory for all steps of an iteration. They are a named view, since a DataFrame given to sql() is a view that is dropped
    after each call, and dropping a view drops what is cached under it."""

    def __init__(self, df: DataFrame):
        self.name, self.df = f"held_{uuid.uuid4().hex}", df.persist()
        self.df.createOrReplaceTempView(self.name)

    def release(self) -> None:
        self.df.sparkSession.catalog.dropTempView(self.name)
        self.df.unpersist()


@contextmanager
def carried_edges(h: DataFrame, units: DataFrame, keys: Keys) -> Iterator[Held]:
    """Edges, and each unit's row to itself (w null); partitioned by the source, and held until the end of the block."""
    own = units.select(*keys, F.col("unit_idx").alias("src"), F.col("unit_idx").alias("dst"), F.lit(None).cast("double").alias("w"))
    n = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = Held(h.select(*keys, "src", "dst", F.col("w").cast("double").alias("w")).unionByName(own).repartition(n, *keys, "src"))
    try:
        yield held
    finally:
        held.release()


def advanced(state: DataFrame, held: Held, keys: Keys, names: Sequence[str], block: int = 1, times: int = CYCLE, hops: int = 1, new: str = "{t}") -> DataFrame:
    """state after some applications of the map. names: iterates by age; of the last block of them, each application moves every column
    hops steps along the edges to t, puts new (an expression of t, the column's last value x, and b) last, and shifts the others up
    the row, so that all steps are the same code. The plan is one text, since building it call by call takes longer than running it."""
    last, extra = names[-block:], [c for c in state.columns if c not in (*keys, "unit_idx", *names)]
    ts = [f"t_{k}" for k in range(block)]
    of_keys, on = "".join(f"h.{k}, " for k in keys), " AND ".join(["h.src = s.unit_idx", *(f"h.{k} = s.{k}" for k in keys)])
    steps, at = [], "{state}"
    for n in range(times):
        for k in range(hops):
            moved = ", ".join(f"coalesce(sum(h.w * s.{a}), 0D) AS {t}" for t, a in zip(ts, ts if k else last))
            stay = ", ".join(f"max(CASE WHEN h.w IS NULL THEN s.{c} END) AS {c}" for c in (*extra, *names))
            steps.append(f"a{n}_{k} AS (SELECT /*+ SHUFFLE_HASH(s) */ {of_keys}h.dst AS unit_idx, {moved}, {stay} FROM {at} s JOIN {held.name} h ON {on} GROUP BY {of_keys}h.dst HAVING max(CASE WHEN h.w IS NULL THEN 1 END) = 1)")
            at = f"a{n}_{k}"
        shifted = [f"{b} AS {a}" for a, b in zip(names, names[block:])] + [f"{new.format(t=t, x=x)} AS {x}" for t, x in zip(ts, last)]
        steps.append(f"s{n} AS (SELECT {', '.join([*keys, 'unit_idx', *extra, *shifted])} FROM {at})")
        at = f"s{n}"
    return state.sparkSession.sql(f"WITH {', '.join(steps)} SELECT * FROM {at}", state=state)


def rows_by_key(df: DataFrame, keys: Keys) -> dict[tuple, dict]:
    """One row a graph; their number is that of the runs asked for, not of the data."""
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def frame_of(df: DataFrame, keys: Keys, rows: dict[tuple, Sequence[float]], names: Sequence[str]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{n} double" for n in names])
    return df.sparkSession.createDataFrame([(*k, *map(float, v)) for k, v in rows.items()], schema)


def of_graphs(df: DataFrame, keys: Keys, which: list[tuple], inside: bool) -> DataFrame:
    """Rows of the named graphs, or of all others."""
    if not which:
        return df.limit(0) if inside else df
    return df.join(F.broadcast(frame_of(df, keys, {k: () for k in which}, ())), list(keys), "left_semi" if inside else "left_anti") if keys else df if inside else df.limit(0)


def joined(df: DataFrame, small: DataFrame, keys: Keys) -> DataFrame:
    """df with the columns of its graph's row."""
    return df.join(F.broadcast(small), list(keys)) if keys else df.crossJoin(F.broadcast(small))


def sums(df: DataFrame, keys: Keys, **what: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in what.items()))


def unit_sum(x: DataFrame, to: float = 1.0, keys: Keys = ()) -> DataFrame:
    """Scores that sum to a number in each graph; where they sum to 0 they stay."""
    total = sums(x, keys, t_=F.col("pi"))
    pi = F.when(F.col("t_") > 0, to * F.col("pi") / F.when(F.col("t_") > 0, F.col("t_"))).otherwise(F.col("pi"))
    return joined(x, total, keys).select(*keys, "unit_idx", pi.alias("pi"))


def extrapolation(gram: np.ndarray) -> np.ndarray | None:
    """Weights, summing to 1, under which the differences of a cycle's iterates nearly cancel; None if that gains nothing."""
    size = np.sqrt(np.diag(gram))
    if not np.isfinite(gram).all() or (size == 0).any():
        return None
    y = np.linalg.pinv(gram / np.outer(size, size), rcond=1e-13, hermitian=True) @ (1 / size)
    c = y / size
    if not np.isfinite(c).all() or abs(c.sum()) < 1e-300:
        return None
    c = c / c.sum()
    return c if 0 <= c @ gram @ c < gram[-1, -1] else None


def fixed_point(h: DataFrame, x: DataFrame, keys: Keys = (), hops: int = 1, scale: float = 1.0, held: float = 0.0, affine: bool = False, tol: float = TOL, most: int | None = None, local: int = 0) -> DataFrame:
    """keys, unit_idx, pi with pi = held pi + (1 - held)(scale h'..h' pi + b), by hops steps along row-normalised edges.
    x: keys, unit_idx, pi to begin with, and, if affine, b. Without b scores sum to 1 in each graph, and the leading
    eigenvector is found even where mass is lost. A graph of up to local edges and units is solved by one task."""
    if local:
        many = solvers.large(keys, local, h, x)
        few = fixed_in_tasks(of_graphs(h, keys, many, False), of_graphs(x, keys, many, False), keys, hops, scale, held, affine, tol, PATIENCE * (MOST if most is None else most)) if keys or not many else None
        if not many:
            return few
        rest = fixed_point(of_graphs(h, keys, many, True), of_graphs(x, keys, many, True), keys, hops, scale, held, affine, tol, most)
        return rest if few is None else few.unionByName(rest)
    with carried_edges(h, x, keys) as held_edges:
        return cut(_fixed_point(held_edges, x, keys, hops, scale, held, affine, tol, MOST if most is None else most))


def with_units(h: DataFrame, x: DataFrame, keys: Keys, affine: bool = False) -> DataFrame:
    """Edges and units as rows of one table: of a unit's row w is its score, and b what it gets each step."""
    e = h.select(*keys, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"), F.lit(0.0).alias("b"), F.lit(False).alias("unit"))
    u = F.col("unit_idx").cast("long")
    return e.unionByName(x.select(*keys, u.alias("src"), u.alias("dst"), F.col("pi").cast("double").alias("w"), (F.col("b").cast("double") if affine else F.lit(0.0)).alias("b"), F.lit(True).alias("unit")))


def fixed_in_tasks(h: DataFrame, x: DataFrame, keys: Keys, hops: int, scale: float, held: float, affine: bool, tol: float, most: int) -> DataFrame:
    def solve(src: np.ndarray, dst: np.ndarray, w: np.ndarray, b: np.ndarray, unit: np.ndarray) -> dict[str, np.ndarray]:
        order = np.argsort(src[unit])
        units, x0, b0 = src[unit][order], w[unit][order], b[unit][order]
        g = solvers.Graph(src[~unit], dst[~unit], w[~unit], units)

        def step(y: np.ndarray) -> np.ndarray:
            z = y
            for _ in range(hops):
                z = g.step(z)
            return held * y + (1 - held) * (scale * z + b0)

        pi, change = solvers.fixed_vector(step, x0, affine, tol, most, CYCLE, extrapolation) if len(units) else (x0, 0.0)
        return {"unit_idx": units, "pi": pi, "change": np.full(len(units), change)}

    out = cut(solvers.per_graph(with_units(h, x, keys, affine), keys, "unit_idx long, pi double, change double", solve))
    last = out.agg(F.max("change").alias("m"), F.count_distinct(F.when(~(F.col("change") < tol), F.struct(*keys) if keys else F.lit(0))).alias("n")).first()
    if last["n"]:
        raise NotConverged(f"scores of {last['n']} graphs still change by up to {last['m']:.3g} after {most} steps; the tolerance is {tol:g}")
    return out.drop("change")


def _fixed_point(edges: Held, x: DataFrame, keys: Keys, hops: int, scale: float, held: float, affine: bool, tol: float, most: int) -> DataFrame:
    columns = [f"p{k}" for k in range(CYCLE + 1)]
    start = lambda pi: [*keys, "unit_idx", *(["b"] if affine else []), *(pi.cast("double").alias(c) for c in columns)]
    state = cut(x.select(*start(F.col("pi"))))
    new = f"{scale!r}D * {{t}}" + (" + b" if affine else "")
    new = f"{held!r}D * {{x}} + {(1 - held)!r}D * ({new})" if held else new
    done, change = [], {}
    for _ in range(max(1, -(-most // CYCLE))):
        with fixed_plans(x.sparkSession):
            state = cut(advanced(state, edges, keys, columns, hops=hops, new=new))
        u = {c: F.col(c) for c in columns}
        if not affine:  # the map is linear, so iterates scaled to sum 1 afterwards are those of the scaled map
            totals = sums(state, keys, **{f"m{k}": F.col(c) for k, c in enumerate(columns)})
            state = joined(state, totals, keys)
            u = {c: F.when(F.col(f"m{k}") > 0, F.col(c) / F.when(F.col(f"m{k}") > 0, F.col(f"m{k}"))).otherwise(0.0) for k, c in enumerate(columns)}
        state = state.select(*keys, "unit_idx", *(["b"] if affine else []), *(c.alias(n) for n, c in u.items()))
        d = F.col(columns[-1]) - F.col(columns[-2])
        pairs = [f"sum((p{i + 1} - p{i}) * (p{j + 1} - p{j})) AS g{i}_{j}" for i in range(CYCLE) for j in range(i, CYCLE)]
        found = rows_by_key(state.groupBy(*keys).agg(F.sum(F.abs(d)).alias("last"), *map(F.expr, pairs)), keys)
        change = {k: r["last"] or 0.0 for k, r in found.items()}
        settled, open_ = [k for k, x in change.items() if x < tol], {}
        for k, r in found.items():
            if k not in settled:
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(CYCLE)] for i in range(CYCLE)], float)
                c = extrapolation(g)
                open_[k] = c if c is not None else np.eye(CYCLE)[-1]
        if settled:
            done.append(joined(state, frame_of(state, keys, {k: () for k in settled}, ()), keys).select(*keys, "unit_idx", F.col(columns[-1]).alias("pi")) if keys else state.select("unit_idx", F.col(columns[-1]).alias("pi")))
        if not open_:
            break
        weights = [f"c{k}" for k in range(CYCLE)]
        state = joined(state, frame_of(state, keys, open_, weights), keys)
        mixed = sum((F.col(w) * F.col(c) for w, c in zip(weights, columns[1:])), F.lit(0.0))
        state = state.select(*start(mixed))
    else:
        late = {k: x for k, x in change.items() if not x < tol}
        raise NotConverged(f"scores of {len(late)} of {len(change)} graphs still change by up to {max(late.values()):.3g} after {most} steps; the tolerance is {tol:g}")
    out = done[0] if done else x.select(*keys, "unit_idx", "pi")
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def products_of(vectors: DataFrame) -> np.ndarray:
    """Inner products of all columns with each other: a matrix a task, summed by entry."""
    n = len(vectors.columns)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x @ x.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], names=["at", "x"])

    out = np.zeros(n * n)
    for r in vectors.mapInArrow(f, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(n, n)


def projected(gram: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values of the map on the span of a cycle's vectors, by descending size, their weights on those vectors, and residuals.
    gram holds products of the vectors 0..width+n-1; the map takes vector i to vector i + n."""
    a, b, c = gram[:width, :width], gram[:width, n : width + n], gram[n : width + n, n : width + n]
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))
    values, basis = np.linalg.eigh(a / np.outer(size, size))
    keep = values > 1e-9 * values.max()
    q = basis[:, keep] / np.sqrt(values[keep]) / size[:, None]  # columns of weights whose vectors are orthonormal
    theta, y = np.linalg.eig(q.T @ b @ q)
    order = np.lexsort((-theta.imag, -np.abs(theta).round(12)))
    theta, y = theta[order], q @ y[:, order]
    # |H z - theta z|^2 with z = sum of weighted vectors
    square = np.einsum("ik,ij,jk->k", y.conj(), c, y) - 2 * np.real(theta.conj() * np.einsum("ik,ij,jk->k", y.conj(), b, y)) + np.abs(theta) ** 2
    return theta, y, np.sqrt(np.maximum(square.real, 0))


def restarted(theta: np.ndarray, y: np.ndarray, gram: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    """Weights of the real vectors of length 1 that span the leading Ritz vectors, with which the next cycle begins."""
    keep = []
    for k in range(len(theta)):
        if len(keep) < n and theta[k].imag >= -1e-14:
            keep += [y[:, k].real] if abs(theta[k].imag) <= 1e-14 else [y[:, k].real, y[:, k].imag]
    keep = keep[:n] + [np.eye(width)[k] for k in range(n - len(keep[:n]))]
    return [v / np.sqrt(max(v @ gram[:width, :width] @ v, 1e-300)) for v in keep]


def leading_in_task(h: DataFrame, units: DataFrame, n_units: int, n: int, wanted: int, tol: float) -> list[complex]:
    """The same steps in numpy, from scattered vectors of fixed seed."""

    def solve(src: np.ndarray, dst: np.ndarray, w: np.ndarray, b: np.ndarray, unit: np.ndarray) -> dict[str, np.ndarray]:
        ids = np.sort(src[unit])
        g, width = solvers.Graph(src[~unit], dst[~unit], w[~unit], ids), POWERS * n
        v = np.vstack([np.ones(n_units), np.random.default_rng(0).uniform(-1, 1, (n - 1, n_units))])
        theta, left = np.zeros(0), np.zeros(0)
        for _ in range(CYCLES):
            vs = [v]
            for _ in range(POWERS):
                vs.append(np.array([g.step(x) for x in vs[-1]]))
            stack = np.concatenate(vs)
            gram = stack @ stack.T
            theta, y, left = projected(gram, width, n)
            if len(theta) == 0 or (left[:wanted] < tol).all() and (len(theta) >= wanted or len(theta) >= n_units):
                left = np.zeros(wanted)
                break
            v = np.array(restarted(theta, y, gram, n, width)) @ stack[:width]
        theta = theta[:wanted]
        return {"place": np.arange(len(theta)), "re": theta.real.astype(float), "im": theta.imag.astype(float), "residual": left[: len(theta)].astype(float)}

    rows = solvers.per_graph(with_units(h, units.withColumn("pi", F.lit(0.0)), ()), (), "place long, re double, im double, residual double", solve).orderBy("place").collect()
    if any(r["residual"] >= tol for r in rows):
        raise NotConverged(f"residuals of eigenvalues are {[r['residual'] for r in rows]} after {CYCLES} cycles; the tolerance is {tol:g}")
    return [complex(r["re"], r["im"]) for r in rows]


def leading_values(h: DataFrame, units: DataFrame, wanted: int = 4, tol: float = 1e-6, local: int = 0) -> list[complex]:
    """The eigenvalues of greatest size of one row-normalised graph, with multiplicity as far as a block of vectors shows it; fewer, where
    the graph has fewer units. Subspace iteration: a block of vectors is one table, a cycle takes its powers, and the driver solves
    the projected problem of some tens of numbers. It ends when the residuals of all wanted values are below tol. A graph of up to
    local edges and units is solved by one task."""
    n_units = units.count()
    if not n_units:
        return []
    if local and not solvers.large((), local, h, units):
        return leading_in_task(h, units, n_units, min(BLOCK, n_units), min(wanted, n_units), tol)
    with carried_edges(h, units, ()) as held:
        return _leading_values(held, units, n_units, min(BLOCK, n_units), min(wanted, n_units), tol)


def _leading_values(held: Held, units: DataFrame, n_units: int, n: int, wanted: int, tol: float) -> list[complex]:
    start = [F.lit(1.0) if k == 0 else F.pmod(F.xxhash64("unit_idx", F.lit(k)), F.lit(1_000_003)) / 500_001.5 - 1 for k in range(n)]
    spread = lambda vs: [v.alias(f"q{p}_{k}") for p in range(POWERS + 1) for k, v in enumerate(vs)]
    state = cut(units.select("unit_idx", *spread(start)))
    names = [f"q{p}_{k}" for p in range(POWERS + 1) for k in range(n)]
    width = POWERS * n
    theta, left = np.zeros(0), np.zeros(0)
    for _ in range(CYCLES):
        with fixed_plans(units.sparkSession):
            state = cut(advanced(state, held, (), names, n, POWERS))
        gram = products_of(state.select(names))
        theta, y, left = projected(gram, width, n)
        if len(theta) == 0 or (left[:wanted] < tol).all() and (len(theta) >= wanted or len(theta) >= n_units):
            break
        mix = [sum((float(v[i]) * F.col(names[i]) for i in range(width)), F.lit(0.0)) for v in restarted(theta, y, gram, n, width)]
        state = state.select("unit_idx", *(m.alias(f"q{POWERS}_{k}") for k, m in enumerate(mix))).select("unit_idx", *spread([F.col(f"q{POWERS}_{k}") for k in range(n)]))
    else:
        raise NotConverged(f"residuals of eigenvalues are {left[:wanted]} after {CYCLES} cycles; the tolerance is {tol:g}")
    return [complex(t) for t in theta[:wanted]]
