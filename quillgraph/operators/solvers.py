"""Graphs that fit a task, in numpy: fixed points, leading eigenvalues and giant components, one task a graph.

`iteration` and `graph` take graphs of any size by joins, a few jobs a step. Most graphs are small, and there the steps' own cost is all
of the time; such a graph goes to one task whole. Counts check which do (`large`), and a task holds no more than its bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.shared import ship

Keys = Sequence[str]

#: A graph of up to so many edges and units together is solved by one task, which holds some 24 bytes an edge a few times over.
TASK_EDGES = 5_000_000
#: Rounds of a search by levels, after which it goes on node by node.
LEVELS = 64


def large(keys: Keys, most: int, *rows: DataFrame) -> list[tuple]:
    """Keys of the graphs that have more than so many rows in all of these tables together; their number is that of the runs asked for."""
    n = None
    for df in rows:
        one = df.groupBy(*keys).agg(F.count("*").alias("n_"))
        n = one if n is None else n.unionByName(one)
    return [tuple(r[k] for k in keys) for r in n.groupBy(*keys).agg(F.sum("n_").alias("n_")).filter(F.col("n_") > most).select(*keys, "n_").collect()]


def per_graph(df: DataFrame, keys: Keys, out: str, f: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """keys and f's columns (out names them with their types) of each graph. f gets the graph's other columns in numpy."""
    ship(df.sparkSession)
    types = {c.name: c.dataType.simpleString() for c in df.schema.fields}
    by = list(keys) or ["one_"]
    d = df if keys else df.withColumn("one_", F.lit(0))
    kept = [(k, types.get(k, "int")) for k in by]
    names = df.columns

    def g(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        got = f(**{c: t.column(c).to_numpy() for c in names if c not in by})
        n = len(next(iter(got.values())))
        same = {k: pa.array([t.column(k)[0].as_py()] * n, t.schema.field(k).type) for k in by}
        return pa.table(same | {c: pa.array(x) for c, x in got.items()})

    schema = ", ".join([f"{k} {t}" for k, t in kept]) + ", " + out
    found = d.groupBy(*by).applyInArrow(g, schema)
    return found if keys else found.drop("one_")


class Graph:
    """Row-normalised edges between units, ordered, so that sums do not depend on how rows came."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, units: np.ndarray):
        self.n = len(units)
        order = np.lexsort((src, dst))
        src, dst, w = src[order], dst[order], w[order]
        at = np.unique(src, return_inverse=True)[1] if len(src) else src
        total = np.bincount(at, w)[at] if len(src) else w
        a, b = np.searchsorted(units, src), np.searchsorted(units, dst)
        known = (a < self.n) & (b < self.n) & (total > 0)
        known &= (units[np.minimum(a, self.n - 1)] == src) & (units[np.minimum(b, self.n - 1)] == dst) if self.n else known
        self.src, self.dst, self.w = a[known], b[known], w[known] / total[known]

    def step(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.dst, self.w * x[self.src], self.n) if len(self.w) else np.zeros(self.n)


def unit_scaled(x: np.ndarray) -> np.ndarray:
    total = x.sum()
    return x / total if total > 0 else np.zeros_like(x)


def fixed_vector(step: Callable[[np.ndarray], np.ndarray], x: np.ndarray, affine: bool, tol: float, most: int, cycle: int, combine: Callable[[np.ndarray], np.ndarray | None]) -> tuple[np.ndarray, float]:
    """The fixed point of a map and the last change: cycles of steps, each followed by the combination of least residual."""
    change = np.inf
    for _ in range(max(1, -(-most // cycle))):
        xs = [x]
        for _ in range(cycle):
            xs.append(step(xs[-1]))
        u = np.array(xs if affine else [unit_scaled(y) for y in xs])
        d = np.diff(u, axis=0)
        change = float(np.abs(d[-1]).sum())
        if change < tol:
            return u[-1], change
        c = combine(d @ d.T)
        x = u[-1] if c is None else c @ u[1:]
    return u[-1], change


def giant(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Nodes of the largest strong component of distinct edges, in linear time; of equally large ones that of the node with most ways through
    it, of such nodes the least. A node alone needs an edge to itself."""
    if not len(src):
        return np.zeros(0, np.int64)
    nodes, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, n = both[: len(src)], both[len(src) :], len(nodes)
    ways = np.bincount(a, minlength=n) * np.bincount(b, minlength=n)
    hub = int(np.argmax(ways))
    there, back = reached(a, b, n, hub), reached(b, a, n, hub)
    if there is not None and back is not None and 2 * int((there & back).sum()) > n:
        return nodes[there & back]
    label = strong_labels(a, b, n)
    size = np.bincount(label, minlength=n)
    loops = np.zeros(n, bool)
    loops[label[a[a == b]]] = True
    size = np.where((size > 1) | loops, size, 0)
    if not size.max():
        return np.zeros(0, np.int64)
    inside = size[label] == size.max()
    best = np.flatnonzero(inside & (ways == ways[inside].max()))[0]  # nodes ascend
    return nodes[label == label[best]]


def reached(a: np.ndarray, b: np.ndarray, n: int, start: int) -> np.ndarray | None:
    """Which nodes an edge path from start leads to; None if that takes more than LEVELS rounds."""
    seen = np.zeros(n, bool)
    seen[start] = True
    for _ in range(LEVELS):
        new = b[seen[a] & ~seen[b]]
        if not len(new):
            return seen
        seen[new] = True
    return None


def strong_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A label of each node's strong component, by Tarjan's search."""
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    index, low, label = [-1] * n, [0] * n, [-1] * n
    at, count, found = first[:n], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path, stack = [root], [root]
        index[root] = low[root] = count
        count += 1
        while path:
            x = path[-1]
            if at[x] < first[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if index[y] < 0:
                    index[y] = low[y] = count
                    count += 1
                    path.append(y)
                    stack.append(y)
                elif label[y] < 0 and index[y] < low[x]:
                    low[x] = index[y]
                continue
            path.pop()
            if path and low[x] < low[path[-1]]:
                low[path[-1]] = low[x]
            if low[x] == index[x]:
                while True:
                    y = stack.pop()
                    label[y] = found
                    if y == x:
                        break
                found += 1
    return np.array(label)
