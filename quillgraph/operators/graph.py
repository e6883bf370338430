"""Connected and strongly connected components of edge DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import solvers
from quillgraph.operators.iteration import fixed_plans, of_graphs
from quillgraph.sources.shared import cut

#: Up to so many edges a graph, which counts check, one task finds its strong components; beyond, or with 0, joins do.
LOCAL_EDGES = solvers.TASK_EDGES


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least node of its undirected component. Neighbours' least labels, then labels of labels: the number
    of steps grows with the logarithm of a path's length."""
    both = cut(edges.toDF("node", "other").union(edges.toDF("other", "node").select("node", "other")).distinct())
    labels = cut(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("l"))
        new = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("l", "label")).alias("new"))
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("to"))
        new = cut(new.join(jump, "new").select("node", "label", "to"))
        if new.filter("to < label").isEmpty():
            return new.select("node", F.col("to").alias("label"))
        labels = new.select("node", F.col("to").alias("label"))


#: Nodes are below 2 to the power of twice HALF; a label is a node's priority above the node itself, its halves scattered and exchanged.
HALF = 28


def own_label(node: Column, priority: Column) -> Column:
    """A label of its own for each node. Along a path labels come as if shuffled, which `spread` needs."""
    mask = F.lit((1 << HALF) - 1)
    low, high = node.bitwiseAND(mask), F.shiftright(node, HALF)
    scattered = (low * 165_580_141).bitwiseAND(mask).bitwiseXOR((high * 102_334_155).bitwiseAND(mask))
    return priority * (1 << 2 * HALF) + scattered * (1 << HALF) + high


def spread(edges: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node, label: the greatest of the own labels of all nodes that lead to a node, itself included. labels: keys, node, own.
    A label belongs to a node, so what has come to that node comes on from there at once; since labels are scattered, these leaps
    grow, and rounds with them only slowly, where a path is long."""
    labels = labels.withColumn("label", F.col("own"))
    while True:
        near = edges.join(labels.select(*keys, F.col("node").alias("src"), F.col("label").alias("l")), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.max("l").alias("l"))
        new = labels.join(near, [*keys, "node"], "left").select(*keys, "node", "own", "label", F.greatest("label", F.coalesce("l", "label")).alias("new"))
        with fixed_plans(edges.sparkSession):
            new = cut(new)  # it is read twice below
            far = new.select(*keys, F.col("own").alias("new"), F.col("new").alias("far"))
            new = cut(new.join(far, [*keys, "new"], "left").select(*keys, "node", "own", "label", F.greatest("new", F.coalesce("far", "new")).alias("new")))
        if new.filter("new > label").isEmpty():
            return new.select(*keys, "node", F.col("new").alias("label"))
        labels = new.select(*keys, "node", "own", F.col("new").alias("label"))


def degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node, o, i: edges from and to each node."""
    o = edges.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("o"))
    i = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    return o.join(i, [*keys, "node"], "full").fillna(0, ["o", "i"])


def components_of_roots(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node, label of strong components, all those of a colour's root at once. A node's colour is the node of highest priority
    that reaches it; inside a colour, what leads back to that node is its component. Priority is the logarithm of in- times
    out-degree, so that a giant component's hub is its colour."""
    n = degrees(edges, keys)
    first = cut(n.select(*keys, "node", own_label(F.col("node"), F.floor(F.log2(F.col("o") * F.col("i") + 1)).cast("long")).alias("own")))
    colour = cut(spread(edges, first, keys))
    same = edges.join(colour.withColumnsRenamed({"node": "src", "label": "c"}), [*keys, "src"]).join(colour.withColumnsRenamed({"node": "dst", "label": "d"}), [*keys, "dst"]).filter("c = d")
    back = spread(cut(same.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))), first, keys).withColumnRenamed("label", "back")
    return cut(colour.join(back, [*keys, "node"]).filter("label = back").drop("back"))


def trimmed(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges without those from nodes that nothing reaches, and to nodes that reach nothing: no cycle has them."""
    heads, tails = edges.select(*keys, F.col("dst").alias("src")).distinct(), edges.select(*keys, F.col("src").alias("dst")).distinct()
    return cut(edges.join(heads, [*keys, "src"], "left_semi").join(tails, [*keys, "dst"], "left_semi").select(*keys, "src", "dst"))


def giant_scc(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node: the largest strongly connected component of each graph; of equally large ones, that of the node with most ways through it
    (in- times out-degree in the whole graph), of such nodes the least. Nodes are not negative and below 2**56; those that no cycle has are in no component. A round finds the component of every colour's root;
    graphs whose remaining nodes are fewer than their best are done, as most are after one round."""
    keys = list(keys)
    whole = cut(edges.select(*keys, "src", "dst").distinct())
    many = solvers.large(keys, LOCAL_EDGES, whole)
    few = None
    if keys or not many:
        few = solvers.per_graph(of_graphs(whole, keys, many, False).select(*keys, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), keys, "node long", lambda src, dst: {"node": solvers.giant(src, dst)})
        if not many:
            return cut(few)
    found = giant_by_joins(of_graphs(whole, keys, many, True), keys)
    return found if few is None else cut(found.unionByName(few))


def giant_by_joins(whole: DataFrame, keys: list[str]) -> DataFrame:
    """The same for graphs of any size; whole: their different edges."""
    ways = cut(degrees(whole, keys).select(*keys, "node", (F.col("o") * F.col("i")).alias("ways")))
    left = trimmed(whole, keys)
    loops = cut(left.filter("src = dst").select(*keys, F.col("src").alias("node")))
    none = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("ways"), F.lit(0).cast("long").alias("hub"))
    best = left.select(*keys, F.col("src").alias("node"), F.lit(0).cast("long").alias("label"), none.alias("size")).limit(0)
    while not left.isEmpty():
        found = components_of_roots(left, keys)
        most = F.max(F.struct("ways", (-F.col("node")).alias("hub")))
        sizes = found.join(ways, [*keys, "node"]).groupBy(*keys, "label").agg(F.count("*").alias("n"), most.alias("m"))
        sizes = sizes.select(*keys, "label", F.struct(F.col("n").alias("size"), "m.ways", "m.hub").alias("size"))
        alone = found.join(loops, [*keys, "node"], "left_semi").select(*keys, "label").distinct()
        sizes = sizes.filter("size.size > 1").unionByName(sizes.filter("size.size = 1").join(alone, [*keys, "label"], "left_semi"))
        top = sizes.groupBy(*keys).agg(F.max_by("label", "size").alias("label"), F.max("size").alias("size"))
        both = best.unionByName(found.join(top, [*keys, "label"]).select(*keys, "node", "label", "size"))
        win = both.groupBy(*keys).agg(F.max("size").alias("size"))
        best = cut(both.join(win, [*keys, "size"], "left_semi").select(*keys, "node", "label", "size"))
        gone = found.select(*keys, "node")
        rest = left.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti")
        rest = cut(rest.select(*keys, "src", "dst"))
        many = rest.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
        size = best.select(*keys, F.col("size.size").alias("size")).distinct()
        many = (many.join(size, keys, "left") if keys else many.join(size, F.lit(True), "left")).filter("n >= coalesce(size, 0)")
        left = trimmed(rest.join(F.broadcast(many.select(keys)), keys, "left_semi") if keys else rest if not many.isEmpty() else rest.limit(0), keys)
    return best.select(*keys, "node")


def seed_citations(refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Citations that the seed works (work_idx) receive."""
    return refs.join(seeds.select(F.col("work_idx").alias("cited_idx")).distinct(), "cited_idx", "left_semi").select("citer_idx", "cited_idx")
