"""Connected components of a graph given as edges, by hooking and pointer jumping over DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): the smallest node that each can reach.

    Each round a node takes the least label of its neighbours' grandparents, hands it on to its own parent, and
    jumps to its grandparent, so rounds grow with the logarithm of a component's breadth. Rounds are written to
    the shared folder; joins read those tables directly, which lets skewed keys be split. Minima are
    combined before they are shuffled. Self-loops and repeated edges are harmless; no edges give no nodes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = durable(both, "cc_edges")
    state = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc_labels")
    written = state
    while True:
        up = state.select(F.col("node").alias("p"), F.col("label").alias("g"))
        jumped = durable(state.join(up, state["label"] == up["p"]).select("node", "label", "g"), "cc_jumped")
        seen = jumped.select(F.col("node").alias("b"), F.col("g").alias("gb"))
        least = both.join(seen, "b").groupBy("a").agg(F.min("gb").alias("m"))
        least = durable(least.join(jumped, least["a"] == jumped["node"]).select("node", "label", "g", "m"), "cc_least")
        handed = least.groupBy("label").agg(F.min("m").alias("h")).select(F.col("label").alias("t"), "h")
        new = least.join(handed, least["node"] == handed["t"], "left")
        new = durable(new.select("node", F.least("label", "g", "m", "h").alias("label"), F.col("label").alias("old")), "cc_labels")
        changed = new.filter("label <> old").limit(1).count()
        discard(written, jumped, least)
        written, state = new, new.select("node", "label")
        if not changed:
            discard(both)
            return state
