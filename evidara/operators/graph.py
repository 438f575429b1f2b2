"""Closure, topological levels, components and the edge list of the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.session import cut


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor) with the node itself; edges are (node, parent). Loops are safe.

    Every round doubles the length of the ways it knows, so depth d takes about log2(d)
    joins. Only the pairs that the last round found are joined with those known: a shortest
    way of up to twice the length begins with one of them. Each pair is written once.
    """
    fresh = cut(edges.select("node", F.col("parent").alias("ancestor")).where("node <> ancestor").distinct(), "closure")
    known = fresh
    while not fresh.isEmpty():
        step = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        grown = fresh.join(step, "ancestor").select("node", F.col("far").alias("ancestor")).where("node <> ancestor").distinct()
        fresh = cut(grown.join(known, ["node", "ancestor"], "left_anti"), "closure")
        known = known.unionByName(fresh)
    return known.unionByName(nodes.select("node", F.col("node").alias("ancestor")).distinct())


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 without parents, else one more than the deepest parent; nodes on or below a loop have none.

    Peels by rounds: a node is done when all its parents are.
    """
    open_edges = cut(edges.where("node <> parent or node = parent").distinct(), "open")
    left = cut(nodes.select("node").distinct(), "left")
    out, level = [], 0
    while True:
        ready = cut(left.join(open_edges.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if ready.isEmpty():
            break
        out.append(ready)
        left = cut(left.join(ready.select("node"), "node", "left_anti"), "left")
        open_edges = cut(open_edges.join(ready.select(F.col("node").alias("parent")), "parent", "left_anti"), "open")
        level += 1
    none = left.withColumn("level", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, out + [none])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b).

    Each round takes the least label among neighbours and then jumps to the label's own
    label, so long chains close quickly.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "both")
    label = cut(nodes.select("node", F.col("node").alias("l")).distinct(), "label")
    while True:
        offered = both.join(label.select(F.col("node").alias("a"), "l"), "a").groupBy(F.col("b").alias("node")).agg(F.min("l").alias("m"))
        nxt = label.join(offered, "node", "left").select("node", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = nxt.select(F.col("node").alias("l"), F.col("l").alias("far"))
        nxt = cut(nxt.join(jump, "l", "left").select("node", "old", F.least("l", F.coalesce("far", "l")).alias("l")), "label")
        done = nxt.where("old <> l").isEmpty()
        label = nxt.select("node", "l")
        if done:
            return label.select("node", F.col("l").alias("component"))


def parent_pairs(contexts: DataFrame) -> DataFrame:
    """(node, parent) of the parents that exist; ``contexts`` holds one row a record."""
    own = contexts.select(F.col("id").alias("node"), F.explode("parent_ids").alias("parent"))
    return own.join(contexts.select(F.col("id").alias("parent")), "parent", "left_semi").select("node", "parent").distinct()


def effective_facets(contexts: DataFrame, facets: DataFrame) -> DataFrame:
    """Facets of each context and its ancestors, each once: (context_id, facet_id, ...)."""
    up = closure(parent_pairs(contexts), contexts.select(F.col("id").alias("node")))
    own = facets.withColumnRenamed("id", "facet_id").withColumnRenamed("context_id", "ancestor")
    return up.withColumnRenamed("node", "context_id").join(own, "ancestor").drop("ancestor")


def edge_list(t: dict[str, DataFrame]) -> DataFrame:
    """(paper_id, source_id, relationship_type, target_id) of all eleven kinds; tables hold one row a record."""
    owner = t["contexts"].select(F.col("id").alias("context_id"), F.col("paper_id").alias("owner"))
    facets = t["facets"].join(owner, "context_id", "left").withColumn("paper_id", F.col("owner"))

    def edge(df: DataFrame, source, kind: str, target) -> DataFrame:
        return df.select("paper_id", source.alias("source_id"), F.lit(kind).alias("relationship_type"), target.alias("target_id"))

    c = F.col
    state = lambda side: X.state_id(F.coalesce(c(f"{side}.concept"), F.lit("")), F.coalesce(c(f"{side}.state"), F.lit("")))
    parts = [
        edge(t["source_blocks"], c("id"), "IN_PAPER", c("paper_id")), edge(t["contexts"], c("paper_id"), "HAS_CONTEXT", c("id")),
        edge(t["contexts"].select("paper_id", "id", F.explode("parent_ids").alias("p")), c("p"), "PARENT_OF", c("id")),
        edge(facets, c("context_id"), "HAS_FACET", c("id")), edge(t["transitions"], c("paper_id"), "HAS_TRANSITION", c("id")),
        edge(t["transitions"], c("id"), "FROM", c("from_context_id")), edge(t["transitions"], c("id"), "TO", c("to_context_id")),
        edge(t["claims"], c("paper_id"), "HAS_CLAIM", c("id")), edge(t["claims"], c("id"), "FROM", state("from_")), edge(t["claims"], c("id"), "TO", state("to_")),
        edge(t["claims"], c("id"), "SCOPED_TO", c("scope_id")),
        edge(t["claims"].select("paper_id", "id", F.explode("conditioning_facet_ids").alias("f")), c("id"), "CONDITIONED_BY", c("f")),
    ]
    for df in (t["contexts"], facets, t["transitions"], t["claims"]):
        parts.append(edge(df.select("paper_id", "id", F.explode("evidence_block_ids").alias("b")), c("id"), "SUPPORTED_BY", c("b")))
    return reduce(DataFrame.unionByName, parts)
