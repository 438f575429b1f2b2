"""Parent-child links to full hierarchies by tree contraction.

A round rakes all leaves and splices an independent set of unary nodes (one parent,
one child): those that outrank, by a hash that changes with the round, whichever of
their two neighbours is unary too. A chain of any length so shrinks by a constant
share. Each removed node is recorded with the edges to its parents as they were. What
no round can remove is a core that holds a loop; its strongly connected parts are
found by colouring. Reading the records backwards then gives every node its ancestors
and paths, and with them depth, roots and descendants. Each round shuffles only the
edges that are left; there is one way for inputs of every size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.session import cut


def parent_edges(df: DataFrame, id_col: str = "id", parents_col: str = "parent_ids") -> tuple[DataFrame, DataFrame]:
    """(nodes: node), (edges: u parent, v child, via, k). Parents that do not exist give no edge.

    Ids are taken once however many copies they have; null, blank and repeated
    parents count for nothing. Other columns are not read.
    """
    slim = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("v"), F.col(parents_col).alias("p")).distinct()
    nodes = cut(slim.select(F.col("v").alias("node")).distinct(), "nodes")
    pairs = slim.select("v", F.explode("p").alias("u")).select(F.regexp_replace("u", r"^\s+|\s+$", "").alias("u"), "v").distinct()
    edges = pairs.join(nodes.select(F.col("node").alias("u")), "u", "left_semi")
    return nodes, cut(edges.select("u", "v", F.array().cast("array<string>").alias("via"), F.lit(0).alias("k")), "edges")


@dataclass
class Contraction:
    """Edges that are left, and for each round the links (u, v, via) of the nodes it removed."""

    core: DataFrame
    removed: list[DataFrame] = field(default_factory=list)


def contract(edges: DataFrame) -> Contraction:
    """Rake and compress until a round removes nothing.

    The number of the round is a column (k), not a constant of the plan, so that all
    rounds run the code that the first one compiled.
    """
    out, e = Contraction(edges), edges
    while True:
        step = cut(_round(_with_degrees(e)), "contract")
        n = {r["kind"]: r["n"] for r in step.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows
        out.core = e = step.where("kind = 'left'").drop("kind")
        if "removed" not in n:
            return out
        out.removed.append(step.where("kind = 'removed'").drop("kind", "k"))
        if "left" not in n:
            return out


def _with_degrees(e: DataFrame) -> DataFrame:
    """Each edge with whether its child is a leaf and whether its ends are unary."""
    ends = e.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    unary = (F.sum("i") == 1) & (F.sum("o") == 1)
    deg = ends.groupBy("node").agg(unary.alias("unary"), (F.sum("o") == 0).alias("leaf"))
    up = deg.select(F.col("node").alias("u"), F.col("unary").alias("u_unary"))
    down = deg.select(F.col("node").alias("v"), F.col("unary").alias("v_unary"), F.col("leaf").alias("v_leaf"))
    return e.join(up, "u").join(down, "v")


def _round(e: DataFrame) -> DataFrame:
    """(u, v, via, k, kind): edges that are ``left`` after a round, and the links of the nodes it ``removed``."""
    rank = lambda c: F.xxhash64("k", c)
    # what the only edge into a unary node and the only one out of it say of it
    into = e.where("v_unary and u <> v").select(
        F.col("v").alias("x"), F.struct("u", "via", "k", (~F.col("u_unary") | (rank("v") > rank("u"))).alias("wins")).alias("up"), F.lit(None).alias("down")
    )
    # a child that is a leaf is raked in this round, so its parent stays
    out_of = e.where("u_unary and u <> v and not v_leaf").select(
        F.col("u").alias("x"), F.lit(None).alias("up"), F.struct("v", "via", (~F.col("v_unary") | (rank("u") > rank("v"))).alias("wins")).alias("down")
    )
    trio = into.unionByName(out_of).groupBy("x").agg(F.any_value("up", True).alias("up"), F.any_value("down", True).alias("down"))
    chosen = trio.where("up.wins and down.wins")
    v_on, u_on = chosen.select(F.col("x").alias("v"), F.lit(True).alias("v_on")), chosen.select(F.col("x").alias("u"), F.lit(True).alias("u_on"))
    # a chosen node's only edge in is its link, its only edge out goes into the joined one
    gone = F.col("v_leaf") | F.col("v_on").isNotNull()
    tagged = e.join(v_on, "v", "left").join(u_on, "u", "left").where(gone | F.col("u_on").isNull())
    kept = tagged.select("u", "v", "via", (F.col("k") + 1).alias("k"), F.when(gone, "removed").otherwise("left").alias("kind"))
    joined = chosen.select(F.col("up.u"), F.col("down.v"), F.concat("up.via", F.array("x"), "down.via").alias("via"), (F.col("up.k") + 1).alias("k"), F.lit("left").alias("kind"))
    return kept.unionByName(joined)


def _trim_top(e: DataFrame) -> DataFrame:
    """Without the edges of nodes that nothing leads to: what hangs above a loop is on none."""
    n = e.count()
    while n:
        targets = e.select(F.col("v").alias("u")).distinct()
        e = cut(e.join(targets, "u", "left_semi"), "trim")
        before, n = n, e.count()
        if n == before:
            break
    return e


def loops(core: DataFrame) -> DataFrame:
    """(node, cycle_id) of the core's nodes that lie on a loop.

    Colouring: the smallest id that reaches a node and the smallest it reaches; where
    the two agree the node belongs to that id's strongly connected part. Parts found
    are taken out and the rest is coloured again. Spliced nodes on an edge within a
    part belong to the part.
    """
    e, found = core, []
    while True:
        e = _trim_top(e)
        if e.isEmpty():
            break
        ends = cut(e.select("u", "v").distinct(), "ends")
        nodes = ends.select(F.col("u").alias("node")).unionByName(ends.select(F.col("v").alias("node"))).distinct()
        color = cut(nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b")), "color")
        while True:
            fw = ends.join(color.select(F.col("node").alias("u"), F.col("f").alias("x")), "u").select(F.col("v").alias("node"), F.col("x").alias("f"), F.lit(None).cast("string").alias("b"))
            bw = ends.join(color.select(F.col("node").alias("v"), F.col("b").alias("x")), "v").select(F.col("u").alias("node"), F.lit(None).cast("string").alias("f"), F.col("x").alias("b"))
            nxt = color.unionByName(fw).unionByName(bw).groupBy("node").agg(F.min("f").alias("f"), F.min("b").alias("b"))
            nxt = cut(nxt.join(color.select("node", F.col("f").alias("f0"), F.col("b").alias("b0")), "node"), "color")
            still = nxt.where("f <> f0 or b <> b0").isEmpty()
            color = nxt.select("node", "f", "b")
            if still:
                break
        part = cut(color.where("f = b").select("node", F.col("f").alias("part")), "part")
        inside = (
            e.join(part.select(F.col("node").alias("u"), F.col("part")), "u")
            .join(part.select(F.col("node").alias("v"), F.col("part").alias("part_v")), "v").where("part = part_v")
        )
        # a part of one node is a loop only if an edge returns to it
        members = inside.select("part", F.explode(F.concat(F.array("u", "v"), "via")).alias("node")).distinct()
        least = members.groupBy("part").agg(F.min("node").alias("cycle_id"))
        found.append(cut(members.join(least, "part").select("node", "cycle_id"), "loops"))
        e = e.join(part.select(F.col("node").alias("u")), "u", "left_anti").join(part.select(F.col("node").alias("v")), "v", "left_anti")
    spark = core.sparkSession
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "node string, cycle_id string")


@dataclass
class Hierarchy:
    nodes: DataFrame
    cycles: DataFrame
    contraction: Contraction

    def _rounds(self) -> list[DataFrame]:
        """The removals of all rounds, the loops' inner links left out, the last round first."""
        removed, core = list(self.contraction.removed), self.contraction.core
        if not core.isEmpty():
            removed += contract(cut(_without_loop_edges(core, self.cycles), "core")).removed
            removed = [_without_loop_edges(r, self.cycles) for r in removed]
        return removed[::-1]

    def _expand(self, first: tuple[Column, ...], grow, gather=None) -> DataFrame:
        """Rows of every node from the rows of its parents, round by round backwards.

        The rows of a round's parents are those of the smaller graph that the round left
        behind, so what is read shrinks with the graph. ``grow`` gives the rows that an edge
        hands down, ``gather`` unites a node's rows from several parents.
        """
        rounds = self._rounds()
        linked = reduce(DataFrame.unionByName, [r.select(F.col("v").alias("node")) for r in rounds]).distinct() if rounds else None
        # the first recovered: nodes that were never linked below another one
        tops = self.nodes.join(linked, "node", "left_anti") if linked is not None else self.nodes
        got = cut(tops.select("node", *first), "expand")
        for r in rounds:
            new = grow(r, got)
            got = cut(got.unionByName(gather(new) if gather else new), "expand")
        return got

    def paths(self) -> DataFrame:
        """(node, path, depth, root): one row per way from a start down to the node.

        A start is a node without (existing) parents; its path is itself, depth 0.
        Links within a loop are not followed, so a loop's members start paths of
        their own unless reached from outside; such paths have a null root. There are
        as many rows as ways: where parents multiply them, use ``ancestors``, which is
        bounded by the pairs of a node and an ancestor.
        """
        def grow(r: DataFrame, got: DataFrame) -> DataFrame:
            up = got.select(F.col("node").alias("u"), F.col("path").alias("head"))
            return r.join(up, "u").select(F.col("v").alias("node"), F.concat("head", "via", F.array("v")).alias("path"))

        got = self._expand((F.array("node").alias("path"),), grow)
        out = got.distinct().select("node", "path", (F.size("path") - 1).alias("depth"), F.col("path")[0].alias("start"))
        return self._rooted(out, "start")

    def ancestors(self) -> DataFrame:
        """(node, ancestor, least, most, ways, root): each node with itself and all above it, once.

        least and most are the numbers of links between them on the shortest and the longest
        way, ways how many there are (null beyond 64 bits); root is the ancestor where paths
        start from it and it is on no loop, else null. Loops are treated as in ``paths``.
        """
        def grow(r: DataFrame, got: DataFrame) -> DataFrame:
            up = got.select(F.col("node").alias("u"), "ancestor", "least", "most", "ways")
            n = F.size("via")
            above = r.join(up, "u").select(F.col("v").alias("node"), "ancestor", (F.col("least") + n + 1).alias("least"), (F.col("most") + n + 1).alias("most"), "ways")
            on_edge = r.select(F.col("v").alias("node"), "via", F.posexplode(F.concat("via", F.array("v"))).alias("p", "ancestor"))
            on_edge = on_edge.where("p < size(via)").unionByName(on_edge.where("p = size(via)").dropDuplicates(["node"]))
            steps = n - F.col("p")
            return above.unionByName(on_edge.select("node", "ancestor", steps.alias("least"), steps.alias("most"), F.lit(1).cast("long").alias("ways")))

        def gather(new: DataFrame) -> DataFrame:
            return new.groupBy("node", "ancestor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.try_sum("ways").alias("ways"))

        first = (F.col("node").alias("ancestor"), F.lit(0).alias("least"), F.lit(0).alias("most"), F.lit(1).cast("long").alias("ways"))
        got = self._expand(first, grow, gather)
        # starts are the nodes that have no ancestor but themselves
        starts = got.groupBy("node").agg(F.count("*").alias("n")).where("n = 1").select(F.col("node").alias("start"))
        got = got.join(starts, F.col("ancestor") == F.col("start"), "left")
        return self._rooted(got, "start")

    def _rooted(self, got: DataFrame, start: str) -> DataFrame:
        on = self.cycles.select(F.col("node").alias(start), F.lit(True).alias("looped"))
        keep = [c for c in got.columns if c != start]
        return got.join(on, start, "left").select(*keep, F.when(F.col("looped").isNull(), F.col(start)).alias("root"))


def _without_loop_edges(e: DataFrame, cycles: DataFrame) -> DataFrame:
    cu = cycles.select(F.col("node").alias("u"), F.col("cycle_id").alias("cu"))
    cv = cycles.select(F.col("node").alias("v"), F.col("cycle_id").alias("cv"))
    return e.join(cu, "u", "left").join(cv, "v", "left").where("cu is null or cv is null or cu <> cv").select(*e.columns)


def resolve_hierarchy(df: DataFrame, id_col: str = "id", parents_col: str = "parent_ids") -> Hierarchy:
    """Contract the parent links of ``df``; ``.cycles``, ``.paths()`` and ``.ancestors()`` hold the results.

    Nulls and blanks among the parents are ignored, a node that is its own parent is
    a loop, an empty table gives empty results.
    """
    nodes, edges = parent_edges(df, id_col, parents_col)
    c = contract(edges)
    return Hierarchy(nodes, cut(loops(c.core), "cycles"), c)


def summarise(h: Hierarchy) -> DataFrame:
    """(context_id, roots, min_depth, max_depth, n_paths, n_descendants, cycle_id) for every node.

    Depths and paths count from the starts; the roots are those starts that are on no loop.
    """
    up = cut(h.ancestors(), "ancestors")
    tops = up.groupBy("node").agg(F.count("*").alias("n")).where("n = 1").select(F.col("node").alias("ancestor"))
    own = up.join(tops, "ancestor", "left_semi").groupBy("node").agg(
        F.array_sort(F.collect_set("root")).alias("roots"), F.min("least").alias("min_depth"), F.max("most").alias("max_depth"), F.try_sum("ways").alias("n_paths")
    )
    below = descendants(up).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    return (
        h.nodes.join(own, "node", "left").join(below, "node", "left").join(h.cycles, "node", "left")
        .select(F.col("node").alias("context_id"), "roots", "min_depth", "max_depth", "n_paths", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), "cycle_id")
    )


def descendants(ancestors: DataFrame) -> DataFrame:
    """(ancestor, descendant, least, most): all that lies below each node, each pair once."""
    return ancestors.where("node <> ancestor").select("ancestor", F.col("node").alias("descendant"), "least", "most")
