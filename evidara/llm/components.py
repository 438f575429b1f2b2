"""Consolidating pairwise matches into groups.

Union-find runs inside edge partitions of bounded size and keeps only a spanning
forest of each. The forests are merged level by level: every vertex moves to the
least (by a hash that changes with the level) of its local roots, which contracts
the graph by a constant share whatever its shape, until the remaining edges fit one
bounded partition. The vertices' moves are then read backwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.session import cut

#: Edges that one task's union-find may hold.
MAX_EDGES = 100_000


def same_pairs(decisions: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs decided SAME, case and outer blanks ignored, each once.

    A null id, a record paired with itself and a null or other decision give no pair.
    """
    same = F.upper(F.regexp_replace("decision", r"^\s+|\s+$", "")) == "SAME"
    return (
        decisions.where(same & F.col("left_id").isNotNull() & F.col("right_id").isNotNull() & (F.col("left_id") != F.col("right_id")))
        .select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"))
    )


def _forest(order: dict[str, int], pairs: Iterator[tuple[str, str]]) -> dict[str, str]:
    """Each vertex' root, the vertex of least rank in its tree."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        r = x
        while up[r] != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    for a, b in pairs:
        up.setdefault(a, a)
        up.setdefault(b, b)
        ra, rb = root(a), root(b)
        if ra != rb:
            if (order[rb], rb) < (order[ra], ra):
                ra, rb = rb, ra
            up[rb] = ra
    return {x: root(x) for x in up}


def _local_forests(max_edges: int):
    """Spanning forests of a partition's edges, at most about ``max_edges`` at a time, as stars: (x, xh, xm, r, rh, rm), one row a vertex.

    h is a vertex' rank on this level, m the least record it stands for. A task that has
    more edges gives out the forest of what it holds and starts another one.
    """

    def stars(order: dict[str, int], least: dict[str, str], pairs: list[tuple[str, str]]) -> Iterator[pd.DataFrame]:
        rows = list(_forest(order, iter(pairs)).items())
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pd.DataFrame(
                {"x": [x for x, _ in part], "xh": [order[x] for x, _ in part], "xm": [least[x] for x, _ in part],
                 "r": [r for _, r in part], "rh": [order[r] for _, r in part], "rm": [least[r] for _, r in part]}
            )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order: dict[str, int] = {}
        least: dict[str, str] = {}
        pairs: list[tuple[str, str]] = []
        for p in batches:
            for a, ah, am, b, bh, bm in p[["a", "ah", "am", "b", "bh", "bm"]].itertuples(index=False):
                order[a], order[b], least[a], least[b] = ah, bh, am, bm
                pairs.append((a, b))
                if len(pairs) >= max_edges:
                    yield from stars(order, least, pairs)
                    order, least, pairs = {}, {}, []
        yield from stars(order, least, pairs)

    return run


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find of the last, bounded set of edges: (x, group_id)."""
    pairs, least = [], {}
    for p in batches:
        for a, am, b, bm in p[["a", "am", "b", "bm"]].itertuples(index=False):
            pairs.append((a, b))
            least[a], least[b] = am, bm
    roots = _forest(dict.fromkeys(least, 0), iter(pairs))
    best: dict[str, str] = {}
    for x, r in roots.items():
        if r not in best or least[x] < best[r]:
            best[r] = least[x]
    yield pd.DataFrame({"x": list(roots), "group_id": [best[r] for r in roots.values()]}, dtype=object)


STAR = "x string, xh long, xm string, r string, rh long, rm string"


def connected_groups(pairs: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(record_id, group_id) of every record in ``pairs`` (a, b); group_id is the least record of the group.

    Pairs may repeat, in either direction; a pair of one record with itself is
    ignored, an empty input gives no rows. Edges are spread by both ends, so a
    record that holds a third of all pairs is not in one partition; where its
    label is joined back the labels are unique and AQE splits the record's side.
    """
    level = 0
    rank = lambda c: F.xxhash64(F.lit(level), F.col(c))
    edges = pairs.where("a is not null and b is not null and a <> b").select("a", F.col("a").alias("am"), "b", F.col("b").alias("bm"))
    # on the first level the scan partitions are taken as they are, in runs of max_edges: nothing is shuffled before a forest is found
    moves: list[DataFrame] = []
    while True:
        ranked = edges.withColumn("ah", rank("a")).withColumn("bh", rank("b"))
        if level:
            n = edges.count()
            if n <= max_edges:
                last = cut(edges.coalesce(1).mapInPandas(_finish, "x string, group_id string"), "last")
                break
            ranked = ranked.repartition(math.ceil(n / max_edges), "a", "b")
        stars = cut(ranked.mapInPandas(_local_forests(max_edges), STAR), "forest")
        # each vertex moves to the least of its local roots; a root counts as its own
        best = stars.groupBy("x").agg(
            F.min(F.struct(F.col("rh").alias("h"), F.col("r").alias("v"))).alias("to"), F.min("rm").alias("rm"), F.min("xm").alias("xm")
        )
        move = cut(best.select("x", F.col("to.v").alias("v"), "xm"), "move")
        moves.append(move.select("x", "v"))
        # the vertex that others moved to stands for the least record of them all
        stand = move.groupBy(F.col("v")).agg(F.min("xm").alias("m"))
        ends = stars.where("x <> r").select("x", "r").join(move.select("x", F.col("v").alias("a")), "x").select("a", "r").distinct()
        ends = ends.join(move.select(F.col("x").alias("r"), F.col("v").alias("b")), "r").where("a <> b")
        ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = cut(
            ends.join(stand.select(F.col("v").alias("a"), F.col("m").alias("am")), "a").join(stand.select(F.col("v").alias("b"), F.col("m").alias("bm")), "b")
            .select("a", "am", "b", "bm"), "edges",
        )
        level += 1
        settled = cut(stand.join(edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct(), "v", "left_anti"), "settled")
        moves[-1] = (moves[-1], settled)
    label = last
    for move, settled in reversed(moves):
        known = label.select(F.col("x").alias("v"), "group_id").unionByName(settled.select("v", F.col("m").alias("group_id")))
        label = cut(move.join(known, "v").select("x", "group_id"), "label")
    return label.select(F.col("x").alias("record_id"), "group_id")
