"""Tree contraction against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from evidara.operators import hierarchy

SCHEMA = "id string, parent_ids array<string>, label string"


def brute(links):
    """Paths from starts without loop links, and the loops' members with their least id."""
    parents = {v: {p for p in (ps or []) if p in links} for v, ps in links.items()}
    reach = {}
    for v in links:
        seen, todo = set(), list(parents[v])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents[x]
        reach[v] = seen
    loop = {v: min(w for w in reach[v] if v in reach[w]) for v in links if v in reach[v]}

    def paths(v):
        ups = [p for p in parents[v] if not (p in loop and v in loop and loop[p] == loop[v])]
        return [(*q, v) for p in ups for q in paths(p)] or [(v,)]

    return {v: set(paths(v)) for v in links}, loop


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    links = {f"c{i:02d}": [f"c{j:02d}" for j in rng.sample(range(n), rng.choice([0, 1, 1, 1, 2])) if j < i or rng.random() < 0.06] for i in range(n)}
    links["c00"] = None
    rows = [(k, v, "x") for k, v in links.items()]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    h = hierarchy.resolve_hierarchy(df)
    want, loop = brute(links)
    assert {r["node"]: r["cycle_id"] for r in h.cycles.collect()} == loop
    got = {}
    for r in h.paths().collect():
        got.setdefault(r["node"], set()).add(tuple(r["path"]))
    assert got == want
    pairs = {}
    for v, ps in want.items():
        for p in ps:
            for k, a in enumerate(p):
                pairs.setdefault((v, a), set()).add(p[k:])
    above = {(r["node"], r["ancestor"]): (r["least"], r["most"], r["ways"], r["root"]) for r in h.ancestors().collect()}
    starts = {p[0] for ps in want.values() for p in ps}
    assert above == {(v, a): (min(map(len, ws)) - 1, max(map(len, ws)) - 1, len(ws), a if a in starts and a not in loop else None) for (v, a), ws in pairs.items()}


def test_long_chain_takes_few_rounds(spark):
    rows = [(f"n{i:04d}", [f"n{i - 1:04d}"] if i else [], "") for i in range(300)]
    h = hierarchy.resolve_hierarchy(spark.createDataFrame(rows, SCHEMA))
    assert h.cycles.count() == 0
    assert len(h.contraction.removed) < 60
    assert h.paths().agg(F.max("depth")).first()[0] == 299


def test_dirty_parents_and_empty(spark):
    df = spark.createDataFrame([("a", None, ""), ("b", ["a", "a", None, "", "gone"], ""), ("c", [" b "], ""), ("s", ["s"], ""), (None, ["a"], "")], SCHEMA)
    h = hierarchy.resolve_hierarchy(df)
    out = {r["context_id"]: r for r in hierarchy.summarise(h).collect()}
    assert set(out) == {"a", "b", "c", "s"}
    assert (out["c"]["max_depth"], out["c"]["roots"], out["a"]["n_descendants"]) == (2, ["a"], 2)
    assert out["s"]["cycle_id"] == "s" and out["s"]["roots"] == []
    none = hierarchy.resolve_hierarchy(spark.createDataFrame([], SCHEMA))
    assert none.cycles.count() == 0 and none.paths().count() == 0 and hierarchy.summarise(none).count() == 0
