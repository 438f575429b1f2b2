"""Operators whose work was a large paper's square, against plain ways on small inputs."""

import itertools

import numpy as np

from evidara.functions import phrases
from evidara.operators import evidence, retrieval


def test_coherence_within_equals_pairwise(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "LEFT_SETS", 2)
    monkeypatch.setattr(retrieval, "RIGHT_SETS", 3)
    rng = np.random.default_rng(3)
    vectors = [(f"f{k}", None if k == 4 else rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist()) for k in range(12)]
    domain = lambda k: (None, "climate", "other", "hydrology", "unheard")[k % 5]
    held = [(f"s{s}", f"f{k}", domain(k)) for s in range(9) for k in range(12) if (s * 7 + k * k) % 4 == 1 and s != 2]
    sets = [("P" if s < 8 else "Q", f"s{s}", s in (0, 2, 3, 5, 8)) for s in range(9)]
    v = spark.createDataFrame(vectors, "facet_id string, n array<double>, c array<double>")
    f = spark.createDataFrame(held, "set_id string, facet_id string, domain string")
    got = retrieval.coherence_within(spark.createDataFrame(sets, "paper_id string, set_id string, asked boolean"), f, v)
    pairs = [(a, b) for (p, a, asked), (q, b, _) in itertools.product(sets, sets) if asked and p == q and a != b]
    want = retrieval.coherence(f.join(v, "facet_id"), spark.createDataFrame(pairs, "left string, right string"))
    told = lambda df: {(r["left"], r["right"]): None if r["coherence"] is None else round(r["coherence"], 10) for r in df.collect()}
    assert told(got) == told(want) and len(pairs) == 28 and got.count() == 28


def test_grounding_takes_supports_one_by_one(spark):
    rows = [("q", "i1", "mechanism", ["c1"], ["f1", "f2"]), ("q", "i2", "mechanism", ["c1"], ["f1", None]), ("q", "i3", "mechanism", ["c1"], None), ("q", "i4", "mechanism", [], ["f1"]), ("q", "i5", "limitation", [], []), (None, "i6", "limitation", ["c1"], []), ("q", "i7", "limitation", ["c2"], ["f1"]), ("q", "i1", "mechanism", ["c1"], ["f9"])]
    items = spark.createDataFrame(rows, "query_id string, item string, kind string, claim_ids array<string>, facet_ids array<string>")
    allowed = lambda *ids: spark.createDataFrame([("q", i) for i in ids] + [("r", "c2"), (None, "c1")], "query_id string, id string")
    x = evidence.grounded(items, allowed("c1"), allowed("f1", "f2", "f2"))
    assert "collect_set" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["item"], tuple(r["facet_ids"] or ()), r["grounded"]) for r in x.collect()} == {
        ("i1", ("f1", "f2"), True), ("i2", ("f1", None), False), ("i3", (), None), ("i4", ("f1",), False), ("i5", (), True), ("i6", (), False), ("i7", ("f1",), False), ("i1", ("f9",), False),
    }


def test_phrases_are_found_wherever_they_stand(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    words = ["a", "ab", "b", "ba", "abb", "c"]
    made = lambda least, most: " ".join(rng.choice(words, rng.integers(least, most)))
    keys, texts = sorted({made(1, 5) for _ in range(80)}), ["", *(made(1, 14) for _ in range(200))]
    assert len(keys) > phrases.FEW
    for own in (keys, keys[:9]):
        p = phrases.Phrases(own)
        assert all(p.found(t) == {k for k in own if k in t} for t in texts)
    monkeypatch.setattr(retrieval, "GROUP_BLOCKS", 30)
    b = spark.createDataFrame([("PQR"[min(k // 90, 2)], f"b{k}", t) for k, t in enumerate(texts)], "paper_id string, block_id string, t string")
    k = spark.createDataFrame([("P", x) for x in keys] + [("Q", "ab c"), ("Q", "ab c"), ("S", "a"), ("P", "")], "paper_id string, key string")
    plain = b.join(k.where("key <> ''").distinct(), "paper_id").where(F.contains("t", "key")).select("paper_id", "key", "block_id")
    assert sorted(map(tuple, retrieval.holding(b, k).collect())) == sorted(map(tuple, plain.collect()))


def test_search_and_budget_do_not_depend_on_parts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = ["soil", "rain", "heat", "crop", "wind"]
    b = [("PQ"[k % 5 == 0], f"b{k:02d}", int(k // 2), " ".join(rng.choice(words, rng.integers(0, 6)))) for k in range(50)]
    q = [("P", "q1", "soil rain soil"), ("P", "q2", "soil rain soil"), ("P", "q3", "fog"), ("P", "q1", "wind"), ("Q", "q4", None), ("R", "q5", "rain")]
    blocks = spark.createDataFrame(b, "paper_id string, block_id string, order_ int, text string")
    v = spark.createDataFrame([(p, i, o, rng.integers(-2, 3, 3).astype(float).tolist() if o % 4 else None) for p, i, o, _ in b], "paper_id string, block_id string, order_ int, v array<double>")
    qv = spark.createDataFrame([("P", "q1", [1.0, 0.0, 2.0]), ("P", "q2", [1.0, 0.0, 2.0]), ("P", "q1", [0.0, 1.0, 0.0]), ("Q", "q4", None), ("Q", "q6", [0.0, 0.0, 0.0])], "paper_id string, query_id string, qv array<double>")
    queries = spark.createDataFrame(q, "paper_id string, query_id string, text string")
    items = spark.createDataFrame([(f"g{k % 7}", f"i{k}", k, int(s), k % 9 == 0) for k, s in enumerate(rng.integers(1, 9, 60))], "group string, id string, pos int, size int, mandatory boolean")
    told = lambda: [sorted(map(tuple, df.collect())) for df in (retrieval.bm25(blocks, queries, 4), retrieval.semantic_blocks(v, qv, 4), evidence.budget_fill(items, 20))]
    whole = told()
    monkeypatch.setattr(retrieval, "GROUP_BLOCKS", 7)
    monkeypatch.setattr(evidence, "GROUPS", 2)
    assert told() == whole
    # every question of a paper with blocks has its four, a text without a hit in order of place
    assert [len([x for x in whole[0] if x[1] == i]) for i in ("q1", "q2", "q3", "q4", "q5")] == [4, 4, 4, 4, 0]
    assert [x[2] for x in sorted(whole[0], key=lambda x: x[4]) if x[1] == "q3"] == [i for p, i, *_ in sorted(b, key=lambda x: (x[2], x[1])) if p == "P"][:4]
    near = {i: max(x @ np.array([1.0, 0.0, 2.0]), x @ np.array([0.0, 1.0, 0.0])) for p, i, _, x in ((r[0], r[1], r[2], np.array(r[3]) if r[3] else None) for r in v.collect()) if p == "P" and x is not None}
    assert [x[3] for x in sorted(whole[1], key=lambda x: x[4]) if x[1] == "q1"] == sorted(near.values(), reverse=True)[:4]
