"""Retrieval, ranking, paths and evidence against plain Python on small inputs."""

import random

import numpy as np
import pytest

from evidara.functions import text as X
from evidara.functions import vector as N
from evidara.functions import vocabulary as V
from evidara.operators import curation, evidence, graph, indexing, paths, retrieval
from pyspark.sql import functions as F


def test_text_goldens(spark):
    rows = [("  Low–level  moisture flux! ",), (None,), ("ＥＴ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.text_key(F.col("t"))).collect()]
    assert got == ["low-level moisture flux", "", "et"]
    names = {"ET": "evapotranspiration", "afternoon convective precipitation": "convective precipitation", "sahel precipitation": "precipitation"}
    df = spark.createDataFrame(list(names.items()), "a string, b string")
    assert df.where(X.canonical_concept(X.text_key(F.col("a"))) != F.col("b")).count() == 0
    states = {"no significant change": "no_detectable_change", "increased likelihood of occurrence": "more_frequent", "increased from 0.14 to 0.35": "increase", "decreased by 40%": "decrease"}
    df = spark.createDataFrame(list(states.items()), "a string, b string")
    assert df.where(X.canonical_direction(X.text_key(F.col("a"))) != F.col("b")).count() == 0
    one = spark.range(1).select(X.state_id(F.lit("surface temperature"), F.lit("increase")), X.token_count(F.lit("")), X.token_count(F.lit("x" * 8))).first()
    assert tuple(one) == ("state::surface_temperature::increase", 1, 3)


def test_scales(spark):
    rows = [("a 14.4 × 14.4 km box, 10-40 km wide storms on flat land, and a halo of 1–2 km",), ("2-3 m annuli; then, much further on in the text, from 110 - 120 KM away",), (None,), ("",), ("10-20-30 km",)]
    got = [[(x["kind"], x["low"], x["high"], x["unit"]) for x in r[0]] for r in spark.createDataFrame(rows, "t string").select(X.scales(F.col("t"))).collect()]
    assert got == [
        [("rectangle", 14.4, 14.4, "km"), ("range", 10.0, 40.0, "km"), ("distance_band", 1.0, 2.0, "km")],
        [("distance_band", 2.0, 3.0, "m"), ("range", 110.0, 120.0, "km")], [], [], [("range", 20.0, 30.0, "km")],
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0]), ([], [1.0]), (None, [1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(N.dot(F.col("a"), F.col("b"))).collect()] == [11.0, 0.0, 0.0, 0.0]
    assert df.select(N.unit(F.col("a"))).collect()[3][0] == [0.0, 0.0]


def test_exact_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    items = spark.createDataFrame([(f"i{k:02d}", v.tolist()) for k, v in enumerate(x)] + [("null", None)], "id string, v array<double>")
    q = spark.createDataFrame([("q0", x[3].tolist()), ("q1", None)], "query_id string, qv array<double>")
    got = [(r["id"], r["rank"]) for r in retrieval.exact_topk(q, items, 5).where("query_id = 'q0'").orderBy("rank").collect()]
    want = sorted(range(60), key=lambda k: (-max(0, x[k] @ x[3]), k))[:5]
    assert got == [(f"i{k:02d}", r + 1) for r, k in enumerate(want)]
    assert retrieval.exact_topk(q, items, 5).where("query_id = 'q1'").count() == 5


def test_maxsim_golden(spark):
    qf = spark.createDataFrame([("q", "f", "climate", [1.0, 0.0], [1.0, 0.0])], "query_id string, query_facet_id string, domain string, qn array<double>, qc array<double>")
    cand = spark.createDataFrame([("q", "c1", "g", "climate", [1.0, 0.0], [0.8, 0.6])], "query_id string, context_id string, facet_id string, domain string, cn array<double>, cc array<double>")
    pairs = spark.createDataFrame([("q", "c1"), ("q", "c2")], "query_id string, context_id string")
    got = {r["context_id"]: (r["semantic"], r["coverage"], r["overall"]) for r in retrieval.maxsim(qf, cand, pairs).collect()}
    assert got["c1"] == (pytest.approx(0.87), 1.0, pytest.approx(0.87)) and got["c2"] == (0.0, 0.0, 0.0)


def test_bm25_order(spark):
    b = spark.createDataFrame([("P", "b1", 0, "soil moisture"), ("P", "b2", 1, "irrigation changes heat"), ("P", "b3", 2, "")], "paper_id string, block_id string, order_ int, text string")
    q = spark.createDataFrame([("P", "q", "irrigation heat")], "paper_id string, query_id string, text string")
    assert [r["block_id"] for r in retrieval.bm25(b, q, 3).orderBy("rank").collect()] == ["b2", "b1", "b3"]


def brute_paths(mode, ranked, sources, targets):
    if mode == "global" or not (sources if mode in ("forward", "a_to_b") else targets):
        return [[c] for c, *_ in sorted(ranked, key=lambda r: (-r[3], r[0]))[: V.MAX_PATHS]]
    rows = {c: (f, t, s, a) for c, f, t, s, a in ranked}

    def score(cs):
        known = [rows[c][3] for c in cs if rows[c][3] is not None]
        return (min(known) if known else 1.0) * sum(rows[c][2] for c in cs) / len(cs) / (1 + V.LENGTH_PENALTY * (len(cs) - 1))

    beam = [([s], []) for s in (sources if mode in ("forward", "a_to_b") else targets)]
    done = []
    for _ in range(V.MAX_LENGTH):
        nxt = []
        for states, cs in beam:
            for c, (f, t, _, _) in rows.items():
                a, b = (t, f) if mode == "backward" else (f, t)
                if a == states[-1] and c not in cs and b not in states:
                    nxt.append((states + [b], cs + [c]))
        done += [x for x in nxt if mode != "a_to_b" or x[0][-1] in targets]
        beam = sorted(nxt, key=lambda x: (-score(x[1]), len(x[1]), x[1]))[: V.BEAM]
    return [x[1] for x in sorted(done, key=lambda x: (-score(x[1]), len(x[1]), x[1]))[: V.MAX_PATHS]]


def test_beam_equals_plain_search(spark):
    rng = random.Random(3)
    modes, want, ranked, seeds = ["forward", "backward", "a_to_b", "global"], {}, [], []
    for g in range(12):
        q, mode = f"q{g:02d}", modes[g % 4]
        rows = [(f"k{i:02d}", f"s{rng.randrange(7)}", f"s{rng.randrange(7)}", rng.randrange(1, 1000) / 1000, rng.choice([None, rng.randrange(1, 1000) / 1000])) for i in range(40)]
        rows.sort(key=lambda r: (-r[3], r[0]))
        src, dst = [f"s{rng.randrange(7)}"], [f"s{rng.randrange(7)}"]
        want[q] = brute_paths(mode, rows, src, dst)
        ranked += [(q, c, i + 1, s, a, f, t) for i, (c, f, t, s, a) in enumerate(rows)]
        seeds += [(q, "source", s) for s in src] + [(q, "target", s) for s in dst]
    qs = spark.createDataFrame([(f"q{g:02d}", modes[g % 4]) for g in range(12)], "query_id string, mode string")
    r = spark.createDataFrame(ranked, "query_id string, claim_id string, rank int, score double, applicability double, from_state string, to_state string")
    s = spark.createDataFrame(seeds, "query_id string, side string, state_id string")
    got = {}
    for x in paths.search(qs, r, s).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["claims"])
    assert {k: v for k, v in want.items() if v} == got


PATHS, ALTS, HELD = "array<struct<rank:int,claims:array<string>,score:double>>", "array<struct<claim_id:string,focal_claim_id:string,classification:string>>", "array<struct<id:string,k:int,block_id:string,text:string>>"


def packed(spark, row, *budgets):
    df = spark.createDataFrame([row], f"query_id string, mode string, paths {PATHS}, alternatives {ALTS}, claims array<struct<id:string,conditioning_facet_ids:array<string>>>, held {HELD}")
    return evidence.packages(df, *budgets).orderBy("pos").collect()


def test_packages_shorten_the_first_path(spark):
    row = ("q", "forward", [(1, ["CL1", "CL2"], 0.9)], None, [("CL1", None), ("CL2", None)], [(c, 1, f"b{c}", "supported result " * 20) for c in ("CL1", "CL2")])
    got = packed(spark, row, 1, 10_000, 1)
    assert [(r["claim_id"], r["blocks"], r["warnings"]) for r in got] == [("CL1", ["bCL1"], ["SOURCEBLOCK_BUDGET_TRUNCATED"])]
    assert packed(spark, row, 1, 1, 5) == []


def test_packages_give_up_second_blocks_for_alternatives(spark):
    row = ("q", "forward", [(1, ["c1"], 0.9)], [("c2", "c1", "opposite")], [("c1", None), ("c2", None)], [("c1", 1, "b1", "x" * 100), ("c1", 2, "b2", "x" * 300), ("c2", 1, "b3", "x" * 300)])
    df = spark.createDataFrame([(f"{b:03d}", *row[1:], b) for b in range(60, 520, 20)], f"query_id string, mode string, paths {PATHS}, alternatives {ALTS}, claims array<struct<id:string,conditioning_facet_ids:array<string>>>, held {HELD}, b int")
    seen = []
    for b in range(60, 520, 20):
        got = [(r["claim_id"], r["blocks"]) for r in evidence.packages(df.where(f"b = {b}"), b, b).orderBy("pos").collect()]
        if not seen or seen[-1] != got:
            seen.append(got)
    assert seen == [[("c1", ["b1"])], [("c1", ["b1", "b2"])], [("c1", ["b1"]), ("c2", ["b3"])], [("c1", ["b1", "b2"]), ("c2", ["b3"])]]


def test_budget_fill_skips_and_continues(spark):
    rows = [("g", "a", 1, 5, False), ("g", "b", 2, 9, False), ("g", "c", 3, 4, False), ("g", "m", 4, 50, True), ("g", "d", 5, 1, False)]
    df = spark.createDataFrame(rows, "group string, id string, pos int, size int, mandatory boolean")
    assert [r["id"] for r in evidence.budget_fill(df, 10).orderBy("pos").collect()] == ["a", "c", "m"]


def test_reversals_and_checks(spark):
    rows = [("c1", "s", "causal", ("a", "x"), ("b", "q"), 1), ("c2", "s", "causal", ("a", "x"), ("b", "q"), 2)]
    ends = "struct<concept:string,state:string>"
    df = spark.createDataFrame([(i, s, r, f, (t[0], "increase" if k == 1 else "decrease")) for i, s, r, f, t, k in rows], f"id string, scope_id string, relation string, from_ {ends}, to_ {ends}")
    from evidara.operators.ranking import canonical_claims

    assert {r["claim_id"] for r in curation.reversals(canonical_claims(df)).collect()} == {"c1", "c2"}
    row = dict(
        query_id="q", expected_id="q", mode="forward", expected_mode="forward", n_facets=1, expects_context=True, gate_disabled=None, has_source=True, has_target=False, source_seeds=1, target_seeds=0, ranked=["CL1"],
        path_claims=[["CL1"], ["CL9"]], path_applicability=[None], n_blocks=1, n_items=1, provenance=["CL1"], required=[["CL1"], ["CL2", "CL3"]], answer="text", warnings=None,
    )
    blank = dict.fromkeys(row) | {"query_id": "r", "expected_id": "s", "answer": " ", "warnings": [evidence.UNGROUNDED]}
    got = evidence.report_checks(spark.createDataFrame([row, blank], evidence.CHECKED)).collect()
    assert sum(r["query_id"] == "q" for r in got) == 12 + 2 + 2 and sum(r["query_id"] == "r" for r in got) == 12
    failed = {r["check"] for r in got if r["query_id"] == "q" and not r["passed"]}
    assert failed == {"paths_use_ranked_claims", "known_path_applicability", "required_claim_group_2"}
    assert {r["check"] for r in got if r["query_id"] == "r" and r["passed"]} == {"query_mode", "query_context", "source_state_mapping", "target_state_mapping", "paths_use_ranked_claims"}


def test_semantic_blocks_and_facet_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 8))
    rows = [("P" if i % 2 else "Q", f"b{i:02d}", i, x[i].tolist() if i != 7 else None) for i in range(40)] + [("P", "b99", 99, x[1].tolist())]
    b = spark.createDataFrame(rows, "paper_id string, block_id string, order_ int, v array<double>")
    q = spark.createDataFrame([("P", "q", x[1].tolist()), ("P", "q", x[4].tolist()), ("Q", "r", None)], "paper_id string, query_id string, qv array<double>")
    for part in (retrieval.GROUP_BLOCKS, 3):
        old, retrieval.GROUP_BLOCKS = retrieval.GROUP_BLOCKS, part
        got = [(r["query_id"], r["block_id"]) for r in retrieval.semantic_blocks(b, q, 4).orderBy("rank").collect()]
        retrieval.GROUP_BLOCKS = old
        best = sorted((i for i in range(1, 40, 2) if i != 7), key=lambda i: (-round(max(x[i] @ x[1], x[i] @ x[4]), 12), i))
        best.insert(best.index(1) + 1, 99)
        assert got == [("q", f"b{i:02d}") for i in best[:4]]
    f = spark.createDataFrame([("f", ["b2", "b1", "gone"]), ("g", []), ("h", None)], "id string, evidence_block_ids array<string>")
    w = spark.createDataFrame([("q", k, [1.0, 0.0]) for k in "fgh"], "query_id string, facet_id string, qv array<double>")
    blocks = spark.createDataFrame([("b1", 1, [0.0, 1.0]), ("b2", 2, [1.0, 0.0])], "id string, order_ int, v array<double>")
    assert [tuple(r) for r in evidence.facet_blocks(w, f, blocks).collect()] == [("q", "f", "b2")]
    assert [tuple(r) for r in evidence.facet_blocks(w.drop("qv"), f, blocks).collect()] == [("q", "f", "b1")]


def test_closure_counts_a_diamond_once(spark):
    e = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("X", "Y"), ("Y", "X")], "node string, parent string")
    n = spark.createDataFrame([(x,) for x in "ABCDXY"], "node string")
    got = sorted(map(tuple, graph.closure(e, n).collect()))
    assert got == sorted([("A", "A"), ("B", "B"), ("B", "A"), ("C", "C"), ("C", "A"), ("D", "D"), ("D", "B"), ("D", "C"), ("D", "A"), ("X", "X"), ("X", "Y"), ("Y", "Y"), ("Y", "X")])
    levels = {r["node"]: r["level"] for r in graph.topological_levels(e, n).collect()}
    assert levels == {"A": 0, "B": 1, "C": 1, "D": 2, "X": None, "Y": None}


def test_splitter_and_blocks(spark):
    pieces = indexing.split_text("One sentence with words. " * 100, 40, 30)
    assert len(pieces) > 1 and all(p.strip() for p, _ in pieces)
    assert indexing.split_text("x" * 1000, 40, 30)[0] == ("x" * 140, True)
    e = spark.createDataFrame([("P", 1, 0, "Page-footer", "p 1"), ("P", 1, 1, "Text", "Body irri-\ngation  text")], "paper_id string, page int, pos int, semantic_class string, text string")
    none = spark.createDataFrame([], "paper_id string, key string, n_pages long")
    assert [r["text"] for r in indexing.clean_elements(e, none).collect()] == ["Body irrigation text"]
    two = spark.createDataFrame([("P", 1, 0, "Title", "A title"), ("P", 1, 1, None, "References"), ("P", 2, 0, "Text", "Kay 2001")], "paper_id string, page int, pos int, semantic_class string, text string")
    got = [(r["id"], r["block_type"]) for r in indexing.build_blocks(two).orderBy("order_").collect()]
    assert got == [("P:S00:P0001", "title"), ("P:S00:P0002", "reference"), ("P:S00:P0003", "reference")]


def test_long_papers_are_ordered_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"b{i}", p, i, [rng.choice("ab"), "x"]) for p in ("P", "Q") for i in range(90) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "id string, paper_id string, order_ int, section_path array<string>")
    want = {}
    for p in ("P", "Q"):
        n, last = 0, None
        for i, q, o, s in sorted((r for r in rows if r[1] == p), key=lambda r: r[2]):
            n += s != last
            last = s
            want[(q, i)] = n
    for part in (indexing.PART, 7):
        monkeypatch.setattr(indexing, "PART", part)
        assert {(r["paper_id"], r["id"]): r["island"] for r in indexing.section_islands(df).collect()} == want
    e = spark.createDataFrame([("P", i // 3, i % 3, "Section-header" if i % 10 == 4 else "Text", f"t{i}") for i in range(60)], "paper_id string, page int, pos int, semantic_class string, text string")
    whole = sorted(map(tuple, indexing.build_blocks(e).collect()))
    monkeypatch.setattr(indexing, "PAGES", 2)
    assert sorted(map(tuple, indexing.build_blocks(e).collect())) == whole and len(whole) == 60


def test_bundles_and_alias_hits_cover_all_papers(spark, tmp_path):
    from evidara.plans import retrieval_plans

    b = [(f"{p}:S{k}", p, k, ["Results"], "paragraph", t) for p in ("P0000001", "P0000050") for k, t in enumerate(("albedo of RUN-A1", "rain", "heat"))]
    c = [(f"{p}:C{k}", p, "albedo", ["run-a1"], [f"{p}:S2"]) for p in ("P0000001", "P0000050") for k in range(2)]
    spark.createDataFrame(b, "id string, paper_id string, order_ int, section_path array<string>, block_type string, text string").write.parquet(str(tmp_path / "source_blocks.parquet"))
    spark.createDataFrame(c, "id string, paper_id string, label string, aliases array<string>, evidence_block_ids array<string>").write.parquet(str(tmp_path / "contexts.parquet"))
    got = {(r["query_id"], r["block_id"]) for r in retrieval_plans.hybrid_bundle(spark, str(tmp_path)).collect()}
    assert got == {(x[0], y[0]) for x in c for y in b if x[1] == y[1]}
    hits = {tuple(r) for r in retrieval_plans.alias_hits(spark, str(tmp_path)).collect()}
    assert hits == {(x[0], f"{x[1]}:S0") for x in c}


def test_packages_hold_contradictions_within_the_budget(spark):
    path, alt, held = "array<struct<rank:int,claims:array<string>,score:double>>", "array<struct<claim_id:string,focal_claim_id:string,classification:string>>", "array<struct<id:string,k:int,block_id:string,text:string>>"
    row = ("q", "forward", [(1, ["c1"], 0.9)], [("c2", "c1", "opposite")], [("c1", ["f1"]), ("c2", None)], [("c1", 1, "b1", "x" * 50), ("c2", 1, "b2", "y" * 700), ("f1", 1, "b3", "z")])
    df = spark.createDataFrame([row], f"query_id string, mode string, paths {path}, alternatives {alt}, claims array<struct<id:string,conditioning_facet_ids:array<string>>>, held {held}")
    got = {b: [(r["claim_id"], r["facet_id"], r["role"], r["blocks"]) for r in evidence.packages(df, b, b).orderBy("pos").collect()] for b in (150, 5_000)}
    path, facet = ("c1", None, "path", ["b1"]), (None, "f1", "conditioning_facet", ["b3"])
    assert got == {150: [path, facet], 5_000: [path, ("c2", None, "opposite", ["b2"]), facet]}


def test_ask_answers_with_alternatives(spark):
    from evidara.plans import retrieval_plans

    roles = {r["role"] for r in retrieval_plans.ask(spark, "/root/testdata/sf0.01").select("role").collect()}
    assert "path" in roles and roles & set(evidence.CLASSES)
