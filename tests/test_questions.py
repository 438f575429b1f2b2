from evidara.operators import questions as Q


def test_specify(spark):
    f = [("climate", "dry", "in dry climates", "dry climates"), ("spatial_configuration", "place", "Sahel", "the Sahel"), ("other", "made up", "x", "not said")]
    rows = [
        ("q1", "In dry climates of the Sahel, how does increased albedo change rain?", False, f, ("albedo", "increased", "increased albedo"), ("rain", "changed", "change rain"), "The Sahel"),
        ("q2", "Globally, is soil drier or wetter?", False, None, None, ("soil", "drier or wetter", "soil drier or wetter"), None),
        ("q3", "What follows from irrigation?", False, [], ("irrigation", "increase", "irrigation"), None, None),
        ("q4", "How does heat respond?", True, None, None, ("heat", "", "heat"), None),
        ("q5", "How do circulation and moisture respond to shade?", None, None, ("shade", "", "shade"), ("circulation and moisture", "", "circulation and moisture"), None),
    ]
    rows[0] = (*rows[0][:1], rows[0][1].replace("In dry", "In dry"), *rows[0][2:])
    got = {r["query_id"]: r for r in Q.specify(spark.createDataFrame(rows, Q.PARSED)).collect()}
    assert got["q1"]["mode"] == "forward" and got["q1"]["target"] is None
    assert [x["id"] for x in got["q1"]["facets"]] == ["q1_F001"]
    assert got["q1"]["warnings"] == ["SUPPORTING_SPAN_DISCARDED", "DUPLICATE_PLACE_DISCARDED", "UNSPECIFIED_TARGET_DISCARDED"]
    assert got["q2"]["mode"] == "global" and "COMPARATIVE_ENDPOINTS_DISCARDED" in got["q2"]["warnings"] and "GLOBAL_FLAG_NORMALIZED" in got["q2"]["warnings"]
    assert got["q3"]["source"]["state"] == "" and got["q3"]["warnings"] == ["SOURCE_STATE_CLEARED"]
    assert got["q4"]["mode"] == "backward" and got["q4"]["warnings"] == ["GLOBAL_FLAG_NORMALIZED"]
    assert got["q5"]["mode"] == "forward" and got["q5"]["warnings"] == ["COMPOUND_TARGET_DISCARDED"]


def test_suffix_checks_and_tree(spark):
    want = spark.createDataFrame([("g", "B1"), ("g", "B2"), ("g", "P:B3")], "group string, ref string")
    have = spark.createDataFrame([("g", "P:B1"), ("g", "P:B2"), ("g", "Q:B2"), ("g", "P:B3")], "group string, id string")
    assert [tuple(r) for r in Q.suffix_matches(want, have).collect()] == [("g", "B1", "P:B1")]
    e = spark.createDataFrame([("P", 1, "x" * 200), ("Q", 1, "bad �")], "paper_id string, page int, text string")
    n = spark.createDataFrame([("P", 1), ("Q", 2), ("R", 1)], "paper_id string, n_pages int")
    got = {tuple(r) for r in Q.page_checks(e, n).collect()}
    assert got == {("Q", "PAGES_MISSING"), ("Q", "PARSE_EMPTY"), ("Q", "PARSE_ENCODING_ERROR"), ("R", "PAGES_MISSING"), ("R", "PARSE_EMPTY")}
    c = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", False)], "query_id string, check string, passed boolean")
    assert tuple(Q.suite_summary(c, spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")).first()) == (3, 1, 1, 1)
    t = spark.createDataFrame([("P", 0, "r", None, "root", []), ("P", 1, "t", ["r"], "treatment", ["RUN"]), ("P", 2, "u", ["r", "t"], "run", None), ("P", 3, "l", ["l"], "loop", None)], "paper_id string, pos int, id string, parent_ids array<string>, label string, aliases array<string>")
    lines = [r["line"] for r in Q.map_tree(t).orderBy("pos").collect()]
    assert lines == ["- root [r]", "  - treatment [t]; aliases: RUN", "    - run [u]", "  - run [u]; also inherits elsewhere", "- loop [l]", "  - loop [l]; also inherits elsewhere"]
