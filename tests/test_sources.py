import json

import pytest

from evidara.sources import graph_store, providers
from evidara.streaming import events as ev
from pyspark.sql import functions as F


def one_claim(spark):
    def mk(name, row):
        schema = spark.createDataFrame([], graph_store.SCHEMAS[name]).schema
        return spark.createDataFrame([json.dumps(row)], "string").select(F.from_json("value", schema).alias("r")).select("r.*")

    return {
        "papers": mk("papers", {"id": "P1", "title": "T", "source_file": "f", "metadata": "{}"}),
        "source_blocks": mk("source_blocks", {"id": "P1:B1", "paper_id": "P1", "order_": 0, "page": 1, "block_type": "paragraph", "text": "x"}),
        "contexts": mk("contexts", {"id": "P1:C1", "paper_id": "P1", "label": "c", "evidence_block_ids": ["P1:B1"], "retrieval_embedding": [1.0, 0.0]}),
        "facets": mk("facets", {"id": "P1:F1", "context_id": "P1:C1", "domain": "land_surface", "notion": "n", "description": "d", "evidence_block_ids": ["P1:B1"]}),
        "transitions": mk("transitions", {"id": "none", "paper_id": "P1"}).limit(0),
        "claims": mk("claims", {"id": "P1:CL1", "paper_id": "P1", "scope_type": "context", "scope_id": "P1:C1", "from_": {"concept": "forest cover", "state": "increase"}, "to_": {"concept": "surface temperature", "state": "decrease"}, "conditioning_facet_ids": ["P1:F1"], "evidence_block_ids": ["P1:B1"]}),
    }


def test_round_trip_and_edges(spark, tmp_path):
    t = one_claim(spark)
    counts = graph_store.write_graph(t, str(tmp_path / "g"))
    assert counts["relationships"] == 11 and counts["claims"] == 1 and counts["transitions"] == 0
    back = graph_store.read_graph(spark, str(tmp_path / "g"))
    for n in t:
        assert back[n].collect() == t[n].collect()
    kinds = {r[0]: r[1] for r in back["relationships"].groupBy("relationship_type").count().collect()}
    assert kinds == {"IN_PAPER": 1, "HAS_CONTEXT": 1, "HAS_FACET": 1, "HAS_CLAIM": 1, "FROM": 1, "TO": 1, "SCOPED_TO": 1, "CONDITIONED_BY": 1, "SUPPORTED_BY": 3}
    root = str(tmp_path / "g")
    held = {n: {r["owner_paper_id"] for r in df.collect()} for n, df in graph_store.read_graph(spark, root, owner=True).items()}
    assert all(v <= {"P1"} for v in held.values()) and held["facets"] == held["evidence_links"] == {"P1"}
    two = t["contexts"].withColumn("id", F.lit("P2:C1")).withColumn("paper_id", F.lit("P2"))
    assert graph_store.replace_papers(root, {"contexts": two.unionByName(t["contexts"].withColumn("label", F.lit("new")))}) == 1
    read = lambda n, v=None: sorted((r["id"], r["label"]) for r in graph_store.read_graph(spark, root, v)[n].collect())
    assert read("contexts") == [("P1:C1", "new"), ("P2:C1", "c")] and read("contexts", 0) == [("P1:C1", "c")]
    new = t["facets"].withColumn("notion", F.lit("m"))
    graph_store.replace_papers(root, {"facets": new, "contexts": t["contexts"]})
    assert [r["notion"] for r in graph_store.read_graph(spark, root)["facets"].collect()] == ["m"] and read("contexts") == [("P1:C1", "c"), ("P2:C1", "c")]
    graph_store.replace_papers(root, {"contexts": t["contexts"].limit(0)}, drop=spark.createDataFrame([("P2",)], "paper_id string"))
    assert read("contexts") == [("P1:C1", "c")]
    assert graph_store.restore_version(spark, root, 1) == 4 and read("contexts") == [("P1:C1", "new"), ("P2:C1", "c")]


def test_entry_points(spark, tmp_path, capsys):
    from evidara import cli

    said = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    g, d = str(tmp_path / "g"), "/root/testdata/sf0.001"
    assert cli.run(spark, ["build", "--tables", d, "--graph", g]) == 0
    counts = said()[-1]["counts"]
    assert counts["papers"] == 8 and counts["states"] > 0 and counts["relationships"] > counts["claims"]
    assert cli.run(spark, ["inspect", "--graph", g]) == 0 and said()[-1]["counts"] == counts
    # another state table, as an older alias list would have left it, is made again with an audit
    graph_store.replace_papers(g, {"states": spark.createDataFrame([("state::old::x", "old", "x")], "id string, concept string, state string")})
    assert cli.run(spark, ["recanonicalise", "--graph", g]) == 0
    made = said()[-1]
    assert made["changed"] == spark.read.parquet(f"{g}/audit/v{made['version']:06d}").count() and graph_store.manifest(spark, g)["counts"]["states"] == counts["states"]
    assert cli.run(spark, ["recanonicalise", "--graph", g]) == 0 and said()[-1] == {"name": "recanonicalise", "status": "complete", "version": made["version"], "changed": 0}
    # one query that fails does not stop the other
    assert cli.run(spark, ["query", "nosuch", "token_counts", "--tables", d, "--out", str(tmp_path / "q")]) == 1
    assert [x["status"] for x in said()] == ["failed", "complete"]
    assert cli.run(spark, ["build", "--graph", g]) == 1 and "either" in said()[-1]["error"]


def test_manifest_guard(spark, tmp_path):
    spark.createDataFrame([('{"format": "other"}',)], "value string").write.text(str(tmp_path / "manifest"))
    with pytest.raises(ValueError):
        graph_store.manifest(spark, str(tmp_path))


def test_register_and_documents(spark, tmp_path):
    for n, text in (("a.pdf", "one"), ("b.pdf", "one"), ("c.pdf", "two")):
        (tmp_path / n).write_text(text)
    new = graph_store.register_files(spark, str(tmp_path / "*.pdf"))
    assert new.count() == 2 and graph_store.register_files(spark, str(tmp_path / "*.pdf"), new).count() == 0
    doc = {"paper": {"id": "P1", "title": "T"}, "claims": [{"id": "x", "from": {"concept": "a", "state": "b"}}]}
    (tmp_path / "final.json").write_text(json.dumps(doc))
    assert graph_store.read_documents(spark, str(tmp_path / "final.json"), "papers").first()["title"] == "T"
    assert graph_store.read_documents(spark, str(tmp_path / "final.json"), "claims").first()["from_"]["concept"] == "a"


def test_providers(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", None)], "id string, text string")
    v = df.select("id", providers.embedded(F.col("text"), providers.HashEmbedder(8)).alias("v"))
    assert v.where("size(v) = 8").count() == 2
    assert providers.missing_vectors(df, v.where("id = '1'"), 8).count() == 1
    saved = spark.createDataFrame([("P", "map", "v1"), ("Q", "map", None)], "paper_id string, stage string, version string")
    now = spark.createDataFrame([("map", "v1")], "stage string, version string")
    assert [r["paper_id"] for r in providers.stale(saved, now).collect()] == ["Q"]
    req = spark.createDataFrame([("s", "k")], "stage string, key string")
    got = providers.replayed(req, spark.createDataFrame([("s", "k", '{"value": "ok"}')], "stage string, key string, body string"), "value string").first()
    assert got["response"]["value"] == "ok"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = ev.windowed(ev.event_stream(spark, str(tmp_path / "in")), "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    a = {(r["start"], r["event_type"]): r["n"] for r in spark.table("w").collect()}
    b = {(r["start"], r["event_type"]): r["n"] for r in ev.windowed(src, "1 day").collect()}
    assert a == b and a
