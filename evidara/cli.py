"""Entry points: build, inspect, query, validate, recanonicalise, restore. ``python -m evidara.cli COMMAND ...``

Each piece of work prints one JSON line with its status; one that fails does not stop the
others, and the exit code is 1 if any failed.
"""

from __future__ import annotations

import argparse
import json
import sys
import traceback
from collections.abc import Callable

from pyspark.sql import SparkSession

from evidara.session import records, scratch, table

RECORDS = ("papers", "source_blocks", "contexts", "facets", "transitions", "claims")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidara")
    c = p.add_subparsers(dest="command", required=True)
    b = c.add_parser("build", help="write a graph from record tables or from paper documents in JSON")
    b.add_argument("--tables", help="folder with one Parquet table a kind of record")
    b.add_argument("--documents", help="glob of final paper documents")
    b.add_argument("--graph", required=True)
    i = c.add_parser("inspect", help="counts and versions of a graph")
    i.add_argument("--graph", required=True)
    q = c.add_parser("query", help="run registered queries and write their results as Parquet")
    q.add_argument("names", nargs="+")
    q.add_argument("--tables", required=True)
    q.add_argument("--out", required=True)
    v = c.add_parser("validate", help="check the reports of the question batch; exit code 1 if a case fails or is blocked")
    v.add_argument("--tables", required=True)
    v.add_argument("--out")
    r = c.add_parser("recanonicalise", help="make the states again under the present alias lists, with an audit")
    r.add_argument("--graph", required=True)
    o = c.add_parser("restore", help="make an older version of a graph the present one")
    o.add_argument("--graph", required=True)
    o.add_argument("--version", type=int, required=True)
    return p


def _say(**fields) -> None:
    print(json.dumps(fields, default=str), flush=True)


def _isolated(spark: SparkSession, name: str, work: Callable[[], dict]) -> bool:
    """Run one piece of work; its failure is told, not raised."""
    try:
        with scratch(spark):
            _say(name=name, status="complete", **work())
        return True
    except Exception as x:
        _say(name=name, status="failed", error=f"{type(x).__name__}: {x}"[:2000])
        traceback.print_exc(file=sys.stderr)
        return False


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    from evidara.operators import ranking
    from evidara.sources import graph_store as g

    if bool(a.tables) == bool(a.documents):
        raise ValueError("give either --tables or --documents")
    t = {n: records(table(spark, a.tables, n), "id") if a.tables else g.read_documents(spark, a.documents, n) for n in RECORDS}
    t["states"] = ranking.states(ranking.canonical_claims(t["claims"]))
    return {"graph": a.graph, "counts": g.write_graph(t, a.graph)}


def inspect(spark: SparkSession, a: argparse.Namespace) -> dict:
    from evidara.sources import graph_store as g

    m = g.manifest(spark, a.graph)
    return {"graph": a.graph, "counts": m["counts"], "versions": g._versions(spark, a.graph)}


def validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    from evidara.operators.questions import suite_summary
    from evidara.plans import retrieval_plans, views
    from evidara.session import cut

    checks = cut(retrieval_plans.report_checks(spark, a.tables), "checks")
    cases = checks.select("query_id").distinct()
    if a.out:
        checks.write.mode("overwrite").parquet(a.out)
    got = suite_summary(checks, cases).first().asDict()
    failed = [tuple(r) for r in checks.where("not passed").orderBy("query_id", "check").limit(50).collect()]
    if got["failed"] or got["blocked"]:
        raise RuntimeError(json.dumps(got | {"asked": views.ASKED, "first_failures": failed}))
    return got


def run(spark: SparkSession, argv: list[str]) -> int:
    a = _parser().parse_args(argv)
    if a.command == "query":
        from evidara.plans import catalog

        def one(name: str) -> Callable[[], dict]:
            def work() -> dict:
                if name not in catalog.QUERIES:
                    raise KeyError(f"no query {name}")
                catalog.QUERIES[name](spark, a.tables).write.mode("overwrite").parquet(f"{a.out}/{name}")
                return {"out": f"{a.out}/{name}", "rows": spark.read.parquet(f"{a.out}/{name}").count()}

            return work

        return int(not all([_isolated(spark, n, one(n)) for n in a.names]))
    from evidara.sources import graph_store as g

    work = {
        "build": lambda: build(spark, a), "inspect": lambda: inspect(spark, a), "validate": lambda: validate(spark, a),
        "recanonicalise": lambda: dict(zip(("version", "changed"), g.recanonicalise(spark, a.graph), strict=True)),
        "restore": lambda: {"version": g.restore_version(spark, a.graph, a.version)},
    }[a.command]
    return int(not _isolated(spark, a.command, work))


def main() -> None:
    sys.exit(run(SparkSession.builder.appName("evidara").getOrCreate(), sys.argv[1:]))


if __name__ == "__main__":
    main()
