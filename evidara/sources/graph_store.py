"""The graph as Parquet tables: write, read, counts, and papers from JSON documents."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators.graph import edge_list
from evidara.session import cut

TABLES = ("papers", "source_blocks", "contexts", "facets", "transitions", "claims", "states", "evidence_links")
FORMAT, VERSION = "evidara-graph", 2
#: The paper a stored row belongs to, and the buckets that papers are spread over.
OWNER, BUCKETS = "owner_paper_id", 64
#: Explicit schemas: an all-null or empty column keeps its type, whatever a file says.
SCHEMAS = {
    "papers": "id string, title string, source_file string, doi string, year int, schema_version string, pipeline_version string, unresolved_conflicts array<string>, metadata string",
    "source_blocks": "id string, paper_id string, order_ int, page int, section_path array<string>, block_type string, text string, source_locator string, oversize_hard_split boolean, embedding array<double>",
    "contexts": "id string, paper_id string, parent_ids array<string>, label string, aliases array<string>, spatial_support struct<kind:string,name:string,geometry:string,resolution:string>, evidence_block_ids array<string>, retrieval_embedding array<double>",
    "facets": "id string, context_id string, domain string, notion string, description string, origin string, source struct<type:string,id:string,dataset:string,version:string,method:string,temporal_window:string,geometry_hash:string>, evidence_block_ids array<string>, notion_embedding array<double>, content_embedding array<double>",
    "transitions": "id string, paper_id string, from_context_id string, to_context_id string, label string, aliases array<string>, description string, evidence_block_ids array<string>, transition_embedding array<double>",
    "claims": "id string, paper_id string, scope_type string, scope_id string, from_ struct<concept:string,state:string>, to_ struct<concept:string,state:string>, relation string, description string, evidence_role string, conditioning_facet_ids array<string>, evidence_block_ids array<string>, claim_embedding array<double>",
    "states": "id string, concept string, state string, aliases array<string>, concept_embedding array<double>",
    "evidence_links": "object_id string, source_block_id string",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in its schema's order and types; missing ones null, others dropped."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def evidence_links(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for n in ("contexts", "facets", "transitions", "claims"):
        part = t[n].select(F.col("id").alias("object_id"), F.explode("evidence_block_ids").alias("source_block_id"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def owners(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with ``owner_paper_id``: the paper that a row belongs to, by its own column, its context or its object; null for shared rows (states)."""
    out = {}
    for n, df in t.items():
        if n == "papers":
            out[n] = df.withColumn(OWNER, F.col("id"))
        elif "paper_id" in df.columns:
            out[n] = df.withColumn(OWNER, F.col("paper_id"))
    if "facets" in t and "contexts" in t:
        up = t["contexts"].select(F.col("id").alias("context_id"), F.col("paper_id").alias(OWNER)).dropDuplicates(["context_id"])
        out["facets"] = t["facets"].join(up, "context_id", "left").select(*t["facets"].columns, OWNER)
    if "evidence_links" in t:
        every = reduce(DataFrame.unionByName, [out[n].select(F.col("id").alias("object_id"), OWNER) for n in ("contexts", "facets", "transitions", "claims") if n in out])
        out["evidence_links"] = t["evidence_links"].join(every.dropDuplicates(["object_id"]), "object_id", "left")
    return {n: out.get(n, df.withColumn(OWNER, F.lit(None).cast("string"))) for n, df in t.items()}


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(BUCKETS)).cast("int")


def _write_buckets(df: DataFrame, root: str, name: str, version: int) -> list[int]:
    """Write the rows by the bucket of their paper into the version's own folder; which buckets it has."""
    path = f"{root}/{name}/v{version:06d}"
    df.withColumn("bucket", _bucket(F.col(OWNER))).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
    try:
        return sorted(r[0] for r in df.sparkSession.read.parquet(path).select("bucket").distinct().collect())  # at most BUCKETS
    except AnalysisException:  # no row at all
        return []


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("v")) if fs.exists(at) else []


def _publish(spark: SparkSession, root: str, m: dict, version: int) -> None:
    """Write a manifest under its own name; what is read is the newest whole one, so a crash before this leaves the old graph."""
    spark.createDataFrame([(json.dumps(m | {"format": FORMAT, "format_version": VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest/v{version:06d}")


def write_graph(t: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Write every table with its edges and a manifest; returns the row counts.

    Rows lie in buckets by their paper. A later write never touches these files: it adds a
    version of the buckets it changes and a manifest that names them.
    """
    spark = next(iter(t.values())).sparkSession
    out = {n: conform(t[n], n) for n in TABLES if n in t}
    out.setdefault("evidence_links", evidence_links(out))
    out["relationships"] = edge_list(out)
    version = max(_versions(spark, root), default=-1) + 1
    tables = {n: {str(b): version for b in _write_buckets(df, root, n, version)} for n, df in owners(out).items()}
    m = {"tables": tables, "counts": {}}
    m["counts"] = {n: _read(spark, root, n, at).count() for n, at in tables.items()}
    _publish(spark, root, m, version)
    return m["counts"]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The graph's manifest, the newest or that of a version."""
    have = _versions(spark, root)
    m = json.loads(spark.read.text(f"{root}/manifest" + (f"/v{version if version is not None else have[-1]:06d}" if have else "")).first()[0])
    if (m.get("format"), m.get("format_version")) != (FORMAT, VERSION):
        raise ValueError(f"not a graph of format {FORMAT} {VERSION}: {m.get('format')} {m.get('format_version')}")
    return m


EDGES = "source_id string, relationship_type string, target_id string, paper_id string"


def _read(spark: SparkSession, root: str, name: str, at: dict[str, int], owner: bool = False) -> DataFrame:
    schema = SCHEMAS.get(name, EDGES) + f", {OWNER} string"
    paths = [f"{root}/{name}/v{v:06d}/bucket={b}" for b, v in sorted(at.items(), key=lambda x: int(x[0]))]
    df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return df if owner else df.drop(OWNER)


def read_graph(spark: SparkSession, root: str, version: int | None = None, owner: bool = False) -> dict[str, DataFrame]:
    """The tables of the newest graph or of a version; with ``owner`` each row's paper, to put papers together again."""
    return {n: _read(spark, root, n, at, owner) for n, at in manifest(spark, root, version)["tables"].items()}


def replace_papers(root: str, t: dict[str, DataFrame], drop: DataFrame | None = None) -> int:
    """Replace, in the tables of ``t``, the papers that its rows belong to (and those of ``drop``: paper_id) and keep the others; returns the version.

    Only the buckets that hold such papers are read and written again, under a new version.
    Rows of no paper (states) replace all such rows. The old version stays readable.
    """
    spark = next(iter(t.values())).sparkSession
    m = manifest(spark, root)
    version = max(_versions(spark, root)) + 1
    rows = {n: df if OWNER in df.columns else None for n, df in t.items()}
    own = owners({n: df.drop(OWNER) for n, df in t.items()})
    for n in t:
        new = rows[n] if rows[n] is not None else own[n]
        new = _conform_owned(new, n)
        gone = new.select(OWNER).distinct()
        gone = gone.unionByName(drop.select(F.col("paper_id").alias(OWNER))).distinct() if drop is not None else gone
        gone = cut(gone, "papers")
        touched = {str(r[0]) for r in gone.select(_bucket(F.col(OWNER)).alias("b")).distinct().collect()}  # at most BUCKETS
        old = _read(spark, root, n, {b: v for b, v in m["tables"].get(n, {}).items() if b in touched}, True)
        kept = old.join(gone.withColumnRenamed(OWNER, "_gone"), old[OWNER].eqNullSafe(F.col("_gone")), "left_anti")
        has = {str(b) for b in _write_buckets(kept.unionByName(new), root, n, version)}
        m["tables"][n] = {b: v for b, v in m["tables"].get(n, {}).items() if b not in touched} | dict.fromkeys(has, version)
        m["counts"][n] = _read(spark, root, n, m["tables"][n]).count()
    _publish(spark, root, m, version)
    return version


def _conform_owned(df: DataFrame, name: str) -> DataFrame:
    schema = df.sparkSession.createDataFrame([], SCHEMAS.get(name, EDGES) + f", {OWNER} string").schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def recanonicalise(spark: SparkSession, root: str) -> tuple[int, int]:
    """(version, changed endpoints): the states table and the edges made again under the present alias lists.

    The endpoints whose state changes are written to ``audit`` under the new version; the
    version before stays as the backup. Nothing is written where nothing changes.
    """
    from evidara.operators import curation, ranking

    g = read_graph(spark, root)
    changed = cut(curation.recanonicalised(g["claims"]), "changed")
    made = ranking.states(ranking.canonical_claims(g["claims"]))
    same = g["states"].select("id").exceptAll(made.select("id")).isEmpty() and made.select("id").exceptAll(g["states"].select("id")).isEmpty() if "states" in g else False
    if same:
        return max(_versions(spark, root)), 0
    version = replace_papers(root, {"states": made})
    changed.write.mode("overwrite").parquet(f"{root}/audit/v{version:06d}")
    return version, changed.count()


def restore_version(spark: SparkSession, root: str, version: int) -> int:
    """Make an older version the present one again, as a new version."""
    m = manifest(spark, root, version)
    new = max(_versions(spark, root)) + 1
    _publish(spark, root, m, new)
    return new


def orphan_states(states: DataFrame, edges: DataFrame) -> DataFrame:
    return states.join(edges.where("relationship_type in ('FROM', 'TO')").select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")


def register_files(spark: SparkSession, glob: str, known: DataFrame | None = None) -> DataFrame:
    """(sha256, path, length) of new files, each content once; ``known``: sha256 of those registered before."""
    f = spark.read.format("binaryFile").load(glob).select(F.sha2("content", 256).alias("sha256"), "path", "length")
    first = f.groupBy("sha256").agg(F.min("path").alias("path"), F.min("length").alias("length"))
    return first.join(known.select("sha256"), "sha256", "left_anti") if known is not None else first


def read_documents(spark: SparkSession, glob: str, name: str) -> DataFrame:
    """One table out of final paper documents in JSON (one nested object a file)."""
    field = {"source_blocks": "source_blocks", "papers": "paper"}.get(name, name)
    schema = spark.createDataFrame([], SCHEMAS[name]).schema.simpleString()
    schema = schema.replace("from_:", "`from`:").replace("to_:", "`to`:").replace("order_:", "`order`:")
    ddl = f"`{field}` {schema}" if name == "papers" else f"`{field}` array<{schema}>"
    docs = spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(glob)
    rows = docs.select(f"{field}.*") if name == "papers" else docs.select(F.explode(field).alias("r")).select("r.*")
    for a in ("from", "to", "order"):
        if a in rows.columns:
            rows = rows.withColumnRenamed(a, f"{a}_")
    return rows
