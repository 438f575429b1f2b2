"""Queries on the graph: edges, rules, closure, levels, components, catalogue, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.operators import graph
from evidara.plans.views import rec, sql_rec
from evidara.session import table
from evidara.streaming import events as ev

COLUMNS = {
    "source_blocks": ("paper_id", "block_type"), "contexts": ("paper_id", "label", "parent_ids", "evidence_block_ids"),
    "facets": ("context_id", "origin", "evidence_block_ids"), "transitions": ("paper_id", "from_context_id", "to_context_id", "evidence_block_ids"),
    "claims": ("paper_id", "scope_type", "scope_id", "from_", "to_", "conditioning_facet_ids", "evidence_block_ids"),
}


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: rec(spark, d, n, *c) for n, c in COLUMNS.items()}


def edge_list(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edge_list(_tables(spark, d))
    return e.groupBy("paper_id", "relationship_type").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"))


def graph_table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("papers", "source_blocks", "contexts", "facets", "transitions", "claims", "map_contexts")
    return reduce(DataFrame.unionByName, [rec(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names])


def catalog_totals(spark: SparkSession, d: str) -> DataFrame:
    parts = [rec(spark, d, n, "paper_id").groupBy("paper_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(n)) for n in ("source_blocks", "contexts", "transitions", "claims")]
    g = reduce(DataFrame.unionByName, parts).groupBy("paper_id")
    return g.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("source_blocks", "contexts", "transitions", "claims")])


def dq_rules(spark: SparkSession, d: str) -> DataFrame:
    """(rule, record_id): records that break a rule of the data model."""
    t = _tables(spark, d)
    c, f, tr, cl = t["contexts"], t["facets"], t["transitions"], t["claims"]
    has = lambda df: df.select(F.col("id").alias("ref"))
    bad = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("id").alias("record_id")).distinct()
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) < 1
    own = c.select("id", "paper_id", F.explode("parent_ids").alias("ref"))
    scope = {"context": c, "transition": tr}
    parts = [
        bad(c.where("label is null or trim(label) = ''"), "context_label"),
        bad(own.join(c.select(F.col("id").alias("ref"), "paper_id"), ["ref", "paper_id"], "left_anti"), "context_parent"),
        bad(f.join(has(c), f["context_id"] == F.col("ref"), "left_anti"), "facet_context"),
        bad(f.where((F.col("origin") == "reported") & empty("evidence_block_ids")), "facet_evidence"),
        bad(tr.where("from_context_id = to_context_id"), "transition_distinct"),
        bad(tr.where(empty("evidence_block_ids")), "transition_evidence"),
        bad(tr.select("id", F.explode(F.array("from_context_id", "to_context_id")).alias("ref")).join(has(c), "ref", "left_anti"), "transition_endpoint"),
        bad(cl.where(empty("evidence_block_ids")), "claim_evidence"),
        *[bad(cl.where(F.col("scope_type") == k).join(has(x), F.col("scope_id") == F.col("ref"), "left_anti"), "claim_scope") for k, x in scope.items()],
    ]
    cited = cl.select("id", F.explode("evidence_block_ids").alias("ref")).join(t["source_blocks"].select(F.col("id").alias("ref"), "block_type"), "ref")
    only = cited.groupBy("id").agg(F.min((F.col("block_type") == "reference").cast("int")).alias("m")).where("m = 1")
    return reduce(DataFrame.unionByName, [*parts, bad(only, "claim_cites_only_references")]).distinct()


def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, id, rows) of ids that several rows carry."""
    names = ("papers", "source_blocks", "contexts", "facets", "transitions", "claims")
    return reduce(DataFrame.unionByName, [table(spark, d, n).groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.lit(n).alias("table_name"), "id", "rows") for n in names])


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = rec(spark, d, "contexts", "parent_ids")
    return graph.parent_pairs(c), c.select(F.col("id").alias("node"))


def closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(*_links(spark, d))


def effective_facets(spark: SparkSession, d: str) -> DataFrame:
    e = graph.effective_facets(rec(spark, d, "contexts", "parent_ids"), rec(spark, d, "facets", "context_id", "domain"))
    return e.groupBy("context_id", "domain").agg(F.count("*").alias("n_facets"), F.min("facet_id").alias("first_facet"))


def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_levels(*_links(spark, d))


def components(spark: SparkSession, d: str) -> DataFrame:
    pairs, nodes = _links(spark, d)
    return graph.components(pairs.toDF("a", "b"), nodes)


def common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    up = graph.closure(*_links(spark, d))
    t = rec(spark, d, "transitions", "from_context_id", "to_context_id")
    a = t.join(up.toDF("from_context_id", "ancestor"), "from_context_id")
    return a.join(up.toDF("to_context_id", "ancestor"), ["to_context_id", "ancestor"], "left_semi").select(F.col("id").alias("transition_id"), "ancestor")


def seq_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("before is not null")
    return e.groupBy("before", "event_type").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ev.windowed(table(spark, d, "events"), "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ev.sessions(table(spark, d, "events"), "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (edge_list, graph_table_counts, catalog_totals, dq_rules, dq_duplicates, closure, effective_facets, topo_levels, components, common_ancestors, seq_transitions, event_windows, event_sessions)}

_C = sql_rec("contexts", "paper_id", "label", "parent_ids", "evidence_block_ids")
_F = sql_rec("facets", "context_id", "domain", "origin", "evidence_block_ids")
_T = sql_rec("transitions", "paper_id", "from_context_id", "to_context_id", "evidence_block_ids")
_CL = sql_rec("claims", "paper_id", "scope_type", "scope_id", "conditioning_facet_ids", "evidence_block_ids", "from_", "to_")
_B = sql_rec("source_blocks", "paper_id", "block_type")
_SLUG = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_STATE = lambda s: f"'state::' || {_SLUG.format(s + '.concept')} || '::' || {_SLUG.format(s + '.state')}"
_EDGES = f"e0 as (select distinct id as node, unnest(parent_ids) as parent from {_C}), e as (select * from e0 where parent in (select id from contexts))"
_UP = f"recursive {_EDGES}, up as (select id as node, id as ancestor from contexts union select up.node, e.parent from up join e on e.node = up.ancestor)"
SQL = {
    "edge_list": f"""with c as (select * from {_C}), f as (select f.*, c.paper_id from {_F} f left join c on c.id = f.context_id), t as (select * from {_T}), cl as (select * from {_CL}),
        x as (select paper_id, 'IN_PAPER' as k, paper_id as target from {_B} union all select paper_id, 'HAS_CONTEXT', id from c
        union all select paper_id, 'PARENT_OF', id from (select paper_id, id, unnest(parent_ids) as p from c) union all select paper_id, 'HAS_FACET', id from f
        union all select paper_id, 'HAS_TRANSITION', id from t union all select paper_id, 'FROM', from_context_id from t union all select paper_id, 'TO', to_context_id from t
        union all select paper_id, 'HAS_CLAIM', id from cl union all select paper_id, 'FROM', {_STATE('from_')} from cl union all select paper_id, 'TO', {_STATE('to_')} from cl
        union all select paper_id, 'SCOPED_TO', scope_id from cl union all select paper_id, 'CONDITIONED_BY', unnest(conditioning_facet_ids) from cl
        union all select paper_id, 'SUPPORTED_BY', unnest(evidence_block_ids) from c union all select paper_id, 'SUPPORTED_BY', unnest(evidence_block_ids) from f
        union all select paper_id, 'SUPPORTED_BY', unnest(evidence_block_ids) from t union all select paper_id, 'SUPPORTED_BY', unnest(evidence_block_ids) from cl)
        select paper_id, k as relationship_type, count(*) as n, count(distinct target) as targets from x group by 1, 2""",
    "graph_table_counts": " union all ".join(f"select '{n}' as table_name, count(*) as n from {sql_rec(n)}" for n in ("papers", "source_blocks", "contexts", "facets", "transitions", "claims", "map_contexts")),
    "catalog_totals": "select paper_id, " + ", ".join(f"cast(coalesce(sum(n) filter (where k = '{n}'), 0) as bigint) as {n}" for n in ("source_blocks", "contexts", "transitions", "claims"))
        + " from (" + " union all ".join(f"select paper_id, '{n}' as k, count(*) as n from {sql_rec(n, 'paper_id')} group by 1" for n in ("source_blocks", "contexts", "transitions", "claims")) + ") group by 1",
    "dq_rules": f"""with c as (select * from {_C}), f as (select * from {_F}), t as (select * from {_T}), cl as (select * from {_CL}), b as (select * from {_B})
        select 'context_label' as rule, id as record_id from c where trim(coalesce(label, '')) = ''
        union select 'context_parent', id from (select id, paper_id, unnest(parent_ids) as p from c) x where not exists (select 1 from c where c.id = x.p and c.paper_id = x.paper_id)
        union select 'facet_context', id from f where not exists (select 1 from c where c.id = f.context_id)
        union select 'facet_evidence', id from f where origin = 'reported' and coalesce(len(evidence_block_ids), 0) < 1
        union select 'transition_distinct', id from t where from_context_id = to_context_id
        union select 'transition_evidence', id from t where coalesce(len(evidence_block_ids), 0) < 1
        union select 'transition_endpoint', id from (select id, unnest([from_context_id, to_context_id]) as r from t) x where not exists (select 1 from c where c.id = x.r)
        union select 'claim_evidence', id from cl where coalesce(len(evidence_block_ids), 0) < 1
        union select 'claim_scope', id from cl where (scope_type = 'context' and not exists (select 1 from c where c.id = cl.scope_id)) or (scope_type = 'transition' and not exists (select 1 from t where t.id = cl.scope_id))
        union select 'claim_cites_only_references', x.id from (select id, unnest(evidence_block_ids) as r from cl) x join b on b.id = x.r group by x.id having bool_and(b.block_type = 'reference')""",
    "dq_duplicates": " union all ".join(f"select '{n}' as table_name, id, count(*) as rows from {n} group by id having count(*) > 1" for n in ("papers", "source_blocks", "contexts", "facets", "transitions", "claims")),
    "closure": f"with {_UP} select node, ancestor from up",
    "effective_facets": f"with {_UP} select up.node as context_id, f.domain, count(*) as n_facets, min(f.id) as first_facet from up join {_F} f on f.context_id = up.ancestor group by 1, 2",
    "topo_levels": f"""with {_UP}, looped as (select distinct e.node from e join up on up.node = e.parent and up.ancestor = e.node),
        bad as (select distinct up.node from up join looped on looped.node = up.ancestor),
        good as (select id as node from contexts where id not in (select node from bad) group by id),
        walk as (select node, 0 as level from good where node not in (select node from e) union
                 select e.node, walk.level + 1 from walk join e on e.parent = walk.node where e.node in (select node from good))
        select g.node, max(w.level)::int as level from (select distinct id as node from contexts) g left join walk w on w.node = g.node group by 1""",
    "components": f"""with recursive {_EDGES}, u as (select node as a, parent as b from e union select parent, node from e),
        r as (select id as x, id as y from contexts union select r.x, u.b from r join u on u.a = r.y) select x as node, min(y) as component from r group by 1""",
    "common_ancestors": f"""with {_UP} select t.id as transition_id, a.ancestor from {_T} t join up a on a.node = t.from_context_id join up b on b.node = t.to_context_id and b.ancestor = a.ancestor""",
    "seq_transitions": """select before, event_type, count(*) as n from (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
        where before is not null group by 1, 2""",
    "event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
        s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
        select user_id, count(distinct s) as n_sessions, max(n) as longest from (select user_id, s, count(*) as n from s group by 1, 2) group by 1""",
}
