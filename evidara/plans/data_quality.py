"""Queries on missing references and hierarchies, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidara.operators import hierarchy, integrity
from evidara.session import table

REFERRING = ("source_blocks", "contexts", "transitions", "facets", "claims", "map_contexts")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_references({n: table(spark, d, n) for n in REFERRING})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    own = [k for k in integrity.GRAPH_KEYS if k.table in ("claims", "map_contexts")]
    return integrity.direct_orphans({n: table(spark, d, n) for n in REFERRING}, own).drop("structural")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_report(_orphans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(table(spark, d, "contexts")).cycles.withColumnRenamed("node", "context_id").select("context_id", "cycle_id")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.summarise(hierarchy.resolve_hierarchy(table(spark, d, "contexts")))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve_hierarchy(table(spark, d, "contexts")).ancestors())


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(table(spark, d, "contexts")).paths().withColumnRenamed("node", "context_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_report, p6_found, p6_hierarchy, p6_descendants, p6_paths)}

_RECORDS = """
        b as (select 'source_blocks' as t, id, min(loaded_at) as arr, bool_or(deleted_at is not null) as gone from source_blocks group by id),
        f as (select 'facets' as t, id, min(loaded_at) as arr, bool_or(deleted_at is not null) as gone from facets group by id),
        c as (select 'contexts' as t, id, min(loaded_at) as arr, bool_or(deleted_at is not null) as gone from contexts group by id),
        tr as (select 'transitions' as t, id, min(loaded_at) as arr, bool_or(deleted_at is not null) as gone from transitions group by id),
        target as (select * from b union all select * from f union all select * from c union all select * from tr),
        cl as (select id, any_value(scope_type) as scope_type, any_value(scope_id) as scope_id, any_value(conditioning_facet_ids) as fs,
                      any_value(evidence_block_ids) as bs, any_value(created_at) as created_at, min(loaded_at) as arr from claims group by id),
        m as (select temp_id as id, any_value(evidence_block_ids) as bs, any_value(created_at) as created_at, min(loaded_at) as arr from map_contexts group by temp_id),
        r as (
            select 'claims' as source_table, 'evidence_block_ids' as field, id as record_id, unnest(bs) as ref, 'source_blocks' as t, created_at, arr from cl
            union all select 'claims', 'conditioning_facet_ids', id, unnest(fs), 'facets', created_at, arr from cl
            union all select 'claims', 'scope_id', id, scope_id, scope_type || 's', created_at, arr from cl
            union all select 'map_contexts', 'evidence_block_ids', id, unnest(bs), 'source_blocks', created_at, arr from m),
        q as (select distinct source_table, field, record_id, regexp_replace(ref, '^\\s+|\\s+$', '', 'g') as ref_id, t, created_at, arr from r)"""

_INHERITED = """
        when_ as (select 'contexts' as t, id, strftime(any_value(created_at), '%Y-%m') as period from contexts group by id
            union all select 'facets', id, strftime(min(loaded_at), '%Y-%m') from facets group by id
            union all select 'transitions', id, strftime(min(loaded_at), '%Y-%m') from transitions group by id
            union all select 'claims', id, strftime(any_value(created_at), '%Y-%m') from claims group by id
            union all select 'map_contexts', temp_id, strftime(any_value(created_at), '%Y-%m') from map_contexts group by temp_id),
        x0 as (
            select distinct 'contexts' as t, 'parent_ids' as field, id, 'contexts' as tt, unnest(parent_ids) as ref, true as st from contexts
            union all select distinct 'transitions', 'from_context_id', id, 'contexts', from_context_id, true from transitions
            union all select distinct 'transitions', 'to_context_id', id, 'contexts', to_context_id, true from transitions
            union all select distinct 'facets', 'context_id', id, 'contexts', context_id, true from facets
            union all select distinct 'claims', 'conditioning_facet_ids', id, 'facets', unnest(conditioning_facet_ids), true from claims
            union all select distinct 'claims', 'scope_id', id, scope_type || 's', scope_id, true from claims
            union all select distinct 'contexts', 'evidence_block_ids', id, 'source_blocks', unnest(evidence_block_ids), false from contexts
            union all select distinct 'transitions', 'evidence_block_ids', id, 'source_blocks', unnest(evidence_block_ids), false from transitions
            union all select distinct 'facets', 'evidence_block_ids', id, 'source_blocks', unnest(evidence_block_ids), false from facets
            union all select distinct 'claims', 'evidence_block_ids', id, 'source_blocks', unnest(evidence_block_ids), false from claims
            union all select distinct 'map_contexts', 'evidence_block_ids', temp_id, 'source_blocks', unnest(evidence_block_ids), false from map_contexts),
        link as (select distinct t, field, id, tt, regexp_replace(ref, '^\\s+|\\s+$', '', 'g') as ref, st from x0 where ref is not null),
        arrival as (select t, id, arr from target union all select 'claims', id, arr from cl union all select 'map_contexts', id, arr from m),
        checked as (select l.*, case when g.id is null then 'missing' when g.gone then 'deleted' when g.arr > a.arr then 'late' end as reason
            from link l join arrival a on a.t = l.t and a.id = l.id left join target g on g.t = l.tt and g.id = l.ref where l.ref <> ''),
        orphan as (select t, id from checked where st and reason in ('missing', 'deleted')
            union select k.t, k.id from orphan o join checked k on k.st and k.tt = o.t and k.ref = o.id),
        every as (select t, field, id, ref, reason, 'direct' as origin from checked where reason is not null
            union all select k.t, k.field, k.id, k.ref, 'inherited', 'inherited' from checked k where k.st and coalesce(k.reason, 'late') = 'late' and (k.tt, k.ref) in (select (t, id) from orphan))"""
#: Contexts by the links that are followed: those within a loop are not.
_LINKS = """
        e0 as (select distinct v, u from (select id as v, trim(unnest(parent_ids)) as u from contexts where id is not null) where u in (select id from contexts)),
        reach as (select v as x, u as y from e0 union select r.x, e0.u from reach r join e0 on e0.v = r.y),
        cyc as (select a.x as node, min(a.y) as cycle_id from reach a join reach b on b.x = a.y and b.y = a.x group by a.x),
        e as (select e0.v, e0.u from e0 left join cyc a on a.node = e0.u left join cyc b on b.node = e0.v where a.cycle_id is null or b.cycle_id is null or a.cycle_id <> b.cycle_id),
        n as (select distinct id as node from contexts where id is not null),
        top as (select node from n where node not in (select v from e)),
        way as (select node, [node] as path from top union all select e.v, list_append(way.path, e.v) from way join e on e.u = way.node),
        up as (select node, node as ancestor, 0 as steps from n union select up.node, e.u, steps + 1 from up join e on e.v = up.ancestor)"""

SQL = {
    "p5_found": f"""
        with {_RECORDS}
        select * from (
            select source_table, field, record_id, ref_id,
                   case when target.id is null then 'missing' when target.gone then 'deleted' when target.arr > q.arr then 'late' end as reason,
                   strftime(created_at, '%Y-%m') as period
            from q left join target on target.t = q.t and target.id = q.ref_id where ref_id <> '')
        where reason is not null""",
    "p6_found": """
        with recursive e as (
            select distinct id as v, unnest(parent_ids) as u from contexts),
        reach as (select v as x, u as y from e union select r.x, e.u from reach r join e on e.v = r.y),
        on_loop as (select x from reach where x = y)
        select a.x as context_id, min(b.y) as cycle_id
        from on_loop a join reach b on b.x = a.x join reach c on c.x = b.y and c.y = a.x group by a.x""",
    "p5_report": f"""
        with recursive {_RECORDS.lstrip()}, {_INHERITED.lstrip()}
        select y.t as source_table, field, w.period, origin, reason, count(*) as n_references, count(distinct y.id) as n_records
        from every y join when_ w on w.t = y.t and w.id = y.id group by 1, 2, 3, 4, 5""",
    "p6_paths": f"""
        with recursive {_LINKS.lstrip()}
        select node as context_id, path, (len(path) - 1)::int as depth, case when path[1] not in (select node from cyc) then path[1] end as root from way""",
    "p6_descendants": f"""
        with recursive {_LINKS.lstrip()}
        select ancestor, node as descendant, min(steps)::int as least, max(steps)::int as most from up where node <> ancestor group by 1, 2""",
    "p6_hierarchy": f"""
        with recursive {_LINKS.lstrip()},
        p as (select node, list_sort(coalesce(list(distinct path[1]) filter (where path[1] not in (select node from cyc)), [])) as roots, (min(len(path)) - 1)::int as min_depth, (max(len(path)) - 1)::int as max_depth, count(*) as n_paths from way group by 1),
        below as (select ancestor as node, count(distinct up.node) as n from up where up.node <> ancestor group by 1)
        select node as context_id, roots, min_depth, max_depth, n_paths, coalesce(below.n, 0) as n_descendants, cycle_id from n left join p using (node) left join below using (node) left join cyc using (node)""",
}
