"""Queries on deduplication, candidate pairs, merging, redirects, reversals and re-canonicalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vector as N
from evidara.functions import vocabulary as V
from evidara.operators import curation, graph, ranking
from evidara.plans import graph_plans
from evidara.plans.views import rec, sql_case, sql_key, sql_rec, sql_slug
from evidara.session import table


def exact_dedup_claims(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "claims", "scope_id", "from_", "to_", "relation", "description", "evidence_block_ids", "conditioning_facet_ids").withColumn("pos", F.col("id"))
    x = curation.exact_dedup(c, curation.claim_keys(), ("evidence_block_ids", "conditioning_facet_ids"))
    return x.select("id", "n_merged", F.size("evidence_block_ids").alias("n_blocks"), F.size("conditioning_facet_ids").alias("n_facets"))


def exact_dedup_facets(spark: SparkSession, d: str) -> DataFrame:
    f = rec(spark, d, "facets", "context_id", "domain", "notion", "description", "evidence_block_ids").withColumn("pos", F.col("id"))
    return curation.exact_dedup(f, curation.facet_keys(), ("evidence_block_ids",)).select("id", "n_merged", F.size("evidence_block_ids").alias("n_blocks"))


def exact_dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def mention_inventory(spark: SparkSession, d: str) -> DataFrame:
    m = rec(spark, d, "map_contexts", "paper_id", "label", "evidence_block_ids")
    m = m.select(F.col("paper_id").alias("group"), F.col("label").alias("name"), F.col("evidence_block_ids").alias("block_ids"), F.col("id").alias("pos"))
    return curation.mention_inventory(m).select(F.col("group").alias("paper_id"), "mention_id", "name", F.size("block_ids").alias("n_blocks"), "n")


def context_pairs(spark: SparkSession, d: str) -> DataFrame:
    return curation.context_pairs(rec(spark, d, "contexts", "paper_id", "label", "aliases"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = rec(spark, d, "facets", "context_id", "domain", "notion", "notion_embedding", "content_embedding")
    for c in ("notion_embedding", "content_embedding"):
        f = f.withColumn(c, F.when(F.size(c) == 64, N.doubles(F.col(c))))
    p = curation.facet_pairs(f)
    return p.select("left_id", "right_id", F.round("notion_cosine", 6).alias("notion_cosine"), F.round("content_cosine", 6).alias("content_cosine"))


def _groups(spark: SparkSession, d: str, kind: str) -> DataFrame:
    t = table(spark, d, "consolidation_decisions").where((F.col("object_type") == kind) & (F.upper(F.trim("decision")) == "SAME") & F.col("left_id").isNotNull() & F.col("right_id").isNotNull() & (F.col("left_id") != F.col("right_id")))
    pairs = t.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).distinct()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    return graph.components(pairs, nodes).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def merge_canonical(spark: SparkSession, d: str) -> DataFrame:
    f = rec(spark, d, "facets", "description", "evidence_block_ids").withColumn("pos", F.col("id"))
    m = curation.merge_groups(f, _groups(spark, d, "facet"))
    return m.select("id", "canonical_id", F.size("evidence_block_ids").alias("n_blocks"))


def redirects(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "contexts", "parent_ids", "evidence_block_ids", "spatial_support")
    c = c.withColumn("spatial_key", F.to_json("spatial_support")).withColumn("pos", F.col("id")).withColumn("description", F.lit(""))
    to = curation.merge_groups(c.drop("parent_ids"), _groups(spark, d, "context"), contexts=True).select("id", "canonical_id")
    f = curation.redirect(rec(spark, d, "facets", "context_id"), "context_id", to)
    return f.groupBy("context_id").agg(F.count("*").alias("n_facets"))


def parent_redirects(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "contexts", "parent_ids")
    to = _groups(spark, d, "context").select("id", F.col("group_id").alias("canonical_id"))
    return curation.redirect(c, "parent_ids", to, "id").select("id", F.coalesce(F.array_join("parent_ids", " "), F.lit("")).alias("parents"))


def reversal_groups(spark: SparkSession, d: str) -> DataFrame:
    c = ranking.canonical_claims(rec(spark, d, "claims", "scope_id", "relation", "from_", "to_"))
    own = curation.reversals(c).unionByName(curation.reversals(c, everywhere=True))
    return own.select("claim_id", "scope_id", "from_key", "to_key", F.size("polarities").alias("n_polarities"))


def recanonicalize_diff(spark: SparkSession, d: str) -> DataFrame:
    return curation.recanonicalised(rec(spark, d, "claims", "from_", "to_"))


def polarity_class(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "claims", "relation", "to_")
    p = X.polarity(X.canonical_direction(X.text_key(F.col("to_.state"))))
    return c.groupBy("relation", p.alias("polarity")).agg(F.count("*").alias("n"))


def ordinal_ids(spark: SparkSession, d: str) -> DataFrame:
    """Permanent ids: contexts of a paper by topological level, then by id."""
    c = rec(spark, d, "contexts", "paper_id", "parent_ids")
    lv = graph.topological_levels(graph.parent_pairs(c), c.select(F.col("id").alias("node"))).where("level is not null")
    x = c.join(lv.withColumnRenamed("node", "id"), "id")
    # a paper's numbers run on from level to level: no task orders a whole paper
    before = x.groupBy("paper_id", "level").agg(F.count("*").alias("k"))
    before = before.withColumn("start", F.coalesce(F.sum("k").over(W.partitionBy("paper_id").orderBy("level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    x = x.join(before, ["paper_id", "level"])
    n = F.col("start") + F.row_number().over(W.partitionBy("paper_id", "level").orderBy("id"))
    return x.select("id", "level", F.format_string("%s_C%03d", F.col("paper_id"), n).alias("permanent_id"))


QUERIES = {f.__name__: f for f in (exact_dedup_claims, exact_dedup_facets, exact_dedup_documents, mention_inventory, context_pairs, near_dup_pairs, merge_canonical, redirects, parent_redirects, reversal_groups, recanonicalize_diff, polarity_class, ordinal_ids)}

_DIR = lambda s: sql_case(sql_key(s + ".state"), V.DIRECTIONS)
_CON = lambda s: sql_case(sql_key(s + ".concept"), V.CONCEPTS)
_POL = lambda x: f"(case {x} when 'increase' then 1 when 'decrease' then -1 when 'no_detectable_change' then 0 end)"
_SID = lambda c, s: f"'state::' || {sql_slug(c)} || '::' || {sql_slug(s)}"
_LISTS = lambda c: f"coalesce(len(list_distinct([coalesce(x, chr(1)) for x in flatten(list({c}))])), 0)::int"
_GROUPS = lambda kind: f"""recursive s as (select left_id as a, right_id as b from consolidation_decisions where object_type = '{kind}' and upper(trim(decision)) = 'SAME' and left_id <> right_id
        union select right_id, left_id from consolidation_decisions where object_type = '{kind}' and upper(trim(decision)) = 'SAME' and left_id <> right_id),
    rc as (select a as x, a as y from s union select rc.x, s.b from rc join s on s.a = rc.y), g as (select x as id, min(y) as group_id from rc group by 1)"""  # noqa: E731
SQL = {
    "exact_dedup_claims": f"""select min(id) as id, count(*) as n_merged, {_LISTS('evidence_block_ids')} as n_blocks, {_LISTS('conditioning_facet_ids')} as n_facets
        from (select * from {sql_rec('claims', 'scope_id', 'from_', 'to_', 'relation', 'description', 'evidence_block_ids', 'conditioning_facet_ids')})
        group by scope_id, relation, {sql_key('from_.concept')}, {sql_key('from_.state')}, {sql_key('to_.concept')}, {sql_key('to_.state')}, {sql_key('description')}""",
    "exact_dedup_facets": f"""select min(id) as id, count(*) as n_merged, {_LISTS('evidence_block_ids')} as n_blocks from {sql_rec('facets', 'context_id', 'domain', 'notion', 'description', 'evidence_block_ids')}
        group by context_id, {sql_key('domain')}, {sql_key('notion')}, {sql_key('description')}""",
    "exact_dedup_documents": "select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by text",
    "mention_inventory": f"""with m as (select id, paper_id, label, evidence_block_ids, {sql_key('label')} as key from {sql_rec('map_contexts', 'paper_id', 'label', 'evidence_block_ids')}),
        g as (select paper_id, key, min(id) as first, arg_min(label, id) as name, coalesce(len(list_distinct(flatten(list(evidence_block_ids)))) + max(case when list_contains([x is null for x in evidence_block_ids], true) then 1 else 0 end), 0)::int as n_blocks, count(*) as n from m where key <> '' group by 1, 2)
        select paper_id, printf('CM%03d', row_number() over (partition by paper_id order by first)) as mention_id, name, n_blocks, n from g""",
    "context_pairs": f"""with n as (select distinct paper_id, id, {sql_key('x')} as k from (select paper_id, id, unnest(list_concat([label], coalesce(aliases, []))) as x from {sql_rec('contexts', 'paper_id', 'label', 'aliases')}) where trim(coalesce(x, '')) <> '')
        select distinct a.id as left_id, b.id as right_id, 'shared_alias' as reason from n a join n b on a.paper_id = b.paper_id and a.k = b.k and a.id < b.id""",
    "near_dup_pairs": f"""with f as (select id, context_id, domain, {sql_key('notion')} as k, case when len(notion_embedding) = 64 then notion_embedding::double[] end as n, case when len(content_embedding) = 64 then content_embedding::double[] end as c
            from {sql_rec('facets', 'context_id', 'domain', 'notion', 'notion_embedding', 'content_embedding')}),
        x as (select a.id as left_id, b.id as right_id, a.k = b.k as same, coalesce(list_dot_product(a.n, b.n), 0.0::double) as nc, coalesce(list_dot_product(a.c, b.c), 0.0::double) as cc
            from f a join f b on a.context_id = b.context_id and a.domain = b.domain and a.id < b.id)
        select left_id, right_id, round(nc, 6) as notion_cosine, round(cc, 6) as content_cosine from x where same or nc >= {V.NOTION_COSINE} or cc >= {V.CONTENT_COSINE}""",
    "merge_canonical": f"""with {_GROUPS('facet')}, f as (select * from {sql_rec('facets', 'description', 'evidence_block_ids')}),
        x as (select f.*, g.group_id, first_value(f.id) over (partition by group_id order by coalesce(len(list_distinct(evidence_block_ids)), 0) desc, length(coalesce(description, '')) desc, f.id) as canonical_id from f join g on g.id = f.id),
        m as (select canonical_id, len(list_distinct(flatten(list(evidence_block_ids))))::int as n_blocks from x group by 1)
        select id, canonical_id, n_blocks from x join m using (canonical_id)""",
    "redirects": f"""with {_GROUPS('context')}, c as (select * from {sql_rec('contexts', 'spatial_support')}),
        k as (select g.group_id, count(distinct spatial_support::varchar) as n from c join g on g.id = c.id group by 1), to_ as (select g.id, case when k.n > 1 then g.id else g.group_id end as canonical_id from g join k using (group_id) where g.id in (select id from c)),
        first as (select group_id, min(id) as id from g where id in (select id from c) group by 1), fix as (select to_.id, case when k.n > 1 then to_.id else first.id end as canonical_id from to_ join g on g.id = to_.id join k using (group_id) join first using (group_id))
        select coalesce(fix.canonical_id, f.context_id) as context_id, count(*) as n_facets from {sql_rec('facets', 'context_id')} f left join fix on fix.id = f.context_id group by 1""",
    "ordinal_ids": f"""with lv as ({graph_plans.SQL['topo_levels']}), c as (select * from {sql_rec('contexts', 'paper_id')})
        select id, level, paper_id || '_C' || printf('%03d', row_number() over (partition by paper_id order by level, id)) as permanent_id from c join lv on lv.node = c.id where level is not null""",
    "parent_redirects": f"""with {_GROUPS('context')}, c as (select * from {sql_rec('contexts', 'parent_ids')}),
        e as (select c.id, unnest(parent_ids) as p, generate_subscripts(parent_ids, 1) as i from c),
        r as (select e.id, coalesce(g.group_id, e.p) as p, min(i) as i from e left join g on g.id = e.p where coalesce(g.group_id, e.p) <> e.id group by 1, 2)
        select c.id, coalesce(string_agg(r.p, ' ' order by r.i), '') as parents from c left join r on r.id = c.id group by 1""",
    "reversal_groups": f"""with x as (select id, scope_id, relation, {sql_key('from_.concept')} as f, {sql_key('to_.concept')} as t, {_POL(_DIR('to_'))} as p from {sql_rec('claims', 'scope_id', 'relation', 'from_', 'to_')}),
        g as (select scope_id, relation, f, t, count(distinct p) as n from x where scope_id is not null group by 1, 2, 3, 4 having count(distinct p) > 1),
        h as (select relation, f, t, count(distinct p) as n from x where relation is not null group by 1, 2, 3 having count(distinct p) > 1)
        select x.id as claim_id, scope_id, f as from_key, t as to_key, n::int as n_polarities from x join g using (scope_id, relation, f, t)
        union all select x.id, null, f, t, n::int from x join h using (relation, f, t)""",
    "recanonicalize_diff": "select * from (" + " union all ".join(
        f"select id as claim_id, '{n}' as side, {_SID(sql_key(s + '.concept'), sql_key(s + '.state'))} as old_id, {_SID(_CON(s), _DIR(s))} as new_id from {sql_rec('claims', 'from_', 'to_')}" for n, s in (("from", "from_"), ("to", "to_"))
    ) + ") where old_id <> new_id",
    "polarity_class": f"select relation, {_POL(_DIR('to_'))}::int as polarity, count(*) as n from {sql_rec('claims', 'relation', 'to_')} group by 1, 2",
}
