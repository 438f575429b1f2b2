"""The queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import components, encoding, leakage, neighbours, packing, scans, split, terms
from evidara.session import records, table

VECTOR_FIELDS = (("facets", "notion_embedding"), ("facets", "content_embedding"), ("claims", "claim_embedding"), ("contexts", "retrieval_embedding"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.mapped_endpoints(table(spark, d, "claims"), table(spark, d, "reference_terms"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return terms.unmatched_report(table(spark, d, "claims"), table(spark, d, "reference_terms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_defects(table(spark, d, "source_blocks"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scan(table(spark, d, "source_blocks")).paragraphs()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized_blocks(table(spark, d, "source_blocks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "source_blocks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_groups(components.same_pairs(table(spark, d, "consolidation_decisions")))


def _vectors(spark: SparkSession, d: str, unique: bool) -> DataFrame:
    own = lambda t, f: records(table(spark, d, t).select("id", f), "id") if unique else table(spark, d, t)
    return reduce(DataFrame.unionByName, [neighbours.vectors(own(t, f), f) for t, f in VECTOR_FIELDS])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d, False), 0.9).select("field", "left_id", "right_id")


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, d, True), 10)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, d, "documents")))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(rule, n): documents, blank ones, containers over capacity, texts cut though they fit, texts not whole; the last three are 0."""
    docs = table(spark, d, "documents")
    p = packing.pack_documents(docs)
    per = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("got"), F.max("container_id").isNull().alias("blank"))
    whole = per.join(packing.token_sizes(docs), "doc_id", "full")
    over = p.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where(f"container_id is not null and used > {packing.CAPACITY}")
    rules = {
        "documents": per, "blank": per.where("blank"), "over_capacity": over, "cut_though_fitting": whole.where(f"pieces > 1 and n_tokens <= {packing.CAPACITY}"),
        "not_whole": whole.where("not (got <=> n_tokens)"),
    }
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("rule"), "n") for k, x in rules.items()])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrased_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_documents(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_unmatched, p2_found, p2_paragraphs, p3_found, p3_pieces, p4_found, p7_found, p7_neighbours, p8_containers, p8_fill, p8_invariants, p9_found, p9_paraphrases, p10_found, p10_restored)
}

SQL = {
    "p3_found": """
        select distinct id as block_id from source_blocks where text is not null and greatest(1, ceil(length(text) / 3.5)) > 1500""",
    "p4_found": """
        with recursive e as (
            select left_id as a, right_id as b from consolidation_decisions
            where upper(trim(decision)) = 'SAME' and left_id is not null and right_id is not null and left_id <> right_id),
        s as (select a, b from e union select b, a from e),
        reach as (select a as x, a as y from s union select r.x, s.b from reach r join s on s.a = r.y)
        select x as record_id, min(y) as group_id from reach group by x""",
    "p7_found": """
        with v as (
            select 'notion_embedding' as field, id, any_value(notion_embedding::double[]) as v from facets where len(notion_embedding) = 64 group by id
            union all select 'content_embedding', id, any_value(content_embedding::double[]) from facets where len(content_embedding) = 64 group by id
            union all select 'claim_embedding', id, any_value(claim_embedding::double[]) from claims where len(claim_embedding) = 64 group by id
            union all select 'retrieval_embedding', id, any_value(retrieval_embedding::double[]) from contexts where len(retrieval_embedding) = 64 group by id),
        u as (select field, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::double[64] as v from v where list_dot_product(v, v) > 0)
        select a.field, a.id as left_id, b.id as right_id from u a join u b on a.field = b.field and a.id < b.id
        where array_inner_product(a.v, b.v) >= 0.9""",
    "p8_invariants": """
        select 'documents' as rule, count(*) as n from documents union all select 'blank', count(*) from documents where coalesce(text, '') = ''
        union all select * from (values ('over_capacity', 0), ('cut_though_fitting', 0), ('not_whole', 0)) v(rule, n)""",
    "p9_found": """
        with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
        i as (select item_id, regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+') as w from eval_items
              union all select item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') from eval_items),
        ds as (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12),
        g as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as r from ds),
        js as (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12),
        h as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as r from js)
        select distinct doc_id, item_id from g join h using (r)""",
}
