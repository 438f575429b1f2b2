"""Queries on text: keys, counts, states, scales, lines, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vocabulary as V
from evidara.operators import indexing, ranking
from evidara.plans.views import rec, sql_case, sql_key, sql_rec, sql_slug
from evidara.session import table


def normalize_key(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "claims", "from_", "to_")
    k = lambda x: X.text_key(F.col(x))
    return c.select(F.col("id").alias("claim_id"), k("from_.concept").alias("from_concept"), k("from_.state").alias("from_state"), k("to_.concept").alias("to_concept"), k("to_.state").alias("to_state"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return rec(spark, d, "source_blocks", "text").select(F.col("id").alias("block_id"), X.token_count(F.col("text")).alias("n_tokens"))


def state_ids(spark: SparkSession, d: str) -> DataFrame:
    return ranking.states(ranking.canonical_claims(rec(spark, d, "claims", "from_", "to_")))


def canonical_directions(spark: SparkSession, d: str) -> DataFrame:
    c = ranking.canonical_claims(rec(spark, d, "claims", "from_", "to_"))
    return c.groupBy(F.col("to_direction").alias("direction")).agg(F.count("*").alias("n"), F.min(X.polarity(F.col("to_direction"))).alias("polarity"))


def scale_parse(spark: SparkSession, d: str) -> DataFrame:
    b = rec(spark, d, "source_blocks", "text").where(r"text rlike '\\d\\s*[x×–—-]\\s*\\d'")
    s = b.select(F.col("id").alias("block_id"), F.explode(X.scales(F.col("text"))).alias("s"))
    return s.select("block_id", "s.kind", "s.low", "s.high", "s.unit").distinct()


def sha_register_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "claims", "from_", "to_", "relation", "description")
    t = X.embedding_text("claim", **{n: F.col(n) for n in ("from_", "to_", "relation", "description")})
    return c.select(F.col("id").alias("claim_id"), t.alias("text"))


def json_codec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    b = rec(spark, d, "source_blocks", "paper_id", "page", "text").where("page is not null")
    return indexing.repeated_lines(b.withColumn("near_edge", F.lit(True)))


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    b = rec(spark, d, "source_blocks", "paper_id", "page", "order_", "text").where("page is not null").withColumn("near_edge", F.lit(True))
    e = b.select("paper_id", "page", F.col("order_").alias("pos"), F.lit("Text").alias("semantic_class"), "text", "near_edge")
    return indexing.clean_elements(e, indexing.repeated_lines(e)).select("paper_id", "page", "pos", "text")


def rebuilt_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = rec(spark, d, "source_blocks", "paper_id", "page", "order_", "block_type", "text")
    cls = F.when(F.col("block_type") == "figure_caption", "Caption").when(F.col("block_type") == "heading", "Section-header").otherwise("Text")
    e = b.select("paper_id", F.coalesce("page", F.lit(0)).alias("page"), F.col("order_").alias("pos"), cls.alias("semantic_class"), "text").where("trim(text) <> ''")
    return indexing.build_blocks(e)


def sections_islands(spark: SparkSession, d: str) -> DataFrame:
    b = rec(spark, d, "source_blocks", "paper_id", "order_", "section_path")
    return indexing.section_islands(b).select(F.col("id").alias("block_id"), "paper_id", "island")


def section_pack(spark: SparkSession, d: str) -> DataFrame:
    b = rec(spark, d, "source_blocks", "paper_id", "order_", "section_path", "text").withColumn("n_tokens", X.token_count(F.col("text")))
    return indexing.pack_sections(indexing.section_islands(b))


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    p = rec(spark, d, "papers", "title")
    return p.where(F.lower(F.to_json(F.struct("id", "title"))).contains("over peat bog")).orderBy("id").limit(200)


QUERIES = {f.__name__: f for f in (normalize_key, token_counts, state_ids, canonical_directions, scale_parse, sha_register_dedup, claim_texts, json_codec, repeated_lines, clean_lines, rebuilt_blocks, sections_islands, section_pack, entity_search)}

_ENDS = " union all ".join(
    f"select {sql_case(sql_key(f'{s}.concept'), V.CONCEPTS)} as concept, {sql_case(sql_key(f'{s}.state'), V.DIRECTIONS)} as state from {sql_rec('claims', 'from_', 'to_')}" for s in ("from_", "to_")
)
_PAIR = r"[0-9]+(?:\.[0-9]+)?\s*-\s*[0-9]+(?:\.[0-9]+)?\s*(?:[kK][mM]|[mM])\b"
_BOX = r"[0-9]+(?:\.[0-9]+)?\s*[xX]\s*[0-9]+(?:\.[0-9]+)?\s*(?:[kK][mM]|[mM])\b"
SQL = {
    "normalize_key": f"""select id as claim_id, {sql_key('from_.concept')} as from_concept, {sql_key('from_.state')} as from_state,
        {sql_key('to_.concept')} as to_concept, {sql_key('to_.state')} as to_state from {sql_rec('claims', 'from_', 'to_')}""",
    "token_counts": f"select id as block_id, greatest(1, ceil(length(text) * 2 / 7.0::double))::int as n_tokens from {sql_rec('source_blocks', 'text')}",
    "state_ids": f"""select 'state::' || {sql_slug('concept')} || '::' || {sql_slug('state')} as id, min(concept) as concept, min(state) as state from ({_ENDS}) group by 1""",
    "canonical_directions": f"""select direction, count(*) as n, min(case direction when 'increase' then 1 when 'decrease' then -1 when 'no_detectable_change' then 0 end)::int as polarity
        from (select {sql_case(sql_key('to_.state'), V.DIRECTIONS)} as direction from {sql_rec('claims', 'from_', 'to_')}) group by 1""",
    "sha_register_dedup": "select sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
    "claim_texts": f"""select id as claim_id, 'FROM: ' || concat_ws(' | ', from_.concept, from_.state) || chr(10) || 'TO: ' || concat_ws(' | ', to_.concept, to_.state)
        || chr(10) || 'RELATION: ' || relation || chr(10) || 'DESCRIPTION: ' || description as text from {sql_rec('claims', 'from_', 'to_', 'relation', 'description')}""",
    "json_codec": "select cast(props->>'$.k' as bigint) as k, count(*) as n from events group by 1",
    "repeated_lines": f"""with b as (select * from {sql_rec('source_blocks', 'paper_id', 'page', 'text')} where page is not null),
        l as (select paper_id, page, unnest(regexp_split_to_array(text, '\\r?\\n')) as t from b),
        k as (select distinct paper_id, page, regexp_replace(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as key from l where not starts_with(ltrim(t), '#')),
        p as (select paper_id, count(distinct page) as pages from b group by 1)
        select paper_id, key, count(*) as n_pages from k join p using (paper_id) where length(key) between 2 and 150
        group by paper_id, key, pages having count(*) >= greatest(2, floor(pages * 0.6 + 0.999))""",
    "sections_islands": f"""with b as (select *, coalesce(array_to_string(section_path[1:2], chr(1)), '') as k from {sql_rec('source_blocks', 'paper_id', 'order_', 'section_path')}),
        n as (select *, case when lag(k) over (partition by paper_id order by order_) = k then 0 else 1 end as new from b)
        select id as block_id, paper_id, cast(sum(new) over (partition by paper_id order by order_ rows unbounded preceding) as bigint) as island from n""",
    "scale_parse": f"""with b as (select id, translate(text, '×–—', 'x--') as t from {sql_rec('source_blocks', 'text')} where text is not null),
        box as (select id, 'rectangle' as kind, unnest(regexp_extract_all(t, '{_BOX}')) as s from b),
        r as (select id, t, regexp_extract_all(t, '{_PAIR}') as src, regexp_split_to_array(t, '{_PAIR}') as gap from b where regexp_matches(t, '{_PAIR}')),
        i as (select id, t, src, gap, unnest(range(1, len(src) + 1)) as i from r),
        located as (select id, t, src[i] as s, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(src[1:i - 1], lambda x: length(x))), 0) as p from i),
        near as (select id, s, lower(substr(t, greatest(p - 25, 0)::bigint + 1, (p - greatest(p - 25, 0))::bigint + length(s) + 15)) as n from located),
        every as (select id, kind, s from box union all select id, case when n like '%annulus%' or n like '%annuli%' or n like '%halo%' then 'distance_band' else 'range' end, s from near)
        select distinct id as block_id, kind, regexp_extract(s, '^([0-9.]+)', 1)::double as low, regexp_extract(s, '[xX-]\\s*([0-9.]+)', 1)::double as high, lower(regexp_extract(s, '([a-zA-Z]+)$', 1)) as unit from every""",
    "clean_lines": f"""with b as (select * from {sql_rec('source_blocks', 'paper_id', 'page', 'order_', 'text')} where page is not null and text is not null),
        w as (select paper_id, page, order_, regexp_split_to_array(text, '\\r?\\n') as ls from b), l as (select paper_id, page, order_, unnest(ls) as t, generate_subscripts(ls, 1) as n from w),
        k as (select *, regexp_replace(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as key from l),
        rep as (select paper_id, key from (select distinct paper_id, page, key from k where not starts_with(ltrim(t), '#')) join (select paper_id, count(distinct page) as pages from b group by 1) using (paper_id)
            where length(key) between 2 and 150 group by paper_id, key, pages having count(*) >= greatest(2, floor(pages * 0.6 + 0.999))),
        j as (select paper_id, page, order_, replace(string_agg(t, chr(10) order by n), chr(160), ' ') as t from k where (paper_id, key) not in (select (paper_id, key) from rep) group by 1, 2, 3),
        h as (select paper_id, page, order_, regexp_replace(regexp_replace(t, '([\\p{{L}}\\p{{N}}_])-\\n([a-z])', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}_])-\\n([a-z])', '\\1\\2', 'g') as t from j),
        c as (select paper_id, page, order_ as pos, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10)), '^\\s+|\\s+$', '', 'g') as text from h)
        select * from c where text <> ''""",
    "section_pack": f"""with recursive n0 as (select *, coalesce(array_to_string(section_path[1:2], chr(1)), '') as k, coalesce(array_to_string(section_path[1:len(section_path) - 1], chr(1)), '') as parent, greatest(1, ceil(length(text) * 2 / 7.0::double))::int as size from {sql_rec('source_blocks', 'paper_id', 'order_', 'section_path', 'text')}),
        n1 as (select *, case when lag(k) over (partition by paper_id order by order_) = k then 0 else 1 end as new from n0),
        b as (select *, sum(new) over (partition by paper_id order by order_ rows unbounded preceding) as island from n1),
        k as (select *, row_number() over (partition by paper_id, island order by order_) as i, case when sum(size) over (partition by paper_id, island) > {V.SECTION_MAX} then {V.SECTION_TARGET} else {V.SECTION_MAX} end as room from b),
        fill as (select paper_id, island, i, size::bigint as held, 0 as piece from k where i = 1
            union all select k.paper_id, k.island, k.i, case when f.held + k.size > room then k.size else f.held + k.size end, case when f.held + k.size > room then f.piece + 1 else f.piece end from fill f join k on k.paper_id = f.paper_id and k.island = f.island and k.i = f.i + 1),
        parts as (select paper_id, island, piece, min(order_) as first, count(*) as nb, sum(size) as nt, arg_min(parent, order_) as parent from fill join k using (paper_id, island, i) group by 1, 2, 3),
        p as (select *, row_number() over (partition by paper_id order by first) as j from parts),
        merge_ as (select paper_id, j, nt::bigint as held, parent, 0 as grp from p where j = 1
            union all select p.paper_id, p.j, case when p.nt < {V.SECTION_MIN} and m.parent = p.parent and m.held + p.nt <= {V.SECTION_MAX} then m.held + p.nt else p.nt end,
                case when p.nt < {V.SECTION_MIN} and m.parent = p.parent and m.held + p.nt <= {V.SECTION_MAX} then m.parent else p.parent end,
                case when p.nt < {V.SECTION_MIN} and m.parent = p.parent and m.held + p.nt <= {V.SECTION_MAX} then m.grp else m.grp + 1 end from merge_ m join p on p.paper_id = m.paper_id and p.j = m.j + 1)
        select paper_id, grp as "group", min(first) as first_order, sum(nb)::int as n_blocks, sum(nt)::int as n_tokens from merge_ join p using (paper_id, j) group by 1, 2""",
    "entity_search": f"select id, title from {sql_rec('papers', 'title')} where lower(id || coalesce(title, '')) like '%over peat bog%' order by id limit 200",
}
