"""Queries on retrieval and reasoning for a stated batch of questions.

The questions are the contexts whose number (the paper's plus their own) is divisible by 50,
asked against all rows: a context's own facets and vector ask for similar contexts, its first
claim gives the endpoints. Texts that have no model's vectors get hashed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vector as N
from evidara.functions import vocabulary as V
from evidara.operators import evidence, graph, indexing, paths, ranking, retrieval
from evidara.plans.views import ASKED, asked, rec, sql_case, sql_key, sql_rec, sql_slug
from evidara.session import cut, table


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    t = retrieval.exact_topk(q, e.select(F.format_string("%08d", "vec_id").alias("id"), F.col("embedding").alias("v")), 10)
    return t.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def _hashed(c: str):
    return N.hashed(X.plain_words(F.col(c)))


def _asking(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return rec(spark, d, "contexts", "paper_id", *cols).where(asked()).withColumnRenamed("id", "query_id")


def _searched_blocks(spark: SparkSession, d: str, q: DataFrame, *cols: str) -> DataFrame:
    """All blocks of the papers that are asked about; retrieval of blocks is within a paper."""
    return rec(spark, d, "source_blocks", "paper_id", "order_", "block_type", "text", *cols).join(q.select("paper_id").distinct(), "paper_id", "left_semi")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    q = _asking(spark, d, "label").where("label is not null").withColumnRenamed("label", "text")
    b = _searched_blocks(spark, d, q).where("block_type <> 'reference'").withColumnRenamed("id", "block_id")
    return retrieval.bm25(b, q, 10).select("query_id", "block_id", "rank", F.round("score", 6).alias("score"))


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    q = _asking(spark, d, "label").select("paper_id", "query_id", _hashed("label").alias("qv"))
    b = _searched_blocks(spark, d, q).where("block_type <> 'reference'").select("paper_id", F.col("id").alias("block_id"), "order_", _hashed("text").alias("v"))
    return retrieval.semantic_blocks(b, q, 10).select("query_id", "block_id", "rank", F.round("score", 6).alias("score"))


def alias_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every context with the blocks of its paper that name it."""
    a = rec(spark, d, "contexts", "paper_id", "label", "aliases")
    b = rec(spark, d, "source_blocks", "paper_id", "text")
    a = a.select(F.col("id").alias("context_id"), "paper_id", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).withColumn("key", X.text_key(F.col("alias"))).where("key <> ''")
    b = b.select(F.col("id").alias("block_id"), "paper_id", X.text_key(F.col("text")).alias("t"))
    # a key that many contexts of a paper share is looked for once
    held = retrieval.holding(b, a)
    return held.join(a, ["paper_id", "key"]).select("context_id", "block_id").distinct()


def neighbour_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = rec(spark, d, "source_blocks", "paper_id", "order_")
    t = rec(spark, d, "transitions", "paper_id", "evidence_block_ids").select(F.col("id").alias("transition_id"), "paper_id", F.explode("evidence_block_ids").alias("bid"))
    at = t.join(b.select(F.col("id").alias("bid"), "order_"), "bid").select("transition_id", "paper_id", F.explode(F.sequence(F.col("order_") - 1, F.col("order_") + 1)).alias("order_")).distinct()
    return at.join(b, ["paper_id", "order_"]).select("transition_id", F.col("id").alias("block_id"))


def _usable(c):
    return F.when(F.size(c) == 64, N.doubles(c))


def _facets(spark: SparkSession, d: str) -> DataFrame:
    f = rec(spark, d, "facets", "context_id", "domain", "notion_embedding", "content_embedding")
    return f.select("id", "context_id", "domain", _usable(F.col("notion_embedding")).alias("n"), _usable(F.col("content_embedding")).alias("c"))


def _questions(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The batch: q (query_id, qv), qf (facets), contexts, effective facets, claims."""
    c = rec(spark, d, "contexts", "paper_id", "parent_ids", "retrieval_embedding", "label")
    f = cut(_facets(spark, d), "facets")
    q = c.where(asked()).select(F.col("id").alias("query_id"), _usable(F.col("retrieval_embedding")).alias("qv"), _hashed("label").alias("intervention_vector"))
    qf = f.where(asked(F.col("context_id"))).select(F.col("context_id").alias("query_id"), F.col("id").alias("query_facet_id"), "domain", F.col("n").alias("qn"), F.col("c").alias("qc"))
    # ids go down the hierarchy, vectors are joined to what a filter leaves
    eff = graph.effective_facets(c.select("id", "parent_ids"), f.select("id", "context_id", "domain")).select("context_id", "facet_id", "domain")
    vectors = f.select(F.col("id").alias("facet_id"), F.col("n").alias("cn"), F.col("c").alias("cc"))
    return {"q": cut(q, "q"), "qf": cut(qf, "qf"), "contexts": c.select("id", "paper_id", _usable(F.col("retrieval_embedding")).alias("v")), "effective": cut(eff, "effective"), "vectors": vectors, "facets": f}


def _retrieved(b: dict[str, DataFrame]) -> DataFrame:
    return retrieval.retrieve_contexts(b["q"], b["qf"], b["contexts"], b["effective"], b["vectors"])


def context_retrieval(spark: SparkSession, d: str) -> DataFrame:
    r = _retrieved(_questions(spark, d))
    return r.select("query_id", "context_id", "rank", *[F.round(c, 6).alias(c) for c in ("coarse", "semantic", "coverage", "overall")])


def maxsim_matches(spark: SparkSession, d: str) -> DataFrame:
    b = _questions(spark, d)
    top = retrieval.exact_topk(b["q"].join(b["qf"].select("query_id").distinct(), "query_id", "left_semi").select("query_id", "qv"), b["contexts"], 10)
    held = b["effective"].join(top.select("query_id", F.col("id").alias("context_id")), "context_id").join(b["vectors"], "facet_id")
    m = retrieval.facet_matches(b["qf"], held)
    return m.select("query_id", "context_id", "domain", "query_facet_id", "facet_id", F.round("pair", 6).alias("pair"))


def coherence_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each asked context with every other one of its paper."""
    c = cut(rec(spark, d, "contexts", "paper_id", "parent_ids"), "contexts")
    f = cut(rec(spark, d, "facets", "context_id", "domain"), "facets")
    sets = c.select("paper_id", F.col("id").alias("set_id"), F.coalesce(asked(), F.lit(False)).alias("asked"))
    sets = sets.join(sets.where("asked").select("paper_id").distinct(), "paper_id", "left_semi")
    eff = graph.effective_facets(c.select("id", "parent_ids"), f).select(F.col("context_id").alias("set_id"), "facet_id", "domain")
    eff = cut(eff.join(sets.select("set_id"), "set_id", "left_semi"), "effective")
    vectors = _facets(spark, d).select(F.col("id").alias("facet_id"), "n", "c")
    return retrieval.coherence_within(sets, eff, vectors).select("left", "right", F.round("coherence", 6).alias("coherence"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "claims", "paper_id", "scope_type", "scope_id", "from_", "to_", "relation", "description", "conditioning_facet_ids", "evidence_block_ids", "claim_embedding")
    c = ranking.canonical_claims(c).withColumn("claim_embedding", _usable(F.col("claim_embedding")))
    return ranking.scoped(c, rec(spark, d, "transitions", "from_context_id"))


def _batch(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    b = _questions(spark, d)
    c = cut(_claims(spark, d), "claims")
    first = W.partitionBy("scope_context_id").orderBy("id")
    seed = c.where("scope_context_id is not null").withColumn("k", F.row_number().over(first)).where("k = 1")
    seed = seed.select(F.col("scope_context_id").alias("query_id"), "from_concept", "from_direction", "to_concept", "to_direction", F.col("claim_embedding").alias("claim_vector"), (F.regexp_extract("id", r"(\d+)$", 1).cast("int") % 4).alias("m"))
    q = b["q"].join(seed, "query_id")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("forward", "backward", "a_to_b", "global")]), F.col("m").cast("int") + 1)
    q = cut(q.withColumn("mode", mode), "questions")
    ends = q.where("m in (0, 2)").select("query_id", F.lit("source").alias("side"), F.col("from_concept").alias("concept"), F.col("from_direction").alias("state"))
    ends = ends.unionByName(q.where("m in (1, 2)").select("query_id", F.lit("target").alias("side"), F.col("to_concept").alias("concept"), F.col("to_direction").alias("state")))
    seeds = ranking.map_endpoints(ends, ranking.states(c))
    moves = cut(rec(spark, d, "transitions", "description").select("id", _hashed("description").alias("v")), "moves")
    return b | {"moves": moves, "questions": q, "claims": c, "seeds": cut(seeds, "seeds"), "retained": cut(_retrieved(b), "retained")}


def state_mapping(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d)["seeds"].select("query_id", "side", "state_id", "score")


def _ranked(b: dict[str, DataFrame]) -> DataFrame:
    f = b["facets"].select(F.col("id").alias("facet_id"), "domain", F.col("n").alias("cn"), F.col("c").alias("cc"))
    return ranking.rank_claims(b["questions"].select("query_id", "mode", "claim_vector", "intervention_vector"), b["claims"], b["retained"], b["seeds"], f, b["qf"], b["moves"])


def claim_rank(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(_batch(spark, d))
    return r.select("query_id", "claim_id", "rank", F.round("score", 6).alias("score"), F.round("applicability", 6).alias("applicability"), F.round("intervention", 6).alias("intervention"), F.array_join("channels", ",").alias("channels"))


def _searched(b: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    ranked = cut(_ranked(b).join(b["claims"].select(F.col("id").alias("claim_id"), "from_state", "to_state"), "claim_id"), "ranked")
    pairs = paths.adjacent(ranked)
    scope = b["claims"].select(F.col("id").alias("claim"), F.col("scope_context_id").alias("context_id"))
    use = pairs.select(F.col("left").alias("claim")).distinct().join(scope, "claim")
    f = b["effective"].join(use, "context_id").join(b["vectors"], "facet_id").select(F.col("claim").alias("set_id"), "facet_id", "domain", F.col("cn").alias("n"), F.col("cc").alias("c"))
    return paths.search(b["questions"], ranked, b["seeds"], retrieval.coherence(cut(f, "sets"), cut(pairs, "pairs"))), ranked


def paths_found(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _searched(_batch(spark, d))
    return p.select("query_id", "rank", F.array_join("claims", " ").alias("claims"), "length", F.round("score", 6).alias("score"))


def ask(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from questions to cited evidence: paths, contradicting and other claims on their endpoints, blocks within the budget, citations."""
    b = _batch(spark, d)
    p, ranked = _searched(b)
    p = cut(p, "paths")
    focal = cut(evidence.focal_claims(p), "focal")
    other = cut(evidence.alternatives(focal, cut(_keyed(spark, d), "keyed"), ranked), "alternatives")
    blocks = rec(spark, d, "source_blocks", "page", "order_", "section_path", "text")
    wanted = focal.select("query_id", "claim_id").union(other.select("query_id", "claim_id")).distinct()
    told = cut(wanted.join(b["claims"].withColumnRenamed("id", "claim_id").select("claim_id", "from_concept", "from_direction", "relation", "to_concept", "to_direction", "description", "conditioning_facet_ids"), "claim_id"), "told")
    needed = told.select("query_id", F.explode("conditioning_facet_ids").alias("claim_id")).distinct()
    own = evidence.facet_blocks(needed.withColumnRenamed("claim_id", "facet_id"), rec(spark, d, "facets", "evidence_block_ids"), blocks.select("id", "order_"))
    held = evidence.evidence_blocks(wanted, b["claims"], blocks).unionByName(own.select("query_id", F.col("facet_id").alias("claim_id"), "block_id", F.lit(1).alias("k")))
    held = held.join(blocks.select(F.col("id").alias("block_id"), "text"), "block_id").groupBy("query_id").agg(F.collect_list(F.struct(F.col("claim_id").alias("id"), "k", "block_id", "text")).alias("held"))
    rank = F.array_position(F.array(*[F.lit(c) for c in evidence.CLASSES]), F.col("classification"))
    other = other.join(focal.select("query_id", F.col("claim_id").alias("focal_claim_id"), "pos"), ["query_id", "focal_claim_id"])
    other = other.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", rank.alias("class"), "claim_id", "focal_claim_id", "classification"))).alias("a"))
    other = other.select("query_id", F.transform("a", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["focal_claim_id"].alias("focal_claim_id"), x["classification"].alias("classification"))).alias("alternatives"))
    claims = told.groupBy("query_id").agg(F.collect_list(F.struct(F.col("claim_id").alias("id"), *[c for c in told.columns if c not in ("query_id", "claim_id")])).alias("claims"))
    best = p.groupBy("query_id").agg(F.collect_list(F.struct("rank", "claims", "score")).alias("paths"))
    whole = b["questions"].select("query_id", "mode").join(best, "query_id").join(claims, "query_id").join(other, "query_id", "left").join(held, "query_id")
    pack = cut(evidence.packages(whole), "packages")
    cites = evidence.citations(b["claims"], rec(spark, d, "papers", "title", "year", "doi"), blocks)
    scores = ranked.select("query_id", "claim_id", F.round("score", 6).alias("score"))
    out = pack.join(cites.select("claim_id", "citation"), "claim_id", "left").join(scores, ["query_id", "claim_id"], "left")
    return out.select("query_id", "pos", "claim_id", "facet_id", "role", "focal_claim_id", "score", F.array_join("blocks", " ").alias("blocks"), "citation", F.array_join("warnings", ",").alias("warnings"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "claims", "paper_id", "from_", "to_")
    k = lambda x: X.text_key(F.col(x))
    return c.select("id", "paper_id", k("from_.concept").alias("from_key"), k("to_.concept").alias("to_key"), X.canonical_direction(k("to_.state")).alias("to_direction"), k("to_.state").alias("to_state_key"))


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    c = cut(_keyed(spark, d), "keyed")
    focal = c.where(asked()).select(F.col("id").alias("query_id"), F.col("id").alias("claim_id"), F.lit(1).alias("pos"))
    return evidence.alternatives(focal, c)


def evidence_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = rec(spark, d, "claims", "evidence_block_ids").withColumn("claim_embedding", F.lit(None).cast("array<double>"))
    wanted = c.select(F.lit("all").alias("query_id"), F.col("id").alias("claim_id"))
    return evidence.evidence_blocks(wanted, c, rec(spark, d, "source_blocks", "order_", "section_path")).select("claim_id", "block_id", "k")


def evidence_blocks_scored(spark: SparkSession, d: str) -> DataFrame:
    """Every claim's blocks by closeness to the claim and to what it is asked for (its outcome), and the section's bonus."""
    c = rec(spark, d, "claims", "evidence_block_ids", "description", "to_").withColumn("claim_embedding", _hashed("description"))
    wanted = c.select(F.lit("all").alias("query_id"), F.col("id").alias("claim_id"), _hashed("to_.concept").alias("qv"))
    b = rec(spark, d, "source_blocks", "order_", "section_path", "text").select("id", "order_", "section_path", _hashed("text").alias("v"))
    return evidence.evidence_blocks(wanted, c, cut(b, "vectors")).select("claim_id", "block_id", "k")


def facet_blocks(spark: SparkSession, d: str) -> DataFrame:
    f = rec(spark, d, "facets", "notion", "evidence_block_ids")
    b = rec(spark, d, "source_blocks", "order_", "text").select("id", "order_", _hashed("text").alias("v"))
    return evidence.facet_blocks(f.select(F.lit("all").alias("query_id"), F.col("id").alias("facet_id"), _hashed("notion").alias("qv")), f, cut(b, "vectors")).select("facet_id", "block_id")


def citations(spark: SparkSession, d: str) -> DataFrame:
    x = evidence.citations(rec(spark, d, "claims", "paper_id", "evidence_block_ids"), rec(spark, d, "papers", "title", "year", "doi"), rec(spark, d, "source_blocks", "page"))
    return x.select("claim_id", "paper_id", "doi", F.size("pages").alias("n_pages"), "citation")


def grounding_filter(spark: SparkSession, d: str) -> DataFrame:
    """Claims as answer items that cite themselves and their conditioning facets; known facets are allowed."""
    c = rec(spark, d, "claims", "paper_id", "relation", "conditioning_facet_ids")
    items = c.select(F.col("paper_id").alias("query_id"), F.col("id").alias("item"), F.when(F.col("relation") == "causal", "mechanism").otherwise("limitation").alias("kind"), F.array("id").alias("claim_ids"), F.col("conditioning_facet_ids").alias("facet_ids"))
    f = rec(spark, d, "facets", "context_id").select(F.substring("context_id", 1, 8).alias("query_id"), "id")
    g = evidence.grounded(items, c.select(F.col("paper_id").alias("query_id"), "id"), f)
    return g.select("query_id", "item", "kind", "grounded")


def _bundle(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    """Candidate blocks for the prompts of the contexts ``c``."""
    b = cut(_searched_blocks(spark, d, c, "section_path"), "blocks")
    usable = b.where("block_type <> 'reference'").withColumnRenamed("id", "block_id")
    lex = cut(retrieval.bm25(usable.select("paper_id", "block_id", "order_", "text"), c.select("paper_id", "query_id", F.col("label").alias("text")).where("text is not null"), 10), "lexical")
    sem = retrieval.semantic_blocks(usable.select("paper_id", "block_id", "order_", _hashed("text").alias("v")), c.select("paper_id", "query_id", _hashed("label").alias("qv")), 10)
    must = c.select("paper_id", "query_id", F.explode("evidence_block_ids").alias("block_id"))
    names = c.select("paper_id", "query_id", F.explode("aliases").alias("alias"))
    return indexing.bundle_candidates(b, lex, must, names, "context", cut(sem, "semantic"))


def bundle_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What competes for the prompts of the asked contexts, in order: everything before the budget."""
    x = _bundle(spark, d, cut(_asking(spark, d, "label", "aliases", "evidence_block_ids"), "contexts"))
    return x.select("query_id", "block_id", "must", "named", "hit", "pos", "size")


def hybrid_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Every context of every paper asks for the blocks of its prompt."""
    c = cut(rec(spark, d, "contexts", "paper_id", "label", "aliases", "evidence_block_ids").withColumnRenamed("id", "query_id"), "contexts")
    return indexing.evidence_bundle(cut(_bundle(spark, d, c), "candidates"))


def report_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of the batch's reports: each question's context is expected, its own claim required."""
    b = _batch(spark, d)
    p, ranked = _searched(b)
    p = cut(p, "paths").where(F.col("rank") <= V.TOP_PATHS)
    seeds = lambda side: F.count_if(F.col("side") == side).cast("int")
    s = b["seeds"].groupBy("query_id").agg(seeds("source").alias("source_seeds"), seeds("target").alias("target_seeds"))
    routes = p.groupBy("query_id").agg(F.collect_list("claims").alias("path_claims"))
    known = p.select("query_id", F.explode("claims").alias("claim_id")).join(ranked.select("query_id", "claim_id", "applicability"), ["query_id", "claim_id"])
    known = known.groupBy("query_id").agg(F.array(F.max("applicability")).alias("path_applicability"), F.collect_set("claim_id").alias("provenance"))
    cands = ranked.groupBy("query_id").agg(F.collect_list("claim_id").alias("ranked"))
    n = b["qf"].groupBy("query_id").agg(F.count("*").cast("int").alias("n_facets"))
    r = b["questions"].select("query_id", "mode", "m")
    for df in (s, routes, known, cands, n):
        r = r.join(df, "query_id", "left")
    r = r.select(
        "*", F.col("query_id").alias("expected_id"), F.col("mode").alias("expected_mode"), F.lit(True).alias("expects_context"), F.when(F.coalesce("n_facets", F.lit(0)) == 0, "empty_query_context").alias("gate_disabled"),
        F.col("m").isin(0, 2).alias("has_source"), F.col("m").isin(1, 2).alias("has_target"), F.size(F.coalesce("provenance", F.array().cast("array<string>"))).alias("n_blocks"), F.size(F.coalesce("provenance", F.array().cast("array<string>"))).alias("n_items"),
        F.array(F.coalesce("provenance", F.array().cast("array<string>"))).alias("required"), F.concat_ws(" ", "provenance").alias("answer"), F.array().cast("array<string>").alias("warnings"),
    )
    return evidence.report_checks(r)


QUERIES = {f.__name__: f for f in (cosine_topk, bm25_topk, semantic_topk, alias_hits, neighbour_blocks, context_retrieval, maxsim_matches, coherence_pairs, state_mapping, claim_rank, paths_found, ask, alternatives, evidence_blocks, evidence_blocks_scored, facet_blocks, citations, grounding_filter, bundle_candidates, hybrid_bundle, report_checks)}

_WORDS = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_%+./-]+')"
_PRIORITY = f"""(case when s like '%results%' or s like '%analysis%' then 5 when s like '%discussion%' then 4 when s like '%conclusion%' then 3 when s like '%methods%' then 2 else 0 end)"""
_WEIGHT = "(case domain when 'other' then 0.5 else 1.0 end)::double"
_USABLE = lambda c: f"case when len({c}) = 64 then {c}::double[] end"
_DOT = lambda a, b: f"(case when {a} is null or {b} is null then 0.0::double else greatest(0.0::double, list_dot_product({a}, {b})) end)"
_CX = sql_rec("contexts", "paper_id", "parent_ids", "retrieval_embedding", "label")
_HASH = lambda x: f"list_transform([list_transform(range(0, 16), lambda d: len(list_filter({_WORDS(x)}, lambda y: strpos('0123456789abcdef', md5(y)[1]) - 1 = d))::double)], lambda h: case when list_sum(h) > 0 then list_transform(h, lambda z: z / sqrt(list_dot_product(h, h))) end)[1]"
_FA = sql_rec("facets", "context_id", "domain", "notion_embedding", "content_embedding")
_BASE = f"""recursive cx as (select id, paper_id, parent_ids, label, {_USABLE('retrieval_embedding')} as v from {_CX}),
    fa as (select id, context_id, domain, {_USABLE('notion_embedding')} as n, {_USABLE('content_embedding')} as c from {_FA}),
    e as (select distinct x.id as node, x.p as parent from (select id, unnest(parent_ids) as p from cx) x where x.p in (select id from cx)),
    up as (select id as node, id as ancestor from cx union select up.node, e.parent from up join e on e.node = up.ancestor),
    eff as (select up.node as context_id, fa.id as facet_id, fa.domain, fa.n, fa.c from up join fa on fa.context_id = up.ancestor),
    q as (select id as query_id, v as qv, {_HASH('label')} as hv from cx where {ASKED.format('id')}),
    qf as (select context_id as query_id, id as query_facet_id, domain, n as qn, c as qc from fa where {ASKED.format('context_id')})"""
_TOP = lambda k: f"""co as (select * from (select q.query_id, cx.id as context_id, {_DOT('q.qv', 'cx.v')} as coarse, row_number() over (partition by q.query_id order by round({_DOT('q.qv', 'cx.v')}, 12) desc, cx.id) as r
        from q cross join cx where q.query_id in (select query_id from qf)) where r <= {k})"""  # noqa: E731
_MATCH = f"""pr as (select qf.query_id, co.context_id, qf.domain, qf.query_facet_id, eff.facet_id, {_DOT('qf.qc', 'eff.c')} as content,
        {V.ALPHA}::double * {_DOT('qf.qn', 'eff.n')} + {1 - V.ALPHA}::double * {_DOT('qf.qc', 'eff.c')} as pair
        from co join qf on qf.query_id = co.query_id join eff on eff.context_id = co.context_id and eff.domain = qf.domain),
    ma as (select * from (select *, row_number() over (partition by query_id, context_id, query_facet_id order by pair desc, content desc, facet_id) as r from pr) where r = 1)"""
_SCORE = f"""dom as (select query_id, context_id, domain, avg(pair) as score from ma group by 1, 2, 3),
    kn as (select query_id, context_id, sum({_WEIGHT}) as kw, sum({_WEIGHT} * score) as ws from dom group by 1, 2),
    tot as (select query_id, sum({_WEIGHT}) as tw from (select distinct query_id, domain from qf) group by 1),
    sc as (select co.query_id, co.context_id, co.coarse, coalesce(ws / nullif(kw, 0), 0.0::double) as semantic, coalesce(coalesce(kw, 0.0) / nullif(tw, 0), 0.0::double) as coverage
        from co left join kn using (query_id, context_id) left join tot using (query_id)),
    so as (select *, semantic * (1 - {V.MISSING}::double * (1 - coverage)) as overall from sc),
    re as (select * from (select *, row_number() over (partition by query_id order by round(overall, 12) desc, round(semantic, 12) desc, coarse desc, context_id) as rank from so) where rank <= {V.RERANKED})"""
_CAN = lambda s: f"{sql_case(sql_key(s + '.concept'), V.CONCEPTS)}"
_DIR = lambda s: f"{sql_case(sql_key(s + '.state'), V.DIRECTIONS)}"
_SID = lambda c, s: f"'state::' || {sql_slug(c)} || '::' || {sql_slug(s)}"
_CLAIMS = f"""cl0 as (select id, paper_id, scope_type, scope_id, conditioning_facet_ids, {_USABLE('claim_embedding')} as cv, {_CAN('from_')} as fc, {_DIR('from_')} as fd, {_CAN('to_')} as tc, {_DIR('to_')} as td
        from {sql_rec('claims', 'paper_id', 'scope_type', 'scope_id', 'from_', 'to_', 'conditioning_facet_ids', 'claim_embedding')}),
    cl as (select c.*, {_SID('fc', 'fd')} as fs, {_SID('tc', 'td')} as ts, case when scope_type = 'context' then scope_id else t.from_context_id end as sx
        from cl0 c left join {sql_rec('transitions', 'from_context_id')} t on t.id = c.scope_id)"""
_SEEDS = f"""fi as (select * from (select *, row_number() over (partition by sx order by id) as k from cl where sx is not null) where k = 1),
    qs as (select q.query_id, fi.fc, fi.fd, fi.tc, fi.td, fi.cv, q.hv, m, ['forward', 'backward', 'a_to_b', 'global'][m + 1] as mode from q join (select *, cast(regexp_extract(id, '([0-9]+)$', 1) as int) % 4 as m from fi) fi on fi.sx = q.query_id),
    st as (select id, min(concept) as concept, min(state) as state from (select fs as id, fc as concept, fd as state from cl union all select ts, tc, td from cl) group by 1),
    en as (select query_id, 'source' as side, fc as concept, fd as state from qs where m in (0, 2) union all select query_id, 'target', tc, td from qs where m in (1, 2)),
    se as (select en.query_id, en.side, st.id as state_id from en join st on st.concept = en.concept and (en.state = '' or en.state = st.state))"""
_ALT_KEYS = f"""k as (select id, paper_id, {sql_key('from_.concept')} as f, {sql_key('to_.concept')} as t, {sql_key('to_.state')} as s, {_DIR('to_')} as dr from {sql_rec('claims', 'paper_id', 'from_', 'to_')}),
    p as (select *, case dr when 'increase' then 1 when 'decrease' then -1 when 'no_detectable_change' then 0 end as pol from k)"""

_ASKING = f"""q0 as (select id as query_id, * exclude (id) from {sql_rec('contexts', 'paper_id', 'label', 'aliases', 'evidence_block_ids')} where {ASKED.format('id')}),
        ab as (select *, {sql_key("array_to_string(section_path, ' ')")} as s from {sql_rec('source_blocks', 'paper_id', 'order_', 'block_type', 'text', 'section_path')} where paper_id in (select paper_id from q0)),
        nb as (select * from ab where block_type <> 'reference')"""
_LEXICAL = f"""bw as (select *, {_WORDS('text')} as w from nb),
        st as (select paper_id, count(*) as n, greatest(avg(len(w)), 1.0) as av from bw group by 1),
        tf as (select paper_id, id, len(w) as l, t, count(*) as tf from (select paper_id, id, w, unnest(w) as t from bw) group by 1, 2, 3, 4),
        df as (select paper_id, t, count(*) as df from tf group by 1, 2),
        qt as (select query_id, paper_id, t, count(*) as m from (select query_id, paper_id, unnest({_WORDS('label')}) as t from q0 where label is not null) group by 1, 2, 3),
        sc0 as (select query_id, id, sum(m * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * {V.BM25_K1 + 1}::double / (tf + {V.BM25_K1}::double * ({1 - V.BM25_B}::double + {V.BM25_B}::double * l / av))) as s
              from tf join qt using (paper_id, t) join df using (paper_id, t) join st using (paper_id) group by 1, 2),
        lex as (select * from (select q0.query_id, nb.id as block_id, coalesce(sc0.s, 0.0::double) as score,
            cast(row_number() over (partition by q0.query_id order by coalesce(sc0.s, 0.0::double) desc, nb.order_, nb.id) as int) as rank
            from q0 join nb using (paper_id) left join sc0 on sc0.id = nb.id and sc0.query_id = q0.query_id where q0.label is not null) where rank <= 10)"""
_SEMANTIC = f"""bv as (select id, paper_id, order_, {_HASH('text')} as v from nb), qv as (select query_id, paper_id, {_HASH('label')} as v from q0),
        sem as (select * from (select query_id, bv.id as block_id, round(list_dot_product(bv.v, qv.v), 12) as score,
            cast(row_number() over (partition by query_id order by round(list_dot_product(bv.v, qv.v), 12) desc, order_, bv.id) as int) as rank from qv join bv using (paper_id) where qv.v is not null and bv.v is not null) where rank <= 10)"""

SQL = {
    "cosine_topk": """with e as (select vec_id, embedding::double[] as v from embeddings)
        select query_id, vec_id, rank, round(score, 6) as score from (select q.vec_id as query_id, e.vec_id, greatest(0.0::double, list_dot_product(q.v, e.v)) as score,
            cast(row_number() over (partition by q.vec_id order by round(greatest(0.0::double, list_dot_product(q.v, e.v)), 12) desc, e.vec_id) as int) as rank
            from e q cross join e where q.vec_id % 50 = 0) where rank <= 10""",
    "bm25_topk": f"""with {_ASKING}, {_LEXICAL} select query_id, block_id, rank, round(score, 6) as score from lex""",
    "semantic_topk": f"""with {_ASKING}, {_SEMANTIC} select query_id, block_id, rank, round(score, 6) as score from sem""",
    "bundle_candidates": f"""with {_ASKING}, {_LEXICAL}, {_SEMANTIC},
        must as (select distinct query_id, unnest(evidence_block_ids) as block_id from q0),
        al as (select distinct query_id, paper_id, {sql_key('x')} as a from (select query_id, paper_id, unnest(aliases) as x from q0)),
        tk as (select id, paper_id, {sql_key('text')} as t from ab),
        named as (select distinct query_id, tk.id as block_id from al join tk using (paper_id) where a <> '' and contains(t, a)),
        direct as (select query_id, block_id from must union select query_id, block_id from named union select query_id, block_id from lex union select query_id, block_id from sem),
        around as (select distinct d.query_id, x.paper_id, x.order_ + k as order_ from direct d join ab x on x.id = d.block_id, (select unnest([-1, 0, 1]) as k)),
        c as (select r.query_id, b.id as block_id, b.order_, b.text, b.s, (r.query_id, b.id) in (select (query_id, block_id) from must) as must, (r.query_id, b.id) in (select (query_id, block_id) from named) as named,
            (r.query_id, b.id) in (select (query_id, block_id) from direct) as hit, coalesce(1.0::double / sem.rank, 0) as sr, coalesce(1.0::double / lex.rank, 0) as lr
            from around r join nb b on b.paper_id = r.paper_id and b.order_ = r.order_ left join sem on sem.query_id = r.query_id and sem.block_id = b.id left join lex on lex.query_id = r.query_id and lex.block_id = b.id)
        select query_id, block_id, must, named, hit, cast(row_number() over (partition by query_id order by must desc, named desc,
            case when s like '%methods%' or s like '%study area%' or s like '%experimental design%' then 3 when s like '%results%' then 2 when s like '%discussion%' then 1 else 0 end desc, sr desc, lr desc, hit desc, order_, block_id) as int) as pos,
            greatest(1, ceil(length(text) * 2 / 7.0::double))::int as size from c""",
    "alias_hits": f"""with a as (select id as context_id, paper_id, unnest(list_concat([label], coalesce(aliases, []))) as x from {sql_rec('contexts', 'paper_id', 'label', 'aliases')}),
        k as (select context_id, paper_id, {sql_key('x')} as key from a),
        b as (select id as block_id, paper_id, {sql_key('text')} as t from {sql_rec('source_blocks', 'paper_id', 'text')})
        select distinct context_id, block_id from k join b using (paper_id) where key <> '' and contains(t, key)""",
    "evidence_blocks_scored": f"""with c as (select id as claim_id, {_HASH('description')} as cv, {_HASH('to_.concept')} as qv, unnest(list_distinct(evidence_block_ids)) as block_id from {sql_rec('claims', 'evidence_block_ids', 'description', 'to_')}),
        b as (select id as block_id, order_, {sql_key("array_to_string(section_path, ' ')")} as s, {_HASH('text')} as v from {sql_rec('source_blocks', 'order_', 'section_path', 'text')}),
        x as (select *, bool_and(cv is not null and qv is not null and v is not null) over (partition by claim_id) as whole from c join b using (block_id)),
        y as (select *, case when whole then round(0.7::double * {_DOT('cv', 'v')} + 0.3::double * {_DOT('qv', 'v')} + case when s like '%results%' or s like '%analysis%' then 0.05::double when s like '%discussion%' then 0.02::double else 0.0::double end, 12) else {_PRIORITY}::double end as value from x)
        select claim_id, block_id, k::int as k from (select *, row_number() over (partition by claim_id order by value desc, order_, block_id) as k from y) where k <= {V.BLOCKS_A_CLAIM}""",
    "facet_blocks": f"""with f as (select id as facet_id, {_HASH('notion')} as qv, unnest(list_distinct(evidence_block_ids)) as block_id from {sql_rec('facets', 'notion', 'evidence_block_ids')}),
        b as (select id as block_id, order_, {_HASH('text')} as v from {sql_rec('source_blocks', 'order_', 'text')})
        select facet_id, block_id from (select facet_id, block_id, row_number() over (partition by facet_id order by round({_DOT('qv', 'v')}, 12) desc, order_, block_id) as r from f join b using (block_id)) where r = 1""",
    "neighbour_blocks": f"""with b as (select * from {sql_rec('source_blocks', 'paper_id', 'order_')}),
        t as (select id as transition_id, paper_id, unnest(evidence_block_ids) as bid from {sql_rec('transitions', 'paper_id', 'evidence_block_ids')}),
        o as (select transition_id, t.paper_id, b.order_ as at from t join b on b.id = t.bid)
        select distinct transition_id, b.id as block_id from o join b on b.paper_id = o.paper_id and b.order_ between o.at - 1 and o.at + 1""",
    "context_retrieval": f"""with {_BASE}, {_TOP(V.COARSE)}, {_MATCH}, {_SCORE}
        select query_id, context_id, rank::int as rank, round(coarse, 6) as coarse, round(semantic, 6) as semantic, round(coverage, 6) as coverage, round(overall, 6) as overall from re""",
    "maxsim_matches": f"with {_BASE}, {_TOP(10)}, {_MATCH} select query_id, context_id, domain, query_facet_id, facet_id, round(pair, 6) as pair from ma",
    "coherence_pairs": f"""with {_BASE}, x as (select a.query_id as l, b.id as r from q a join cx c on c.id = a.query_id join cx b on b.paper_id = c.paper_id and b.id <> a.query_id),
        bo as (select l as query_id, r as context_id from x union select r, l from x),
        pr as (select t.query_id, t.context_id, a.domain, a.facet_id as query_facet_id, b.facet_id, {_DOT('a.c', 'b.c')} as content, {V.ALPHA}::double * {_DOT('a.n', 'b.n')} + {1 - V.ALPHA}::double * {_DOT('a.c', 'b.c')} as pair
            from bo t join eff a on a.context_id = t.query_id join eff b on b.context_id = t.context_id and b.domain = a.domain),
        dom as (select query_id, context_id, domain, avg(p) as score from (select query_id, context_id, domain, query_facet_id, max(pair) as p from pr group by all) group by 1, 2, 3),
        kn as (select query_id, context_id, sum({_WEIGHT}) as kw, sum({_WEIGHT} * score) as ws from dom group by 1, 2),
        tot as (select context_id as query_id, sum({_WEIGHT}) as tw from (select distinct context_id, domain from eff) group by 1),
        s as (select bo.query_id, bo.context_id, coalesce(ws / nullif(kw, 0), 0.0::double) * (1 - {V.MISSING}::double * (1 - coalesce(coalesce(kw, 0.0) / nullif(tw, 0), 0.0::double))) as o
            from bo left join kn using (query_id, context_id) left join tot using (query_id)),
        has as (select distinct context_id from eff)
        select x.l as "left", x.r as "right", round(case when x.l in (select context_id from has) and x.r in (select context_id from has) then 0.5::double * (f.o + b.o) end, 6) as coherence
        from x join s f on f.query_id = x.l and f.context_id = x.r join s b on b.query_id = x.r and b.context_id = x.l""",
    "state_mapping": f"""with {_BASE}, {_CLAIMS}, {_SEEDS} select query_id, side, state_id, 1.0::double as score from se""",
    "claim_rank": f"""with {_BASE}, {_TOP(V.COARSE)}, {_MATCH}, {_SCORE}, {_CLAIMS}, {_SEEDS},
        nr as (select * from (select qs.query_id, cl.id as claim_id, {_DOT('qs.cv', 'cl.cv')} as s, row_number() over (partition by qs.query_id order by round({_DOT('qs.cv', 'cl.cv')}, 12) desc, cl.id) as r from qs cross join cl) where r <= {V.CLAIMS_ANN}),
        tv as (select id, {_HASH('description')} as v from {sql_rec('transitions', 'description')}),
        mv as (select * from (select qs.query_id, tv.id as tid, {_DOT('qs.hv', 'tv.v')} as s, row_number() over (partition by qs.query_id order by round({_DOT('qs.hv', 'tv.v')}, 12) desc, tv.id) as r from qs cross join tv where qs.hv is not null) where r <= {V.TRANSITIONS_ANN}),
        ch0 as (select mv.query_id, cl.id as claim_id, 'transition_ann' as c from mv join cl on cl.scope_type = 'transition' and cl.scope_id = mv.tid union select re.query_id, cl.id, 'context_scope' from re join cl on cl.sx = re.context_id union select query_id, claim_id, 'claim_ann' from nr
            union select se.query_id, cl.id, 'source_endpoint' from se join cl on se.side = 'source' and cl.fs = se.state_id union select se.query_id, cl.id, 'target_endpoint' from se join cl on se.side = 'target' and cl.ts = se.state_id),
        ch as (select query_id, claim_id, string_agg(c, ',' order by c) as channels from ch0 where query_id in (select query_id from qs) group by 1, 2),
        cf as (select ch.query_id, ch.claim_id, u.i, u.f from ch join (select id, unnest(conditioning_facet_ids) as f, generate_subscripts(conditioning_facet_ids, 1) as i from cl) u on u.id = ch.claim_id),
        cp as (select cf.query_id, cf.claim_id, cf.i, max({V.ALPHA}::double * {_DOT('qf.qn', 'fa.n')} + {1 - V.ALPHA}::double * {_DOT('qf.qc', 'fa.c')}) as pair from cf join fa on fa.id = cf.f join qf on qf.query_id = cf.query_id and qf.domain = fa.domain group by 1, 2, 3),
        cd as (select query_id, claim_id, avg(pair) as cond from cp group by 1, 2),
        x as (select ch.query_id, ch.claim_id, ch.channels, qs.mode, {_DOT('qs.cv', 'cl.cv')} as mech, coalesce(re.coverage, 0.0::double) as coverage, mv.s as iv,
            case when re.overall is not null then coalesce({1 - V.BETA}::double * re.overall + {V.BETA}::double * cd.cond, re.overall) end as app,
            case when exists (select 1 from se where se.query_id = ch.query_id and side = 'source' and state_id = cl.fs) then 1.0::double else 0.0::double end as ss,
            case when exists (select 1 from se where se.query_id = ch.query_id and side = 'target' and state_id = cl.ts) then 1.0::double else 0.0::double end as ts,
            (select count(distinct side) from se where se.query_id = ch.query_id) as sides
            from ch join qs using (query_id) join cl on cl.id = ch.claim_id left join re on re.query_id = ch.query_id and re.context_id = cl.sx left join cd on cd.query_id = ch.query_id and cd.claim_id = ch.claim_id left join mv on mv.query_id = ch.query_id and mv.tid = cl.scope_id and cl.scope_type = 'transition'),
        y as (select *, case mode when 'forward' then ss when 'backward' then ts when 'a_to_b' then (ss + ts) / 2 else (ss + ts) / nullif(sides, 0) end as ep from x),
        z as (select *, (coalesce({V.WEIGHTS['context']}::double * app, 0) + {V.WEIGHTS['mechanism']}::double * mech + coalesce({V.WEIGHTS['intervention']}::double * iv, 0) + coalesce({V.WEIGHTS['endpoint']}::double * ep, 0))
            / (case when app is not null then {V.WEIGHTS['context']}::double else 0 end + {V.WEIGHTS['mechanism']}::double + case when iv is not null then {V.WEIGHTS['intervention']}::double else 0 end + case when ep is not null then {V.WEIGHTS['endpoint']}::double else 0 end) as score from y)
        select query_id, claim_id, rank, round(score, 6) as score, round(app, 6) as applicability, round(iv, 6) as intervention, channels from (select *, cast(row_number() over (partition by query_id order by round(score, 12) desc, app is null, round(coverage, 12) desc,
            round(app, 12) desc nulls last, ep desc nulls last, claim_id) as int) as rank from z) where rank <= {V.RANKED}""",
    "alternatives": f"""with {_ALT_KEYS}, f as (select *, 1 as pos from p where {ASKED.format('id')}),
        x as (select f.id as query_id, f.id as focal_claim_id, f.pos, c.id as claim_id,
            case when f.pol * c.pol < 0 then 0 when f.pol * c.pol = 0 and f.pol <> c.pol then 1 when f.s = c.s then 2 else 3 end as cls from f join p c on c.f = f.f and c.t = f.t and c.id <> f.id),
        y as (select *, row_number() over (partition by query_id, focal_claim_id order by cls, claim_id) as k from x),
        z as (select *, row_number() over (partition by query_id, claim_id order by pos) as o from y where k <= {V.PER_FOCAL})
        select query_id, claim_id, focal_claim_id, ['opposite', 'null_alternative', 'supporting_alternative', 'alternative'][cls + 1] as classification from z where o = 1""",
    "evidence_blocks": f"""with c as (select id as claim_id, unnest(list_distinct(evidence_block_ids)) as block_id from {sql_rec('claims', 'evidence_block_ids')}),
        b as (select id as block_id, order_, {sql_key("array_to_string(section_path, ' ')")} as s from {sql_rec('source_blocks', 'order_', 'section_path')})
        select claim_id, block_id, k::int as k from (select claim_id, block_id, row_number() over (partition by claim_id order by {_PRIORITY} desc, order_, block_id) as k from c join b using (block_id)) where k <= {V.BLOCKS_A_CLAIM}""",
    "citations": f"""with c as (select * from {sql_rec('claims', 'paper_id', 'evidence_block_ids')}), p as (select id as paper_id, title, year, doi from {sql_rec('papers', 'title', 'year', 'doi')}),
        e as (select id as claim_id, unnest(evidence_block_ids) as block_id from c), b as (select id as block_id, page from {sql_rec('source_blocks', 'page')}),
        g as (select claim_id, list_sort(list(distinct page)) as pages from e join b using (block_id) where page is not null and page <> 0 group by 1)
        select c.id as claim_id, paper_id, doi, coalesce(len(pages), 0)::int as n_pages,
            coalesce(title, '') || ' (' || coalesce(nullif(year, 0)::varchar, 'n.d.') || '), pp. ' || coalesce(array_to_string(pages, ','), '') || ', Claim ' || c.id as citation
        from c join p using (paper_id) left join g on g.claim_id = c.id""",
    "grounding_filter": f"""with c as (select * from {sql_rec('claims', 'paper_id', 'relation', 'conditioning_facet_ids')}), f as (select id, substr(context_id, 1, 8) as p from {sql_rec('facets', 'context_id')}),
        bad as (select distinct x.id from (select id, paper_id, conditioning_facet_ids, unnest(conditioning_facet_ids) as r from c) x where not exists (select 1 from f where f.id = x.r and f.p = x.paper_id))
        select paper_id as query_id, c.id as item, case when relation = 'causal' then 'mechanism' else 'limitation' end as kind,
            case when conditioning_facet_ids is null then null else c.id not in (select id from bad) end as grounded from c""",
}
