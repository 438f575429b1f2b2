"""State mapping, claim channels and null-aware claim ranking for batches of questions.

Null means unknown: an unknown component drops out of the weighted mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vector as N
from evidara.functions import vocabulary as V
from evidara.operators.retrieval import exact_topk


def canonical_claims(claims: DataFrame) -> DataFrame:
    """Claims with canonical concepts and directions of both ends and the ids of their states."""
    out = claims
    for side, end in (("from", "from_"), ("to", "to_")):
        out = out.withColumn(f"{side}_concept", X.canonical_concept(X.text_key(F.col(f"{end}.concept"))))
        out = out.withColumn(f"{side}_direction", X.canonical_direction(X.text_key(F.col(f"{end}.state"))))
        out = out.withColumn(f"{side}_state", X.state_id(F.col(f"{side}_concept"), F.col(f"{side}_direction")))
    return out


def states(canonical: DataFrame) -> DataFrame:
    """(id, concept, state), each once: the states that claims start from or lead to."""
    ends = [canonical.select(F.col(f"{s}_state").alias("id"), F.col(f"{s}_concept").alias("concept"), F.col(f"{s}_direction").alias("state")) for s in ("from", "to")]
    return ends[0].unionByName(ends[1]).groupBy("id").agg(F.min("concept").alias("concept"), F.min("state").alias("state"))


def map_endpoints(asked: DataFrame, state_table: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, side, state_id, score, ambiguous) of the questions' endpoints.

    ``asked``: query_id, side, concept, state (canonical), and qv where ``vectors`` (id, v)
    is given. Every compatible state of the same concept scores 1; only without one do the
    nearest compatible vectors count, and a narrow lead of the first is marked.
    """
    exact = asked.join(state_table.select("id", "concept", F.col("state").alias("have")), "concept").where(X.compatible(F.col("state"), F.col("have")))
    exact = exact.select("query_id", "side", F.col("id").alias("state_id"), F.lit(1.0).alias("score"), F.lit(False).alias("ambiguous"))
    if vectors is None:
        return exact
    rest = asked.join(exact.select("query_id", "side").distinct(), ["query_id", "side"], "left_anti").where("qv is not null")
    keyed = rest.withColumn("k", F.concat_ws("\u0001", "query_id", "side"))
    pool = exact_topk(keyed.select(F.col("k").alias("query_id"), "qv"), vectors, max(10 * V.SEEDS, 50)).select(F.col("query_id").alias("k"), "id", "score")
    near = pool.join(keyed.select("k", "query_id", "side", "state"), "k").join(state_table.select("id", F.col("state").alias("have")), "id").where(X.compatible(F.col("state"), F.col("have")))
    order = W.partitionBy("query_id", "side").orderBy(F.desc("score"), "id")
    near = near.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    first = F.max(F.when(F.col("r") == 1, F.col("score") - F.col("next") < V.MARGIN)).over(W.partitionBy("query_id", "side"))
    near = near.withColumn("ambiguous", F.coalesce(first, F.lit(False))).where(F.col("r") <= V.SEEDS)
    return exact.unionByName(near.select("query_id", "side", F.col("id").alias("state_id"), "score", "ambiguous"))


def scoped(claims: DataFrame, transitions: DataFrame) -> DataFrame:
    """Claims with the context they hold in: their own, or the one their transition starts from."""
    t = transitions.select(F.col("id").alias("scope_id"), F.col("from_context_id").alias("start"))
    return claims.join(t, "scope_id", "left").withColumn("scope_context_id", F.when(F.col("scope_type") == "context", F.col("scope_id")).otherwise(F.col("start"))).drop("start")


def channels(claims: DataFrame, retained: DataFrame, seeds: DataFrame, near: DataFrame, transition_near: DataFrame | None = None) -> DataFrame:
    """(query_id, claim_id, channels): how each claim became a candidate.

    ``claims``: id, scope_type, scope_id, scope_context_id, from_state, to_state; ``retained``:
    query_id, context_id; ``seeds``: query_id, side, state_id; ``near``: query_id, claim_id.
    """
    parts = [
        claims.join(retained.select("query_id", F.col("context_id").alias("scope_context_id")), "scope_context_id").select("query_id", F.col("id").alias("claim_id"), F.lit("context_scope").alias("channel")),
        near.select("query_id", "claim_id", F.lit("claim_ann").alias("channel")),
    ]
    for side, end in (("source", "from_state"), ("target", "to_state")):
        s = seeds.where(F.col("side") == side).select("query_id", F.col("state_id").alias(end))
        parts.append(claims.join(s, end).select("query_id", F.col("id").alias("claim_id"), F.lit(f"{side}_endpoint").alias("channel")))
    if transition_near is not None:
        t = transition_near.select("query_id", F.col("transition_id").alias("scope_id"))
        parts.append(claims.where("scope_type = 'transition'").join(t, "scope_id").select("query_id", F.col("id").alias("claim_id"), F.lit("transition_ann").alias("channel")))
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "claim_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def conditioning(candidates: DataFrame, facets: DataFrame, query_facets: DataFrame) -> DataFrame:
    """(query_id, claim_id, conditioning, known): mean of the best matches of a claim's conditioning facets.

    ``candidates``: query_id, claim_id, conditioning_facet_ids; facets of domains that the
    question does not speak of are unknown, not 0. Ties go to the greater query facet id.
    """
    own = candidates.select("query_id", "claim_id", F.posexplode("conditioning_facet_ids").alias("pos", "facet_id"), F.size("conditioning_facet_ids").alias("k"))
    pair = own.join(facets.select("facet_id", "domain", "cn", "cc"), "facet_id").join(query_facets, ["query_id", "domain"])
    pair = pair.withColumn("content", N.closeness(F.col("qc"), F.col("cc"))).withColumn("pair", V.ALPHA * N.closeness(F.col("qn"), F.col("cn")) + (1 - V.ALPHA) * F.col("content"))
    best = pair.groupBy("query_id", "claim_id", "pos", "k").agg(F.max(F.struct("pair", "content", "query_facet_id")).alias("b"))
    return best.groupBy("query_id", "claim_id").agg(F.avg("b.pair").alias("conditioning"), (F.count("*") / F.first("k")).alias("known"))


def rank_claims(queries: DataFrame, claims: DataFrame, retained: DataFrame, seeds: DataFrame, facets: DataFrame, query_facets: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """Ranked claims of each question, at most RANKED of them.

    ``queries``: query_id, mode, claim_vector and, where a change is asked about,
    intervention_vector; ``transitions``: id, v. Columns: query_id, claim_id, rank, score,
    applicability, mechanism, intervention, endpoint, coverage, channels, scope_context_id.
    """
    near = exact_topk(queries.select("query_id", F.col("claim_vector").alias("qv")), claims.select("id", F.col("claim_embedding").alias("v")), V.CLAIMS_ANN)
    near = near.select("query_id", F.col("id").alias("claim_id"), F.col("score").alias("near"))
    moved = None
    if transitions is not None:
        asked = queries.where("intervention_vector is not null").select("query_id", F.col("intervention_vector").alias("qv"))
        moved = exact_topk(asked, transitions, V.TRANSITIONS_ANN).select("query_id", F.col("id").alias("transition_id"), F.col("score").alias("intervention"))
    cand = channels(claims, retained, seeds, near, moved)
    c = cand.join(claims.select(F.col("id").alias("claim_id"), "scope_type", "scope_id", "scope_context_id", "from_state", "to_state", "conditioning_facet_ids", "claim_embedding"), "claim_id")
    c = c.join(queries.select("query_id", "mode", "claim_vector"), "query_id").join(near, ["query_id", "claim_id"], "left")
    c = c.withColumn("mechanism", F.coalesce("near", N.closeness(N.doubles(F.col("claim_vector")), N.doubles(F.col("claim_embedding")))))
    c = c.join(retained.select("query_id", F.col("context_id").alias("scope_context_id"), "overall", F.col("coverage").alias("c")), ["query_id", "scope_context_id"], "left").withColumn("coverage", F.coalesce("c", F.lit(0.0)))
    c = c.join(conditioning(c.select("query_id", "claim_id", "conditioning_facet_ids"), facets, query_facets), ["query_id", "claim_id"], "left")
    mixed = (1 - V.BETA) * F.col("overall") + V.BETA * F.col("conditioning")
    # means may differ in their last bits with the order of rows; ties must not
    c = c.withColumn("applicability", F.round(F.when(F.col("overall").isNotNull(), F.coalesce(mixed, F.col("overall"))), 12))
    for side, end in (("source", "from_state"), ("target", "to_state")):
        s = seeds.where(F.col("side") == side).groupBy("query_id", F.col("state_id").alias(end)).agg(F.max("score").alias(f"{side}_score"))
        c = c.join(s, ["query_id", end], "left").fillna({f"{side}_score": 0.0})
    sides = seeds.groupBy("query_id").agg(F.count_distinct("side").alias("sides"))
    c = c.join(sides, "query_id", "left")
    both = F.col("source_score") + F.col("target_score")
    endpoint = F.when(F.col("mode") == "forward", F.col("source_score")).when(F.col("mode") == "backward", F.col("target_score")).when(F.col("mode") == "a_to_b", both / 2)
    c = c.withColumn("endpoint", F.coalesce(endpoint, both / F.col("sides")))
    if moved is not None:
        c = c.join(moved.withColumnRenamed("transition_id", "scope_id"), ["query_id", "scope_id"], "left").withColumn("intervention", F.when(F.col("scope_type") == "transition", F.col("intervention")))
    else:
        c = c.withColumn("intervention", F.lit(None).cast("double"))
    names = {"context": "applicability", "mechanism": "mechanism", "intervention": "intervention", "endpoint": "endpoint"}
    top = reduce(lambda a, b: a + b, [F.coalesce(V.WEIGHTS[n] * F.col(x), F.lit(0.0)) for n, x in names.items()])
    weight = reduce(lambda a, b: a + b, [F.when(F.col(x).isNotNull(), V.WEIGHTS[n]).otherwise(0.0) for n, x in names.items()])
    c = c.withColumn("score", F.round(top / weight, 12))
    order = W.partitionBy("query_id").orderBy(
        F.desc("score"), F.col("applicability").isNull(), F.desc("coverage"), F.desc_nulls_last("applicability"), F.desc_nulls_last("endpoint"), "claim_id"
    )
    cols = ["query_id", "claim_id", "rank", "score", "applicability", "mechanism", "intervention", "endpoint", "coverage", "channels", "scope_context_id"]
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= V.RANKED).select(*cols)
