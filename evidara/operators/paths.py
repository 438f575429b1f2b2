"""Beam search for chains of claims, one level of joins per step for all questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions import vocabulary as V
from evidara.session import cut

COLUMNS = ["query_id", "claims", "states", "applicability", "coherence", "mean_score", "score", "length"]


def _scored(df: DataFrame) -> DataFrame:
    """Path score: weakest applicability, weakest coherence, mean claim score and a factor for length; unknown counts as 1."""
    factor = 1 / (1 + V.LENGTH_PENALTY * (F.col("length") - 1))
    out = df.withColumn("mean_score", F.col("total") / F.col("length"))
    return out.withColumn("score", F.coalesce("applicability", F.lit(1.0)) * F.coalesce("coherence", F.lit(1.0)) * F.col("mean_score") * factor)


def search(queries: DataFrame, ranked: DataFrame, seeds: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, claims, states, applicability, coherence, mean_score, score, length): the best paths.

    ``queries``: query_id, mode; ``ranked``: query_id, claim_id, rank, score, applicability,
    from_state, to_state; ``seeds``: query_id, side, state_id; ``coherence``: left, right,
    coherence of claims that may stand next to each other. A path visits no claim and no
    state twice. Completed paths are kept before the beam is cut. Questions in global mode,
    or without a start, get their best claims as paths of one step.
    """
    q = queries.select("query_id", "mode")
    side = F.when(F.col("mode").isin("forward", "a_to_b"), "source").otherwise("target")
    starts = q.where("mode <> 'global'").withColumn("side", side).join(seeds.select("query_id", "side", "state_id").distinct(), ["query_id", "side"])
    walking = starts.select("query_id").distinct()
    edges = ranked.join(q, "query_id").join(walking, "query_id", "left_semi")
    back = F.col("mode") == "backward"
    edges = cut(
        edges.select(
            "query_id", "claim_id", F.when(back, F.col("to_state")).otherwise(F.col("from_state")).alias("at"), F.when(back, F.col("from_state")).otherwise(F.col("to_state")).alias("next"),
            F.col("score").alias("r"), F.col("applicability").alias("a"),
        ), "steps",
    )
    beam = starts.select(
        "query_id", F.col("state_id").alias("at"), F.array("state_id").alias("states"), F.array().cast("array<string>").alias("claims"), F.lit(None).cast("double").alias("applicability"),
        F.lit(None).cast("double").alias("coherence"), F.lit(0.0).alias("total"),
    )
    goals = seeds.where("side = 'target'").select("query_id", F.col("state_id").alias("at"), F.lit(True).alias("goal")).distinct()
    done = []
    for depth in range(1, V.MAX_LENGTH + 1):
        x = beam.join(edges, ["query_id", "at"]).where(~F.array_contains("claims", F.col("claim_id")) & ~F.array_contains("states", F.col("next")))
        if coherence is not None and depth > 1:
            # a pair is asked for in the order of the path
            pair = coherence.select(F.col("left").alias("last"), F.col("right").alias("claim_id"), F.col("coherence").alias("c"))
            x = x.withColumn("last", F.element_at("claims", -1)).join(pair, ["last", "claim_id"], "left").drop("last")
        else:
            x = x.withColumn("c", F.lit(None).cast("double"))
        x = x.select(
            "query_id", F.col("next").alias("at"), F.array_append("states", F.col("next")).alias("states"), F.array_append("claims", F.col("claim_id")).alias("claims"),
            F.least("applicability", "a").alias("applicability"), F.least("coherence", "c").alias("coherence"), (F.col("total") + F.col("r")).alias("total"), F.lit(depth).alias("length"),
        )
        if depth == 1:
            x = x.withColumn("single", F.lit(1.0))
        x = cut(_scored(x.drop("single")), "beam")
        done.append(x.join(goals, ["query_id", "at"], "left").join(q, "query_id").where("mode <> 'a_to_b' or goal").select(*COLUMNS))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "length", "claims")
        beam = x.withColumn("k", F.row_number().over(order)).where(F.col("k") <= V.BEAM).select("query_id", "at", "states", "claims", "applicability", "coherence", "total")
        if x.isEmpty():
            break
    flat = ranked.join(walking, "query_id", "left_anti").where(F.col("rank") <= V.MAX_PATHS)
    flat = flat.select("query_id", F.array("claim_id").alias("claims"), F.array("from_state", "to_state").alias("states"), "applicability", F.lit(None).cast("double").alias("coherence"), F.col("score").alias("total"), F.lit(1).alias("length"), F.col("rank").alias("given"))
    flat = _scored(flat).select(*COLUMNS, "given")
    found = reduce(DataFrame.unionByName, done).withColumn("given", F.lit(None).cast("int")).unionByName(flat)
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_first("given"), F.desc("score"), "length", "claims")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= V.MAX_PATHS).select("query_id", "rank", *COLUMNS[1:])


def adjacent(ranked: DataFrame) -> DataFrame:
    """(left, right): claims of one question that may follow each other in either direction of travel."""
    a = ranked.select("query_id", F.col("claim_id").alias("left"), F.col("to_state").alias("s"))
    b = ranked.select("query_id", F.col("claim_id").alias("right"), F.col("from_state").alias("s"))
    one = a.join(b, ["query_id", "s"]).where("left <> right").select("left", "right")
    return one.unionByName(one.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
