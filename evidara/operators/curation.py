"""Exact deduplication, candidate pairs, merging, redirects, reversals and re-canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vector as N
from evidara.functions import vocabulary as V


def _union_in_order(col: str, pos: str = "pos") -> Column:
    """Distinct elements of the group's lists, in order of the rows and of their places."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(F.col(col), F.array().cast("array<string>")).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"])))


def exact_dedup(df: DataFrame, keys: dict[str, Column], unions: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """One row for each key: the first by ``pos``, with the lists of all; n_merged tells how many it stands for."""
    x = df
    for name, c in keys.items():
        x = x.withColumn(name, c)
    return x.groupBy(*keys).agg(F.min_by("id", pos).alias("id"), F.min(pos).alias("pos"), *[_union_in_order(u, pos).alias(u) for u in unions], F.count("*").alias("n_merged"))


def claim_keys() -> dict[str, Column]:
    k = lambda c: X.text_key(F.col(c))
    return {
        "k_scope": F.col("scope_id"), "k_from": k("from_.concept"), "k_from_state": k("from_.state"), "k_relation": F.col("relation"),
        "k_to": k("to_.concept"), "k_to_state": k("to_.state"), "k_text": k("description"),
    }


def facet_keys() -> dict[str, Column]:
    k = lambda c: X.text_key(F.col(c))
    return {"k_context": F.col("context_id"), "k_domain": k("domain"), "k_notion": k("notion"), "k_text": k("description")}


def mention_inventory(mentions: DataFrame) -> DataFrame:
    """(group, mention_id, name, block_ids, n): settings by normalised name, numbered by first mention."""
    x = mentions.withColumn("key", X.text_key(F.col("name"))).where("key <> ''")
    g = x.groupBy("group", "key").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("first"), _union_in_order("block_ids").alias("block_ids"), F.count("*").alias("n"))
    number = F.row_number().over(W.partitionBy("group").orderBy("first"))
    return g.withColumn("mention_id", F.format_string("CM%03d", number)).select("group", "mention_id", "name", "block_ids", "n")


def context_pairs(contexts: DataFrame) -> DataFrame:
    """(left_id, right_id, reason): contexts of a paper that share a name, or label and spatial support.

    Blocked by name: only contexts that agree on one meet.
    """
    names = F.array_distinct(F.transform(F.filter(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: a.isNotNull() & (F.trim(a) != "")), lambda a: a))
    n = contexts.select("paper_id", "id", F.explode(names).alias("name")).withColumn("key", X.text_key(F.col("name"))).select("paper_id", "id", "key").distinct()
    pair = n.alias("a").join(n.alias("b"), ["paper_id", "key"]).where("a.id < b.id")
    return pair.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.lit("shared_alias").alias("reason")).distinct()


def facet_pairs(facets: DataFrame) -> DataFrame:
    """(left_id, right_id, notion_cosine, content_cosine): facets of one context and domain that may be the same."""
    f = facets.select("id", "context_id", "domain", X.text_key(F.col("notion")).alias("key"), N.doubles(F.col("notion_embedding")).alias("n"), N.doubles(F.col("content_embedding")).alias("c"))
    x = f.alias("a").join(f.alias("b"), ["context_id", "domain"]).where("a.id < b.id")
    x = x.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), (F.col("a.key") == F.col("b.key")).alias("same"), N.dot(F.col("a.n"), F.col("b.n")).alias("notion_cosine"), N.dot(F.col("a.c"), F.col("b.c")).alias("content_cosine"))
    return x.where(F.col("same") | (F.col("notion_cosine") >= V.NOTION_COSINE) | (F.col("content_cosine") >= V.CONTENT_COSINE)).drop("same")


def claim_pairs(canonical: DataFrame, vectors: DataFrame) -> DataFrame:
    """(left_id, right_id, from_cosine, to_cosine): claims of one scope, relation and directions with close concepts.

    ``vectors``: concept, v of the canonical concepts.
    """
    c = canonical.select("id", "scope_id", "relation", "from_direction", "to_direction", "from_concept", "to_concept")
    for s in ("from", "to"):
        c = c.join(vectors.select(F.col("concept").alias(f"{s}_concept"), F.col("v").alias(f"{s}_v")), f"{s}_concept", "left")
    x = c.alias("a").join(c.alias("b"), ["scope_id", "relation", "from_direction", "to_direction"]).where("a.id < b.id")
    x = x.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), N.dot(F.col("a.from_v"), F.col("b.from_v")).alias("from_cosine"), N.dot(F.col("a.to_v"), F.col("b.to_v")).alias("to_cosine"))
    return x.where((F.col("from_cosine") >= V.ENDPOINT_COSINE) & (F.col("to_cosine") >= V.ENDPOINT_COSINE))


def merge_groups(items: DataFrame, groups: DataFrame, contexts: bool = False) -> DataFrame:
    """(id, canonical_id, evidence_block_ids): each member with what it becomes.

    ``items``: id, pos, evidence_block_ids, description and, for contexts, spatial_key;
    ``groups``: id, group_id. Contexts keep the least id and stay apart where their spatial
    supports contradict; others keep the one with most evidence, then longest, then first.
    """
    x = items.join(groups, "id")
    w = W.partitionBy("group_id")
    order = ("id",) if contexts else (F.desc(F.size(F.array_distinct("evidence_block_ids"))), F.desc(F.length(F.coalesce("description", F.lit("")))), "pos")
    x = x.withColumn("canonical_id", F.first("id").over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    if contexts:
        x = x.withColumn("canonical_id", F.when(F.size(F.collect_set("spatial_key").over(w)) > 1, F.col("id")).otherwise(F.col("canonical_id")))
    merged = x.groupBy("canonical_id").agg(_union_in_order("evidence_block_ids").alias("evidence_block_ids"))
    return x.select("id", "canonical_id").join(merged, "canonical_id").select("id", "canonical_id", "evidence_block_ids")


def redirect(df: DataFrame, column: str, redirects: DataFrame, drop_self: str | None = None) -> DataFrame:
    """``column`` (an id or a list of ids) rewritten by ``redirects`` (id, canonical_id); lists stay in order and distinct.

    ``drop_self`` names the row's own id, which must not be among its parents.
    """
    to = redirects.select(F.col("id").alias("_from"), F.col("canonical_id").alias("_to"))
    if not dict(df.dtypes)[column].startswith("array"):
        return df.join(to, df[column] == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
    e = df.select("id", F.posexplode(column).alias("p", "_from")).join(to, "_from", "left").withColumn("v", F.coalesce("_to", "_from"))
    new = e.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda r: r["v"])).alias("_new"))
    out = df.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    return out.withColumn(column, F.array_remove(F.col(column), F.col(drop_self))) if drop_self else out


def reversals(canonical: DataFrame, everywhere: bool = False) -> DataFrame:
    """(claim_id, scope_id, relation, from_key, to_key, polarities): claims of groups whose outcomes contradict, within one scope or everywhere (scope_id is then null)."""
    if everywhere:
        canonical = canonical.withColumn("scope_id", F.lit("*"))
    k = lambda c: X.text_key(F.col(c))
    x = canonical.select("id", "scope_id", "relation", k("from_.concept").alias("from_key"), k("to_.concept").alias("to_key"), X.polarity(F.col("to_direction")).alias("p"))
    keys = ["scope_id", "relation", "from_key", "to_key"]
    g = x.where("scope_id is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("p")).alias("polarities"))
    # two different polarities always contradict: up and down, or none and either
    g = g.where(F.size("polarities") > 1)
    return x.join(g, keys).select(F.col("id").alias("claim_id"), F.nullif("scope_id", F.lit("*")).alias("scope_id"), *keys[1:], "polarities")


def recanonicalised(claims: DataFrame) -> DataFrame:
    """(claim_id, side, old_id, new_id): endpoints whose state id changes under the alias lists."""
    parts = []
    for side, end in (("from", "from_"), ("to", "to_")):
        ck, sk = X.text_key(F.col(f"{end}.concept")), X.text_key(F.col(f"{end}.state"))
        parts.append(claims.select(F.col("id").alias("claim_id"), F.lit(side).alias("side"), X.state_id(ck, sk).alias("old_id"), X.state_id(X.canonical_concept(ck), X.canonical_direction(sk)).alias("new_id")))
    return parts[0].unionByName(parts[1]).where("old_id <> new_id")
