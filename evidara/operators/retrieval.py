"""Exact top-k, BM25, domain-wise MaxSim and the retrieval of contexts for batches of questions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vector as N
from evidara.functions import vocabulary as V
from evidara.functions.phrases import Phrases
from evidara.session import cut

#: Query vectors that one pass over the table holds; more are handled in blocks.
QUERY_BLOCK = 4_096


def exact_topk(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k items of greatest dot product, negative ones as 0, ties to the smaller id.

    ``queries`` is (query_id, qv), ``items`` (id, v). Queries are taken in blocks of
    bounded size; each task multiplies its batch with the block and keeps k a query, so
    only winners are shuffled. The dot product runs over the common length; nulls score 0.
    """
    spark = items.sparkSession
    n = queries.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "qv").collect()
        part = items.select("id", "v").mapInPandas(_block_topk(spark.sparkContext.broadcast(_matrix(rows)), k), "query_id string, id string, score double")
        out = part if out is None else out.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(rows) -> tuple[list[str], np.ndarray]:
    dim = max((len(r["qv"] or ()) for r in rows), default=0)
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, : len(r["qv"] or ())] = r["qv"] or ()
    return [str(r["query_id"]) for r in rows], m


def _block_topk(block, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = block.value
        for p in batches:
            if not len(names) or not len(p):
                continue
            x = np.zeros((len(p), q.shape[1]))
            for i, v in enumerate(p.v):
                if v is not None:
                    u = np.asarray(v, dtype=np.float64)[: q.shape[1]]
                    x[i, : len(u)] = np.nan_to_num(u)
            # rows in the order of ids, so that a stable sort gives ties to the smaller id
            by_id = np.argsort(p.id.astype(str).to_numpy(), kind="stable")
            ids = p.id.astype(str).to_numpy()[by_id]
            s = np.maximum(0.0, np.round(q @ x[by_id].T, 12))
            m = min(k, s.shape[1])
            # all that reach the k-th score, then the k first of them
            least = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
            row, col = np.nonzero(s >= least)
            order = np.lexsort((col, -s[row, col], row))
            row, col = row[order], col[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[nth < m], col[nth < m]
            yield pd.DataFrame({"query_id": np.array(names, dtype=object)[row], "id": ids[col], "score": s[row, col]})

    return run


def bm25(blocks: DataFrame, queries: DataFrame, k: int, group: str = "paper_id") -> DataFrame:
    """(group, query_id, block_id, score, rank): the k best blocks of each group by BM25.

    ``blocks`` is (group, block_id, order_, text), ``queries`` (group, query_id, text); several
    texts of one query_id give the best of them, a repeated word counts twice. Blocks that
    share no word score 0 and fill up the k; ties go to the smaller order.
    """
    most = k
    n, bins = dealt(blocks, group)
    kind = dict(blocks.dtypes)[group]
    spaced = lambda c: F.concat_ws(" ", X.word_list(F.col(c)))
    queries = cut(queries.select(group, "query_id", F.coalesce("text", F.lit("")).alias("qt")).distinct(), "queries")
    # a text that many queries of a group share is scored once
    texts = queries.select(group, "qt").distinct()
    asked = cut(texts.select(group, "qt", F.explode(X.word_list(F.col("qt"))).alias("w")).groupBy(group, "qt", "w").agg(F.count("*").cast("double").alias("times")), "asked")
    b = blocks.join(texts.select(group).distinct(), group, "left_semi").join(n, group)
    b = b.select(group, "block_id", "order_", spaced("text").alias("t"), in_bin(group, F.pmod(F.xxhash64("block_id"), F.col("parts")), bins).alias("bin"))
    bins_of = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")

    def counted(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        own = {g: set(w) for g, w in y.groupby(group, sort=False)["w"]}
        out = []
        for g, i, o, t in zip(x[group], x.block_id, x.order_, x.t, strict=True):
            words, wanted = t.split(" ") if t else [], own.get(g, ())
            held = Counter(w for w in words if w in wanted)
            out.append((g, i, o, len(words), list(held), list(held.values())))
        return pd.DataFrame(out, columns=[group, "block_id", "order_", "len", "ws", "tf"])

    # only words that are asked for are kept
    wanted = asked.select(group, "w").distinct().join(n, group).select(group, "w", bins_of).select(group, "w", in_bin(group, F.col("part"), bins).alias("bin")).distinct()
    post = b.groupBy("bin").cogroup(wanted.groupBy("bin")).applyInPandas(counted, f"{group} {kind}, block_id string, order_ int, len int, ws array<string>, tf array<int>")
    post = cut(post, "postings")
    size = post.groupBy(group).agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg"))
    df = post.select(group, F.explode("ws").alias("w")).groupBy(group, "w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(df, [group, "w"]).join(size, group).groupBy(group, "qt").agg(F.array_sort(F.collect_list(F.struct("w", idf.alias("idf"), "times"))).alias("asked"))
    y = texts.join(size.select(group, "avg"), group).join(known, [group, "qt"], "left").join(n, group)
    y = y.select(group, "qt", "avg", *[F.col(f"asked.{c}").alias(c) for c in ("w", "idf", "times")], bins_of).withColumn("bin", in_bin(group, F.col("part"), bins)).drop("part").dropDuplicates([group, "qt", "bin"])
    at = post.join(n, group).withColumn("bin", in_bin(group, F.pmod(F.xxhash64("block_id"), F.col("parts")), bins)).drop("parts")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        mine, out = dict(list(y.groupby(group, sort=False))), []
        for g, own in x.groupby(group, sort=False):
            if g not in mine:
                continue
            own = own.sort_values(["order_", "block_id"])  # so that a stable sort keeps ties in order
            avg, length = mine[g].avg.iloc[0], own["len"].to_numpy()
            rows: dict[str, list[int]] = {}
            tfs: dict[str, list[int]] = {}
            for r, (ws, tf) in enumerate(zip(own.ws, own.tf, strict=True)):
                for w, c in zip(ws, tf, strict=True):
                    rows.setdefault(w, []).append(r)
                    tfs.setdefault(w, []).append(c)
            held = {w: (np.array(r), np.array(tfs[w], dtype=float), length[r]) for w, r in rows.items()}
            ids, order = own.block_id.to_numpy(), own.order_.to_numpy()
            for qt, ws, idfs, times in zip(mine[g].qt, mine[g].w, mine[g].idf, mine[g].times, strict=True):
                s = np.zeros(len(own))
                for w, i, m in zip(ws, idfs, times, strict=True) if ws is not None else ():
                    if w in held:
                        r, tf, ln = held[w]
                        s[r] += i * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * ln / avg)) * m
                top = _first(s, most)
                out.append((g, qt, ids[top], order[top], s[top]))
        return _told(out, [group, "qt", "block_id", "order_", "score"])

    every = at.groupBy("bin").cogroup(y.groupBy("bin")).applyInPandas(best, f"{group} {kind}, qt string, block_id string, order_ int, score double")
    best_of = every.withColumn("r", F.row_number().over(W.partitionBy(group, "qt").orderBy(F.desc("score"), "order_", "block_id"))).where(F.col("r") <= most)
    # a query's k best are among the k best of its texts
    out = best_of.join(queries, [group, "qt"]).groupBy(group, "query_id", "block_id", "order_").agg(F.max("score").alias("score"))
    order = W.partitionBy(group, "query_id").orderBy(F.desc("score"), "order_", "block_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(group, "query_id", "block_id", "score", "rank")


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, in order; ties in order of place."""
    if len(s) > 4 * k:
        at = np.flatnonzero(s >= -np.partition(-s, k - 1)[k - 1])
        return at[np.argsort(-s[at], kind="stable")[:k]]
    return np.argsort(-s, kind="stable")[:k]


def _told(out: list[tuple], names: list[str]) -> pd.DataFrame:
    """A frame of (group, name, ids, orders, scores), a row an id."""
    if not out:
        return pd.DataFrame({c: pd.Series([], dtype=float if c == "score" else object) for c in names})
    times = [len(x[2]) for x in out]
    first = [np.repeat(np.array([x[c] for x in out], dtype=object), times) for c in (0, 1)]
    return pd.DataFrame(dict(zip(names, [*first, *[np.concatenate([x[c] for x in out]) for c in (2, 3, 4)]], strict=True)))


#: Blocks of a group that meet its queries in one task.
GROUP_BLOCKS = 8_192


def semantic_blocks(blocks: DataFrame, queries: DataFrame, k: int, group: str = "paper_id") -> DataFrame:
    """(group, query_id, block_id, score, rank): the k blocks of each group nearest to a query by dot product.

    ``blocks``: group, block_id, order_, v; ``queries``: group, query_id, qv; several vectors of
    one query give the best of them. Blocks without a vector take no part, negative scores
    stay; ties go to the smaller order, then id. A group's blocks are dealt out to as many tasks as
    they need, its queries to each of them, and only each task's k best are shuffled.
    """
    b = cut(blocks.where(F.col("v").isNotNull()).select(group, "block_id", "order_", "v"), "vectors")
    n, bins = dealt(b, group)
    b = b.join(n, group).select(group, "block_id", "order_", "v", in_bin(group, F.pmod(F.xxhash64("block_id"), F.col("parts")), bins).alias("bin"))
    q = queries.where(F.col("qv").isNotNull()).groupBy(group, "query_id").agg(F.array_sort(F.collect_set("qv")).alias("qvs"))
    q = q.groupBy(group, "qvs").agg(F.collect_list("query_id").alias("query_ids"))
    q = q.join(n, group).select(group, "query_ids", "qvs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    q = q.withColumn("bin", in_bin(group, F.col("part"), bins)).drop("part").dropDuplicates([group, "qvs", "bin"])
    kind = dict(b.dtypes)[group]

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        mine, out = dict(list(y.groupby(group, sort=False))), []
        for g, own in x.groupby(group, sort=False):
            if g not in mine:
                continue
            own = own.sort_values(["order_", "block_id"])  # so that a stable sort keeps ties in order
            m = np.stack(own.v.to_numpy()).astype(np.float64)
            ids, at = own.block_id.to_numpy(), own.order_.to_numpy()
            for names, many in zip(mine[g].query_ids, mine[g].qvs, strict=True):
                s = np.round((m @ np.stack(list(many)).T.astype(np.float64)).max(axis=1), 12)
                top = _first(s, k)
                out += [(g, name, ids[top], at[top], s[top]) for name in names]
        return _told(out, [group, "query_id", "block_id", "order_", "score"])

    near = b.groupBy("bin").cogroup(q.groupBy("bin")).applyInPandas(best, f"{group} {kind}, query_id string, block_id string, order_ int, score double")
    order = W.partitionBy(group, "query_id").orderBy(F.desc("score"), "order_", "block_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(group, "query_id", "block_id", "score", "rank")


def dealt(blocks: DataFrame, group: str) -> tuple[DataFrame, int]:
    """(group, parts) and the number of bins that hold GROUP_BLOCKS blocks each: where ``in_bin`` deals large groups out and small ones together."""
    n = cut(blocks.groupBy(group).agg(F.count("*").alias("n"), F.ceil(F.count("*") / GROUP_BLOCKS).cast("int").alias("parts")), "parts")
    return n.select(group, "parts"), max(1, math.ceil((n.agg(F.sum("n")).first()[0] or 0) / GROUP_BLOCKS))


def in_bin(group: str, part: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(F.col(group), part.cast("int")), F.lit(bins)).cast("int")


def holding(blocks: DataFrame, keys: DataFrame, group: str = "paper_id") -> DataFrame:
    """(group, key, block_id): the blocks whose text key ``t`` holds a key of their group, anywhere.

    ``blocks``: group, block_id, t; ``keys``: group, key. A text is read once for all keys of its group.
    """
    n, bins = dealt(blocks, group)
    asked = keys.where("key <> ''").select(group, "key").distinct()
    b = blocks.join(asked.select(group).distinct(), group, "left_semi").join(n, group)
    b = b.select(group, "block_id", "t", in_bin(group, F.pmod(F.xxhash64("block_id"), F.col("parts")), bins).alias("bin"))
    k = asked.join(n, group).select(group, "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    k = k.select(group, "key", in_bin(group, F.col("part"), bins).alias("bin")).distinct()

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        named = {g: Phrases(own) for g, own in y.groupby(group, sort=False)["key"]}
        out = [(g, key, i) for g, i, t in zip(x[group], x.block_id, x.t, strict=True) if g in named for key in named[g].found(t)]
        return pd.DataFrame(out, columns=[group, "key", "block_id"], dtype=object)

    return b.groupBy("bin").cogroup(k.groupBy("bin")).applyInPandas(run, f"{group} {dict(blocks.dtypes)[group]}, key string, block_id string")


def facet_matches(query_facets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate facet for each query facet and context, within the domain.

    ``query_facets``: query_id, query_facet_id, domain, qn, qc; ``candidates``: query_id,
    context_id, facet_id, domain, cn, cc. Order: pair score, content score, facet id.
    """
    pair = query_facets.join(candidates, ["query_id", "domain"])
    pair = pair.withColumn("notion", N.closeness(F.col("qn"), F.col("cn"))).withColumn("content", N.closeness(F.col("qc"), F.col("cc")))
    pair = pair.withColumn("pair", V.ALPHA * F.col("notion") + (1 - V.ALPHA) * F.col("content"))
    best = F.min(F.struct((-F.col("pair")).alias("p"), (-F.col("content")).alias("c"), F.col("facet_id").alias("id"), F.col("notion").alias("n"))).alias("b")
    return pair.groupBy("query_id", "context_id", "domain", "query_facet_id").agg(best).select(
        "query_id", "context_id", "domain", "query_facet_id", F.col("b.id").alias("facet_id"), (-F.col("b.p")).alias("pair"), F.col("b.n").alias("notion"), (-F.col("b.c")).alias("content")
    )


def maxsim(query_facets: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, context_id, semantic, coverage, overall) for every pair (query_id, context_id).

    A domain scores the mean of its facets' best pairs; domains that the context lacks are
    left out of the mean, not counted as 0, and lower the coverage instead.
    """
    weight = F.create_map(*[F.lit(x) for p in V.DOMAIN_WEIGHTS.items() for x in p])
    domains = facet_matches(query_facets, candidates).groupBy("query_id", "context_id", "domain").agg(F.avg("pair").alias("score"))
    known = domains.withColumn("w", F.coalesce(F.try_element_at(weight, F.col("domain")), F.lit(0.0))).groupBy("query_id", "context_id").agg(F.sum("w").alias("kw"), F.sum(F.col("w") * F.col("score")).alias("ws"))
    total = query_facets.select("query_id", "domain").distinct().groupBy("query_id").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("domain")), F.lit(0.0))).alias("tw"))
    out = pairs.join(known, ["query_id", "context_id"], "left").join(total, "query_id", "left").fillna({"kw": 0.0, "ws": 0.0, "tw": 0.0})
    out = out.withColumn("semantic", F.when(F.col("kw") > 0, F.col("ws") / F.col("kw")).otherwise(0.0)).withColumn("coverage", F.when(F.col("tw") > 0, F.col("kw") / F.col("tw")).otherwise(0.0))
    out = out.withColumn("overall", F.col("semantic") * (1 - V.MISSING * (1 - F.col("coverage")))).drop("kw", "ws", "tw")
    # sums may differ in their last bits with the order of rows; ties must not
    return out.withColumns({c: F.round(c, 12) for c in ("semantic", "coverage", "overall")})


def retrieve_contexts(queries: DataFrame, query_facets: DataFrame, contexts: DataFrame, effective: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, context_id, coarse, semantic, coverage, overall, rank): coarse top-k by vector, then MaxSim, then the best kept.

    ``effective``: context_id, facet_id, domain; ``vectors``: facet_id, cn, cc. The vectors meet the facets
    of the retrieved contexts only. A question without facets retrieves no context.
    """
    asked = queries.join(query_facets.select("query_id").distinct(), "query_id", "left_semi")
    coarse = exact_topk(asked.select("query_id", "qv"), contexts, V.COARSE).select("query_id", F.col("id").alias("context_id"), F.col("score").alias("coarse"))
    held = effective.join(coarse.select("query_id", "context_id"), "context_id").join(vectors, "facet_id")
    scored = maxsim(query_facets, held, coarse)
    order = W.partitionBy("query_id").orderBy(F.desc("overall"), F.desc("semantic"), F.desc("coarse"), "context_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= V.RERANKED)


def coherence(facets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, coherence): mean of MaxSim in both directions; null where a side has no facets.

    ``facets``: set_id, facet_id, domain, n, c (vectors).
    """
    q = facets.select(F.col("set_id").alias("query_id"), F.col("facet_id").alias("query_facet_id"), "domain", F.col("n").alias("qn"), F.col("c").alias("qc"))
    c = facets.select(F.col("set_id").alias("context_id"), "facet_id", "domain", F.col("n").alias("cn"), F.col("c").alias("cc"))
    both = pairs.select("left", "right").union(pairs.select("right", "left")).distinct().toDF("query_id", "context_id")
    score = maxsim(q, c.join(both, "context_id"), both).select("query_id", "context_id", "overall")
    has = facets.select("set_id").distinct()
    ok = pairs.join(has.withColumnRenamed("set_id", "left"), "left", "left_semi").join(has.withColumnRenamed("set_id", "right"), "right", "left_semi")
    ok = ok.join(score.toDF("left", "right", "f"), ["left", "right"]).join(score.toDF("right", "left", "b"), ["left", "right"])
    return pairs.join(ok.select("left", "right", (0.5 * (F.col("f") + F.col("b"))).alias("coherence")), ["left", "right"], "left")


#: Sets of a group that ask, and sets that they are compared with, in one task.
LEFT_SETS, RIGHT_SETS = 256, 4_096


def coherence_within(sets: DataFrame, facets: DataFrame, vectors: DataFrame, group: str = "paper_id") -> DataFrame:
    """(left, right, coherence) of every asked set with each other set of its group: ``coherence`` where all pairs are wanted.

    ``sets``: group, set_id, asked; ``facets``: set_id, facet_id, domain; ``vectors``: facet_id, n, c. A group's sets
    are dealt out to as many tasks as they need; a task gets the vectors of its sets' facets once each, and
    the products of two facets serve both directions and all pairs that hold them.
    """
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    n = sets.groupBy(group).agg(blocks(F.count_if("asked"), LEFT_SETS).alias("lefts"), blocks(F.count("*"), RIGHT_SETS).alias("rights"), F.max("asked").alias("any")).where("any").drop("any")
    held = facets.groupBy("set_id").agg(F.collect_list("facet_id").alias("ids"))
    whole = sets.join(n, group).join(held, "set_id", "left")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = lambda k, seed: F.pmod(F.xxhash64("set_id", F.lit(seed)), F.col(k)).cast("int")
    left = whole.where("asked").select(group, own("lefts", 1).alias("l"), every("rights").alias("r"), F.lit("left").alias("kind"), "set_id", "ids")
    right = whole.select(group, every("lefts").alias("l"), own("rights", 2).alias("r"), F.lit("right").alias("kind"), "set_id", "ids")
    both = cut(left.unionByName(right), "dealt")
    known = both.select(group, "l", "r", F.explode("ids").alias("facet_id")).distinct().join(facets.select("facet_id", "domain").distinct().join(vectors, "facet_id"), "facet_id")
    rows = both.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("domain", "string"), ("n", "array<double>"), ("c", "array<double>"))]).unionByName(
        known.select(group, "l", "r", F.lit("facet").alias("kind"), F.col("facet_id").alias("set_id"), F.lit(None).cast("array<string>").alias("ids"), "domain", N.doubles(F.col("n")).alias("n"), N.doubles(F.col("c")).alias("c"))
    )
    return rows.groupBy(group, "l", "r").applyInPandas(_coherence_block, "left string, right string, coherence double")


def _padded(many) -> np.ndarray:
    """Rows of one length; null is 0 throughout."""
    out = np.zeros((len(many), max((len(v) for v in many if v is not None), default=0)))
    for i, v in enumerate(many):
        if v is not None:
            out[i, : len(v)] = v
    return out


def _coherence_block(p: pd.DataFrame) -> pd.DataFrame:
    f, left, right = (p[p.kind == k] for k in ("facet", "left", "right"))
    place: dict[str, tuple] = {}
    tables = {}
    for domain, g in f[f.domain.notna()].groupby("domain", sort=False):
        place |= {i: (domain, k) for k, i in enumerate(g.set_id)}
        tables[domain] = (_padded(g.n.to_numpy()), _padded(g.c.to_numpy()))
    # a facet without a domain matches nothing and weighs nothing
    split = lambda ids: [place[i] for i in (ids if ids is not None else ()) if i in place]
    names, weight = right.set_id.to_numpy(), lambda d: V.DOMAIN_WEIGHTS.get(d, 0.0)
    some = np.array([x is not None and len(x) > 0 for x in right.ids], dtype=bool)
    refs: dict[str, list[list[int]]] = {d: [[], [], []] for d in tables}  # facets, first of each set, sets
    total = np.zeros(len(names))
    for k, ids in enumerate(right.ids):
        for d, i in split(ids):
            at, first, whose = refs[d]
            if not whose or whose[-1] != k:
                first.append(len(at))
                whose.append(k)
                total[k] += weight(d)
            at.append(i)
    refs = {d: tuple(np.array(x, dtype=np.int64) for x in r) for d, r in refs.items()}
    out = []
    for name, ids in zip(left.set_id, left.ids, strict=True):
        own: dict[str, list[int]] = {}
        for d, i in split(ids):
            own.setdefault(d, []).append(i)
        kw, there, back = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for d, mine in own.items():
            at, first, whose = refs[d]
            if not len(whose):
                continue
            notion, content = tables[d]
            pair = V.ALPHA * np.maximum(0.0, notion @ notion[mine].T) + (1 - V.ALPHA) * np.maximum(0.0, content @ content[mine].T)
            best = np.maximum.reduceat(pair[at], first, axis=0).mean(axis=1)
            met = np.add.reduceat(pair.max(axis=1)[at], first) / np.diff(np.append(first, len(at)))
            kw[whose] += weight(d)
            there[whose] += weight(d) * best
            back[whose] += weight(d) * met
        mean = lambda x: np.divide(x, kw, out=np.zeros(len(x)), where=kw > 0)  # noqa: B023, E731
        tw = sum(weight(d) for d in own)
        ways = ((mean(there), kw / tw if tw > 0 else np.zeros(len(kw))), (mean(back), np.divide(kw, total, out=np.zeros(len(kw)), where=total > 0)))
        f, b = (np.round(s * (1 - V.MISSING * (1 - coverage)), 12) for s, coverage in ways)
        known = some if ids is not None and len(ids) else np.zeros(len(names), dtype=bool)
        x = pd.DataFrame({"left": name, "right": names, "coherence": np.where(known, 0.5 * (f + b), np.nan)})
        out.append(x[names != name])
    return pd.concat(out) if out else pd.DataFrame({"left": pd.Series([], dtype=object), "right": pd.Series([], dtype=object), "coherence": pd.Series([], dtype=float)})
