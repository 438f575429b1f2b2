"""Most similar vectors for every vector, by learned partitions.

A bounded sample's neighbour graph is partitioned in balance and a softmax classifier
learns which parts a vector's neighbours are in. Every vector is then indexed in its
most probable part and queries the few most probable ones; candidates are ranked by
their cosine in single precision. Parts are cut into blocks of bounded size, so a part
that holds a third of all rows is worked on by many tasks. Probing every part
(``probes=ALL_PARTS``) is the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.llm import partition as lp
from evidara.session import cut

DIM = 64
#: Rows of the sample that the partition and its classifier are fitted on, at most.
SAMPLE_ROWS = 12_000
#: Rows that a part should hold, and the least and most parts of a field; small fields are routed like large ones.
PART_ROWS, MIN_PARTS, MAX_PARTS = 1_500, 16, 256
#: Parts that a vector queries when pairs above a high threshold are wanted.
PROBES = 6
#: Probes that stand for all parts: nothing is missed, at the price of comparing all with all.
ALL_PARTS = 1 << 20
#: Rows of an index block and of a query block that meet in one task.
INDEX_BLOCK, QUERY_BLOCK = 8_192, 32_768
#: A half-precision query is off by less than this; only pairs this close to the threshold are checked again.
HALF_ERROR = 2e-3


def vectors(df: DataFrame, field: str, key: str = "id", dim: int = DIM) -> DataFrame:
    """(field, id, v) of the usable vectors: ``dim`` finite numbers, not all zero."""
    v = F.col(field)
    usable = v.isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30))
    return df.where(F.col(key).isNotNull() & usable).select(F.lit(field).alias("field"), F.col(key).alias("id"), v.cast("array<float>").alias("v"))


def _unit(col: pd.Series) -> np.ndarray:
    m = np.stack(col.to_numpy()).astype(np.float64)
    # norms of subnormal squares would vanish: scale by the largest entry first
    m /= np.abs(m).max(axis=1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def fit_routers(vecs: DataFrame, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS) -> dict[str, np.ndarray]:
    """Router weights by field. The sample is the rows of least id hash, a share of each field."""
    n = {r["field"]: r["count"] for r in vecs.groupBy("field").count().collect()}
    if not n:
        return {}
    share = F.lit(0.0)
    for name, k in n.items():
        share = F.when(F.col("field") == name, F.lit(min(1.0, sample_rows / k))).otherwise(share)
    lot = F.pmod(F.xxhash64("field", "id"), F.lit(1_000_003)) / 1_000_003.0
    rows = vecs.where(lot < share).dropDuplicates(["field", "id"]).select("field", "id", "v").toPandas()
    out = {}
    for name, k in n.items():
        mine = rows[rows.field == name].sort_values("id")
        parts = min(MAX_PARTS, max(MIN_PARTS, math.ceil(k / part_rows)))
        out[name] = lp.fit(_unit(mine.v), parts) if len(mine) else np.zeros((DIM + 1, 1), dtype=np.float32)
    return out


def _routed(routers: dict[str, np.ndarray], probes: dict[str, int]):
    """For each batch and field: ids, unit vectors and the parts of each row, the best first."""

    def run(p: pd.DataFrame):
        for name, g in p.groupby("field", sort=False):
            x = _unit(g.v)
            yield name, g.id.to_numpy(), x, lp.route(x, routers[name], probes[name])

    return run


def _count_parts(routers, probes):
    routed = _routed(routers, probes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], list[int]] = {}
        for p in batches:
            for name, _, _, parts in routed(p):
                n = routers[name].shape[1]
                i, q = np.bincount(parts[:, 0], minlength=n), np.bincount(parts.ravel(), minlength=n)
                for k in np.flatnonzero(q):
                    t = total.setdefault((name, int(k)), [0, 0])
                    t[0] += int(i[k])
                    t[1] += int(q[k])
        yield pd.DataFrame([(a, b, *c) for (a, b), c in total.items()], columns=["field", "part", "n_index", "n_query"])

    return run


BLOCKED = "field string, part int, ib int, qb int, id string, v binary"


def _emit(routers, probes, grid, index: bool, half: bool):
    """Rows of the index (one part) or of the queries (several parts, in half precision if a second look follows)."""
    routed = _routed(routers, probes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name, ids, x, parts in routed(p):
                data = x.astype(np.float16) if half and not index else x
                raw = [r.tobytes() for r in data]
                lot = pd.util.hash_array(ids.astype(object))
                use = parts[:, :1] if index else parts
                row = np.repeat(np.arange(len(ids)), use.shape[1])
                part = use.ravel()
                ib, qb = grid[name][part].T
                # a row meets every block of the other kind: its own number of blocks times the other's
                other = qb if index else ib
                rep = np.repeat(np.arange(len(row)), other)
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(other) - other, other)
                own = (lot[row] % (ib if index else qb).astype(np.uint64)).astype(np.int32)[rep]
                yield pd.DataFrame(
                    {"field": name, "part": part[rep].astype(np.int32), "ib": own if index else nth.astype(np.int32), "qb": nth.astype(np.int32) if index else own,
                     "id": ids[row[rep]], "v": [raw[k] for k in row[rep]]}
                )

    return run


def _blocks(vecs: DataFrame, routers: dict[str, np.ndarray], probes: dict[str, int], half: bool, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK):
    """The index and the query rows, keyed by the blocks in which they meet."""
    counts = vecs.mapInPandas(_count_parts(routers, probes), "field string, part int, n_index long, n_query long").groupBy("field", "part").agg(F.sum("n_index").alias("i"), F.sum("n_query").alias("q"))
    grid = {name: np.ones((w.shape[1], 2), dtype=np.int64) for name, w in routers.items()}
    for r in counts.collect():  # fields times parts, at most MAX_PARTS each
        grid[r["field"]][r["part"]] = max(1, math.ceil(r["i"] / index_block)), max(1, math.ceil(r["q"] / query_block))
    keys = ["field", "part", "ib", "qb"]
    index = vecs.mapInPandas(_emit(routers, probes, grid, True, half), BLOCKED).groupBy(*keys)
    query = vecs.mapInPandas(_emit(routers, probes, grid, False, half), BLOCKED).groupBy(*keys)
    return index, query


def _columns(parts: list[pd.DataFrame], field: str, names: list[str]) -> pd.DataFrame:
    """The parts as one frame; a pair of blocks of which one is empty gives no rows, of the same types."""
    if not parts:
        return pd.DataFrame({n: pd.Series([], dtype="float64" if n == "cosine" else object) for n in ["field", *names]})
    return pd.concat(parts).assign(field=field)[["field", *names]]


def _matrix(col: pd.Series, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=dtype).reshape(len(col), -1).astype(np.float32)


def similar_pairs(vecs: DataFrame, threshold: float, probes: int = PROBES, part_rows: int = PART_ROWS, index_block: int = INDEX_BLOCK) -> DataFrame:
    """(field, left_id, right_id, cosine): pairs of different ids with cosine >= ``threshold``, left < right.

    Rows repeated with one id give no pair with themselves and each pair once. A pair is
    found if either end's part is among the parts the other end queries. Null, short, zero
    and non-finite vectors take no part (see ``vectors``); an empty input gives no rows.
    With ``probes=ALL_PARTS`` every part is queried and no pair is missed.
    """
    vecs = vecs.select("field", "id", "v")
    routers = fit_routers(vecs, part_rows=part_rows)
    schema = "field string, left_id string, right_id string, cosine double"
    if not routers:
        return vecs.sparkSession.createDataFrame([], schema)
    index, query = _blocks(vecs, routers, dict.fromkeys(routers, probes), True, index_block)
    low = threshold - HALF_ERROR

    def match(i: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(i) and len(q):
            y, yi, qi = _matrix(i.v, np.float32).T, i.id.to_numpy(), q.id.to_numpy()
            for k in range(0, len(q), 2048):
                s = _matrix(q.v.iloc[k : k + 2048], np.float16) @ y
                a, b = np.nonzero(s >= low)
                left, right, c = qi[a + k], yi[b], s[a, b]
                different = left != right
                left, right, c = left[different], right[different], c[different]
                swap = left > right
                out.append(pd.DataFrame({"left_id": np.where(swap, right, left), "right_id": np.where(swap, left, right), "cosine": c.astype(np.float64)}))
        return _columns(out, i.field.iloc[0] if out else "", ["left_id", "right_id", "cosine"]).drop_duplicates(["left_id", "right_id"])

    near = cut(index.cogroup(query).applyInPandas(match, schema).groupBy("field", "left_id", "right_id").agg(F.max("cosine").alias("cosine")), "near")
    # half precision decides all but the pairs right at the threshold; those get their true cosine
    sure = near.where(F.col("cosine") >= threshold + HALF_ERROR)
    unsure = near.where(F.col("cosine") < threshold + HALF_ERROR)
    a = vecs.select("field", F.col("id").alias("left_id"), F.col("v").alias("va"))
    b = vecs.select("field", F.col("id").alias("right_id"), F.col("v").alias("vb"))
    checked = unsure.drop("cosine").join(a, ["field", "left_id"]).join(b, ["field", "right_id"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    checked = checked.withColumn("cosine", dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))).where(F.col("cosine") >= threshold)
    return sure.unionByName(checked.select("field", "left_id", "right_id", "cosine").distinct())


def calibrated_probes(vecs: DataFrame, routers: dict[str, np.ndarray], k: int, recall: float) -> dict[str, int]:
    """Parts to query so that the sample's rows find ``recall`` of their k nearest sample rows."""
    n = {r["field"]: r["count"] for r in vecs.groupBy("field").count().collect()}
    out = {}
    for name, w in routers.items():
        lot = F.pmod(F.xxhash64("field", "id"), F.lit(1_000_003)) / 1_000_003.0
        rows = vecs.where((F.col("field") == name) & (lot < min(1.0, SAMPLE_ROWS / n[name]))).toPandas()
        x = _unit(rows.v)
        near = lp.neighbour_graph(x, k)
        order = lp.route(x, w, w.shape[1])
        rank = np.argsort(order, axis=1)  # rank of each part in a row's own order
        need = rank[np.repeat(np.arange(len(x)), near.shape[1]), order[near, 0].ravel()]
        out[name] = int(np.quantile(need, recall)) + 1 if len(need) else 1
    return out


def nearest(vecs: DataFrame, k: int = 10, recall: float = 0.95, part_rows: int = PART_ROWS, index_block: int = INDEX_BLOCK) -> DataFrame:
    """(field, id, rank, neighbour_id, cosine): the k most similar other rows of every row.

    Rows must be unique by (field, id). Candidates are ranked by their cosine in single
    precision, rounded to 6 digits; ties go to the smaller id, within a block and across
    blocks. The number of parts a row queries is the least that finds the share ``recall``
    of the sample's neighbours. A field of fewer than k + 1 rows gives what there is; an
    empty one nothing.
    """
    routers = fit_routers(vecs, part_rows=part_rows)
    schema = "field string, id string, neighbour_id string, cosine double"
    if not routers:
        return vecs.sparkSession.createDataFrame([], "field string, id string, rank int, neighbour_id string, cosine double")
    probes = calibrated_probes(vecs, routers, k, recall)
    index, query = _blocks(vecs, routers, probes, False, index_block)

    def best(i: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(i) and len(q):
            i = i.sort_values("id")  # so that a place in the block orders ties as the ids do
            y, yi, qi = _matrix(i.v, np.float32).T, i.id.to_numpy(), q.id.to_numpy()
            m = min(k + 1, len(yi))
            place = np.arange(len(yi))
            for at in range(0, len(q), 512):
                s = np.rint(_matrix(q.v.iloc[at : at + 512], np.float32) @ y * 1e6).astype(np.int64)
                own = qi[at : at + 512, None]
                top = np.argpartition(place - s * len(yi), m - 1, axis=1)[:, :m]
                c, names = np.take_along_axis(s, top, 1) / 1e6, yi[top]
                keep = names != own
                out.append(pd.DataFrame({"id": np.broadcast_to(own, names.shape)[keep], "neighbour_id": names[keep], "cosine": c[keep]}))
        return _columns(out, i.field.iloc[0] if out else "", ["id", "neighbour_id", "cosine"])

    found = index.cogroup(query).applyInPandas(best, schema)
    order = W.partitionBy("field", "id").orderBy(F.desc("cosine"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("field", "id", "rank", "neighbour_id", "cosine")
