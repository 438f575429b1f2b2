"""Language-model and embedding steps as replaceable providers; nothing here needs a network."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors of words; stands in where no model is at hand."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1 if h & 1 << 20 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embedded(text: Column, embedder: Embedder) -> Column:
    """``text`` through an embedder, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(s.fillna("").tolist()))

    return run(text)


def missing_vectors(objects: DataFrame, cache: DataFrame, dimension: int) -> DataFrame:
    """Objects (id, text) without a cached vector (id, v) of this dimension."""
    return objects.join(cache.where(F.size("v") == dimension).select("id"), "id", "left_anti")


def replayed(requests: DataFrame, responses: DataFrame, schema: str) -> DataFrame:
    """Requests (stage, key) with their recorded responses (stage, key, body), parsed by ``schema``; null where none or unfit."""
    body = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    return requests.join(responses, ["stage", "key"], "left").withColumn("response", body).drop("body")


def stale(saved: DataFrame, current: DataFrame) -> DataFrame:
    """(paper_id, stage): saved results (paper_id, stage, version) made with another version than ``current`` (stage, version)."""
    return saved.join(current.withColumnRenamed("version", "now"), "stage").where(~F.col("version").eqNullSafe(F.col("now"))).select("paper_id", "stage")
