"""Evaluation texts leaking into training text, by latent semantic retrieval.

Passages are windows of words. A randomised SVD of their TF-IDF matrix is computed over
all documents, distributed: each task sums its part of A'AX, the bounded factor (hashed
terms times rank) is put together and orthonormalised. Windows of documents are then
compared with the windows of the evaluation items by cosine in the latent space, and the
candidates are checked: for common runs of words exactly, and for paraphrases by the
longest common subsequence and the item's own names and numbers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.session import cut

#: Hashed terms and rank: together they bound all that the driver and each task hold.
DIMS, RANK = 1 << 14, 64
#: Words of a window and between window starts; any run of RUN words lies within a window.
WINDOW, STRIDE, RUN = 14, 3, 12
#: Radius of the balls around the items' windows; a document's window is compared with all only if it comes near one.
BALL = 0.33
#: Items that one pass over the documents handles; more are handled in blocks.
ITEM_BLOCK = 4_000
#: ``miss`` for which every window is a candidate, so that the exact check sees all.
EXACT = 0.0
#: Slices of the factor in the shuffle.
SLICES = 32
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters or digits, case ignored."""
    return WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=200_000)
def term(word: str) -> int:
    return zlib.crc32(word.encode()) % DIMS


def terms(ws: list[str]) -> np.ndarray:
    return np.fromiter((term(w) for w in ws), dtype=np.int32, count=len(ws))


def starts(n: int, stride: int = STRIDE) -> np.ndarray:
    """Window starts that cover n words; a shorter text is one window."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    s = np.arange(0, n - WINDOW + 1, stride)
    return s if s[-1] == n - WINDOW else np.append(s, n - WINDOW)


def window_sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.vstack([np.zeros((1, rows.shape[1]), dtype=np.float32), np.cumsum(rows, axis=0, dtype=np.float64)])
    return (c[np.minimum(at + WINDOW, len(rows))] - c[at]).astype(np.float32)


def _term_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        ids = [terms(words(t)).astype(np.uint16).tobytes() for t in p.text]
        yield pd.DataFrame({"doc_id": p.doc_id, "ids": ids})


def _document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, total = 0, np.zeros(DIMS, dtype=np.int64)
    for p in batches:
        for b in p.ids:
            if b:
                n += 1
                total[np.unique(np.frombuffer(b, dtype=np.uint16))] += 1
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"t": np.append(seen, -1), "n": np.append(total[seen], n)})


def inverse_frequency(ids: DataFrame) -> np.ndarray:
    """ln((N + 1) / (df + 1)) + 1 of each hashed term, over all documents."""
    rows = ids.select("ids").mapInPandas(_document_frequency, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS), 0
    for r in rows:  # at most DIMS + 1
        if r["t"] < 0:
            n = r["n"]
        else:
            df[r["t"]] = r["n"]
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


def _gram_times(texts: list[np.ndarray], idf: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Adds A'A x for the disjoint passages of the texts; rows of A have norm 1."""
    texts = [t for t in texts if len(t)]
    if not texts:
        return
    ids = np.concatenate(texts).astype(np.int64)
    first = np.cumsum([0] + [len(t) for t in texts[:-1]])
    at = np.concatenate([np.arange(f, f + len(t), WINDOW) for f, t in zip(first, texts, strict=True)])
    w = idf[ids]
    norm = np.maximum(np.add.reduceat(w * w, at), 1e-9)
    y = np.add.reduceat(w[:, None] * x[ids], at, axis=0) / norm[:, None]
    order = np.argsort(ids, kind="stable")
    passage = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))[order]
    cut_at = np.flatnonzero(np.diff(ids[order], prepend=-1))
    out[ids[order][cut_at]] += np.add.reduceat(w[order][:, None] * y[passage], cut_at, axis=0)


def _slice_rows(z: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"s": np.arange(SLICES, dtype=np.int32), "z": [b.tobytes() for b in np.split(z, SLICES)]})


def _partial_gram(idf_b, x_b):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, x = idf_b.value, x_b.value
        z = np.zeros((DIMS, RANK), dtype=np.float32)
        some, held, n = False, [], 0
        for p in batches:
            for b in p.ids:
                held.append(np.frombuffer(b, dtype=np.uint16))
                n += len(held[-1])
                if n > 100_000:
                    _gram_times(held, idf, x, z)
                    some, held, n = True, [], 0
        if n:
            _gram_times(held, idf, x, z)
        if n or some:
            yield _slice_rows(z)

    return run


def _sum_slices(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    z = np.zeros(DIMS // SLICES * RANK, dtype=np.float32)
    for b in g.z:
        z += np.frombuffer(b, dtype=np.float32)
    return pd.DataFrame({"s": [key[0]], "z": [z.tobytes()]})


def _gram(ids: DataFrame, idf_b, x_b) -> np.ndarray:
    """A'A x over all passages of ``ids``, summed by slices of the factor."""
    parts = ids.select("ids").mapInPandas(_partial_gram(idf_b, x_b), "s int, z binary").groupBy("s").applyInPandas(_sum_slices, "s int, z binary").collect()
    z = np.zeros((DIMS, RANK), dtype=np.float32)
    for r in parts:  # SLICES rows
        z[r["s"] * (DIMS // SLICES) : (r["s"] + 1) * (DIMS // SLICES)] = np.frombuffer(r["z"], dtype=np.float32).reshape(-1, RANK)
    return z


def latent_basis(ids: DataFrame, item_ids: DataFrame, idf: np.ndarray, passes: int = 2) -> np.ndarray:
    """Orthonormal (DIMS, RANK) basis of the leading right singular space of all passages.

    The few passages of the items, all of them, are weighted up to the documents' mass, so
    that their words are represented whatever the size of the corpus.
    """
    sc = ids.sparkSession.sparkContext
    x = np.random.default_rng(11).standard_normal((DIMS, RANK)).astype(np.float32)
    idf_b = sc.broadcast(idf)
    for _ in range(passes):
        x_b = sc.broadcast(x)
        z, own = _gram(ids, idf_b, x_b), _gram(item_ids, idf_b, x_b)
        mass = np.linalg.norm(own)
        z += own * (max(1.0, np.linalg.norm(z) / mass) if mass else 0)
        x = np.linalg.qr(z.astype(np.float64))[0].astype(np.float32)
        x_b.destroy()
    return x


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _balls(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of balls of at most BALL radians that cover the rows of x, and their true radii."""
    left, centers, far = np.ones(len(x), dtype=bool), [], []
    for i in range(len(x)):
        if left[i]:
            s = x @ x[i]
            own = left & (s >= math.cos(BALL))
            own[i] = True
            centers.append(x[i])
            far.append(float(np.arccos(np.clip(s[own].min(), -1, 1))))
            left &= ~own
    return np.array(centers, dtype=np.float32).reshape(-1, x.shape[1]), np.array(far)


class Items:
    """The evaluation side of one block of items: windows in the latent space and runs of words."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], idf: np.ndarray, basis: np.ndarray):
        self.words = [(i, words(t)) for i, q, p in rows for t in (q, p)]
        self.words = [(i, ws) for i, ws in self.words if ws]
        latent, owner = [], []
        self.runs: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for i, ws in self.words:
            ids = terms(ws)
            e = window_sums(idf[ids][:, None] * basis[ids], starts(len(ws)))
            latent.append(e)
            owner += [i] * len(e)
            for k in range(len(ws) - RUN + 1):
                self.runs[tuple(ws[k : k + RUN])].add(i)
        self.latent = _unit(np.vstack(latent)) if latent else np.zeros((0, RANK), dtype=np.float32)
        self.owner = np.array(owner, dtype=np.int64)
        self.centers, self.reach = _balls(self.latent)

    def threshold(self, idf: np.ndarray, basis: np.ndarray, miss: float) -> float:
        """Cosine that every window holding a run of an item reaches, whatever the words beside the run; no window lies below it for EXACT.

        A run leaves a window room for two more words. For each run and each item window e, the
        least cosine over all pairs of hashed terms, or fewer, is bounded from below: e.(r+a+b) / |r+a+b| >= t holds where the least of e.(r+a) - t|r+a| over a and the least of
        e.b - t|b| over b sum to 0 or more. The item window that gives the greatest bound counts.
        """
        if miss <= EXACT:
            return -2.0
        rows = np.vstack([np.zeros((1, basis.shape[1]), dtype=np.float32), idf[:, None] * basis])
        size = np.linalg.norm(rows, axis=1)
        least = 1.0
        for i, ws in self.words:
            ids, own = terms(ws), self.latent[self.owner == i]
            for k in range(len(ids) - RUN + 1):
                w = ids[k : k + RUN]
                r = (idf[w][:, None] * basis[w]).sum(axis=0)
                e = own[int(np.argmax(own @ r))]
                side = rows @ e
                long = np.sqrt(np.maximum(0.0, r @ r + 2 * (rows @ r) + size * size))
                fits = lambda t: (float(e @ r) + side - t * long).min() + (side - t * size).min() >= 0  # noqa: B023, E731
                if fits(least):
                    continue
                low = -1.0
                for _ in range(12):
                    t = (low + least) / 2
                    low, least = (t, least) if fits(t) else (low, t)
                least = low
        return max(-1.0, least) - 0.01


def _candidates(idf_b, basis_b, items_b, low: float, least: int, whose: bool = True):
    """For each document of at least ``least`` words: its word list and, by window, the items whose windows are near; without ``whose`` the windows only."""

    def run(p: pd.DataFrame):
        idf, basis, items = idf_b.value, basis_b.value, items_b.value
        # a window near an item's window is at most this far from the centre of its ball
        touch = np.cos(np.minimum(np.pi, items.reach + np.arccos(np.clip(low, -1, 1)) + 1e-3)).astype(np.float32)
        for doc, text in zip(p.doc_id, p.text, strict=True):
            ws = words(text)
            if len(ws) < least:
                continue
            ids = terms(ws)
            at = starts(len(ws))
            for k in range(0, len(at), 2048):
                part = at[k : k + 2048]
                base = int(part[0])
                sub = ids[base : int(part[-1]) + WINDOW]
                v = _unit(window_sums(idf[sub][:, None] * basis[sub], part - base))
                c = v @ items.centers.T
                if not whose:
                    # centres are items' windows themselves: what is near one needs no further product
                    a = (c >= low).any(axis=1)
                    rest = np.flatnonzero(~a & (c >= touch).any(axis=1))
                    if len(rest):
                        a[rest] = (v[rest] @ items.latent.T >= low).any(axis=1)
                    if a.any():
                        yield doc, ws, part, np.flatnonzero(a), None, None
                    continue
                near = np.flatnonzero((c >= touch).any(axis=1))
                s = v[near] @ items.latent.T
                a, b = np.nonzero(s >= low)
                if len(a):
                    yield doc, ws, part, near[a], items.owner[b], s[a, b]

    return run


def _exact(idf_b, basis_b, items_b, low: float):
    near = _candidates(idf_b, basis_b, items_b, low, RUN, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = set()
            runs = items_b.value.runs
            for doc, ws, at, a, _, _ in near(p):
                for k in sorted({k for s in at[a].tolist() for k in range(s, min(s + WINDOW, len(ws)) - RUN + 1)}):
                    hit = runs.get(tuple(ws[k : k + RUN]))
                    if hit:
                        found.update((doc, i) for i in hit)
            yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"])

    return run


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit a word of ``a``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _paraphrase(idf_b, basis_b, items_b, low: float, share: float, answer: float):
    near = _candidates(idf_b, basis_b, items_b, low, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[int, list[list[str]]] = defaultdict(list)
        for i, ws in items_b.value.words:
            texts[i].append(ws)
        common = idf_b.value
        for p in batches:
            spans: dict[tuple[int, int], list[int]] = {}
            held: dict[int, list[str]] = {}
            for doc, ws, at, a, owner, _ in near(p):
                held[doc] = ws
                for w, i in zip(a.tolist(), owner.tolist(), strict=True):
                    s = int(at[w])
                    spans.setdefault((doc, i), []).append(s)
            rows = []
            for (doc, i), found in spans.items():
                ws = held[doc]
                for item in texts[i]:
                    # only the windows that came near, and as much text as the item has around them
                    best = 0.0
                    for s in sorted(set(found)):
                        lo, hi = max(0, s - len(item) // 2), min(len(ws), s + WINDOW + len(item) // 2)
                        best = max(best, lcs(item, ws[lo:hi]) / len(item))
                    if best < share:
                        continue
                    # the item's own words: numbers and what is rare in the corpus
                    key = {w for w in item if w.isdigit() or common[term(w)] > 5}
                    kept = len(key & set(ws)) / len(key) if key else 1.0
                    if kept >= answer:
                        rows.append((doc, i, round(best, 4), round(kept, 4)))
            d = pd.DataFrame(rows, columns=["doc_id", "item_id", "lcs_share", "answer_share"])
            yield d.sort_values("lcs_share").drop_duplicates(["doc_id", "item_id"], keep="last")

    return run


def _prepare(docs: DataFrame, items: DataFrame, miss: float):
    """The latent space, then block by block the items with their threshold."""
    sc = docs.sparkSession.sparkContext
    slim = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    ids = cut(slim.mapInPandas(_term_ids, "doc_id long, ids binary"), "terms")
    idf = inverse_frequency(ids)
    sides = items.where("item_id is not null").select(F.explode(F.array("question", "passage")).alias("text")).where("text is not null")
    item_ids = cut(sides.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInPandas(_term_ids, "doc_id long, ids binary"), "item-terms")
    basis = latent_basis(ids, item_ids, idf)
    blocks = max(1, math.ceil(items.count() / ITEM_BLOCK))
    idf_b, basis_b = sc.broadcast(idf), sc.broadcast(basis)
    for b in range(blocks):
        rows = items.where((F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) & F.col("item_id").isNotNull()).select("item_id", "question", "passage").distinct().collect()
        own = Items([tuple(r) for r in rows], idf, basis)
        yield slim, idf_b, basis_b, sc.broadcast(own), own.threshold(idf, basis, miss)


def leaked_items(docs: DataFrame, items: DataFrame, miss: float = 0.0005) -> DataFrame:
    """(doc_id, item_id): the document shares at least RUN consecutive words with the item's question or passage.

    The latent search's threshold is a bound that every window with a run keeps, so none is lost, whatever
    ``miss`` above EXACT; ``miss=EXACT`` makes every window a candidate. Null texts and ids, texts
    shorter than a run and items shorter than a run match nothing; equal texts are reported
    each; empty tables give no rows.
    """
    out = None
    for slim, idf_b, basis_b, items_b, low in _prepare(docs, items, miss):
        part = slim.mapInPandas(_exact(idf_b, basis_b, items_b, low), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def paraphrased_items(docs: DataFrame, items: DataFrame, share: float = 0.7, answer: float = 0.6, near: float = 0.6) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share): items that a document repeats in altered words.

    lcs_share: the longest common subsequence of words against the item's length, around the
    windows that came as near as the cosine ``near``; answer_share: how many of the item's
    numbers and rare words occur (1 if it has none). Items and documents of any length take
    part; what holds no word matches nothing.
    """
    out = None
    for slim, idf_b, basis_b, items_b, _ in _prepare(docs, items, EXACT):
        part = slim.mapInPandas(_paraphrase(idf_b, basis_b, items_b, near, share, answer), "doc_id long, item_id long, lcs_share double, answer_share double")
        out = part if out is None else out.unionByName(part)
    return out
