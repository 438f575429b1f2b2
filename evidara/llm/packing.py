"""Filling fixed-capacity containers with texts.

Sizes are whole tokens up to the capacity, so the packing is computed on their
histogram: at most ``capacity`` numbers, whatever the number of texts. Items above a
third of the capacity are matched greedily, each container taking at most two of
them; the smaller ones, largest first, go to the tightest gap that holds them. Runs
of equal containers are handled as one. Texts then find their container by their
rank among the texts of their size.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import os
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.session import cut

CAPACITY = 2_048
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: The byte-level tokenizer's split of a text into words (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Rows of one size that one task ranks; a larger size is split by a salt.
RANK_ROWS = 200_000

_ENCODERS: dict[str, object] = {}


def encoder(ranks: bytes):
    """The tokenizer of a rank file's contents, made once in each worker."""
    name = hashlib.sha256(ranks).hexdigest()
    if name not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[name]


def _count_tokens(ranks_b):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_b.value)
        for p in batches:
            yield pd.DataFrame({"doc_id": p.doc_id, "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in p.text]})

    return run


def token_sizes(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) by a public tokenizer; a null or empty text has 0 tokens.

    The rank file (``tokenizer``, under a megabyte) is read by the driver and sent to the
    executors, which need not have it.
    """
    with open(tokenizer or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE), "rb") as f:
        ranks_b = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select("doc_id", "text").mapInPandas(_count_tokens(ranks_b), "doc_id long, n_tokens long")


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Placements (size, first rank, how many, first container), from {size: how many}.

    The item of rank r among its size goes to container first + (r - first rank).
    """
    out: list[tuple[int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    used: dict[int, int] = defaultdict(int)  # ranks handed out so far
    containers = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> runs (first container, how many)

    def place(size: int, n: int, first: int) -> None:
        out.append((size, used[size], n, first))
        used[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]

    third = capacity // 3
    large = sorted(s for s in left if s > third)
    while large:
        s = large[-1]
        if s not in left:
            large.pop()
            continue
        # the largest partner that still fits; s itself where two of it fit
        i = bisect.bisect_right(large, capacity - s) - 1
        while i >= 0 and large[i] not in left:
            large.pop(i)
            i -= 1
        p = large[i] if i >= 0 else None
        if p == s and left[s] < 2:
            p = next((x for x in reversed(large[:i]) if x in left), None)
        if p is None:
            n = left[s]
            place(s, n, containers)
            gaps[capacity - s].append((containers, n))
        elif p == s:
            n = left[s] // 2
            place(s, n, containers)
            place(s, n, containers)
            gaps[capacity - 2 * s].append((containers, n))
        else:
            n = min(left[s], left[p])
            place(s, n, containers)
            place(p, n, containers)
            gaps[capacity - s - p].append((containers, n))
        containers += n
    free = sorted(g for g in gaps if g > 0)
    for s in sorted(left, reverse=True):
        while s in left:
            i = bisect.bisect_left(free, s)
            if i == len(free):
                # no gap holds it: open as many containers as its items need at most
                n = -(-left[s] // (capacity // s))
                gaps[capacity].append((containers, n))
                containers += n
                bisect.insort(free, capacity) if capacity not in free else None
                continue
            g = free[i]
            first, n = gaps[g].pop()
            take = min(n, left[s])
            place(s, take, first)
            if take < n:
                gaps[g].append((first + take, n - take))
            if not gaps[g]:
                free.pop(i)
            if g - s > 0:
                if not gaps[g - s]:
                    bisect.insort(free, g - s)
                gaps[g - s].append((first, take))
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, token_from, n_tokens, container_id): every text in containers of ``capacity`` tokens.

    A text larger than a container is cut into full containers and one rest; no other
    text is cut. A null or empty text needs no container: its container_id is null and
    n_tokens 0. Equal texts are packed each for itself. The order within a size follows
    doc_id within a salted share of that size, so a size that holds a third of all rows
    is ranked by many tasks.
    """
    sizes = cut(token_sizes(docs, tokenizer), "sizes")
    rest = F.pmod(F.col("n_tokens") - 1, F.lit(capacity)) + 1
    items = sizes.where("n_tokens > 0").select(
        "doc_id", F.floor((F.col("n_tokens") - 1) / capacity).cast("int").alias("piece"), rest.cast("int").alias("size")
    )
    full = (
        sizes.where(F.col("n_tokens") > capacity)
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int") - 1)).alias("piece"))
        .select("doc_id", "piece", F.lit(capacity).alias("size"))
    )
    items = items.unionByName(full)
    total = sizes.count()
    salts = max(1, -(-total // RANK_ROWS))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = items.groupBy("size", "salt").count()
    # at most capacity sizes: the only thing that reaches the driver
    counts = {r["size"]: r["n"] for r in by_salt.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    placed = pack_histogram(counts, capacity)
    spark = docs.sparkSession
    slots = spark.createDataFrame(
        pd.DataFrame(placed, columns=["size", "rank_from", "n", "container_from"]) if placed else [], "size int, rank_from long, n long, container_from long"
    )
    offset = by_salt.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = items.withColumn("r", F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offset.select("size", "salt", "before"), ["size", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    # the slots are bounded by the number of sizes and gaps, not by the texts
    inside = (ranked["size"] == slots["size"]) & (F.col("r") >= F.col("rank_from")) & (F.col("r") < F.col("rank_from") + F.col("n"))
    packed = ranked.join(F.broadcast(slots), inside).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("token_from"), ranked["size"].cast("long").alias("n_tokens"),
        (F.col("container_from") + F.col("r") - F.col("rank_from")).alias("container_id"),
    )
    blank = sizes.where("n_tokens = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_from"), "n_tokens", F.lit(None).cast("long").alias("container_id")
    )
    return packed.unionByName(blank)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, most_used, share_filled, and least_containers, a bound that no packing can go below.

    The bound is the greater of the total size over the capacity and the number of items
    above half of it. No items: no containers, a null share.
    """
    p = packed.where("container_id is not null")
    c = p.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"), F.count_if(F.col("n_tokens") * 2 > capacity).alias("halves"))
    share = F.round(F.sum("used") / (F.count("*") * capacity), 4)
    least = F.greatest(F.ceil(F.sum("used") / capacity), F.sum("halves"))
    return c.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.max("used").alias("most_used"), share.alias("share_filled"), least.alias("least_containers"))
