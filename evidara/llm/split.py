"""Splitting oversized texts at natural boundaries.

Every position between two characters has a boundary strength: 4 an empty line,
3 the end of a sentence, 2 a line break or the end of a clause, 1 white space, 0 none.
A sparse table over the strengths answers "the strongest cut in this window" in
constant time; ties go to the right, so pieces are as long as the text allows. The
table covers a stretch of the text at a time and no more levels than a window needs, so
its size does not grow with the text. The next piece starts the overlap earlier, moved
to the nearest white space at or after.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.session import records

CHARS_PER_TOKEN = 3.5
MAX_TOKENS = 1_500
OVERLAP_TOKENS = 100
#: A cut is sought in the last so many parts of the longest permissible piece.
WINDOW = 0.5

_STRENGTH = ((re.compile(r"\s+"), 1), (re.compile(r"[;:,]\s+|\n"), 2), (re.compile(r"[.!?][\"'”’)\]]*\s+"), 3), (re.compile(r"\n[^\S\n]*\n\s*"), 4))


def tokens(n_chars: int) -> int:
    return max(1, -(-n_chars * 2 // 7))  # ceil(n / 3.5) in whole numbers


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character; a cut stands after its boundary's white space."""
    s = np.zeros(len(text) + 1, dtype=np.int8)
    for pattern, k in _STRENGTH:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        s[ends] = np.maximum(s[ends], k)
    return s


#: Positions that one sparse table covers.
STRETCH = 1 << 16


class RangeMax:
    """Sparse tables over stretches of s: position of the maximum of s[lo:hi], the rightmost of equals, for windows of at most ``longest``."""

    def __init__(self, s: np.ndarray, longest: int | None = None):
        self.s = s
        self.longest = min(len(s), longest or len(s))
        self.base = self.end = 0
        self.rows: list[np.ndarray] = []

    def _cover(self, lo: int) -> None:
        self.base, self.end = lo, min(len(self.s), lo + max(STRETCH, self.longest))
        part = self.s[self.base : self.end]
        self.rows = [np.arange(len(part), dtype=np.int32)]
        w = 1
        while 2 * w <= min(len(part), self.longest):
            a, b = self.rows[-1][:-w], self.rows[-1][w:]
            self.rows.append(np.where(part[a] > part[b], a, b))
            w *= 2

    def __call__(self, lo: int, hi: int) -> int:
        if lo < self.base or hi > self.end:
            self._cover(lo)
        lo, hi = lo - self.base, hi - self.base
        k = (hi - lo).bit_length() - 1
        a, b = int(self.rows[k][lo]) + self.base, int(self.rows[k][hi - (1 << k)]) + self.base
        return a if self.s[a] > self.s[b] else b


def cut_points(text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of the pieces; hard where no boundary was in reach."""
    limit = int(max_tokens * CHARS_PER_TOKEN)
    overlap = min(int(overlap_tokens * CHARS_PER_TOKEN), int(limit * (1 - WINDOW)) - 1)
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    s = strengths(text)
    best = RangeMax(s, limit + 1 - int(limit * WINDOW))
    out, start = [], 0
    while n - start > limit:
        lo, hi = start + int(limit * WINDOW), start + limit + 1
        end = best(lo, hi)
        hard = s[end] == 0
        out.append((start, end, hard))
        back = end - overlap
        if overlap and not hard:
            near = np.flatnonzero(s[back:end])
            back = back + int(near[0]) if len(near) else back
        start = max(back, start + 1)
    out.append((start, n, False))
    return out


PIECE = "block_id string, paper_id string, section_path array<string>, order_ int, piece int, n_pieces int, start int, end int, n_tokens int, hard_split boolean, text string"


def _pieces(max_tokens: int, overlap_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for r in p.itertuples(index=False):
                spans = cut_points(r.text, max_tokens, overlap_tokens)
                rows += [
                    (r.block_id, r.paper_id, r.section_path, r.order_, i, len(spans), a, b, tokens(b - a), bool(hard), r.text[a:b])
                    for i, (a, b, hard) in enumerate(spans)
                ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])

    return run


def split_oversized(blocks: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of every block, each at most ``max_tokens`` by max(1, ceil(characters / 3.5)).

    A block within the limit is its own single piece, passed through on the JVM side;
    only oversized texts go to Python. Copies of a block count once; a null text gives
    no piece, an empty one an empty piece of one token. The text is never changed: the
    pieces without their overlaps are the text. No boundary in the window means a hard cut.
    """
    whole = records(_texts(blocks).where(~_is_big(max_tokens)), "block_id").select(
        "block_id", "paper_id", "section_path", "order_", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"),
        F.char_length("text").alias("end"), F.greatest(F.lit(1), F.ceil(F.char_length("text") * 2 / F.lit(7))).cast("int").alias("n_tokens"),
        F.lit(False).alias("hard_split"), "text",
    )
    return whole.unionByName(_cut_pieces(blocks, max_tokens, overlap_tokens))


def _texts(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("id").alias("block_id"), "paper_id", "section_path", "order_", "text").where("text is not null")


def _is_big(max_tokens: int):
    return F.ceil(F.char_length("text") * 2 / F.lit(7)) > max_tokens


def _cut_pieces(blocks: DataFrame, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """The pieces of the oversized blocks; what is within the limit is left out before copies are taken together."""
    big = records(_texts(blocks).where(_is_big(max_tokens)), "block_id", few=True)
    return big.mapInPandas(_pieces(max_tokens, overlap_tokens), PIECE)


def oversized_blocks(blocks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(block_id) of the blocks that the splitter had to cut."""
    return _cut_pieces(blocks, max_tokens, OVERLAP_TOKENS).where("n_pieces > 1 and piece = 0").select("block_id")
