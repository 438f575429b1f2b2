"""Mapping freely typed values to a canonical list.

The list's terms and known aliases form a BK-tree under the Levenshtein distance on
spelling keys (case, accents, spacing and punctuation set aside). The triangle
inequality prunes the search, which returns every entry within the threshold. A value
that is no near spelling as a whole is tried with its parts reordered ("moisture of the
soil"), and by the runs of words within it; abbreviated words are completed by the words
of the entry they are compared with. Every match has a rank that depends on the value and
the entry alone, so the list may be cut into any shards: the best of the shards' winners
is the winner of the whole list.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.session import cut, records

#: Entries of one tree; a longer list is sharded and the shards' winners are merged.
SHARD_ENTRIES = 20_000
#: Distinct values that one task compares.
VALUES_A_TASK = 20_000
#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("абвеһіјкмнорѕстухԁαβεηικμνορτυχ", "abbehijkmhopsctyxdabeniкuvoptuχ".replace("к", "k").replace("χ", "x"))
_SPLIT = re.compile(r"[^\w.]+|_+")
#: A hyphen within an abbreviated word: 'low-l. jet'.
_CUT = re.compile(r"-(?=\w*\.(?:\s|$))")


def folded(value: str) -> str:
    """Compatibility forms, case, accents, soft hyphens and look-alike letters set aside."""
    v = unicodedata.normalize("NFKC", value).replace("\xad", "").lower().translate(LOOKALIKES)
    return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))


def tokens(value: str) -> list[str]:
    """Words of a folded value; a trailing full stop stays, as the sign of an abbreviation."""
    parts = _SPLIT.split(_CUT.sub("", folded(value)))
    return [t for t in (p.lstrip(".") for p in parts) if t.strip(".")]


def key(words: list[str]) -> str:
    return "".join(w.rstrip(".") for w in words)


def levenshtein(a: str, b: str) -> int:
    """Edit distance, one bit a character of the longer word (a true metric)."""
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if not b:
        return n
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << n) - 1
    top = 1 << (n - 1)
    pv, mv, d = full, 0, n
    for c in b:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        ph = (ph << 1) | 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return d


class BKTree:
    """Entries by distance from their parent; ``within`` prunes by the triangle inequality."""

    def __init__(self, keys: list[str]):
        self.root: tuple[str, dict] | None = None
        for k in keys:
            self.add(k)

    def add(self, k: str) -> None:
        if self.root is None:
            self.root = (k, {})
            return
        node = self.root
        while True:
            d = levenshtein(k, node[0])
            if not d:
                return
            if d not in node[1]:
                node[1][d] = (k, {})
                return
            node = node[1][d]

    def within(self, k: str, most: int) -> list[tuple[int, str]]:
        """(distance, entry) of every entry at most ``most`` away."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            name, below = todo.pop()
            d = levenshtein(k, name)
            if d <= most:
                out.append((d, name))
            todo += [child for e, child in below.items() if d - most <= e <= d + most]
        return out


def allowed(n: int, whole: bool) -> int:
    """Edits tolerated in a key of n characters; fewer where only a part of the value is compared."""
    if whole:
        return 0 if n < 4 else 1 if n < 7 else 2 if n < 13 else 3
    return 0 if n < 6 else 1 if n < 11 else 2


#: How a value meets an entry, the best first: as a whole, turned round, by a run of its words.
WHOLE, TURNED, PART = 0, 1, 2
#: (kind, cost, distance, entry) of a match; the least is the best. NONE ranks behind all.
Match = tuple[int, int, int, str]
NONE: Match = (3, 0, 0, "")


def _match(kind: int, d: int, entry: str) -> Match:
    """A whole value goes to the nearest, then the longest entry; for parts, each edit costs three covered characters."""
    return (kind, 3 * d - len(entry), d, entry) if kind == PART else (kind, d, -len(entry), entry)


class Matcher:
    """The entries of one field (or one shard of it)."""

    def __init__(self, entries: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        spelled: dict[tuple[str, ...], str] = {}
        for term_id, text in sorted(entries):
            ws = tokens(text)
            if not ws:
                continue
            self.ids.setdefault(key(ws), term_id)
            # a hyphen may stand between two words or within one
            for words in (ws, [key(tokens(w)) for w in text.split()]):
                spelled[tuple(w.rstrip(".") for w in words if w)] = key(ws)
        self.tree = BKTree(list(self.ids))
        self.spelled = list(spelled.items())
        self.most = max((len(w) for w, _ in self.spelled), default=0)
        #: (word, place in the entry, number of the spelling), for the words that an abbreviation may stand for
        self.starts = sorted((w, i, n) for n, (ws, _) in enumerate(self.spelled) for i, w in enumerate(ws))
        self._arm()

    def _arm(self) -> None:
        self.near = lru_cache(maxsize=200_000)(self._near)
        self.best = lru_cache(maxsize=200_000)(self._best)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("near", "best")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._arm()

    def _near(self, k: str, kind: int) -> Match:
        """The best entry within the threshold. An exact one is never outranked."""
        if k in self.ids:
            return _match(kind, 0, k)
        whole = kind != PART
        most = allowed(len(k), whole)
        hits = self.tree.within(k, most) if most else []
        return min((_match(kind, d, e) for d, e in hits if d <= allowed(len(e), whole)), default=NONE)

    def abbreviated(self, words: list[str]) -> Match:
        """The best entry for words some of which are cut short ('relat. humidity'), whole or by a run."""
        best = NONE
        tried = set()
        for at, w in enumerate(words):
            stem = w.rstrip(".")
            if not w.endswith(".") or len(stem) < 3:
                continue
            for i in range(bisect.bisect_left(self.starts, (stem,)), len(self.starts)):
                full, place, n = self.starts[i]
                if not full.startswith(stem):
                    break
                entry, name = self.spelled[n]
                first, last = at - place, at - place + len(entry)
                if first < 0 or last > len(words) or (n, first) in tried:
                    continue
                tried.add((n, first))
                run = words[first:last]
                form = "".join(e if r.endswith(".") and len(r) > 3 and e.startswith(r.rstrip(".")) else r.rstrip(".") for r, e in zip(run, entry, strict=True))
                whole = len(run) == len(words)
                d = levenshtein(form, name)
                if d <= min(allowed(len(form), whole), allowed(len(name), whole)):
                    best = min(best, _match(WHOLE if whole else PART, d, name))
        return best

    def _best(self, value: str) -> Match:
        words = tokens(value)
        if not words:
            return NONE
        best = min(self.near(key(words), WHOLE), self.abbreviated(words))
        if best[0] > WHOLE:
            best = min([best, *(self.near(key(t), TURNED) for t in turns(value))])
        if best[0] > TURNED:
            # a hyphen may join two words of an entry or be part of one: the tokens are split at either
            runs = (words[i:j] for i in range(len(words)) for j in range(i + 1, min(len(words), i + self.most + 1) + 1))
            best = min([best, *(self.near(key(r), PART) for r in runs)])
        return best


def turns(value: str) -> Iterator[list[str]]:
    """Reorderings that a spelling with 'of' or a comma suggests."""
    v = folded(value)
    m = re.fullmatch(r"\s*(.+?)\s+of\s+(?:the\s+)?(.+?)\s*", v)
    if m:
        yield tokens(m[2]) + tokens(m[1])
    m = re.fullmatch(r"\s*([^,]+),\s*([^,]+?)\s*", v)
    if m:
        yield tokens(m[2]) + tokens(m[1])


def matchers(terms: DataFrame, shard_entries: int = SHARD_ENTRIES) -> Iterator[dict[str, Matcher]]:
    """Shard by shard, the matchers of each field. A shard holds at most ``shard_entries`` terms with their aliases."""
    slim = terms.where("term_id is not null and term is not null and field is not null")
    shards = max(1, math.ceil(slim.count() / shard_entries))
    for s in range(shards):
        own = slim.where(F.pmod(F.xxhash64("term_id"), F.lit(shards)) == s).select("field", "term_id", "term", "known_aliases").collect()
        by: dict[str, list[tuple[int, str]]] = {}
        for r in own:
            by.setdefault(r["field"], []).extend((r["term_id"], t) for t in [r["term"], *(r["known_aliases"] or [])] if t)
        yield {f: Matcher(e) for f, e in by.items()}


def endpoint_values(claims: DataFrame) -> DataFrame:
    """(claim_id, side, field, value): each endpoint value of each claim record."""
    own = records(claims.select(F.col("id").alias("claim_id"), F.col("from_"), F.col("to_")), "claim_id")
    cells = [F.struct(F.lit(s).alias("side"), F.lit(f).alias("field"), F.col(f"{s}_.{f}").alias("value")) for s in ("from", "to") for f in ("concept", "state")]
    return own.select("claim_id", F.explode(F.array(*cells)).alias("c")).select("claim_id", "c.side", "c.field", "c.value")


MATCHED = "field string, value string, kind int, cost int, tie int, entry string, term_id int"


def _map(tree_b):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = tree_b.value
        for p in batches:
            rows = []
            for f, v in zip(p.field, p.value, strict=True):
                m = trees[f].best(v) if f in trees else NONE
                if m != NONE:
                    rows.append((f, v, *m, trees[f].ids[m[3]]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHED.split(", ")])

    return run


def map_values(values: DataFrame, terms: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(field, value, term_id, distance) of the distinct values; term_id 0 where no entry is within the threshold.

    Values are compared once each, however often they occur, and spread by their number.
    The shards are worked on one after the other: each one's winners are written before
    the next one is sent out, so one shard is all that a task ever holds. Null values are
    left out; a field without entries matches none.
    """
    sc = values.sparkSession.sparkContext
    distinct = cut(values.where("value is not null").select("field", "value").distinct(), "values")
    tasks = max(2 * sc.defaultParallelism, math.ceil(distinct.count() / VALUES_A_TASK))
    spread = distinct.repartition(tasks, "field", "value")
    won = None
    for m in matchers(terms, shard_entries):
        tree_b = sc.broadcast(m)
        part = cut(spread.mapInPandas(_map(tree_b), MATCHED), "matched")
        tree_b.destroy()
        won = part if won is None else won.unionByName(part)
    best = won.groupBy("field", "value").agg(F.min(F.struct("kind", "cost", "tie", "entry", "term_id")).alias("m"))
    # the distance is the first figure of a whole match, the second of a part
    distance = F.when(F.col("m.kind") == PART, F.col("m.tie")).otherwise(F.col("m.cost"))
    got = best.select("field", "value", F.col("m.term_id").alias("term_id"), distance.alias("distance"))
    return distinct.join(got, ["field", "value"], "left").fillna({"term_id": 0, "distance": 0})


def mapped_endpoints(claims: DataFrame, terms: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(claim_id, side, field, term_id) of every endpoint value that is neither null nor blank nor a term as it stands.

    Copies of a claim count once. The join back is by value, each unique on the mapping's
    side, so a value that a third of all claims hold is split by AQE on the claims' side.
    """
    exact = terms.select("field", F.col("term").alias("value")).distinct()
    typed = endpoint_values(claims).where(r"value is not null and not value rlike '^[\\s\\x{A0}]*$'").join(exact, ["field", "value"], "left_anti")
    typed = cut(typed, "typed")
    return typed.join(map_values(typed, terms, shard_entries), ["field", "value"]).select("claim_id", "side", "field", "term_id")


def unmatched_report(claims: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, value, n): values that mean no entry, with their number of uses, most used first."""
    typed = cut(endpoint_values(claims).where(r"value is not null and not value rlike '^[\\s\\x{A0}]*$'"), "typed")
    none = map_values(typed, terms).where("term_id = 0").select("field", "value")
    return typed.groupBy("field", "value").agg(F.count("*").alias("n")).join(none, ["field", "value"])
