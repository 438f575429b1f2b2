"""Text expressions. All but compatibility folding stay on the JVM side."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions import vocabulary as V


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(c: Column) -> Column:
    """Lower case of the compatibility form; only texts beyond ASCII travel to Python."""
    return F.lower(F.coalesce(_nfkc(F.when(c.rlike("[^\\x00-\\x7f]"), c)), c))


def text_key(c: Column) -> Column:
    """The comparison key of a text: null counts as empty."""
    return key_of(folded(F.coalesce(c, F.lit(""))))


def key_of(folded_text: Column) -> Column:
    """The key of a text whose forms and case are folded already; no Python, so it may stand in a lambda."""
    dashed = F.regexp_replace(folded_text, "[‐-―]", "-")
    return F.trim(F.regexp_replace(dashed, r"[^\p{L}\p{N}_%+./-]+", " "))


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_%+./-]+"), F.lit(0))


def plain_words(c: Column) -> Column:
    """Words in lower case, their forms as they are: for hashed vectors."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_%+./-]+"), F.lit(0))


def token_count(c: Column) -> Column:
    """The project's estimate: at least 1, else characters / 3.5 rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(c) * 2 / F.lit(7.0))).cast("int")


def _aliases(groups: dict[str, tuple[str, ...]]) -> Column:
    def key(x: str) -> str:
        return re.sub(r"\s+", " ", re.sub(r"[^\w%+./-]+", " ", x.lower())).strip()

    flat = {key(a): name for name, many in groups.items() for a in (name, *many)}
    return F.create_map(*[F.lit(x) for pair in flat.items() for x in pair])


def canonical_concept(key: Column) -> Column:
    return F.coalesce(F.try_element_at(_aliases(V.CONCEPTS), key), key)


def canonical_direction(key: Column) -> Column:
    return F.coalesce(F.try_element_at(_aliases(V.DIRECTIONS), key), key)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def state_id(concept: Column, state: Column) -> Column:
    return F.concat(F.lit("state::"), slug(concept), F.lit("::"), slug(state))


def polarity(direction: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in V.POLARITY.items() for x in p]), direction)


def compatible(asked: Column, have: Column) -> Column:
    """An empty state asks for any; the three directed ones only match themselves."""
    directed = list(V.POLARITY)
    return F.when(asked == "", True).when(asked.isin(directed) | have.isin(directed), asked == have).otherwise(asked == have)


def section_bonus(path: Column) -> Column:
    s = text_key(F.array_join(path, " "))
    return F.when(s.contains("results") | s.contains("analysis"), 0.05).when(s.contains("discussion"), 0.02).otherwise(0.0)


def section_priority(path: Column, kind: str = "query") -> Column:
    """Rank of a section for evidence: kinds query, claim and context."""
    s = text_key(F.array_join(path, " "))
    steps = {
        "query": ((5, ("results", "analysis")), (4, ("discussion",)), (3, ("conclusion",)), (2, ("methods",))),
        "claim": ((4, ("results", "analysis")), (3, ("discussion", "mechanism", "sensitivity")), (2, ("conclusion",)), (1, ("methods", "experimental design"))),
        "context": ((3, ("methods", "study area", "experimental design")), (2, ("results",)), (1, ("discussion",))),
    }[kind]
    out = F.lit(0)
    for value, names in reversed(steps):
        hit = F.lit(False)
        for n in names:
            hit = hit | s.contains(n)
        out = F.when(hit, value).otherwise(out)
    return out


def spatial_families(key: Column) -> Column:
    hits = [F.when(F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.contains(key, p)), F.lit(n)) for n, ps in V.SPATIAL_PHRASES.items()]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


_SIZE = r"[0-9]+(?:\.[0-9]+)?"
_UNIT = r"(?i:km|m)\b"
_BOX, _RANGE = rf"{_SIZE}\s*(?i:x)\s*{_SIZE}\s*{_UNIT}", rf"{_SIZE}\s*-\s*{_SIZE}\s*{_UNIT}"
#: What names a band of distances when it stands wholly within so many characters before or after a range (fixed values).
_BANDS, _BEFORE, _AFTER = ("annulus", "annuli", "halo"), 25, 15


def scales(c: Column) -> Column:
    """The spatial scales that a text names: array of (kind, low, high, unit, source), rectangles first, each kind in order.

    Ranges near the name of a band are marked in one replacement, whose lookarounds see the
    text as it was; the marks then tell the two kinds apart. A null text names none.
    """
    t = F.translate(F.coalesce(c, F.lit("")), "×–—", "x--")
    behind = "|".join(f"{w}.{{0,{_BEFORE - len(w)}}}" for w in _BANDS)
    ahead = "|".join(f".{{0,{_AFTER - len(w)}}}{w}" for w in _BANDS)
    whole = r"(?<![0-9])(?<![0-9]\.)"
    marked = F.regexp_replace(t, rf"(?s){whole}(?:(?<=(?i:{behind})){_RANGE}|{_RANGE}(?=(?i:{ahead})))", "\u0001$0")
    number = lambda x, i: F.regexp_extract(x, rf"({_SIZE})\s*[xX-]\s*({_SIZE})", i).cast("double")

    def found(x: Column, kind: Column) -> Column:
        unit = F.lower(F.regexp_extract(x, rf"({_UNIT})$", 1))
        return F.struct(kind.alias("kind"), number(x, 1).alias("low"), number(x, 2).alias("high"), unit.alias("unit"), F.ltrim(F.translate(x, "\u0001", "")).alias("source"))

    boxes = F.transform(F.regexp_extract_all(t, F.lit(_BOX), F.lit(0)), lambda x: found(x, F.lit("rectangle")))
    ranges = F.regexp_extract_all(marked, F.lit(f"\u0001?{_RANGE}"), F.lit(0))
    return F.concat(boxes, F.transform(ranges, lambda x: found(x, F.when(x.startswith("\u0001"), "distance_band").otherwise("range"))))


def query_mode(is_global: Column, source: Column, target: Column) -> Column:
    has = lambda c: c.isNotNull()
    return (
        F.when(F.coalesce(is_global, F.lit(False)), "global").when(has(source) & has(target), "a_to_b").when(has(source), "forward").when(has(target), "backward").otherwise("global")
    )


def endpoint_problem(concept: Column, state: Column, question: Column, is_target: bool) -> Column:
    """Why a parsed endpoint of a question is set aside; null if it stands."""
    ck, sk = text_key(concept), text_key(state)
    out = F.when(F.concat(F.lit(" "), sk, F.lit(" ")).contains(" or "), "comparative")
    if not is_target:
        return out
    return (
        F.when(sk.isin(*V.UNSPECIFIED), "unspecified_state")
        .when(question.rlike(r"(?i)\bwhere\b") & (ck.contains("location") | sk.contains("relative to")), "spatial_relation")
        .when(F.concat(F.lit(" "), sk, F.lit(" ")).contains(" or "), "comparative")
        .when((F.trim(F.coalesce(state, F.lit(""))) == "") & concept.rlike(r"(?i)\band\b"), "compound")
    )


def asks_globally(question: Column) -> Column:
    return question.rlike(r"(?i)\b(?:across (?:the )?(?:indexed )?(?:literature|studies)|global(?:ly)?|corpus-wide)\b")


def embedding_text(kind: str, **c: Column) -> Column:
    """The text that a record is embedded by."""
    if kind == "notion":
        return F.concat_ws(" | ", c["domain"], c["notion"])
    if kind == "content":
        return F.concat(F.lit("Domain: "), c["domain"], F.lit("\nNotion: "), c["notion"], F.lit("\nDescription: "), c["description"])
    if kind == "claim":
        side = lambda s: F.concat_ws(" | ", c[s]["concept"], c[s]["state"])
        return F.concat(F.lit("FROM: "), side("from_"), F.lit("\nTO: "), side("to_"), F.lit("\nRELATION: "), c["relation"], F.lit("\nDESCRIPTION: "), c["description"])
    if kind == "transition":
        return F.concat(F.lit("FROM CONTEXT: "), c["source"], F.lit("\nTO CONTEXT: "), c["target"], F.lit("\nTRANSITION: "), c["description"])
    raise ValueError(kind)
