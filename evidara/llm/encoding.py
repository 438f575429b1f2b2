"""Garbled text from a wrong character encoding.

Words are compared with their near-twins: words that look the same once non-ASCII
characters are stripped, between the same neighbours. Where one form of a twin group
dominates, a rarer one is aligned with it, character by character, between the ASCII
characters they share: what stands for what is learned from the pairs. Substitutions
that agree with "these bytes read with that table" vote for that pair of code tables,
which serve as a prior: a pair that is voted for explains the characters no twin shows.
Substitutions that no table explains make a table of their own, if what they put in is
found in garbled words only. What was learned is then applied to all words of the corpus:
forwards from the common words, and backwards where the garbled bytes are UTF-8, which
spells itself out, or where the learned table says so. Nothing here is fixed to a language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.session import cut

SPACE = re.compile(r"[ \t\n\r\f\v]+")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
DIGITS = re.compile(r"[0-9]+")
#: Characters that no text holds unless it was misread: the sign for a lost character, and the controls from 80 to 9f (fixed values).
LOST = "\ufffd"
MARKS = re.compile("[\x80-\x9f\ufffd]")
#: Single-byte tables that texts are commonly written and misread in (fixed values).
TABLES = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "cp852", "mac_roman", "iso8859-15", "cp1254", "mac_latin2")
#: Twin pairs that must show a transformation before it counts as learned.
MIN_PAIRS = 2
#: How much commoner the restored form must be than the garbled one, where the bytes don't prove it.
RATIO = 3
#: A learned substitution holds if so many words, and such a share of the words with what it puts in, are restored by it to words RATIO times as common.
MIN_WORDS, MIN_SHARE = 3, 0.5


@lru_cache(maxsize=None)
def _table(name: str) -> tuple[str, ...]:
    """256 characters; bytes that a table leaves open read as the control of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _back(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(name))))}


def misread(text: str, way: str) -> str | None:
    """``text`` written and read the way it says, e.g. ``utf-8>cp1252`` or, with a second leg, ``utf-8>cp1252>utf-8>cp1252``.

    ``~`` at the end: the invisible no-break space and soft hyphen that result were lost.
    """
    legs = way.rstrip("~").split(">")
    for source, read in zip(legs[::2], legs[1::2], strict=True):
        if source == "utf-8":
            raw = text.encode("utf-8", "surrogatepass")
        else:
            back = _back(source)
            if not all(c in back for c in text):
                return None
            raw = bytes(back[c] for c in text)
        text = "".join(map(_table(read).__getitem__, raw))
    return text.replace("\xa0", "").replace("\xad", "") if way.endswith("~") else text


def reread(text: str, way: str) -> str | None:
    """The text that ``misread`` made into this one, if the bytes allow it."""
    legs = way.split(">")
    for source, read in zip(legs[-2::-2], legs[::-2], strict=True):
        back = _back(read)
        if not all(c in back for c in text):
            return None
        raw = bytes(back[c] for c in text)
        try:
            text = raw.decode("utf-8") if source == "utf-8" else "".join(map(_table(source).__getitem__, raw))
        except UnicodeDecodeError:
            return None
    return text


def ways() -> list[str]:
    one = [f"utf-8>{t}" for t in TABLES]
    two = [f"{a}>{b}" for a in ("utf-8>cp1252", "utf-8>latin-1") for b in ("utf-8>cp1252", "utf-8>latin-1")]
    single = [f"{a}>{b}" for a in TABLES for b in TABLES if a != b]
    return one + two + [w + "~" for w in one + two] + single


def masked(word: str) -> str:
    return DIGITS.sub("#", word)


def _twin_key(words: list[str], i: int) -> str:
    """What identifies a word's place without its non-ASCII characters.

    Where too few ASCII letters remain (other scripts), the lengths of five words stand in.
    """
    near = [masked(NON_ASCII.sub("", words[k])) if 0 <= k < len(words) else "^" for k in (i - 1, i, i + 1)]
    if sum(c.isalpha() for c in near[1]) >= 2 or sum(c.isalpha() for x in near for c in x) >= 6:
        return " ".join(near)
    around = [f"{len(words[k])}{NON_ASCII.sub('', words[k])}" if 0 <= k < len(words) else "^" for k in range(i - 2, i + 3)]
    return "L " + masked(" ".join(around))


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(form, key, n): texts of the batch that hold a word with non-ASCII characters at this place; without a key: anywhere."""
    for p in batches:
        n: Counter = Counter()
        for text in p.text:
            if text is None or text.isascii():
                continue
            words = SPACE.split(text)
            at = {(masked(w), _twin_key(words, i)) for i, w in enumerate(words) if not w.isascii()}
            n.update(at | {(f, None) for f, _ in at})
        yield pd.DataFrame([(f, k, c) for (f, k), c in n.items()], columns=["form", "key", "n"])


def aligned(form: str, clean: str) -> list[tuple[str, str]] | None:
    """(clean stretch, what stands for it) between the ASCII characters that the two words share; null if they share them in another order."""
    parts = re.split("([^\x00-\x7f]+)", clean)
    m = re.fullmatch("([^\x00-\x7f]*)".join(re.escape(x) for x in parts[::2]), form)
    return list(zip(parts[1::2], m.groups(), strict=True)) if m else None


def substitutions(stretches: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(character, what stands for it), where a stretch has the same width for each of its characters."""
    out = []
    for c, g in stretches:
        width, odd = divmod(len(g), len(c))
        if width and not odd:
            out += [(x, g[i * width : (i + 1) * width]) for i, x in enumerate(c)]
    return out


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(form, clean, subs, ways) of twin pairs that can be aligned: the substitutions, and the code tables that explain them all."""
    every = ways()
    for p in batches:
        rows = []
        for g, c in zip(p.form, p.clean, strict=True):
            stretches = aligned(g, c)
            if stretches:
                explained = [w for w in every if all(misread(x, w) == y for x, y in stretches)]
                rows.append((g, c, [{"c": x, "s": y} for x, y in substitutions(stretches) if x != y], explained))
        yield pd.DataFrame(rows, columns=["form", "clean", "subs", "ways"])


def _restored(table: dict[str, str]):
    """(form, clean, s) of forms that hold what the table's substitutions put in."""
    found = re.compile("|".join(re.escape(s) for s in sorted(table, key=lambda s: (-len(s), s))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for form in p.form:
                hits = set(found.findall(form))
                if hits:
                    clean = found.sub(lambda m: table[m[0]], form)
                    rows += [(form, clean, s) for s in hits]
            yield pd.DataFrame(rows, columns=["form", "clean", "s"])

    return run


def own_table(unexplained: DataFrame, forms: DataFrame) -> dict[str, str]:
    """{what stands there: character} of the substitutions that no code table explains but the corpus confirms.

    ``unexplained``: form, clean, subs. An accent that is merely written differently fails:
    most words that hold it are right as they are.
    """
    seen = unexplained.select("form", "clean", F.explode("subs").alias("x")).groupBy("x.s", "x.c").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAIRS)
    table = {r["s"]: r["c"] for r in seen.groupBy("s").agg(F.max_by("c", F.struct("n", "c")).alias("c")).collect()}  # strings that stand for characters: bounded by the character sets
    table.pop(LOST, None)
    if not table:
        return {}
    tried = forms.select("form").mapInPandas(_restored(table), "form string, clean string, s string").join(forms.select("form", "n"), "form")
    tried = tried.join(forms.select(F.col("form").alias("clean"), F.col("n").alias("n_clean")), "clean", "left")
    good = F.coalesce(F.col("n_clean") >= RATIO * F.col("n"), F.lit(False))
    held = {r["s"]: (r["words"], r["good"]) for r in tried.groupBy("s").agg(F.count("*").alias("words"), F.count_if(good).alias("good")).collect()}
    sure = {s for s, (n, k) in held.items() if k >= MIN_WORDS and k >= MIN_SHARE * n}
    # next to such a one, a substitution seen in fewer words holds if it restores all of them
    return {s: c for s, c in table.items() if s in sure or (sure and s in held and held[s][0] == held[s][1])}


def _apply(learned: list[str], known: frozenset[str], minor: frozenset[str]):
    proven = [w for w in learned if w.startswith("utf-8") and not w.endswith("~")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for form, n, places in zip(p.form, p.n, p.places, strict=True):
                if not MARKS.search(form) and n >= RATIO:
                    major = {misread(form, w) for w in learned if w not in minor}
                    for g in (major | {misread(form, w) for w in minor}) - {None, form}:
                        rows.append((g, form, n, places, g not in major, False))
                for w in proven:
                    c = reread(form, w)
                    # only characters that aligned twins show as restored ones
                    if c and c != form and all(x.isascii() or x in known for x in c):
                        rows.append((form, c, 0, 0, False, True))
            yield pd.DataFrame(rows, columns=["form", "clean", "n_clean", "places_clean", "minor", "proven"])

    return run


@dataclass
class Learned:
    """forms (form, n, places); the ways and their minor ones; the characters they were seen to garble; the corpus' own table; twins of forms with marks."""

    forms: DataFrame
    ways: list[str]
    minor: frozenset[str]
    known: frozenset[str]
    table: dict[str, str]
    marked: DataFrame


def learn(docs: DataFrame) -> Learned:
    """What the corpus shows of its garblings. Copies of a text count once. A way is minor if more twin pairs show its reverse."""
    slim = docs.select("text").where(r"text rlike '[^\\x00-\\x7f]'").distinct()
    counted = cut(slim.mapInPandas(_forms, "form string, key string, n long").groupBy("form", "key").agg(F.sum("n").alias("n")), "forms")
    forms = counted.groupBy("form").agg(F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("n"), F.count("key").alias("places"))
    forms = cut(forms, "vocabulary")
    placed = counted.where("key is not null")
    # one dominant form a group, so a group of any size gives as many pairs as it has other forms
    top = placed.groupBy("key").agg(F.max_by("form", F.struct("n", "form")).alias("clean"), F.max("n").alias("n_clean"))
    twins = placed.join(top, "key").where((F.col("form") != F.col("clean")) & (F.col("n_clean") > F.col("n"))).select("form", "clean").distinct()
    spread = max(8, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    pairs = cut(twins.repartition(spread, "form", "clean").mapInPandas(_align, "form string, clean string, subs array<struct<c:string,s:string>>, ways array<string>"), "pairs")
    strong = pairs.where(F.char_length("clean") >= 3).select(F.explode("ways").alias("way"))
    votes = {r["way"]: r["count"] for r in strong.groupBy("way").count().collect()}  # at most len(ways())
    learned = sorted(w for w, n in votes.items() if n >= MIN_PAIRS)
    minor = frozenset(w for w in learned if votes[w] < votes.get(">".join(w.split(">")[::-1]), 0))
    explained = F.arrays_overlap("ways", F.array(*[F.lit(w) for w in learned]).cast("array<string>"))
    shown = pairs.where(explained).select(F.explode(F.split("clean", "")).alias("c")).where(r"c rlike '[^\\x00-\\x7f]'").groupBy("c").count()
    known = frozenset(r["c"] for r in shown.collect())  # characters: bounded by the character set
    marked = pairs.where(F.col("form").contains(LOST)).select("form", "clean")
    return Learned(forms, learned, minor, known, own_table(pairs.where(~explained), forms), marked)


def garbled_forms(docs: DataFrame) -> DataFrame:
    """(form, clean): garbled words, digits masked, with what they were; null where it is lost."""
    k = learn(docs)
    forms = k.forms
    cand = forms.mapInPandas(_apply(k.ways, k.known, k.minor), "form string, clean string, n_clean long, places_clean long, minor boolean, proven boolean")
    # a word of one letter says too little; a lone sign may be judged by how common it is
    telling = (F.char_length("form") > 1) | ~F.col("form").rlike(r"^\p{L}$")
    # against the direction that most pairs show, the clean form must stand in more places as well
    placed = ~F.col("minor") | (F.col("places_clean") >= RATIO * F.col("places"))
    hit = cand.join(forms, "form").where(F.col("proven") | ((F.col("n_clean") >= RATIO * F.col("n")) & telling & placed))
    hit = hit.select("form", "clean", "n_clean", F.col("proven").cast("int").alias("sure"))
    # the corpus' own table: all words that hold what it puts in
    own = [forms.select("form").mapInPandas(_restored(k.table), "form string, clean string, s string").select("form", "clean").distinct()] if k.table else []
    # twins of words that lost a character, where they are common enough
    lost = k.marked.join(forms, "form").join(forms.select(F.col("form").alias("clean"), F.col("n").alias("n_clean")), "clean").where(F.col("n_clean") >= RATIO * F.col("n"))
    for x in (*own, lost.select("form", "clean")):
        n = x.join(forms.select(F.col("form").alias("clean"), F.col("n").alias("n_clean")), "clean", "left").fillna({"n_clean": 0})
        hit = hit.unionByName(n.select("form", "clean", "n_clean", F.lit(0).alias("sure")))
    best = cut(hit.groupBy("form").agg(F.max_by("clean", F.struct("n_clean", "sure", "clean")).alias("clean")), "best")
    # what the marks give away and nothing restores is lost
    broken = forms.where(F.col("form").rlike("[\\x{80}-\\x{9f}\\x{fffd}]")).select("form")
    return cut(best.unionByName(broken.join(best, "form", "left_anti").withColumn("clean", F.lit(None).cast("string"))), "garbled")


def _doc_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = [(d, f) for d, t in zip(p.doc_id, p.text, strict=True) if t and not t.isascii() for f in {masked(w) for w in SPACE.split(t) if not w.isascii()}]
        yield pd.DataFrame(rows, columns=["doc_id", "form"])


def garbled_words(docs: DataFrame) -> DataFrame:
    """(doc_id, form, clean): each garbled form of each document once; null ids and texts have none."""
    own = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(_doc_forms, "doc_id long, form string")
    return own.join(garbled_forms(docs), "form")


def garbled_documents(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents with at least one garbled stretch."""
    return garbled_words(docs).select("doc_id").distinct()


def _restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for d, text, forms in zip(p.doc_id, p.text, p.forms, strict=True):
            clean = {f["form"]: f["clean"] for f in forms}
            done = lost = 0
            parts = re.split(r"([ \t\n\r\f\v]+)", text)
            for i in range(0, len(parts), 2):
                form = masked(parts[i])
                if form not in clean:
                    continue
                if clean[form] is None:
                    lost += 1
                    continue
                numbers = iter(DIGITS.findall(parts[i]))
                parts[i] = re.sub("#", lambda m: next(numbers, m[0]), clean[form])
                done += 1
            rows.append((d, "".join(parts), done, lost))
        yield pd.DataFrame(rows, columns=["doc_id", "text", "n_restored", "n_lost"])


def restore_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_restored, n_lost) of the affected documents; what cannot be recovered stays as it is.

    Documents without a garbled word, null texts and null ids give no row. Repeated rows
    of one doc_id are restored each.
    """
    per = garbled_words(docs).groupBy("doc_id").agg(F.collect_set(F.struct("form", "clean")).alias("forms"))
    return docs.select("doc_id", "text").where("text is not null").join(per, "doc_id").mapInPandas(_restore, "doc_id long, text string, n_restored int, n_lost int")
