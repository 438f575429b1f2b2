"""Noise in text from scanned pages: furniture, cut words, misread characters, reflow.

Page numbers and running headers are found by line: by form and by their agreement with
the page, and by repetition within the paper, exact or nearly so. What is left reads on
across lines and blocks; a word cut at a line's end is told from a compound by which of
the two the corpus writes. Misread words are looked up with Levenshtein automata run over
a trie of the corpus' own vocabulary, which returns every word within two edits; which
replacements are misreadings is learned from the papers whose words hold stray digits.
Candidates are then ranked for each occurrence by its neighbours: by how often the corpus
writes the candidate after the word before and before the word after. A form that is
itself a word counts as misread only where its neighbours say so.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.session import cut, records

#: Hyphens that a line may end with: plain, Unicode, soft, and the not sign that scanners put for them (fixed values).
HYPHENS = "-‐¬­"
#: A word explains another one that is so many times rarer, in the corpus or between the same neighbours.
RARER = 10
#: Words of one trie; a larger vocabulary is searched shard by shard.
TRIE_WORDS = 50_000
#: A misreading is at least so many times as frequent in noisy papers as elsewhere.
NOISY = 5.0
#: Share of a paper's words that show the signs of misreading where the paper is a noisy scan.
NOISY_SHARE = 0.0005
#: Share of a paper's pages on which a line must recur to be a running header, unless it looks like one.
RECURS = 0.08
NO_TEXT = ("equation", "table")
#: A replacement that needs no further support: a digit within a word that has none.
DIGIT_FOR_LETTER = "[0-9].*>[^0-9]+$"
#: The reverse: a letter within a number.
LETTER_FOR_DIGIT = "^[a-z]>[0-9]$"
WORD = re.compile(r"[^\W_]+")
#: Letters that are misread for digits, in lower case, and the digits (fixed values).
LETTERS, FIGURES = "liosbz", "110582"
#: Bits of the filter that says which words one pass over the text has to look at.
FILTER_BITS = 1 << 22


def _number(c: Column) -> Column:
    """The page a page-number line names; null for Roman numbers and other lines."""
    return F.regexp_extract(F.translate(c, "OolI", "0011"), r"(\d+)", 1).try_cast("int")


def _page_form(c: Column) -> Column:
    n = r"[0-9OolI]*[0-9][0-9OolI]*"
    t = F.trim(c)
    forms = (
        ("page", rf"(?i)^(page|p\.?|pg\.?)\s*{n}$"), ("of", rf"(?i)^(page\s*)?{n}\s*(/|of)\s*{n}$"), ("dash", rf"^[–—\-~*·|]+\s*{n}\s*[–—\-~*·|]+$"),
        ("bracket", rf"^[\[(<{{]\s*{n}\s*[\])>}}]$"), ("plain", rf"^{n}$"),
        ("roman", r"^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"),
    )
    return F.coalesce(*[F.when(t.rlike(p), F.lit(f)) for f, p in forms])


def _key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "))


def block_records(blocks: DataFrame) -> DataFrame:
    slim = blocks.select(F.col("id").alias("block_id"), "paper_id", "order_", "page", "block_type", "text")
    return records(slim, "block_id")


def furniture(b: DataFrame) -> DataFrame:
    """(block_id, line, kind): the lines that hold only a page number or a running header."""
    lines = b.where("text is not null").select(
        "block_id", "paper_id", "page", "block_type", F.posexplode(F.split("text", r"\r?\n")).alias("line", "t")
    )
    lines = cut(lines.where("trim(t) <> ''").withColumn("form", _page_form(F.col("t"))).withColumn("key", _key(F.col("t"))), "lines")

    # page numbers: the form says it, and a plain number must go with the paper's pages
    numbered = lines.where("form is not null").withColumn("off", _number(F.col("t")) - F.col("page"))
    steady = numbered.where("form = 'plain' and off is not null and block_type <> 'table'").groupBy("paper_id").agg(F.median("off").alias("mid"), F.count("*").alias("k"))
    numbered = numbered.join(steady, "paper_id", "left")
    near = F.coalesce(F.abs(F.col("off") - F.col("mid")) <= 1, F.lit(False))
    sure = F.col("form").isin("page", "of", "dash", "bracket", "roman") & ((F.col("block_type") != "table") | (F.col("form") != "roman"))
    plain = (F.col("form") == "plain") & F.when(F.col("block_type") == "table", near).otherwise(F.col("off").isNull() | (F.col("k") < 3) | near)
    pages = numbered.where(sure | plain).select("block_id", "line", F.lit("page_number").alias("kind"))

    # running headers: lines that recur in the paper
    rest = lines.where(r"form is null and key <> '' and not t rlike '[.,;:\\-‐¬­]\\s*$'")
    capital = F.regexp_count("t", F.lit(r"\b[\p{Lu}]")) / F.greatest(F.lit(1), F.regexp_count("t", F.lit(r"\b\p{L}[\p{L}\p{N}]{3,}")))
    looks = (capital >= 0.6) | F.col("t").rlike(r"\||\(\d{4}\)|\s{3}|(?i)\bet al\b")
    body = rest.where(~F.col("block_type").isin(*NO_TEXT))
    pages_of = b.groupBy("paper_id").agg(F.count_distinct("page").alias("n_pages"))
    alone = ~((F.col("block_type") == "heading") & (F.col("line") == 0))
    seen = body.where(alone).groupBy("paper_id", "key").agg(F.count_distinct("block_id").alias("n"), F.max(looks).alias("looks")).join(pages_of, "paper_id")
    often = F.col("n") >= F.greatest(F.lit(2.0), RECURS * F.col("n_pages"))
    own = seen.where(often & (F.col("looks") | ((F.col("n") >= 4) & (F.col("n") >= 2 * RECURS * F.col("n_pages"))))).select("paper_id", "key")
    own = cut(own, "headers")
    # a header that several papers carry is known even where a paper shows it once
    shared = own.groupBy("key").agg(F.count("*").alias("papers")).where("papers >= 3").select("key")
    exact = body.join(own, ["paper_id", "key"], "left_semi").where(alone | looks)
    common = rest.join(shared, "key", "left_semi")
    # such a header with an author or a title before or after it
    w = F.split("key", " ")
    parts = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(w) - 1)), lambda i: F.array(F.array_join(F.slice(w, 1, i), " "), F.array_join(F.slice(w, -i, i), " ")))
    longer = body.where(looks & (F.size(w) > 2) & (F.col("block_type") != "reference")).withColumn("part", F.explode(F.array_distinct(F.flatten(parts))))
    longer = longer.join(shared.where("length(key) >= 12").withColumnRenamed("key", "part"), "part", "left_semi")
    # a misread header: few letters off one of the paper's headers. A header fills its share of the pages,
    # so a paper has at most as many as a page has lines over that share, however large it is
    most = F.floor(F.length("known") / 5)
    close = body.where(alone | looks).join(own.select("paper_id", F.col("key").alias("known")), "paper_id").where(
        (F.abs(F.length("key") - F.length("known")) <= most) & (F.levenshtein("key", "known") <= most)
    )
    in_table = rest.where(F.col("block_type").isin(*NO_TEXT)).join(own, ["paper_id", "key"], "left_semi")
    heads = [x.select("block_id", "line") for x in (exact, common, longer, close, in_table)]
    head = heads[0]
    for h in heads[1:]:
        head = head.unionByName(h)
    return pages.unionByName(head.distinct().withColumn("kind", F.lit("header")).join(pages.select("block_id", "line"), ["block_id", "line"], "left_anti"))


LEFT = f"([\\p{{L}}]+)[{HYPHENS}]\\s*$"


def running_lines(b: DataFrame, marks: DataFrame) -> DataFrame:
    """Each block with its lines of running text and the first such line of the next block."""
    per = marks.groupBy("block_id").agg(F.collect_set("line").alias("off"))
    own = b.where("text is not null").join(per, "block_id", "left")
    body = F.filter(
        F.transform(F.split("text", r"\r?\n"), lambda x, i: F.when(F.coalesce(F.array_contains("off", i), F.lit(False)) | (F.trim(x) == ""), F.lit(None)).otherwise(x)),
        lambda x: x.isNotNull(),
    )
    own = cut(own.select("block_id", "paper_id", "order_", "block_type", body.alias("lines")), "running")
    nxt = own.select("paper_id", (F.col("order_") - 1).alias("order_"), F.get("lines", F.lit(0)).alias("next_line"), F.col("block_type").alias("next_type"))
    # a block without running text, or one missing in the order, ends what came before it
    return own.join(nxt.dropDuplicates(["paper_id", "order_"]), ["paper_id", "order_"], "left")


def breaks(lines: DataFrame) -> DataFrame:
    """(block_id, line, left, right, sign): lines that end in a hyphen, with what stands next."""
    x = lines.where(~F.col("block_type").isin(*NO_TEXT)).select("block_id", "next_line", F.posexplode("lines").alias("line", "t"), F.col("lines"))
    x = x.where(F.col("t").rlike(LEFT)).withColumn("after", F.coalesce(F.get("lines", F.col("line") + 1), F.col("next_line")))
    right = F.regexp_extract("after", r"^\s*([\p{L}\p{N}]+)", 1)
    sign = F.regexp_extract("t", f"([{HYPHENS}])\\s*$", 1)
    return x.select("block_id", "line", F.lower(F.regexp_extract("t", LEFT, 1)).alias("left"), F.lower(right).alias("right"), right.alias("raw"), sign.alias("sign")).where("right <> ''")


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(paper_id, word, n, low): words and hyphenated pairs of the lines, without what a line break may have cut; low counts those in lower case."""
    pair = re.compile(r"([^\W\d_]+)-([^\W\d_]+)")
    for p in batches:
        n: Counter = Counter()
        low: Counter = Counter()
        for paper, lines in zip(p.paper_id, p.lines, strict=True):
            for w in line_words(lines):
                n[(paper, w.lower())] += 1
                low[(paper, w.lower())] += not w[0].isupper()
            for t in lines:
                n.update((paper, f"{a}-{b}") for a, b in pair.findall(t.lower()))
        yield pd.DataFrame([(*k, c, low[k]) for k, c in n.items()], columns=["paper_id", "word", "n", "low"])


def line_words(lines) -> Iterator[str]:
    cut_before = False
    for t in lines:
        found = WORD.findall(t)
        ends = t.rstrip()[-1:] in HYPHENS
        yield from found[1 if cut_before else 0 : len(found) - (1 if ends else 0)]
        cut_before = ends


def cuts(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(block_id, line, word): the breaks that cut a word in two, with the whole word.

    The corpus decides: the joined form against the compound with its hyphen. Where it
    knows neither, two words that it knows make a compound; anything else was cut.
    """
    h = breaks(lines)
    total = counts.groupBy("word").agg(F.sum("n").alias("n"))
    h = h.withColumn("joined", F.concat("left", "right")).withColumn("compound", F.concat_ws("-", "left", "right"))
    for c in ("joined", "compound", "left", "right"):
        h = h.join(total.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left").fillna({f"n_{c}": 0})
    letters = ~F.col("raw").rlike(r"[\p{N}\p{Lu}]")
    known = (F.col("n_left") >= RARER) & (F.col("n_right") >= RARER)
    is_cut = F.when(F.col("n_joined") != F.col("n_compound"), F.col("n_joined") > F.col("n_compound")).otherwise(letters & ~known)
    return h.where(is_cut).select("block_id", "line", F.col("joined").alias("word"))


class Trie:
    """A vocabulary by letters; ``within`` runs the Levenshtein automaton of a word over it."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, most: int) -> list[str]:
        """Every word of the trie at most ``most`` edits away.

        The automaton's states are kept as one bit a position and one number for each edit
        spent; a branch is left as soon as no state survives.
        """
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        end = 1 << n
        full = (end << 1) - 1
        start = tuple(((1 << (e + 1)) - 1) & full for e in range(most + 1))
        out, todo = [], [(self.root, start)]
        while todo:
            node, states = todo.pop()
            for c, below in node.items():
                if c == "":
                    if states[-1] & end:
                        out.append(below)
                    continue
                hit = at.get(c, 0)
                prev = (states[0] & hit) << 1
                new = [prev]
                for e in range(1, most + 1):
                    # match, insertion and substitution of c, then deletions of the word's letters
                    s = ((states[e] & hit) << 1) | states[e - 1] | (states[e - 1] << 1) | (prev << 1)
                    prev = s & full
                    new.append(prev)
                if new[-1]:
                    todo.append((below, tuple(new)))
        return out


def core(wrong: str, right: str) -> tuple[str, str]:
    """What is left of two words without their common head and tail."""
    i = 0
    while i < min(len(wrong), len(right)) and wrong[i] == right[i]:
        i += 1
    j = 0
    while j < min(len(wrong), len(right)) - i and wrong[-1 - j] == right[-1 - j]:
        j += 1
    return wrong[i : len(wrong) - j], right[i : len(right) - j]


def replacements(wrong: str, right: str) -> list[str] | None:
    """What was put for what, 'ri>n', at each place where the words differ; null if a side is empty or long."""
    a, b = core(wrong, right)
    if len(a) <= 2 and len(b) <= 2:
        return [f"{a}>{b}"] if a and b else None
    m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    if not m.size:
        return None
    head, tail = (a[: m.a], b[: m.b]), (a[m.a + m.size :], b[m.b + m.size :])
    ops = [x for x in (head, tail) if x[0] or x[1]]
    return [f"{x}>{y}" for x, y in ops] if all(0 < len(x) <= 2 and 0 < len(y) <= 2 for x, y in ops) else None


CANDIDATE = "word string, n long, right string, n_right long, ops array<string>"


def _lookup(tries_b):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, uses = tries_b.value
        for p in batches:
            rows = []
            for w, n in zip(p.word, p.n, strict=True):
                for v in trie.within(w, 2 if len(w) > 3 else 1):
                    if uses[v] >= n and v != w:
                        ops = replacements(w, v)  # a misread character leaves something in its place
                        if ops:
                            rows.append((w, n, v, uses[v], ops))
            yield pd.DataFrame(rows, columns=["word", "n", "right", "n_right", "ops"])

    return run


def candidates(total: DataFrame) -> DataFrame:
    """(word, n, right, n_right, ops): the words within reach of each word that are at least as common, and the numbers that digits with letters among them may be.

    ``total``: word, n. The vocabulary is worked on shard by shard; each shard's finds are
    written before the next one is sent out. Words of digits are no part of it.
    """
    sc = total.sparkSession.sparkContext
    # whatever explains a word at all has RARER uses
    vocabulary = cut(total.where((F.col("n") >= RARER) & ~F.col("word").rlike(r"\d")), "vocabulary")
    shards = max(1, math.ceil(vocabulary.count() / TRIE_WORDS))
    asked = total.where(F.regexp_count("word", F.lit(r"\p{L}")) >= F.when(F.length("word") < 3, 1).otherwise(2))
    asked = asked.repartition(max(8, sc.defaultParallelism * 2), "word")
    found = None
    for s in range(shards):
        words = {r["word"]: r["n"] for r in vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == s).collect()}  # at most about TRIE_WORDS
        tries_b = sc.broadcast((Trie(list(words)), words))
        part = cut(asked.mapInPandas(_lookup(tries_b), CANDIDATE), "candidates")
        tries_b.destroy()
        found = part if found is None else found.unionByName(part)
    # numbers: at least two digits, no more look-alike letters than digits
    shape = F.col("word").rlike(f"^[0-9{LETTERS}]+$") & (F.regexp_count("word", F.lit("[0-9]")) >= F.greatest(F.lit(2), F.regexp_count("word", F.lit("[a-z]")))) & F.col("word").rlike("[a-z]")
    figure = F.translate("word", LETTERS, FIGURES)
    letters = F.array_distinct(F.filter(F.split("word", ""), lambda c: c.rlike("[a-z]")))
    numbers = total.where(shape).select("word", "n", figure.alias("right"), F.transform(letters, lambda c: F.concat(c, F.lit(">"), F.translate(c, LETTERS, FIGURES))).alias("ops"))
    uses = total.select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    return found.unionByName(numbers.join(uses, "right", "left").fillna({"n_right": 0}).select("word", "n", "right", "n_right", "ops"))


def _commoner(plain: DataFrame, found: DataFrame, signs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(word, right, n, n_right, k, words, sure) all of whose replacements are much commoner in the papers that show the signs; and those papers.

    ``sure``: the word is RARER times rarer than what it stands for and no word of quiet papers.
    """
    marked = plain.join(signs.withColumn("sign", F.lit(1)), "word", "left").groupBy("paper_id")
    share = marked.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("sign") == 1, F.col("n")).otherwise(0)).alias("signs"))
    noisy = cut(share.select("paper_id", "all", ((F.col("signs") >= least) & (F.col("signs") / F.col("all") >= NOISY_SHARE)).alias("noisy")), "noisy")
    size = {r["noisy"]: r["t"] for r in noisy.groupBy("noisy").agg(F.sum("all").alias("t")).collect()}
    n_noisy, n_clean = size.get(True, 0) or 1, size.get(False, 0) or 1
    where = plain.join(noisy.select("paper_id", "noisy"), "paper_id").groupBy("word").agg(
        F.sum(F.when(F.col("noisy"), F.col("n")).otherwise(0)).alias("in_noisy"), F.sum(F.when(~F.col("noisy"), F.col("n")).otherwise(0)).alias("in_clean"),
        F.sum("low").alias("low"),
    )
    rare = (F.col("n_right") >= RARER * F.col("n")) | F.col("right").rlike("^[0-9]+$")
    cand = cut(found.withColumn("rare", rare).join(where, "word"), "cand")
    more = lambda a, b: F.col(a) / n_noisy >= NOISY * F.col(b) / n_clean
    # names are built from the same syllables: they show nothing about characters
    single = cand.where("rare and size(ops) = 1 and low > 0").groupBy(F.col("ops")[0].alias("op"))
    ways = single.agg(F.count_distinct("word").alias("words"), F.sum("in_noisy").alias("wn"), F.sum("in_clean").alias("wc")).where(((F.col("words") >= 3) | F.col("op").rlike(DIGIT_FOR_LETTER) | F.col("op").rlike(LETTER_FOR_DIGIT)) & more("wn", "wc"))
    # a rare word may stand in any paper; one that is usual in quiet papers is a word
    sure = F.col("rare") & (more("in_noisy", "in_clean") | (F.col("in_clean") <= 2))
    steps = cand.select("word", "right", "n", "n_right", sure.alias("sure"), F.size("ops").alias("k"), F.explode("ops").alias("op")).join(ways.select("op", "words"), "op")
    ok = steps.groupBy("word", "right", "n", "n_right", "k", "sure").agg(F.count("*").alias("known"), F.min("words").alias("words")).where("known = k")
    return ok, noisy.where("noisy").select("paper_id")


def misreadings(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, right, n, n_right, k, words, sure): what words may be misread from; and the noisy papers. From the words' counts by paper.

    Rows that are not ``sure`` need the evidence of an occurrence's neighbours.
    """
    plain = counts.where(r"not word rlike '-' and word rlike '\\p{L}'")
    total = cut(plain.groupBy("word").agg(F.sum("n").alias("n")).unionByName(counts.where("word rlike '^[0-9]+$'").groupBy("word").agg(F.sum("n").alias("n"))), "totals")
    found = cut(candidates(total), "found")

    # a digit within a word that has none is a sure sign: papers that show it are noisy. What is
    # commoner there than elsewhere is a misreading, and shows which other papers are noisy
    signs = found.where((F.col("n_right") >= RARER * F.col("n")) & F.exists("ops", lambda x: x.rlike(DIGIT_FOR_LETTER))).select("word").distinct()
    ok, _ = _commoner(plain, found, signs, 1)
    ok, noisy = _commoner(plain, found, cut(ok.where("sure").select("word").distinct().union(signs).distinct(), "signs"), 2)
    ok = cut(ok, "ok")
    # a word that is always capital may be a name: then the name it stands for is in the same paper
    names = plain.groupBy("word").agg(F.sum("low").alias("low")).where("low = 0").select("word", F.lit(True).alias("name"))
    named = ok.join(names, "word").select("word", "right").join(plain.select("word", "paper_id"), "word")
    named = named.join(plain.select(F.col("word").alias("right"), "paper_id"), ["right", "paper_id"], "left_semi").select("word", "right").distinct()
    return cut(ok.join(names, "word", "left_anti").unionByName(ok.join(named, ["word", "right"], "left_semi")), "misread"), noisy


def _bit(c: Column) -> Column:
    return F.pmod(F.crc32(c.cast("binary")), F.lit(FILTER_BITS)).cast("int")


def word_filter(words: DataFrame) -> np.ndarray:
    """A bit for the hash of each of the words: FILTER_BITS bits, whatever their number. Strangers may share a bit; joins settle that."""
    per = words.select(_bit(F.col("word")).alias("b")).groupBy(F.floor(F.col("b") / 512).alias("at")).agg(F.collect_set(F.col("b") % 512).alias("on"))
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for r in per.toLocalIterator():  # at most FILTER_BITS numbers in all
        bits[r["at"] * 512 + np.array(r["on"])] = True
    return np.packbits(bits)


OCCURRENCE = "block_id string, word string, before string, after string, n long"


def _occurrences(filters_b):
    """Occurrences of suspected words with their neighbours, and counts of the neighbourhoods of what they may stand for (no block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        suspect, right = (np.unpackbits(f).astype(bool) for f in filters_b.value)
        known: dict[str, tuple[bool, bool]] = {}

        def kind(w: str) -> tuple[bool, bool]:
            k = known.get(w)
            if k is None:
                h = zlib.crc32(w.encode()) % FILTER_BITS
                k = known[w] = (bool(suspect[h]), bool(right[h]))
            return k

        for p in batches:
            rows, near = [], Counter()
            if len(known) > 500_000:
                known.clear()
            for b, lines in zip(p.block_id, p.lines, strict=True):
                ws = [w.lower() for w in line_words(lines)]
                last = len(ws) - 1
                for i, w in enumerate(ws):
                    asked, answer = kind(w)
                    if asked or answer:
                        before, after = ws[i - 1] if i else "", ws[i + 1] if i < last else ""
                        if asked:
                            rows.append((b, w, before, after, 1))
                        near[(w, before, None)] += 1
                        near[(w, None, after)] += 1
            rows += [(None, *k, n) for k, n in near.items()]
            yield pd.DataFrame(rows, columns=["block_id", "word", "before", "after", "n"])

    return run


def in_context(text: DataFrame, cuts: DataFrame, ok: DataFrame, noisy: DataFrame) -> DataFrame:
    """(block_id, word, before, after, right, sure): the misread occurrences and what stands there, judged by their neighbours.

    Sure misreadings are ranked by the neighbours and the commonness of what they may stand
    for. A form that is a word is misread only in a noisy paper, and only where the corpus
    writes the other word RARER times as often between the same neighbours.
    """
    sc = text.sparkSession.sparkContext
    filters_b = sc.broadcast((word_filter(ok.select("word").distinct()), word_filter(ok.select(F.col("right").alias("word")).distinct())))
    seen = cut(text.select("block_id", "lines").mapInPandas(_occurrences(filters_b), OCCURRENCE), "occurrences")
    filters_b.destroy()
    near = seen.where("block_id is null").groupBy("word", "before", "after").agg(F.sum("n").alias("n"))
    left = cut(near.where("before is not null").select("word", "before", "n"), "left")
    right = cut(near.where("after is not null").select("word", "after", "n"), "right")
    # words that a line's end cut in two stand without known neighbours
    none = F.lit("")
    own = seen.where("block_id is not null").select("block_id", "word", "before", "after").unionByName(cuts.select("block_id", "word", none.alias("before"), none.alias("after")))
    papers = text.select("block_id", "paper_id").join(noisy.withColumn("noisy", F.lit(True)), "paper_id", "left").select("block_id", F.coalesce("noisy", F.lit(False)).alias("noisy"))
    own = cut(own.join(ok.select("word").distinct(), "word", "left_semi").distinct().join(papers, "block_id"), "suspects")
    at = own.select("word", "before", "after").distinct()
    x = at.join(ok, "word")
    with_left = lambda df, w, n: df.join(left.select(F.col("word").alias(w), "before", F.col("n").alias(n)), [w, "before"], "left")
    with_right = lambda df, w, n: df.join(right.select(F.col("word").alias(w), "after", F.col("n").alias(n)), [w, "after"], "left")
    x = with_right(with_left(x, "right", "rl"), "right", "rr")
    x = with_right(with_left(x, "word", "wl"), "word", "wr").fillna(0, ["rl", "rr", "wl", "wr"])
    # at a block's edge an empty neighbour tells nothing
    told = lambda c, n: F.when(F.col(c) == "", 0).otherwise(F.col(n))
    theirs, mine = told("before", "rl") + told("after", "rr"), told("before", "wl") + told("after", "wr")
    x = x.withColumn("evident", (theirs >= RARER) & (theirs >= RARER * mine) & (told("before", "rl") > 0) & (told("after", "rr") > 0))
    x = x.where("sure or evident")
    # one misreading ranks before two, then the neighbours speak, then the replacement seen with most words and the commoner word
    rank = F.struct(F.col("sure"), -F.col("k"), F.log1p(theirs) + F.log1p(F.col("words") * F.log1p("n_right")), F.col("right"))
    best = x.groupBy("word", "before", "after").agg(F.max_by(F.struct("right", "sure"), rank).alias("b"))
    got = own.join(best, ["word", "before", "after"]).where("b.sure or noisy")
    return got.select("block_id", "word", "before", "after", F.col("b.right").alias("right"), F.col("b.sure").alias("sure"))


class Scan:
    """The stages of one run over a table of blocks, each computed once."""

    def __init__(self, blocks: DataFrame):
        self.blocks = cut(block_records(blocks), "blocks")
        self.furniture = cut(furniture(self.blocks), "furniture")
        self.lines = cut(running_lines(self.blocks, self.furniture), "lines")
        text = self.lines.where(~F.col("block_type").isin(*NO_TEXT)).select("paper_id", "block_id", "lines")
        seen = text.mapInPandas(_words, "paper_id string, word string, n long, low long").groupBy("paper_id", "word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))
        self.counts = cut(seen, "counts")
        self.cuts = cut(cuts(self.lines, self.counts), "cuts")
        whole = self.cuts.join(self.blocks.select("block_id", "paper_id"), "block_id").groupBy("paper_id", "word").agg(F.count("*").alias("n"), F.count("*").alias("low"))
        ok, noisy = misreadings(self.counts.unionByName(whole).groupBy("paper_id", "word").agg(F.sum("n").alias("n"), F.sum("low").alias("low")))
        self.misread = cut(in_context(text, self.cuts, ok, noisy), "context")

    def defects(self) -> DataFrame:
        """(block_id, defect), each once."""
        wrong = self.misread.select("block_id", F.lit("ocr").alias("defect"))
        kinds = self.furniture.select("block_id", F.col("kind").alias("defect"))
        return kinds.unionByName(self.cuts.select("block_id", F.lit("hyphen").alias("defect"))).unionByName(wrong).distinct()

    def paragraphs(self) -> DataFrame:
        """(paper_id, paragraph, first_block_id, n_blocks, text): the repaired text, paragraph by paragraph.

        ``paragraph`` is the order of its first block. A block runs on into the next one of
        the same kind if a word was cut between them, or if it ends without a full stop and
        the next starts in lower case. Tables and equations keep their lines.
        """
        per_cut = self.cuts.groupBy("block_id").agg(F.collect_set("line").alias("cut_lines"))
        fixes = self.misread.groupBy("block_id").agg(F.collect_set(F.struct("word", "before", "after", "right", "sure")).alias("fixes"))
        own = self.lines.join(per_cut, "block_id", "left").join(fixes, "block_id", "left")
        done = own.select("block_id", "paper_id", "order_", "block_type", "next_line", "next_type", "lines", "cut_lines", "fixes").mapInPandas(
            _reflow, "block_id string, paper_id string, order_ int, text string, runs_on boolean"
        )
        done = cut(done, "reflowed")
        # a paragraph starts where the block before does not run on: a running maximum in two levels,
        # so that no task holds all blocks of a paper
        before = done.where("runs_on").select("paper_id", (F.col("order_") + 1).alias("order_")).distinct().withColumn("joined", F.lit(True))
        s = done.join(before, ["paper_id", "order_"], "left").withColumn("start", F.when(F.col("joined").isNull(), F.col("order_")))
        s = s.withColumn("part", F.floor(F.col("order_") / 512))
        s = s.withColumn("in_part", F.max("start").over(W.partitionBy("paper_id", "part").orderBy("order_")))
        last = s.groupBy("paper_id", "part").agg(F.max("start").alias("last"))
        last = last.withColumn("carried", F.max("last").over(W.partitionBy("paper_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
        s = s.join(last.select("paper_id", "part", "carried"), ["paper_id", "part"]).withColumn("paragraph", F.coalesce("in_part", "carried", "order_"))
        g = s.groupBy("paper_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("order_", "block_id", "text"))).alias("b"))
        text = F.regexp_replace(F.array_join(F.transform("b", lambda x: x["text"]), " "), "\u0002 ?", "")
        return g.select("paper_id", "paragraph", F.col("b")[0]["block_id"].alias("first_block_id"), F.size("b").alias("n_blocks"), text.alias("text"))


def _cased(right: str, like: str) -> str:
    return right.upper() if like.isupper() and len(like) > 1 else right.capitalize() if like[:1].isupper() else right


def _corrected(text: str, fix: dict[tuple[str, str, str], str], alone: dict[str, str]) -> str:
    found = list(WORD.finditer(text))
    ws = ["", *(m[0].lower() for m in found), ""]
    out, at = [], 0
    for i, m in enumerate(found, 1):
        right = fix.get((ws[i], ws[i - 1], ws[i + 1])) or alone.get(ws[i])
        if right:
            out += [text[at : m.start()], _cased(right, m[0])]
            at = m.end()
    return "".join([*out, text[at:]])


def _reflow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for r in p.itertuples(index=False):
            lines = list(r.lines)
            if r.block_type in NO_TEXT:
                rows.append((r.block_id, r.paper_id, r.order_, "\n".join(lines), False))
                continue
            off = set(r.cut_lines) if r.cut_lines is not None else set()
            fixes = list(r.fixes) if r.fixes is not None else []
            fix = {(x["word"], x["before"], x["after"]): x["right"] for x in fixes}
            # next to a word that was cut in two the neighbours are not those that were seen
            alone = {x["word"]: x["right"] for x in fixes if x["sure"]}
            text = ""
            for i, t in enumerate(lines):
                t = t.strip()
                if i in off:
                    text += t.rstrip(HYPHENS) + "\u0002"
                else:
                    # a compound's hyphen stays and needs no space after it
                    text += t if t[-1:] == "-" and t[-2:-1].isalnum() else t + " "
            text = text.rstrip(" ")
            cut_at_end = text.endswith("\u0002")
            text = text.replace("\u0002", "") + ("\u0002" if cut_at_end else "")
            if fix:
                text = _corrected(text, fix, alone)
            goes_on = r.block_type == r.next_type and isinstance(r.next_line, str) and r.next_line.strip()[:1].islower() and text.rstrip()[-1:] not in ".!?:"
            rows.append((r.block_id, r.paper_id, r.order_, text, bool(cut_at_end or goes_on)))
        yield pd.DataFrame(rows, columns=["block_id", "paper_id", "order_", "text", "runs_on"])


def scan_defects(blocks: DataFrame) -> DataFrame:
    """(block_id, defect) with defect hyphen, ocr, header or page_number.

    Copies of a block count once; withdrawn blocks count; a null or empty text has no
    defect; a null page leaves a plain number to its form; an empty table gives no rows.
    """
    return Scan(blocks).defects()
