"""The training-data operators against brute force, round trips and planted cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import components, encoding, leakage, neighbours, packing, partition, scans, split, terms

# ---- 1: terms ------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_distance_and_tree_are_exact():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    for a, b in zip(words, reversed(words)):
        assert terms.levenshtein(a, b) == plain_distance(a, b)
    tree = terms.BKTree(words)
    for q in words[:40]:
        for most in (0, 1, 2):
            assert sorted(tree.within(q, most)) == sorted((d, w) for w in set(words) if (d := plain_distance(q, w)) <= most)


TERMS = [(1, "concept", "soil moisture", ["SM"]), (2, "concept", "root-zone soil water", []), (3, "concept", "evapotranspiration", ["ET"]), (4, "state", "increase", ["higher"]), (5, "concept", "surface albedo", [])]


def test_values_are_mapped(spark):
    t = spark.createDataFrame(TERMS, "term_id int, field string, term string, known_aliases array<string>")
    cases = {
        "Soil  moisture ": 1, "sm": 1, "moisture, soil": 1, "moisture of the soil": 1, "soil moisure": 1, "mean soil_moisture anomaly": 1, "root-. soil water": 2, "evapotrans.": 3,
        "ｓｕｒｆａｃｅ ａｌｂｅｄο": 5, "farm income": 0, "???": 0, "x" * 50_000: 0,
    }
    v = spark.createDataFrame([("concept", k) for k in cases] * 2 + [("concept", None), ("nofield", "soil moisture")], "field string, value string")
    for shards in (terms.SHARD_ENTRIES, 2):
        got = {r["value"]: r["term_id"] for r in terms.map_values(v, t, shards).where("field = 'concept'").collect()}
        assert got == cases
    claims = spark.createDataFrame([("c", ("soil moisture", "higher"), ("SM", " ")), ("c", ("soil moisture", "higher"), ("SM", " ")), ("d", None, (None, "nope"))], "id string, from_ struct<concept:string,state:string>, to_ struct<concept:string,state:string>")
    rows = sorted(map(tuple, terms.mapped_endpoints(claims, t).collect()))
    assert rows == [("c", "from", "state", 4), ("c", "to", "concept", 1), ("d", "to", "state", 0)]


def test_shards_give_what_one_list_gives(spark):
    names = ["soil heat flux", "soil heat", "surface heat flux", "latent heat", "heat flux", "relative humidity", "relational humour", "boundary layer height", "boundary condition", "wind speed at the canopy top"]
    # more completions of one stem than any fixed number
    names += [f"relat{chr(97 + i // 26)}{chr(97 + i % 26)} humus" for i in range(120)]
    t = spark.createDataFrame([(i + 1, "concept", n, []) for i, n in enumerate(names)], "term_id int, field string, term string, known_aliases array<string>")
    rng = random.Random(6)
    typed = ["soil heat fxx", "relat. humidity", "bound. layer height", "mean bound. lay. heigt anomaly", "the soil heat flux", "relat. humus", "relatez humus", "heat fluxx latent", "speed of the wind at canopy top", "rel. humid."]
    for n in names[:40]:
        for _ in range(3):
            k = rng.randrange(len(n))
            typed.append(n[:k] + rng.choice(["", "x", "e", ". "]) + n[k + 1 :])
    v = spark.createDataFrame([("concept", x) for x in typed], "field string, value string")
    want = {tuple(r) for r in terms.map_values(v, t, 10_000).collect()}
    assert len(want) == len(set(typed)) and {r[2] for r in want} > {1, 6, 8}
    for shard in (40, 7):
        assert {tuple(r) for r in terms.map_values(v, t, shard).collect()} == want
    assert {r[2] for r in want if r[1] == "relatez humus"} != {0}


# ---- 2: scans ------------------------------------------------------------------


def test_trie_is_complete():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    trie = scans.Trie(words)
    for q in words[:60] + ["", "zzz"]:
        for most in (0, 1, 2):
            assert set(trie.within(q, most)) == {w for w in words if plain_distance(q, w) <= most}


BLOCK = "id string, paper_id string, order_ int, page int, block_type string, text string, deleted_at timestamp_ntz, loaded_at timestamp_ntz"


def scan_rows():
    rng = random.Random(12)
    body = "the surface layer deepened while soil moisture increased over the irrigated meadow near large-scale stations and albedo contrast".split()
    rows = []
    for p in range(12):
        for i in range(12):
            rows.append((f"P{p}:B{i}", f"P{p:07d}", i, i + 1, "paragraph", " ".join(rng.sample(body, len(body)) + rng.sample(body, len(body))), None, None))
    noisy = ["the surfacc layer decpened", "thc so1l moisture increa5ed", "ovcr the irrigafed mead0w", "m0isture contrcist", "albcdo contrasf near the stations"]
    for i in range(12):
        lines = [f"Journal of Dry Soils 12 (2001)   {i + 3}", noisy[i % 5], "soil mois-", "ture over the large-", "scale meadow " + " ".join(rng.sample(body, 4)) + ".", f"- {i + 1} -"]
        rows.append((f"S:B{i}", "S", i, i + 1, "paragraph", "\n".join(lines), None, None))
    rows.append(("S:T", "S", 12, 13, "table", "a | b\n7\n17\n27", None, None))
    rows += [("S:N", "S", 13, None, "paragraph", None, None, None), ("S:E", "S", 14, None, "paragraph", "", None, None)]
    return rows


def test_scan_defects_and_reflow(spark):
    df = spark.createDataFrame(scan_rows() + scan_rows()[:3], BLOCK)
    s = scans.Scan(df)
    by = defaultdict(set)
    for r in s.defects().collect():
        by[r["block_id"]].add(r["defect"])
    for i in range(12):
        assert {"header", "page_number", "hyphen"} <= by[f"S:B{i}"]
        assert "ocr" in by[f"S:B{i}"]
        assert not by[f"P3:B{i}"]
    assert not by["S:T"] and not by["S:N"] and not by["S:E"]
    text = {r["first_block_id"]: r["text"] for r in s.paragraphs().collect()}
    assert text["S:B1"].startswith("the soil moisture increased soil moisture over the large-scale meadow ")
    assert scans.scan_defects(df.limit(0)).count() == 0


def test_neighbours_rank_candidates(spark):
    """A misread form that may be either of two words, a form that is a word itself, and a number."""
    rng = random.Random(3)
    words = "water flows under pale rivers while winter brings sudden dry winds over hills".split()
    rows = []
    for p in range(12):
        for i in range(20):
            text = f"{rng.choice(words)} the cold lake froze {rng.choice(words)} and a hot bake rose {rng.choice(words)} since they came in 1993 {rng.choice(words)} a dark cave opens to the roof eave drips on roof eave drips"
            rows.append((f"P{p}:B{i}", f"P{p:07d}", i, i + 1, "paragraph", text + " " + " ".join(rng.sample(words, 8)) + ".", None, None))
    noisy = ["thc cold 1ake froze", "a hot 1ake rose so thc rivers", "to the roof cave drips wh1le", "the wintcr of l993 undcr hills", "vvater flovvs undcr pa1e rivers", "a dark cave opens so thcy", "brings suddcn vvinds ovcr"]
    for i in range(21):
        rows.append((f"S:B{i}", "S", i, i + 1, "paragraph", "The hills " + noisy[i % 7] + " while " + rng.choice(words) + ".", None, None))
    s = scans.Scan(spark.createDataFrame(rows, BLOCK))
    text = {r["first_block_id"]: r["text"] for r in s.paragraphs().collect()}
    parts = ["the cold lake froze", "a hot bake rose so the rivers", "to the roof eave drips while", "the winter of 1993 under hills", "water flows under pale rivers", "a dark cave opens so they", "brings sudden winds over"]
    assert [i for i in range(21) if parts[i % 7] not in text[f"S:B{i}"]] == [], text
    assert all(r["paper_id"] == "S" for r in s.misread.join(s.blocks.select("block_id", "paper_id"), "block_id").collect())


# ---- 3: split ------------------------------------------------------------------


def test_range_maximum_is_exact():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, 200)
    best = split.RangeMax(s)
    for _ in range(500):
        a, b = sorted(rng.integers(0, 201, 2).tolist())
        if a < b:
            assert best(a, b) == max(range(a, b), key=lambda i: (s[i], i))


@pytest.mark.parametrize("text", ["", "word " * 5000, "x" * 30_000, "One sentence here. " * 900 + "\n\n" + "Another, with clauses; and more. " * 400])
def test_pieces_cover_the_text(text):
    spans = split.cut_points(text, 300, 20)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b, hard), nxt in zip(spans, spans[1:] + [None]):
        assert split.tokens(b - a) <= 300
        if nxt:
            assert a < nxt[0] <= b and b - nxt[0] <= 70
            assert hard or text[b - 1].isspace()


def test_stretches_change_nothing(monkeypatch):
    text = "One sentence here, of some length. " * 700 + "\n\n" + "x" * 3000 + " Another; and more words to go on. " * 500
    want = split.cut_points(text, 300, 20)
    monkeypatch.setattr(split, "STRETCH", 1500)
    assert split.cut_points(text, 300, 20) == want and len(want) > 40


def test_split_blocks(spark):
    rows = [("a", "P", ["S"], 1, "word " * 2000), ("a", "P", ["S"], 1, "word " * 2000), ("b", "P", None, 2, "x" * 5250), ("c", "P", None, 3, "x" * 5251), ("n", "P", None, 4, None), ("e", "P", None, 5, "")]
    df = spark.createDataFrame(rows, "id string, paper_id string, section_path array<string>, order_ int, text string")
    assert {r[0] for r in split.oversized_blocks(df).collect()} == {"a", "c"}
    got = split.split_oversized(df)
    assert got.where("n_tokens > 1500").count() == 0 and got.where("block_id = 'e'").first()["n_tokens"] == 1 and got.where("block_id = 'n'").count() == 0


# ---- 4: components -------------------------------------------------------------


@pytest.mark.parametrize("most", [100_000, 7])
def test_groups(spark, most):
    rng = random.Random(4)
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    star = [("hub", f"leaf{i:03d}") for i in range(80)]
    loose = [(f"r{rng.randrange(60):02d}", f"r{rng.randrange(60):02d}") for _ in range(45)]
    pairs = chain + star + loose + [(b, a) for a, b in chain[:20]]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in up}
    got = {r[0]: r[1] for r in components.connected_groups(spark.createDataFrame(pairs, "a string, b string"), most).collect()}
    assert got == want


def test_pairs_of_decisions(spark):
    rows = [("a", "b", " same "), ("b", "a", "SAME"), ("a", "a", "SAME"), ("c", None, "SAME"), ("d", "e", "DISTINCT"), ("d", "e", None)]
    df = spark.createDataFrame(rows, "left_id string, right_id string, decision string")
    assert sorted(map(tuple, components.connected_groups(components.same_pairs(df)).collect())) == [("a", "a"), ("b", "a")]
    assert components.connected_groups(components.same_pairs(df.limit(0))).count() == 0


# ---- 7: neighbours -------------------------------------------------------------


def vectors(n=900, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    for i in range(0, n - 1, 9):
        x[i + 1] = x[i] + rng.standard_normal(64) * rng.uniform(0, 0.6)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_similar_pairs_find_what_brute_force_finds(spark):
    x = vectors()
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)]
    dirty = [("null", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64)]
    df = spark.createDataFrame(rows + rows[:30] + dirty, "id string, e array<float>")
    v = neighbours.vectors(df, "e")
    got = {(r[1], r[2]) for r in neighbours.similar_pairs(v, 0.9).collect()}
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(s, 1) >= 0.9))}
    assert not got - want and len(got & want) >= 0.99 * len(want) > 20
    assert neighbours.similar_pairs(v.limit(0), 0.9).count() == 0


def test_partition_is_balanced_and_routes():
    x = vectors(2000)
    near = partition.neighbour_graph(x, 10)
    part = partition.balanced_partition(x, near, 16, np.random.default_rng(0))
    size = np.bincount(part, minlength=16)
    assert size.max() <= np.ceil(1.15 * 2000 / 16) + 1
    w = partition.fit(x, 16)
    assert partition.route(x, w, 4).shape == (2000, 4)


def clustered(n=6000, seed=8):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 60, 64))
    x = np.vstack([c + 0.35 * rng.standard_normal((60, 64)) for c in centers]).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_with_many_parts(spark):
    x = clustered()
    v = neighbours.vectors(spark.createDataFrame([(f"v{i:04d}", r.tolist()) for i, r in enumerate(x)], "id string, e array<float>"), "e")
    assert neighbours.fit_routers(v, part_rows=150)["e"].shape[1] == 40
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(s, 1) >= 0.9))}
    got = {(r[1], r[2]) for r in neighbours.similar_pairs(v, 0.9, part_rows=150).collect()}
    assert not got - want and len(got) >= 0.99 * len(want) > 1000
    whole = {(r[1], r[2]) for r in neighbours.similar_pairs(v, 0.9, neighbours.ALL_PARTS, part_rows=150).collect()}
    assert whole == want
    near, found = partition.neighbour_graph(x, 10), defaultdict(set)
    for r in neighbours.nearest(v, 10, part_rows=150).collect():
        found[r["id"]].add(r["neighbour_id"])
    hit = sum(len(found[f"v{i:04d}"] & {f"v{j:04d}" for j in row}) for i, row in enumerate(near))
    assert all(len(g) == 10 for g in found.values()) and hit / near.size >= 0.9


def test_blocks_of_which_one_side_is_empty(spark):
    x = clustered(120)
    v = neighbours.vectors(spark.createDataFrame([(f"v{i:04d}", r.tolist()) for i, r in enumerate(x)], "id string, e array<float>"), "e")
    # so many hash blocks that some hold no row: queries meet an empty index and the reverse
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(s, 1) >= 0.9))}
    assert {(r[1], r[2]) for r in neighbours.similar_pairs(v, 0.9, neighbours.ALL_PARTS, index_block=2).collect()} == want
    assert neighbours.nearest(v, 3, index_block=2).count() == 3 * 120


def test_ties_go_to_the_smaller_id(spark):
    x = clustered(120)
    rows = [(f"v{i:04d}", r.tolist()) for i, r in enumerate(x)] + [(f"copy{i:02d}", x[5].tolist()) for i in range(30)]
    got = neighbours.nearest(neighbours.vectors(spark.createDataFrame(rows, "id string, e array<float>"), "e"), 3).where("id = 'v0005'").orderBy("rank")
    assert [r["neighbour_id"] for r in got.collect()] == ["copy00", "copy01", "copy02"]


# ---- 8: packing ----------------------------------------------------------------


def test_histogram_packing():
    rng = random.Random(8)
    for cap in (10, 100, 2048):
        counts = Counter(rng.randrange(1, cap + 1) for _ in range(3000))
        placed = packing.pack_histogram(counts, cap)
        fill, seen, large = Counter(), Counter(), Counter()
        for size, first, n, at in placed:
            assert seen[size] == first
            seen[size] += n
            for k in range(n):
                fill[at + k] += size
                large[at + k] += size > cap // 3
        assert seen == counts and max(fill.values()) <= cap and max(large.values()) <= 2
        least = -(-sum(s * n for s, n in counts.items()) // cap)
        big = sum(n for s, n in counts.items() if s > cap // 2)
        assert len(fill) <= max(least, big) * 1.12 + 1


def test_documents_are_packed_whole(spark):
    rows = [(i, "soil moisture and heat " * (i % 60 + 1)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "long text of many words " * 3000), (1003, "soil moisture and heat ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack_documents(df, 512).collect()
    fill, pieces = Counter(), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["token_from"], r["n_tokens"]))
        if r["container_id"] is not None:
            fill[r["container_id"]] += r["n_tokens"]
    assert max(fill.values()) <= 512 and set(pieces) == {i for i, _ in rows}
    size = {r[0]: r[1] for r in packing.token_sizes(df).collect()}
    for d, ps in pieces.items():
        ps.sort()
        assert sum(n for _, _, n in ps) == size[d] and (len(ps) == 1 or size[d] > 512)
    assert pieces[1000] == [(0, 0, 0)] and packing.pack_documents(df.limit(0), 512).count() == 0


# ---- 9: leakage ----------------------------------------------------------------


def test_lcs():
    rng = random.Random(9)
    for _ in range(60):
        a, b = [[rng.choice("abcde") for _ in range(rng.randrange(0, 15))] for _ in range(2)]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert leakage.lcs(a, b) == d[-1][-1]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(10)
    vocab = [f"word{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(20)) + "?", " ".join(say(60))) for i in range(20)] + [(90, None, "too short"), (91, "", None)]
    docs, want = [], set()
    for d in range(150):
        ws = say(rng.choice([5, 40, 200]))
        if d % 3 == 0:
            i, q, p = items[rng.randrange(20)]
            src = rng.choice([q, p]).rstrip("?").split()
            n = rng.choice([11, 12, 13, 19])
            k = rng.randrange(len(src) - n + 1)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = src[k : k + n]
        docs.append((d, ", ".join(w.upper() if rng.random() < 0.3 else w for w in ws)))
    docs += [(500, None), (501, ""), (502, items[3][2]), (503, items[3][2])]
    runs = defaultdict(set)
    for i, q, p in items:
        for t in (q, p):
            ws = leakage.words(t)
            for k in range(len(ws) - 11):
                runs[tuple(ws[k : k + 12])].add(i)
    for d, t in docs:
        ws = leakage.words(t)
        for k in range(len(ws) - 11):
            want |= {(d, i) for i in runs.get(tuple(ws[k : k + 12]), ())}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, question string, passage string")
    got = {tuple(r) for r in leakage.leaked_items(df, it).collect()}
    assert not got - want and len(got) >= 0.98 * len(want) > 20
    assert (502, 3) in {(r["doc_id"], r["item_id"]) for r in leakage.paraphrased_items(df, it).collect()}
    assert {tuple(r) for r in leakage.leaked_items(df, it, leakage.EXACT).collect()} == want
    assert leakage.leaked_items(df.limit(0), it).count() == 0


def test_paraphrases_are_recalled(spark):
    """Items with a share of their words replaced, and short ones, within foreign text."""
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(8)), " ".join(say(40))) for i in range(40)]
    docs, planted = [], set()
    for d in range(200):
        ws = say(rng.choice([30, 120]))
        if d < 120:
            i, q, p = items[d % 40]
            src = (q if d % 3 == 0 else p).split()
            new = [rng.choice(vocab) if rng.random() < 0.12 else w for w in src]
            if sum(a == b for a, b in zip(src, new)) >= 0.75 * len(src):
                at = rng.randrange(len(ws) + 1)
                ws[at:at] = new
                planted.add((d, i))
        docs.append((d, " ".join(ws)))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.paraphrased_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, passage string"), answer=0.5).collect()}
    assert len(got & planted) >= 0.9 * len(planted) > 80 and len(got - planted) <= 2


# ---- 10: encoding --------------------------------------------------------------


def test_ways_invert():
    text = "Über § 12: “naïve” – 5 µm²"
    for way in ("utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp1252>utf-8>cp1252", "cp1252>cp437"):
        garbled = encoding.misread(text, way)
        assert garbled != text and encoding.reread(garbled, way) == text


SENTENCES = ["Die Bodenfeuchte über dem Grünland erhöhte sich um {n} %.", "La température près du sol s’élève à {n} °C lorsque la forêt a été coupée.", "Влажность почвы на станции снизилась на {n} %.", "Particles above {n} µm were removed."]


def test_garbled_documents(spark):
    rng = random.Random(11)
    clean = [(i, " ".join(rng.choice(SENTENCES).format(n=rng.randrange(99)) for _ in range(4))) for i in range(240)]
    bad = {}
    for k, way in enumerate(["utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "cp1252>cp437", "cp1251>koi8-r", "utf-8>cp1252>utf-8>cp1252"] * 3):
        s = SENTENCES[2] if "cp1251" in way else SENTENCES[k % 2]
        text = s.format(n=k) + " " + s.format(n=k + 1)
        bad[1000 + k] = (text, encoding.misread(text, way))
    rows = clean + [(d, g) for d, (_, g) in bad.items()] + [(5000, "Temp�rature"), (5001, None), (5002, ""), (5003, "plain ascii"), (5004, "SÃO À L’ÂGE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0] for r in encoding.garbled_documents(df).collect()}
    assert got == set(bad) | {5000}
    back = {r["doc_id"]: r["text"] for r in encoding.restore_documents(df).collect()}
    whole = [d for d, (t, _) in bad.items() if back[d] == t]
    assert len(whole) >= 0.8 * len(bad) and back[5000] == "Temp�rature"
    assert encoding.garbled_documents(df.limit(0)).count() == 0


def test_copies_do_not_outvote_clean_words(spark):
    rng = random.Random(5)
    clean = [(i, " ".join(SENTENCES[2].format(n=rng.randrange(10_000)) for _ in range(2))) for i in range(12)]
    bad = [encoding.misread(SENTENCES[2].format(n=k), "cp1251>cp1252") for k in range(2)]
    rows = clean + [(1000 + i, bad[0]) for i in range(90)] + [(2000, bad[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in encoding.garbled_documents(df).collect()} == {d for d, _ in rows if d >= 1000}
    assert {r["text"] for r in encoding.restore_documents(df).collect()} == {SENTENCES[2].format(n=k) for k in range(2)}


def test_alignment():
    assert encoding.aligned("CafÃ© dÃ©jÃ\xa0", "Café déjà") == [("é", "Ã©"), ("é", "Ã©"), ("à", "Ã\xa0")]
    assert encoding.aligned("aé", "éa") is None
    assert encoding.substitutions([("éà", "Ã©Ã\xa0"), ("’é", "abc")]) == [("é", "Ã©"), ("à", "Ã\xa0")]


def test_a_garbling_of_no_code_table_is_learned(spark):
    """An invented table, next to an accent that is merely written differently now and then."""
    table = {"é": "ᚠᛯ", "è": "ᚢ", "à": "ᚦᚨ", "ê": "ᚱ", "ô": "ᚲ", "ç": "ᚷᚹ", "û": "ᚺ"}
    rng = random.Random(7)
    words = "grès scène là voilà tête rêve drôle rôle leçon garçon goût coûte près forêt élevé température déjà contrôle façon août été récolte même côté sécheresse dégradé où".split()
    say = lambda: " ".join(f"{rng.choice('abcde')}la {w} du sol" for w in rng.sample(words, 6))
    clean = [(i, say()) for i in range(300)]
    odd = [(1000 + i, "ala " + rng.choice(["prés", "foret é", "élevè"]) + " du sol") for i in range(12)]
    bad = {2000 + i: say() for i in range(12)}
    garble = lambda t: "".join(table.get(c, c) for c in t)
    df = spark.createDataFrame(clean + odd + [(d, garble(t)) for d, t in bad.items()], "doc_id long, text string")
    assert {r[0] for r in encoding.garbled_documents(df).collect()} == set(bad)
    back = {r["doc_id"]: r["text"] for r in encoding.restore_documents(df).collect()}
    assert sum(back[d] == t for d, t in bad.items()) >= 10


def test_empty_tables_and_clashing_columns(spark):
    ends = "struct<concept:string,state:string>"
    claims = spark.createDataFrame([("c", ("soil moisure", None), ("", "higher"), "x", 7, "y")], f"id string, from_ {ends}, to_ {ends}, value string, term_id int, field string")
    t = spark.createDataFrame(TERMS, "term_id int, field string, term string, known_aliases array<string>").withColumn("value", F.lit("clash"))
    assert sorted(map(tuple, terms.mapped_endpoints(claims, t).collect())) == [("c", "from", "concept", 1), ("c", "to", "state", 4)]
    assert sorted(map(tuple, terms.mapped_endpoints(claims, t.limit(0)).collect())) == [("c", "from", "concept", 0), ("c", "to", "state", 0)]
    assert terms.mapped_endpoints(claims.limit(0), t).count() == 0
    docs = spark.createDataFrame([(1, "some words of a text that holds no item at all, long enough for a window", 5), (2, None, 6)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([], "item_id long, question string, passage string")
    assert leakage.leaked_items(docs, items).count() == 0 and leakage.paraphrased_items(docs, items).count() == 0
    blocks = spark.createDataFrame([("a", "P", ["S"], 1, "word " * 2000, 3, "z")], "id string, paper_id string, section_path array<string>, order_ int, text string, piece int, block_id string")
    assert [r[0] for r in split.oversized_blocks(blocks).collect()] == ["a"] and split.oversized_blocks(blocks.limit(0)).count() == 0
