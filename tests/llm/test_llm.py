"""Training-data operators on small tables, against plain versions and defined results."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import canonical, components, lookalike, mixing, overlap, splits, subjects, textnorm, tokens


# --- forms of text -----------------------------------------------------------------------------------


def test_visual_and_fold():
    assert textnorm.visual("Ｔｒａｄｅ dеbtоrs") == "Trade debtors"
    assert textnorm.visual("café ﬁn​­") == "café fin"
    assert textnorm.visual("²½") == "²½" and textnorm.visual("") == "" and textnorm.visual(None) is None
    assert textnorm.visual("A  b") == "A  b" and textnorm.visual("Trade") != textnorm.visual("trade")
    assert textnorm.fold("Écart d’ACQUISITION_& more") == "ecart dacquisition and more"
    assert textnorm.fold("إجمالي الأرباحـ") == "اجمالي الارباح" and textnorm.fold(None) is None and textnorm.fold(" .. ") == ""
    assert textnorm.fold("Ｓ．Ａ．＆ co", glue=".") == "sa and co" and textnorm.fold("owner＇s") == "owners"
    assert textnorm.read_digits("m0ney") == "money" and textnorm.read_digits("2024") == "2024" and textnorm.read_digits("h1") == "h1"


def _plain_distance(a, b):
    d = {(-1, -1): 0}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if i == j == -1:
                continue
            ways = []
            if i >= 0:
                ways.append(d[i - 1, j] + 1)
            if j >= 0:
                ways.append(d[i, j - 1] + 1)
            if i >= 0 and j >= 0:
                ways.append(d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    ways.append(d[i - 2, j - 2] + 1)
            d[i, j] = min(ways)
    return d[len(a) - 1, len(b) - 1]


def test_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        want = _plain_distance(a, b)
        for most in (0, 1, 2, 4):
            assert textnorm.distance(a, b, most) == min(want, most + 1)


# --- components and splits ---------------------------------------------------------------------------


def _union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rng = random.Random(6)
    edges = {"random": [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)], "path": [(f"n{i}", f"n{i + 1}") for i in range(40)], "star": [("hub", f"n{i}") for i in range(60)]}[kind]
    df = spark.createDataFrame([*edges, *edges[:5], (None, "x"), ("loop", "loop")], "u STRING, v STRING")
    rows = components.components(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == _union_find([e for e in edges if e[0] != e[1]])
    assert all(c in g for c, g in got.items()) and len(rows) == len({r.node for r in rows})


def test_hubs_are_split(spark):
    """A node with many neighbours is split over branches, and its component stays whole."""
    edges = [("hub", f"n{i}") for i in range(60)] + [("hub", "other")] + [("other", f"m{i}") for i in range(30)] + [("x", "y")]
    df = spark.createDataFrame(edges, "u STRING, v STRING")
    both = df.union(df.select("v", "u"))
    assert max(r["count"] for r in components.split_hubs(both, 40).groupBy("u").count().collect()) <= 40
    got = {}
    for r in components.components(df, hub=40).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == _union_find(edges) and all(components.BRANCH not in n for g in got.values() for n in g)


def test_lists_stay_in_place(spark, monkeypatch):
    """Lists that fill the partitions are exchanged once: a step joins its frontier to them as they lie."""
    monkeypatch.setattr(components, "LINKS_A_PART", 5)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(0, 60, 2)] + [("n0", "n2"), ("n2", "n4")]
    got = {}
    for r in components.components(spark.createDataFrame(edges, "u STRING, v STRING")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == _union_find(edges)
    lists = components.in_place(spark.createDataFrame(edges, "u STRING, v STRING").repartition(8, "u"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lists.join(spark.createDataFrame([("n0", "x")], "node STRING, label STRING"), lists["u"] == F.col("node"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1


def test_components_empty(spark):
    assert components.components(spark.createDataFrame([], "u STRING, v STRING")).count() == 0


SOURCES = "source_id STRING, issuer STRING, cik STRING, extra STRING, component STRING"


def test_issuer_groups(spark):
    rows = [
        ("a1", "The Alpha Beta Foods Co. Ltd", None), ("a2", "ALPHA BETA FOODS S.A.", "CIK 0012"), ("a3", "Αlpha Bеta Foods plc", "12.0"), ("a4", "Aplha Beta Foods", None), ("a5", "Gamma Delta Foods Inc.", "0000000012"), ("a6", "Gamma Detla Foods", None),
        ("b1", "Alpha Zeta Foods", "13"), ("b2", None, " 13 "), ("c1", None, None), ("c2", None, None), ("d1", "Co", None), (None, "Alpha Beta Foods", None), ("a1", "The Alpha Beta Foods Co. Ltd", None),
    ]
    df = spark.createDataFrame([(*r, "x", "clash") for r in rows], SOURCES)
    pairs = {tuple(r) for r in splits.grouped_pairs(splits.issuer_groups(df)).collect()}
    assert pairs == {("a1", x) for x in ("a2", "a3", "a4", "a5", "a6")} | {("b1", "b2")}
    assert splits.grouped_pairs(splits.issuer_groups(df.limit(0))).count() == 0


def test_pools_keep_groups_whole(spark):
    rng = random.Random(3)
    groups = spark.createDataFrame([(f"s{i}", f"c{i // 3}") for i in range(900)], "source_id STRING, component STRING")
    weights = spark.createDataFrame([(f"s{i}", float(rng.randrange(1, 9) if i > 2 else 1500)) for i in range(900)], "source_id STRING, records DOUBLE")
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15), (None, 0.3), ("zero", 0.0)], "pool STRING, share DOUBLE")
    out = splits.assign_pools(groups, weights, targets).join(weights, "source_id").collect()
    assert len(out) == 900 and len({(r.component, r.pool) for r in out}) == 300
    total = sum(r.records for r in out)
    for pool, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
        assert abs(sum(r.records for r in out if r.pool == pool) / total - share) < 0.02
    assert splits.assign_pools(groups.limit(0), weights, targets).count() == 0


# --- canonical list ----------------------------------------------------------------------------------

ENTRIES = [("cash", "Cash at hand and at banks"), ("debtors", "Trade debtors"), ("creditors", "Trade creditors"), ("sum", "Assets in total"), ("short", "Short-term assets in total"), ("margin", "Gross trading margin"), ("ar", "ذمم العملاء المدينة"), ("twice", "Same words"), ("other", "same WORDS")]


@pytest.mark.parametrize(("value", "item"), [
    ("Trade debtors", "debtors"), ("TRADE DEBTORS (note 12)", "debtors"), ("b) Trade debtors *", "debtors"), ("Total: Short-term assets in total", "short"), ("Short-term asets in total (note 9)", "short"), ("Trde debotrs", "debtors"),
    ("Tradedebtors", "debtors"), ("Debtors, trade", "debtors"), ("Cash at hand & at bnks", "cash"), ("Gr. trading margin", "margin"), ("ذمم العملاء المدينه - إيضاح 4", "ar"), ("Ｔｒａｄｅ ｄеｂｔｏｒｓ", "debtors"),
    (None, None), ("", None), ("   ", None), ("note 4", None), ("Trade debtors of the pension fund", None), ("Trade debtors and trade creditors", None), ("Trade fair", None), ("Same words", None), ("x" * 5000, None), ("Assets in trust", None),
])
def test_mapper(value, item):
    assert canonical.Mapper(ENTRIES)(value)[0] == item


def test_mapper_without_list():
    assert canonical.Mapper([])("Trade debtors") == (None, None, 0.0)


def test_found_items(spark):
    items = spark.createDataFrame([(i, "s") for i in sorted({e[0] for e in ENTRIES})], "item_id STRING, statement STRING")
    aliases = spark.createDataFrame(ENTRIES, "item_id STRING, alias STRING")
    rows = [("1", "Trade debtors", None), ("2", "Trade debtors", "debtors"), ("3", "Trade debtors", "Debtors "), ("4", None, None), ("5", "unknown", "cash"), ("1", "Trade debtors", None)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "record_id STRING, label STRING, canonical_id STRING, item_id STRING, score DOUBLE")
    mapped = canonical.map_values(df, items, aliases)
    assert sorted(tuple(r) for r in canonical.found_items(mapped, items).collect()) == [("1", "debtors"), ("3", "debtors")]
    assert {r.record_id: r.typed_item for r in mapped.collect()} == {"1": None, "2": "debtors", "3": "debtors", "4": None, "5": "cash"}
    assert {(r.label, r.records) for r in canonical.unmatched(mapped).collect()} == {(None, 1), ("unknown", 1)}
    assert canonical.map_values(df.limit(0), items, aliases).count() == 0


# --- look-alikes -------------------------------------------------------------------------------------


def test_trie_walk():
    trie = lookalike.Trie([(1, "Trade debtors"), (2, "Trésorerie"), (3, "Trade debts")])
    assert trie.walk("Тrade debtors‍") == (1, 0) and trie.walk("Trésorerie") == (2, 0) and trie.walk("trade debtors") is None and trie.walk("Trade  debtors") is None and trie.walk("") is None
    assert trie.walk("Trade debtor", 1) == (1, 1) and trie.walk("Trade debtss", 1) == (3, 1) and trie.walk("rade debts", 1) == (3, 1) and trie.walk("Trade deb", 1) is None
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    t = lookalike.Trie(enumerate(words))

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, e = [i] + [0] * len(b), d
            for j, y in enumerate(b, 1):
                d[j] = min(e[j] + 1, d[j - 1] + 1, e[j - 1] + (x != y))
        return d[-1]

    for _ in range(200):
        q = "".join(rng.choice("ab") for _ in range(rng.randrange(7)))
        best = min(plain(q, w) for w in words)
        hit = t.walk(q, 2)
        assert (hit[1] if hit else None) == (best if best <= 2 else None)


def test_disguised(spark):
    aliases = spark.createDataFrame([(1, "Trade debtors", "x"), (2, "Écart", "x"), (None, "Null", "x")], "alias_id LONG, alias STRING, lang STRING")
    rows = [("a", "Trade debtors"), ("b", "Trade debtors"), ("c", "trade debtors"), ("d", None), ("e", ""), ("f", "Écart"), ("g", "Ecart"), ("b", "Trade debtors"), ("h", "Ｆｒｅｅ text"), ("i", "Trade debtors ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id STRING, label STRING, form STRING")
    forms = lookalike.canonical_form(df, aliases)
    assert sorted(tuple(r) for r in lookalike.disguised(forms).collect()) == [("b", 1), ("f", 2)]
    assert {r.record_id: r.form for r in forms.collect()}["h"] == "Free text"
    assert lookalike.canonical_form(df.limit(0), aliases).count() == 0


# --- overlap -----------------------------------------------------------------------------------------

FRAMES = ["Deferred portion of the {} silo rebuilding scheme agreed with {}, lot {}", "Cost of relocating herds from the {} pasture to the {} dairy, trip {}", "Refund due on customs bonds for the {} turbines shipped via {}, crate {}"]


def _lines(rng, n):
    name = lambda: "".join(rng.choice(["ba", "ko", "ri", "zem", "tol", "vax"]) for _ in range(3)).capitalize()
    return [(k, FRAMES[k % 3].format(name(), name(), rng.randrange(1000))) for k in range(n)]


def test_near_pairs(spark):
    rng = random.Random(7)
    rows = [(f"t{k}", "s", "train", line) for k, line in _lines(rng, 300)]
    base = {k: line for k, line in _lines(random.Random(7), 300)}
    want = set()

    def add(ident, k, text):
        rows.append((ident, "e", "validation" if k % 2 else "test", text))
        want.add((f"t{k}", ident))

    add("e0", 0, base[0])
    add("e1", 1, base[1].upper() + " *")
    add("e2", 2, base[2].replace("customs", "cutsoms").replace("shipped", "shpped"))
    add("e3", 3, base[3].replace("the ", "", 1))
    add("e4", 4, base[4].replace("of relocating", "relocating of"))
    add("e5", 5, base[5].replace(" ", " ").replace("o", "о"))
    rows += [("x1", "e", "test", base[6].replace("lot", "lot 9")), ("x2", "e", "test", base[9].replace(base[9].split()[4], "Unknownia")), ("x3", "e", None, base[12]), ("x4", "e", "test", None), ("x5", "e", "train", base[15]), ("x6", "e", "test", ""), ("e0", "e", "test", base[0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id STRING, source_id STRING, pool STRING, label STRING, canon STRING")
    got = {(r.train_id, r.eval_id) for r in overlap.pairs(overlap.near_classes(df)).collect()}
    extra = {p for p in got - want if p[1][0] == "x" or {base[int(p[0][1:])]} != {base[int(dict((b, a) for a, b in want)[p[1]][1:])]}}
    assert want <= got and not extra
    none = overlap.near_classes(df.limit(0))
    assert overlap.pairs(none).count() == 0 and overlap.report(none).count() == 0 and overlap.classes(none).count() == 0


def _brute(found):
    """Pairs and report from the members and links, by hand."""
    members = [(r.record_id, r.source_id, r.pool, bytes(r["class"])) for r in found.members.collect()]
    links = {(bytes(a), bytes(b)) for a, b in found.links.select("train_class", "eval_class").collect()}
    pairs = [(a[0], b) for a in members if a[2] == "train" for b in members if b[2] != "train" and (a[3], b[3]) in links]
    records, counts = {}, Counter()
    for _, b in pairs:
        records.setdefault((b[2], b[1]), set()).add(b[0])
        counts[b[2], b[1]] += 1
    return {(a, b[0]) for a, b in pairs}, {k: (len(v), counts[k]) for k, v in records.items()}


def test_copies_are_counted_not_paired(spark):
    """Two hundred copies a side make one link, and the report counts all pairs."""
    line = "cost of relocating the harbour depot to the northern quay before the summer season"
    other = "gain on the sale of two cranes at the southern terminal after the storm of autumn"
    rows = [(f"t{k}", f"s{k % 3}", "train", line) for k in range(200)] + [(f"e{k}", f"s{k % 2}", "test" if k % 2 else "validation", line.upper() if k % 5 else line) for k in range(200)] + [("o1", "s9", "train", other), ("o2", "s9", "test", other + " *"), ("t0", "s0", "train", line)]
    found = overlap.near_classes(spark.createDataFrame(rows, "record_id STRING, source_id STRING, pool STRING, label STRING"))
    assert found.links.count() == 2 and found.members.count() == 402
    pairs, report = _brute(found)
    assert {tuple(r) for r in overlap.pairs(found).collect()} == pairs and len(pairs) == 40_001
    assert {(r.pool, r.source_id): (r.records, r.pairs) for r in overlap.report(found).collect()} == report
    assert {(r.record_id, r.links) for r in overlap.classes(found).where("record_id LIKE 'o%'").collect()} == {("o1", 1), ("o2", 1)}


def test_a_corpus_twice_the_size_reads_alike(spark):
    """Texts of the same kind added to a corpus change no link between those that were there."""
    rng = random.Random(21)
    lines = [line for _, line in _lines(rng, 600)]
    rows = [(f"t{k}", "s", "train", line) for k, line in enumerate(lines[:300])]
    rows += [(f"e{k}", "s", "test", lines[k].replace("customs", "cutsoms").replace("the ", "", k % 2)) for k in range(0, 60, 3)]
    more = [(f"m{k}", "s", None, line) for k, line in enumerate(lines[300:])]
    schema = "record_id STRING, source_id STRING, pool STRING, label STRING"
    one, two = ({tuple(r) for r in overlap.pairs(overlap.near_classes(spark.createDataFrame(x, schema))).collect()} for x in (rows, rows + more))
    assert one == two and one >= {(f"t{k}", f"e{k}") for k in range(0, 60, 3)}


def test_same_files(spark):
    h = "ab" * 32
    files = spark.createDataFrame([("a", h), ("b", h.upper()), ("c", "sha256:" + h), ("d", " " + h[:16]), ("e", h[:16] + "0" * 48), ("f", None), ("g", "abc"), ("h", h)], "file_id STRING, sha256 STRING")
    sources = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "validation"), ("d", "test"), ("e", "test"), ("f", "test"), ("g", "test"), ("h", None)], "source_id STRING, pool STRING")
    assert {(r.train_id, r.eval_id) for r in overlap.pairs(overlap.same_files(files, sources)).collect()} == {("a", "b"), ("a", "c"), ("a", "d")}


# --- tokens and mixing -------------------------------------------------------------------------------


def _reference():
    import base64

    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_encoder_equals_library():
    lib, ranks = _reference()
    rng = random.Random(11)
    texts = ["", " ", "\n\n \t x", "<|endoftext|>", "a" * 3000, "abab" * 700, "👩‍👩‍👧‍👦 text", "é́" * 50, "المجموع العام", "\x00\x07", "x" * 40_000]
    texts += ["".join(rng.choice("ab cd.'ét1 9ا\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    encoder = tokens.Encoder()
    for t in texts:
        ids = encoder(t)
        assert ids == lib.encode_ordinary(t)
        assert b"".join({v: k for k, v in ranks.items()}[i] for i in ids).decode() == t if len(t) < 100 else True
    assert encoder(None) == []


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "a text", "s", 9), (2, None, "s", 9), (3, "", None, 9), (None, "x", "s", 9)], "doc_id LONG, text STRING, source STRING, ids INT")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 2 and len(got) == 4
    assert tokens.encode(df.limit(0)).count() == 0
    assert {(r.source, r.documents, r.empty) for r in tokens.sizes_by_source(df).collect()} == {("s", 3, 1), (None, 1, 1)}


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(k, "big" if k % 10 < 7 else "mid" if k % 10 < 9 else "small", rng.randrange(1, 60)) for k in range(4000)] + [(9001, "stray", 10), (9002, None, 10), (9003, "big", 0), (1, "mid", 7), (None, "big", 5)]
    df = spark.createDataFrame(docs, "doc_id LONG, source STRING, tokens LONG").dropDuplicates(["doc_id"])
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("none", 0.05, 4), (None, 0.1, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    picked, report = mixing.mix(df, targets)
    rows, sums = picked.collect(), {r.source: r for r in report.collect()}
    most = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.times <= most[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(sums[s].actual_share - share / 0.95) < 0.01 and 0 <= sums[s].budget - sums[s].tokens < 60 * 2 and not sums[s].short
    assert sums["none"].tokens == 0 and sums["none"].short
    again = {r.doc_id for r in mixing.mix(df.repartition(7), targets)[0].collect()}
    assert again == {r.doc_id for r in rows}
    has = spark.createDataFrame([("a", 1000), ("b", 10)], "source STRING, has LONG")
    scarce = {r.source: (r.budget, r.rounds, r.rest) for r in mixing.budgets(has, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.0, 1), ("d", None, None)], "source STRING, target_share DOUBLE, max_repeats INT"), 0.5).collect()}
    assert scarce == {"a": (252, 0, 252), "b": (20, 2, 0), "c": (0, 0, 0), "d": (0, 0, 0)}
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_shards(spark):
    """A vocabulary in shards gives what it gives in one piece."""
    names = [(k, f"caption {k} of é{k % 7}") for k in range(60)] + [(60, "Ａbc"), (61, "Abc")]
    aliases = spark.createDataFrame(names, "alias_id LONG, alias STRING")
    texts = [(str(k), t) for k, t in enumerate(["caption 5 of e\u03015", "captiоn 13 of é6", "Abc", "Аbc", "caption", "x Abc y", None, "", "caption 5  of é5", "caption 8 of é2"])]
    df = spark.createDataFrame(texts, "record_id STRING, label STRING")
    for most in (0, 1):
        whole, parts = (sorted(map(tuple, lookalike.canonical_form(df, aliases, most, n).select("record_id", "alias_id", "cost").collect())) for n in (1000, 7))
        assert whole == parts
    forms = {r.record_id: r.form for r in lookalike.canonical_form(df, aliases, 0, 7).collect()}
    assert forms["2"] == forms["3"] and forms["6"] is None


def test_list_in_shards(spark):
    """A canonical list in parts gives what it gives in one piece."""
    items = spark.createDataFrame([(f"item_{k}",) for k in range(20)], "item_id STRING")
    aliases = spark.createDataFrame([(f"item_{k % 20}", f"{'red blue green'.split()[k % 3]} harbour {'crane depot vessel anchor quay'.split()[k % 5]} {k // 15}") for k in range(45)] + [("item_1", "twin name"), ("item_2", "Twin Name")], "item_id STRING, alias STRING")
    values = ["red harbour crane 0", "RED harbour crane 0 (note 4)", "red harbur crane 0", "blue harbour", "twin name", None, "", "item 3", "red harbour crane 0 and blue harbour depot 1", "green harbour quay 2 restated"]
    df = spark.createDataFrame([(str(k), v, t) for k, v in enumerate(values) for t in (None, "item_7", "item 7", "itm_7")], "record_id STRING, label STRING, canonical_id STRING")
    whole, parts = (sorted(canonical.map_values(df, items, aliases, n).collect(), key=repr) for n in (1000, 9))
    assert whole == parts and sum(r.item_id is not None for r in whole) >= 16


# --- subjects ----------------------------------------------------------------------------------------

TOPICS = {"farm": "barley herd orchard tractor fodder silo".split(), "court": "judge tribunal lawsuit verdict counsel appeal".split(), "sea": "tanker harbour cargo vessel anchor crane".split()}


def _corpus(rng, n):
    docs, truth = [], []
    for k in range(n):
        own = rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 2]))
        parts = []
        for t in own:
            parts += [f"Spending on the {rng.choice(TOPICS[t])} rose owing to the {rng.choice(TOPICS[t])}." for _ in range(rng.randrange(3, 6))]
        parts += [rng.choice(["The statements were approved on the date shown.", "Figures may not add up owing to rounding.", "Cash at the close stood at 5 mn."]) for _ in range(rng.randrange(1, 5))]
        rng.shuffle(parts)
        docs.append((k, " ".join(parts)))
        truth.append({t for t in own if sum(any(w in p for w in TOPICS[t]) for p in parts) >= 0.2 * len(parts)})
    return docs, truth


def test_subjects(spark):
    docs, truth = _corpus(random.Random(8), 700)
    df = spark.createDataFrame([*docs, (1000, None), (1001, ""), (1002, "  \n "), (None, "judge"), docs[0]], "doc_id LONG, text STRING").withColumn("subject", F.lit("clash"))
    names = spark.createDataFrame([(t, " ".join(w[:2])) for t, w in TOPICS.items()], "subject STRING, gloss STRING")
    labels = spark.createDataFrame([(k, t) for k in range(200) for t in (truth[k] or {"none"})], "doc_id LONG, subject STRING")
    got = {}
    for r in subjects.subject_mixtures(df, names, labels).where(F.col("share") >= subjects.SHARE).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = range(200, 700)
    hit = sum(len(got.get(k, set()) & truth[k]) for k in held_out)
    assert hit / sum(len(got.get(k, set())) for k in held_out) > 0.97 and hit / sum(len(truth[k]) for k in held_out) > 0.97
    assert not {1000, 1001, 1002} & got.keys()
    assert subjects.subject_mixtures(df.limit(0), names, labels).count() == 0


def test_factorisation_never_loses_mass():
    rng = np.random.default_rng(1)
    rows = subjects.Rows.of([list(rng.integers(0, 20, 12)) for _ in range(30)])
    h = rng.random((4, 20))
    w = rows.mixtures(h / h.sum(1, keepdims=True), 5)
    assert np.allclose(w.sum(1), rows.size) and (w >= 0).all()
