"""Operators over small tables: shredding, units, sums, alignment, checks, datasets, splits, ranges, mapping."""

from __future__ import annotations

import json
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import checks, dataset, evaluate, locate, mapping, shred, split, sums, units

D = Decimal


# --- nested records ----------------------------------------------------------------------------------


def _random_file(rng: random.Random, i: int) -> dict:
    def maybe(x):
        return x if rng.random() < 0.7 else rng.choice([None, x])

    rows = lambda: [{"label": maybe(f"l{rng.randrange(9)}"), "values": rng.choice([None, {}, {"p": "1", "q": None}, [{"period": "z", "value": 3}], {"p": "", "r": "x"}])} for _ in range(rng.randrange(4))]
    st = [{"type": maybe("balance"), "pages": rng.choice([None, [], [1, 2]]), "rows": rng.choice([None, rows()])} for _ in range(rng.randrange(4))]
    return {"id": f"f{i}", "sha256": maybe("ab"), "statements": rng.choice([st, st[0] if st else None, None]), "new_field": rng.choice([1, None])}


def _walk(files: list[dict]) -> tuple[set, set, set]:
    rows, values, pages = set(), set(), set()
    for f in files:
        st = f.get("statements")
        for sp, s in enumerate(st if isinstance(st, list) else [] if st is None else [st]):
            for pp, p in enumerate(s.get("pages") or []):
                pages.add((f["id"], sp, pp, p))
            for rp, r in enumerate(s.get("rows") or []):
                rows.add((f["id"], sp, rp, r.get("label")))
                v = r.get("values") or {}
                for vp, (k, x) in enumerate(v.items() if isinstance(v, dict) else [(y["period"], y["value"]) for y in v]):
                    values.add((f["id"], sp, rp, vp, k, None if x is None else str(x)))
    return rows, values, pages


def test_shredding_round_trip(spark):
    rng = random.Random(5)
    files = [_random_file(rng, i) for i in range(120)]
    at = datetime(2025, 1, 1)
    rows = []
    for i, f in enumerate(files):
        body = json.dumps(f)
        rows.append((i, at, json.dumps(body) if i % 7 == 0 else json.dumps({"readings": [f]}) if i % 5 == 0 else body))
    rows += [(1000, at, "{broken"), (1001, at, None), (1002, at, ""), (1003, at, "[]"), (1004, datetime(2024, 1, 1), json.dumps({"id": "f0", "statements": [{"rows": [{"label": "old"}]}]}))]
    df = spark.createDataFrame(rows, "delivery_id LONG, received_at TIMESTAMP, body STRING").withColumn("file_id", F.lit("clash"))
    want = _walk(files)
    s = shred.shred_files(df)
    assert {tuple(r) for r in shred.rows(s).select("file_id", "statement_pos", "row_pos", "label").collect()} == want[0]
    assert {tuple(r) for r in shred.values(s).collect()} == want[1]
    assert {tuple(r) for r in shred.pages(s).collect()} == want[2]
    pruned = shred.shred_files(df, ("statements.item.rows.item.values",))
    assert {tuple(r) for r in shred.values(pruned).collect()} == want[1]
    got = {r.file_id: r.extra for r in shred.files(shred.shred_files(df, ("sha256", "status", "note", "extra"))).collect()}
    assert got == {f["id"]: '{"new_field": %s}' % json.dumps(f["new_field"]) for f in files}
    assert {r.delivery_id for r in shred.rejects(df).collect()} == {1000, 1001, 1002, 1003}


def test_shredding_empty(spark):
    none = spark.createDataFrame([], "delivery_id LONG, received_at TIMESTAMP, body STRING")
    assert shred.values(shred.shred_files(none)).count() == 0 and shred.rejects(none).count() == 0
    item = "STRUCT<input_id: BIGINT, statement_id: STRING, line_item_id: STRING, canonical_id: STRING, period_key: STRING, reported: DECIMAL(38,6), raw_text: STRING, unit_text: STRING, scale: BIGINT, currency: STRING>"
    schema = f"metric_value_id STRING, inputs MAP<STRING, ARRAY<{item}>>, role STRING"
    x = (7, "s", None, None, None, D("1.5"), None, None, None, None)
    mv = spark.createDataFrame([("a", {"r": [x, x], "": [x]}, "c"), ("a", {"r": [x, x], "": [x]}, "c"), ("b", None, None), ("c", {}, None), ("d", {"r": [], "t": None}, None)], schema)
    got = sorted((r.metric_value_id, r.role, r.position, r.input_id) for r in shred.inputs(shred.shred_inputs(mv)).collect())
    assert got == [("a", "", 0, 7), ("a", "r", 0, 7), ("a", "r", 1, 7)]


# --- units -------------------------------------------------------------------------------------------


def test_whole_units(spark):
    fields = "input_id LONG, statement_id STRING, canonical_id STRING, reported DECIMAL(38,6), raw_text STRING, unit_text STRING, scale LONG, currency STRING, unit_of STRING"
    rows = [
        (1, "s1", "x", D(5), "5", None, 1000, "SAR", "clash"), (2, "s1", "x", D(5), "5", "AED millions", None, None, None), (3, "s1", "x", None, "(2.5) mn", None, None, "EGP", None), (4, "s1", "x", D(7), None, None, None, None, None),
        (5, "s2", "x", D(7), None, None, None, None, None), (6, "s3", "x", D(7), None, None, None, None, None), (7, None, "x", D(9), None, None, None, None, None), (8, "s1", "per_share_basic", D(9), None, None, 1, "SAR", None),
        (9, "s1", "x", None, None, None, 1, "SAR", None), (10, "s1", None, D(250), None, "in US cents", None, None, None), (1, "s1", "x", D(5), "5", None, 1000, "SAR", None),
    ]
    st = spark.createDataFrame([("s1", 1000, "KWD", None), ("s2", None, None, "en milliers de dirhams marocains")], "statement_id STRING, scale LONG, currency STRING, unit_text STRING")
    got = {r.input_id: (r.amount, r.currency) for r in units.whole_units(spark.createDataFrame(rows, fields), st).collect()}
    assert got == {1: (5000, "SAR"), 2: (5_000_000, "AED"), 3: (-2_500_000, "EGP"), 4: (7000, "KWD"), 5: (7000, "MAD"), 6: (7, None), 7: (9, None), 10: (3, "USD")} or got[10] == (2, "USD")
    empty = spark.createDataFrame([], fields)
    assert units.whole_units(empty, st).count() == 0


# --- sums and alignment ------------------------------------------------------------------------------


def _line(i, *values, total=False, heading=False):
    return sums.Line(f"r{i}", {k: D(v) for k, v in zip("pq", values, strict=False) if v is not None}, total=total, heading=heading)


def test_infer_sums():
    lines = [_line(0, heading=True), _line(1, 10, 1), _line(2, 20, 2), _line(3, 30, 3, total=True), _line(4, 5, 5), _line(5, 7, 7), _line(6, 12, 12, total=True), _line(7, 42, 15, total=True)]
    got = {(t, k): (s, tuple(a)) for t, _, _, k, s, _, a in sums.infer_sums(lines, ["p", "q"])}
    assert got[("r3", "p")] == ("pass", ("r1", "r2")) and got[("r6", "q")] == ("pass", ("r4", "r5")) and got[("r7", "p")] == ("pass", ("r3", "r6"))
    implicit = sums.infer_sums([_line(1, 10), _line(2, 20), _line(3, 30)], ["p"])
    assert implicit[0][:3] == ("r3", "run", True)
    single = sums.infer_sums([_line(1, 10), _line(2, 10, total=True)], ["p"])
    assert single[0][4:6] == ("pass", "single_addend")
    wrong = sums.infer_sums([_line(1, 10), _line(2, 20), _line(3, 35, total=True)], ["p"])
    assert wrong[0][4] == "fail"
    assert sums.infer_sums([_line(1, 0), _line(2, 0), _line(3, 0)], ["p"]) == []


def test_align_is_longest():
    rng = random.Random(1)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + (a[i] == b[j]))
        return t[-1][-1]

    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(9))], [rng.randrange(4) for _ in range(rng.randrange(9))]
        pairs = sums.align(a, b, lambda x, y: x == y)
        assert len(pairs) == longest(a, b) and pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs) and len({j for _, j in pairs}) == len(pairs)


def test_outliers_and_fractions(spark):
    rows = [("s", f"r{i}", "p", D(v), []) for i, v in enumerate([10, 12, 9, 11, 10, 500_000, 0])] + [("s", "r0", "q", D(20_000), []), ("s", "r1", "q", D("12.5"), []), ("s", "r9", "p", None, None)]
    cells = spark.createDataFrame(rows, "statement_id STRING, row_id STRING, period_key STRING, reported DECIMAL(38,6), flags ARRAY<STRING>")
    assert {(r.row_id, r.period_key) for r in checks.period_outliers(cells).collect()} == {("r0", "p"), ("r0", "q")}
    assert {r.row_id for r in checks.column_outliers(cells).collect()} == {"r5"}
    assert {(r.row_id, r.period_key) for r in checks.fractions(cells).collect()} == {("r1", "q")}


def test_eps(spark):
    df = spark.createDataFrame([(1000.0, 1.0, 100.0, 1.0, 10.0, 0.01), (1000.0, 1.0, 100.0, 1.0, 12.0, 0.01), (None, 1.0, 100.0, 1.0, 12.0, 0.01)], "p DOUBLE, a DOUBLE, s DOUBLE, b DOUBLE, e DOUBLE, q DOUBLE")
    bounds = checks.eps_interval(F.col("p"), F.col("a"), F.col("s"), F.col("b"))
    assert [r[0] for r in df.select(checks.eps_status(F.col("e"), F.col("q"), bounds)).collect()] == ["pass", "fail", "missing_values"]


def test_net_profit_tie(spark):
    schema = "doc_id STRING, row_id STRING, ordinal INT, period_key STRING, reported DECIMAL(38,6)"
    income = spark.createDataFrame([("d", "a", 0, "p", D(5)), ("d", "b", 1, "p", D(7)), ("d", "b", 1, "q", D(8)), ("e", "a", 0, "p", D(1))], schema)
    other = spark.createDataFrame([("d", "x", 0, "p", None), ("d", "y", 1, "p", D(7)), ("d", "y", 1, "q", D(8)), ("d", "z", 2, "p", D(5)), ("e", "y", 0, "p", D(9))], schema)
    got = {(r.doc_id, r.period_key): (r.head_row, r.match_row, r.status) for r in checks.net_profit_tie(income, other).collect()}
    assert got == {("d", "p"): ("y", "b", "pass"), ("d", "q"): ("y", "b", "pass"), ("e", "p"): ("y", None, "fail")}


# --- datasets and splits -----------------------------------------------------------------------------


def test_dedupe_and_conflicts(spark):
    df = spark.createDataFrame([("g", "b", "t"), ("g", "a", "t"), ("h", "c", None), ("h", "d", "t"), ("i", "e", None), ("i", "f", None), (None, "k", "t")], "g STRING, id STRING, t STRING")
    assert {(r.g, r.id) for r in dataset.dedupe_lowest(df, ["g"], "t", "id").collect()} == {("g", "a"), ("i", "e"), (None, "k")}
    assert [(r.g, r["rows"], r.targets) for r in dataset.conflicts(df, ["g"], "t").collect()] == [("h", 2, 2)]


def test_cap(spark):
    df = spark.createDataFrame([("hot", f"{i:04}") for i in range(500)] + [("x", "1"), (None, "2")], "k STRING, id STRING").repartition(7)
    got = dataset.cap_per_key(df, "k", "id", 3).collect()
    assert sorted(r.id for r in got if r.k == "hot") == ["0000", "0001", "0002"] and len(got) == 5


def test_coverage_curve(spark):
    rng = random.Random(2)
    counts = [rng.randrange(1, 6) for _ in range(40)]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "key STRING, n LONG")
    want, total = {}, sum(counts)
    for p in (0, 10, 50, 99, 100):
        run = 0
        for needed, n in enumerate(sorted(counts, reverse=True), 1):
            run += n
            if run * 100 >= p * total:
                want[p] = needed
                break
    assert {r.percent: r.needed for r in dataset.coverage_curve(df, list(want)).collect()} == want
    assert {r.needed for r in dataset.coverage_curve(df.limit(0), [50]).collect()} == {0}


def test_multisets(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "v STRING"), spark.createDataFrame([("x",), ("z",), ("z",)], "v STRING")
    assert {tuple(r) for r in dataset.multiset_difference(a, b, ["v"]).collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 0, 2)}


def test_parts_and_moves(spark):
    docs = spark.createDataFrame([("fit", "a", "en", "annual"), ("fit", "a", "ar", "interim"), ("fit", "b", "en", "annual"), ("holdout", "c", "ar", "annual")], "part STRING, key STRING, language STRING, period STRING")
    assert {tuple(r) for r in split.part_counts(docs).collect()} == {("fit", 2, 3, 2, 1, 1, 2, 1), ("holdout", 1, 1, 0, 1, 0, 1, 0)}
    moves = spark.createDataFrame([("a", "validation"), ("c", "validation")], "key STRING, to_part STRING")
    assert {(r.key, r.part) for r in split.with_moves(docs.select("key", "part").distinct(), moves).collect()} == {("a", "fit"), ("b", "fit"), ("c", "validation")}
    assert split.impure_keys(docs, "key", "part").count() == 0


def test_bootstrap_covers(spark):
    rng = random.Random(4)
    rows = [("s", f"i{i % 30}", rng.random() < 0.6, rng.random() < 0.7) for i in range(900)]
    r = evaluate.paired_bootstrap(spark.createDataFrame(rows, "s STRING, issuer STRING, a BOOLEAN, b BOOLEAN"), "s", "issuer", "a", "b", 400).first()
    assert r.low <= r.difference <= r.high and r.high - r.low < 0.2


# --- ranges and mapping ------------------------------------------------------------------------------


def _ranges(pages):
    groups, open_ = [], None
    for n, score, candidate, continues in sorted(pages):
        adjacent = open_ is not None and n == open_[-1][0] + 1
        if candidate:
            if adjacent:
                open_.append((n, score))
            else:
                open_ = [(n, score)]
                groups.append(open_)
        elif adjacent and continues:
            open_.append((n, score))
        else:
            open_ = None
    found = sorted(((max(s for _, s in g), g[0][0], g[-1][0]) for g in groups), key=lambda x: (-x[0], x[1]))
    return {(a, b, s, k) for k, (s, a, b) in enumerate(found, 1)}


def test_find_ranges(spark):
    rng = random.Random(9)
    docs = {f"d{i}": [(n, float(rng.randrange(5)), rng.random() < 0.3, rng.random() < 0.4) for n in sorted(rng.sample(range(30), 18))] for i in range(40)}
    df = spark.createDataFrame([(d, "t", *p) for d, ps in docs.items() for p in ps], "doc_id STRING, type STRING, page_no LONG, score DOUBLE, candidate BOOLEAN, continues BOOLEAN")
    got = {}
    for r in locate.find_ranges(df).collect():
        got.setdefault(r.doc_id, set()).add((r.first_page, r.last_page, r.score, r["rank"]))
    assert got == {d: w for d, ps in docs.items() if (w := _ranges(ps))}


def test_merge_intervals(spark):
    rng = random.Random(8)
    spans = [(f"k{rng.randrange(6)}", a, a + rng.randrange(6)) for a in (rng.randrange(60) for _ in range(150))]
    want = set()
    for k in {s[0] for s in spans}:
        merged = []
        for a, b in sorted((a, b) for x, a, b in spans if x == k):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want |= {(k, a, b) for a, b in merged}
    df = spark.createDataFrame(spans, "k STRING, a LONG, b LONG")
    assert {tuple(r) for r in locate.merge_intervals(df, "k", "a", "b").select("k", "a", "b").collect()} == want


def test_mapping(spark):
    lab = spark.createDataFrame([("1", "t", "totalassets"), ("2", "t", "totalassetsnet"), ("3", "t", "cash"), ("4", "t", "xyz")], "label_id STRING, type STRING, squashed STRING")
    al = spark.createDataFrame([("A", "t", "totalassets"), ("B", "t", "cash"), ("C", "t", "cash")], "item_id STRING, type STRING, squashed STRING")
    assert {r.label_id: (r.item_id, len(r.candidates)) for r in mapping.match_labels(lab, al).collect()} == {"1": ("A", 1), "2": (None, 0), "3": (None, 2), "4": (None, 0)}
    assert {tuple(r) for r in mapping.prefix_matches(lab, al).collect()} == {("1", "A"), ("2", "A"), ("3", "B"), ("3", "C")}
    heads = spark.createDataFrame([("cash",), ("cash at",), ("other",)], "heading STRING")
    run = spark.createDataFrame([("1", "cash at bank"), ("2", "cash"), ("3", "cashier")], "label_id STRING, label STRING")
    assert [tuple(r) for r in mapping.longest_heading(run, heads).collect()] == [("1", "cash at", "bank")]
    chain = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", None)], "statement_id STRING, row_id STRING, parent_id STRING")
    assert {(r.row_id, r.ancestor, r.distance) for r in mapping.ancestors(chain).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    listed = spark.range(5).toDF("x")  # a longer list is joined by a shuffle, with the same rows
    assert spark.range(5).toDF("x").join(mapping.small(listed, 4), "x").count() == spark.range(5).toDF("x").join(mapping.small(listed, 5), "x").count() == 5


def test_boxes_and_columns(spark):
    v = spark.createDataFrame([("t", "v1", 10.0), ("t", "v2", 50.0), ("u", "v3", 10.0)], "table_id STRING, value_id STRING, x DOUBLE")
    c = spark.createDataFrame([("t", "c1", 12.0), ("t", "c2", 9.0), ("t", "c3", 80.0)], "table_id STRING, column_id STRING, centre DOUBLE")
    assert [tuple(r) for r in locate.nearest_column(v, c, 5.0).collect()] == [("t", "v1", "c2")]
    boxes = spark.createDataFrame([(1, "in", 2.0, 2.0, 3.0, 3.0), (1, "out", 0.0, 0.0, 9.0, 9.0)], "page INT, id STRING, left DOUBLE, top DOUBLE, right DOUBLE, bottom DOUBLE")
    assert [tuple(r) for r in locate.contained(boxes, boxes).collect()] == [(1, "in", "out")]


# --- groups of any size ------------------------------------------------------------------------------


def test_numbered_over_parts(spark):
    from tallyspark.operators.ranged import numbered

    rng = random.Random(12)
    rows = [("hot", i) for i in range(3000)] + [(f"k{rng.randrange(40)}", i) for i in range(400)] + [(None, i) for i in range(30)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = numbered(spark.createDataFrame(rows, "k STRING, v LONG"), ["k"], ["v"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for k, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(k, []).append(v)
    assert len(got) == len(rows) and all(want[r.k][r.n - 1] == r.v for r in got)


def test_near_matches_lose_nothing(spark):
    rng = random.Random(13)
    words = [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(4000)]
    sets = [sorted(set(rng.sample(words, rng.randrange(1, 7)))) for _ in range(160)]
    a, b = [(f"q{i}", s) for i, s in enumerate(sets[:60])] + [("none", [])], [(f"n{i}", s) for i, s in enumerate(sets[60:])]
    for least in (0.34, 0.5, 0.8):
        want = {(q, n) for q, x in a for n, y in b if x and len(set(x) & set(y)) / len(set(x) | set(y)) >= least - 1e-12}
        got = {(r["query"], r["name"]) for r in dataset.near_matches(spark.createDataFrame(a, "query STRING, words ARRAY<STRING>"), spark.createDataFrame(b, "name STRING, words ARRAY<STRING>"), 1000, least).collect()}
        assert got == want


def test_merge_over_parts(spark):
    rng = random.Random(14)
    spans = [("hot", a, a + rng.randrange(4)) for a in (rng.randrange(4000) for _ in range(1500))] + [("hot", 10, 3000), (None, 1, 2), ("x", None, 3), ("y", 5, 5)]
    merged = []
    for a, b in sorted((a, b) for k, a, b in spans if k == "hot"):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {tuple(r) for r in locate.merge_intervals(spark.createDataFrame(spans, "k STRING, a LONG, b LONG"), "k", "a", "b").select("k", "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {("hot", a, b) for a, b in merged} | {(None, 1, 2), ("y", 5, 5)}
