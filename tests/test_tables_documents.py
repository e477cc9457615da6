"""Printed tables, texts in visual order, documents, and SQL registration."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark import sql
from tallyspark.functions import texts
from tallyspark.operators import documents, tables


def test_text_repairs():
    assert texts.restore_digits("ABC 5202") == "ABC 2025" and texts.restore_digits(")321(") == "(123)" and texts.join_year("5 202") == "2025"
    vocabulary = frozenset(texts.meeting_form(w) for w in ("مجموع", "الأصول"))
    assert texts.join_letters("م ج م و ع ا ل أ ص و ل", vocabulary) == "مجموع الأصول"
    assert texts.join_letters("م ج م و ع") == "مجموع" and texts.join_letters("total assets") == "total assets" and texts.join_letters("") == ""
    assert texts.split_run("قققققق", vocabulary) == "قققققق"
    assert texts.is_visual("ةكرش ةيلام ةدوهعم") and not texts.is_visual("شركة مالية معهودة") and not texts.is_visual("")
    assert texts.variants("one two", True) == ["one two"] and texts.variants("أ ب", False) == ["أ ب", "ب أ"]
    assert "مجموع" in texts.page_words("مجموع x 5", False)


def test_phrases():
    index = texts.PhraseIndex({"a": ["net income", "income"], "b": ["income", ""]})
    assert index.find("The net income rose") == {"net income": ["a"]}
    assert index.find("net income, other income; INCOME") == {"net income": ["a"], "income": ["a", "b"]}
    assert index.find("incomes") == {} and index.find(None) == {} and texts.PhraseIndex({}).find("x") == {}


def test_phrase_column(spark):
    df = spark.createDataFrame([("net income",), (None,), ("",)], "t STRING")
    got = [[(x.phrase, x.grp) for x in r.h] if r.h else r.h for r in df.select(texts.phrase_hits({"g": ["income"]})(F.col("t")).alias("h")).collect()]
    assert got == [[("income", "g")], [], []]


def test_claims():
    assert texts.place_claims("Margin was 12.5% in 2024, and 12.5% before", ["12.5%", "12.5%"]) == [("12.5%", 11, 16), ("12.5%", 30, 35)]
    assert texts.place_claims("Margin was 12.5% and 12.5%", ["12.5%"]) is None and texts.place_claims("x", ["y"]) is None and texts.place_claims("5 of 15", ["5"]) == [("5", 0, 1)]


def test_token_classes(spark):
    cases = [("12", True, True), ("1,234", False, True), ("2024", False, False), ("31/12/2024", False, False), ("(500)", False, True), ("-", False, True), ("label", False, False), (None, False, False), ("7 a", True, False), ("٤٥", True, True)]
    df = spark.createDataFrame(cases, "t STRING, n BOOLEAN, a BOOLEAN")
    for r in df.select("t", "n", "a", tables.is_note(F.col("t")).alias("gn"), tables.is_amount(F.col("t")).alias("ga")).collect():
        assert (r.gn, r.ga) == (r.n, r.a), r.t
    notes = spark.createDataFrame([("Trade receivables 12",), ("Under IFRS 16",), ("Plain",)], "l STRING").select(tables.split_note(F.col("l")).alias("s"))
    assert [tuple(r.s) for r in notes.collect()] == [("Trade receivables", "12"), ("Under IFRS 16", None), ("Plain", None)]


def test_grid_and_periods(spark):
    cell = "STRUCT<start_row: INT, start_col: INT, text: STRING, row_span: INT, col_span: INT, column_header: BOOLEAN>"
    grid = [(0, 1, "31 December\n", 1, 1, True), (1, 1, " 2024", 1, 1, True), (0, 2, "31 December", 1, 1, True), (1, 2, "2023", 1, 1, True), (0, 3, "2024-12-31", 1, 1, True), (2, 0, "Cash", 1, 1, False), (2, 1, "1,200", 1, 1, False), (2, 2, "900", 1, 1, False)]
    df = spark.createDataFrame([("t", grid), ("u", None), ("v", [])], f"table_id STRING, cells ARRAY<{cell}>")
    cells = tables.grid_cells(df)
    assert cells.count() == len(grid)
    got = {r.col: (r.key, r.bound) for r in tables.column_periods(cells).collect()}
    assert got == {1: ("2024-12-31", True), 2: ("2023-12-31", True), 3: ("2024-12-31", False)}


def test_hierarchy(spark):
    rows = [("t", 0, "Assets", 0.0, False), ("t", 1, "Current", 8.0, False), ("t", 2, "Cash", 17.0, True), ("t", 3, "Total current", 8.5, True), ("t", 4, "Fixed", 8.0, False), ("t", 5, "", None, True)]
    got = {r.row: (r.depth, r.parent_row, r.is_subtotal, r.is_section) for r in tables.hierarchy(spark.createDataFrame(rows, "table_id STRING, row LONG, label STRING, indent DOUBLE, has_values BOOLEAN")).collect()}
    assert got == {0: (0, None, False, True), 1: (1, 0, False, True), 2: (2, 1, False, False), 3: (1, 1, True, False), 4: (1, 0, False, True), 5: (0, 0, True, False)}


def test_hierarchy_of_many_tables(spark):
    """Any number of tables pass in one stream: no call for each; tables that span batches, unsorted, of many levels, with gaps, against plain steps."""
    rng = random.Random(5)
    rows = [(f"t{t}", r, rng.choice(["Assets", "", " ", None, "Total due", "totals"]), rng.choice([None, float("nan"), 0.0, 4.0, 4.5, 8.0, 9.0, 40.0]), rng.choice([True, False, None])) for t in range(400) for r in range(rng.randrange(1, 12))]
    rows += [("long", r, "part", 5.0 * rng.randrange(60), r % 3 == 0) for r in range(700)] + [(None, r, "x", None, r > 0) for r in range(3)]
    rng.shuffle(rows)

    want = set()
    for t in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == t), key=lambda x: x[1])
        levels: list[float] = []
        for x in sorted(x[3] for x in own if x[3] is not None and x[3] == x[3]):
            if not levels or x - levels[-1] > 4.0:
                levels.append(x)
        sections: list[tuple[int, int]] = []
        for _, r, label, indent, valued in own:
            d = min(range(len(levels)), key=lambda i: abs(indent - levels[i])) if levels and indent is not None and indent == indent else 0
            text = (label or "").strip()
            section = bool(text) and not valued
            want.add((t, r, d, next((s for s, e in reversed(sections) if e < d or (e == d and not section)), None), bool(valued) and text in ("", "Total due"), section))
            if section:
                sections.append((r, d))

    df = spark.createDataFrame([(*x, "clash") for x in rows], "table_id STRING, row LONG, label STRING, indent DOUBLE, has_values BOOLEAN, indents STRING").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = tables.hierarchy(df)
        got = [tuple(r) for r in out.collect()]
        empty = tables.hierarchy(df.limit(0)).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and set(got) == want and empty == 0
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_realign(spark):
    bands = {0: (0.0, 10.0), 1: (10.0, 20.0), 2: (20.0, 30.0)}
    at = lambda y: [(y - 4, y + 4)]
    assert tables.realign({0: at(5), 1: at(15), 2: at(25)}, bands, [0, 1, 2]) == ({}, [])
    assert tables.realign({0: at(15), 1: at(25)}, bands, [0, 1, 2]) == ({0: 1, 1: 2}, [])
    moved, left = tables.realign({0: at(90)}, bands, [0, 1, 2])
    assert moved == {} and left == [0] and tables.realign({}, bands, [0]) == ({}, [])
    boxes = [("t", r, True, a, b) for r, (a, b) in bands.items()] + [("t", 0, False, 11.0, 19.0), ("t", 1, False, 21.0, 29.0)]
    got = tables.realigned_rows(spark.createDataFrame(boxes, "table_id STRING, row LONG, is_label BOOLEAN, top DOUBLE, bottom DOUBLE")).collect()
    assert {(r.row, r.target_row, r.flag) for r in got} == {(0, 1, "row_realigned"), (1, 2, "row_realigned")}


def test_table_scores(spark):
    lab = spark.createDataFrame([("t", x) for x in "abcdefg"], "table_id STRING, squashed STRING")
    al = spark.createDataFrame([("balance", x) for x in "abcd"] + [("income", x) for x in "fg"], "type STRING, squashed STRING")
    got = {r.type: (r.hits, r.score, r.settled) for r in tables.table_scores(lab, al, spark.createDataFrame([("t", "income", "title")], "table_id STRING, type STRING, how STRING")).collect()}
    assert got == {"balance": (4, 0.5, False), "income": (2, 0.6, True)}


def test_documents(spark):
    pages = spark.createDataFrame([("d", 1, 10, 90, ["ocr_failed"], "text"), ("d", 2, 200, 5, [], "ocr"), ("e", 1, 0, 0, [], "text")], "doc_id STRING, page_no INT, arabic_chars INT, latin_chars INT, flags ARRAY<STRING>, source STRING")
    assert {tuple(r) for r in documents.document_language(pages).collect()} == {("d", "ar"), ("e", None)}
    ranges = spark.createDataFrame([("d", "income")], "doc_id STRING, type STRING")
    spans = spark.createDataFrame([("d", 1, 1)], "doc_id STRING, first_page INT, last_page INT")
    got = {r.doc_id: r.flags for r in documents.locate_flags(pages, ranges, spans, ["income", "balance"]).collect()}
    assert got == {"d": ["ocr_failed_pages:1", "statement_not_found:balance", "low_selectivity"], "e": ["statement_not_found:income", "statement_not_found:balance", "no_statements_found"]}
    cur = spark.createDataFrame([("d", "SAR", 2), ("d", "EGP", 1), ("d", None, 0), ("d", "EGP", 5), ("d", "SAR", 6)], "doc_id STRING, currency STRING, ordinal INT")
    assert [tuple(r) for r in documents.most_common_first(cur, "doc_id", "currency", "ordinal").collect()] == [("d", "EGP", 2)]
    st = spark.createDataFrame([("s1", "d", "SAR", "EGP"), ("s2", "d", None, None), ("s3", "x", None, None)], "statement_id STRING, doc_id STRING, header_currency STRING, caption_currency STRING")
    docs = spark.createDataFrame([("d", None, "KWD")], "doc_id STRING, domicile_currency STRING, document_currency STRING")
    assert {r.statement_id: (r.currency, r.flags) for r in documents.metadata(st, docs).collect()} == {"s1": ("SAR", ["currency_conflict"]), "s2": ("KWD", ["currency_inferred"]), "s3": ("XXX", ["currency_missing"])}
    ev = documents.merge_evidence(cur, ["doc_id"], "currency").first()
    assert ev.conflict and ev.currency is None


def test_alias_pools(spark):
    rng = random.Random(1)
    rows = [("n:a", "cik:1", "train"), ("n:b", "cik:1", "train"), ("n:b", None, "train"), ("n:c", None, "test"), ("n:d", "cik:2", "train"), ("n:d", "cik:3", "train"), ("n:e", "cik:4", "test"), ("n:f", "cik:4", "train")]
    rng.shuffle(rows)
    got = {r.key: (r.group, r.pool, r.conflict) for r in documents.alias_pools(spark.createDataFrame(rows, "name_key STRING, cik_key STRING, pool STRING")).collect()}
    assert got["n:a"] == got["n:b"] == got["cik:1"] == ("cik:1", "train", False) and got["n:c"] == ("n:c", "test", False)
    assert got["n:d"] == ("cik:2", None, True) and got["n:e"] == ("cik:4", None, True)


def test_sql(spark):
    sql.register(spark)
    r = spark.sql("SELECT parse_number('(1,234)') AS n, parse_period('31 December 2024').key AS k, normalize_label('Net-Income') AS l").first()
    assert r.n.value == Decimal("-1234") and r.k == "2024-12-31" and r.l == "net income"
    rows = spark.sql("SELECT c.position, c.value FROM VALUES (array('5', NULL, 'x')) AS t(raw), LATERAL parse_cells(raw) AS c ORDER BY 1").collect()
    assert [(x.position, x.value) for x in rows] == [(0, Decimal(5)), (1, None), (2, None)]
