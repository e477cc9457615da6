"""Figures that do not fit, label mapping, scores against gold, parts over pages, exact percentiles, late events."""

from __future__ import annotations

import random
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import numbers, units as wording
from tallyspark.operators import continuation, evaluate, label_mapping, locate, mapping, scoring, sums, units
from tallyspark.streaming import events

D = Decimal


@pytest.mark.parametrize(
    ("text", "value", "flags"),
    [
        ("12.34567%", D("0.123457"), ["percent", "decimals_rounded"]), ("1.1234567", D("1.123457"), ["decimals_rounded"]), ("9" * 40, None, ["out_of_range"]), ("9" * 32, D("9" * 32), []), ("-" + "9" * 33, None, ["out_of_range"]),
        ("(" + "1" * 500 + ")", None, ["parentheses_negative", "unparsed"]), ("1e5", None, ["unparsed"]), ("٪", None, ["percent", "unparsed"]),
    ],
)
def test_no_figure_is_fatal(text, value, flags):
    assert numbers.read_number(text) == (value, "ratio" if "percent" in flags and value is not None else "number", flags)


def test_no_cell_kills_a_job(spark):
    df = spark.createDataFrame([(t,) for t in ("12.34567%", "1.1234567", "9" * 40, "5", None)], "t STRING")
    assert [r.p.value for r in df.select(numbers.parse_number("t").alias("p")).collect()] == [D("0.123457"), D("1.123457"), None, D(5), None]
    rows = [(1, D("1e18"), None, 10**9), (2, None, "99,999,999,999,999,999 bn", None), (3, D("12.5"), None, 1000), (4, D("9" * 32), None, 10**9), (5, None, "9" * 60, 1), (6, D("0.4"), None, 1), (7, None, "3", 10**18)]
    inputs = spark.createDataFrame([(i, "s", None, r, t, None, s, "SAR") for i, r, t, s in rows], "input_id LONG, statement_id STRING, canonical_id STRING, reported DECIMAL(38,6), raw_text STRING, unit_text STRING, scale LONG, currency STRING")
    statements = spark.createDataFrame([("s", 10**17, None, None)], "statement_id STRING, scale LONG, currency STRING, unit_text STRING")
    got = {r.input_id: (r.amount, r.exact) for r in units.whole_units(inputs, statements).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (12500, True), 4: (None, False), 6: (0, False), 7: (3, True)}


def test_unit_signal(spark):
    cases = [("ＳＡＲ in thousands, except per share data", (1000, "in thousands", "SAR", "SAR", True)), ("€ 000", (None, None, None, None, False)), (None, (None, None, None, None, False)), ("بملايين الدولار", (10**6, "ملايين", "USD", "دولار", False))]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t STRING")
    assert [tuple(r.u) for r in df.select(wording.unit_signal(F.col("t")).alias("u")).collect()] == [w for _, w in cases]


def test_sums_against_brute_force():
    """The shortest tail that makes every period, by trying all of them."""
    rng = random.Random(4)
    for _ in range(400):
        keys = ["a", "b"][: rng.randrange(1, 3)]
        rows = [{k: D(rng.choice([0, 1, 2, 3, 5, 9])) for k in keys} for _ in range(rng.randrange(2, 7))]
        n = rng.randrange(2, len(rows) + 1)
        total = {k: sum((r[k] for r in rows[-n:]), D(0)) for k in keys}
        lines = [sums.Line(f"r{i}", v) for i, v in enumerate(rows)]
        pile = sums.Pile(keys)
        for line in lines:
            pile.push(line)

        def fits(m):
            tail = rows[-m:]
            telling = sum(any(r.values()) for r in tail) >= 2
            off = [abs(total[k] - sum((r[k] for r in tail), D(0))) for k in keys]
            some = any(total[k] or sum((r[k] for r in tail), D(0)) for k, o in zip(keys, off, strict=True) if o <= D("0.5") * m)
            return telling and some and all(o <= D("0.5") * m for o in off)

        want = next((m for m in range(2, len(rows) + 1) if fits(m)), None)
        start = pile.best(sums.Line("t", total))
        assert (None if start is None else len(rows) - start) == want


def _row(ordinal, label, parent=None, total=False, values=True, checked=False, confirmed=True, figures=None, type_="balance"):
    return ("s", type_, f"r{ordinal}", ordinal, label, parent, total, values, checked, confirmed, figures or f"f{ordinal}")


ROWS = "statement_id STRING, type STRING, row_id STRING, ordinal INT, squashed STRING, parent_id STRING, is_total BOOLEAN, has_values BOOLEAN, checked BOOLEAN, confirmed BOOLEAN, figures STRING"
ALIASES = "item_id STRING, type STRING, squashed STRING, within STRING, subtotal BOOLEAN"


def test_label_mapping(spark):
    aliases = spark.createDataFrame([("cash", "balance", "cash", None, False), ("loans_s", "balance", "loans", "short", False), ("loans_l", "balance", "loans", "long", False), ("short", "balance", "shortdues", None, True), ("long", "balance", "longdues", None, True), ("assets", "balance", "assets", None, True), ("rent", "balance", "rent", "long", False), ("eps_b", "income", "epsbasic", None, False)], ALIASES)
    rules = spark.createDataFrame([("assets", ["cash", "stock"]), ("pair", ["cash"])], "item_id STRING, needs ARRAY<STRING>")
    rows = [
        _row(0, "cash", "r2"), _row(1, "", "r2"), _row(2, "sum", total=True, checked=True), _row(3, "shortdues", values=False), _row(4, "loans", "r6"), _row(5, "rent", "r6"), _row(6, "total", total=True, checked=True),
        _row(7, "assets", total=True, confirmed=False), _row(8, "loans"), _row(9, None), _row(10, "earningspershare", values=False, type_="income"), _row(11, "basic", type_="income"),
    ]
    got = {r.row_id: (r.item_id, r.evidence, r.flag) for r in label_mapping.map_rows(spark.createDataFrame(rows, ROWS), aliases, rules, {"basic": "eps_b"}).collect()}
    assert got == {
        "r0": ("cash", "alias", None), "r1": (None, "no_alias_no_anchor", "unmapped"), "r2": ("pair", "anchor:sum_of_mapped", None), "r4": ("loans_s", "alias_in_section:short", None), "r5": (None, "section_conflict:rent|section=short", "ambiguous"),
        "r6": ("short", "anchor:section_heading", None), "r7": (None, "alias_total_unconfirmed:assets", "ambiguous"), "r8": (None, "alias_multiple:loans_l|loans_s", "ambiguous"), "r9": (None, "no_alias_no_anchor", "unmapped"), "r11": ("eps_b", "anchor:eps_heading", None),
    }
    twice = [_row(0, "cash", figures="x"), _row(1, "cash", figures="x"), _row(2, "rent", "r3"), _row(3, "rent"), _row(4, "assets", total=True), _row(5, "assets", total=True)]
    got = {r.row_id: (r.item_id, r.evidence) for r in label_mapping.map_rows(spark.createDataFrame(twice, ROWS), aliases, rules).collect()}
    assert got == {"r0": ("cash", "alias"), "r1": (None, "repeat_of:r0:cash"), "r2": (None, "duplicate:rent"), "r3": ("rent", "alias"), "r4": (None, "duplicate:assets"), "r5": (None, "duplicate:assets")}
    assert label_mapping.map_rows(spark.createDataFrame([], ROWS), aliases, rules).count() == 0


def test_own_labels():
    labels = ["cash", "cashandcashequivalents", "tradedebtors"]
    assert scoring.is_own("cash", "cash", labels) and scoring.is_own("cashandcashequivalents", "cashandcashequlvalents", labels) and not scoring.is_own("cash", "cashandcashequlvalents", labels)
    assert not scoring.is_own("tradedebtors", "cash", labels) and scoring.is_own(None, "x", labels) and not scoring.is_own("cash", "", labels) and scoring.is_own("tradedebtors", "tradedebtrs", labels)


def test_scores(spark):
    schema = "key STRING, row STRING, ordinal INT, label STRING, period_key STRING, value DECIMAL(20,0), confirmed BOOLEAN"
    gold = [("s", "0", 0, "cash", "p", D(10), True), ("s", "1", 1, "tradedebtors", "p", D(20), True), ("s", "2", 2, "stockheld", "p", D(30), True), ("s", "3", 3, "loansdue", "p", D(40), True), ("s", "4", 4, "wagesdue", "p", D(50), False)]
    read = [("s", "a", 0, "cash", "p", D(10), None), ("s", "b", 1, "tradedebtors", "p", D(-20), None), ("s", "c", 2, "wagesdue", "p", D(30), None), ("s", "d", 3, "nothing", "p", D(77), None)]
    found = spark.createDataFrame(read, schema).drop("confirmed")
    got = {r.row: r.verdict for r in scoring.judged_cells(spark.createDataFrame(gold, schema), found).collect()}
    assert got == {"0": "right", "1": "wrong", "2": "mislabelled", "3": "missing"}
    r = scoring.statement_scores(spark.createDataFrame(gold, schema), found).first()
    assert (r.cells, r.right, r.mislabelled, r.missing, r.sign_cells, r.sign_right, r.extra_rows) == (4, 1, 1, 1, 3, 2, 1)


def test_parts(spark):
    schema = "doc_id STRING, part_id STRING, type STRING, grp STRING, first_page INT, last_page INT, place INT, centres MAP<STRING, DOUBLE>, page_width DOUBLE, closed BOOLEAN"
    x = {"p": 50.0}
    rows = [("d", "a", "b", "g", 1, 1, 0, x, 100.0, False), ("d", "b", "b", "g", 2, 3, 0, {"p": 54.0}, 100.0, False), ("d", "c", "b", "g", 4, 4, 0, {"p": 58.0}, 100.0, False), ("d", "e", "b", "g", 5, 5, 0, {"p": 58.0}, 100.0, True), ("d", "f", "b", "g", 6, 6, 0, {"p": 58.0}, 100.0, False), ("d", "h", "b", "g", 8, 8, 0, {"p": 58.0}, 100.0, False), ("d", "i", "b", "g", 8, 8, 1, None, 100.0, False), ("e", "j", "b", "g", 8, 8, 1, x, 100.0, False)]
    got = {r.part_id: r.head_id for r in continuation.merged_parts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "e": "c", "f": "f", "h": "h", "i": "i", "j": "j"}
    unbound = spark.createDataFrame([("t", 1, 50.0, 100.0, ["q"]), ("t", 2, 52.0, 100.0, ["q"]), ("t", 3, 90.0, 100.0, [])], "table_id STRING, col INT, centre DOUBLE, page_width DOUBLE, bound ARRAY<STRING>")
    before = spark.createDataFrame([("t", "p", 51.0), ("t", "q", 50.0)], "table_id STRING, period_key STRING, centre DOUBLE")
    assert [tuple(r) for r in continuation.inherited_columns(unbound, before).collect()] == [("t", 1, "p")]


def test_percentiles_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(20))) for _ in range(301)] + [("c", None), (None, 5.0)]
    got = {r.k: (r.n, r.median, r.p90) for r in evaluate.times(spark.createDataFrame(rows, "k STRING, v DOUBLE").where("k IS NOT NULL"), ["k"], "v").collect()}
    for k in ("a", "b", None):
        values = sorted(v for g, v in rows if v is not None and g is not None and k in (g, None))
        assert got[k] == (len(values), median(values), values[-(-9 * len(values) // 10) - 1])
    assert got["c"] == (0, None, None)


def test_late_events_change_nothing(spark):
    """Events that come out of order give the state of those in order; folding by hand and by joins agree."""
    rng = random.Random(5)
    rows = [(j, s, rng.choice(["queued", "running", "completed", "failed", "needs_review"])) for j in range(40) for s in range(rng.randrange(1, 9))]
    want = {}
    for j in range(40):
        want[j] = events._folded({s: x for i, s, x in rows if i == j})
    shuffled = rng.sample(rows, len(rows))
    got = {r.job_id: (r.status, r.seq) for r in events.job_states(spark.createDataFrame(shuffled, "job_id LONG, seq LONG, status STRING")).collect()}
    assert got == want


def test_islands_and_carried_states(spark):
    pages = [("d", "t", p, float(p), p in (3, 9), True) for p in (1, 2, 3, 4, 8, 9, 12)]
    got = sorted((r.first_page, r.last_page, r.score, r["rank"]) for r in locate.find_ranges(spark.createDataFrame(pages, "doc_id STRING, type STRING, page_no INT, score DOUBLE, candidate BOOLEAN, continues BOOLEAN")).collect())
    assert got == [(3, 4, 4.0, 2), (9, 9, 9.0, 1)]
    rows = spark.createDataFrame([("s", i, i % 3 == 1, f"h{i}") for i in range(9)], "statement_id STRING, ordinal INT, is_heading BOOLEAN, h STRING")
    assert [r.h_carried for r in mapping.carried_forward(rows, "h").orderBy("ordinal").collect()] == [None, "h1", "h1", "h1", "h4", "h4", "h4", "h7", "h7"]
