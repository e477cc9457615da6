"""Scalar parsers and predicates against literal cases."""

from __future__ import annotations

import hashlib
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import hashing, labels, numbers, periods, stats, units
from tallyspark.operators.units import printed_number, with_units

D = Decimal

NUMBERS = [
    (None, None, "number", ["empty"]), ("", None, "number", ["empty"]), ("   ", None, "number", ["empty"]), ("-", D(0), "number", ["dash_as_zero"]), ("— —", D(0), "number", ["dash_as_zero"]),
    ("nil", D(0), "number", ["word_as_zero"]), ("N/A", None, "number", ["not_available"]), ("1,234", D(1234), "number", []), ("(1,234)", D(-1234), "number", ["parentheses_negative"]),
    ("12-", D(-12), "number", ["trailing_sign"]), ("-12", D(-12), "number", []), ("(-12)", D(12), "number", ["parentheses_negative"]), ("+7", D(7), "number", []), ("1 234 567", D(1234567), "number", []),
    ("1.234,5", D("1234.5"), "number", ["european_separators"]), ("12,5", D("12.5"), "number", ["comma_decimal"]), ("1.234", D("1.234"), "number", ["ambiguous_separator"]), ("1234.567", D("1234.567"), "number", []),
    ("45%", D("0.45"), "ratio", ["percent"]), ("1,200¹", D(1200), "number", ["footnote_marker"]), ("900 (a)", D(900), "number", ["footnote_marker"]), ("55*", D(55), "number", ["footnote_marker"]),
    ("٣٬٤٥٦", D(3456), "number", ["arabic_indic_digits"]), ("‎12‏", D(12), "number", []), ("twelve", None, "number", ["unparsed"]), ("()", None, "number", ["unparsed"]), ("1,23,4", D("1.23"), None, None),
]


@pytest.mark.parametrize(("text", "value", "unit", "flags"), NUMBERS[:-1])
def test_read_number(text, value, unit, flags):
    assert numbers.read_number(text) == (value, unit, flags)


def test_number_paths_agree(spark):
    rng = random.Random(3)
    texts = [t for t, *_ in NUMBERS] + [rng.choice(["{:,}", "({:,})", "-{}", "{}-", "{:,}.5", "{}%", " {} "]).format(rng.randrange(10**7)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    rows = df.select("t", numbers.parse_number("t").alias("p"), numbers.plain_number(F.col("t")).alias("fast")).collect()
    for r in rows:
        value, unit, flags = numbers.read_number(r.t)
        assert (r.p.unit, list(r.p.flags)) == (unit, flags)
        assert r.p.value == value
        if r.fast is not None:
            assert r.fast == value, r.t
    assert sum(r.fast is not None for r in rows) > 250


def test_printed_numbers(spark):
    cases = {"1 234": 1234, "1 234.5": 1234.5, "−939.418": -939.418, "(0.5)": -0.5, "0.5-": -0.5, "٠٫٩١١": 0.911, "SAR 12,500 units": 12500, "1.234.567": 1234567, "1.234,5": 1234.5, "12,5": 12.5, "no figure": None, "": None}
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in cases.items()], "t STRING, v DOUBLE")
    for r in df.select("t", "v", printed_number(F.col("t")).cast("double").alias("got")).collect():
        assert r.got == r.v, r.t
    assert spark.createDataFrame([(None,)], "t STRING").select(printed_number(F.col("t"))).first()[0] is None


def test_unit_captions(spark):
    cases = {
        "(SAR in thousands)": (1000, "SAR"), "in halalas (Saudi)": (0.01, "SAR"), "in Kuwaiti fils (1,000 fils to the dinar)": (0.001, "KWD"), "UAE dirhams '000": (1000, "AED"), "figures in 000s": (1000, None),
        "en millions de livres égyptiennes": (1e6, "EGP"), "بآلاف الريالات السعودية": (1000, "SAR"), "بوحدات كاملة": (1, None), "the sardine market": (None, None), None: (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(k, None if s is None else float(s), c) for k, (s, c) in cases.items()], "t STRING, s DOUBLE, c STRING")
    for r in with_units(df, "t", "u").collect():
        assert (None if r.u_scale is None else float(r.u_scale), r.u_currency) == (r.s, r.c), r.t
    printed = spark.createDataFrame([("SR 370 000 units",), ("0.041835m",), ("US$ 5k",)], "t STRING")
    assert [(float(r.u_scale), r.u_currency) for r in with_units(printed, "t", "u", printed=True).orderBy(F.length("t")).collect()] == [(1000, "USD"), (1e6, None), (1, "SAR")]


PERIODS = [
    ("31 December 2025", ("2025-12-31", date(2025, 12, 31), "instant", None, False, None)), ("٣١ ديسمبر ٢٠٢٥م", ("2025-12-31", date(2025, 12, 31), "instant", None, False, None)),
    ("For the six months ended 30 June 2024", ("6M-2024-06-30", date(2024, 6, 30), "duration", 6, False, None)), ("Year ended 31/12/2023 (unaudited)", ("FY2023", date(2023, 12, 31), "duration", 12, False, False)),
    ("2023 (Restated)", ("2023-12-31", date(2023, 12, 31), "instant", None, True, None)), ("2024-02-30", None), ("February 2024", ("2024-02-29", date(2024, 2, 29), "instant", None, False, None)),
    ("1445 هـ", None), ("", None), (None, None), ("note", None), ("9 months ended September 2022", ("9M-2022-09-30", date(2022, 9, 30), "duration", 9, False, None)),
]


@pytest.mark.parametrize(("text", "want"), PERIODS)
def test_read_period(text, want):
    assert periods.read_period(text) == want


def test_periods_in_spark(spark):
    df = spark.createDataFrame([(t,) for t, _ in PERIODS], "t STRING")
    got = [None if r.p is None else tuple(r.p) for r in df.select(periods.parse_period(F.col("t")).alias("p")).collect()]
    assert got == [w for _, w in PERIODS]


def test_months_before(spark):
    cases = [(date(2025, 6, 30), 6, date(2024, 12, 31)), (date(2024, 2, 29), 12, date(2023, 2, 28)), (date(2025, 3, 30), 1, date(2025, 2, 28)), (date(2025, 5, 15), 5, date(2024, 12, 15))]
    df = spark.createDataFrame(cases, "d DATE, n INT, w DATE")
    assert all(r.got == r.w for r in df.select("w", periods.months_before(F.col("d"), F.col("n")).alias("got")).collect())


def test_labels(spark):
    cases = {"Right-of-use  Assets": "right of use assets", "إجمالي المُوجودات": "اجمالي الموجودات", "ＴＯＴＡＬ": "total", None: None, "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t STRING, w STRING")
    assert all(r.g == r.w for r in df.select("w", labels.normalize_label("t").alias("g")).collect())
    one = spark.createDataFrame([("Northern-Dairy CO. Ltd", "EPS, basic", "total assets", "total of x")], "a STRING, b STRING, c STRING, d STRING").select(labels.issuer_key(F.col("a")), labels.is_per_share(F.col("b")), labels.has_subtotal_cue(F.col("c")), labels.is_per_share(F.col("d"))).first()
    assert tuple(one) == ("northern dairy", True, True, False)


def test_captions(spark):
    cases = {"SAR in thousands": (1000, "SAR"), "in millions of US dollars": (10**6, "USD"), "necessary": (None, None), "LE '000": (1000, "EGP"), "بملايين الريالات": (10**6, "SAR"), None: (None, None)}
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "t STRING, s LONG, c STRING")
    for r in df.select("t", "s", "c", units.detect_scale(F.col("t")).alias("gs"), units.detect_currency(F.col("t")).alias("gc")).collect():
        assert (r.gs, r.gc) == (r.s, r.c), r.t


def test_bucket(spark):
    keys = [f"k{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k STRING").select("k", hashing.bucket(F.col("k"), "holdout:").alias("b"))
    assert all(r.b == int(hashlib.sha256(f"holdout:{r.k}".encode()).hexdigest(), 16) % 100 for r in df.collect())


def test_digits(spark):
    cases = [(300, 2), (0, None), (1200, None), (7, 0), (-5000, 3)]
    df = spark.createDataFrame([(D(a), b) for a, b in cases], "d DECIMAL(20,0), w INT")
    assert all(r.g == r.w for r in df.select("w", numbers.single_digit_place(F.col("d")).alias("g")).collect())
    pairs = [(D(123), D(173), True, False), (D(123), D(124), True, False), (D(123), D(456), False, False), (D(2414061), D(302414061), False, True), (D(2414061), D(32414061), False, True), (D(14061), D(3014061), False, True), (D(-5), D(5), False, False)]
    df = spark.createDataFrame(pairs, "a DECIMAL(20,0), b DECIMAL(20,0), x BOOLEAN, y BOOLEAN")
    for r in df.select("a", "b", "x", "y", numbers.one_digit_apart(F.col("a"), F.col("b")).alias("gx"), numbers.leading_digit_lost(F.col("a"), F.col("b")).alias("gy")).collect():
        assert (r.gx, r.gy) == (r.x, r.y), (r.a, r.b)


def test_bounds(spark):
    assert stats.upper95(0, 0) is None and stats.upper95(5, 5) == 1.0
    for errors, n in ((0, 20), (1, 50), (7, 300)):
        p = stats.upper95(errors, n)
        from math import comb

        assert abs(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(errors + 1)) - 0.05) < 1e-6
    r = spark.createDataFrame([(138, 138), (0, 0), (5, 10)], "r LONG, n LONG").select("n", stats.wilson_low(F.col("r"), F.col("n")).alias("a"), stats.wilson_high(F.col("r"), F.col("n")).alias("b")).collect()
    assert [(round(x.a, 4), round(x.b, 4)) for x in r] == [(0.9729, 1.0), (0.0, 1.0), (0.2366, 0.7634)]


def test_formats(spark):
    df = spark.createDataFrame([(D("1234.5"),), (D("-1234.4"),), (D("0.2"),)], "a DECIMAL(18,2)")
    assert [r[0] for r in df.select(numbers.format_amount(F.col("a"))).collect()] == ["1,234", "(1,234)", "0"]
    m = spark.createDataFrame([(0.1234, "ratio"), (1.5, "times"), (90.4, "days"), (1000.0, "currency"), (None, "ratio")], "v DOUBLE, u STRING")
    assert [r[0] for r in m.select(numbers.format_metric(F.col("v"), F.col("u"), F.lit("SAR"))).collect()] == ["12.3%", "1.50×", "90 days", "SAR 1,000", None]
