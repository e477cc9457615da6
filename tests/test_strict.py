"""Strict headers, unit markers, samples and breakdowns."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import periods, units
from tallyspark.operators import dataset, evaluate

STRICT = [
    ("31 December 2025", ("complete", "none", date(2025, 12, 31), None, "2025-12-31")), ("December 2025", ("month_year", "none", date(2025, 12, 31), None, "2025-12-31")), ("2025", ("year_only", "none", date(2025, 12, 31), None, "2025-12-31")),
    ("six months ended 30 June 2024", ("complete", "explicit", date(2024, 6, 30), 6, "6M-2024-06-30")), ("Year ended 31/12/2024 SAR '000 (unaudited)", ("complete", "explicit", date(2024, 12, 31), 12, "FY2024")),
    ("5 months ended 31 May 2024", ("complete", "invalid", date(2024, 5, 31), None, None)), ("six months and year ended 2024-06-30", ("complete", "invalid", date(2024, 6, 30), None, None)), ("period ended 30 June 2024", ("complete", "generic", date(2024, 6, 30), None, None)),
    ("31/12-2024", ("invalid", "none", None, None, None)), ("31 December 2024 and 31 December 2023", ("invalid", "none", None, None, None)), ("note 5", ("invalid", "none", None, None, None)), ("Total", ("missing", "none", None, None, None)), ("", ("missing", "none", None, None, None)), (None, ("missing", "none", None, None, None)),
    ("31 February 2024", ("invalid", "none", None, None, None)), ("Balance 2024", ("invalid", "none", None, None, None)), ("1445 هـ", ("invalid", "none", None, None, None)),
]


@pytest.mark.parametrize(("text", "want"), STRICT)
def test_interpret(text, want):
    assert periods.interpret(text) == want


def test_interpret_year(spark):
    assert periods.interpret("30 June", reference_year=2024)[:3] == ("complete", "none", date(2024, 6, 30)) and periods.interpret("30 June")[0] == "invalid"
    df = spark.createDataFrame([(t,) for t, _ in STRICT], "t STRING")
    assert [tuple(r.p) for r in df.select(periods.interpret_period(F.col("t")).alias("p")).collect()] == [w for _, w in STRICT]


def test_markers():
    text = "Figures in SAR thousands, except per share data"
    assert [text[a:b] for a, b in units.unit_marker_spans(text)] == ["SAR", "thousands", "except per share"]
    assert units.unit_marker_spans("necessary") == [] and units.unit_marker_spans("") == [] and [("$5")[a:b] for a, b in units.unit_marker_spans("$5")] == ["$"]


def test_samples(spark):
    df = spark.createDataFrame([(str(i), i % 10 == 0, "ab"[i % 2]) for i in range(40)], "id STRING, critical BOOLEAN, v STRING")
    got = dataset.owner_sample(df, "id", "critical", 5, "s").collect()
    assert len(got) == 9 and sum(r.critical for r in got) == 4
    assert [(r.v, r.n, r["rank"]) for r in dataset.top_k(df, [], "v", 1).collect()] == [("a", 20, 1)]
    assert {(r.critical, r.v, r.n) for r in dataset.top_k(df, ["critical"], "v", 1).collect()} == {(True, "a", 4), (False, "b", 20)}


def test_breakdown(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, 3.0), ("b", True, None)], "k STRING, ok BOOLEAN, s DOUBLE")
    got = {r.k: (r.cells, r.accuracy, r.mean_seconds) for r in evaluate.breakdown(df, ["k"], "ok", "s").collect()}
    assert got == {"a": (2, 0.5, 2.0), "b": (1, 1.0, None)}
    runs = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("y", 1, 5), ("y", 2, None)], "k STRING, run INT, v INT")
    assert {r.k: r.agreed for r in evaluate.agreement(runs, ["k"], "run", "v").collect()} == {"x": True, "y": False}
