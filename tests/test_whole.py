"""Queries that have to take all of their input: no row and no field is left out."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from datetime import datetime
from statistics import median

import pytest

from tallyspark.functions import numbers
from tallyspark.operators import mapping, shred
from tallyspark.plans import catalogue
from tallyspark.plans.fixtures import star


def _figures(spark, data):
    rows = spark.read.parquet(f"{data}/metric_values.parquet").select("inputs").collect()
    return {x.input_id: x for r in rows for used in (r.inputs or {}).values() for x in used or [] if x and x.raw_text is not None}


def test_all_printed_figures_are_parsed(spark, data):
    """Every raw text, by brute force; also those without a reported value."""
    want = _figures(spark, data)
    got = {r.input_id: r for r in catalogue.QUERIES["parse_numbers"](spark, data).collect()}
    assert got.keys() == want.keys() and any(x.reported is None for x in want.values())
    for k, x in want.items():
        value, unit, flags = numbers.read_number(x.raw_text)
        assert (got[k].value, got[k].unit, got[k].flags) == (None if value is None else float(value), unit, ";".join(flags))
        assert x.reported is None or value == x.reported


def test_figures_with_raw_text_only(spark, tmp_path):
    cases = [("1,234", 1234.0, []), ("−12", -12.0, []), ("(7)", -7.0, ["parentheses_negative"]), ("SAR 5 million", None, ["unparsed"]), ("-", 0.0, ["dash_as_zero"])]
    used = [(k, t, None) for k, (t, _, _) in enumerate(cases)]
    df = spark.createDataFrame([({"r": used},)], "inputs MAP<STRING, ARRAY<STRUCT<input_id: BIGINT, raw_text: STRING, reported: DECIMAL(38,6)>>>")
    df.write.parquet(f"{tmp_path}/metric_values.parquet")
    got = {r.input_id: (r.value, [f for f in r.flags.split(';') if f]) for r in catalogue.QUERIES["parse_numbers"](spark, str(tmp_path)).collect()}
    assert got == {k: (v, f) for k, (_, v, f) in enumerate(cases)}


def test_no_field_of_a_gold_file_is_lost(spark, tmp_path):
    """Readers who checked a file, and unknown fields of a period, come out of the tables."""
    files = [{"id": "a", "checked_by": ["A", None, "B"], "statements": [{"periods": [{"key": "FY2024", "note": "x"}, {"key": "FY2023"}]}]}, {"id": "b", "checked_by": []}, {"id": "c"}, {"id": "d", "checked_by": "C"}]
    df = spark.createDataFrame([(k, datetime(2025, 1, 1), json.dumps(f)) for k, f in enumerate(files)], "delivery_id LONG, received_at TIMESTAMP, body STRING")
    df.write.parquet(f"{tmp_path}/gold_files.parquet")
    run = lambda name: {tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(*want[name][0]).collect()}
    want = {
        "p4_checked_by": (("file_id", "checked_by_pos", "checked_by"), {("a", 0, "A"), ("a", 1, None), ("a", 2, "B"), ("d", 0, "C")}),
        "p4_periods_full": (("file_id", "statement_pos", "period_pos", "period_key", "extra"), {("a", 0, 0, "FY2024", '{"note": "x"}'), ("a", 0, 1, "FY2023", None)}),
    }
    assert {name: run(name) for name in want} == {name: rows for name, (_, rows) in want.items()}


def test_checked_by_of_all_files(spark, data):
    """By a plain walk of the latest bodies."""
    bodies = sorted((r.received_at, r.delivery_id, r.body) for r in spark.read.parquet(f"{data}/gold_files.parquet").collect())
    latest = {f["id"]: f for _, _, body in bodies for f in shred.parse_body(body) or []}
    want = {(k, p, x) for k, f in latest.items() for p, x in enumerate(f.get("checked_by") or [])}
    got = [tuple(r) for r in catalogue.QUERIES["p4_checked_by"](spark, data).select("file_id", "checked_by_pos", "checked_by").collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_ancestors_of_a_deep_hierarchy(spark):
    schema = "statement_id STRING, row_id STRING, parent_id STRING"
    chain = spark.createDataFrame([("s", f"r{k}", f"r{k + 1}" if k < 15 else None) for k in range(16)], schema)
    got = sorted((r.row_id, r.ancestor, r.distance) for r in mapping.ancestors(chain).collect())
    assert got == sorted((f"r{a}", f"r{b}", b - a) for a in range(16) for b in range(a + 1, 16))
    with pytest.raises(ValueError, match="above itself"):
        mapping.ancestors(spark.createDataFrame([("s", "x", "a"), ("s", "a", "b"), ("s", "b", "a")], schema))


def test_all_order_lines_enter_the_multisets(spark, data):
    """Odd and even lines, net, by brute force over all of them."""
    net = Counter()
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").collect():
        net[r.l_returnflag, r.l_linestatus, int(r.l_quantity)] += 1 if r.l_linenumber % 2 else -1
    got = {(r.l_returnflag, r.l_linestatus, r.quantity): r.missing - r.extra for r in catalogue.QUERIES["multiset_diff"](spark, data).collect()}
    assert got == {k: n for k, n in net.items() if n}


def test_lease_lines_are_judged(spark, data):
    """Columns with their lease lines, by brute force."""
    cells = [(r.statement_id, r.period_key, r.row_id, r.reported * (100000 if r.row_id == "inventories" and r.period_key.startswith("1998") else 1)) for r in star(spark, data)[3].collect()]
    columns = defaultdict(list)
    for s, p, _, x in cells:
        if x:
            columns[s, p].append(abs(x))
    want = {(s, p, k) for s, p, k, x in cells if x and (abs(x) > 10**15 or len(columns[s, p]) >= 5 and abs(x) > 10000 * median(columns[s, p]))}
    got = {(r.statement_id, r.period_key, r.row_id) for r in catalogue.QUERIES["column_outliers"](spark, data).collect()}
    assert any(k.startswith("lease") for _, _, k, _ in cells) and want and got == want
