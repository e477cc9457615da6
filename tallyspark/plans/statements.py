"""Queries over statements: frame, metrics, identities, outliers, coverage, reviews, views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import checks, frame, mapping, metrics, sums
from tallyspark.operators.taxonomy import STATEMENT
from tallyspark.plans.fixtures import LINES, STAR_SQL, star
from tallyspark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    s, p, li, c = star(spark, folder)
    first = frame.primary_statements(s)
    return first, p, li, c, frame.frame_rows(first, p, li, c)


def frame_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _parts(spark, folder)[4]
    return rows.select("doc_id", "statement_id", "canonical_id", "row_id", "period_key", F.col("months").cast("int").alias("months"), F.col("value").cast("double").alias("value"))


def primary_statements(spark: SparkSession, folder: str) -> DataFrame:
    return frame.primary_statements(star(spark, folder)[0]).select("doc_id", "statement_id", "type", "ordinal")


def wide_facts(spark: SparkSession, folder: str) -> DataFrame:
    names = ["revenue", "cost_of_revenue", "net_income", "total_assets", "total_equity"]
    out = frame.wide_facts(_parts(spark, folder)[4], names)
    return out.select("doc_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), F.col("months").cast("int").alias("months"), *[F.col(n).cast("double").alias(n) for n in names])


def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return frame.duplicate_rows(_parts(spark, folder)[4])


def _metrics(spark: SparkSession, folder: str, policy: metrics.Policy | None = None, only: tuple[str, ...] = metrics.METRIC_IDS) -> DataFrame:
    first, p, li, _, rows = _parts(spark, folder)
    return metrics.compute(rows, first, p, li, policy, only)


def _metric_query(*ids: str, policy: metrics.Policy | None = None) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        out = _metrics(spark, folder, policy, ids)
        return out.select("doc_id", "metric_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), F.round("value", 9).alias("value"))

    return query


def metric_flags(spark: SparkSession, folder: str) -> DataFrame:
    out = _metrics(spark, folder, only=("current_ratio", "revenue_growth", "total_debt", "roa"))
    return out.select("doc_id", "metric_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), F.array_join("flags", ";").alias("flags"))


def metrics_full(spark: SparkSession, folder: str) -> DataFrame:
    """Everything: 21 metrics with units and flags."""
    out = _metrics(spark, folder)
    return out.select("doc_id", "metric_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), F.col("months").cast("int").alias("months"), "unit", F.round("value", 9).alias("value"), F.array_join("flags", ";").alias("flags"))


def identity_checks(spark: SparkSession, folder: str) -> DataFrame:
    first, p, _, _, rows = _parts(spark, folder)
    out = checks.identity_checks(rows, first, p)
    return out.select("statement_id", "kind", "period_key", "status", F.col("expected").cast("double").alias("expected"), F.col("actual").cast("double").alias("actual"), F.col("difference").cast("double").alias("difference"), "detail")


def identity_status(spark: SparkSession, folder: str) -> DataFrame:
    first, p, _, _, rows = _parts(spark, folder)
    return checks.identity_checks(rows, first, p).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def period_outliers(spark: SparkSession, folder: str) -> DataFrame:
    c = star(spark, folder)[3]
    # the interim year's sub-minor figures beside full years give rows of very different size
    return checks.period_outliers(c.withColumn("reported", F.when((F.col("row_id") == "net_income") & (F.col("period_key") == "FY1996"), F.col("reported") * 5000).otherwise(F.col("reported")).cast("decimal(38,6)")))


def _column_outliers(c: DataFrame) -> DataFrame:
    c = c.withColumn("reported", F.when((F.col("row_id") == "inventories") & F.col("period_key").startswith("1998"), F.col("reported") * 100000).otherwise(F.col("reported")).cast("decimal(38,6)"))
    return checks.column_outliers(c).select("statement_id", "period_key", "row_id", F.col("reported").cast("double").alias("reported"))


def column_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return _column_outliers(star(spark, folder)[3])


def fractions(spark: SparkSession, folder: str) -> DataFrame:
    return checks.fractions(star(spark, folder)[3])


def unchecked_cells(spark: SparkSession, folder: str) -> DataFrame:
    first, p, _, c, rows = _parts(spark, folder)
    own = c.join(first.select("statement_id"), "statement_id", "left_semi")
    out = checks.unchecked_cells(own, checks.identity_checks(rows, first, p))
    return out.select("statement_id", "row_id", "period_key", F.round("weight", 9).alias("weight"))


def coverage_tally(spark: SparkSession, folder: str) -> DataFrame:
    first, p, _, c, rows = _parts(spark, folder)
    own = c.join(first.select("statement_id"), "statement_id", "left_semi")
    out = checks.tally(checks.unchecked_cells(own, checks.identity_checks(rows, first, p)), "row_id")
    return out.select("row_id", "statements", "cells", F.round("mean_weight", 9).alias("mean_weight"))


def review_reasons(spark: SparkSession, folder: str) -> DataFrame:
    first, p, _, c, rows = _parts(spark, folder)
    own = c.join(first.select("statement_id"), "statement_id", "left_semi")
    out = checks.reviews(first, own, checks.identity_checks(rows, first, p))
    return out.select("statement_id", "status", F.array_join("reasons", ";").alias("reasons"), "numeric_cells", "checked_cells", "flagged_cells")


def digit_suspects(spark: SparkSession, folder: str) -> DataFrame:
    first, p, _, c, rows = _parts(spark, folder)
    found = checks.identity_checks(rows, first, p)
    # a total stands last among the lines of a subtotal
    last = F.when(F.col("kind") == "subtotal", F.expr("concat(slice(line_item_ids, 2, size(line_item_ids)), slice(line_item_ids, 1, 1))")).otherwise(F.col("line_item_ids"))
    out = checks.diagnose_digits(found.withColumn("line_item_ids", last), c)
    return out.select("check_id", F.col("place").cast("int").alias("place"), "row_id", "period_key", F.col("settled").cast("double").alias("settled"))


def unit_caveats(spark: SparkSession, folder: str) -> DataFrame:
    first, _, _, c, _ = _parts(spark, folder)
    out = checks.unit_caveats(first, c.join(first.select("statement_id"), "statement_id", "left_semi"))
    return out.select("statement_id", "n", F.round("middle", 4).alias("middle"), F.array_join("caveats", ";").alias("caveats"))


def inferred_sums(spark: SparkSession, folder: str) -> DataFrame:
    _, _, li, c, _ = _parts(spark, folder)
    lines = c.join(li, ["statement_id", "row_id"]).select("statement_id", "ordinal", "row_id", F.col("row_id").startswith("total").alias("is_total"), F.lit(False).alias("per_share"), "period_key", "reported", F.lit(False).alias("blank"))
    return sums.statement_sums(lines)


YEARS = tuple(range(1995, 2002))


def statement_view(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by years, side by side."""
    _, p, li, c, _ = _parts(spark, folder)
    out = c.join(p, ["statement_id", "period_key"]).withColumn("year", F.year("end_date")).groupBy("statement_id", "row_id").pivot("year", list(YEARS)).agg(F.max(F.col("reported").cast("double")))
    return out.join(li.select("statement_id", "row_id", "ordinal"), ["statement_id", "row_id"]).select("statement_id", "row_id", "ordinal", *[F.col(str(y)).alias(f"y{y}") for y in YEARS])


def latest_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The last period of each statement and item, where it is unique."""
    rows = _parts(spark, folder)[4]
    last = rows.groupBy("statement_id", "canonical_id").agg(F.max(F.struct("end_date", "period_key")).alias("at"))
    found = rows.join(last, ["statement_id", "canonical_id"]).where(F.col("end_date") == F.col("at.end_date"))
    return found.groupBy("statement_id", "canonical_id").agg(F.count(F.lit(1)).alias("n"), F.max("period_key").alias("period_key"), F.max(F.col("value").cast("double")).alias("value")).where("n = 1").drop("n")


def settle_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _parts(spark, folder)[4]
    claims = rows.groupBy("statement_id", "row_id", F.col("row_ordinal").alias("ordinal"), F.col("canonical_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("period_key", F.col("reported").cast("string").alias("reported")))).alias("figures"))
    return mapping.settle_duplicates(claims)


def item_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "taxonomy_items").select("statement", F.col("item_id"), "within")
    chain = items.select(F.col("statement").alias("statement_id"), F.col("item_id").alias("row_id"), F.col("within").alias("parent_id"))
    return mapping.ancestors(chain).select("row_id", "ancestor", "distance")


def model_violations(spark: SparkSession, folder: str) -> DataFrame:
    s, p, li, c = star(spark, folder)
    return frame.violations(s, p, li, c).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


LIQUIDITY, LEVERAGE = ("current_ratio", "quick_ratio", "cash_ratio"), ("total_debt", "debt_to_equity", "net_debt", "net_debt_to_ebitda", "interest_coverage")
RETURNS, DAYS, GROWTH = ("ebitda", "roa", "roe", "asset_turnover"), ("dso", "dio", "dpo", "cash_conversion_cycle"), ("revenue_growth", "net_income_growth")
MARGIN_IDS = tuple(m for m, _ in metrics.MARGINS)

QUERIES: dict[str, Query] = {
    "frame_rows": frame_rows, "primary_statements": primary_statements, "wide_facts": wide_facts, "duplicate_rows": duplicate_rows,
    "margins": _metric_query(*MARGIN_IDS), "liquidity": _metric_query(*LIQUIDITY), "leverage": _metric_query(*LEVERAGE), "returns": _metric_query(*RETURNS), "turnover_days": _metric_query(*DAYS), "growth": _metric_query(*GROWTH),
    "leverage_with_leases": _metric_query("total_debt", "debt_to_equity", policy=metrics.Policy(include_lease_liabilities=True)), "metric_flags": metric_flags, "metrics_full": metrics_full,
    "identity_checks": identity_checks, "identity_status": identity_status, "period_outliers": period_outliers, "column_outliers": column_outliers, "fractions": fractions,
    "unchecked_cells": unchecked_cells, "coverage_tally": coverage_tally, "review_reasons": review_reasons, "digit_suspects": digit_suspects, "unit_caveats": unit_caveats, "inferred_sums": inferred_sums,
    "statement_view": statement_view, "latest_facts": latest_facts, "settle_duplicates": settle_duplicates, "item_ancestors": item_ancestors, "model_violations": model_violations,
}

# --- the same in SQL -------------------------------------------------------------------------------

_NAMES = sorted({i for _, i, _, _ in LINES})
_EXPENSES = "('cost_of_revenue', 'selling_general_admin', 'depreciation_amortization', 'finance_costs', 'income_tax_expense')"
_FACTS = f""",
facts AS (SELECT doc_id, end_date, months, canonical_id, COUNT(*) AS n, MAX(CASE WHEN canonical_id IN {_EXPENSES} THEN abs(value) ELSE value END) AS v FROM frame GROUP BY ALL),
wide AS (SELECT doc_id, end_date, months, {', '.join(f"MAX(CASE WHEN canonical_id = '{i}' AND n = 1 THEN v END) AS {i}, COALESCE(MAX(CASE WHEN canonical_id = '{i}' THEN n END), 0) AS n_{i}" for i in _NAMES)} FROM facts GROUP BY ALL),
spans AS (SELECT DISTINCT s.doc_id, s.type AS anchor, f.end_date, f.months FROM firsts s JOIN figures f USING (statement_id)),
dated AS (SELECT *, CASE WHEN months IS NULL THEN NULL WHEN end_date = last_day(end_date) THEN last_day(CAST(end_date - to_months(months) AS DATE)) ELSE CAST(end_date - to_months(months) AS DATE) END AS opened, CASE WHEN end_date = last_day(end_date) THEN last_day(CAST(end_date - INTERVAL 12 MONTH AS DATE)) ELSE CAST(end_date - INTERVAL 12 MONTH AS DATE) END AS year_before FROM spans),
heads AS (SELECT doc_id, MAX(CASE WHEN type = 'income' THEN currency END) AS ic, MAX(CASE WHEN type = 'balance' THEN currency END) AS bc, MAX(CASE WHEN type = 'income' THEN scale END) AS isc, MAX(CASE WHEN type = 'balance' THEN scale END) AS bsc FROM firsts GROUP BY 1)"""
_WIDE_JOIN = "FROM dated d LEFT JOIN wide w ON d.doc_id = w.doc_id AND d.end_date = w.end_date AND d.months IS NOT DISTINCT FROM w.months LEFT JOIN wide c ON d.doc_id = c.doc_id AND d.end_date = c.end_date AND c.months IS NULL LEFT JOIN wide o ON d.doc_id = o.doc_id AND d.opened = o.end_date AND o.months IS NULL LEFT JOIN wide p ON d.doc_id = p.doc_id AND d.year_before = p.end_date AND d.months IS NOT DISTINCT FROM p.months JOIN heads h ON d.doc_id = h.doc_id"


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {_dbl(b)} > 0 THEN {_dbl(a)} / {_dbl(b)} END"


def _avg(item: str) -> str:
    return f"CASE WHEN c.{item} IS NULL OR d.months IS NULL THEN NULL WHEN COALESCE(o.n_{item}, 0) = 0 THEN CAST(c.{item} AS DOUBLE) WHEN o.n_{item} = 1 THEN CAST(o.{item} + c.{item} AS DOUBLE) / 2 END"


def _growth(item: str) -> str:
    return f"CASE WHEN {_dbl(f'p.{item}')} > 0 THEN {_dbl(f'w.{item} - p.{item}')} / {_dbl(f'p.{item}')} END"


def _turn(stock: str, flow: str) -> str:
    return f"({_ratio(_avg(stock), f'w.{flow}')}) * (CASE WHEN d.months = 12 THEN 365.0 ELSE CAST(date_diff('day', d.opened, d.end_date) AS DOUBLE) END)"


_DEBT = "c.short_term_borrowings + c.current_portion_long_term_debt + c.long_term_borrowings"
_NET = f"({_DEBT}) - (c.cash_and_equivalents + c.short_term_investments)"
_EBITDA = "w.operating_income + w.depreciation_amortization"
_MIXED_NULL = "h.ic <> h.bc"
_SQL_METRICS: dict[str, tuple[str, str, bool, bool]] = {  # id -> (anchor, value, both statements, annual only)
    "ebitda": ("income", _dbl(_EBITDA), False, False), "roa": ("income", _ratio("w.net_income", _avg("total_assets")), True, True), "roe": ("income", _ratio("w.net_income_attributable_parent", _avg("equity_attributable_parent")), True, True),
    "current_ratio": ("balance", _ratio("c.total_current_assets", "c.total_current_liabilities"), False, False), "quick_ratio": ("balance", _ratio("c.cash_and_equivalents + c.short_term_investments + c.trade_receivables", "c.total_current_liabilities"), False, False),
    "cash_ratio": ("balance", _ratio("c.cash_and_equivalents", "c.total_current_liabilities"), False, False), "total_debt": ("balance", _dbl(_DEBT), False, False), "debt_to_equity": ("balance", _ratio(_DEBT, "c.total_equity"), False, False),
    "net_debt": ("balance", _dbl(_NET), False, False), "net_debt_to_ebitda": ("income", _ratio(_NET, _EBITDA), True, True), "interest_coverage": ("income", _ratio("w.operating_income", "w.finance_costs"), False, False),
    "asset_turnover": ("income", _ratio("w.revenue", _avg("total_assets")), True, True), "dso": ("income", _turn("trade_receivables", "revenue"), True, False), "dio": ("income", _turn("inventories", "cost_of_revenue"), True, False), "dpo": ("income", _turn("trade_payables", "cost_of_revenue"), True, False),
    "cash_conversion_cycle": ("income", f"({_turn('trade_receivables', 'revenue')}) + ({_turn('inventories', 'cost_of_revenue')}) - ({_turn('trade_payables', 'cost_of_revenue')})", True, False),
    "revenue_growth": ("income", _growth("revenue"), False, False), "net_income_growth": ("income", _growth("net_income"), False, False),
}


def _sql_metrics(ids: tuple[str, ...], debt: str | None = None) -> str:
    parts = []
    for m in ids:
        anchor, value, both, annual = _SQL_METRICS[m]
        if debt:
            value = value.replace(_DEBT, debt)
        if both:
            value = f"CASE WHEN {_MIXED_NULL} THEN NULL ELSE {value} END"
        if annual:
            value = f"CASE WHEN d.months = 12 THEN {value} END"
        parts.append(f"SELECT d.doc_id, '{m}' AS metric_id, strftime(d.end_date, '%Y-%m-%d') AS end_date, round({value}, 9) AS value {_WIDE_JOIN} WHERE d.anchor = '{anchor}'")
    return STAR_SQL + _FACTS + " " + " UNION ALL ".join(parts)


_SQL_MARGINS = STAR_SQL + """,
m AS (SELECT statement_id, period_key, canonical_id, COUNT(*) AS n, MAX(reported) AS v FROM frame WHERE type = 'income' GROUP BY ALL),
sp AS (SELECT DISTINCT s.doc_id, s.statement_id, f.period_key, f.end_date FROM firsts s JOIN figures f USING (statement_id) WHERE s.type = 'income')
""" + " UNION ALL ".join(f"SELECT sp.doc_id, '{m}' AS metric_id, strftime(sp.end_date, '%Y-%m-%d') AS end_date, round(CASE WHEN CAST(b.v AS DOUBLE) <> 0 THEN CAST(a.v AS DOUBLE) / CAST(b.v AS DOUBLE) END, 9) AS value FROM sp LEFT JOIN m a ON a.statement_id = sp.statement_id AND a.period_key = sp.period_key AND a.canonical_id = '{i}' AND a.n = 1 LEFT JOIN m b ON b.statement_id = sp.statement_id AND b.period_key = sp.period_key AND b.canonical_id = 'revenue' AND b.n = 1" for m, i in metrics.MARGINS)

_READ = lambda side, item, role, kind: [f"CASE WHEN COALESCE({side}.n_{item}, 0) > 1 THEN 'duplicate_input:{role}' END", f"CASE WHEN COALESCE({side}.n_{item}, 0) = 0 THEN 'missing_input:{role}' END", f"CASE WHEN COALESCE({side}.n_{item}, 0) = 0 AND {'d.doc_id IN (SELECT doc_id FROM stmts WHERE nk % 6 = 1)' if kind == 'balance' else 'FALSE'} THEN 'input_may_be_unmapped:{role}' END", *([f"CASE WHEN COALESCE({side}.n_{item}, 0) > 0 AND d.doc_id IN (SELECT doc_id FROM stmts WHERE nk % 5 = 2) THEN 'rows_realigned' END"] if kind == "income" else [])]
_UNIT = "CASE WHEN {when} AND d.doc_id IN (SELECT doc_id FROM stmts WHERE nk % 12 = 7) THEN 'currency_missing:' || d.doc_id || '-balance' END"


def _sql_flags() -> str:
    def row(metric: str, anchor: str, flags: list[str], annual: bool = False) -> str:
        joined = f"array_to_string(list_transform(list_sort(list_transform(list_filter(list_transform(range(len(l)), lambda i: {{'i': i, 'x': l[i + 1]}}), lambda e: e.x IS NOT NULL AND list_position(l, e.x) = e.i + 1), lambda e: e)), lambda e: e.x), ';')"
        if annual:
            joined = f"CASE WHEN months = 12 THEN {joined} ELSE 'interim_not_annualized' END"
        return f"SELECT doc_id, '{metric}' AS metric_id, end_date, {joined} AS flags FROM (SELECT d.doc_id, d.months, strftime(d.end_date, '%Y-%m-%d') AS end_date, [{', '.join(flags)}] AS l {_WIDE_JOIN} WHERE d.anchor = '{anchor}')"

    current = [*_READ("c", "total_current_assets", "total_current_assets", "balance"), *_READ("c", "total_current_liabilities", "total_current_liabilities", "balance"), "CASE WHEN c.total_current_liabilities = 0 THEN 'undefined_zero_denominator' END", "CASE WHEN c.total_current_assets IS NOT NULL AND c.total_current_liabilities < 0 THEN 'undefined_negative_denominator' END"]
    growth = [*_READ("w", "revenue", "revenue", "income"), *_READ("p", "revenue", "revenue@prior_period", "income"), "CASE WHEN p.revenue = 0 THEN 'undefined_zero_denominator' END", "CASE WHEN w.revenue IS NOT NULL AND p.revenue < 0 THEN 'undefined_negative_denominator' END"]
    debt = [x for i in metrics.DEBT for x in _READ("c", i, i, "balance")] + [_UNIT.format(when="TRUE")]
    have = "COALESCE(w.n_net_income, 0) > 0 AND COALESCE(c.n_total_assets, 0) > 0"
    roa = [*_READ("w", "net_income", "net_income", "income"), *_READ("c", "total_assets", "total_assets", "balance"), "CASE WHEN c.total_assets IS NOT NULL AND COALESCE(o.n_total_assets, 0) > 1 THEN 'duplicate_input:total_assets@opening' END", "CASE WHEN c.total_assets IS NOT NULL AND COALESCE(o.n_total_assets, 0) = 0 THEN 'average_fallback_to_closing' END",
           f"CASE WHEN ({_avg('total_assets')}) = 0 THEN 'undefined_zero_denominator' END", f"CASE WHEN w.net_income IS NOT NULL AND ({_avg('total_assets')}) < 0 THEN 'undefined_negative_denominator' END", f"CASE WHEN {have} AND h.ic <> h.bc THEN 'currency_mismatch' END", f"CASE WHEN {have} AND h.isc <> h.bsc THEN 'scale_mismatch' END", _UNIT.format(when=f"{have} AND NOT (h.ic <> h.bc)")]
    return STAR_SQL + _FACTS + " " + " UNION ALL ".join([row("current_ratio", "balance", current), row("revenue_growth", "income", growth), row("total_debt", "balance", debt), row("roa", "income", roa, annual=True)])


# All metrics with all flags. The parts of a formula as SQL: (flags, statement it is read from, whether anything was read).
_Part = tuple[list[str], str, str]
_JOINED = "array_to_string(list_transform(list_sort(list_filter(list_transform(range(len(l)), lambda i: {'i': i, 'x': l[i + 1]}), lambda e: e.x IS NOT NULL AND list_position(l, e.x) = e.i + 1)), lambda e: e.x), ';')"


def _nation(rule: str) -> str:
    return f"d.doc_id IN (SELECT doc_id FROM stmts WHERE {rule})"


def _sql_read(side: str, item: str, role: str | None = None) -> _Part:
    flags = _READ(side, item, role or item, STATEMENT[item])
    if item == "inventories":
        flags.append(f"CASE WHEN COALESCE({side}.n_{item}, 0) > 0 AND {_nation('nk % 3 = 1')} THEN 'comma_decimal' END")
    return flags, STATEMENT[item], f"COALESCE({side}.n_{item}, 0) > 0"


def _sql_mean(item: str) -> _Part:
    flags, kind, any_ = _sql_read("c", item)
    usable = f"c.{item} IS NOT NULL AND d.months IS NOT NULL"
    n = f"COALESCE(o.n_{item}, 0)"
    own = f"CASE WHEN {usable} AND {n} > 0 AND {_nation('nk % 3 = 1')} THEN 'comma_decimal' END" if item == "inventories" else "NULL"
    more = [f"CASE WHEN c.{item} IS NOT NULL AND d.months IS NULL THEN 'period_not_a_duration' END", f"CASE WHEN {usable} AND {n} > 1 THEN 'duplicate_input:{item}@opening' END", f"CASE WHEN {usable} AND {n} = 0 THEN 'average_fallback_to_closing' END", own]
    return [*flags, *more], kind, f"({any_} OR ({usable} AND {n} > 0))"


def _sql_denominator(x: str, y: str) -> _Part:
    return [f"CASE WHEN {_dbl(y)} = 0 THEN 'undefined_zero_denominator' END", f"CASE WHEN ({x}) IS NOT NULL AND {_dbl(y)} < 0 THEN 'undefined_negative_denominator' END"], "", ""


_DAYS: _Part = (["CASE WHEN d.months IS NULL THEN 'period_not_a_duration' END"], "", "")


def _sql_days(stock: str, flow: str) -> list[_Part]:
    return [_sql_mean(stock), _sql_read("w", flow), _sql_denominator(_avg(stock), f"w.{flow}"), _DAYS]


def _sql_growth(item: str) -> list[_Part]:
    return [_sql_read("w", item), _sql_read("p", item, f"{item}@prior_period"), _sql_denominator(f"w.{item}", f"p.{item}")]


_CLOSING = lambda *items: [_sql_read("c", i) for i in items]
_EARNED = [_sql_read("w", "operating_income"), _sql_read("w", "depreciation_amortization")]
_SQL_PARTS: dict[str, list[_Part]] = {
    "ebitda": _EARNED, "roa": [_sql_read("w", "net_income"), _sql_mean("total_assets"), _sql_denominator("w.net_income", _avg("total_assets"))],
    "roe": [_sql_read("w", "net_income_attributable_parent"), _sql_mean("equity_attributable_parent"), _sql_denominator("w.net_income_attributable_parent", _avg("equity_attributable_parent"))],
    "current_ratio": [*_CLOSING("total_current_assets", "total_current_liabilities"), _sql_denominator("c.total_current_assets", "c.total_current_liabilities")],
    "quick_ratio": [*_CLOSING(*metrics.QUICK, "total_current_liabilities"), _sql_denominator("c.cash_and_equivalents + c.short_term_investments + c.trade_receivables", "c.total_current_liabilities")],
    "cash_ratio": [*_CLOSING("cash_and_equivalents", "total_current_liabilities"), _sql_denominator("c.cash_and_equivalents", "c.total_current_liabilities")],
    "total_debt": _CLOSING(*metrics.DEBT), "debt_to_equity": [*_CLOSING(*metrics.DEBT, "total_equity"), _sql_denominator(_DEBT, "c.total_equity")], "net_debt": _CLOSING(*metrics.DEBT, *metrics.CASH),
    "net_debt_to_ebitda": [*_CLOSING(*metrics.DEBT, *metrics.CASH), *_EARNED, _sql_denominator(_NET, _EBITDA)],
    "interest_coverage": [_sql_read("w", "operating_income"), _sql_read("w", "finance_costs"), _sql_denominator("w.operating_income", "w.finance_costs")],
    "asset_turnover": [_sql_read("w", "revenue"), _sql_mean("total_assets"), _sql_denominator("w.revenue", _avg("total_assets"))],
    "dso": _sql_days("trade_receivables", "revenue"), "dio": _sql_days("inventories", "cost_of_revenue"), "dpo": _sql_days("trade_payables", "cost_of_revenue"),
    "cash_conversion_cycle": [*_sql_days("trade_receivables", "revenue"), *_sql_days("inventories", "cost_of_revenue"), *_sql_days("trade_payables", "cost_of_revenue")],
    "revenue_growth": _sql_growth("revenue"), "net_income_growth": _sql_growth("net_income"),
}
_UNITS = {m.id: m.unit for m in metrics.REGISTRY}


def _sql_full() -> str:
    out = []
    for m, parts in _SQL_PARTS.items():
        anchor, value, mixed, annual = _SQL_METRICS[m]
        read = {k: "(" + " OR ".join(c for _, kind, c in parts if kind == k) + ")" for k in {kind for _, kind, _ in parts if kind}}
        both = f"{read['income']} AND {read['balance']}" if len(read) > 1 else "FALSE"
        amount = _UNITS[m] == "currency"
        currencies, scales = f"({both} AND h.ic IS DISTINCT FROM h.bc)", f"({both} AND h.isc <> h.bsc)"
        notes = [f"CASE WHEN {currencies} THEN 'currency_mismatch' END", f"CASE WHEN {scales} THEN 'scale_mismatch' END"]
        if "balance" in read and (amount or len(read) > 1):
            notes.append(_UNIT.format(when=f"{read['balance']} AND {'TRUE' if amount else both} AND NOT {currencies}"))
        flags = [f for p, _, _ in parts for f in p] + notes
        joined, figure = _JOINED, f"CASE WHEN {_MIXED_NULL} THEN NULL ELSE {value} END" if mixed else value
        if annual:
            joined = f"CASE WHEN months = 12 THEN {joined} WHEN months IS NULL THEN 'period_not_a_duration' WHEN months > 12 THEN 'period_longer_than_year' ELSE 'interim_not_annualized' END"
            figure = f"CASE WHEN d.months = 12 THEN {figure} END"
        out.append(f"SELECT doc_id, '{m}' AS metric_id, end_date, months, '{_UNITS[m]}' AS unit, value, {joined} AS flags FROM (SELECT d.doc_id, CAST(d.months AS INTEGER) AS months, strftime(d.end_date, '%Y-%m-%d') AS end_date, round({figure}, 9) AS value, [{', '.join(flags)}] AS l {_WIDE_JOIN} WHERE d.anchor = '{anchor}')")
    part = lambda t, item: [f"CASE WHEN {t}.n > 1 THEN 'duplicate_input:{item}' END", f"CASE WHEN {t}.mi AND {t}.v <> 0 THEN 'sign_unexpected' END", f"CASE WHEN {t}.n IS NULL THEN 'missing_input:{item}' END"]
    for m, item in metrics.MARGINS:
        x, y = "CAST(CASE WHEN a.n = 1 THEN a.v END AS DOUBLE)", "CAST(CASE WHEN b.n = 1 THEN b.v END AS DOUBLE)"
        flags = [*part("a", item), *part("b", "revenue"), f"CASE WHEN {y} = 0 THEN 'undefined_zero_denominator' END", f"CASE WHEN {x} IS NOT NULL AND {y} < 0 THEN 'negative_base' END"]
        out.append(f"SELECT doc_id, '{m}' AS metric_id, end_date, months, 'ratio' AS unit, value, {_JOINED} AS flags FROM (SELECT sp.doc_id, CAST(sp.months AS INTEGER) AS months, strftime(sp.end_date, '%Y-%m-%d') AS end_date, round(CASE WHEN {y} <> 0 THEN {x} / {y} END, 9) AS value, list_concat(sp.flags, [{', '.join(flags)}]) AS l FROM sp LEFT JOIN mm a ON a.statement_id = sp.statement_id AND a.period_key = sp.period_key AND a.canonical_id = '{item}' LEFT JOIN mm b ON b.statement_id = sp.statement_id AND b.period_key = sp.period_key AND b.canonical_id = 'revenue')")
    margin = ", mm AS (SELECT statement_id, period_key, canonical_id, COUNT(*) AS n, MAX(reported) AS v, bool_or(reported < 0) AS mi FROM frame WHERE type = 'income' GROUP BY ALL), sp AS (SELECT DISTINCT s.doc_id, s.statement_id, s.flags, f.period_key, f.end_date, f.months FROM firsts s JOIN figures f USING (statement_id) WHERE s.type = 'income')"
    return STAR_SQL + _FACTS + margin + " " + " UNION ALL ".join(out)


def _sql_check(kind: str, total: str, adds: tuple[str, ...], subs: tuple[str, ...], statement: str, where: str) -> str:
    parts = [total, *adds, *subs]
    sub = " ".join(f"LEFT JOIN m m{k} ON m{k}.statement_id = sp.statement_id AND m{k}.period_key = sp.period_key AND m{k}.canonical_id = '{i}'" for k, i in enumerate(parts))
    signed = lambda k, i: f"abs(m{k}.v)" if i in _EXPENSES else f"m{k}.v"
    expected = " + ".join([signed(k + 1, i) for k, i in enumerate(adds)] + [f"(-{signed(k + 1 + len(adds), i)})" for k, i in enumerate(subs)])
    reasons = "[" + ", ".join([f"CASE WHEN m{k}.n > 1 THEN 'ambiguous_input:{i}' END" for k, i in enumerate(parts)] + [f"CASE WHEN m{k}.n IS NULL THEN 'missing_input:{i}' END" for k, i in enumerate(parts)]) + "]"
    text = f"{total} = {' + '.join(adds)}" + "".join(f" - {s}" for s in subs)
    return f"""SELECT statement_id, '{kind}' AS kind, period_key, CASE WHEN len(r) > 0 THEN 'skipped' WHEN abs(a - e) <= {0.5 * (len(adds) + len(subs))} THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN len(r) = 0 THEN CAST(e AS DOUBLE) END AS expected, CASE WHEN len(r) = 0 THEN CAST(a AS DOUBLE) END AS actual, CASE WHEN len(r) = 0 THEN CAST(a - e AS DOUBLE) END AS difference, CASE WHEN len(r) = 0 THEN '{text}' ELSE array_to_string(r, ';') END AS detail
  FROM (SELECT sp.statement_id, sp.period_key, m0.v AS a, {expected} AS e, list_filter({reasons}, lambda x: x IS NOT NULL) AS r FROM sp {sub} WHERE sp.type = '{statement}' AND {where})"""


_SQL_CHECKS = STAR_SQL + """,
m AS (SELECT statement_id, period_key, canonical_id, COUNT(*) AS n, MAX(reported) AS v FROM frame GROUP BY ALL),
sp AS (SELECT DISTINCT s.statement_id, s.type, f.period_key FROM firsts s JOIN figures f USING (statement_id)),
checks AS (""" + " UNION ALL ".join([
    _sql_check("balance_identity", "total_assets", ("total_liabilities_and_equity",), (), "balance", "EXISTS (SELECT 1 FROM m WHERE m.statement_id = sp.statement_id AND m.period_key = sp.period_key AND canonical_id = 'total_liabilities_and_equity')"),
    _sql_check("balance_identity", "total_assets", ("total_liabilities", "total_equity"), (), "balance", "NOT EXISTS (SELECT 1 FROM m WHERE m.statement_id = sp.statement_id AND m.period_key = sp.period_key AND canonical_id = 'total_liabilities_and_equity')"),
    *[_sql_check("subtotal", total, adds, subs, kind, "m0.n IS NOT NULL") for kind, total, adds, subs in checks.TIES],
]) + ")"

_CELLS = "cells AS (SELECT statement_id, row_id, period_key, v AS reported, nk FROM figures)"
_PASSED = ", ".join(f"('{total}', '{item}')" for _, total, adds, subs in (("balance", "total_assets", ("total_liabilities_and_equity",), ()), *checks.TIES) for item in (total, *adds, *subs))
_SQL_VOUCHED = _SQL_CHECKS + f""",
covered AS (SELECT DISTINCT c.statement_id, f.row_id, c.period_key FROM checks c JOIN frame f ON f.statement_id = c.statement_id AND f.period_key = c.period_key WHERE c.status = 'pass' AND list_contains(string_split(regexp_replace(replace(replace(replace(c.detail, ' = ', '|'), ' + ', '|'), ' - ', '|'), ' ', '', 'g'), '|'), f.canonical_id)),
cells AS (SELECT f.statement_id, f.row_id, f.period_key, f.v AS reported, f.nk FROM figures f JOIN firsts s USING (statement_id)),
weighed AS (SELECT *, COALESCE(CAST(abs(reported) AS DOUBLE) / NULLIF(CAST(MAX(abs(reported)) OVER (PARTITION BY statement_id, period_key) AS DOUBLE), 0), 0.0) AS weight FROM cells),
unchecked AS (SELECT w.* FROM weighed w WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.statement_id = w.statement_id AND v.row_id = w.row_id AND v.period_key = w.period_key))"""

ORACLES: dict[str, str] = {
    "frame_rows": STAR_SQL + " SELECT doc_id, statement_id, canonical_id, row_id, period_key, months, CAST(value AS DOUBLE) AS value FROM frame",
    "primary_statements": STAR_SQL + " SELECT doc_id, statement_id, type, ordinal FROM firsts",
    "wide_facts": STAR_SQL + f" SELECT doc_id, strftime(end_date, '%Y-%m-%d') AS end_date, months, " + ", ".join(f"MAX(CASE WHEN canonical_id = '{i}' THEN CAST(CASE WHEN canonical_id IN {_EXPENSES} THEN abs(value) ELSE value END AS DOUBLE) END) AS {i}" for i in ("revenue", "cost_of_revenue", "net_income", "total_assets", "total_equity")) + " FROM frame GROUP BY 1, 2, 3",
    "duplicate_rows": STAR_SQL + " SELECT statement_id, period_key, canonical_id, COUNT(*) AS n FROM frame GROUP BY 1, 2, 3 HAVING COUNT(*) > 1",
    "margins": _SQL_MARGINS, "liquidity": _sql_metrics(LIQUIDITY), "leverage": _sql_metrics(LEVERAGE), "returns": _sql_metrics(RETURNS), "turnover_days": _sql_metrics(DAYS), "growth": _sql_metrics(GROWTH),
    "leverage_with_leases": _sql_metrics(("total_debt", "debt_to_equity"), _DEBT + " + c.lease_liabilities_current + c.lease_liabilities_non_current"),
    "metric_flags": _sql_flags(), "metrics_full": _sql_full(),
    "identity_checks": _SQL_CHECKS + " SELECT * FROM checks",
    "identity_status": _SQL_CHECKS + " SELECT kind, status, COUNT(*) AS n FROM checks GROUP BY 1, 2",
    "period_outliers": STAR_SQL + """, c AS (SELECT statement_id, row_id, period_key, CASE WHEN row_id = 'net_income' AND period_key = 'FY1996' THEN v * 5000 ELSE v END AS r FROM figures)
SELECT statement_id, row_id, period_key FROM (SELECT *, COUNT(*) OVER w AS n, MAX(abs(r)) OVER w AS hi, MIN(abs(r)) OVER w AS lo FROM c WHERE r <> 0 WINDOW w AS (PARTITION BY statement_id, row_id)) WHERE n >= 2 AND hi >= 1000 * lo""",
    "column_outliers": STAR_SQL + """, c AS (SELECT statement_id, row_id, period_key, CASE WHEN row_id = 'inventories' AND period_key LIKE '1998%' THEN v * 100000 ELSE v END AS r FROM figures),
md AS (SELECT statement_id, period_key, COUNT(*) AS n, median(CAST(abs(r) AS DOUBLE)) AS m FROM c WHERE r <> 0 GROUP BY 1, 2)
SELECT c.statement_id, c.period_key, c.row_id, CAST(c.r AS DOUBLE) AS reported FROM c JOIN md USING (statement_id, period_key) WHERE c.r <> 0 AND ((n >= 5 AND abs(c.r) > 10000 * m) OR abs(c.r) > 1e15)""",
    "fractions": STAR_SQL + """, c AS (SELECT statement_id, row_id, period_key, v, v % 1 <> 0 AS part FROM figures),
s AS (SELECT *, COUNT(*) OVER r AS rn, SUM(part::INT) OVER r AS rp, COUNT(*) OVER st AS n, SUM(part::INT) OVER st AS p FROM c WINDOW r AS (PARTITION BY statement_id, row_id), st AS (PARTITION BY statement_id))
SELECT statement_id, row_id, period_key FROM s WHERE p <= 0.2 * n AND part AND (rp < rn OR abs(v) >= 1000)""",
    "unchecked_cells": _SQL_VOUCHED + " SELECT statement_id, row_id, period_key, round(weight, 9) AS weight FROM unchecked",
    "coverage_tally": _SQL_VOUCHED + " SELECT row_id, COUNT(DISTINCT statement_id) AS statements, COUNT(*) AS cells, round(AVG(weight), 9) AS mean_weight FROM unchecked GROUP BY 1",
    "review_reasons": _SQL_VOUCHED + """, k AS (SELECT statement_id, SUM((kind = 'subtotal' AND status = 'fail')::INT) AS sf_, SUM((kind = 'balance_identity' AND status = 'fail')::INT) AS bf, SUM((kind = 'balance_identity' AND status = 'skipped')::INT) AS bs, SUM((kind = 'subtotal' AND status = 'skipped')::INT) AS ss, SUM((status = 'pass')::INT) AS ok FROM checks GROUP BY 1),
n AS (SELECT statement_id, COUNT(*) AS cells, SUM((row_id = 'inventories' AND nk % 3 = 1)::INT) AS bad FROM cells GROUP BY 1),
v AS (SELECT statement_id, COUNT(*) AS seen FROM covered GROUP BY 1),
r AS (SELECT f.statement_id, COALESCE(cells, 0) AS numeric_cells, COALESCE(seen, 0) AS checked_cells, COALESCE(bad, 0) AS flagged_cells, list_filter([CASE WHEN sf_ > 0 THEN 'subtotal_failed' END, CASE WHEN bf > 0 THEN 'identity_failed' END, CASE WHEN bs > 0 THEN 'identity_not_checked' END, CASE WHEN ss > 0 THEN 'subtotal_not_checked:' || ss END, CASE WHEN COALESCE(ok, 0) = 0 THEN 'unchecked' END, CASE WHEN bad > 0 THEN 'comma_decimal:' || bad END], lambda x: x IS NOT NULL) AS l FROM firsts f LEFT JOIN k USING (statement_id) LEFT JOIN n USING (statement_id) LEFT JOIN v USING (statement_id))
SELECT statement_id, CASE WHEN len(l) = 0 THEN 'passed' ELSE 'needs_review' END AS status, array_to_string(l, ';') AS reasons, numeric_cells, checked_cells, CAST(flagged_cells AS BIGINT) AS flagged_cells FROM r""",
    "digit_suspects": _SQL_CHECKS + """,
ck AS (SELECT *, statement_id || ':' || kind || ':' || CASE WHEN kind = 'balance_identity' THEN 'balance' ELSE string_split(detail, ' = ')[1] END || ':' || period_key AS check_id, string_split(detail, ' = ')[1] AS tot, string_split(replace(replace(replace(detail, ' = ', '|'), ' + ', '|'), ' - ', '|'), '|') AS ids FROM checks WHERE status IN ('pass', 'fail')),
pl AS (SELECT *, CAST(CAST(abs(df) AS BIGINT) AS VARCHAR) AS t FROM (SELECT *, CAST(difference AS DECIMAL(38,6)) AS df FROM ck WHERE status = 'fail') WHERE df <> 0 AND df = round(df, 0)),
nm AS (SELECT p.check_id, p.statement_id, p.period_key, length(t) - 1 AS place, p.df, p.tot, f.row_id, f.canonical_id, f.reported AS r FROM pl p JOIN frame f ON f.statement_id = p.statement_id AND f.period_key = p.period_key AND list_contains(p.ids, f.canonical_id) WHERE length(regexp_replace(t, '0+$', '')) = 1),
pa AS (SELECT DISTINCT c.statement_id, c.period_key, f.row_id FROM ck c JOIN frame f ON f.statement_id = c.statement_id AND f.period_key = c.period_key AND list_contains(c.ids, f.canonical_id) WHERE c.status = 'pass'),
se AS (SELECT *, CASE WHEN canonical_id = tot THEN r - df ELSE r + df END AS s FROM nm WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.statement_id = nm.statement_id AND pa.period_key = nm.period_key AND pa.row_id = nm.row_id)),
tx AS (SELECT *, CAST(CAST(abs(r) AS BIGINT) AS VARCHAR) AS a, CAST(CAST(abs(s) AS BIGINT) AS VARCHAR) AS b, CAST(CAST(abs(abs(s) - abs(r)) AS BIGINT) AS VARCHAR) AS g, r = round(r, 0) AND s = round(s, 0) AND (r < 0) = (s < 0) AS ok FROM se),
fi AS (SELECT *, COUNT(*) OVER (PARTITION BY check_id) AS n FROM tx WHERE ok AND ((r <> s AND length(a) = length(b) AND len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] <> p[2])) = 1) OR (r <> 0 AND abs(s) > abs(r) AND length(regexp_replace(g, '0+$', '')) = 1 AND length(g) - 1 BETWEEN length(a) AND length(a) + 2))),
so AS (SELECT DISTINCT statement_id, period_key, row_id FROM fi WHERE n = 1), mk AS (SELECT fi.*, so.row_id IS NOT NULL AS sole, bool_or(so.row_id IS NOT NULL) OVER (PARTITION BY check_id) AS any_sole FROM fi LEFT JOIN so USING (statement_id, period_key, row_id))
SELECT check_id, CAST(place AS INTEGER) AS place, row_id, period_key, CAST(s AS DOUBLE) AS settled FROM mk WHERE NOT any_sole OR sole""",
    "unit_caveats": STAR_SQL + """, md AS (SELECT statement_id, COUNT(*) AS n, median(CAST(abs(v) AS DOUBLE)) AS middle FROM figures WHERE v <> 0 GROUP BY 1)
SELECT f.statement_id, COALESCE(n, 0) AS n, round(middle, 4) AS middle, array_to_string(list_filter([CASE WHEN list_contains(flags, 'scale_missing') THEN 'scale_assumed_units' END, CASE WHEN list_contains(flags, 'scale_missing') AND n >= 5 AND middle < 10000 THEN 'scale_implausible' END], lambda x: x IS NOT NULL), ';') AS caveats FROM firsts f LEFT JOIN md USING (statement_id)""",
    "statement_view": STAR_SQL + " SELECT statement_id, row_id, MIN(ordinal) AS ordinal, " + ", ".join(f"MAX(CASE WHEN year(end_date) = {y} THEN CAST(v AS DOUBLE) END) AS y{y}" for y in YEARS) + " FROM figures GROUP BY 1, 2",
    "latest_facts": STAR_SQL + " SELECT statement_id, canonical_id, MAX(period_key) AS period_key, MAX(CAST(value AS DOUBLE)) AS value FROM (SELECT *, MAX(end_date) OVER (PARTITION BY statement_id, canonical_id) AS last FROM frame) WHERE end_date = last GROUP BY 1, 2 HAVING COUNT(*) = 1",
    "settle_duplicates": STAR_SQL + """, cl AS (SELECT statement_id, row_id, row_ordinal, canonical_id AS item_id, string_agg(period_key || '=' || reported, ',' ORDER BY period_key) AS s FROM frame GROUP BY 1, 2, 3, 4),
g AS (SELECT *, COUNT(*) OVER w AS n, MIN(s) OVER w = MAX(s) OVER w AS same, row_number() OVER (PARTITION BY statement_id, item_id ORDER BY row_ordinal, row_id) AS k FROM cl WINDOW w AS (PARTITION BY statement_id, item_id))
SELECT statement_id, row_id, item_id, CASE WHEN n = 1 OR (same AND k = 1) THEN 'kept' WHEN same THEN 'repeat_of' ELSE 'duplicate' END AS verdict FROM g""",
    "item_ancestors": "WITH RECURSIVE a(row_id, ancestor, distance) AS (SELECT item_id, within, 1 FROM taxonomy_items WHERE within IS NOT NULL UNION ALL SELECT a.row_id, t.within, a.distance + 1 FROM a JOIN taxonomy_items t ON t.item_id = a.ancestor WHERE t.within IS NOT NULL) SELECT * FROM a",
    "model_violations": "SELECT 'x' AS rule, CAST(1 AS BIGINT) AS n WHERE FALSE",
}
