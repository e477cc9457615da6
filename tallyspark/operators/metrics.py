"""Margins, liquidity, leverage, coverage, return, turnover, working-capital days and growth.

Each metric is an expression over the readings of one document and period; four lookups (this period, the
closing date, the opening date, the same length a year earlier) are joined once for all of them, and every
reading with its flags is projected once.
A missing part makes the result null and is named in ``flags``, in the order in which it is read;
it is never a zero. Ratios are divided as DOUBLE after exact DECIMAL sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.periods import months_before
from tallyspark.operators.frame import facts
from tallyspark.operators.taxonomy import SIGN, STATEMENT

DEBT = ("short_term_borrowings", "current_portion_long_term_debt", "long_term_borrowings")
LEASES = ("lease_liabilities_current", "lease_liabilities_non_current")
CASH = ("cash_and_equivalents", "short_term_investments")
QUICK = ("cash_and_equivalents", "short_term_investments", "trade_receivables")
#: Statement flags that unit notes deal with, so that no reading passes them on.
UNIT_FLAGS = ("scale_conflict", "scale_implausible", "currency_missing", "currency_conflict")
NOT_PASSED = (*UNIT_FLAGS, "scale_missing", "currency_from_domicile", "currency_inferred")


@dataclass(frozen=True)
class Policy:
    """The three settings that formulas depend on."""

    negative_margin_denominator: str = "compute_and_flag"
    include_lease_liabilities: bool = False
    day_count_basis: int = 365


NO_FLAGS = "cast(array() AS array<string>)"


@dataclass
class Value:
    """A figure while a formula is built, in SQL: its value, the arrays of flags so far, and what it has read."""

    sql: str
    flags: list[str]
    read: list[tuple[str, str]]


def _flag(when: str, name: str) -> str:
    return f"if({when}, array('{name}'), {NO_FLAGS})"


def _divided(x: str, y: str) -> str:
    return f"try_divide({x}, {y})"


class Reader:
    """Reads items for one period; every reading brings its flags.

    A reading is a struct (v, any, flags) that is projected once, in ``readings``, however many formulas use it.
    """

    def __init__(self, policy: Policy):
        self.policy = policy
        self.used: set[tuple[str, str]] = set()
        self.readings: dict[str, str] = {}
        self.means: dict[str, str] = {}

    def _value(self, name: str, kind: str) -> Value:
        return Value(f"{name}.v", [f"{name}.flags"], [(kind, f"{name}.any")])

    def _read(self, side: str, item: str, role: str | None = None) -> Value:
        self.used.add((side, item))
        name, fact, kind = f"r_{side}_{item}", f"{side}_{item}", STATEMENT[item]
        role = role or item
        n = f"coalesce({fact}.n, 0)"
        flags = [_flag(f"{n} > 1", f"duplicate_input:{role}"), _flag(f"{n} = 0", f"missing_input:{role}"), _flag(f"{n} = 0 AND {kind}_unmapped > 0", f"input_may_be_unmapped:{role}"), f"if({n} > 0, concat({kind}_passed, {fact}.flags), {NO_FLAGS})"]
        self.readings[name] = f"named_struct('v', if({n} = 1, {fact}.value, NULL), 'any', {n} > 0, 'flags', concat({', '.join(flags)}))"
        return self._value(name, kind)

    def flow(self, item: str) -> Value:
        return self._read("now", item)

    def closing(self, item: str) -> Value:
        return self._read("close", item)

    def prior_flow(self, item: str) -> Value:
        return self._read("prior", item, f"{item}@prior_period")

    def average(self, item: str) -> Value:
        """The mean of opening and closing balance; the closing balance alone, flagged, where there is no opening."""
        closing, name, fact, kind = self.closing(item).sql.removesuffix(".v"), f"a_{item}", f"open_{item}", STATEMENT[item]
        self.used.add(("open", item))
        n, usable = f"coalesce({fact}.n, 0)", f"{closing}.v IS NOT NULL AND months IS NOT NULL"
        flags = [f"{closing}.flags", _flag(f"{closing}.v IS NOT NULL AND months IS NULL", "period_not_a_duration"), _flag(f"{usable} AND {n} > 1", f"duplicate_input:{item}@opening"), _flag(f"{usable} AND {n} = 0", "average_fallback_to_closing"), f"if({usable} AND {n} > 0, {fact}.flags, {NO_FLAGS})"]
        mean = f"CASE WHEN {usable} AND {n} = 0 THEN cast({closing}.v AS double) WHEN {usable} AND {n} = 1 THEN cast({fact}.value + {closing}.v AS double) / 2 END"
        self.means[name] = f"named_struct('v', {mean}, 'any', {closing}.any OR ({usable} AND {n} > 0), 'flags', concat({', '.join(flags)}))"
        return self._value(name, kind)

    def total(self, *values: Value) -> Value:
        """The sum; null if any part is."""
        return Value("(" + " + ".join(v.sql for v in values) + ")", [f for v in values for f in v.flags], [r for v in values for r in v.read])

    def minus(self, a: Value, b: Value) -> Value:
        return Value(f"({a.sql} - {b.sql})", [*a.flags, *b.flags], [*a.read, *b.read])

    def ratio(self, a: Value, b: Value) -> Value:
        """Null, with the reason, for a zero or negative denominator; zero is noted even if the numerator is missing."""
        x, y = f"cast({a.sql} AS double)", f"cast({b.sql} AS double)"
        zero, negative = f"coalesce({y} = 0, false)", f"coalesce({a.sql} IS NOT NULL AND {y} < 0, false)"
        return Value(f"CASE WHEN {y} > 0 THEN {_divided(x, y)} END", [*a.flags, *b.flags, _flag(zero, "undefined_zero_denominator"), _flag(negative, "undefined_negative_denominator")], [*a.read, *b.read])

    def growth(self, current: Value, prior: Value) -> Value:
        """The change as a fraction of the base; the difference is taken exactly before it is divided."""
        share = self.ratio(current, prior)
        change = _divided(f"cast({current.sql} - {prior.sql} AS double)", f"cast({prior.sql} AS double)")
        return Value(f"CASE WHEN ({share.sql}) IS NOT NULL THEN {change} END", share.flags, share.read)

    def days(self) -> Value:
        """The length of the period in days."""
        length = f"CASE WHEN months = 12 THEN {float(self.policy.day_count_basis)}D ELSE cast(datediff(end_date, opened) AS double) END"
        return Value(length, [_flag("months IS NULL", "period_not_a_duration")], [])

    def debt(self) -> Value:
        return self.total(*map(self.closing, (*DEBT, *LEASES) if self.policy.include_lease_liabilities else DEBT))

    def net_debt(self) -> Value:
        return self.minus(self.debt(), self.total(*map(self.closing, CASH)))

    def ebitda(self) -> Value:
        return self.total(self.flow("operating_income"), self.flow("depreciation_amortization"))

    def turnover_days(self, stock: str, flow: str) -> Value:
        share, days = self.ratio(self.average(stock), self.flow(flow)), self.days()
        return Value(f"(({share.sql}) * ({days.sql}))", [*share.flags, *days.flags], share.read)

    def cash_cycle(self) -> Value:
        a, b, c = self.turnover_days("trade_receivables", "revenue"), self.turnover_days("inventories", "cost_of_revenue"), self.turnover_days("trade_payables", "cost_of_revenue")
        return Value(f"({a.sql} + {b.sql} - {c.sql})", [*a.flags, *b.flags, *c.flags], [*a.read, *b.read, *c.read])


@dataclass(frozen=True)
class Metric:
    """One entry of the registry; ``annual_only`` skips periods that are not a year."""

    id: str
    unit: str
    anchor: str
    formula: Callable[[Reader], Value]
    annual_only: bool = False


REGISTRY: tuple[Metric, ...] = (
    Metric("ebitda", "currency", "income", Reader.ebitda),
    Metric("roa", "ratio", "income", lambda r: r.ratio(r.flow("net_income"), r.average("total_assets")), True),
    Metric("roe", "ratio", "income", lambda r: r.ratio(r.flow("net_income_attributable_parent"), r.average("equity_attributable_parent")), True),
    Metric("current_ratio", "times", "balance", lambda r: r.ratio(r.closing("total_current_assets"), r.closing("total_current_liabilities"))),
    Metric("quick_ratio", "times", "balance", lambda r: r.ratio(r.total(*map(r.closing, QUICK)), r.closing("total_current_liabilities"))),
    Metric("cash_ratio", "times", "balance", lambda r: r.ratio(r.closing("cash_and_equivalents"), r.closing("total_current_liabilities"))),
    Metric("total_debt", "currency", "balance", Reader.debt),
    Metric("debt_to_equity", "times", "balance", lambda r: r.ratio(r.debt(), r.closing("total_equity"))),
    Metric("net_debt", "currency", "balance", Reader.net_debt),
    Metric("net_debt_to_ebitda", "times", "income", lambda r: r.ratio(r.net_debt(), r.ebitda()), True),
    Metric("interest_coverage", "times", "income", lambda r: r.ratio(r.flow("operating_income"), r.flow("finance_costs"))),
    Metric("asset_turnover", "times", "income", lambda r: r.ratio(r.flow("revenue"), r.average("total_assets")), True),
    Metric("dso", "days", "income", lambda r: r.turnover_days("trade_receivables", "revenue")),
    Metric("dio", "days", "income", lambda r: r.turnover_days("inventories", "cost_of_revenue")),
    Metric("dpo", "days", "income", lambda r: r.turnover_days("trade_payables", "cost_of_revenue")),
    Metric("cash_conversion_cycle", "days", "income", Reader.cash_cycle),
    Metric("revenue_growth", "ratio", "income", lambda r: r.growth(r.flow("revenue"), r.prior_flow("revenue"))),
    Metric("net_income_growth", "ratio", "income", lambda r: r.growth(r.flow("net_income"), r.prior_flow("net_income"))),
)
MARGINS = (("gross_margin", "gross_profit"), ("operating_margin", "operating_income"), ("net_margin", "net_income"))
METRIC_IDS = (*(m for m, _ in MARGINS), *(m.id for m in REGISTRY))


def _heads(statements: DataFrame, unmapped: DataFrame) -> DataFrame:
    """One row per document: currency, scale, flags and unmapped rows of its two primary statements."""
    both = statements.join(unmapped, "statement_id", "left")
    pick = lambda kind, column: F.max(F.when(F.col("type") == kind, F.col(column)))
    out = []
    for kind in ("income", "balance"):
        out += [pick(kind, "statement_id").alias(f"{kind}_id"), pick(kind, "currency").alias(f"{kind}_currency"), pick(kind, "scale").alias(f"{kind}_scale"), F.coalesce(pick(kind, "unmapped"), F.lit(0)).alias(f"{kind}_unmapped")]
        out.append(F.coalesce(F.flatten(F.collect_list(F.when(F.col("type") == kind, F.col("flags")))), F.array().cast("array<string>")).alias(f"{kind}_flags"))
    heads = both.groupBy("doc_id").agg(*out)
    listed = lambda names: "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    for kind in ("income", "balance"):  # what a reading passes on, and the unit flags with the id of their statement
        heads = heads.withColumns({
            f"{kind}_passed": F.expr(f"filter({kind}_flags, f -> NOT array_contains({listed(NOT_PASSED)}, f))"),
            f"{kind}_units": F.expr(f"transform(array_intersect({listed(UNIT_FLAGS)}, {kind}_flags), f -> concat(f, ':', {kind}_id))"),
        })
    return heads


def compute(rows: DataFrame, statements: DataFrame, periods: DataFrame, line_items: DataFrame, policy: Policy | None = None, only: tuple[str, ...] = METRIC_IDS) -> DataFrame:
    """(doc_id, metric_id, end_date, months, unit, value, flags) for every period of the anchor statement.

    ``rows`` are the frame rows of primary statements, ``statements`` those statements. Only the items
    that the wanted metrics read are aggregated and joined.
    """
    policy = policy or Policy()
    reader = Reader(policy)
    wanted = [(m, m.formula(reader)) for m in REGISTRY if m.id in only]
    found = margins(rows, statements, periods, policy).where(F.col("metric_id").isin(*only)) if any(m in only for m, _ in MARGINS) else None
    if not wanted:
        return found
    heads = _heads(statements, line_items.groupBy("statement_id").agg(F.count_if(F.col("mapping_flag").isNotNull()).alias("unmapped")))
    anchor = statements.select("doc_id", "statement_id", F.col("type").alias("anchor")).join(periods.select("statement_id", "end_date", "months"), "statement_id").select("doc_id", "anchor", "end_date", "months").distinct()
    at = anchor.withColumns({"opened": months_before(F.col("end_date"), F.col("months")), "year_before": months_before(F.col("end_date"), 12)})
    known = facts(rows, sorted({i for _, i in reader.used}))
    for name, end, length in (("now", "end_date", "months"), ("close", "end_date", None), ("open", "opened", None), ("prior", "year_before", "months")):
        own = sorted(i for n, i in reader.used if n == name)
        if own:
            side = known.select(F.col("doc_id").alias("_doc"), F.col("end_date").alias("_end"), F.col("months").alias("_len"), *[F.col(i).alias(f"{name}_{i}") for i in own])
            side = side if length else side.where("_len IS NULL")
            on = (F.col("doc_id") == F.col("_doc")) & (F.col(end) == F.col("_end"))
            at = at.join(side, on & F.col(length).eqNullSafe(F.col("_len")) if length else on, "left").drop("_doc", "_end", "_len")
    at = at.join(heads, "doc_id")
    base = ["doc_id", "anchor", "end_date", "months", "opened", *[f"{k}_{c}" for k in ("income", "balance") for c in ("id", "currency", "scale", "units")]]
    opening = sorted({f"open_{i}" for n, i in reader.used if n == "open"})
    once = at.select(*base, *opening, *[F.expr(x).alias(n) for n, x in reader.readings.items()])
    once = once.select(*base, *reader.readings, *[F.expr(x).alias(n) for n, x in reader.means.items()])
    results = ", ".join(_result(metric, value) for metric, value in wanted)
    long = once.select("doc_id", "end_date", "months", F.expr(f"explode(array_compact(array({results})))").alias("m"))
    long = long.select("doc_id", "m.metric_id", "end_date", "months", "m.unit", "m.value", "m.flags")
    return long if found is None else long.unionByName(found)


def _result(metric: Metric, value: Value) -> str:
    """The struct of one metric, null for periods of another statement: value and flags after the notes on units."""
    read = {kind: "(" + (" OR ".join(sorted({c for k, c in value.read if k == kind})) or "false") + ")" for kind in ("income", "balance")}
    kinds = sorted({k for k, _ in value.read})
    both = f"({read['income']} AND {read['balance']})" if len(kinds) > 1 else "false"
    amount = metric.unit == "currency"
    currencies = f"({both} AND NOT income_currency <=> balance_currency)"
    scales = f"coalesce({both} AND income_scale != balance_scale, false)"
    blocked = f"({currencies} OR {scales})" if amount else currencies
    notes = [_flag(currencies, "currency_mismatch"), _flag(scales, "scale_mismatch")]
    for place, kind in [(p, k) for p in (0, 1) for k in kinds]:
        if amount or len(kinds) > 1:
            other = "balance" if kind == "income" else "income"
            first = f"{kind}_id < coalesce({other}_id, '\uffff')"
            mine = f"{'' if place == 0 else 'NOT '}({first}) AND {read[kind]} AND {'true' if amount else both} AND NOT {blocked}"
            notes.append(f"if({mine}, {kind}_units, {NO_FLAGS})")
    flags = f"array_distinct(concat({', '.join((*value.flags, *notes))}))"
    figure = f"CASE WHEN NOT {blocked} THEN cast({value.sql} AS double) END"
    if metric.annual_only:
        year = "coalesce(months = 12, false)"
        why = "CASE WHEN months IS NULL THEN 'period_not_a_duration' WHEN months > 12 THEN 'period_longer_than_year' ELSE 'interim_not_annualized' END"
        figure, flags = f"CASE WHEN {year} THEN {figure} END", f"CASE WHEN {year} THEN {flags} ELSE array({why}) END"
    return f"CASE WHEN anchor = '{metric.anchor}' THEN named_struct('metric_id', '{metric.id}', 'unit', '{metric.unit}', 'value', {figure}, 'flags', {flags}) END"


def _noted(when: Column, name: str) -> Column:
    return F.when(when, F.array(F.lit(name)))


def margins(rows: DataFrame, statements: DataFrame, periods: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Three margins per duration of the income statement: as reported, signs kept, all statement flags passed on."""
    policy = policy or Policy()
    income = statements.where("type = 'income'").select("doc_id", "statement_id", F.col("flags").alias("statement_flags"))
    spans = income.join(periods.select("statement_id", "period_key", "end_date", "months"), "statement_id")
    items = ["revenue", *(item for _, item in MARGINS)]
    wanted = rows.where((F.col("type") == "income") & F.col("canonical_id").isin(*items))
    by_item = wanted.groupBy("statement_id", "period_key", "canonical_id").agg(F.count(F.lit(1)).alias("n"), F.max("reported").alias("reported"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_ordinal", "row_id", "cell_flags"))), lambda x: x["cell_flags"])).alias("flags"), F.max(F.when(F.col("reported") < 0, F.lit(True)).otherwise(F.lit(False))).alias("minus"))
    packed = by_item.groupBy("statement_id", "period_key").agg(F.map_from_entries(F.collect_list(F.struct("canonical_id", F.struct("n", "reported", "flags", "minus")))).alias("by_item"))
    at = spans.join(packed, ["statement_id", "period_key"], "left")

    def part(item: str) -> tuple[Column, list[Column]]:
        fact = F.col("by_item")[item]
        n = F.coalesce(fact["n"], F.lit(0))
        wrong = ~fact["minus"] if SIGN[item] == "-" else fact["minus"]
        return F.when(n == 1, fact["reported"]), [_noted(n > 1, f"duplicate_input:{item}"), F.when(n > 0, fact["flags"]), _noted(F.coalesce(wrong & (fact["reported"] != 0), F.lit(False)), "sign_unexpected"), _noted(n == 0, f"missing_input:{item}")]

    base, base_flags = part("revenue")
    out = []
    for metric, item in MARGINS:
        top, top_flags = part(item)
        x, y = top.cast("double"), base.cast("double")
        both = x.isNotNull() & y.isNotNull()
        negative = F.coalesce(both & (y < 0), F.lit(False))
        keep = policy.negative_margin_denominator == "compute_and_flag"
        value = F.when(both & ((y != 0) if keep else (y > 0)), F.try_divide(x, y))
        notes = [_noted(F.coalesce(y == 0, F.lit(False)), "undefined_zero_denominator"), _noted(negative, "negative_base" if keep else "undefined_negative_denominator")]
        flags = F.array_distinct(F.flatten(F.array_compact(F.array(F.col("statement_flags"), *top_flags, *base_flags, *notes))))
        out.append(F.struct(F.lit(metric).alias("metric_id"), F.lit("ratio").alias("unit"), value.alias("value"), flags.alias("flags")))
    return at.select("doc_id", "end_date", "months", F.explode(F.array(*out)).alias("m")).select("doc_id", "m.metric_id", "end_date", "months", "m.unit", "m.value", "m.flags")


def metric_violations(metrics: DataFrame) -> DataFrame:
    """Rows that break the invariant: a null has a reason, and a value is finite."""
    return metrics.where("(value IS NULL AND size(flags) = 0) OR isnan(value)")
