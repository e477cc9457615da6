"""Statements made from the order tables: star tables of one issuer a nation, and the same as SQL.

Money is cast to DECIMAL before it is summed, so that both engines agree to the last digit. Rules on
the nation's number leave out, double, flag, misstate or rescale some figures, so that every branch
of the operators is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import cut, table

# (statement, item, figure, condition under which it is printed), both in SQL that either engine reads.
LINES: tuple[tuple[str, str, str, str], ...] = (
    ("income", "revenue", "rev", "true"),
    ("income", "cost_of_revenue", "-fr", "true"),
    ("income", "gross_profit", "CASE WHEN nk % 4 = 1 THEN rev - fr + 3 ELSE rev - fr END", "true"),
    ("income", "depreciation_amortization", "-cnt", "true"),
    ("income", "operating_income", "fa", "true"),
    ("income", "finance_costs", "-(cnt * 10)", "nk % 5 <> 0"),
    ("income", "net_income", "fa - fn", "true"),
    ("income", "net_income_attributable_parent", "fa - fn - cnt", "true"),
    ("income", "net_income_attributable_nci", "cnt", "true"),
    ("balance", "cash_and_equivalents", "cnt * 1000", "true"),
    ("balance", "short_term_investments", "cnt * 10", "nk % 10 <> 9"),
    ("balance", "trade_receivables", "sf", "true"),
    ("balance", "inventories", "fr", "true"),
    ("balance", "total_current_assets", "sf", "true"),
    ("balance", "total_non_current_assets", "so", "nk % 9 <> 0"),
    ("balance", "total_assets", "rev", "true"),
    ("balance", "trade_payables", "so", "true"),
    ("balance", "short_term_borrowings", "cnt * 7", "true"),
    ("balance", "current_portion_long_term_debt", "cnt * 3", "true"),
    ("balance", "lease_liabilities_current", "cnt", "true"),
    ("balance", "total_current_liabilities", "CASE WHEN nk % 8 = 5 THEN 0 ELSE fa END", "true"),
    ("balance", "long_term_borrowings", "fr", "true"),
    ("balance", "lease_liabilities_non_current", "cnt * 2", "true"),
    ("balance", "total_non_current_liabilities", "fr", "true"),
    ("balance", "total_liabilities", "fa + fr", "true"),
    ("balance", "equity_attributable_parent", "fn - cnt", "true"),
    ("balance", "non_controlling_interests", "cnt", "true"),
    ("balance", "total_equity", "CASE WHEN nk % 10 = 4 THEN -fn ELSE fn END", "true"),
    ("balance", "total_liabilities_and_equity", "rev", "nk % 2 = 0"),
)
INTERIM_YEAR = 2001


def _base(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = table(spark, folder, "lineitem").select("l_orderkey", price.alias("p"), "l_returnflag", "l_linestatus")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"))
    people = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    part = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("p")).otherwise(F.lit(0).cast("decimal(18,2)")))
    # lines are summed to orders before anything is joined by customer
    by_order = lines.groupBy("l_orderkey").agg(F.sum("p").alias("rev"), part("l_returnflag", "A").alias("fa"), part("l_returnflag", "R").alias("fr"), part("l_returnflag", "N").alias("fn"), part("l_linestatus", "F").alias("sf"), part("l_linestatus", "O").alias("so"), F.count(F.lit(1)).alias("cnt"))
    joined = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    # one row a nation and year, read by several branches of every query: written once, so that the lines are read once
    return cut(joined.groupBy("nk", "yr").agg(*[F.sum(c).cast("decimal(30,2)").alias(c) for c in ("rev", "fa", "fr", "fn", "sf", "so")], F.sum("cnt").alias("cnt")))


def statements(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nk"))
    kinds = F.explode(F.array(F.struct(F.lit("income").alias("type"), F.lit("income").alias("name"), F.lit(0).alias("ordinal")), F.struct(F.lit("balance").alias("type"), F.lit("balance").alias("name"), F.lit(1).alias("ordinal")), F.struct(F.lit("income").alias("type"), F.lit("income2").alias("name"), F.lit(2).alias("ordinal"))))
    s = nations.select("nk", kinds.alias("k")).select("nk", "k.*").where("name <> 'income2' OR nk % 6 = 0")
    currency = F.expr("CASE WHEN type = 'balance' AND nk % 13 = 1 THEN 'USD' ELSE element_at(array('SAR', 'EGP', 'AED', 'USD', 'EUR'), nk % 5 + 1) END")
    scale = F.expr("CASE WHEN type = 'balance' AND nk % 11 = 0 THEN 1 ELSE element_at(array(1, 1000, 1000000), nk % 3 + 1) END").cast("bigint")
    flags = F.array_compact(F.array(F.when(F.expr("type = 'income' AND nk % 4 = 0"), "scale_missing"), F.when(F.expr("type = 'income' AND nk % 5 = 2"), "rows_realigned"), F.when(F.expr("type = 'balance' AND nk % 12 = 7"), "currency_missing")))
    return s.select(F.concat(F.lit("N"), "nk").alias("doc_id"), F.concat(F.lit("N"), "nk", F.lit("-"), "name").alias("statement_id"), "type", "ordinal", currency.alias("currency"), scale.alias("scale"), flags.alias("flags"), "nk")


def _figures(spark: SparkSession, folder: str) -> DataFrame:
    listed = [F.struct(F.lit(s).alias("name"), F.lit(i).alias("item"), F.lit(i).alias("row_id"), F.lit(k).alias("ordinal"), F.expr(f"CAST({x} AS DECIMAL(38,6))").alias("v"), F.expr(ok).alias("ok")) for k, (s, i, x, ok) in enumerate(LINES)]
    listed.append(F.struct(F.lit("income").alias("name"), F.lit("revenue").alias("item"), F.lit("revenue_b").alias("row_id"), F.lit(90).alias("ordinal"), F.expr("CAST(rev + 1 AS DECIMAL(38,6))").alias("v"), F.expr("nk % 7 = 3 AND yr = 1997").alias("ok")))
    listed.append(F.struct(F.lit("income2").alias("name"), F.lit("revenue").alias("item"), F.lit("revenue").alias("row_id"), F.lit(0).alias("ordinal"), F.expr("CAST(rev AS DECIMAL(38,6))").alias("v"), F.expr("nk % 6 = 0").alias("ok")))
    listed.append(F.struct(F.lit("balance").alias("name"), F.lit(None).cast("string").alias("item"), F.lit("other").alias("row_id"), F.lit(91).alias("ordinal"), F.expr("CAST(cnt AS DECIMAL(38,6))").alias("v"), F.expr("nk % 6 = 1").alias("ok")))
    rows = _base(spark, folder).select("nk", "yr", F.explode(F.array(*listed)).alias("x")).select("nk", "yr", "x.*").where("ok")
    whole = F.expr("CASE WHEN nk % 3 = 0 AND row_id <> 'inventories' THEN CAST(floor(v) AS DECIMAL(38,6)) ELSE v END")
    end = F.expr(f"CASE WHEN yr = {INTERIM_YEAR} THEN make_date(yr, 6, 30) ELSE make_date(yr, 12, 31) END")
    return rows.withColumns({"v": whole, "end_date": end}).withColumns({"statement_id": F.concat(F.lit("N"), "nk", F.lit("-"), "name"), "months": F.expr(f"CASE WHEN name = 'balance' THEN NULL WHEN yr = {INTERIM_YEAR} THEN 6 ELSE 12 END"), "period_key": F.expr(f"CASE WHEN name = 'balance' THEN date_format(end_date, 'yyyy-MM-dd') WHEN yr = {INTERIM_YEAR} THEN concat('6M-', date_format(end_date, 'yyyy-MM-dd')) ELSE concat('FY', yr) END")})


def star(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(statements, periods, line_items, cells)."""
    figures = _figures(spark, folder)
    periods = figures.select("statement_id", "period_key", "end_date", "months").distinct()
    lines = figures.groupBy("statement_id", "row_id").agg(F.min("ordinal").alias("ordinal"), F.max("item").alias("canonical_id")).withColumn("mapping_flag", F.when(F.col("canonical_id").isNull(), "no_alias_no_anchor"))
    flags = F.array_compact(F.array(F.when(F.expr("row_id = 'inventories' AND nk % 3 = 1"), "comma_decimal")))
    cells = figures.select("statement_id", "row_id", "period_key", F.col("v").alias("reported"), flags.alias("flags"))
    return statements(spark, folder), periods, lines, cells


def _sql_figures() -> str:
    listed = [f"{{'name': '{s}', 'item': '{i}', 'row_id': '{i}', 'ordinal': {k}, 'v': CAST({x} AS DECIMAL(38,6)), 'ok': {ok}}}" for k, (s, i, x, ok) in enumerate(LINES)]
    listed.append("{'name': 'income', 'item': 'revenue', 'row_id': 'revenue_b', 'ordinal': 90, 'v': CAST(rev + 1 AS DECIMAL(38,6)), 'ok': nk % 7 = 3 AND yr = 1997}")
    listed.append("{'name': 'income2', 'item': 'revenue', 'row_id': 'revenue', 'ordinal': 0, 'v': CAST(rev AS DECIMAL(38,6)), 'ok': nk % 6 = 0}")
    listed.append("{'name': 'balance', 'item': CAST(NULL AS VARCHAR), 'row_id': 'other', 'ordinal': 91, 'v': CAST(cnt AS DECIMAL(38,6)), 'ok': nk % 6 = 1}")
    return ", ".join(listed)


#: The same star tables as common table expressions, to be followed by a SELECT.
STAR_SQL = f"""WITH base AS (
  SELECT c_nationkey AS nk, CAST(year(o_orderdate) AS INTEGER) AS yr, SUM(p) AS rev,
    SUM(CASE WHEN l_returnflag = 'A' THEN p ELSE 0 END) AS fa, SUM(CASE WHEN l_returnflag = 'R' THEN p ELSE 0 END) AS fr, SUM(CASE WHEN l_returnflag = 'N' THEN p ELSE 0 END) AS fn,
    SUM(CASE WHEN l_linestatus = 'F' THEN p ELSE 0 END) AS sf, SUM(CASE WHEN l_linestatus = 'O' THEN p ELSE 0 END) AS so, COUNT(*) AS cnt
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
figures0 AS (SELECT nk, yr, unnest([{_sql_figures()}], recursive := true) FROM base),
figures AS (SELECT nk, yr, name, item, row_id, ordinal, CASE WHEN nk % 3 = 0 AND row_id <> 'inventories' THEN CAST(floor(v) AS DECIMAL(38,6)) ELSE v END AS v,
    CASE WHEN yr = {INTERIM_YEAR} THEN make_date(yr, 6, 30) ELSE make_date(yr, 12, 31) END AS end_date, 'N' || nk || '-' || name AS statement_id,
    CASE WHEN name = 'balance' THEN NULL WHEN yr = {INTERIM_YEAR} THEN 6 ELSE 12 END AS months,
    CASE WHEN name = 'balance' AND yr = {INTERIM_YEAR} THEN yr || '-06-30' WHEN name = 'balance' THEN yr || '-12-31' WHEN yr = {INTERIM_YEAR} THEN '6M-' || yr || '-06-30' ELSE 'FY' || yr END AS period_key
  FROM figures0 WHERE ok),
stmts AS (SELECT n_nationkey AS nk, 'N' || n_nationkey AS doc_id, 'N' || n_nationkey || '-' || name AS statement_id, type, ordinal,
    CASE WHEN type = 'balance' AND n_nationkey % 13 = 1 THEN 'USD' ELSE ['SAR', 'EGP', 'AED', 'USD', 'EUR'][n_nationkey % 5 + 1] END AS currency,
    CASE WHEN type = 'balance' AND n_nationkey % 11 = 0 THEN 1 ELSE [1, 1000, 1000000][n_nationkey % 3 + 1] END AS scale,
    list_filter([CASE WHEN type = 'income' AND n_nationkey % 4 = 0 THEN 'scale_missing' END, CASE WHEN type = 'income' AND n_nationkey % 5 = 2 THEN 'rows_realigned' END, CASE WHEN type = 'balance' AND n_nationkey % 12 = 7 THEN 'currency_missing' END], lambda x: x IS NOT NULL) AS flags
  FROM nation, (VALUES ('income', 'income', 0), ('balance', 'balance', 1), ('income', 'income2', 2)) AS k(type, name, ordinal) WHERE name <> 'income2' OR n_nationkey % 6 = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY ordinal, statement_id) AS rn FROM stmts) WHERE rn = 1),
frame AS (SELECT s.doc_id, s.statement_id, s.type, s.currency, s.scale, f.item AS canonical_id, f.row_id, f.ordinal AS row_ordinal, f.period_key, f.end_date, f.months, f.v AS reported, CAST(f.v * s.scale AS DECIMAL(38,6)) AS value,
    CASE WHEN row_id = 'inventories' AND f.nk % 3 = 1 THEN ['comma_decimal'] ELSE CAST([] AS VARCHAR[]) END AS cell_flags
  FROM figures f JOIN firsts s USING (statement_id) WHERE f.item IS NOT NULL)"""
