"""The analytical projection of statements: one row per mapped, printed, non-null cell.

Inputs are star tables. ``statements``: doc_id, statement_id, type, ordinal, currency, scale, flags.
``periods``: statement_id, period_key, end_date, months (null for a balance). ``line_items``:
statement_id, row_id, ordinal, canonical_id, mapping_flag. ``cells``: statement_id, row_id,
period_key, reported, flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.taxonomy import SIGN


def primary_statements(statements: DataFrame) -> DataFrame:
    """The first statement of each type of a document, in document order; ties by id."""
    order = Window.partitionBy("doc_id", "type").orderBy("ordinal", "statement_id")
    return statements.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def frame_rows(statements: DataFrame, periods: DataFrame, line_items: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with their row, period and statement; ``value`` is the figure in single units.

    Cells of unmapped rows and empty cells are left out before anything is joined.
    """
    mapped = line_items.where("canonical_id IS NOT NULL").select("statement_id", "row_id", "canonical_id", F.col("ordinal").alias("row_ordinal"))
    printed = cells.where("reported IS NOT NULL").select("statement_id", "row_id", "period_key", "reported", F.col("flags").alias("cell_flags"))
    heads = statements.select("doc_id", "statement_id", "type", "currency", F.col("scale").cast("bigint").alias("scale"), F.col("flags").alias("statement_flags"))
    rows = printed.join(mapped, ["statement_id", "row_id"]).join(periods.select("statement_id", "period_key", "end_date", "months"), ["statement_id", "period_key"]).join(heads, "statement_id")
    return rows.withColumn("value", (F.col("reported") * F.col("scale")).cast("decimal(38,6)"))


def unmapped_rows(line_items: DataFrame) -> DataFrame:
    """(statement_id, unmapped): rows that mapping could not place."""
    return line_items.groupBy("statement_id").agg(F.count_if(F.col("mapping_flag").isNotNull()).alias("unmapped"))


def lookup(rows: DataFrame, item: str, kind: str, end_date: Column, months: Column) -> DataFrame:
    """Rows of one item, statement type, end date and length; null lengths are equal."""
    return rows.where((F.col("canonical_id") == item) & (F.col("type") == kind) & (F.col("end_date") == end_date) & F.col("months").eqNullSafe(months))


def magnitude(item: Column, value: Column) -> Column:
    """Expenses as magnitudes whichever sign they are printed with; everything else as printed."""
    return F.when(item.isin(*[i for i, s in SIGN.items() if s == "-"]), F.abs(value)).otherwise(value)


def facts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, end_date, months, one struct per item): how many rows there are, the value, and its flags.

    Pre-aggregated by item, then brought side by side, so that afterwards every metric reads columns.
    """
    keys = ["doc_id", "end_date", "months", "canonical_id"]
    each = rows.where(F.col("canonical_id").isin(*names)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(magnitude(F.col("canonical_id"), F.col("value"))).alias("value"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("statement_id", "row_ordinal", "row_id", "cell_flags"))), lambda x: x["cell_flags"])).alias("flags"),
    )
    fact = F.struct("n", "value", "flags")
    return each.groupBy("doc_id", "end_date", "months").agg(*[F.max(F.when(F.col("canonical_id") == i, fact)).alias(i) for i in names])


def wide_facts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, end_date, months, one column per item): the pivot with its values listed, so no extra job finds them."""
    signed = rows.withColumn("signed", magnitude(F.col("canonical_id"), F.col("value")))
    return signed.groupBy("doc_id", "end_date", "months").pivot("canonical_id", names).agg(F.max("signed"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """(statement_id, period_key, canonical_id, n) of items printed more than once in a period."""
    return rows.groupBy("statement_id", "period_key", "canonical_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(statements: DataFrame, periods: DataFrame, line_items: DataFrame, cells: DataFrame) -> DataFrame:
    """(rule, subject): what breaks the data model; empty for valid tables.

    The writer refuses a table for which this is not empty.
    """
    bad_scale = statements.where(~F.col("scale").isin(1, 1_000, 1_000_000, 1_000_000_000)).select(F.lit("scale").alias("rule"), F.col("statement_id").alias("subject"))
    twice = statements.groupBy("statement_id").count().where("count > 1").select(F.lit("statement_id_unique"), "statement_id")
    rows_twice = line_items.groupBy("statement_id", "row_id").count().where("count > 1").select(F.lit("row_id_unique"), F.concat_ws(":", "statement_id", "row_id"))
    both = line_items.where("canonical_id IS NOT NULL AND mapping_flag IS NOT NULL").select(F.lit("mapped_or_flagged"), F.concat_ws(":", "statement_id", "row_id"))
    length = periods.where("months IS NOT NULL AND NOT months BETWEEN 1 AND 36").select(F.lit("months"), F.concat_ws(":", "statement_id", "period_key"))
    stray = cells.join(periods, ["statement_id", "period_key"], "left_anti").select(F.lit("unknown_period"), F.concat_ws(":", "statement_id", "period_key"))
    out = bad_scale
    for part in (twice, rows_twice, both, length, stray.distinct()):
        out = out.union(part)
    return out
