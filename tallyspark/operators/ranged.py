"""Running numbers and running maxima along an order, without a task that holds a whole group.

Rows are range-partitioned by key and order, so that a key of any size is cut into consecutive parts.
Each part works for itself, and what a part needs from those before it is one row a part and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyspark.session import cut


def ranged(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_part``: parts of one key follow one another in the order. Written once, so that every reader sees the same parts."""
    return cut(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))


def carried(parts: DataFrame, key: list[str], what: Column) -> tuple[DataFrame, WindowSpec]:
    """((key..., _part, _value), the window over the earlier parts of a key): as many rows as parts a key has."""
    each = parts.groupBy(*key, "_part").agg(what.alias("_value"))
    return each, Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(df: DataFrame, each: DataFrame, key: list[str], carry: Column) -> DataFrame:
    """Join the carried value to the rows of its part; null keys are equal."""
    side = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), carry.alias("_carry"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(side, on).drop("_p", *[f"_k{i}" for i in range(len(key))])


def running(df: DataFrame, key: list[str], order: list[str], what: Column, name: str) -> DataFrame:
    """Rows with the running total of ``what`` within their key up to and with their own, in the order."""
    parts = ranged(df.withColumn("_what", what), key, order)
    each, before = carried(parts, key, F.sum("_what"))
    rows = _with_carry(parts, each, key, F.coalesce(F.sum("_value").over(before), F.lit(0)))
    here = F.sum("_what").over(Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, here + F.col("_carry")).drop("_part", "_carry", "_what")


def numbered(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 within their key, in the order."""
    return running(df, key, order, F.lit(1), name).withColumn(name, F.col(name).cast("bigint"))


def last_seen(df: DataFrame, key: list[str], order: list[str], what: Column, name: str) -> DataFrame:
    """Rows with the last value of ``what`` that is not null within their key, up to and with their own."""
    parts = ranged(df.withColumn("_what", what), key, order)
    each, before = carried(parts, key, F.max_by("_what", F.when(F.col("_what").isNotNull(), F.struct(*order))))
    rows = _with_carry(parts, each, key, F.last("_value", ignorenulls=True).over(before))
    here = F.last("_what", ignorenulls=True).over(Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(here, F.col("_carry"))).drop("_part", "_carry", "_what")


def merged(spans: DataFrame, key: str, first: str, last: str, gap: int) -> DataFrame:
    """(key, first, last): spans merged where they overlap or lie at most ``gap`` apart."""
    parts = ranged(spans.select(key, first, last).where(F.col(first).isNotNull() & F.col(last).isNotNull()), [key], [first, last])
    each, before = carried(parts, [key], F.max(last))
    rows = _with_carry(parts, each, [key], F.max("_value").over(before))
    order = Window.partitionBy(key, "_part").orderBy(first, last)
    reach = F.greatest(F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    fresh = rows.withColumn("_reach", reach).withColumn("_fresh", F.when(F.col("_reach").isNull() | (F.col(first) > F.col("_reach") + gap), 1).otherwise(0)).drop("_carry", "_reach")
    starts, before = carried(fresh, [key], F.sum("_fresh"))
    grouped = _with_carry(fresh, starts, [key], F.coalesce(F.sum("_value").over(before), F.lit(0)))
    group = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_carry")
    return grouped.withColumn("_group", group).groupBy(key, "_group").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_group")
