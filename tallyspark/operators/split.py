"""Deterministic splits by hashed keys: parts, pools, moves, and what each part holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.hashing import SPLIT_SALT, bucket

HOLDOUT_END, VALIDATION_END = 15, 30


def hashed_part(key: Column) -> Column:
    """holdout for buckets below 15, validation below 30, else fit; salted."""
    b = bucket(key, SPLIT_SALT)
    return F.when(b < HOLDOUT_END, "holdout").when(b < VALIDATION_END, "validation").otherwise("fit")


def hashed_pool(source: Column, cik_key: Column, name_key: Column) -> Column:
    """Pools of new issuers, unsalted: filers by number (below 15 test), others by name (65, 20 and 15 in a hundred)."""
    by_number, by_name = bucket(cik_key), bucket(name_key)
    named = F.when(by_name < 65, "train").when(by_name < 85, "model_test").otherwise("blind")
    return F.when(source == "sec", F.when(by_number < 15, "model_test").otherwise("train")).when(source == "pdf", named)


def with_moves(parts: DataFrame, moves: DataFrame, key: str = "key") -> DataFrame:
    """Parts after moves (key, to_part); a move overrides only the holdout."""
    moved = parts.join(moves.select(key, "to_part"), key, "left")
    return moved.withColumn("part", F.when(F.col("part") == "holdout", F.coalesce("to_part", "part")).otherwise(F.col("part"))).drop("to_part")


def part_counts(documents: DataFrame) -> DataFrame:
    """(part, issuers, documents, english, arabic, both, annual, interim) of documents (part, key, language, period).

    Languages are counted by issuer, ``both`` those with documents in either.
    """
    issuer = documents.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("language") == "en").alias("en"), F.bool_or(F.col("language") == "ar").alias("ar"), F.count_if(F.col("period") == "annual").alias("annual"), F.count_if(F.col("period") == "interim").alias("interim"))
    return issuer.groupBy("part").agg(F.count(F.lit(1)).alias("issuers"), F.sum("n").alias("documents"), F.count_if("en").alias("english"), F.count_if("ar").alias("arabic"), F.count_if(F.col("en") & F.col("ar")).alias("both"), F.sum("annual").alias("annual"), F.sum("interim").alias("interim"))


def impure_keys(rows: DataFrame, key: str, part: str) -> DataFrame:
    """(key, parts) of keys whose rows lie in several parts; empty for a valid split."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(part)).alias("parts")).where("size(parts) > 1")


def out_of_order(log: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of a log whose time lies before that of the row above, by line number."""
    from pyspark.sql import Window

    return log.withColumn("_before", F.lag(at).over(Window.partitionBy(key).orderBy("line"))).where(F.col(at) < F.col("_before")).drop("_before")
