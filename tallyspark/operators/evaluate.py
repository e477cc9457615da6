"""Scores of predictions and gates: confusion counts, F1, strata with totals, percentiles, paired bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import stats
from tallyspark.operators.ranged import running


def joined_once(rows: DataFrame, predictions: DataFrame, on: str) -> DataFrame:
    """Rows with their prediction, one to one. Rows on either side without a partner have a null ``truth_n`` or ``prediction_n``;
    a count above one marks a repeated id."""
    a = rows.withColumn("truth_n", F.count(F.lit(1)).over(Window.partitionBy(on)))
    b = predictions.withColumn("prediction_n", F.count(F.lit(1)).over(Window.partitionBy(on)))
    return a.join(b, on, "full")


def confusion(pairs: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, prediction, n); null is a class of its own."""
    return pairs.groupBy(*(by or []), truth, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, truth: str, prediction: str, classes: DataFrame) -> DataFrame:
    """(class, support, predicted, correct, precision, recall, f1) for every class of the list, unsupported ones included."""
    support = counts.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth).eqNullSafe(F.col(prediction)), F.col("n")).otherwise(0)).alias("correct"))
    emitted = counts.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("predicted"))
    s, e, c = support.alias("s"), emitted.alias("e"), classes.select("class").alias("c")
    out = c.join(s, F.col("c.class").eqNullSafe(F.col("s.class")), "left").join(e, F.col("c.class").eqNullSafe(F.col("e.class")), "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    out = out.select(F.col("c.class").alias("class"), zero("support"), zero("predicted"), zero("correct"))
    return out.withColumns({"precision": F.coalesce(F.try_divide(F.col("correct").cast("double"), "predicted"), F.lit(0.0)), "recall": F.coalesce(F.try_divide(F.col("correct").cast("double"), "support"), F.lit(0.0)), "f1": stats.f1(F.col("correct"), F.col("support"), F.col("predicted"))})


def macro_f1(scores: DataFrame) -> DataFrame:
    """(classes, supported, macro_f1): the mean over all classes, unsupported ones included."""
    return scores.agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("support") > 0).alias("supported"), F.avg("f1").alias("macro_f1"))


def summary(pairs: DataFrame, truth: str, prediction: str, by: list[str]) -> DataFrame:
    """(by..., rows, correct, abstain_support, correct_abstentions, false_mappings) for every stratum and their total (null)."""
    same = F.col(truth).eqNullSafe(F.col(prediction))
    none = F.col(truth).isNull()
    return pairs.rollup(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("correct"), F.count_if(none).alias("abstain_support"), F.count_if(none & same).alias("correct_abstentions"), F.count_if(none & ~same).alias("false_mappings"))


def wilson(counts: DataFrame, right: str, total: str) -> DataFrame:
    """Add ``low`` and ``high`` of the 95 % Wilson interval."""
    return counts.withColumns({"low": stats.wilson_low(F.col(right), F.col(total)), "high": stats.wilson_high(F.col(right), F.col(total))})


def times(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, median, p90, total, most): by stratum and over all (null strata); the percentile is the nearest rank.

    Exact without a task that holds a stratum: equal values are counted first, the counts are added up along
    the order of the values by range, and a rank is read where the running count reaches it. A stratum
    without any value has a null median.
    """
    flag = "_all"
    given = rows.select(*by, F.col(value).alias("_v"))
    each = given.where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn(flag, F.lit(False))
    whole = each.groupBy("_v").agg(F.sum("_n").alias("_n")).select(*[F.lit(None).cast(rows.schema[b].dataType).alias(b) for b in by], "_v", "_n", F.lit(True).alias(flag))
    key = [flag, *by]
    line = running(each.unionByName(whole), key, ["_v"], F.col("_n"), "_upto")
    sums = line.groupBy(*key).agg(F.sum("_n").alias("n"), F.max("_v").alias("most"))
    at = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "n", "most")
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    reached = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    n = F.col("n")
    ranks = line.join(at, on).groupBy(*key, "n", "most").agg(reached(F.floor((n + 1) / 2)).alias("_a"), reached(F.floor(n / 2) + 1).alias("_b"), reached(F.ceil(n * F.lit(0.9).cast("decimal(2,1)"))).alias("p90"))
    total = given.groupBy(*by).agg(F.sum("_v").alias("total")).withColumn(flag, F.lit(False)).unionByName(given.agg(F.sum("_v").alias("total")).select(*[F.lit(None).cast(rows.schema[b].dataType).alias(b) for b in by], "total", F.lit(True).alias(flag)))
    side = ranks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "n", "most", ((F.col("_a").cast("double") + F.col("_b")) / 2).alias("median"), "p90")
    return total.join(side, on, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), "median", "p90", "total", "most")


def gate_cube(rows: DataFrame, by: list[str], right: Column) -> DataFrame:
    """(by..., cells, right, files, share) over every combination of strata; null stands for all."""
    return rows.cube(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_if(right).alias("right"), F.countDistinct("file_id").alias("files"), F.try_divide(F.count_if(right).cast("double"), F.count(F.lit(1))).alias("share"))


def set_recall(expected: Column, found: Column) -> Column:
    """The share of an expected set that was found; null for an empty set."""
    return F.try_divide(F.size(F.array_intersect(expected, found)).cast("double"), F.size(F.array_distinct(expected)))


def compare_reports(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., before, after, change): rows that differ between two reports, absent ones included."""
    both = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("_a")).join(after.select(*key, F.col(value).alias("after"), F.lit(True).alias("_b")), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select(*key, "before", "after", change.alias("change"))


def paired_bootstrap(pairs: DataFrame, stratum: str, issuer: str, before: str, after: str, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """(stratum, difference, low, high): difference of two accuracies, issuers resampled whole within their stratum.

    Counts are aggregated to one row per issuer. Each issuer then draws how often it is taken in every
    resample (Poisson with mean one, seeded by its name), so that the resamples are sums which every
    task prepares for its own issuers; a stratum of any size is one vector a task. The bounds are order
    statistics at q (n - 1).
    """
    sums = pairs.groupBy(stratum, issuer).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(before).cast("int")).alias("a"), F.sum(F.col(after).cast("int")).alias("b"))
    drawn = sums.select(stratum, F.xxhash64(F.lit(seed), issuer).alias("draw"), "n", "a", "b")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for key, draw, n, a, b in pdf.itertuples(index=False, name=None):
                taken = np.random.Generator(np.random.Philox(draw % 2**64)).poisson(1.0, resamples)
                held = total.setdefault(key, np.zeros((3, resamples + 1)))
                held += np.outer((n, a, b), np.concatenate((taken, [1])))  # the last is the sample itself
        rows = [(key, k, *held[:, k]) for key, held in total.items() for k in range(resamples + 1)]
        yield pd.DataFrame(rows, columns=[stratum, "k", "n", "a", "b"])

    parts = drawn.mapInPandas(vectors, f"`{stratum}` STRING, k INT, n DOUBLE, a DOUBLE, b DOUBLE")
    each = parts.groupBy(stratum, "k").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("d", F.try_divide(F.col("b") - F.col("a"), "n"))
    found = F.array_sort(F.collect_list(F.when(F.col("k") < resamples, F.col("d"))))  # resamples numbers a stratum
    out = each.groupBy(stratum).agg(F.max(F.when(F.col("k") == resamples, F.col("d"))).alias("difference"), found.alias("found"))
    at = lambda q: F.element_at("found", F.floor(F.lit(q) * (F.size("found") - 1)).cast("int") + 1)
    return out.select(stratum, "difference", at(0.025).alias("low"), at(0.975).alias("high"))


def breakdown(rows: DataFrame, by: list[str], right: str, seconds: str) -> DataFrame:
    """(by..., cells, right, accuracy, low, high, mean_seconds): accuracy with its interval; the mean time only where all are timed."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col(right)).alias("right"), F.when(F.count(seconds) == F.count(F.lit(1)), F.avg(seconds)).alias("mean_seconds"))
    return wilson(n, "right", "cells").withColumn("accuracy", F.try_divide(F.col("right").cast("double"), "cells"))


def agreement(runs: DataFrame, key: list[str], run: str, value: str) -> DataFrame:
    """(key..., runs, values, agreed): whether all runs give one value; a missing value is one too."""
    marked = F.coalesce(F.concat(F.lit("="), F.col(value).cast("string")), F.lit("\u2205"))
    return runs.groupBy(*key).agg(F.countDistinct(run).alias("runs"), F.countDistinct(marked).alias("values")).withColumn("agreed", F.col("values") == 1)
