"""A mix of documents in which each source has its target share of all tokens.

Every document gets a key by a seeded hash. Within its source the documents stand in the order of
that key; prefix sums of their tokens are taken in two steps (sums by range of keys, then within each
range), so a source with most of the corpus is spread over all tasks. A source is cut at its budget;
where the budget is larger than the source, whole rounds are repeated first, up to ``max_repeats``.

The total is the largest at which every source can fill its share, but not less than ``least_total``
of the listed sources' own size: a source that would press it further is used as often as allowed
and reported as short. Shares of sources without any tokens are spread over the others in proportion.

Defined results: documents of sources that are not listed, and those without tokens, are never drawn;
a repeated ``doc_id`` counts once; a source with a null, zero or negative share gets nothing; the
document that lies across the cut is left out, so a source ends below its budget by less than it; of a
source listed several times the largest share counts. The list of sources may be of any length: budgets
are computed where the sums are, and only single rows are sent to all workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import cut

#: Ranges of the key within a source: two to the power of this.
RANGE_BITS = 12


def budgets(available: DataFrame, targets: DataFrame, least_total: float) -> DataFrame:
    """(source, target_share, max_repeats, budget, rounds, rest) of all listed sources, by the rule above.

    ``available`` is (source, has), in tokens. ``rounds`` is how often the whole source is used and
    ``rest`` what of the budget is left after that.
    """
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r"), "target_share", "max_repeats")).alias("t"))
    listed = listed.select("source", "t.target_share", "t.max_repeats", F.greatest("t.s", F.lit(0.0)).alias("share"), F.greatest("t.r", F.lit(0)).alias("repeats"))
    each = listed.join(available, "source", "left").withColumn("has", F.coalesce("has", F.lit(0)))
    each = each.withColumn("usable", F.expr("share > 0 AND repeats > 0 AND has > 0")).withColumn("most", F.col("has") * F.col("repeats"))
    usable = each.where("usable")
    shares = usable.agg(F.sum("share").alias("whole"), F.sum("has").cast("double").alias("own"), F.min(F.col("most") / F.col("share")).alias("reach"))
    total = F.greatest(F.least(F.col("own"), F.col("reach") * F.col("whole")), F.col("own") * least_total)
    budget = F.when(F.col("usable"), F.floor(F.least(total * F.col("share") / F.col("whole"), F.col("most")))).otherwise(0)
    out = each.crossJoin(F.broadcast(shares)).withColumn("budget", budget.cast("bigint"))
    rounds = F.when(F.col("has") > 0, F.expr("budget div has")).otherwise(0)
    return out.withColumn("rounds", rounds).select("source", "target_share", "max_repeats", "budget", "rounds", (F.col("budget") - F.col("rounds") * F.col("has")).alias("rest"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17, least_total: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, tokens, times), report) of a corpus (doc_id, source, tokens).

    The report is (source, target_share, actual_share, documents, tokens, budget, max_repeats, short).
    """
    drawn = sized.where("doc_id IS NOT NULL AND tokens > 0").join(targets.select("source").distinct(), "source", "left_semi")
    drawn = drawn.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("tokens").alias("tokens"))
    key = F.xxhash64(F.lit(seed), "doc_id")
    drawn = cut(drawn.withColumns({"key": key, "range": F.shiftrightunsigned(key, 64 - RANGE_BITS).cast("int")}))
    sums = cut(drawn.groupBy("source", "range").agg(F.sum("tokens").alias("in_range")))  # 2 ** RANGE_BITS rows a source at most
    budget = cut(budgets(sums.groupBy("source").agg(F.sum("in_range").alias("has")), targets, least_total))
    line = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "range", F.coalesce(F.sum("in_range").over(line), F.lit(0)).alias("before")).join(budget, "source")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.withColumn("within", F.sum("tokens").over(inside)).join(before, ["source", "range"])
    times = F.col("rounds") + F.when(F.col("before") + F.col("within") <= F.col("rest"), 1).otherwise(0)
    picked = placed.withColumn("times", times).where("times > 0").select("doc_id", "source", "tokens", "times")
    used = picked.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    whole = used.agg(F.sum("tokens").alias("whole"))
    filled = F.coalesce("tokens", F.lit(0))
    report = budget.join(used, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.round(F.try_divide(filled, "whole"), 6).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), filled.alias("tokens"), "budget", "max_repeats",
        (F.coalesce(F.try_divide(filled, "whole"), F.lit(0.0)) < 0.98 * F.col("target_share")).alias("short"),
    )
    return picked, report
