"""Labelled rows: deduplication with conflicts, caps, routing with counted drops, exclusions, coverage, multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.hashing import seeded_order
from tallyspark.operators.ranged import numbered


def dedupe_lowest(rows: DataFrame, group: list[str], target: str, ident: str) -> DataFrame:
    """(group..., ident, target): the lowest id of every group whose rows agree on the target; a null target is one too.

    Pre-aggregated: a group of any size moves one row per task.
    """
    marked = F.coalesce(F.concat(F.lit("="), F.col(target).cast("string")), F.lit("∅"))
    return rows.groupBy(*group).agg(F.min(ident).alias(ident), F.min(marked).alias("_a"), F.max(marked).alias("_b"), F.min(target).alias(target)).where("_a = _b").drop("_a", "_b")


def conflicts(rows: DataFrame, group: list[str], target: str) -> DataFrame:
    """(group..., rows, targets): groups whose rows do not agree, with how many rows and different targets."""
    marked = F.coalesce(F.concat(F.lit("="), F.col(target).cast("string")), F.lit("∅"))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(marked).alias("targets")).where("targets > 1")


def cap_per_key(rows: DataFrame, key: str, ident: str, most: int) -> DataFrame:
    """At most so many rows per key, those with the lowest ids.

    Keys of up to ``most`` rows pass without sorting; the cut of a larger one is found by a partial
    sort in each task, so a key with a third of all rows is no hot group.
    """
    part = F.spark_partition_id()
    local = Window.partitionBy(key, "_part").orderBy(ident)
    first = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= most)
    whole = Window.partitionBy(key).orderBy(ident)
    return first.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= most).drop("_n", "_part")


def select_rows(rows: DataFrame, ident: str, limit: int, seed: str) -> DataFrame:
    """A deterministic sample: the rows with the lowest seeded hashes."""
    return rows.orderBy(seeded_order(seed, F.col(ident).cast("string")), ident).limit(limit)


def route(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``drop_reason``: the first rule that holds, null for rows that are kept."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return rows.withColumn("drop_reason", out)


def route_counts(routed: DataFrame) -> DataFrame:
    """(drop_reason, n): how many rows each rule dropped; null for those kept."""
    return routed.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def coverage_curve(counts: DataFrame, percents: list[int]) -> DataFrame:
    """(percent, needed): how many keys, the most frequent first, cover each share of all rows; 0 if none do.

    ``counts`` is (key, n). Keys of one frequency are summed first, so that the running sum is over
    different frequencies only, however many keys there are.
    """
    by_n = counts.groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    order = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    line = by_n.withColumns({"rows_before": F.coalesce(F.sum(F.col("n") * F.col("keys")).over(order), F.lit(0)), "keys_before": F.coalesce(F.sum("keys").over(order), F.lit(0))})
    total = by_n.agg(F.sum(F.col("n") * F.col("keys")).alias("total"))
    wanted = counts.sparkSession.createDataFrame([(p,) for p in percents], "percent INT")
    at = line.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(wanted))
    goal = F.col("percent") * F.col("total")
    hit = at.where(((F.col("rows_before") + F.col("n") * F.col("keys")) * 100 >= goal))
    missing = F.greatest(F.ceil((goal / 100 - F.col("rows_before")) / F.col("n")), F.lit(1))
    first = hit.groupBy("percent").agg(F.min(F.col("keys_before") + missing).alias("needed"))
    return wanted.join(first, "percent", "left").select("percent", F.coalesce(F.col("needed").cast("bigint"), F.lit(0)).alias("needed"))


def consistency_removals(counts: DataFrame, key: list[str], target: str, n: str, dominance: tuple[int, int], null_dominance: tuple[int, int]) -> DataFrame:
    """(key..., target, n, reason): targets to drop from keys with several, compared as whole numbers.

    A key whose best target is not dominant loses all (``ambiguous``); otherwise only the dominant
    one is kept, or null where null dominates (``outlier``). Keys without any target are left alone.
    """
    w = Window.partitionBy(*key)
    mapped = F.when(F.col(target).isNotNull(), F.col(n))
    seen = counts.withColumns({"_all": F.sum(n).over(w), "_mapped": F.sum(mapped).over(w), "_top": F.max(mapped).over(w), "_null": F.coalesce(F.max(F.when(F.col(target).isNull(), F.col(n))).over(w), F.lit(0))})
    seen = seen.withColumn("_winners", F.count_if(F.col(target).isNotNull() & (F.col(n) == F.col("_top"))).over(w)).where("_mapped IS NOT NULL")
    ambiguous = (F.col("_winners") != 1) | (F.col("_top") * dominance[1] < F.col("_mapped") * dominance[0])
    keep_null = F.col("_null") * null_dominance[1] >= F.col("_all") * null_dominance[0]
    kept = F.when(keep_null, F.col(target).isNull()).otherwise(F.col(target).isNotNull() & (F.col(n) == F.col("_top")))
    reason = F.when(ambiguous, "ambiguous").when(~kept, "outlier")
    return seen.withColumn("reason", reason).where("reason IS NOT NULL").select(*key, target, n, "reason")


def apply_exclusions(rows: DataFrame, removals: DataFrame, on: list[str]) -> DataFrame:
    """Rows without those that a removal names; null keys are equal."""
    cond = None
    r = removals.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = part if cond is None else cond & part
    return rows.join(r, cond, "left_anti")


def contradictory_keys(rows: DataFrame, key: str, target: str, one: str, other: str) -> DataFrame:
    """Keys that have both of two targets that exclude each other."""
    return rows.groupBy(key).agg(F.bool_or(F.col(target) == one).alias("a"), F.bool_or(F.col(target) == other).alias("b")).where("a AND b").select(key)


def multiset_match(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): copies paired off one to one within equal keys, in the order of their ids; a key may hold any number."""
    a = numbered(left.select(*on, left_id), on, [left_id], "_n")
    b = numbered(right.select(*on, right_id), on, [right_id], "_n")
    return a.join(b, [*on, "_n"]).select(left_id, right_id)


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(columns..., missing, extra): how often each tuple is lacking on the right, or too often there. Counted, not expanded."""
    a = left.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_side", F.lit(1))
    b = right.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_side", F.lit(-1))
    net = a.unionByName(b).groupBy(*columns).agg(F.sum(F.col("_n") * F.col("_side")).alias("_d")).where("_d <> 0")
    return net.select(*columns, F.greatest("_d", F.lit(0)).alias("missing"), F.greatest(-F.col("_d"), F.lit(0)).alias("extra"))


def near_matches(queries: DataFrame, names: DataFrame, top: int, least: float = 0.5) -> DataFrame:
    """(query, name, similarity, rank): names whose words overlap a query's by at least ``least`` (Jaccard).

    ``queries`` is (query, words), ``names`` (name, words). Two sets that overlap so much share one of
    the rarest words of each, as many as may be missing and one; only those meet, so that a word that
    many names have forms no pairs, and none is lost.
    """
    a = queries.select("query", F.array_distinct("words").alias("q")).where("size(q) > 0")
    b = names.select("name", F.array_distinct("words").alias("m")).where("size(m) > 0")
    count = a.select(F.explode("q").alias("word")).unionByName(b.select(F.explode("m").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df: DataFrame, who: str, words: str) -> DataFrame:
        ranked = df.select(who, words, F.explode(words).alias("word")).join(count, "word").groupBy(who, words).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
        keep = F.size(words) - F.ceil(F.size(words) * least - 1e-9).cast("int") + 1
        return ranked.select(who, words, F.explode(F.slice("r", 1, keep)).alias("x")).select(who, words, F.col("x.word").alias("word"))

    met = rarest(a, "query", "q").join(rarest(b, "name", "m"), "word").select("query", "q", "name", "m").distinct()
    shared = F.size(F.array_intersect("q", "m"))
    scored = met.withColumn("similarity", shared / (F.size("q") + F.size("m") - shared)).where(F.col("similarity") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "name"))).where(F.col("rank") <= top).select("query", "name", "similarity", "rank")


def length_stats(rows: DataFrame, size: str) -> DataFrame:
    """(count, mean, p95, max) of a size; the percentile by nearest rank."""
    return rows.agg(F.count(size).alias("count"), F.round(F.avg(size), 3).alias("mean"), F.percentile_approx(size, 0.95, 1_000_000).alias("p95_approx"), F.max(size).alias("max"))


def cell_map(snapshots: dict[str, DataFrame], key: list[str], value: str) -> DataFrame:
    """Cells of several snapshots side by side; a cell that one lacks is null there."""
    out = None
    for name, df in snapshots.items():
        side = df.select(*key, F.col(value).alias(name))
        out = side if out is None else out.join(side, key, "full")
    return out


def owner_sample(rows: DataFrame, ident: str, critical: str, n: int, seed: str) -> DataFrame:
    """All critical rows and a seeded draw of so many others."""
    rest = select_rows(rows.where(~F.coalesce(F.col(critical), F.lit(False))), ident, n, seed)
    return rows.where(F.col(critical)).unionByName(rest)


def top_k(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """(by..., value, n, rank): the k most frequent values of each group, ties by the value; counts before anything is ranked."""
    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), value) if by else Window.orderBy(F.desc("n"), value)
    if not by:
        n = n.orderBy(F.desc("n"), value).limit(k)  # a partial sort in each task, then at most k rows
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
