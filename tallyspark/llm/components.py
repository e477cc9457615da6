"""Connected components by a breadth-first search from many seeds at once.

The adjacency lists are hash-partitioned by node once and keep their partitioning; a step brings its
frontier to them. Every node whose hash is smaller than those of all its neighbours is a seed, so each
component has at least one, and all seeds expand concurrently, one frontier a step. Where two seeds meet,
their labels become an edge of a small graph of labels, which is solved the same way; it has at most half
as many nodes, and where many seeds meet in one node the one of the smallest hash takes it, so that it is
the only seed among them next time. No links or labels reach the driver, and each step is checkpointed, so a lost executor
costs no more than that step.

A node with more than ``HUB`` neighbours is split: its list is spread over branches that hang on it, which
changes no component, so that no task holds the list of one node.

Defined results: loops and repeated edges change nothing; a null end drops the edge; no edges give
no rows. The label of a component is one of its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import cut

#: Neighbours of a node from which on its list is split.
HUB = 10_000
#: Links a partition of the lists holds. Lists that do not fill the session's partitions are left to adaptive execution.
LINKS_A_PART = 200_000
#: Begins and ends the first part of a branch's name; no node has it.
BRANCH = "\u0001"


def _rank(node: str | Column) -> Column:
    return F.struct(F.xxhash64(node), node)


def _branch_of(node: str | Column, number: Column, level: int) -> Column:
    return F.concat(F.lit(f"{BRANCH}{level}."), number.cast("string"), F.lit(BRANCH), F.col(node) if isinstance(node, str) else node)


def _hubs(edges: DataFrame, hub: int) -> DataFrame:
    """(h, branches) of the nodes with more than ``hub`` neighbours: at most one in ``hub`` of the edges."""
    degrees = edges.groupBy("u").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > hub)
    return degrees.select(F.col("u").alias("h"), F.ceil(F.col("degree") / hub).cast("int").alias("branches"))


def split_hubs(edges: DataFrame, hub: int = HUB, level: int = 0) -> DataFrame:
    """Edges (u, v) in both directions, in which the list of a node with more than ``hub`` neighbours hangs on branches of it.

    Branches are named after the node and ``level``, so that those of a graph of labels are new.
    """
    hubs = _hubs(edges, hub)
    branch = lambda of, other, n: F.when(F.col(n).isNotNull(), _branch_of(of, F.pmod(F.xxhash64(other), F.col(n)), level)).otherwise(F.col(of))
    ends = edges.join(hubs.select(F.col("h").alias("u"), F.col("branches").alias("nu")), "u", "left").join(hubs.select(F.col("h").alias("v"), F.col("branches").alias("nv")), "v", "left")
    moved = ends.select(branch("u", "v", "nu").alias("u"), branch("v", "u", "nv").alias("v"))
    arms = hubs.select("h", F.explode(F.sequence(F.lit(0), F.col("branches") - 1)).alias("k")).select(F.col("h").alias("u"), _branch_of("h", F.col("k"), level).alias("v"))
    return moved.unionByName(arms).unionByName(arms.select(F.col("v").alias("u"), F.col("u").alias("v")))


def in_place(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep what is known of the partitioning, which a plan that may still change does not tell."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def components(edges: DataFrame, hub: int = HUB, level: int = 0) -> DataFrame:
    """(node, component) for every node of the edges (u, v)."""
    once = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    links = once.count()
    if not links:
        return once.select(F.col("u").alias("node"), F.col("v").alias("component"))
    both = once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lists = both if _hubs(both, hub).isEmpty() else split_hubs(both, hub, level)
    parts = -(-links // LINKS_A_PART)
    least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (lambda df, by: df.repartition(parts, by)) if parts >= least else (lambda df, by: df)
    adjacent = (in_place if parts >= least else cut)(placed(lists, "u"))  # the one exchange of the lists; later joins and aggregates by u find them in place
    seeds = adjacent.groupBy("u").agg(F.min(_rank("v")).alias("least")).where(_rank("u") < F.col("least"))
    frontier = cut(seeds.select(F.col("u").alias("node"), F.col("u").alias("label")))
    owned, meetings = frontier, None
    while not frontier.isEmpty():
        reached = adjacent.join(frontier, adjacent["u"] == frontier["node"]).select(F.col("v").alias("node"), "label").distinct()
        step = cut(placed(reached, "node").join(owned.select("node", F.col("label").alias("owner")), "node", "left"))
        frontier = step.where("owner IS NULL").groupBy("node").agg(F.min(_rank("label"))["label"].alias("label"))
        held = step.where("owner IS NOT NULL AND owner <> label").select(F.col("owner").alias("u"), F.col("label").alias("v"))
        rivals = step.where("owner IS NULL").select("node", F.col("label").alias("v")).join(frontier.select("node", F.col("label").alias("u")), "node").where("u <> v").select("u", "v")
        met = held.unionByName(rivals).distinct()
        meetings = met if meetings is None else meetings.unionByName(met)
        owned = owned.unionByName(frontier)
    merged = components(meetings, hub, level + 1)
    final = owned.join(merged.select(F.col("node").alias("label"), "component"), "label", "left")
    named = final.select("node", F.coalesce("component", "label").alias("component"))
    return _without_branches(named, level)


def _without_branches(named: DataFrame, level: int) -> DataFrame:
    """Nodes only; a component that took the name of a branch is called by the node that the branch hangs on."""
    mine = f"{BRANCH}{level}."
    hung_on = F.expr("substring(component, locate('\u0001', component, 2) + 1)")
    bare = F.when(F.col("component").startswith(mine), hung_on).otherwise(F.col("component"))
    return named.where(~F.col("node").startswith(mine)).select("node", bare.alias("component"))
