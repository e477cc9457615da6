"""Labels against aliases by exact, prefix and longest-heading match, and duplicates settled.

Aliases and headings are sent to all workers where a count shows that they are short lists, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.ranged import last_seen
from tallyspark.session import cut

MOST_ALIASES = 100_000
#: Levels of a hierarchy that are climbed before the lineage is cut.
CUT_EVERY = 6


def small(df: DataFrame, most: int = MOST_ALIASES) -> DataFrame:
    """A list to be joined: sent to all workers if a count shows that it is one, else left to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def match_labels(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label_id, type, candidates, item_id): all items with an equal alias, and the item if there is exactly one.

    ``labels`` is (label_id, type, squashed), ``aliases`` (item_id, type, squashed).
    """
    found = labels.join(small(aliases.select("item_id", "type", "squashed").distinct()), ["type", "squashed"], "left")
    sets = found.groupBy("label_id", "type").agg(F.sort_array(F.collect_set("item_id")).alias("candidates"))
    return sets.withColumn("item_id", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)))


def prefix_matches(labels: DataFrame, aliases: DataFrame, least: int = 4) -> DataFrame:
    """(label_id, item_id): labels and aliases of which one begins the other, both of at least ``least`` letters.

    The first letters are joined by equality, so that only aliases with the same start are compared.
    """
    a = labels.where(F.length("squashed") >= least).withColumn("_head", F.substring("squashed", 1, least))
    b = aliases.where(F.length("squashed") >= least).select("item_id", "type", F.col("squashed").alias("alias"), F.substring("squashed", 1, least).alias("_head")).distinct()
    met = a.join(small(b), ["type", "_head"]).where(F.col("squashed").startswith(F.col("alias")) | F.col("alias").startswith(F.col("squashed")))
    return met.select("label_id", "item_id").distinct()


def longest_heading(labels: DataFrame, headings: DataFrame) -> DataFrame:
    """(label_id, heading, rest): the longest heading that a label runs on from, and what is left of the label."""
    b = small(headings.select(F.col("heading"), F.substring("heading", 1, 3).alias("_head")).distinct())
    met = labels.withColumn("_head", F.substring("label", 1, 3)).join(b, "_head").where(F.col("label").startswith(F.concat("heading", F.lit(" "))))
    best = met.groupBy("label_id", "label").agg(F.max_by("heading", F.struct(F.length("heading"), F.col("heading"))).alias("heading"))
    return best.select("label_id", "heading", F.expr("substring(label, length(heading) + 2)").alias("rest"))


def resolve(in_section: Column, conflict: Column, many: Column, anchor_conflict: Column, unconfirmed: Column, alias: Column, anchor: Column) -> Column:
    """Where a mapping comes from, the first that holds: section, conflicts, several, unconfirmed total, alias, anchor, nothing."""
    return F.when(in_section, "alias_in_section").when(conflict, "section_conflict").when(many, "alias_multiple").when(anchor_conflict, "anchor_conflict").when(unconfirmed, "alias_total_unconfirmed").when(alias, "alias").when(anchor, "anchor").otherwise("no_alias_no_anchor")


def settle_duplicates(claims: DataFrame) -> DataFrame:
    """(statement_id, row_id, item_id, verdict): rows that claim one item. ``claims`` has (statement_id, row_id, ordinal, item_id, figures).

    Rows with the same figures: the first is kept, the others are its repeats. Otherwise all are duplicates.
    """
    group = Window.partitionBy("statement_id", "item_id")
    signed = claims.withColumn("sign", F.to_json(F.array_sort(F.col("figures"))))
    first = F.row_number().over(group.orderBy("ordinal", "row_id"))
    seen = signed.withColumns({"n": F.count(F.lit(1)).over(group), "same": F.min("sign").over(group).eqNullSafe(F.max("sign").over(group)), "place": first})
    return seen.select("statement_id", "row_id", "item_id", F.when(F.col("n") == 1, "kept").when(F.col("same") & (F.col("place") == 1), "kept").when(F.col("same"), "repeat_of").otherwise("duplicate").alias("verdict"))


def required_parts(children: DataFrame, rules: DataFrame) -> DataFrame:
    """(parent, item_id): parents that have all items a rule needs. ``children`` is (parent, item_id), ``rules`` (item_id, needs)."""
    have = children.groupBy("parent").agg(F.collect_set("item_id").alias("have"))
    return have.crossJoin(small(rules.select("item_id", "needs"), 1000)).where(F.size(F.array_except("needs", "have")) == 0).select("parent", "item_id")


def _loops(step: DataFrame) -> bool | None:
    """Whether a row is its own ancestor; None where there are no rows."""
    return step.agg(F.max(F.col("row_id").eqNullSafe(F.col("ancestor")))).first()[0]


def ancestors(rows: DataFrame) -> DataFrame:
    """(statement_id, row_id, ancestor, distance): each row with all rows above it, however deep.

    ``rows`` is (statement_id, row_id, parent_id) with one parent a row. A row above itself is an error.
    """
    step = rows.where("parent_id IS NOT NULL").select("statement_id", "row_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"))
    out, edge = step, rows.where("parent_id IS NOT NULL").select("statement_id", F.col("row_id").alias("ancestor"), F.col("parent_id").alias("_up"))
    level, loops = 1, _loops(step)
    while loops is not None:
        if loops:  # climbing that never ends has entered a cycle, and the rows of a cycle meet themselves
            raise ValueError("a row lies above itself")
        level += 1
        step = step.join(edge, ["statement_id", "ancestor"]).select("statement_id", "row_id", F.col("_up").alias("ancestor"), F.lit(level).alias("distance"))
        step = cut(step) if level % CUT_EVERY == 0 else step
        loops = _loops(step)
        out = out if loops is None else out.unionByName(step)
    return out


def carried_forward(rows: DataFrame, state: str) -> DataFrame:
    """Rows with the state of the last heading above them, in document order; statements of any length."""
    return last_seen(rows, ["statement_id"], ["ordinal"], F.when(F.col("is_heading"), F.col(state)), f"{state}_carried")


def latest_version(vocabulary: DataFrame) -> DataFrame:
    """(tag, version, definition): each tag as its latest version has it."""
    return vocabulary.groupBy("tag").agg(F.max("version").alias("version"), F.max_by("definition", "version").alias("definition"))
