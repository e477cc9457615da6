"""The rows of a statement mapped to canonical items: aliases and anchors, resolved twice, then one row an item.

``rows`` is (statement_id, type, row_id, ordinal, squashed, parent_id, is_total, has_values, checked,
confirmed, figures): ``squashed`` is the label in comparable form without spaces, ``parent_id`` the total a
row is added to, ``checked`` whether a check of that total passed, ``confirmed`` whether any check bears the
row out, ``figures`` the row's figures as one text. ``aliases`` is (item_id, type, squashed, within,
subtotal), ``sums`` (item_id, needs): totals that are known by the items they add up.

An alias names an item outright. An anchor names it by where a row stands: a total by the heading above its
first part or run into it, or by its parts; "basic" and "diluted" by the heading over them. The first round
resolves rows by themselves; the second knows the item of the total that each row is added to.

Defined results: rows without figures are headings and are not mapped; null and empty labels have no alias;
a row without parent has no section; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.mapping import ancestors, small

# Headings over earnings per share, and the rows below them, without spaces.
EPS_HEADINGS = ("earningspershare", "ربحيهالسهم", "ربحيةالسهم")
EPS_ROWS: dict[str, tuple[str, ...]] = {"basic": ("basic", "الاساسيه", "اساسي"), "diluted": ("diluted", "المخفضه", "مخفض")}
#: Letters by which labels and headings meet before they are compared.
HEAD = 4

_ROW = ["statement_id", "row_id"]
_NONE = "cast(array() AS array<struct<kind: string, item: string>>)"


def _aliased(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(statement_id, row_id, aliased): the items whose alias a label is, in order."""
    met = rows.where("has_values AND squashed <> ''").join(small(aliases.select("type", "squashed", "item_id", "within", "subtotal").distinct()), ["type", "squashed"])
    return met.groupBy(*_ROW).agg(F.sort_array(F.collect_set(F.struct("item_id", "within", "subtotal"))).alias("aliased"))


def _in_order() -> Window:
    return Window.partitionBy("statement_id").orderBy("ordinal", "row_id")


def _eps_anchors(rows: DataFrame, items: dict[str, str]) -> DataFrame:
    """Anchors of rows that say "basic" or "diluted" below a heading of earnings per share."""
    named = F.lit(False)
    for heading in EPS_HEADINGS:
        named = named | F.col("squashed").contains(heading)
    below = F.last(F.when(~F.col("has_values"), F.coalesce(named, F.lit(False))), ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    kind = F.coalesce(*[F.when(F.col("squashed").isin(*EPS_ROWS[k]), F.lit(item)) for k, item in items.items()], F.lit(None).cast("string"))
    found = rows.where("type = 'income'").withColumns({"below": below, "item": kind}).where("has_values AND below AND item IS NOT NULL")
    return found.select(*_ROW, F.lit("eps_heading").alias("kind"), "item")


def _section_anchors(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Anchors of checked totals: the total named by the heading above their first part, or by one run into its label."""
    above = rows.withColumns({"above": F.lag("squashed").over(_in_order()), "under_heading": ~F.lag("has_values").over(_in_order())})
    first = above.where("parent_id IS NOT NULL").groupBy("statement_id", F.col("parent_id").alias("row_id")).agg(F.min_by(F.struct("above", "under_heading", "squashed"), F.struct("ordinal", "row_id")).alias("first"))
    totals = rows.where("is_total AND has_values AND checked").select(*_ROW, "type").join(first, _ROW)
    sought = totals.select(*_ROW, "type", F.coalesce("first.under_heading", F.lit(False)).alias("whole"), F.when(F.coalesce("first.under_heading", F.lit(False)), F.col("first.above")).otherwise(F.col("first.squashed")).alias("text"))
    headings = small(aliases.where("subtotal AND squashed <> ''").select("type", F.col("squashed").alias("heading"), F.col("item_id").alias("item"), F.substring("squashed", 1, HEAD).alias("head")).distinct())
    met = sought.withColumn("head", F.substring("text", 1, HEAD)).join(headings, ["type", "head"])
    fits = F.when(F.col("whole"), F.col("text") == F.col("heading")).otherwise(F.col("text").startswith(F.col("heading")) & (F.col("text") != F.col("heading")))
    longest = met.where(fits).groupBy(*_ROW).agg(F.max(F.length("heading")).alias("n"), F.collect_set(F.struct(F.length("heading").alias("n"), "item")).alias("all"))
    named = longest.select(*_ROW, F.array_distinct(F.transform(F.filter("all", lambda x: x["n"] == F.col("n")), lambda x: x["item"])).alias("items")).where("size(items) = 1")
    return named.select(*_ROW, F.lit("section_heading").alias("kind"), F.col("items")[0].alias("item"))


def _sum_anchors(rows: DataFrame, mapped: DataFrame, sums: DataFrame) -> DataFrame:
    """Anchors of checked totals whose parts include all that a rule needs."""
    parts = rows.where("parent_id IS NOT NULL").join(mapped, _ROW).groupBy("statement_id", F.col("parent_id").alias("row_id")).agg(F.collect_set("item_id").alias("parts"))
    met = rows.where("is_total AND has_values AND checked").select(*_ROW).join(parts, _ROW).crossJoin(small(sums.select(F.col("item_id").alias("item"), "needs"), 1000))
    return met.where(F.size(F.array_except("needs", "parts")) == 0).select(*_ROW, F.lit("sum_of_mapped").alias("kind"), "item")


def _gathered(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy(*_ROW).agg(F.sort_array(F.collect_set(F.struct("kind", "item"))).alias("anchored"))


def _resolved(section: Column, section_totals: Column) -> Column:
    """(item_id, evidence, flag) of a row with ``aliased``, ``anchored`` and ``confirmed``, by the order of the rules."""
    aliased = F.coalesce("aliased", F.expr("cast(array() AS array<struct<item_id: string, within: string, subtotal: boolean>>)"))
    anchored = F.coalesce("anchored", F.expr(_NONE))
    within = F.filter(aliased, lambda a: a["within"] == section)
    narrowed = section.isNotNull() & (F.size(aliased) > 1) & (F.size(within) == 1)
    own = F.when(narrowed, within).otherwise(aliased)
    only = F.get(own, 0)
    anchors = F.array_sort(F.array_distinct(F.transform(anchored, lambda a: a["item"])))
    strange = section.isNotNull() & (F.size(aliased) == 1) & only["within"].isNotNull() & F.array_contains(section_totals, section) & (only["within"] != section)
    one, anchor = F.size(own) == 1, F.get(anchors, 0)
    out = lambda item, evidence, flag: F.struct(item.cast("string").alias("item_id"), evidence.alias("evidence"), F.lit(flag).cast("string").alias("flag"))
    none = F.lit(None)
    return (
        F.when(strange, out(none, F.concat(F.lit("section_conflict:"), only["item_id"], F.lit("|section="), section), "ambiguous"))
        .when(F.size(own) > 1, out(none, F.concat(F.lit("alias_multiple:"), F.array_join(F.transform(own, lambda a: a["item_id"]), "|")), "ambiguous"))
        .when(F.size(anchors) > 1, out(none, F.concat(F.lit("anchor_conflict:"), F.array_join(F.transform(anchored, lambda a: F.concat(a["kind"], F.lit("="), a["item"])), "|")), "ambiguous"))
        .when(one & (anchor != only["item_id"]), out(none, F.concat(F.lit("anchor_conflict:alias="), only["item_id"], F.lit("|"), F.get(anchored, 0)["kind"], F.lit("="), anchor), "ambiguous"))
        .when(one & only["subtotal"] & ~F.coalesce("confirmed", F.lit(False)), out(none, F.concat(F.lit("alias_total_unconfirmed:"), only["item_id"]), "ambiguous"))
        .when(one, out(only["item_id"], F.when(narrowed, F.concat(F.lit("alias_in_section:"), section)).otherwise("alias"), None))
        .when(anchor.isNotNull(), out(anchor, F.concat(F.lit("anchor:"), F.get(anchored, 0)["kind"]), None))
        .otherwise(out(none, F.lit("no_alias_no_anchor"), "unmapped"))
    )


def _settled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row an item: repeats of the same figures keep the first; of others only the one that all the rest are added to."""
    unconfirmed = "alias_total_unconfirmed:"
    claim = F.coalesce("item_id", F.when(F.col("evidence").startswith(unconfirmed), F.substring("evidence", len(unconfirmed) + 1, 1000)))
    staked = found.join(rows.select(*_ROW, "ordinal", "figures"), _ROW).withColumn("claim", claim)
    groups = staked.where("claim IS NOT NULL").groupBy("statement_id", "claim").agg(F.count(F.lit(1)).alias("n"), (F.min(F.coalesce("figures", F.lit(""))) == F.max(F.coalesce("figures", F.lit("")))).alias("same"), F.min_by("row_id", F.when(F.col("item_id").isNotNull(), F.struct("ordinal", "row_id"))).alias("held"))
    contested = staked.join(groups.where("n > 1"), ["statement_id", "claim"])
    torn = contested.where("NOT same")
    above = ancestors(rows.select("statement_id", "row_id", "parent_id")).select("statement_id", "row_id", "ancestor")
    over = torn.select("statement_id", "claim", "row_id", "n").join(above, _ROW).join(torn.select("statement_id", "claim", F.col("row_id").alias("ancestor")), ["statement_id", "claim", "ancestor"])
    outer = over.groupBy("statement_id", "claim", F.col("ancestor").alias("row_id"), "n").agg(F.count(F.lit(1)).alias("below")).where("below = n - 1").select("statement_id", "claim", "row_id", F.lit(True).alias("outer"))
    marked = contested.join(outer, ["statement_id", "claim", "row_id"], "left")
    repeat = F.when(F.col("item_id").isNotNull() & (F.col("row_id") != F.col("held")), F.concat(F.lit("repeat_of:"), "held", F.lit(":"), "claim"))
    lost = F.when(F.col("same"), repeat).otherwise(F.when(F.col("outer").isNull(), F.concat(F.lit("duplicate:"), "claim")))
    verdicts = marked.select(*_ROW, lost.alias("lost")).where("lost IS NOT NULL")
    out = found.join(verdicts, _ROW, "left")
    gone = F.col("lost").isNotNull()
    return out.select(*_ROW, F.when(~gone, F.col("item_id")).alias("item_id"), F.coalesce("lost", "evidence").alias("evidence"), F.when(gone, "ambiguous").otherwise(F.col("flag")).alias("flag"))


def map_rows(rows: DataFrame, aliases: DataFrame, sums: DataFrame, eps_items: dict[str, str] | None = None) -> DataFrame:
    """(statement_id, row_id, item_id, evidence, flag) of every row with figures."""
    known = rows.where("has_values").select(*_ROW, "parent_id", "confirmed").join(_aliased(rows, aliases), _ROW, "left")
    anchors = _section_anchors(rows, aliases)
    if eps_items:
        anchors = anchors.unionByName(_eps_anchors(rows, eps_items))
    nothing = F.lit(None).cast("string")
    first = known.join(_gathered(anchors), _ROW, "left").withColumn("r", _resolved(nothing, F.array().cast("array<string>"))).select(*_ROW, F.col("r.item_id").alias("item_id")).where("item_id IS NOT NULL")
    anchors = anchors.unionByName(_sum_anchors(rows, first, sums))
    totals = aliases.where("within IS NOT NULL").agg(F.collect_set("within").alias("totals"))
    parents = first.select("statement_id", F.col("row_id").alias("parent_id"), F.col("item_id").alias("section"))
    again = known.join(_gathered(anchors), _ROW, "left").join(parents, ["statement_id", "parent_id"], "left").crossJoin(F.broadcast(totals))
    found = again.withColumn("r", _resolved(F.col("section"), F.col("totals"))).select(*_ROW, "r.item_id", "r.evidence", "r.flag")
    return _settled(rows, found)


def missing_items(mapped: DataFrame, statements: DataFrame, items: DataFrame) -> DataFrame:
    """(statement_id, item_id): critical items of a statement's type that no row was mapped to."""
    wanted = statements.select("statement_id", "type").join(small(items.where("critical").select(F.col("statement").alias("type"), "item_id")), "type")
    return wanted.join(mapped.where("item_id IS NOT NULL").select("statement_id", "item_id"), ["statement_id", "item_id"], "left_anti").select("statement_id", "item_id")
