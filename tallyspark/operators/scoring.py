"""Readings of statements scored against gold: rows aligned in order, figures judged under their labels, tags resolved.

Cells are (key, row, ordinal, label, period_key, value), one row a printed figure; ``label`` is without
spaces and ``key`` names the statement. A figure is right if it was read in the row that aligns with its own,
in a period that the reading has, under a label that can be read as its own.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.mapping import small
from tallyspark.operators.sums import align_rows

# How alike a label and a stretch of text must be to be found, and to be readable; letters that do not count.
FOUND, READABLE, SLOP = 0.85, 0.6, 2


def stretch(label: str, read: str) -> tuple[float, int, int] | None:
    """(likeness, start, end) of the stretch of a read label where an expected one lies; None if no two letters in a row are shared."""
    matcher = SequenceMatcher(None, label, read, autojunk=False)
    runs = [m for m in matcher.get_matching_blocks() if m.size > 1]
    if not runs:
        return None
    start = max(0, runs[0].b - runs[0].a)
    after = len(label) - runs[-1].a - runs[-1].size  # letters of the label behind the last shared run
    end = min(len(read), runs[-1].b + runs[-1].size + after)
    matcher.set_seq2(read[start:end])
    return matcher.ratio(), start, end


def is_own(label: str | None, read: str | None, others: list[str]) -> bool:
    """Whether a label that was read is the expected one, among those of the same statement.

    All labels that are found in it compete for the longest stretch; an expected label that is merely
    readable loses to any that is found in the same place. A row without a label is its own.
    """
    if not label:
        return True
    if not read:
        return False
    places = {x: p for x in {label, *others} if x and (p := stretch(x, read))}
    mine = places.get(label)
    if mine is None or mine[0] < READABLE:
        return False
    found = {x: p for x, p in places.items() if p[0] >= FOUND}
    meets = lambda p: min(mine[2], p[2]) - max(mine[1], p[1]) > SLOP
    if label not in found:
        return not any(map(meets, found.values()))
    longest = max(b - a for _, a, b in found.values())
    rivals = [x for x, (_, a, b) in found.items() if longest - (b - a) <= SLOP]
    best = max(rivals, key=lambda x: (found[x][0], x == label))
    return best == label or not meets(found[best])


@F.pandas_udf(T.BooleanType())
def _own(labels: pd.Series, reads: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([is_own(a, b, list(o) if o is not None else []) for a, b, o in zip(labels, reads, others, strict=True)], dtype=bool)


def _as_rows(cells: DataFrame) -> DataFrame:
    """One row a printed row, with its figures by period."""
    figures = F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("period_key").isNotNull(), F.struct("period_key", F.col("value").cast("double").alias("value"))))))
    return cells.groupBy("key", "row").agg(F.min("ordinal").alias("ordinal"), F.min("label").alias("label"), figures.alias("figures"))


def judged_cells(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(key, row, period_key, value, found_row, read, verdict) of every expected figure with ``confirmed``.

    ``verdict`` is right, mislabelled (the right figure under another label), wrong, or missing where no
    row aligns. A period is given once a row.
    """
    own, other = _as_rows(expected), _as_rows(found)
    pairs = align_rows(own, other).select("key", F.col("expected_row").alias("row"), "found_row")
    all_labels = own.groupBy("key").agg(F.collect_set("label").alias("others"))
    labels = pairs.join(own.select("key", "row", "label"), ["key", "row"]).join(other.select("key", F.col("row").alias("found_row"), F.col("label").alias("read_label")), ["key", "found_row"]).join(all_labels, "key")
    same_label = labels.select("key", "row", "found_row", _own("label", "read_label", "others").alias("own_label"))
    reading = found.select("key", F.col("row").alias("found_row"), "period_key", F.col("value").alias("read"))
    has = found.select("key", "period_key").distinct().withColumn("in_period", F.lit(True))
    cells = expected.where("confirmed AND value IS NOT NULL").select("key", "row", "period_key", "value")
    met = cells.join(same_label, ["key", "row"], "left").join(reading, ["key", "found_row", "period_key"], "left").join(has, ["key", "period_key"], "left")
    equal = F.coalesce((F.col("read") == F.col("value")) & F.col("in_period"), F.lit(False))
    verdict = F.when(F.col("found_row").isNull(), "missing").when(equal & F.col("own_label"), "right").when(equal, "mislabelled").otherwise("wrong")
    return met.select("key", "row", "period_key", "value", "found_row", "read", verdict.alias("verdict"))


def statement_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(key, cells, right, mislabelled, missing, sign_cells, sign_right, extra_rows) of each expected statement."""
    judged = judged_cells(expected, found)
    sized = F.abs("read") == F.abs("value")
    counts = judged.groupBy("key").agg(
        F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("right", "mislabelled", "missing")],
        F.count_if(sized).alias("sign_cells"), F.count_if(sized & (F.col("read") == F.col("value"))).alias("sign_right"),
    )
    used = judged.where("found_row IS NOT NULL").select("key", F.col("found_row").alias("row")).distinct()
    extra = found.where("value IS NOT NULL").select("key", "row").distinct().join(used, ["key", "row"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("extra_rows"))
    return counts.join(extra, "key", "left").na.fill(0, ["extra_rows"])


def sibling_cells(cells: DataFrame, others: DataFrame) -> DataFrame:
    """Cells (doc_id, type, period_key, row_id, amount) whose amount another document of the issuer has too; zeros vouch for nothing.

    ``others`` is (doc_id, sibling_of, type, period_key, amount): the figures of documents that are siblings of ``sibling_of``.
    """
    known = others.where("amount IS NOT NULL AND amount <> 0").select(F.col("sibling_of").alias("doc_id"), "type", "period_key", "amount").distinct()
    return cells.join(known, ["doc_id", "type", "period_key", "amount"], "left_semi")


def closing_identity(rows: DataFrame) -> DataFrame:
    """(statement_id, period_key, status, actual, expected) of assets against liabilities and equity, each by the last row that is mapped to it.

    ``rows`` is (statement_id, period_key, canonical_id, row_ordinal, reported), one row a printed cell. The
    printed sum of liabilities and equity is taken where there is one in the statement, else its two parts.
    """
    items = ("total_assets", "total_liabilities_and_equity", "total_liabilities", "total_equity")
    own = rows.where(F.col("canonical_id").isin(*items))
    last = own.groupBy("statement_id", "canonical_id").agg(F.max("row_ordinal").alias("row_ordinal"))
    at = own.join(last, ["statement_id", "canonical_id", "row_ordinal"]).groupBy("statement_id", "period_key").pivot("canonical_id", list(items)).agg(F.max("reported"))
    have = last.groupBy("statement_id").pivot("canonical_id", list(items)).agg(F.count(F.lit(1))).select("statement_id", *[F.col(i).isNotNull().alias(f"has_{i}") for i in items])
    spans = rows.select("statement_id", "period_key").distinct().join(at, ["statement_id", "period_key"], "left").join(have, "statement_id", "left")
    both = F.coalesce("has_total_liabilities_and_equity", F.lit(False))
    found = F.coalesce(F.col("has_total_assets") & (both | (F.col("has_total_liabilities") & F.col("has_total_equity"))), F.lit(False))
    expected = F.when(both, F.col("total_liabilities_and_equity")).otherwise(F.col("total_liabilities") + F.col("total_equity"))
    gap = F.abs(F.col("total_assets") - expected)
    status = F.when(~found, "identity_totals_not_found").when(gap.isNull(), "missing_values").when(gap <= F.when(both, 0.5).otherwise(1.0), "pass").otherwise("fail")
    return spans.select("statement_id", "period_key", status.alias("status"), F.when(found, F.col("total_assets")).alias("actual"), F.when(found, expected).alias("expected"))


def resolve_tags(rows: DataFrame, entries: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows with ``outcome`` (mapped, abstain, unresolved), ``canonical_id`` and ``reason``, by one exact key each.

    ``rows`` has (tag, statement, scope, role, companion), ``entries`` is (tag, statement, canonical_id,
    abstention_reason, requires_companion), ``policies`` (kind, scope, reason) with kind negative_control or
    outside_crosswalk. What is missing is unresolved and never a null target; a key with two entries is an
    error of the list, seen by ``repeated_entries``.
    """
    e = small(entries.select("tag", "statement", F.col("canonical_id").alias("target"), "abstention_reason", F.coalesce("requires_companion", F.lit(False)).alias("needs"), F.lit(True).alias("entered")))
    p = small(policies.select("kind", "scope", F.col("reason").alias("policy_reason")))
    kind = F.when(F.col("role") == "negative_control", "negative_control").otherwise("outside_crosswalk")
    met = rows.join(e, ["tag", "statement"], "left").withColumn("kind", kind).join(p, ["kind", "scope"], "left")
    control, entered, excluded = F.coalesce(F.col("role") == "negative_control", F.lit(False)), F.col("entered").isNotNull(), F.col("policy_reason").isNotNull()
    said = lambda what, why: F.struct(F.lit(what).alias("outcome"), why.cast("string").alias("reason"))
    outcome = (
        F.when(F.col("tag").isNull(), said("unresolved", F.lit("missing_key")))
        .when(F.coalesce("role", F.lit("unknown")) == "unknown", said("unresolved", F.lit("unknown_role")))
        .when((control | ~entered) & excluded, said("abstain", F.col("policy_reason")))
        .when(control, said("unresolved", F.lit("negative_control_policy_missing")))
        .when(~entered, said("unresolved", F.lit("missing_entry")))
        .when(F.col("target").isNull(), said("abstain", F.col("abstention_reason")))
        .when(F.col("needs") & ~F.coalesce("companion", F.lit(False)), said("unresolved", F.lit("companion_required")))
        .otherwise(said("mapped", F.lit(None)))
    )
    out = met.withColumn("r", outcome)
    return out.select(*rows.columns, "r.outcome", F.when(F.col("r.outcome") == "mapped", F.col("target")).alias("canonical_id"), "r.reason")


def repeated_entries(entries: DataFrame) -> DataFrame:
    """(tag, statement, n) of keys that are entered more than once; empty for a valid list."""
    return entries.groupBy("tag", "statement").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
