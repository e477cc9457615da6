"""Pages and ranges: scores, islands of pages, merged intervals, verdicts from weighted phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.ranged import merged, numbered

# Weights of a page's score and the thresholds it is held against.
TITLE, CUE, NUMERIC, STRUCTURE, NEGATIVE = 3.0, 1.5, 2.0, 1.0, 4.0
NUMERIC_FULL = 30
CANDIDATE = 4.5
CONTINUES = 15
# Thresholds of the industry verdict.
VERDICT, LEAST_CUES, MARGIN = 6.0, 3, 2.0


def numeric_tokens(text: Column) -> Column:
    """How many printed amounts of three digits or more a text has; years and ratios do not count."""
    plain = F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    found = F.regexp_extract_all(plain, F.lit("(?<!\\.)(?<![\\d])(\\d{1,3}(?:[,\\u066c. \\u00a0\\u202f\\u2009]\\d{3})+|\\d{3,})"), F.lit(1))
    return F.size(F.filter(found, lambda t: ~t.rlike("^((19|20)\\d{2}){1,2}$") & ~t.rlike("^0[^\\d]")))


def page_score(titled: Column, cued: Column, numbers: Column, structure: Column, negatives: Column) -> Column:
    """The linear score of a page for one statement type."""
    shared = NUMERIC * F.least(numbers / F.lit(float(NUMERIC_FULL)), F.lit(1.0)) + STRUCTURE * structure - NEGATIVE * negatives
    return shared + F.when(titled, TITLE).otherwise(0.0) + F.when(cued, CUE).otherwise(0.0)


def find_ranges(scores: DataFrame) -> DataFrame:
    """(doc_id, type, first_page, last_page, score, rank): islands of candidate pages and the pages that continue them.

    ``scores`` is (doc_id, type, page_no, score, candidate, continues). An island begins at its first
    candidate; islands without one are none. Ranked by best score, ties by page. Pages are numbered by
    range, so that a document may have any number of them; a page occurs once.
    """
    able = numbered(scores.where("candidate OR continues"), ["doc_id", "type"], ["page_no"], "_k").withColumn("island", F.col("page_no") - F.col("_k"))
    starts = able.where("candidate").groupBy("doc_id", "type", "island").agg(F.min("page_no").alias("first_page"))
    kept = able.join(starts, ["doc_id", "type", "island"]).where("page_no >= first_page")
    ranges = kept.groupBy("doc_id", "type", "island", "first_page").agg(F.max("page_no").alias("last_page"), F.max("score").alias("score"))
    rank = Window.partitionBy("doc_id", "type").orderBy(F.desc("score"), "first_page")
    return ranges.withColumn("rank", F.row_number().over(rank)).drop("island")


def merge_intervals(spans: DataFrame, key: str, first: str, last: str, gap: int = 1) -> DataFrame:
    """(key, first, last): spans merged where they overlap or lie at most ``gap`` apart; a key may hold any number of them."""
    return merged(spans, key, first, last, gap)


def plan_conversion(ranges: DataFrame, page_counts: DataFrame, enabled: list[str], pad: int) -> DataFrame:
    """(doc_id, first_page, last_page): padded, clipped and merged ranges of the enabled types."""
    padded = ranges.where(F.col("type").isin(*enabled)).join(page_counts.select("doc_id", "pages"), "doc_id")
    clipped = padded.select("doc_id", F.greatest(F.col("first_page") - pad, F.lit(1)).alias("first_page"), F.least(F.col("last_page") + pad, F.col("pages")).alias("last_page"))
    return merge_intervals(clipped, "doc_id", "first_page", "last_page")


def industry_verdict(hits: DataFrame, weights: DataFrame, whole_document: bool = False) -> DataFrame:
    """(doc_id, grp, score, cues, outcome): the group with the greatest weight of phrases, ties by the order of groups.

    ``hits`` is (doc_id, page_no, phrase), ``weights`` (grp, place, phrase, weight), a short list. Over
    the whole document each phrase counts once, and three different ones are needed.
    """
    seen = hits.select("doc_id", "phrase").distinct() if whole_document else hits.select("doc_id", "page_no", "phrase").distinct()
    totals = seen.join(weights, "phrase").groupBy("doc_id", "grp", "place").agg(F.sum("weight").alias("score"), F.countDistinct("phrase").alias("cues"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "place")
    top = totals.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    sure = (F.col("score") >= VERDICT) & (F.col("cues") >= LEAST_CUES if whole_document else F.lit(True))
    near = F.when(F.col("score") >= VERDICT, "too_narrow").when(F.col("score") >= VERDICT - MARGIN, "near_threshold").otherwise("corporate")
    firm = (F.col("score") >= VERDICT + MARGIN) & (F.col("cues") >= LEAST_CUES)
    return top.select("doc_id", "grp", "score", "cues", F.when(~sure, near).when(firm, "verdict").otherwise("weak_verdict").alias("outcome"))


def nearest_column(values: DataFrame, columns: DataFrame, tolerance: float) -> DataFrame:
    """(table_id, value_id, column_id): each value's nearest column centre within the tolerance.

    ``values`` is (table_id, value_id, x), ``columns`` (table_id, column_id, centre); the range
    condition follows an equi-join on the table, so no pair of different tables is formed.
    """
    near = values.join(columns, "table_id").where(F.abs(F.col("x") - F.col("centre")) <= tolerance)
    return near.groupBy("table_id", "value_id").agg(F.min_by("column_id", F.struct(F.abs(F.col("x") - F.col("centre")), F.col("column_id"))).alias("column_id"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(page, inner_id, outer_id): boxes that lie within others of their page. Both are (page, id, left, top, right, bottom)."""
    a = inner.select("page", F.col("id").alias("inner_id"), *[F.col(c).alias(f"i_{c}") for c in ("left", "top", "right", "bottom")])
    b = outer.select("page", F.col("id").alias("outer_id"), "left", "top", "right", "bottom")
    return a.join(b, "page").where("i_left >= left AND i_top >= top AND i_right <= right AND i_bottom <= bottom AND inner_id <> outer_id").select("page", "inner_id", "outer_id")
