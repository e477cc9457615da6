"""Arithmetic checks over the frame: identities and ties, outliers, fractions, misread digits, ties between statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers
from tallyspark.operators.taxonomy import SIGN, TIES

OUTLIER_RATIO = 1000
IMPLAUSIBLE = 10**15
IMPLAUSIBLE_RATIO = 10**4
LEAST_COLUMN = 5
FRACTION_SHARE = 0.2
LARGE_FRACTION = 1000


def _signed(item: str, reported: Column, subtract: bool) -> Column:
    size = F.abs(reported) if SIGN[item] == "-" else reported
    return -size if subtract else size


def identity_checks(rows: DataFrame, statements: DataFrame, periods: DataFrame) -> DataFrame:
    """(check_id, statement_id, kind, period_key, status, expected, actual, difference, tolerance, line_item_ids, detail).

    Assets against liabilities and equity on every balance sheet, and every tie whose total is
    printed. A missing or ambiguous part makes the check ``skipped`` and is named in ``detail``.
    """
    named = sorted({i for _, total, adds, subs in TIES for i in (total, *adds, *subs)} | {"total_liabilities_and_equity", "total_liabilities", "total_equity", "total_assets"})
    by_item = rows.where(F.col("canonical_id").isin(*named)).groupBy("statement_id", "period_key", "canonical_id").agg(F.count(F.lit(1)).alias("n"), F.max("reported").alias("reported"), F.transform(F.array_sort(F.collect_list(F.struct("row_ordinal", "row_id"))), lambda x: x["row_id"]).alias("ids"))
    packed = by_item.groupBy("statement_id", "period_key").agg(F.map_from_entries(F.collect_list(F.struct("canonical_id", F.struct("n", "reported", "ids")))).alias("found"))
    spans = statements.select("statement_id", "type").join(periods.select("statement_id", "period_key"), "statement_id").join(packed, ["statement_id", "period_key"], "left")

    def check(kind: str, target: str, total: str, adds: tuple[str, ...], subs: tuple[str, ...]) -> Column:
        parts = [total, *adds, *subs]
        n = {i: F.coalesce(F.col("found")[i]["n"], F.lit(0)) for i in parts}
        reasons = F.array_compact(F.array(*[F.when(n[i] > 1, f"ambiguous_input:{i}") for i in parts], *[F.when(n[i] == 0, f"missing_input:{i}") for i in parts]))
        ids = F.flatten(F.array_compact(F.array(*[F.col("found")[i]["ids"] for i in parts])))
        actual = F.col("found")[total]["reported"]
        expected = reduce(lambda a, b: a + b, [_signed(i, F.col("found")[i]["reported"], False) for i in adds] + [_signed(i, F.col("found")[i]["reported"], True) for i in subs])
        clear = F.size(reasons) == 0
        addends = len(adds) + len(subs)
        difference = (actual - expected).cast("decimal(38,6)")
        text = f"{total} = {' + '.join(adds)}" + "".join(f" - {s}" for s in subs)
        return F.struct(
            F.concat_ws(":", "statement_id", F.lit(kind), F.lit(target), "period_key").alias("check_id"), F.lit(kind).alias("kind"),
            F.when(~clear, "skipped").when(numbers.within_rounding(difference, addends), "pass").otherwise("fail").alias("status"),
            F.when(clear, expected.cast("decimal(38,6)")).alias("expected"), F.when(clear, actual).alias("actual"), F.when(clear, difference).alias("difference"), F.when(clear, F.lit(addends / 2)).alias("tolerance"),
            ids.alias("line_item_ids"), F.when(clear, text).otherwise(F.array_join(reasons, ";")).alias("detail"),
        )

    printed = F.coalesce(F.col("found")["total_liabilities_and_equity"]["n"], F.lit(0)) > 0
    balance = F.when(printed, check("balance_identity", "balance", "total_assets", ("total_liabilities_and_equity",), ())).otherwise(check("balance_identity", "balance", "total_assets", ("total_liabilities", "total_equity"), ()))
    checks = [F.when(F.col("type") == "balance", balance)]
    for kind, total, adds, subs in TIES:
        checks.append(F.when((F.col("type") == kind) & (F.coalesce(F.col("found")[total]["n"], F.lit(0)) > 0), check("subtotal", total, total, adds, subs)))
    out = spans.select("statement_id", "period_key", F.explode(F.array_compact(F.array(*checks))).alias("c"))
    return out.select("c.check_id", "statement_id", "c.kind", "period_key", "c.status", "c.expected", "c.actual", "c.difference", "c.tolerance", "c.line_item_ids", "c.detail")


def _has(column: str, *flags: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, flags))), F.lit(False))


def period_outliers(cells: DataFrame) -> DataFrame:
    """(statement_id, row_id, period_key): cells of rows whose largest value is a thousand times the smallest or more."""
    compared = cells.where("reported IS NOT NULL AND reported <> 0").where(~_has("flags", "per_share", "percent", "implausible_magnitude"))
    row = Window.partitionBy("statement_id", "row_id")
    sized = compared.withColumns({"n": F.count(F.lit(1)).over(row), "most": F.max(F.abs("reported")).over(row), "least": F.min(F.abs("reported")).over(row)})
    return sized.where((F.col("n") >= 2) & (F.col("most") >= OUTLIER_RATIO * F.col("least"))).select("statement_id", "row_id", "period_key")


def column_outliers(cells: DataFrame) -> DataFrame:
    """(statement_id, period_key, row_id, reported): values beyond any figure, or 10,000 times the median of their column."""
    judged = cells.where("reported IS NOT NULL AND reported <> 0").where(~_has("flags", "per_share"))
    medians = judged.groupBy("statement_id", "period_key").agg(F.count(F.lit(1)).alias("n"), F.median(F.abs("reported")).alias("middle"))
    beyond = F.abs("reported") > F.when(F.col("n") >= LEAST_COLUMN, IMPLAUSIBLE_RATIO * F.col("middle"))
    out = judged.join(medians, ["statement_id", "period_key"]).where(F.coalesce(beyond, F.lit(False)) | (F.abs("reported") > IMPLAUSIBLE))
    return out.select("statement_id", "period_key", "row_id", "reported")


def fractions(cells: DataFrame) -> DataFrame:
    """(statement_id, row_id, period_key): fractional figures in a statement of whole amounts.

    A fraction counts beside a whole amount of its row, or when it is large. A statement of which more
    than a fifth of the amounts are fractional is printed with decimals and left alone.
    """
    amounts = cells.where("reported IS NOT NULL").where(~_has("flags", "per_share", "percent")).withColumn("part", F.col("reported") % 1 != 0)
    row, whole = Window.partitionBy("statement_id", "row_id"), Window.partitionBy("statement_id")
    seen = amounts.withColumns({"row_n": F.count(F.lit(1)).over(row), "row_parts": F.count_if("part").over(row), "n": F.count(F.lit(1)).over(whole), "parts": F.count_if("part").over(whole)})
    odd = F.col("part") & ((F.col("row_parts") < F.col("row_n")) | (F.abs("reported") >= LARGE_FRACTION))
    return seen.where((F.col("parts") <= FRACTION_SHARE * F.col("n")) & odd).select("statement_id", "row_id", "period_key")


def vouched_cells(checks: DataFrame) -> DataFrame:
    """(statement_id, row_id, period_key, check_ids): cells that a passing check covers, with the checks in order.

    A total that only repeats one figure vouches for nothing.
    """
    passed = checks.where("status = 'pass'").where(~F.coalesce(F.col("detail").contains("single_addend"), F.lit(False)))
    return passed.select("statement_id", "period_key", "check_id", F.explode("line_item_ids").alias("row_id")).groupBy("statement_id", "row_id", "period_key").agg(F.sort_array(F.collect_set("check_id")).alias("check_ids"))


def unchecked_cells(cells: DataFrame, checks: DataFrame) -> DataFrame:
    """(statement_id, row_id, period_key, reported, weight): printed cells that no passing check covers.

    ``weight`` is the size of the figure against the largest of its column; 0 in a column of zeros.
    """
    printed = cells.where("reported IS NOT NULL").select("statement_id", "row_id", "period_key", "reported")
    column = Window.partitionBy("statement_id", "period_key")
    weighed = printed.withColumn("weight", F.coalesce(F.try_divide(F.abs("reported").cast("double"), F.max(F.abs("reported")).over(column).cast("double")), F.lit(0.0)))
    return weighed.join(vouched_cells(checks), ["statement_id", "row_id", "period_key"], "left_anti")


def tally(unchecked: DataFrame, key: str) -> DataFrame:
    """(key, statements, cells, mean_weight) of unchecked cells, heaviest first."""
    return unchecked.groupBy(key).agg(F.countDistinct("statement_id").alias("statements"), F.count(F.lit(1)).alias("cells"), F.avg("weight").alias("mean_weight")).orderBy(F.desc("mean_weight"), key)


def diagnose_digits(checks: DataFrame, cells: DataFrame) -> DataFrame:
    """(check_id, place, row_id, period_key, settled): cells where one misread digit explains a failed check.

    A cell that is the only candidate of some check wins over other candidates of the same period.
    """
    failed = checks.where("status = 'fail' AND difference IS NOT NULL").withColumn("place", numbers.single_digit_place(F.col("difference"))).where("place IS NOT NULL")
    total = F.when(F.col("kind") == "balance_identity", F.element_at("line_item_ids", 1)).otherwise(F.element_at("line_item_ids", -1))
    named = failed.withColumn("total_id", total).select("check_id", "statement_id", "period_key", "difference", "place", "total_id", F.explode(F.array_distinct("line_item_ids")).alias("row_id"))
    valued = named.join(cells.where("reported IS NOT NULL").select("statement_id", "row_id", "period_key", "reported"), ["statement_id", "row_id", "period_key"])
    passed = checks.where("status = 'pass'").select("statement_id", "period_key", F.explode("line_item_ids").alias("row_id")).distinct()
    open_ = valued.join(passed, ["statement_id", "period_key", "row_id"], "left_anti")
    settled = F.when(F.col("row_id") == F.col("total_id"), F.col("reported") - F.col("difference")).otherwise(F.col("reported") + F.col("difference")).cast("decimal(38,6)")
    fits = open_.withColumn("settled", settled).where(numbers.one_digit_apart(F.col("reported"), F.col("settled")) | numbers.leading_digit_lost(F.col("reported"), F.col("settled")))
    counted = fits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("check_id")))
    sole = counted.where("n = 1").select("statement_id", "period_key", "row_id").distinct().withColumn("sole", F.lit(True))
    marked = counted.join(sole, ["statement_id", "period_key", "row_id"], "left").withColumn("any_sole", F.max(F.coalesce("sole", F.lit(False))).over(Window.partitionBy("check_id")))
    return marked.where(~F.col("any_sole") | F.coalesce("sole", F.lit(False))).select("check_id", "place", "row_id", "period_key", "settled")


def net_profit_tie(income: DataFrame, comprehensive: DataFrame) -> DataFrame:
    """(doc_id, head_row, period_key, actual, expected, match_row, status): the first row of comprehensive income
    against the first income row that equals it in every period both have.

    Both inputs are (doc_id, row_id, ordinal, period_key, reported).
    """
    first = Window.partitionBy("doc_id").orderBy("ordinal", "row_id")
    valued = comprehensive.where("reported IS NOT NULL")
    head = valued.withColumn("_r", F.dense_rank().over(first)).where("_r = 1").select("doc_id", F.col("row_id").alias("head_row"), "period_key", F.col("reported").alias("actual"))
    shared = head.join(income.select("doc_id", "period_key").distinct(), ["doc_id", "period_key"], "left_semi")
    needed = shared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("needed"))
    pairs = income.where("reported IS NOT NULL").join(shared, ["doc_id", "period_key"]).where(numbers.within_rounding(F.col("reported") - F.col("actual"), 1))
    equal = pairs.groupBy("doc_id", "row_id", "ordinal").agg(F.countDistinct("period_key").alias("n")).join(needed, "doc_id").where("n = needed")
    best = equal.groupBy("doc_id").agg(F.min_by("row_id", F.struct("ordinal", "row_id")).alias("match_row"))
    values = income.select("doc_id", F.col("row_id").alias("match_row"), "period_key", F.col("reported").alias("expected"))
    out = shared.join(best, "doc_id", "left").join(values, ["doc_id", "match_row", "period_key"], "left")
    return out.select("doc_id", "head_row", "period_key", "actual", "expected", "match_row", F.when(F.col("match_row").isNotNull(), "pass").otherwise("fail").alias("status"))


def unit_caveats(statements: DataFrame, cells: DataFrame) -> DataFrame:
    """(statement_id, middle, n, caveats): assumed units, and a scale that the figures do not bear out.

    In single units, five figures or more with a median below 10,000 make the scale implausible.
    """
    sized = cells.where("reported IS NOT NULL AND reported <> 0").where(~_has("flags", "per_share", "percent"))
    middle = sized.groupBy("statement_id").agg(F.median(F.abs("reported")).alias("middle"), F.count(F.lit(1)).alias("n"))
    assumed = F.array_contains("flags", "scale_missing")
    out = statements.join(middle, "statement_id", "left")
    found = F.array_compact(F.array(F.when(assumed, "scale_assumed_units"), F.when(F.array_contains("flags", "currency_from_domicile"), "currency_from_domicile"), F.when(F.array_contains("flags", "currency_inferred"), "currency_inferred"), F.when(assumed & (F.col("n") >= 5) & (F.col("middle") < 10_000), "scale_implausible")))
    return out.select("statement_id", F.col("middle").cast("double").alias("middle"), F.coalesce("n", F.lit(0)).alias("n"), found.alias("caveats"))


# Reasons for a review, in the order in which they are listed.
CRITICAL_FLAGS = ("implausible_magnitude", "digit_suspect", "period_outlier", "fraction_among_whole", "ambiguous_separator", "unparsed", "row_misaligned", "label_merged", "spanned_cell", "comma_decimal")


def reviews(statements: DataFrame, cells: DataFrame, checks: DataFrame) -> DataFrame:
    """(statement_id, status, reasons, numeric_cells, checked_cells, flagged_cells): what stands against a statement, in a fixed order."""
    failed = checks.groupBy("statement_id").agg(
        F.count_if((F.col("kind") == "subtotal") & (F.col("status") == "fail")).alias("subtotal_failed"), F.count_if((F.col("kind") == "balance_identity") & (F.col("status") == "fail")).alias("identity_failed"),
        F.count_if((F.col("kind") == "net_profit_tie") & (F.col("status") == "fail")).alias("tie_failed"), F.count_if((F.col("kind") == "balance_identity") & (F.col("status") == "skipped")).alias("identity_skipped"),
        F.count_if((F.col("kind") == "subtotal") & (F.col("status") == "skipped")).alias("subtotal_skipped"), F.count_if(F.col("status") == "pass").alias("passed"),
    )
    counted = cells.groupBy("statement_id").agg(F.count("reported").alias("numeric_cells"), F.count_if(_has("flags", "numbers_missing")).alias("numbers_missing"), F.count_if(_has("flags", *CRITICAL_FLAGS)).alias("flagged_cells"), *[F.count_if(_has("flags", f)).alias(f"n_{f}") for f in CRITICAL_FLAGS])
    checked = vouched_cells(checks).groupBy("statement_id").agg(F.count(F.lit(1)).alias("checked_cells"))
    all_ = statements.select("statement_id", "type").join(failed, "statement_id", "left").join(counted, "statement_id", "left").join(checked, "statement_id", "left").na.fill(0)
    some = lambda name, text: F.when(F.col(name) > 0, F.lit(text))
    number = lambda name, text: F.when(F.col(name) > 0, F.concat(F.lit(text + ":"), F.col(name)))
    reasons = F.array_compact(F.array(some("subtotal_failed", "subtotal_failed"), some("identity_failed", "identity_failed"), some("tie_failed", "tie_failed"), some("identity_skipped", "identity_not_checked"), number("subtotal_skipped", "subtotal_not_checked"), F.when(F.col("passed") == 0, "unchecked"), number("numbers_missing", "numbers_missing"), *[number(f"n_{f}", f) for f in CRITICAL_FLAGS]))
    return all_.withColumn("reasons", reasons).select("statement_id", F.when(F.size("reasons") == 0, "passed").otherwise("needs_review").alias("status"), "reasons", "numeric_cells", "checked_cells", "flagged_cells")


def eps_interval(profit: Column, profit_step: Column, shares: Column, shares_step: Column) -> Column:
    """The bounds of profit per share when both figures are known to half a printed step."""
    corners = [F.try_divide(profit + a * profit_step / 2, shares + b * shares_step / 2) for a in (-1, 1) for b in (-1, 1)]
    return F.struct(F.least(*corners).alias("low"), F.greatest(*corners).alias("high"))


def eps_status(eps: Column, eps_step: Column, bounds: Column) -> Column:
    """pass where the printed figure meets the bounds, ``precision_insufficient`` where it would at a hundredth too."""
    meets = lambda x: (x + eps_step / 2 >= bounds["low"]) & (x - eps_step / 2 <= bounds["high"])
    return F.when(eps.isNull() | bounds["low"].isNull(), "missing_values").when(meets(eps) & meets(eps / 100), "precision_insufficient").when(meets(eps), "pass").otherwise("fail")
