"""Queries of single operators: predicates, tables, boxes, ties, samples and reports over the order and document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import labels, numbers, periods, units
from tallyspark.operators import checks, continuation, dataset, documents, evaluate, frame, label_mapping, locate, mapping, scoring, shred, split, tables
from tallyspark.plans.fixtures import STAR_SQL, star
from tallyspark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(t, r, q, p): order, line, whole quantity and price of all order lines."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("r"), F.col("l_quantity").cast("int").alias("q"), F.floor("l_extendedprice").cast("bigint").alias("p"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with one row a line number: line numbers repeat."""
    return _lines(spark, folder).groupBy("t", "r").agg(F.max("q").alias("q"), F.max("p").alias("p"))


_LU = "WITH l AS (SELECT l_orderkey AS t, l_linenumber AS r, MAX(CAST(l_quantity AS INTEGER)) AS q, MAX(CAST(floor(l_extendedprice) AS BIGINT)) AS p FROM lineitem GROUP BY 1, 2)"
_L = "WITH l AS (SELECT l_orderkey AS t, l_linenumber AS r, CAST(l_quantity AS INTEGER) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem)"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").dropDuplicates(["source_id"])


_S = "WITH so AS (SELECT DISTINCT ON (source_id) * FROM sources ORDER BY source_id)"


# --- ties and earnings per share ---------------------------------------------------------------------


def net_profit_tie(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of an order, changed in every third order, against the first equal line of it."""
    l = _rows(spark, folder)
    rows = l.select(F.col("t").alias("doc_id"), F.col("r").cast("string").alias("row_id"), F.col("r").alias("ordinal"), F.lit("FY").alias("period_key"), F.col("q").cast("decimal(38,6)").alias("reported"))
    shown = rows.withColumn("reported", F.when(F.col("doc_id") % 3 == 0, F.col("reported") + 7).otherwise(F.col("reported")).cast("decimal(38,6)"))
    out = checks.net_profit_tie(rows, shown)
    return out.select("doc_id", "head_row", F.col("actual").cast("double").alias("actual"), F.col("expected").cast("double").alias("expected"), "match_row", "status")


def eps_status(spark: SparkSession, folder: str) -> DataFrame:
    """Earnings per share printed to a hundredth, off by more or less."""
    o = table(spark, folder, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("profit"), (F.col("o_custkey") % 97 + 1).cast("double").alias("shares"))
    shown = F.floor(F.col("profit") / F.col("shares") * 100) / 100 + F.when(F.col("o_orderkey") % 4 == 0, 3.0).otherwise(0.0)
    e = o.withColumns({"eps": F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(shown), "bounds": checks.eps_interval(F.col("profit"), F.lit(1.0), F.col("shares"), F.lit(1.0))})
    return e.select("o_orderkey", checks.eps_status(F.col("eps"), F.lit(0.01), F.col("bounds")).alias("status"))


# --- printed tables ----------------------------------------------------------------------------------


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    """One table an order: a header of dates in columns 1 and 2, and a row of figures."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("table_id"), F.to_date("o_orderdate").alias("d"), F.floor("o_totalprice").cast("bigint").alias("v"))
    cell = lambda row, col, text, header: F.struct(F.lit(row).alias("start_row"), F.lit(col).alias("start_col"), text.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(header).alias("column_header"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return o.select("table_id", F.array(cell(0, 1, F.concat(F.lit(" As at  "), iso("d")), True), cell(0, 2, iso(F.add_months("d", -12 * 1)), True), cell(0, 3, iso("d"), True), cell(1, 0, F.lit("Total  assets"), False), cell(1, 1, F.format_number("v", 0), False)).alias("cells"))


def grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    return tables.grid_cells(_grid(spark, folder)).select("table_id", "row", "col", "text", "is_header")


def column_periods(spark: SparkSession, folder: str) -> DataFrame:
    out = tables.column_periods(tables.grid_cells(_grid(spark, folder)))
    return out.select("table_id", "col", "key", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "bound")


def table_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as a table: every third line a section, indented by quantity."""
    l = _lines(spark, folder).repartition("t").groupBy("t", "r").agg(F.max("q").alias("q"))  # one exchange, by table
    label = F.when(F.col("r") % 5 == 0, F.lit("Total due")).when(F.col("r") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("line "), F.col("r")))
    return tables.hierarchy(l.select(F.col("t").alias("table_id"), F.col("r").cast("bigint").alias("row"), label.alias("label"), (F.col("q") % 3 * 8).cast("double").alias("indent"), (F.col("r") % 3 != 0).alias("has_values")))


def nearest_column(spark: SparkSession, folder: str) -> DataFrame:
    l = _lines(spark, folder)
    columns = l.select("t").distinct().select(F.col("t").alias("table_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("column_id"), F.lit(float(x)).alias("centre")) for k, x in enumerate((10, 25, 40))])).alias("c")).select("table_id", "c.*")
    return locate.nearest_column(l.select(F.col("t").alias("table_id"), F.col("r").alias("value_id"), F.col("q").cast("double").alias("x")), columns, 6.0)


def contained(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes made from the lines of an order, those within others."""
    l = _lines(spark, folder)
    boxes = l.select(F.col("t").alias("page"), F.col("r").alias("id"), F.col("q").alias("left"), F.col("r").alias("top"), (F.col("q") + F.col("p") % 50).alias("right"), (F.col("r") + F.col("p") % 7).alias("bottom"))
    return locate.contained(boxes, boxes)


def column_centres(spark: SparkSession, folder: str) -> DataFrame:
    l = _lines(spark, folder)
    out = tables.column_centres(l.select(F.col("t").alias("table_id"), (F.col("q") % 2).alias("col"), F.col("r").alias("row"), F.col("q").cast("double").alias("left"), (F.col("q") + 4).cast("double").alias("right")))
    return out.select("table_id", "col", F.round("centre", 6).alias("centre"), "rows")


def cell_box(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth line has no box of its own."""
    l = _lines(spark, folder)
    side = lambda x: F.when(F.col("r") % 4 != 0, x.cast("double"))
    cells = l.select(F.col("t").alias("table_id"), (F.col("r") % 2).alias("row"), (F.col("q") % 2).alias("col"), "r", side(F.col("q")).alias("left"), side(F.col("q") + 3).alias("right"), side(F.col("r")).alias("top"), side(F.col("r") + 1).alias("bottom"))
    return tables.cell_box(cells).select("table_id", "r", "left", "right", "top", "bottom", "synthesized")


def reversed_words(spark: SparkSession, folder: str) -> DataFrame:
    l = _lines(spark, folder)
    return tables.reversed_words(l.select(F.col("t").alias("table_id"), (F.col("q") % 5 == 0).alias("matches_forward"), (F.col("q") % 2 == 0).alias("matches_backward")))


def token_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Printed figures that are note references or amounts."""
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.floor("o_totalprice").cast("bigint").alias("v"))
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.format_number("v", 0)).when(k == 1, F.date_format("d", "dd/MM/yyyy")).when(k == 2, F.date_format("d", "yyyy")).when(k == 3, F.concat(F.col("v") % 60, F.lit("a"))).when(k == 4, F.concat(F.lit("("), F.col("v"), F.lit(")"))).otherwise(F.lit("–"))
    return o.select("o_orderkey", tables.is_note(text).alias("note"), tables.is_amount(text).alias("amount"))


def split_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Captions that end in a note reference; a standard keeps its number."""
    o = table(spark, folder, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("w"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Cash at hand "), F.col("o_orderkey") % 40)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Leases under IFRS "), F.col("o_orderkey") % 40)).otherwise(F.lit("Other assets"))
    return o.select("o_orderkey", tables.split_note(text).alias("s")).select("o_orderkey", "s.label", "s.note")


# --- texts and captions ------------------------------------------------------------------------------


def unit_signals(spark: SparkSession, folder: str) -> DataFrame:
    """All that the captions of statements say at once."""
    s = table(spark, folder, "statements").where("unit_text IS NOT NULL")
    return s.select("statement_id", units.unit_signal(F.col("unit_text")).alias("u")).select("statement_id", "u.scale", "u.scale_cue", "u.currency", "u.per_share_exempt")


def digit_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without formatting characters, with ASCII digits."""
    d = table(spark, folder, "documents")
    plain = numbers.normalize_digits(numbers.strip_bidi(F.col("text")))
    return d.select("doc_id", F.sha2(plain, 256).alias("digest"), F.coalesce(numbers.has_eastern_digits(F.col("text")), F.lit(False)).alias("eastern"))


def header_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The JVM-side date of plain headers."""
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("d", "yyyy-MM-dd")).when(k == 1, F.date_format("d", "dd/MM/yyyy")).when(k == 2, F.date_format("d", "yyyy")).otherwise(F.concat(F.lit("note "), F.date_format("d", "yyyy")))
    return o.select("o_orderkey", F.date_format(periods.header_end_date(text), "yyyy-MM-dd").alias("end_date"))


def strict_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of order dates read strictly: whole dates, months, years, counts of months, and text that spoils them."""
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    long = F.date_format("d", "d MMMM yyyy")
    forms = [F.date_format("d", "yyyy-MM-dd"), F.concat(F.lit("Six months ended "), long, F.lit(" (unaudited), SAR '000")), F.date_format("d", "MMMM yyyy"), F.concat(F.lit("Balance "), long), F.date_format("d", "yyyy"), F.concat(F.lit("5 months ended "), long), F.lit("Notes")]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))
    p = o.withColumn("p", periods.interpret_period(text))
    return p.select("o_orderkey", "p.calendar", "p.duration", F.date_format("p.end_date", "yyyy-MM-dd").alias("end_date"), "p.months", "p.period_key")


def placeholder_tokens(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    text = F.element_at(F.array(*map(F.lit, ("x", "(X)", "xx", "", "X.", "y"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", units.is_glyph_placeholder(text).alias("placeholder"), F.round(numbers.quantum(F.col("o_orderkey") % 4), 6).alias("quantum"))


def document_keys(spark: SparkSession, folder: str) -> DataFrame:
    s = _names(spark, folder)
    return s.select("source_id", labels.document_key(F.nullif(F.regexp_extract("cik", "(\\d+)", 1), F.lit("")), F.col("issuer")).alias("key"))


def reading_variants(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "taxonomy_aliases")
    return a.select("alias_id", F.array_join(labels.reading_variants(F.col("alias")), "|").alias("readings"))


def text_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Sources by whether their documents have enough text."""
    d = table(spark, folder, "documents").where("source_id IS NOT NULL").groupBy("source_id").agg(F.count_if(F.coalesce(F.col("n_chars"), F.lit(0)) >= 400).alias("readable"), F.count(F.lit(1)).alias("pages"))
    return d.select("source_id", labels.text_layer(F.col("readable"), F.col("pages")).alias("layer"))


# --- datasets and reports ----------------------------------------------------------------------------


def joined_once(spark: SparkSession, folder: str) -> DataFrame:
    """Orders beside customers' numbers as predictions: ids that one side lacks or has twice."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return evaluate.joined_once(o, c, "id").groupBy("truth_n", "prediction_n").agg(F.count(F.lit(1)).alias("n"))


def set_recalls(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of the odd lines of an order that its even lines have too."""
    l = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))).alias("b"))
    return l.select("l_orderkey", F.round(evaluate.set_recall(F.col("a"), F.col("b")), 9).alias("recall"))


def cell_map(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by customer and year in two snapshots, side by side."""
    o = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), "o_orderkey")
    count = lambda df: df.groupBy("o_custkey", "yr").agg(F.count(F.lit(1)).alias("n"))
    return dataset.cell_map({"odd": count(o.where("o_orderkey % 2 = 1")), "even": count(o.where("o_orderkey % 2 = 0"))}, ["o_custkey", "yr"], "n")


def text_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.length_stats(table(spark, folder, "documents"), "n_chars").select("count", "mean", "max")


def out_of_order(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer dated before the order with the next lower number."""
    o = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("line"), F.to_date("o_orderdate").alias("at"))
    return split.out_of_order(o, "o_custkey", "at").select("o_custkey", "line")


def required_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that have all the flags a rule needs."""
    children = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("parent"), F.concat("l_returnflag", "l_linestatus").alias("item_id")).distinct()
    rules = spark.createDataFrame([("returned_and_kept", ["RF", "AF"]), ("open", ["NO"])], "item_id STRING, needs ARRAY<STRING>")
    return mapping.required_parts(children, rules)


def owner_sample(spark: SparkSession, folder: str) -> DataFrame:
    """All urgent orders and a seeded draw of others; the draw is the operator's own."""
    o = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return dataset.owner_sample(o, "o_orderkey", "urgent", 50, "s:").select("o_orderkey")


def top_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent labels of each statement; the limit is the operator's own."""
    e = table(spark, folder, "audit_examples").dropDuplicates(["example_id"]).where("label IS NOT NULL").select("statement", F.lower("label").alias("label"))
    return dataset.top_k(e, ["statement"], "label", 10)


def run_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all lines of an order agree on their flag."""
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return evaluate.agreement(l, ["l_orderkey"], "l_linenumber", "l_returnflag").select("l_orderkey", "runs", "values", "agreed")


def scanned_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cheap lines by flag, with its interval."""
    l = table(spark, folder, "lineitem").select("l_returnflag", (F.col("l_quantity") < 20).alias("ok"), F.col("l_tax").cast("double").alias("s"))
    out = evaluate.breakdown(l, ["l_returnflag"], "ok", "s")
    return out.select("l_returnflag", "cells", "right", *[F.round(c, 9).alias(c) for c in ("accuracy", "mean_seconds")])


def document_status(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose statements are all without flags but a harmless one."""
    s = table(spark, folder, "statements").select("doc_id", F.when(F.col("scale").isNotNull(), "passed").otherwise("needs_review").alias("review"), F.when(F.col("consolidated"), F.array(F.lit("low_selectivity"))).otherwise(F.coalesce("flags", F.array().cast("array<string>"))).alias("flags"))
    return documents.status(s)


def first_reasons(spark: SparkSession, folder: str) -> DataFrame:
    s = _names(spark, folder)
    reason = documents.first_reason([("no_number", F.col("cik").isNull()), ("no_name", F.col("issuer").isNull()), ("not_verified", ~F.col("verified"))])
    return s.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def mapping_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Where the mapping of an example would come from, counted."""
    e = table(spark, folder, "audit_examples").dropDuplicates(["example_id"])
    has = lambda c: F.col(c).isNotNull()
    how = mapping.resolve(has("role") & has("tag"), has("abstention_reason") & has("canonical_id"), F.lit(False), F.lit(False), F.col("statement") == "cash_flow", has("canonical_id"), has("label"))
    return e.groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("n"))


# --- statements --------------------------------------------------------------------------------------


def unmapped_rows(spark: SparkSession, folder: str) -> DataFrame:
    return frame.unmapped_rows(star(spark, folder)[2])


def frame_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Total assets of one closing date."""
    s, p, li, c = star(spark, folder)
    first = frame.primary_statements(s)
    rows = frame.frame_rows(first, p, li, c)
    return frame.lookup(rows, "total_assets", "balance", F.to_date(F.lit("1997-12-31")), F.lit(None).cast("int")).select("doc_id", "period_key", F.col("value").cast("double").alias("value"))


def _statement_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the gold statements, with totals, headings and checks by position; the aliases; and the sums by which totals are known."""
    shredded = shred.shred_files(table(spark, folder, "gold_files"), ("statements.item.rows.item.label", "statements.item.rows.item.values"))
    at = [F.concat_ws("/", "file_id", "statement_pos").alias("statement_id"), F.col("row_pos").cast("string").alias("row_id")]
    figures = shred.values(shredded).where("value IS NOT NULL").select(*at, F.concat_ws("=", "period_key", "value").alias("x")).groupBy("statement_id", "row_id").agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("figures"))
    flat = shred.rows(shred.shred_files(table(spark, folder, "gold_files"), ("statements.item.rows.item.label", "statements.item.rows.item.canonical_id", "statements.item.rows.item.extra")))
    n = flat.select(*at, F.col("row_pos").alias("ordinal"), labels.squash(labels.simple_label(F.col("label"))).alias("squashed"))
    n = n.withColumns({"type": F.lit("any"), "has_values": F.col("ordinal") % 5 != 2, "is_total": F.col("ordinal") % 4 == 3})
    below = Window.partitionBy("statement_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    parent = F.when(~F.col("is_total"), F.min(F.when(F.col("is_total") & F.col("has_values"), F.col("ordinal"))).over(below))
    n = n.withColumns({"parent_id": parent.cast("string"), "checked": F.expr("ordinal % 8 = 3"), "confirmed": F.expr("ordinal % 8 = 3 OR ordinal % 3 = 0")}).join(figures, ["statement_id", "row_id"], "left")
    a = table(spark, folder, "taxonomy_aliases").join(table(spark, folder, "taxonomy_items"), "item_id")
    a = a.select("item_id", F.lit("any").alias("type"), labels.squash(labels.simple_label(F.col("alias"))).alias("squashed"), "within", "subtotal")
    return n, a, spark.createDataFrame([(i, list(p)) for i, p in SUMS], "item_id STRING, needs ARRAY<STRING>")


# --- readings against gold, tags, parts ---------------------------------------------------------------


def _readings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Printed figures of the gold statements, and a reading of them that lost rows, misread figures and swapped labels."""
    shredded = shred.shred_files(table(spark, folder, "gold_files"), ("statements.item.rows.item.values",))
    at = [F.concat_ws("/", "file_id", "statement_pos").alias("key"), F.col("row_pos").cast("string").alias("row"), F.col("row_pos").alias("ordinal")]
    figures = shred.values(shredded).select(*at, "period_key", F.expr("try_cast(value AS DECIMAL(20,0))").alias("value")).dropDuplicates(["key", "row", "period_key"])
    flat = shred.rows(shred.shred_files(table(spark, folder, "gold_files"), ("statements.item.rows.item.label", "statements.item.rows.item.canonical_id", "statements.item.rows.item.extra")))
    named = flat.select(at[0], at[1], labels.squash(labels.simple_label(F.col("label"))).alias("label"))
    gold = figures.join(named, ["key", "row"], "left").withColumn("confirmed", F.col("ordinal") % 6 != 5)
    read = gold.where("ordinal % 7 <> 3").withColumns({"value": F.when(F.col("ordinal") % 5 == 1, -F.col("value")).otherwise(F.col("value")), "label": F.when(F.col("ordinal") % 9 == 2, F.lit("othercaption")).otherwise(F.col("label"))})
    return gold, read.drop("confirmed")


def statement_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every gold statement scored against a faulty reading of it."""
    return scoring.statement_scores(*_readings(spark, folder))


def resolved_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of all examples resolved by a list of the tags that name one item."""
    e = table(spark, folder, "audit_examples").dropDuplicates(["example_id"])
    ids = table(spark, folder, "taxonomy_items").select(F.col("item_id").alias("canonical_id"))
    named = e.where("tag IS NOT NULL").join(mapping.small(ids), "canonical_id").groupBy("tag", "statement").agg(F.min("canonical_id").alias("a"), F.max("canonical_id").alias("b"))
    entries = named.select("tag", "statement", F.when(F.col("a") == F.col("b"), F.col("a")).alias("canonical_id"), F.when(F.col("a") != F.col("b"), "several_items").alias("abstention_reason"), (F.length("tag") % 5 == 0).alias("requires_companion"))
    policies = spark.createDataFrame([("outside_crosswalk", "custom", "own_extension"), ("negative_control", "us-gaap", "control")], "kind STRING, scope STRING, reason STRING")
    kind = F.when(F.length("example_id") % 11 == 0, "unknown").when(F.col("example_id").endswith("7"), "negative_control").otherwise("source")
    rows = e.select("example_id", "tag", "statement", F.substring_index("tag", ":", 1).alias("scope"), kind.alias("role"), F.col("canonical_id").isNotNull().alias("companion"))
    return scoring.resolve_tags(rows, entries, policies).select("example_id", "outcome", "canonical_id", "reason")


def closing_identities(spark: SparkSession, folder: str) -> DataFrame:
    s, p, li, c = star(spark, folder)
    first = frame.primary_statements(s).where("type = 'balance'")
    rows = frame.frame_rows(first, p, li, c)
    out = scoring.closing_identity(rows)
    return out.select("statement_id", "period_key", "status", F.col("actual").cast("double").alias("actual"), F.col("expected").cast("double").alias("expected"))


def sibling_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose price another order of the same part and quantity has too."""
    l = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("type"), F.col("l_partkey").cast("string").alias("period_key"), F.col("l_linenumber").alias("row_id"), F.floor("l_extendedprice").cast("bigint").alias("amount"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    of = l.join(o, "doc_id")
    # the next order of the customer is the sibling
    following = o.select("doc_id", F.lead("doc_id").over(Window.partitionBy("o_custkey").orderBy("doc_id")).alias("sibling_of")).where("sibling_of IS NOT NULL")
    others = of.join(following, "doc_id").select("doc_id", "sibling_of", "type", F.lit("x").alias("period_key"), F.col("amount") % 500)
    others = others.toDF("doc_id", "sibling_of", "type", "period_key", "amount")
    cells = l.select("doc_id", "type", F.lit("x").alias("period_key"), "row_id", (F.col("amount") % 500).alias("amount"))
    return scoring.sibling_cells(cells, others).select("doc_id", "type", "row_id", "amount")


def merged_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as parts of a statement: the next continues it where the date is close and the status the same."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("part_id"), F.col("o_orderstatus").alias("type"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("day"), "o_orderkey")
    page = F.floor(F.col("day") / 200).cast("int")
    parts = o.select("doc_id", "part_id", "type", F.lit("g").alias("grp"), page.alias("first_page"), page.alias("last_page"), F.col("o_orderkey").alias("place"), F.create_map(F.lit("a"), F.lit(10.0)).alias("centres"), F.lit(100.0).alias("page_width"), (F.col("o_orderkey") % 5 == 0).alias("closed"))
    return continuation.merged_parts(parts)


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    l = _lines(spark, folder)
    return continuation.reading_order(l.select(F.col("t").alias("page"), F.concat_ws("-", "t", "r", "p", "q").alias("line_id"), F.col("q").alias("top"), F.col("r").alias("left"))).select("page", "line_id", "place")


def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Parts in orders of three flags, each as the first flag has it."""
    l = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag", "l_suppkey")
    lists = [l.where(F.col("l_returnflag") == f).groupBy("part").agg(F.max("l_suppkey").alias("supplier")).withColumn("flag", F.lit(f)) for f in ("R", "A", "N")]
    return continuation.first_seen(lists, ["part"])


def oldest_order(spark: SparkSession, folder: str) -> DataFrame:
    """The open order that has waited longest; one row is the operator's own."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.to_date("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return continuation.oldest(o, "O").select("job_id")


def edition_pairs(spark: SparkSession, folder: str) -> DataFrame:
    s = _names(spark, folder).where("issuer IS NOT NULL").select(F.col("source_id").alias("doc_id"), "language", labels.issuer_key(F.col("issuer")).alias("issuer"), "fiscal_year", "period")
    return continuation.edition_pairs(s, ["issuer", "fiscal_year", "period"])


#: Totals known by parts that they add up, for the query below.
SUMS = (("short_assets", ("cash_at_hand",)), ("running_result", ("wear_charge",)), ("owner_funds", ("kept_profits",)))


def mapped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all gold statements mapped to items."""
    return label_mapping.map_rows(*_statement_rows(spark, folder))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    net_profit_tie, eps_status, grid_cells, column_periods, table_hierarchy, nearest_column, contained, column_centres, cell_box, reversed_words, token_classes, split_notes,
    unit_signals, digit_forms, header_dates, strict_headers, placeholder_tokens, document_keys, reading_variants, text_layers,
    joined_once, set_recalls, cell_map, text_lengths, out_of_order, required_parts, owner_sample, top_labels, run_agreement, scanned_breakdown, document_status, first_reasons, mapping_sources,
    unmapped_rows, frame_lookup, mapped_rows, statement_scores, resolved_tags, closing_identities, sibling_cells, merged_parts, reading_order, first_seen, oldest_order, edition_pairs,
)}

# --- the same in SQL -------------------------------------------------------------------------------

_GRID = "WITH o AS (SELECT o_orderkey AS table_id, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)"


def _contains(c: str, words: tuple[str, ...]) -> str:
    return " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words)


_CUES = [(c, n) for n, cues in units.SCALE_CUES.items() for c in cues]


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _oracles() -> dict[str, str]:
    from tallyspark.plans.pipeline import _P4
    from tallyspark.plans.records import _CURRENCY, _SUFFIXES, _key, _simple

    assert _SUFFIXES
    cue = "CASE " + " ".join(f"WHEN contains(lower(unit_text), '{_quoted(c)}') THEN '{_quoted(c)}'" for c, _ in _CUES) + " END"
    scale = "CASE " + " ".join(f"WHEN contains(lower(unit_text), '{_quoted(c)}') THEN {n}" for c, n in _CUES) + " END"
    return {
        "net_profit_tie": _LU + ", c AS (SELECT t, r, q + CASE WHEN t % 3 = 0 THEN 7 ELSE 0 END AS a, row_number() OVER (PARTITION BY t ORDER BY r) AS k FROM l), h AS (SELECT t, r, a FROM c WHERE k = 1), m AS (SELECT h.t, MIN(l.r) AS mr FROM h JOIN l ON l.t = h.t AND abs(l.q - h.a) <= 0.5 GROUP BY 1) SELECT h.t AS doc_id, CAST(h.r AS VARCHAR) AS head_row, CAST(h.a AS DOUBLE) AS actual, CAST(l.q AS DOUBLE) AS expected, CAST(m.mr AS VARCHAR) AS match_row, CASE WHEN m.mr IS NULL THEN 'fail' ELSE 'pass' END AS status FROM h LEFT JOIN m USING (t) LEFT JOIN l ON l.t = h.t AND l.r = m.mr",
        "eps_status": "WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS p, CAST(o_custkey % 97 + 1 AS DOUBLE) AS s FROM orders), e AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE floor(p / s * 100) / 100 + CASE WHEN o_orderkey % 4 = 0 THEN 3.0 ELSE 0.0 END END AS e, least((p - 0.5) / (s - 0.5), (p - 0.5) / (s + 0.5), (p + 0.5) / (s - 0.5), (p + 0.5) / (s + 0.5)) AS lo, greatest((p - 0.5) / (s - 0.5), (p - 0.5) / (s + 0.5), (p + 0.5) / (s - 0.5), (p + 0.5) / (s + 0.5)) AS hi FROM o) SELECT o_orderkey, CASE WHEN e IS NULL THEN 'missing_values' WHEN e + 0.005 >= lo AND e - 0.005 <= hi AND e / 100 + 0.005 >= lo AND e / 100 - 0.005 <= hi THEN 'precision_insufficient' WHEN e + 0.005 >= lo AND e - 0.005 <= hi THEN 'pass' ELSE 'fail' END AS status FROM e",
        "grid_cells": _GRID + " SELECT table_id, x.r AS row, x.c AS col, x.s AS text, x.h AS is_header FROM (SELECT table_id, unnest([{'r': 0, 'c': 1, 's': 'As at ' || strftime(d, '%Y-%m-%d'), 'h': TRUE}, {'r': 0, 'c': 2, 's': strftime(d - INTERVAL 12 MONTH, '%Y-%m-%d'), 'h': TRUE}, {'r': 0, 'c': 3, 's': strftime(d, '%Y-%m-%d'), 'h': TRUE}, {'r': 1, 'c': 0, 's': 'Total assets', 'h': FALSE}, {'r': 1, 'c': 1, 's': format('{:,}', v), 'h': FALSE}]) AS x FROM o)",
        "column_periods": _GRID + " SELECT table_id, c AS col, strftime(e, '%Y-%m-%d') AS key, strftime(e, '%Y-%m-%d') AS end_date, c < 3 AS bound FROM (SELECT table_id, 1 AS c, d AS e FROM o UNION ALL SELECT table_id, 2, CAST(d - INTERVAL 12 MONTH AS DATE) FROM o UNION ALL SELECT table_id, 3, d FROM o)",
        "table_hierarchy": _LU + ", a AS (SELECT t, r, q % 3 AS i, CASE WHEN r % 5 = 0 THEN 'Total due' WHEN r % 7 = 0 THEN '' ELSE 'line ' || r END AS label, r % 3 <> 0 AS hv, dense_rank() OVER (PARTITION BY t ORDER BY q % 3) - 1 AS d FROM l), s AS (SELECT *, label <> '' AND NOT hv AS sec FROM a) SELECT CAST(t AS VARCHAR) AS table_id, CAST(r AS BIGINT) AS row, CAST(d AS INTEGER) AS depth, CAST((SELECT MAX(b.r) FROM s b WHERE b.t = s.t AND b.r < s.r AND b.sec AND (b.d < s.d OR (b.d = s.d AND NOT s.sec))) AS BIGINT) AS parent_row, hv AND (label = '' OR label = 'Total due') AS is_subtotal, sec AS is_section FROM s",
        "nearest_column": _L + ", c(k, x) AS (VALUES (0, 10), (1, 25), (2, 40)) SELECT t AS table_id, r AS value_id, arg_min(k, abs(q - x) * 10 + k) AS column_id FROM l, c WHERE abs(q - x) <= 6 GROUP BY 1, 2",
        "contained": _L + ", b AS (SELECT t, r, q AS a, r AS u, q + p % 50 AS z, r + p % 7 AS w FROM l) SELECT i.t AS page, i.r AS inner_id, o.r AS outer_id FROM b i JOIN b o ON i.t = o.t AND i.r <> o.r AND i.a >= o.a AND i.u >= o.u AND i.z <= o.z AND i.w <= o.w",
        "column_centres": _L + " SELECT t AS table_id, q % 2 AS col, round(AVG(q + 2.0), 6) AS centre, COUNT(DISTINCT r) AS rows FROM l GROUP BY 1, 2 HAVING COUNT(DISTINCT r) >= 2",
        "cell_box": _L + ", c AS (SELECT t, r, r % 2 AS rw, q % 2 AS cl, r % 4 = 0 AS gone, CASE WHEN r % 4 <> 0 THEN CAST(q AS DOUBLE) END AS a, CASE WHEN r % 4 <> 0 THEN q + 3.0 END AS b, CASE WHEN r % 4 <> 0 THEN CAST(r AS DOUBLE) END AS u, CASE WHEN r % 4 <> 0 THEN r + 1.0 END AS w FROM l) SELECT t AS table_id, r, CASE WHEN gone THEN MIN(a) OVER y ELSE a END AS left, CASE WHEN gone THEN MAX(b) OVER y ELSE b END AS right, CASE WHEN gone THEN MIN(u) OVER x ELSE u END AS top, CASE WHEN gone THEN MAX(w) OVER x ELSE w END AS bottom, gone AS synthesized FROM c WINDOW x AS (PARTITION BY t, rw), y AS (PARTITION BY t, cl)",
        "reversed_words": _L + " SELECT *, CASE WHEN backward >= 3 AND backward > 2 * forward THEN 'words_reversed' WHEN backward > 0 THEN 'word_order_uncertain' END AS verdict FROM (SELECT t AS table_id, COUNT(*) FILTER (q % 5 = 0) AS forward, COUNT(*) FILTER (q % 2 = 0) AS backward FROM l GROUP BY 1)",
        "token_classes": "SELECT o_orderkey, o_orderkey % 6 = 3 AS note, o_orderkey % 6 IN (0, 4, 5) AS amount FROM orders",
        "split_notes": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Cash at hand' WHEN 1 THEN 'Leases under IFRS ' || o_orderkey % 40 ELSE 'Other assets' END AS label, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS VARCHAR) END AS note FROM orders",
        "unit_signals": f"SELECT statement_id, CAST({scale} AS BIGINT) AS scale, {cue} AS scale_cue, {_CURRENCY} AS currency, COALESCE({_contains('lower(unit_text)', units.PER_SHARE_EXCEPTIONS)}, FALSE) AS per_share_exempt FROM statements WHERE unit_text IS NOT NULL",
        "digit_forms": f"SELECT doc_id, sha256(translate(translate(text, '{numbers.BIDI}', ''), '{numbers.EASTERN_DIGITS}', '{numbers.WESTERN_DIGITS}')) AS digest, COALESCE(translate(text, '{numbers.EASTERN_DIGITS}', '{numbers.WESTERN_DIGITS}') <> text, FALSE) AS eastern FROM documents",
        "header_dates": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN strftime(d, '%Y') || '-12-31' WHEN 3 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS end_date FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
        "strict_headers": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 AS k FROM orders), e AS (SELECT *, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN last_day(d) WHEN 4 THEN make_date(year(d), 12, 31) WHEN 5 THEN d END AS x FROM o)
SELECT o_orderkey, CASE k WHEN 2 THEN 'month_year' WHEN 3 THEN 'invalid' WHEN 4 THEN 'year_only' WHEN 6 THEN 'missing' ELSE 'complete' END AS calendar, CASE k WHEN 1 THEN 'explicit' WHEN 5 THEN 'invalid' ELSE 'none' END AS duration, strftime(x, '%Y-%m-%d') AS end_date, CASE WHEN k = 1 THEN 6 END AS months, CASE WHEN k = 1 THEN '6M-' || strftime(x, '%Y-%m-%d') WHEN k <> 5 THEN strftime(x, '%Y-%m-%d') END AS period_key FROM e""",
        "placeholder_tokens": "SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 4) AS placeholder, round(pow(10.0, -(o_orderkey % 4)), 6) AS quantum FROM orders",
        "document_keys": _S + f" SELECT source_id, COALESCE('cik:' || TRY_CAST(NULLIF(regexp_extract(cik, '(\\d+)', 1), '') AS BIGINT), {_key('issuer')}) AS key FROM so",
        "reading_variants": "SELECT alias_id, CASE WHEN b = alias THEN alias ELSE alias || '|' || b END AS readings FROM (SELECT alias_id, alias, array_to_string(list_reverse(regexp_split_to_array(alias, '\\s+')), ' ') AS b FROM taxonomy_aliases)",
        "text_layers": "SELECT source_id, CASE WHEN a = n THEN 'digital' WHEN a = 0 THEN 'scanned' ELSE 'mixed' END AS layer FROM (SELECT source_id, COUNT(*) FILTER (COALESCE(n_chars, 0) >= 400) AS a, COUNT(*) AS n FROM documents WHERE source_id IS NOT NULL GROUP BY 1)",
        "joined_once": "WITH a AS (SELECT o_custkey AS id, COUNT(*) OVER (PARTITION BY o_custkey) AS truth_n FROM orders), b AS (SELECT c_custkey AS id, COUNT(*) OVER (PARTITION BY c_custkey) AS prediction_n FROM customer) SELECT truth_n, prediction_n, COUNT(*) AS n FROM a FULL JOIN b USING (id) GROUP BY 1, 2",
        "set_recalls": "SELECT l_orderkey, round(len(list_intersect(a, b)) / NULLIF(CAST(len(a) AS DOUBLE), 0), 9) AS recall FROM (SELECT l_orderkey, COALESCE(list(DISTINCT l_returnflag) FILTER (l_linenumber % 2 = 1), []) AS a, COALESCE(list(DISTINCT l_returnflag) FILTER (l_linenumber % 2 = 0), []) AS b FROM lineitem GROUP BY 1)",
        "cell_map": "WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderkey % 2 AS m FROM orders), a AS (SELECT o_custkey, yr, COUNT(*) AS odd FROM o WHERE m = 1 GROUP BY 1, 2), b AS (SELECT o_custkey, yr, COUNT(*) AS even FROM o WHERE m = 0 GROUP BY 1, 2) SELECT o_custkey, yr, odd, even FROM a FULL JOIN b USING (o_custkey, yr)",
        "text_lengths": "SELECT COUNT(n_chars) AS count, round(AVG(n_chars), 3) AS mean, MAX(n_chars) AS max FROM documents",
        "out_of_order": "SELECT o_custkey, line FROM (SELECT o_custkey, o_orderkey AS line, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE d < b",
        "required_parts": "WITH c AS (SELECT l_orderkey AS parent, list(DISTINCT l_returnflag || l_linestatus) AS h FROM lineitem GROUP BY 1) SELECT parent, 'returned_and_kept' AS item_id FROM c WHERE list_contains(h, 'RF') AND list_contains(h, 'AF') UNION ALL SELECT parent, 'open' FROM c WHERE list_contains(h, 'NO')",
        "owner_sample": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderpriority IS NULL ORDER BY sha256('s:' || o_orderkey), o_orderkey LIMIT 50)",
        "top_labels": "WITH ex AS (SELECT DISTINCT ON (example_id) * FROM audit_examples ORDER BY example_id), n AS (SELECT statement, lower(label) AS label, COUNT(*) AS n FROM ex WHERE label IS NOT NULL GROUP BY 1, 2) SELECT statement, label, n, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY n DESC, label) AS k FROM n) WHERE k <= 10",
        "run_agreement": "SELECT l_orderkey, COUNT(DISTINCT l_linenumber) AS runs, COUNT(DISTINCT l_returnflag) AS \"values\", COUNT(DISTINCT l_returnflag) = 1 AS agreed FROM lineitem GROUP BY 1",
        "scanned_breakdown": "SELECT l_returnflag, COUNT(*) AS cells, COUNT(*) FILTER (l_quantity < 20) AS \"right\", round(COUNT(*) FILTER (l_quantity < 20) / CAST(COUNT(*) AS DOUBLE), 9) AS accuracy, round(CASE WHEN COUNT(l_tax) = COUNT(*) THEN AVG(CAST(l_tax AS DOUBLE)) END, 9) AS mean_seconds FROM lineitem GROUP BY 1",
        "document_status": "SELECT doc_id, CASE WHEN bool_and(scale IS NOT NULL) AND bool_and(CASE WHEN consolidated THEN TRUE ELSE len(list_filter(COALESCE(flags, []), lambda f: f <> 'low_selectivity')) = 0 END) THEN 'completed' ELSE 'needs_review' END AS status FROM statements GROUP BY 1",
        "first_reasons": _S + " SELECT CASE WHEN cik IS NULL THEN 'no_number' WHEN issuer IS NULL THEN 'no_name' WHEN NOT verified THEN 'not_verified' END AS reason, COUNT(*) AS n FROM so GROUP BY 1",
        "mapping_sources": "WITH ex AS (SELECT DISTINCT ON (example_id) * FROM audit_examples ORDER BY example_id) SELECT CASE WHEN role IS NOT NULL AND tag IS NOT NULL THEN 'alias_in_section' WHEN abstention_reason IS NOT NULL AND canonical_id IS NOT NULL THEN 'section_conflict' WHEN statement = 'cash_flow' THEN 'alias_total_unconfirmed' WHEN canonical_id IS NOT NULL THEN 'alias' WHEN label IS NOT NULL THEN 'anchor' ELSE 'no_alias_no_anchor' END AS how, COUNT(*) AS n FROM ex GROUP BY 1",
        "mapped_rows": _P4 + f""", fg AS (SELECT file_id, sp, rp, string_agg(k || '=' || x, ',' ORDER BY k || '=' || x) AS figures FROM v WHERE x IS NOT NULL GROUP BY 1, 2, 3),
n0 AS (SELECT file_id || '/' || sp AS st, rp, replace({_simple("json_extract_string(r, '$.label')")}, ' ', '') AS sq, rp % 5 <> 2 AS hv, rp % 4 = 3 AS tot, rp % 8 = 3 AS chk, rp % 8 = 3 OR rp % 3 = 0 AS conf, figures FROM r LEFT JOIN fg USING (file_id, sp, rp)),
n AS (SELECT *, CASE WHEN NOT tot THEN MIN(CASE WHEN tot AND hv THEN rp END) OVER (PARTITION BY st ORDER BY rp ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS par, lag(sq) OVER (PARTITION BY st ORDER BY rp) AS ab, NOT lag(hv) OVER (PARTITION BY st ORDER BY rp) AS uh FROM n0),
al AS (SELECT DISTINCT item_id, replace({_simple('alias')}, ' ', '') AS sq, within, subtotal FROM taxonomy_aliases JOIN taxonomy_items USING (item_id)),
ad AS (SELECT st, rp, list({{'i': item_id, 'w': within, 's': subtotal}} ORDER BY item_id) AS a FROM n JOIN al USING (sq) WHERE hv AND n.sq <> '' GROUP BY 1, 2),
fc AS (SELECT st, par AS rp, arg_min({{'ab': ab, 'uh': COALESCE(uh, FALSE), 'sq': sq}}, rp) AS f FROM n WHERE par IS NOT NULL GROUP BY 1, 2),
hs AS (SELECT n.st, n.rp, al.item_id, length(al.sq) AS m FROM n JOIN fc ON fc.st = n.st AND fc.rp = n.rp JOIN al ON al.subtotal AND al.sq <> '' AND CASE WHEN f.uh THEN al.sq = f.ab ELSE starts_with(f.sq, al.sq) AND f.sq <> al.sq END WHERE tot AND hv AND chk),
sa AS (SELECT st, rp, 'section_heading' AS kind, MIN(item_id) AS item FROM (SELECT *, MAX(m) OVER (PARTITION BY st, rp) AS mm FROM hs) WHERE m = mm GROUP BY 1, 2 HAVING COUNT(DISTINCT item_id) = 1),
k1 AS (SELECT n.st, n.rp, n.par, n.conf, n.figures, COALESCE(a, []) AS a, sa.item AS sec FROM n LEFT JOIN ad ON ad.st = n.st AND ad.rp = n.rp LEFT JOIN sa ON sa.st = n.st AND sa.rp = n.rp WHERE hv),
p1 AS (SELECT st, rp, CASE WHEN len(a) > 1 THEN NULL WHEN len(a) = 1 AND sec <> a[1].i THEN NULL WHEN len(a) = 1 AND a[1].s AND NOT conf THEN NULL WHEN len(a) = 1 THEN a[1].i ELSE sec END AS item FROM k1),
su(item, need) AS (VALUES {', '.join(f"('{i}', '{p[0]}')" for i, p in SUMS)}),
sm AS (SELECT DISTINCT n.st, n.rp, 'sum_of_mapped' AS kind, su.item FROM n JOIN n c ON c.st = n.st AND c.par = n.rp JOIN p1 ON p1.st = c.st AND p1.rp = c.rp JOIN su ON su.need = p1.item WHERE n.tot AND n.hv AND n.chk),
an AS (SELECT st, rp, list({{'k': kind, 'i': item}} ORDER BY kind, item) AS an FROM (SELECT * FROM sa UNION SELECT * FROM sm) GROUP BY 1, 2),
k2 AS (SELECT k1.st, k1.rp, k1.par, k1.conf, k1.figures, k1.a AS a0, COALESCE(an, []) AS an, pp.item AS sc, list_filter(k1.a, lambda y: y.w = pp.item) AS wi FROM k1 LEFT JOIN an ON an.st = k1.st AND an.rp = k1.rp LEFT JOIN p1 pp ON pp.st = k1.st AND pp.rp = k1.par),
k3 AS (SELECT *, CASE WHEN sc IS NOT NULL AND len(a0) > 1 AND len(wi) = 1 THEN wi ELSE a0 END AS a, sc IS NOT NULL AND len(a0) > 1 AND len(wi) = 1 AS narrow, list_sort(list_distinct(list_transform(an, lambda y: y.i))) AS ai FROM k2),
k4 AS (SELECT *, CASE WHEN sc IS NOT NULL AND len(a0) = 1 AND a[1].w IS NOT NULL AND a[1].w <> sc AND sc IN (SELECT within FROM taxonomy_items WHERE within IS NOT NULL) THEN 'section_conflict:' || a[1].i || '|section=' || sc WHEN len(a) > 1 THEN 'alias_multiple:' || array_to_string(list_transform(a, lambda y: y.i), '|') WHEN len(ai) > 1 THEN 'anchor_conflict:' || array_to_string(list_transform(an, lambda y: y.k || '=' || y.i), '|') WHEN len(a) = 1 AND ai[1] <> a[1].i THEN 'anchor_conflict:alias=' || a[1].i || '|' || an[1].k || '=' || ai[1] WHEN len(a) = 1 AND a[1].s AND NOT conf THEN 'alias_total_unconfirmed:' || a[1].i WHEN len(a) = 1 THEN CASE WHEN narrow THEN 'alias_in_section:' || sc ELSE 'alias' END WHEN len(ai) = 1 THEN 'anchor:' || an[1].k ELSE 'no_alias_no_anchor' END AS ev FROM k3),
k5 AS (SELECT *, CASE WHEN ev = 'alias' OR starts_with(ev, 'alias_in_section') THEN a[1].i WHEN starts_with(ev, 'anchor:') THEN ai[1] END AS item FROM k4),
k6 AS (SELECT *, COALESCE(item, CASE WHEN starts_with(ev, 'alias_total_unconfirmed:') THEN substring(ev, 25) END) AS cl FROM k5),
g AS (SELECT st, cl, COUNT(*) AS n, MIN(COALESCE(figures, '')) = MAX(COALESCE(figures, '')) AS same, arg_min(rp, CASE WHEN item IS NOT NULL THEN rp END) FILTER (item IS NOT NULL) AS held FROM k6 WHERE cl IS NOT NULL GROUP BY 1, 2),
ou AS (SELECT o.st, o.cl, o.rp FROM k6 o JOIN g ON g.st = o.st AND g.cl = o.cl JOIN k6 c ON c.st = o.st AND c.cl = o.cl AND c.par = o.rp WHERE g.n > 1 AND NOT g.same GROUP BY o.st, o.cl, o.rp, g.n HAVING COUNT(*) = g.n - 1),
z AS (SELECT k6.st, k6.rp, k6.item, k6.ev, CASE WHEN g.n > 1 AND g.same AND item IS NOT NULL AND k6.rp <> g.held THEN 'repeat_of:' || g.held || ':' || k6.cl WHEN g.n > 1 AND NOT g.same AND ou.rp IS NULL THEN 'duplicate:' || k6.cl END AS lost FROM k6 LEFT JOIN g ON g.st = k6.st AND g.cl = k6.cl LEFT JOIN ou ON ou.st = k6.st AND ou.cl = k6.cl AND ou.rp = k6.rp)
SELECT st AS statement_id, CAST(rp AS VARCHAR) AS row_id, CASE WHEN lost IS NULL THEN item END AS item_id, COALESCE(lost, ev) AS evidence, CASE WHEN lost IS NOT NULL THEN 'ambiguous' WHEN ev = 'no_alias_no_anchor' THEN 'unmapped' WHEN item IS NULL THEN 'ambiguous' END AS flag FROM z""",
        "resolved_tags": """WITH ex AS (SELECT DISTINCT ON (example_id) * FROM audit_examples ORDER BY example_id), nm AS (SELECT tag, ex.statement AS statement, MIN(canonical_id) AS a, MAX(canonical_id) AS b FROM ex JOIN taxonomy_items ON item_id = canonical_id WHERE tag IS NOT NULL GROUP BY 1, 2),
r AS (SELECT example_id, ex.tag, string_split(ex.tag, ':')[1] AS scope, CASE WHEN length(example_id) % 11 = 0 THEN 'unknown' WHEN ends_with(example_id, '7') THEN 'negative_control' ELSE 'source' END AS role, canonical_id IS NOT NULL AS comp, a, b FROM ex LEFT JOIN nm ON nm.tag = ex.tag AND nm.statement = ex.statement),
o AS (SELECT *, CASE WHEN tag IS NULL THEN 'missing_key' WHEN role = 'unknown' THEN 'unknown_role' WHEN role = 'negative_control' THEN CASE WHEN scope = 'us-gaap' THEN 'control' ELSE 'negative_control_policy_missing' END WHEN a IS NULL THEN CASE WHEN scope = 'custom' THEN 'own_extension' ELSE 'missing_entry' END WHEN a <> b THEN 'several_items' WHEN length(tag) % 5 = 0 AND NOT comp THEN 'companion_required' END AS reason FROM r)
SELECT example_id, CASE WHEN reason IS NULL THEN 'mapped' WHEN reason IN ('control', 'own_extension', 'several_items') THEN 'abstain' ELSE 'unresolved' END AS outcome, CASE WHEN reason IS NULL THEN a END AS canonical_id, reason FROM o""",
        "closing_identities": STAR_SQL + """, b AS (SELECT f.* FROM frame f WHERE type = 'balance'), la AS (SELECT statement_id, canonical_id, MAX(row_ordinal) AS o FROM b GROUP BY 1, 2), v AS (SELECT b.statement_id, b.period_key, b.canonical_id, MAX(b.reported) AS x FROM b JOIN la ON la.statement_id = b.statement_id AND la.canonical_id = b.canonical_id AND la.o = b.row_ordinal GROUP BY 1, 2, 3),
w AS (SELECT s.statement_id, s.period_key, a.x AS ta, t.x AS le, l.x AS li, e.x AS eq, EXISTS (SELECT 1 FROM la WHERE la.statement_id = s.statement_id AND canonical_id = 'total_assets') AS ha, EXISTS (SELECT 1 FROM la WHERE la.statement_id = s.statement_id AND canonical_id = 'total_liabilities_and_equity') AS hb, (SELECT COUNT(*) FROM la WHERE la.statement_id = s.statement_id AND canonical_id IN ('total_liabilities', 'total_equity')) = 2 AS hc FROM (SELECT DISTINCT statement_id, period_key FROM b) s LEFT JOIN v a ON a.statement_id = s.statement_id AND a.period_key = s.period_key AND a.canonical_id = 'total_assets' LEFT JOIN v t ON t.statement_id = s.statement_id AND t.period_key = s.period_key AND t.canonical_id = 'total_liabilities_and_equity' LEFT JOIN v l ON l.statement_id = s.statement_id AND l.period_key = s.period_key AND l.canonical_id = 'total_liabilities' LEFT JOIN v e ON e.statement_id = s.statement_id AND e.period_key = s.period_key AND e.canonical_id = 'total_equity'),
z AS (SELECT *, ha AND (hb OR hc) AS ok, CASE WHEN hb THEN le ELSE li + eq END AS ex FROM w) SELECT statement_id, period_key, CASE WHEN NOT ok THEN 'identity_totals_not_found' WHEN ta IS NULL OR ex IS NULL THEN 'missing_values' WHEN abs(ta - ex) <= CASE WHEN hb THEN 0.5 ELSE 1.0 END THEN 'pass' ELSE 'fail' END AS status, CASE WHEN ok THEN CAST(ta AS DOUBLE) END AS actual, CASE WHEN ok THEN CAST(ex AS DOUBLE) END AS expected FROM z""",
        "sibling_cells": "WITH l AS (SELECT l_orderkey AS d, l_returnflag AS ty, l_linenumber AS r, CAST(floor(l_extendedprice) AS BIGINT) % 500 AS a FROM lineitem), n AS (SELECT o_orderkey AS d, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders) SELECT d AS doc_id, ty AS type, r AS row_id, a AS amount FROM l WHERE a <> 0 AND EXISTS (SELECT 1 FROM n JOIN l k ON k.d = n.d WHERE n.nx = l.d AND k.ty = l.ty AND k.a = l.a)",
        "merged_parts": "WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderstatus AS ty, o_orderkey AS k, CAST(floor(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) / 200.0) AS INTEGER) AS pg FROM orders), p AS (SELECT *, lag(pg) OVER w AS bp, lag(k) OVER w AS bk FROM o WINDOW w AS (PARTITION BY doc_id, ty ORDER BY pg, k)), q AS (SELECT *, CASE WHEN bk IS NULL OR bk % 5 = 0 OR pg - bp > 1 THEN k END AS h FROM p) SELECT doc_id, CAST(k AS VARCHAR) AS part_id, CAST(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id, ty ORDER BY pg, k ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS head_id FROM q",
        "reading_order": _L + ", i AS (SELECT t, q, r, t || '-' || r || '-' || p || '-' || q AS x FROM l) SELECT t AS page, x AS line_id, CAST(row_number() OVER (PARTITION BY t ORDER BY q, r, x) AS INTEGER) AS place FROM i",
        "first_seen": "WITH g AS (SELECT l_partkey AS part, l_returnflag AS flag, MAX(l_suppkey) AS supplier FROM lineitem GROUP BY 1, 2) SELECT part, supplier, flag FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS k FROM g) WHERE k = 1",
        "oldest_order": "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 1",
        "edition_pairs": _S + f" SELECT issuer, fiscal_year, period, MIN(e) AS en_id, MIN(a) AS ar_id FROM (SELECT {_key('issuer')} AS issuer, fiscal_year, period, CASE WHEN language = 'en' THEN source_id END AS e, CASE WHEN language = 'ar' THEN source_id END AS a FROM so WHERE issuer IS NOT NULL AND language IN ('en', 'ar')) GROUP BY 1, 2, 3 HAVING COUNT(e) = 1 AND COUNT(a) = 1",
        "unmapped_rows": STAR_SQL + " SELECT statement_id, COUNT(DISTINCT CASE WHEN item IS NULL THEN row_id END) AS unmapped FROM figures GROUP BY 1",
        "frame_lookup": STAR_SQL + " SELECT doc_id, period_key, CAST(value AS DOUBLE) AS value FROM frame WHERE canonical_id = 'total_assets' AND type = 'balance' AND end_date = DATE '1997-12-31' AND months IS NULL",
    }


ORACLES: dict[str, str] = _oracles()
