"""Queries over labelled rows, sources, documents and events: parsers, datasets, splits, scores, ranges, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import hashing, labels, numbers, periods, stats, units
from tallyspark.operators import dataset, documents, evaluate, locate, mapping, shred, split, sums, tables
from tallyspark.session import table
from tallyspark.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    """Audit examples, each once; repeated deliveries have the same content."""
    return table(spark, folder, "audit_examples").dropDuplicates(["example_id"])


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").dropDuplicates(["source_id"])


# --- parsers -----------------------------------------------------------------------------------------


def _raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    roles = table(spark, folder, "metric_values").select(F.explode("inputs").alias("role", "used"))
    return roles.select(F.explode("used").alias("x")).select("x.input_id", "x.raw_text", "x.reported").where("raw_text IS NOT NULL").dropDuplicates(["input_id"])


def plain_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The JVM-side number path over all printed figures."""
    return _raw_texts(spark, folder).select("input_id", numbers.plain_number(F.col("raw_text")).cast("double").alias("value"))


def parse_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The full parser over all printed figures; what it cannot read has a null value, and why is in its flags."""
    parsed = _raw_texts(spark, folder).withColumn("p", numbers.parse_number("raw_text"))
    return parsed.select("input_id", F.col("p.value").cast("double").alias("value"), F.col("p.unit").alias("unit"), F.array_join("p.flags", ";").alias("flags"))


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """Scale and currency by wording in statement captions."""
    s = table(spark, folder, "statements").where("unit_text IS NOT NULL")
    return s.select("statement_id", units.detect_scale(F.col("unit_text")).alias("scale"), units.detect_currency(F.col("unit_text")).alias("currency"))


def period_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers made of order dates, read back."""
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("d", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("For the six months ended "), F.date_format("d", "d MMMM yyyy"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Year ended "), F.date_format("d", "dd/MM/yyyy"), F.lit(" (unaudited)"))).otherwise(F.concat(F.date_format("d", "yyyy"), F.lit(" (Restated)")))
    p = o.withColumn("p", periods.parse_period(text))
    return p.select("o_orderkey", F.col("p.key").alias("period_key"), F.date_format("p.end_date", "yyyy-MM-dd").alias("end_date"), F.col("p.kind").alias("kind"), F.col("p.months").alias("months"), F.col("p.restated").alias("restated"), F.col("p.audited").alias("audited"))


def month_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 13).cast("int").alias("n"))
    key = periods.make_key(F.col("d"), F.when(F.col("n") == 0, "instant").otherwise("duration"), F.col("n"))
    return o.select("o_orderkey", F.date_format(periods.months_before(F.col("d"), F.col("n")), "yyyy-MM-dd").alias("before"), key.alias("period_key"))


def label_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Captions in comparable form, with what they look like they are."""
    a = table(spark, folder, "taxonomy_aliases")
    form = labels.simple_label(F.col("alias"))
    return a.select("alias_id", form.alias("form"), labels.squash(form).alias("squashed"), labels.label_key(F.col("alias")).alias("key"), labels.has_subtotal_cue(form).alias("is_total"), labels.is_per_share(F.col("alias")).alias("per_share"))


def issuer_keys(spark: SparkSession, folder: str) -> DataFrame:
    s = _sources(spark, folder)
    return s.select("source_id", labels.issuer_key(F.col("issuer")).alias("issuer_key"), labels.cik_key(F.regexp_extract("cik", "(\\d+)", 1)).alias("cik_key"))


def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "taxonomy_aliases").select(F.col("alias_id"), hashing.digest(F.col("item_id"), F.col("lang")).alias("digest"))
    return a


def garbled_texts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(labels.is_garbled(F.col("text"))).alias("garbled"))


def formatted_amounts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select("c_custkey", numbers.format_amount(F.col("c_acctbal").cast("decimal(18,2)")).alias("amount"))


def digit_places(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", F.floor("o_totalprice").cast("decimal(20,0)").alias("a"), (F.floor("o_totalprice") + F.col("o_orderkey") % 3 * F.lit(100)).cast("decimal(20,0)").alias("b"))
    return o.select("o_orderkey", numbers.single_digit_place((F.col("b") - F.col("a")).cast("decimal(20,0)")).cast("int").alias("place"), numbers.one_digit_apart(F.col("a"), F.col("b")).alias("apart"))


# --- splits and datasets -----------------------------------------------------------------------------


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    keys = _sources(spark, folder).where("issuer IS NOT NULL").select(labels.issuer_key(F.col("issuer")).alias("key")).distinct()
    return keys.select("key", hashing.bucket(F.col("key"), hashing.SPLIT_SALT).alias("bucket"), split.hashed_part(F.col("key")).alias("part"))


def pool_assign(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    kind = F.when(F.col("c_custkey") % 2 == 0, "sec").otherwise("pdf")
    return c.select("c_custkey", split.hashed_pool(kind, F.concat(F.lit("cik:"), "c_custkey"), F.lower("c_name")).alias("pool"))


def _parted(spark: SparkSession, folder: str) -> DataFrame:
    s = _sources(spark, folder).where("issuer IS NOT NULL").select(labels.issuer_key(F.col("issuer")).alias("key"), "language", "period")
    return s.withColumn("part", split.hashed_part(F.col("key")))


def part_counts(spark: SparkSession, folder: str) -> DataFrame:
    return split.part_counts(_parted(spark, folder))


def moved_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = _parted(spark, folder).select("key", "part").distinct()
    moves = parts.where("key LIKE 'b%'").select("key", F.lit("validation").alias("to_part"))
    return split.with_moves(parts, moves).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def impure_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Issuers whose sources lie in several recorded pools."""
    s = _sources(spark, folder).where("issuer IS NOT NULL AND pool IS NOT NULL").select(labels.issuer_key(F.col("issuer")).alias("key"), "pool")
    return split.impure_keys(s, "key", "pool").select("key", F.array_join("parts", ",").alias("parts"))


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    return _examples(spark, folder).where("label IS NOT NULL").select("example_id", "source_id", "statement", F.lower("label").alias("label"), "canonical_id")


def dedupe_lowest(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.dedupe_lowest(_grouped(spark, folder), ["source_id", "statement", "label"], "canonical_id", "example_id")


def target_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.conflicts(_grouped(spark, folder), ["source_id", "label"], "canonical_id")


def issuer_cap(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.cap_per_key(_examples(spark, folder).select("example_id", "source_id"), "source_id", "example_id", 40)


def sampled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample; the limit is the operator's own."""
    return dataset.select_rows(_examples(spark, folder).select("example_id", "statement"), "example_id", 500, "seed-7:")


def route_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = _sources(spark, folder)
    rules = [("missing_issuer", F.col("issuer").isNull()), ("unverified", ~F.col("verified")), ("missing_cik", F.col("cik").isNull()), ("pool_test", F.col("pool") == "test"), ("interim", F.col("period") == "interim")]
    return dataset.route_counts(dataset.route(s, rules))


def row_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Every example by what becomes of it, and by statement: a cascade of rules, counted in one pass."""
    ids = table(spark, folder, "taxonomy_items").select(F.col("item_id").alias("canonical_id"), F.lit(True).alias("listed"))
    e = _examples(spark, folder).select("statement", "label", "tag", "canonical_id").join(mapping.small(ids), "canonical_id", "left")
    rules = [
        ("unsupported_statement_code", ~F.col("statement").isin("income", "balance")), ("empty_label", F.col("label").isNull() | (F.trim("label") == "")), ("custom_extension", F.col("tag").isNull() | F.col("tag").startswith("custom:")),
        ("unsupported_namespace", ~F.substring_index("tag", ":", 1).isin("us-gaap", "ifrs-full")), ("null_entry", F.col("canonical_id").isNull()), ("outside_crosswalk", F.col("listed").isNull()),
    ]
    return dataset.route(e, rules).withColumn("kind", F.coalesce("drop_reason", F.lit("mapped"))).rollup("kind", "statement").agg(F.count(F.lit(1)).alias("n"))


def coverage_curve(spark: SparkSession, folder: str) -> DataFrame:
    counts = _examples(spark, folder).where("label IS NOT NULL").groupBy(F.lower("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return dataset.coverage_curve(counts, [10, 25, 50, 75, 90, 95, 99, 100])


def _target_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _grouped(spark, folder).groupBy("statement", "label", "canonical_id").agg(F.count(F.lit(1)).alias("n"))


def consistency_removals(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.consistency_removals(_target_counts(spark, folder), ["statement", "label"], "canonical_id", "n", (9, 10), (1, 2))


def exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left by statement after the removals."""
    removals = dataset.consistency_removals(_target_counts(spark, folder), ["statement", "label"], "canonical_id", "n", (9, 10), (1, 2))
    kept = dataset.apply_exclusions(_grouped(spark, folder), removals, ["statement", "label", "canonical_id"])
    return kept.groupBy("statement").agg(F.count(F.lit(1)).alias("n"))


def contradictory_sources(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.contradictory_keys(_grouped(spark, folder), "source_id", "canonical_id", "tbd", "other")


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All order lines, those of odd and those of even number."""
    lines = table(spark, folder, "lineitem").select("l_linenumber", "l_orderkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("quantity"))
    return lines.where("l_linenumber % 2 = 1").drop("l_linenumber"), lines.where("l_linenumber % 2 = 0").drop("l_linenumber")


def multiset_match(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _sides(spark, folder)
    return dataset.multiset_match(a, b.withColumnRenamed("l_orderkey", "other_key"), ["l_returnflag", "l_linestatus", "quantity"], "l_orderkey", "other_key")


def multiset_diff(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.multiset_difference(*_sides(spark, folder), ["l_returnflag", "l_linestatus", "quantity"])


def near_issuers(spark: SparkSession, folder: str) -> DataFrame:
    s = _sources(spark, folder).where("issuer IS NOT NULL").select(labels.issuer_key(F.col("issuer")).alias("k"), "pool").where("k <> ''")
    a = s.where("pool IN ('validation', 'test')").select(F.col("k").alias("query")).distinct().withColumn("words", F.split("query", " "))
    b = s.where("pool = 'train'").select(F.col("k").alias("name")).distinct().withColumn("words", F.split("name", " "))
    return dataset.near_matches(a, b, 3, 0.6).select("query", "name", F.round("similarity", 6).alias("similarity"), "rank")


def snapshot_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals by customer and priority before and after 1998, where they differ."""
    o = table(spark, folder, "orders")
    count = lambda df: df.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.compare_reports(count(o.where("year(o_orderdate) < 1998")), count(o.where("year(o_orderdate) >= 1998")), ["o_custkey", "o_orderpriority"], "n")


# --- scores ------------------------------------------------------------------------------------------


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with a listed target or none, beside the item of an equal caption."""
    ids = table(spark, folder, "taxonomy_items").select(F.col("item_id").alias("canonical_id"), F.lit(True).alias("listed"))
    names = table(spark, folder, "taxonomy_aliases").select(F.lower("alias").alias("label"), F.col("item_id").alias("prediction"))
    e = _examples(spark, folder).select("example_id", "source_id", "language", "statement", F.lower("label").alias("label"), "canonical_id")
    e = e.join(mapping.small(ids), "canonical_id", "left").where("canonical_id IS NULL OR listed")
    return e.join(mapping.small(names), "label", "left")


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(_predicted(spark, folder), "canonical_id", "prediction")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    classes = table(spark, folder, "taxonomy_items").select(F.col("item_id").alias("class"))
    return evaluate.class_scores(evaluate.confusion(_predicted(spark, folder), "canonical_id", "prediction"), "canonical_id", "prediction", classes)


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = _scores(spark, folder)
    return s.select("class", "support", "predicted", "correct", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.macro_f1(_scores(spark, folder)).withColumn("macro_f1", F.round("macro_f1", 9))


def score_strata(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(_predicted(spark, folder), "canonical_id", "prediction", ["language", "statement"])


def wilson(spark: SparkSession, folder: str) -> DataFrame:
    by = _predicted(spark, folder).groupBy("language").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("canonical_id").eqNullSafe(F.col("prediction"))).alias("right"))
    return evaluate.wilson(by, "right", "total").select("language", "total", "right", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def error_bounds(spark: SparkSession, folder: str) -> DataFrame:
    by = _predicted(spark, folder).groupBy("statement").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("canonical_id").eqNullSafe(F.col("prediction"))).alias("errors"))
    return by.withColumn("upper95", stats.error_upper95("errors", "total"))


def p90_strata(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.times(table(spark, folder, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "p90", "total", "most")])


def gate_cube(spark: SparkSession, folder: str) -> DataFrame:
    e = _examples(spark, folder).withColumnRenamed("source_id", "file_id")
    out = evaluate.gate_cube(e, ["language", "statement"], F.col("canonical_id").isNotNull())
    return out.withColumn("share", F.round("share", 9))


def bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    p = _predicted(spark, folder).where("language IS NOT NULL")
    marked = p.select("language", "source_id", F.col("canonical_id").eqNullSafe(F.col("prediction")).alias("after"), F.col("canonical_id").isNull().alias("before"))
    return evaluate.paired_bootstrap(marked, "language", "source_id", "before", "after")


def unmatched_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of two readings of a gold file aligned in order; here a reading beside itself without every third row."""
    rows = shred.rows(shred.shred_files(table(spark, folder, "gold_files")))
    lines = rows.select(F.concat_ws("/", "file_id", "statement_pos").alias("key"), F.col("row_pos").alias("ordinal"), F.col("row_pos").cast("string").alias("row"), F.lower("label").alias("label"), F.expr("CAST(map() AS MAP<STRING, DOUBLE>)").alias("figures"))
    return sums.align_rows(lines, lines.where("ordinal % 3 <> 2"))


# --- ranges and labels -------------------------------------------------------------------------------


def page_scores(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("n_chars IS NOT NULL")
    score = locate.page_score(F.col("n_chars") % 3 == 0, F.col("n_chars") % 4 == 0, (F.col("n_chars") % 40).cast("int"), F.col("n_chars") % 2, F.when(F.col("n_chars") % 11 == 0, 1).otherwise(0))
    return d.select("doc_id", F.round(score, 9).alias("score"))


def numeric_tokens(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.coalesce(locate.numeric_tokens(F.col("text")), F.lit(0)).alias("amounts"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("bigint").alias("page_no"), "value")
    pages = e.groupBy(F.col("user_id").alias("doc_id"), F.lit("any").alias("type"), "page_no").agg(F.max("value").alias("score"))
    return pages.withColumns({"candidate": F.col("score") >= 60, "continues": F.col("score") >= 20})


def find_ranges(spark: SparkSession, folder: str) -> DataFrame:
    out = locate.find_ranges(_pages(spark, folder))
    return out.select("doc_id", "first_page", "last_page", F.round("score", 6).alias("score"), "rank")


def merge_intervals(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000)).cast("bigint").alias("first"), F.floor("value").cast("bigint").alias("v"))
    return locate.merge_intervals(e.withColumn("last", F.col("first") + F.col("v") * 3).drop("v"), "user_id", "first", "last")


def conversion_plan(spark: SparkSession, folder: str) -> DataFrame:
    ranges = locate.find_ranges(_pages(spark, folder))
    start = _pages(spark, folder).agg(F.min("page_no").alias("lo"))
    shifted = ranges.crossJoin(F.broadcast(start)).withColumns({"first_page": F.col("first_page") - F.col("lo") + 1, "last_page": F.col("last_page") - F.col("lo") + 1})
    counts = _pages(spark, folder).select("doc_id").distinct().withColumn("pages", F.lit(700).cast("bigint"))
    return locate.plan_conversion(shifted, counts, ["any"], 2)


#: (group, place in the order of groups, phrase, weight)
WEIGHTS = (("bank", 0, "purchase", 2.5), ("bank", 0, "login", 1.0), ("insurer", 1, "click", 2.0), ("insurer", 1, "view", 0.5), ("other", 2, "logout", 3.0), ("other", 2, "signup", 3.0))


def industry_verdict(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    hits = e.select(F.col("user_id").alias("doc_id"), F.dayofmonth("ts").alias("page_no"), F.col("event_type").alias("phrase"))
    weights = spark.createDataFrame(list(WEIGHTS), "grp STRING, place INT, phrase STRING, weight DOUBLE")
    return locate.industry_verdict(hits, weights)


def _label_ids(spark: SparkSession, folder: str) -> DataFrame:
    form = labels.squash(labels.simple_label(F.col("label")))
    return _examples(spark, folder).where("label IS NOT NULL").select(F.col("example_id").alias("label_id"), F.col("statement").alias("type"), form.alias("squashed")).where("squashed <> ''")


def _alias_forms(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "taxonomy_aliases").join(table(spark, folder, "taxonomy_items").select("item_id", F.col("statement").alias("type")), "item_id")
    return a.select("item_id", "type", labels.squash(labels.simple_label(F.col("alias"))).alias("squashed"))


def label_match(spark: SparkSession, folder: str) -> DataFrame:
    out = mapping.match_labels(_label_ids(spark, folder), _alias_forms(spark, folder))
    return out.select("label_id", "item_id", F.size("candidates").alias("candidates"))


def prefix_match(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.prefix_matches(_label_ids(spark, folder), _alias_forms(spark, folder))


def longest_heading(spark: SparkSession, folder: str) -> DataFrame:
    l = _examples(spark, folder).where("label IS NOT NULL").select(F.col("example_id").alias("label_id"), F.lower("label").alias("label"))
    words = F.split(F.lower("alias"), " ")
    heads = table(spark, folder, "taxonomy_aliases").select(F.explode(F.array(F.array_join(F.slice(words, 1, 1), " "), F.array_join(F.slice(words, 1, 2), " "))).alias("heading")).where("length(heading) >= 3").distinct()
    return mapping.longest_heading(l, heads)


def carried_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with the kind of the last purchase or login above it."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("statement_id"), F.col("event_id").alias("ordinal"), F.col("event_type").isin("purchase", "login").alias("is_heading"), "event_type")
    return mapping.carried_forward(e, "event_type").select("ordinal", "event_type_carried")


def latest_tags(spark: SparkSession, folder: str) -> DataFrame:
    e = _examples(spark, folder).where("tag IS NOT NULL")
    v = e.select(F.substring_index("tag", ":", -1).alias("tag"), F.col("extracted_at").alias("version"), F.col("statement").alias("definition"))
    return mapping.latest_version(v).select("tag", "definition")


# --- documents and tables ----------------------------------------------------------------------------


def document_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of the texts of each source, by its letters."""
    d = table(spark, folder, "documents").where("source_id IS NOT NULL")
    count = lambda c: F.length(F.regexp_replace("text", f"[^{c}]", ""))
    return documents.document_language(d.select(F.col("source_id").alias("doc_id"), count("ء-ي").alias("arabic_chars"), count("A-Za-z").alias("latin_chars")))


def document_currency(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "statements").select("doc_id", "currency", "statement_id")
    return documents.most_common_first(s.withColumn("place", F.expr("CAST(substring(statement_id, 4) AS BIGINT)")), "doc_id", "currency", "place")


#: Currencies of domiciles.
DOMICILES = (("SA", "SAR"), ("AE", "AED"), ("EG", "EGP"), ("KW", "KWD"), ("MA", "MAD"), ("US", "USD"), ("FR", "EUR"))


def statement_currency(spark: SparkSession, folder: str) -> DataFrame:
    """Currency of each statement with where it comes from: column, caption, domicile."""
    s = table(spark, folder, "statements").select("statement_id", "doc_id", F.col("currency").alias("header_currency"), units.detect_currency(F.col("unit_text")).alias("caption_currency"))
    homes = spark.createDataFrame(list(DOMICILES), "country STRING, domicile_currency STRING")
    d = _sources(spark, folder).select(F.col("source_id").alias("doc_id"), "country").join(homes, "country", "left").withColumn("document_currency", F.lit(None).cast("string"))
    return documents.metadata(s, d).select("statement_id", "currency", "source", F.array_join("flags", ";").alias("flags"))


def alias_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Names and numbers of sources linked into groups, with the pool they share."""
    s = _sources(spark, folder)
    keys = s.select(F.concat(F.lit("name:"), F.nullif(labels.issuer_key(F.col("issuer")), F.lit(""))).alias("name_key"), labels.cik_key(F.nullif(F.regexp_extract("cik", "(\\d+)", 1), F.lit(""))).alias("cik_key"), "pool")
    return documents.alias_pools(keys)


def merged_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The one currency that all statements of a document give, null where they differ."""
    return documents.merge_evidence(table(spark, folder, "statements").where("currency IS NOT NULL"), ["doc_id", "type"], "currency")


def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    return documents.latest_unique(table(spark, folder, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


def table_types(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of each source as a table, scored for the two statement types."""
    l = _label_ids(spark, folder).join(_examples(spark, folder).select(F.col("example_id").alias("label_id"), F.col("source_id").alias("table_id")), "label_id").select("table_id", "squashed")
    titles = _sources(spark, folder).where("period = 'annual'").select(F.col("source_id").alias("table_id"), F.lit("income").alias("type"), F.lit("cue").alias("how"))
    return tables.table_scores(l, _alias_forms(spark, folder), titles)


# --- streams -----------------------------------------------------------------------------------------


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.tumbling(table(spark, folder, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def event_sliding(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.sliding(table(spark, folder, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 6).alias("total"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.sessions(table(spark, folder, "events"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def event_state(spark: SparkSession, folder: str) -> DataFrame:
    """A guarded state per user, fed by the kinds of event."""
    e = streams.sequence(table(spark, folder, "events"))
    status = F.create_map(*[F.lit(x) for x in ("signup", "queued", "login", "queued", "click", "running", "view", "running", "purchase", "completed", "logout", "failed")])[F.col("event_type")]
    return streams.job_states(e.select(F.col("user_id").alias("job_id"), F.col("seq").cast("bigint").alias("seq"), status.alias("status")).where("status IS NOT NULL"))


def event_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return streams.sequence(table(spark, folder, "events")).select("event_id", F.col("seq").cast("bigint").alias("seq"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    plain_numbers, parse_numbers, captions, period_headers, month_arithmetic, label_forms, issuer_keys, content_digests, garbled_texts, formatted_amounts, digit_places,
    hash_split, pool_assign, part_counts, moved_parts, impure_sources, dedupe_lowest, target_conflicts, issuer_cap, sampled_rows, route_counts, row_kinds, coverage_curve, consistency_removals, exclusions, contradictory_sources,
    multiset_match, multiset_diff, near_issuers, snapshot_changes, confusion, class_scores, macro_f1, score_strata, wilson, error_bounds, p90_strata, gate_cube, bootstrap, unmatched_rows,
    page_scores, numeric_tokens, find_ranges, merge_intervals, conversion_plan, industry_verdict, label_match, prefix_match, longest_heading, carried_forward, latest_tags,
    document_language, document_currency, statement_currency, alias_pools, merged_evidence, latest_events, table_types,
    event_windows, event_sliding, event_sessions, event_state, event_sequence,
)}

# --- the same in SQL -------------------------------------------------------------------------------

_EX = "WITH ex AS (SELECT DISTINCT ON (example_id) * FROM audit_examples ORDER BY example_id), so AS (SELECT DISTINCT ON (source_id) * FROM sources ORDER BY source_id)"
_SUFFIXES = "['" + "', '".join(labels.ISSUER_SUFFIXES) + "']"


def _key(c: str) -> str:
    return f"array_to_string(list_filter(regexp_extract_all(replace(lower({c}), '.', ''), '[a-z0-9]+'), lambda w: NOT list_contains({_SUFFIXES}, w)), ' ')"


def _bucket(x: str) -> str:
    return f"CAST(list_reduce(list_prepend(0, [strpos('0123456789abcdef', c) - 1 for c in string_split(sha256({x}), '')]), lambda a, c: (a * 16 + c) % 100) AS INTEGER)"


def _part(x: str) -> str:
    b = _bucket(f"'holdout:' || {x}")
    return f"CASE WHEN {b} < 15 THEN 'holdout' WHEN {b} < 30 THEN 'validation' ELSE 'fit' END"


_PARTED = _EX + f", pk AS (SELECT *, {_part('key')} AS part FROM (SELECT {_key('issuer')} AS key, language, period FROM so WHERE issuer IS NOT NULL))"
_RAW = "WITH raw AS (SELECT DISTINCT ON (input_id) input_id, raw_text, reported FROM (SELECT unnest(u, recursive := true) FROM (SELECT unnest(map_values(inputs)) AS u FROM (SELECT inputs FROM metric_values WHERE inputs IS NOT NULL)) WHERE len(u) > 0) WHERE raw_text IS NOT NULL)"
_GROUPED = _EX + ", gr AS (SELECT example_id, source_id, statement, lower(label) AS label, canonical_id FROM ex WHERE label IS NOT NULL)"
_TARGETS = _GROUPED + ", tc AS (SELECT statement, label, canonical_id, COUNT(*) AS n FROM gr GROUP BY 1, 2, 3)"
_REMOVED = _TARGETS + """, w AS (SELECT *, SUM(n) OVER k AS all_, SUM(CASE WHEN canonical_id IS NOT NULL THEN n END) OVER k AS mapped, MAX(CASE WHEN canonical_id IS NOT NULL THEN n END) OVER k AS top, COALESCE(MAX(CASE WHEN canonical_id IS NULL THEN n END) OVER k, 0) AS nul FROM tc WINDOW k AS (PARTITION BY statement, label)),
w2 AS (SELECT *, SUM(CASE WHEN canonical_id IS NOT NULL AND n = top THEN 1 ELSE 0 END) OVER (PARTITION BY statement, label) AS winners FROM w WHERE mapped IS NOT NULL),
rm AS (SELECT statement, label, canonical_id, n, CASE WHEN winners <> 1 OR top * 10 < mapped * 9 THEN 'ambiguous' WHEN nul * 2 >= all_ AND canonical_id IS NOT NULL THEN 'outlier' WHEN nul * 2 < all_ AND (canonical_id IS NULL OR n <> top) THEN 'outlier' END AS reason FROM w2)"""
_LINE = "(SELECT l_orderkey, l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem WHERE l_linenumber % 2 = {})"
_PRED = _EX + """, pr AS (SELECT e.example_id, e.source_id, e.language, e.statement, e.canonical_id, a.item_id AS prediction FROM ex e LEFT JOIN taxonomy_items t ON e.canonical_id = t.item_id LEFT JOIN taxonomy_aliases a ON lower(e.label) = lower(a.alias) WHERE e.canonical_id IS NULL OR t.item_id IS NOT NULL)"""
_SCORED = _PRED + """, cl AS (SELECT item_id AS class FROM taxonomy_items), su AS (SELECT canonical_id AS class, COUNT(*) AS support, SUM((canonical_id IS NOT DISTINCT FROM prediction)::INT) AS correct FROM pr GROUP BY 1), em AS (SELECT prediction AS class, COUNT(*) AS predicted FROM pr GROUP BY 1),
sc AS (SELECT cl.class, COALESCE(support, 0) AS support, COALESCE(predicted, 0) AS predicted, CAST(COALESCE(correct, 0) AS BIGINT) AS correct FROM cl LEFT JOIN su USING (class) LEFT JOIN em USING (class)),
sf AS (SELECT *, COALESCE(correct / NULLIF(CAST(predicted AS DOUBLE), 0), 0) AS "precision", COALESCE(correct / NULLIF(CAST(support AS DOUBLE), 0), 0) AS recall, COALESCE(2.0 * correct / NULLIF(support + predicted, 0), 0) AS f1 FROM sc)"""
_PAGES = "WITH pg AS (SELECT user_id AS doc_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS page_no, MAX(value) AS score FROM events GROUP BY 1, 2)"
_RANGES = _PAGES + """, ab AS (SELECT *, score >= 60 AS cand, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS isl FROM pg WHERE score >= 20),
kp AS (SELECT * FROM (SELECT *, MIN(CASE WHEN cand THEN page_no END) OVER (PARTITION BY doc_id, isl) AS starts FROM ab) WHERE page_no >= starts),
rg AS (SELECT doc_id, MIN(page_no) AS first_page, MAX(page_no) AS last_page, MAX(score) AS score FROM kp GROUP BY doc_id, isl)"""


def _merged(source: str, key: str, first: str, last: str) -> str:
    return f"SELECT {key}, MIN({first}) AS {first}, MAX({last}) AS {last} FROM (SELECT *, SUM(fresh) OVER (PARTITION BY {key} ORDER BY {first}, {last} ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN reach IS NULL OR {first} > reach + 1 THEN 1 ELSE 0 END AS fresh FROM (SELECT *, MAX({last}) OVER (PARTITION BY {key} ORDER BY {first}, {last} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}))) GROUP BY {key}, g"


def _contains(c: str, words: tuple[str, ...]) -> str:
    return " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words)


_SCALE = "CASE " + " ".join(f"WHEN {_contains('lower(unit_text)', cues)} THEN {scale}" for scale, cues in units.SCALE_CUES.items()) + " END"
_RANKED = sorted(((w, iso) for iso, ws in units.CURRENCY_WORDS.items() for w in ws), key=lambda x: -len(x[0]))
_CURRENCY = ("COALESCE(NULLIF(regexp_extract(upper(unit_text), '(^|[^A-Z])(" + "|".join(units.ISO_CODES) + ")($|[^A-Z])', 2), ''), CASE "
             + " ".join(("WHEN regexp_matches(lower(unit_text), '(^|[^\\p{{L}}\\p{{N}}_]){}($|[^\\p{{L}}\\p{{N}}_])') THEN '{}'".format(w.replace(".", "\\."), iso) if w.isascii() else f"WHEN contains(lower(unit_text), '{w}') THEN '{iso}'") for w, iso in _RANKED)
             + " " + " ".join(f"WHEN regexp_matches(unit_text, '(^|[^A-Za-z]){a}($|[^A-Za-z])') THEN '{iso}'" for a, iso in units.ABBREVIATIONS.items()) + " " + " ".join(f"WHEN contains(unit_text, '{s}') THEN '{iso}'" for s, iso in units.SIGNS.items()) + " END)")
_FROM, _TO = labels.ARABIC_FROM + labels.ARABIC_MARKS + numbers.BIDI, labels.ARABIC_TO


def _simple(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({c}), '{_FROM}', '{_TO}'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_BEFORE = "CASE WHEN d = last_day(d) THEN last_day(CAST(d - to_months(n) AS DATE)) ELSE CAST(d - to_months(n) AS DATE) END"
_Z = stats.Z95

_SQL_NUMBERS = _RAW + rf""", a AS (SELECT input_id, translate(raw_text, '{numbers.BIDI}', '') AS h FROM raw),
b AS (SELECT input_id, translate(h, '{numbers.SUPERSCRIPTS}', '') <> h AS sup, trim(translate(translate(h, '{numbers.SUPERSCRIPTS}', ''), '{numbers.SPACES}', '     ')) AS w FROM a),
c AS (SELECT *, lower(w) AS lw, translate(w, '{numbers.EASTERN_DIGITS}', '{numbers.WESTERN_DIGITS}') <> w AS east, translate(w, '{numbers.EASTERN_DIGITS}{numbers.DASHES}٪٬٫', '{numbers.WESTERN_DIGITS}--------%,.') AS m FROM b),
d AS (SELECT *, contains(m, '%') AS pct, trim(replace(m, '%', ' ')) AS t FROM c),
e AS (SELECT *, regexp_matches(t, '(\([A-Za-zء-ي]{{1,3}}\)|\*+)$') AS note, trim(regexp_replace(t, '\s*(\([A-Za-zء-ي]{{1,3}}\)|\*+)$', '')) AS u FROM d),
f AS (SELECT *, regexp_full_match(u, '\([^()]*[0-9][^()]*\)') AS br FROM e),
g AS (SELECT *, CASE WHEN br THEN trim(substring(u, 2, length(u) - 2)) ELSE u END AS i FROM f),
k AS (SELECT *, regexp_matches(i, '^[-+]') AS led, starts_with(i, '-') AS minus, length(i) > 1 AND ends_with(i, '-') AS trail, replace(regexp_replace(i, '^[-+]|-$', '', 'g'), ' ', '') AS p FROM g),
l AS (SELECT *, CASE WHEN led AND trail THEN NULL WHEN regexp_full_match(p, '[0-9]+') THEN 'whole' WHEN regexp_full_match(p, '[0-9]*(,[0-9]{{3}})+') THEN 'grouped' WHEN regexp_full_match(p, '[0-9]*,[0-9]+') THEN 'comma_decimal' WHEN regexp_full_match(p, '[0-9]{{0,3}}\.[0-9]{{3}}') THEN 'ambiguous_separator' WHEN regexp_full_match(p, '[0-9]*\.[0-9]+') THEN 'decimal' WHEN regexp_full_match(p, '[0-9,]*,[0-9,]*\.[0-9]+') THEN 'english' WHEN regexp_full_match(p, '[0-9.]*\.[0-9.]*,[0-9]+') THEN 'european_separators' END AS how FROM k),
n AS (SELECT *, CASE WHEN how = 'european_separators' THEN replace(replace(p, '.', ''), ',', '.') WHEN how = 'comma_decimal' THEN replace(p, ',', '.') ELSE replace(p, ',', '') END AS q,
  CASE WHEN w = '' THEN 'empty' WHEN lw IN ('n/a', 'na', 'n.a.', 'غير متاح', 'لا ينطبق') THEN 'not_available' WHEN lw IN ('nil', 'none', 'صفر', 'لا شيء') THEN 'word_as_zero' WHEN translate(w, '{numbers.DASHES} ', '') = '' THEN 'dash_as_zero' END AS word FROM l)
SELECT input_id, CASE WHEN word IN ('word_as_zero', 'dash_as_zero') THEN 0 WHEN word IS NULL AND how IS NOT NULL THEN (CASE WHEN br <> (minus OR trail) THEN -1 ELSE 1 END) * CAST(CAST(CAST(q AS DECIMAL(38,8)) / (CASE WHEN pct THEN 100 ELSE 1 END) AS DECIMAL(38,6)) AS DOUBLE) END AS value,
  CASE WHEN word IS NULL AND how IS NOT NULL AND pct THEN 'ratio' ELSE 'number' END AS unit,
  concat_ws(';', CASE WHEN sup THEN 'footnote_marker' END, word, CASE WHEN word IS NULL THEN NULLIF(concat_ws(';', CASE WHEN east THEN 'arabic_indic_digits' END, CASE WHEN pct THEN 'percent' END,
    CASE WHEN how IS NULL AND NOT regexp_full_match(i, '[-+]?[^-+()]*[0-9][^-+()]*-?') THEN 'unparsed' ELSE NULLIF(concat_ws(';', CASE WHEN note THEN 'footnote_marker' END, CASE WHEN br THEN 'parentheses_negative' END, CASE WHEN trail THEN 'trailing_sign' END, CASE WHEN how IN ('comma_decimal', 'ambiguous_separator', 'european_separators') THEN how END, CASE WHEN how IS NULL THEN 'unparsed' END), '') END), '') END) AS flags FROM n"""

ORACLES: dict[str, str] = {
    "plain_numbers": _RAW + r""", t AS (SELECT input_id, raw_text AS r, trim(raw_text) AS t0 FROM raw), u AS (SELECT *, trim(replace(t0, '%', '')) AS a, contains(t0, '%') AS pct FROM t), v AS (SELECT *, regexp_matches(a, '^\(.*\d.*\)$') AS br, CASE WHEN regexp_matches(a, '^\(.*\d.*\)$') THEN trim(regexp_replace(a, '^\(|\)$', '', 'g')) ELSE a END AS i FROM u),
w AS (SELECT *, starts_with(i, '-') AS ld, ends_with(i, '-') AS tr, trim(regexp_replace(i, '^[-+]|-$', '', 'g')) AS dg FROM v)
SELECT input_id, CAST(CASE WHEN regexp_matches(r, '^[\x20-\x7e]*$') AND regexp_matches(dg, '^\d+(,\d{3})*(\.\d+)?$') AND NOT (ld AND tr) THEN (CASE WHEN br <> (ld OR tr) THEN -1 ELSE 1 END) * CAST(replace(dg, ',', '') AS DECIMAL(38,6)) / (CASE WHEN pct THEN 100 ELSE 1 END) END AS DOUBLE) AS value FROM w""",
    "parse_numbers": _SQL_NUMBERS,
    "captions": f"SELECT statement_id, CAST({_SCALE} AS BIGINT) AS scale, {_CURRENCY} AS currency FROM statements WHERE unit_text IS NOT NULL",
    "period_headers": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS m FROM orders), e AS (SELECT *, CASE WHEN m = 3 THEN make_date(year(d), 12, 31) ELSE d END AS x FROM o)
SELECT o_orderkey, CASE WHEN m = 0 OR m = 3 THEN strftime(x, '%Y-%m-%d') WHEN m = 1 THEN '6M-' || strftime(x, '%Y-%m-%d') ELSE 'FY' || year(x) END AS period_key, strftime(x, '%Y-%m-%d') AS end_date, CASE WHEN m IN (1, 2) THEN 'duration' ELSE 'instant' END AS kind, CASE WHEN m = 1 THEN 6 WHEN m = 2 THEN 12 END AS months, m = 3 AS restated, CASE WHEN m = 2 THEN FALSE END AS audited FROM e""",
    "month_arithmetic": f"SELECT o_orderkey, strftime({_BEFORE}, '%Y-%m-%d') AS before, CASE WHEN n = 0 THEN strftime(d, '%Y-%m-%d') WHEN n = 12 THEN 'FY' || year(d) ELSE n || 'M-' || strftime(d, '%Y-%m-%d') END AS period_key FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 13 AS INTEGER) AS n FROM orders)",
    "label_forms": f"WITH f AS (SELECT alias_id, alias, {_simple('alias')} AS form FROM taxonomy_aliases) SELECT alias_id, form, replace(form, ' ', '') AS squashed, regexp_replace(lower(alias), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g') AS key, regexp_matches(' ' || form || ' ', ' (total|اجمالي|مجموع) ') AS is_total, regexp_matches(lower(alias), '\\b(eps|dps)\\b|\\bper ([a-z0-9_]+ )?share\\b') OR ({_contains(chr(114)+'eplace(alias, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + chr(39) + ')', labels.PER_SHARE_CUES)}) AS per_share FROM f",
    "issuer_keys": _EX + f" SELECT source_id, {_key('issuer')} AS issuer_key, 'cik:' || TRY_CAST(regexp_extract(cik, '(\\d+)', 1) AS BIGINT) AS cik_key FROM so",
    "content_digests": "SELECT alias_id, sha256('{\"item_id\":\"' || item_id || '\",\"lang\":\"' || lang || '\"}') AS digest FROM taxonomy_aliases",
    "digit_places": "WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS a, CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 3 * 100 AS b FROM orders) SELECT o_orderkey, CASE WHEN b - a <> 0 THEN 2 END AS place, a <> b AND length(CAST(a AS VARCHAR)) = length(CAST(b AS VARCHAR)) AND len(list_filter(list_zip(string_split(CAST(a AS VARCHAR), ''), string_split(CAST(b AS VARCHAR), '')), lambda p: p[1] <> p[2])) = 1 AS apart FROM o",
    "hash_split": _EX + f" SELECT key, {_bucket(chr(39) + 'holdout:' + chr(39) + ' || key')} AS bucket, {_part('key')} AS part FROM (SELECT DISTINCT {_key('issuer')} AS key FROM so WHERE issuer IS NOT NULL)",
    "pool_assign": f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN {_bucket(chr(39) + 'cik:' + chr(39) + ' || c_custkey')} < 15 THEN 'model_test' ELSE 'train' END ELSE CASE WHEN {_bucket('lower(c_name)')} < 65 THEN 'train' WHEN {_bucket('lower(c_name)')} < 85 THEN 'model_test' ELSE 'blind' END END AS pool FROM customer",
    "part_counts": _PARTED + ", ik AS (SELECT part, key, COUNT(*) AS n, bool_or(language = 'en') AS en, bool_or(language = 'ar') AS ar, SUM((period = 'annual')::INT) AS annual, SUM((period = 'interim')::INT) AS interim FROM pk GROUP BY 1, 2) SELECT part, COUNT(*) AS issuers, CAST(SUM(n) AS BIGINT) AS documents, COUNT(*) FILTER (en) AS english, COUNT(*) FILTER (ar) AS arabic, COUNT(*) FILTER (en AND ar) AS both, CAST(SUM(annual) AS BIGINT) AS annual, CAST(SUM(interim) AS BIGINT) AS interim FROM ik GROUP BY 1",
    "moved_parts": _PARTED + " SELECT CASE WHEN part = 'holdout' AND key LIKE 'b%' THEN 'validation' ELSE part END AS part, COUNT(*) AS n FROM (SELECT DISTINCT key, part FROM pk) GROUP BY 1",
    "impure_sources": _EX + f" SELECT key, string_agg(pool, ',' ORDER BY pool) AS parts FROM (SELECT DISTINCT {_key('issuer')} AS key, pool FROM so WHERE issuer IS NOT NULL AND pool IS NOT NULL) GROUP BY 1 HAVING COUNT(*) > 1",
    "dedupe_lowest": _GROUPED + " SELECT source_id, statement, label, MIN(example_id) AS example_id, MIN(canonical_id) AS canonical_id FROM gr GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT COALESCE('=' || canonical_id, '∅')) = 1",
    "target_conflicts": _GROUPED + " SELECT source_id, label, COUNT(*) AS rows, COUNT(DISTINCT COALESCE('=' || canonical_id, '∅')) AS targets FROM gr GROUP BY 1, 2 HAVING COUNT(DISTINCT COALESCE('=' || canonical_id, '∅')) > 1",
    "issuer_cap": _EX + " SELECT example_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY example_id) AS k FROM ex) WHERE k <= 40",
    "sampled_rows": _EX + " SELECT example_id, statement FROM ex ORDER BY sha256('seed-7:' || example_id), example_id LIMIT 500",
    "route_counts": _EX + " SELECT CASE WHEN issuer IS NULL THEN 'missing_issuer' WHEN NOT verified THEN 'unverified' WHEN cik IS NULL THEN 'missing_cik' WHEN pool = 'test' THEN 'pool_test' WHEN period = 'interim' THEN 'interim' END AS drop_reason, COUNT(*) AS n FROM so GROUP BY 1",
    "row_kinds": _EX + " SELECT kind, statement, COUNT(*) AS n FROM (SELECT ex.statement AS statement, CASE WHEN ex.statement NOT IN ('income', 'balance') THEN 'unsupported_statement_code' WHEN label IS NULL OR trim(label) = '' THEN 'empty_label' WHEN tag IS NULL OR starts_with(tag, 'custom:') THEN 'custom_extension' WHEN string_split(tag, ':')[1] NOT IN ('us-gaap', 'ifrs-full') THEN 'unsupported_namespace' WHEN canonical_id IS NULL THEN 'null_entry' WHEN item_id IS NULL THEN 'outside_crosswalk' ELSE 'mapped' END AS kind FROM ex LEFT JOIN taxonomy_items ON item_id = canonical_id) GROUP BY ROLLUP (kind, statement)",
    "coverage_curve": _EX + ", k AS (SELECT lower(label) AS key, COUNT(*) AS n FROM ex WHERE label IS NOT NULL GROUP BY 1), c AS (SELECT n, row_number() OVER (ORDER BY n DESC, key) AS r, SUM(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) AS run, SUM(n) OVER () AS total FROM k) SELECT CAST(p AS INTEGER) AS percent, COALESCE((SELECT MIN(r) FROM c WHERE run * 100 >= p * total), 0) AS needed FROM (SELECT unnest([10, 25, 50, 75, 90, 95, 99, 100]) AS p)",
    "consistency_removals": _REMOVED + " SELECT * FROM rm WHERE reason IS NOT NULL",
    "exclusions": _REMOVED + " SELECT g.statement, COUNT(*) AS n FROM gr g WHERE NOT EXISTS (SELECT 1 FROM rm WHERE reason IS NOT NULL AND rm.statement = g.statement AND rm.label = g.label AND rm.canonical_id IS NOT DISTINCT FROM g.canonical_id) GROUP BY 1",
    "contradictory_sources": _GROUPED + " SELECT source_id FROM gr GROUP BY 1 HAVING bool_or(canonical_id = 'tbd') AND bool_or(canonical_id = 'other')",
    "multiset_match": f"SELECT a.l_orderkey, b.l_orderkey AS other_key FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, quantity ORDER BY l_orderkey) AS k FROM {_LINE.format(1)}) a JOIN (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, quantity ORDER BY l_orderkey) AS k FROM {_LINE.format(0)}) b USING (l_returnflag, l_linestatus, quantity, k)",
    "multiset_diff": f"SELECT l_returnflag, l_linestatus, quantity, CAST(greatest(d, 0) AS BIGINT) AS missing, CAST(greatest(-d, 0) AS BIGINT) AS extra FROM (SELECT l_returnflag, l_linestatus, quantity, SUM(s) AS d FROM (SELECT *, 1 AS s FROM {_LINE.format(1)} UNION ALL SELECT *, -1 AS s FROM {_LINE.format(0)}) GROUP BY 1, 2, 3) WHERE d <> 0",
    "near_issuers": _EX + f", k AS (SELECT DISTINCT {_key('issuer')} AS k, pool FROM so WHERE issuer IS NOT NULL), q AS (SELECT DISTINCT k AS query, list_distinct(string_split(k, ' ')) AS a FROM k WHERE pool IN ('validation', 'test') AND k <> ''), m AS (SELECT DISTINCT k AS name, list_distinct(string_split(k, ' ')) AS b FROM k WHERE pool = 'train' AND k <> ''), s AS (SELECT query, name, len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) AS sim FROM q, m WHERE len(list_intersect(a, b)) > 0) SELECT query, name, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, name) AS rank FROM s WHERE sim >= 0.6) WHERE rank <= 3",
    "snapshot_changes": "WITH a AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_custkey, o_orderpriority) WHERE a.n IS DISTINCT FROM b.n",
    "confusion": _PRED + " SELECT canonical_id, prediction, COUNT(*) AS n FROM pr GROUP BY 1, 2",
    "class_scores": _SCORED + ' SELECT class, support, predicted, correct, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sf',
    "macro_f1": _SCORED + " SELECT COUNT(*) AS classes, COUNT(*) FILTER (support > 0) AS supported, round(AVG(f1), 9) AS macro_f1 FROM sf",
    "score_strata": _PRED + " SELECT language, statement, COUNT(*) AS rows, COUNT(*) FILTER (canonical_id IS NOT DISTINCT FROM prediction) AS correct, COUNT(*) FILTER (canonical_id IS NULL) AS abstain_support, COUNT(*) FILTER (canonical_id IS NULL AND prediction IS NULL) AS correct_abstentions, COUNT(*) FILTER (canonical_id IS NULL AND prediction IS NOT NULL) AS false_mappings FROM pr GROUP BY ROLLUP (language, statement)",
    "wilson": _PRED + f""", b AS (SELECT language, COUNT(*) AS total, COUNT(*) FILTER (canonical_id IS NOT DISTINCT FROM prediction) AS "right" FROM pr GROUP BY 1), c AS (SELECT *, "right" / CAST(total AS DOUBLE) AS p FROM b), d AS (SELECT *, (p + {_Z * _Z} / (2 * total)) / (1 + {_Z * _Z} / total) AS m, {_Z} * sqrt(p * (1 - p) / total + {_Z * _Z} / (4.0 * total * total)) / (1 + {_Z * _Z} / total) AS h FROM c) SELECT language, total, "right", round(greatest(0, m - h), 9) AS low, round(least(1, m + h), 9) AS high FROM d""",
    "p90_strata": "SELECT event_type, COUNT(value) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.9), 6) AS p90, round(SUM(value), 6) AS total, round(MAX(value), 6) AS most FROM events GROUP BY GROUPING SETS ((event_type), ())",
    "gate_cube": _EX + " SELECT language, statement, COUNT(*) AS cells, COUNT(canonical_id) AS \"right\", COUNT(DISTINCT source_id) AS files, round(COUNT(canonical_id) / CAST(COUNT(*) AS DOUBLE), 9) AS share FROM ex GROUP BY CUBE (language, statement)",
    "page_scores": "SELECT doc_id, round(2.0 * least((n_chars % 40) / 30.0, 1.0) + n_chars % 2 - CASE WHEN n_chars % 11 = 0 THEN 4.0 ELSE 0 END + CASE WHEN n_chars % 3 = 0 THEN 3.0 ELSE 0 END + CASE WHEN n_chars % 4 = 0 THEN 1.5 ELSE 0 END, 9) AS score FROM documents WHERE n_chars IS NOT NULL",
    "numeric_tokens": "SELECT doc_id, CAST(COALESCE(len(list_filter(regexp_extract_all(translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '(?:^|[^.0-9])([0-9]{1,3}(?:[,\u066c. \u00a0\u202f\u2009][0-9]{3})+|[0-9]{3,})', 1), lambda t: NOT regexp_matches(t, '^((19|20)[0-9]{2}){1,2}$') AND NOT regexp_matches(t, '^0[^0-9]'))), 0) AS INTEGER) AS amounts FROM documents",
    "find_ranges": _RANGES + " SELECT doc_id, first_page, last_page, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first_page) AS INTEGER) AS rank FROM rg",
    "merge_intervals": "WITH sp AS (SELECT user_id, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS first, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) + CAST(floor(value) AS BIGINT) * 3 AS last FROM events) " + _merged("sp", "user_id", "first", "last"),
    "conversion_plan": _RANGES + ", lo AS (SELECT MIN(page_no) AS lo FROM pg), sp AS (SELECT doc_id, greatest(first_page - lo + 1 - 2, 1) AS first_page, least(last_page - lo + 1 + 2, 700) AS last_page FROM rg, lo) " + _merged("sp", "doc_id", "first_page", "last_page"),
    "industry_verdict": "WITH wt(grp, place, phrase, weight) AS (VALUES " + ", ".join(f"('{g}', {p}, '{x}', CAST({w} AS DOUBLE))" for g, p, x, w in WEIGHTS) + "), h AS (SELECT DISTINCT user_id AS doc_id, day(ts) AS page_no, event_type AS phrase FROM events), t AS (SELECT doc_id, grp, place, SUM(weight) AS score, COUNT(DISTINCT phrase) AS cues FROM h JOIN wt USING (phrase) GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM t) SELECT doc_id, grp, score, cues, CASE WHEN score < 6 THEN CASE WHEN score >= 4 THEN 'near_threshold' ELSE 'corporate' END WHEN score >= 8 AND cues >= 3 THEN 'verdict' ELSE 'weak_verdict' END AS outcome FROM b WHERE k = 1",
    "label_match": _EX + f", l AS (SELECT example_id AS label_id, statement AS type, replace({_simple('label')}, ' ', '') AS s FROM ex WHERE label IS NOT NULL), a AS (SELECT DISTINCT item_id, statement AS type, replace({_simple('alias')}, ' ', '') AS s FROM taxonomy_aliases JOIN taxonomy_items USING (item_id)) SELECT label_id, CASE WHEN COUNT(item_id) = 1 THEN MIN(item_id) END AS item_id, CAST(COUNT(item_id) AS INTEGER) AS candidates FROM l LEFT JOIN a USING (type, s) WHERE s <> '' GROUP BY label_id",
    "prefix_match": _EX + f", l AS (SELECT example_id AS label_id, statement AS type, replace({_simple('label')}, ' ', '') AS s FROM ex WHERE label IS NOT NULL), a AS (SELECT DISTINCT item_id, statement AS type, replace({_simple('alias')}, ' ', '') AS t FROM taxonomy_aliases JOIN taxonomy_items USING (item_id)) SELECT DISTINCT label_id, item_id FROM l JOIN a USING (type) WHERE length(s) >= 4 AND length(t) >= 4 AND (starts_with(s, t) OR starts_with(t, s))",
    "longest_heading": _EX + ", h AS (SELECT DISTINCT heading FROM (SELECT unnest([string_split(lower(alias), ' ')[1], array_to_string(string_split(lower(alias), ' ')[1:2], ' ')]) AS heading FROM taxonomy_aliases) WHERE length(heading) >= 3), m AS (SELECT example_id AS label_id, lower(label) AS label, heading, row_number() OVER (PARTITION BY example_id ORDER BY length(heading) DESC, heading DESC) AS k FROM ex JOIN h ON starts_with(lower(label), heading || ' ')) SELECT label_id, heading, substring(label, length(heading) + 2) AS rest FROM m WHERE k = 1",
    "carried_forward": "SELECT event_id AS ordinal, last_value(CASE WHEN event_type IN ('purchase', 'login') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS event_type_carried FROM events",
    "latest_tags": _EX + " SELECT string_split(tag, ':')[-1] AS tag, arg_max(statement, extracted_at) AS definition FROM ex WHERE tag IS NOT NULL GROUP BY 1",
    "document_language": "SELECT source_id AS doc_id, CASE WHEN COALESCE(SUM(a), 0) + COALESCE(SUM(l), 0) = 0 THEN NULL WHEN SUM(a) > SUM(l) THEN 'ar' ELSE 'en' END AS language FROM (SELECT source_id, length(regexp_replace(text, '[^ء-ي]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents WHERE source_id IS NOT NULL) GROUP BY 1",
    "document_currency": "SELECT doc_id, currency, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM (SELECT doc_id, currency, COUNT(*) AS n, MIN(CAST(substring(statement_id, 4) AS BIGINT)) AS f FROM statements WHERE currency IS NOT NULL GROUP BY 1, 2)) WHERE k = 1",
    "statement_currency": _EX + f", dm(country, dc) AS (VALUES {', '.join(str(d) for d in DOMICILES)}), s AS (SELECT statement_id, currency AS h, CASE WHEN unit_text IS NOT NULL THEN {_CURRENCY} END AS c, dc AS d FROM statements LEFT JOIN so ON source_id = doc_id LEFT JOIN dm USING (country)) SELECT statement_id, COALESCE(h, c, d, 'XXX') AS currency, CASE WHEN h IS NOT NULL THEN 'header' WHEN c IS NOT NULL THEN 'caption' WHEN d IS NOT NULL THEN 'domicile' END AS source, concat_ws(';', CASE WHEN h <> c THEN 'currency_conflict' END, CASE WHEN h IS NULL AND c IS NULL AND d IS NOT NULL THEN 'currency_from_domicile' END, CASE WHEN COALESCE(h, c, d) IS NULL THEN 'currency_missing' END) AS flags FROM s",
    "alias_pools": _EX.replace("WITH", "WITH RECURSIVE") + f""", k AS (SELECT 'name:' || NULLIF({_key('issuer')}, '') AS n, 'cik:' || TRY_CAST(NULLIF(regexp_extract(cik, '(\\d+)', 1), '') AS BIGINT) AS c, pool FROM so),
e AS (SELECT n AS u, c AS v FROM k WHERE n IS NOT NULL AND c IS NOT NULL UNION SELECT c, n FROM k WHERE n IS NOT NULL AND c IS NOT NULL), ky AS (SELECT n AS key FROM k WHERE n IS NOT NULL UNION SELECT c FROM k WHERE c IS NOT NULL),
r(key, reach) AS (SELECT key, key FROM ky UNION SELECT r.key, e.v FROM r JOIN e ON e.u = r.reach), g AS (SELECT key, MIN(reach) AS "group" FROM r GROUP BY 1),
p AS (SELECT "group", MIN(pool) AS a, MAX(pool) AS b, COUNT(DISTINCT c) AS m FROM k JOIN g ON g.key = COALESCE(n, c) GROUP BY 1) SELECT key, "group", CASE WHEN a = b AND m <= 1 THEN a END AS pool, COALESCE(a <> b, FALSE) OR m > 1 AS conflict FROM g JOIN p USING ("group")""",
    "merged_evidence": "SELECT doc_id, type, CASE WHEN COUNT(DISTINCT currency) = 1 THEN MIN(currency) END AS currency, COUNT(*) AS observations, COUNT(DISTINCT currency) > 1 AS conflict FROM statements WHERE currency IS NOT NULL GROUP BY 1, 2",
    "latest_events": "SELECT user_id, event_type, MIN(event_id) AS event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY 1, 2 HAVING COUNT(*) = 1",
    "table_types": _EX + f", l AS (SELECT DISTINCT source_id AS table_id, replace({_simple('label')}, ' ', '') AS s FROM ex WHERE label IS NOT NULL), a AS (SELECT DISTINCT statement AS type, replace({_simple('alias')}, ' ', '') AS s FROM taxonomy_aliases JOIN taxonomy_items USING (item_id)), h AS (SELECT table_id, type, COUNT(*) AS hits FROM l JOIN a USING (s) GROUP BY 1, 2), e AS (SELECT * FROM (SELECT DISTINCT table_id FROM l WHERE s <> ''), (SELECT DISTINCT type FROM a)), c AS (SELECT table_id, type, COALESCE(hits, 0) AS hits, CASE WHEN type = 'income' AND period = 'annual' THEN 0.15 ELSE 0 END AS b FROM e LEFT JOIN h USING (table_id, type) LEFT JOIN so ON source_id = table_id), d AS (SELECT *, round(CAST(0.6 * least(hits, 6) / 6 + 0.1 + b AS DOUBLE), 3) AS score FROM c), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY score DESC, b DESC, type) AS INTEGER) AS place FROM d) SELECT table_id, type, hits, score, place, place = 1 AND score >= 0.5 AS settled FROM k",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, COUNT(*) AS n, round(SUM(value), 6) AS total FROM events GROUP BY 1, 2",
    "event_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, COUNT(*) AS n, round(SUM(value), 6) AS total FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, value FROM events) GROUP BY 1",
    "event_sessions": "SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start, COUNT(*) AS n FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g",
    "event_state": """WITH q AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'login' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'logout' THEN 'failed' END AS status FROM events),
e AS (SELECT * FROM q WHERE status IS NOT NULL), a AS (SELECT job_id, MIN(CASE WHEN status = 'queued' THEN seq END) AS a FROM e GROUP BY 1), b AS (SELECT e.job_id, MIN(seq) AS b FROM e JOIN a ON a.job_id = e.job_id AND seq > a WHERE status = 'running' GROUP BY 1), c AS (SELECT e.job_id, MIN(seq) AS c, arg_min(status, seq) AS s FROM e JOIN b ON b.job_id = e.job_id AND seq > b WHERE status IN ('completed', 'failed') GROUP BY 1)
SELECT job_id, CASE WHEN c IS NOT NULL THEN s WHEN b IS NOT NULL THEN 'running' WHEN a IS NOT NULL THEN 'queued' END AS status, COALESCE(c, b, a, 0) AS seq FROM a LEFT JOIN b USING (job_id) LEFT JOIN c USING (job_id)""",
    "garbled_texts": "SELECT source, COUNT(*) AS n, COUNT(*) FILTER (length(regexp_replace(text, '[\\s\\x{0085}\\p{Z}]', '', 'g')) >= 100 AND length(regexp_replace(text, '[^\\p{L}\\p{N}\\p{P}\\p{Sc}\\p{Sm}]', '', 'g')) < 0.9 * length(regexp_replace(text, '[\\s\\x{0085}\\p{Z}]', '', 'g'))) AS garbled FROM documents GROUP BY 1",
    "formatted_amounts": "SELECT c_custkey, CASE WHEN r < 0 THEN '(' || format('{:,}', -r) || ')' ELSE format('{:,}', r) END AS amount FROM (SELECT c_custkey, CAST(round_even(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS BIGINT) AS r FROM customer)",
    "event_sequence": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
}
