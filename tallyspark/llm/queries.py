"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import canonical, lookalike, mixing, overlap, splits, subjects, tokens
from tallyspark.llm.textnorm import look
from tallyspark.operators import shred
from tallyspark.plans.pipeline import _P4
from tallyspark.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(first_source_id, source_id): sources of one issuer, each with the smallest of its group."""
    return splits.grouped_pairs(splits.issuer_groups(table(spark, folder, "sources")))


def _record_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, records): distinct examples, gold files and documents of each source."""
    examples = table(spark, folder, "audit_examples").select("source_id", "example_id").distinct().groupBy("source_id").count()
    files = shred.shred_files(table(spark, folder, "gold_files"), ("status",)).groupBy(F.col("file_id").alias("source_id")).count()
    texts = table(spark, folder, "documents").select("source_id", "doc_id").distinct().groupBy("source_id").count()
    return examples.unionByName(files).unionByName(texts).where("source_id IS NOT NULL").groupBy("source_id").agg(F.sum("count").cast("double").alias("records"))


def p1_split(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, component, pool): the pool of each source, whole issuers together."""
    groups = splits.issuer_groups(table(spark, folder, "sources"))
    return splits.assign_pools(groups, _record_counts(spark, folder), table(spark, folder, "split_targets"))


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(pool, share, actual_share, sources, records): wanted and reached shares."""
    counts = _record_counts(spark, folder)
    pools = splits.assign_pools(splits.issuer_groups(table(spark, folder, "sources")), counts, table(spark, folder, "split_targets"))
    reached = pools.join(counts, "source_id", "left").groupBy("pool").agg(F.count(F.lit(1)).alias("sources"), F.sum(F.coalesce("records", F.lit(0.0))).alias("records"))
    whole = reached.agg(F.sum("records").alias("whole"))
    out = table(spark, folder, "split_targets").select("pool", "share").join(reached, "pool", "full").crossJoin(F.broadcast(whole))
    return out.select("pool", "share", F.try_divide("records", "whole").alias("actual_share"), "sources", "records")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, label, canonical_id) of all audit examples and gold rows; repeated rows may repeat."""
    examples = table(spark, folder, "audit_examples").select(F.col("example_id").alias("record_id"), "label", "canonical_id")
    rows = "statements.item.rows.item."
    lines = shred.rows(shred.shred_files(table(spark, folder, "gold_files"), (f"{rows}label", f"{rows}canonical_id", f"{rows}extra")))
    gold = lines.select(F.concat_ws("/", "file_id", F.col("statement_pos").cast("string"), F.col("row_pos").cast("string")).alias("record_id"), "label", "canonical_id")
    return spread(examples).unionByName(gold)


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_values(_labels(spark, folder), table(spark, folder, "taxonomy_items"), table(spark, folder, "taxonomy_aliases"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, item_id): records without a listed id whose label names an item."""
    return canonical.found_items(_mapped(spark, folder), table(spark, folder, "taxonomy_items"))


def p2_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, label, canonical_id, item_id, how, score, typed_item): every record with its item, or none."""
    return _mapped(spark, folder).dropDuplicates(["record_id"])


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """(label, canonical_id, records): values that name no item of the list."""
    return canonical.unmatched(_mapped(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, alias_id): labels that look the same as a caption but differ from it in characters."""
    return lookalike.disguised(lookalike.canonical_form(_labels(spark, folder), table(spark, folder, "taxonomy_aliases")))


def p6_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, label, form, alias_id, cost): the one form of every label."""
    return lookalike.canonical_form(_labels(spark, folder), table(spark, folder, "taxonomy_aliases")).dropDuplicates(["record_id"])


#: Labels of more characters than this are compared across pools.
LONG_LABEL = 60


def _label_overlap(spark: SparkSession, folder: str) -> overlap.Overlap:
    examples = table(spark, folder, "audit_examples").where(F.length("label") > LONG_LABEL)
    return overlap.near_classes(spread(examples.select(F.col("example_id").alias("record_id"), "source_id", "pool", "label")))


def _file_overlap(spark: SparkSession, folder: str) -> overlap.Overlap:
    files = shred.files(shred.shred_files(table(spark, folder, "gold_files"), ("sha256", "status", "note", "extra")))
    return overlap.same_files(files, table(spark, folder, "sources"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(first_record, second_record): a training and an evaluation record that are the same or almost."""
    both = overlap.pairs(_label_overlap(spark, folder)).unionByName(overlap.pairs(_file_overlap(spark, folder)))
    return both.select(F.least("train_id", "eval_id").alias("first_record"), F.greatest("train_id", "eval_id").alias("second_record"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, pool, source_id, records, pairs): overlapping evaluation records by pool and source, without forming the pairs."""
    labels, files = overlap.report(_label_overlap(spark, folder)), overlap.report(_file_overlap(spark, folder))
    return labels.withColumn("kind", F.lit("example")).unionByName(files.withColumn("kind", F.lit("file"))).select("kind", "pool", "source_id", "records", "pairs")


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, pool, class_id, links): every record with its class of copies and the number of classes it overlaps with."""
    return overlap.classes(_label_overlap(spark, folder)).unionByName(overlap.classes(_file_overlap(spark, folder)))


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """(train_class, eval_class): the classes that overlap; with ``p5_classes`` it says what ``p5_found`` does."""
    links = [found.links.select(*[F.hex(F.col(c).cast("binary")).alias(c) for c in ("train_class", "eval_class")]) for found in (_label_overlap(spark, folder), _file_overlap(spark, folder))]
    return links[0].unionByName(links[1])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    return tokens.encode(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p7_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(source, documents, empty, tokens, largest): the corpus in tokens."""
    return tokens.sizes_by_source(spread(table(spark, folder, "documents").select("doc_id", "source", "text")))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.with_tokens(spread(table(spark, folder, "documents").select("doc_id", "source", "text")))
    return mixing.mix(sized, table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens, times): the documents drawn and how often each is used."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target_share, actual_share, documents, tokens, budget, max_repeats, short): shares reached."""
    return _mix(spark, folder)[1]


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return subjects.subject_mixtures(documents, table(spark, folder, "subjects"), table(spark, folder, "subject_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, subject): areas that at least a fifth of the document's sentences are about."""
    return _subjects(spark, folder).where(F.col("share") >= subjects.SHARE - 1e-9).select("doc_id", "subject")


def p9_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, sentences, subject, about, share, weight): every area touched by a document."""
    return _subjects(spark, folder)


def p9_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, documents, sentences): the composition of the corpus by area."""
    found = _subjects(spark, folder)
    about = found.groupBy("subject").agg(F.count_if(F.col("share") >= subjects.SHARE - 1e-9).alias("documents"), F.sum("about").alias("sentences"))
    return table(spark, folder, "subjects").select("subject").join(about, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("sentences", F.lit(0)).alias("sentences"))


QUERIES: dict[str, Query] = {
    "p9_found": p9_found, "p9_mixtures": p9_mixtures, "p9_corpus": p9_corpus,
    "p7_ids": p7_ids, "p7_sizes": p7_sizes, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p5_found": p5_found, "p5_report": p5_report, "p5_classes": p5_classes, "p5_links": p5_links,
    "p1_found": p1_found, "p1_split": p1_split, "p1_shares": p1_shares,
    "p2_found": p2_found, "p2_mapped": p2_mapped, "p2_unmatched": p2_unmatched,
    "p6_found": p6_found, "p6_forms": p6_forms,
}
# --- the same in SQL -------------------------------------------------------------------------------


def _sql_look(column: str) -> str:
    """What a text looks like, by the table of look-alikes: characters replaced one by one, then composed."""
    plain = {c: look(c) for c in map(chr, range(0x80, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000}
    one = {c: x for c, x in plain.items() if len(x) == 1 and x != c}
    gone = "".join(c for c, x in plain.items() if not x)
    many = {c: x for c, x in plain.items() if len(x) > 1 and unicodedata.normalize("NFD", c) != x}
    quoted = lambda x: x.replace("'", "''")
    table_ = "MAP {" + ", ".join(f"'{quoted(c)}': '{quoted(x)}'" for c, x in many.items()) + "}"
    wide = f"CASE WHEN regexp_matches({column}, '[{''.join(many)}]') THEN array_to_string(list_transform(string_split({column}, ''), lambda c: COALESCE({table_}[c], c)), '') ELSE {column} END"
    return f"nfc_normalize(translate({wide}, '{quoted(''.join(one) + gone)}', '{quoted(''.join(one.values()))}'))"


ORACLES: dict[str, str] = {
    "p6_found": _P4 + f""", lb AS (SELECT DISTINCT example_id AS record_id, label FROM audit_examples UNION SELECT file_id || '/' || sp || '/' || rp, json_extract_string(r, '$.label') FROM r),
al AS (SELECT alias_id, alias, {_sql_look('alias')} AS x FROM taxonomy_aliases WHERE alias <> ''), fi AS (SELECT x, MIN(alias_id) AS alias_id FROM al GROUP BY 1), ld AS (SELECT DISTINCT label FROM lb WHERE label IS NOT NULL), lv AS (SELECT label, {_sql_look("label")} AS x FROM ld)
SELECT DISTINCT lb.record_id, fi.alias_id FROM lb JOIN lv ON lv.label = lb.label JOIN fi ON fi.x = lv.x JOIN al ON al.alias_id = fi.alias_id WHERE lb.label <> al.alias""",
}
