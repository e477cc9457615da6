"""Facts of whole documents: language, currency, flags, merged evidence, pools of linked issuers, grounded claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import cut


def document_language(pages: DataFrame) -> DataFrame:
    """(doc_id, language): Arabic if its letters outnumber the Latin ones over all pages, else English; null without letters."""
    n = pages.groupBy("doc_id").agg(F.sum("arabic_chars").alias("a"), F.sum("latin_chars").alias("l"))
    return n.select("doc_id", F.when(F.coalesce("a", F.lit(0)) + F.coalesce("l", F.lit(0)) == 0, F.lit(None)).when(F.col("a") > F.coalesce("l", F.lit(0)), "ar").otherwise("en").alias("language"))


def most_common_first(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, value, n): the most frequent value, the one seen first where two tie."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return n.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("best")).select(key, f"best.{value}", "best.n")


def metadata(statements: DataFrame, documents: DataFrame) -> DataFrame:
    """(statement_id, currency, source, flags): header, then caption, then domicile, then document; what contradicts is flagged.

    ``statements`` has (statement_id, doc_id, header_currency, caption_currency), ``documents``
    (doc_id, domicile_currency, document_currency).
    """
    s = statements.join(documents.select("doc_id", "domicile_currency", "document_currency"), "doc_id", "left")
    ranked = ("header_currency", "caption_currency", "domicile_currency", "document_currency")
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c.removesuffix("_currency"))) for c in ranked])
    clash = F.col("header_currency") != F.col("caption_currency")
    flags = F.array_compact(F.array(F.when(clash, "currency_conflict"), F.when(source == "domicile", "currency_from_domicile"), F.when(source == "document", "currency_inferred"), F.when(source.isNull(), "currency_missing")))
    return s.select("statement_id", F.coalesce(*ranked, F.lit("XXX")).alias("currency"), source.alias("source"), flags.alias("flags"))


def locate_flags(pages: DataFrame, ranges: DataFrame, spans: DataFrame, enabled: list[str], share: float = 0.25) -> DataFrame:
    """(doc_id, flags): pages not read, types not found, and a selection that takes more than a quarter of the pages.

    ``pages`` is (doc_id, page_no, flags, source), ``ranges`` (doc_id, type), ``spans`` (doc_id, first_page, last_page).
    """
    has = lambda f: F.array_contains("flags", f)
    p = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(has("ocr_unavailable")).alias("unread"), F.count_if(has("ocr_failed")).alias("failed"), F.count_if(has("garbled_text_layer") & (F.col("source") != "ocr")).alias("garbled"))
    r = ranges.groupBy("doc_id").agg(F.collect_set("type").alias("found"))
    s = spans.groupBy("doc_id").agg(F.sum(F.col("last_page") - F.col("first_page") + 1).alias("taken"))
    number = lambda c, text: F.when(F.col(c) > 0, F.concat(F.lit(f"{text}:"), c))
    missing = F.transform(F.array_except(F.array(*map(F.lit, enabled)), F.coalesce("found", F.array().cast("array<string>"))), lambda t: F.concat(F.lit("statement_not_found:"), t))
    last = F.when(F.col("taken").isNull(), "no_statements_found").when(F.col("taken") / F.col("pages") > share, "low_selectivity")
    first = F.array_compact(F.array(number("unread", "image_pages_not_read"), number("failed", "ocr_failed_pages"), number("garbled", "garbled_text_layers_not_read")))
    return p.join(r, "doc_id", "left").join(s, "doc_id", "left").select("doc_id", F.concat(first, missing, F.array_compact(F.array(last))).alias("flags"))


def merge_evidence(observations: DataFrame, key: list[str], fact: str) -> DataFrame:
    """(key..., fact, observations, conflict): the one interpretation of all observations, null where they differ."""
    g = observations.groupBy(*key).agg(F.count(F.lit(1)).alias("observations"), F.min(fact).alias("_a"), F.max(fact).alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return g.select(*key, F.when(same, F.col("_a")).alias(fact), "observations", (~same).alias("conflict"))


def alias_pools(records: DataFrame) -> DataFrame:
    """(key, group, pool, conflict): names and numbers linked by records (name_key, cik_key, pool), with the pool they share.

    Groups are found by spreading the smallest key along the links, which halves distances by also
    following each key's current smallest; steps are checkpointed. A group with several pools, or
    several numbers under one name, is a conflict and gets none. Records without a pool link all the same.
    """
    links = records.where("name_key IS NOT NULL AND cik_key IS NOT NULL").select(F.col("name_key").alias("u"), F.col("cik_key").alias("v"))
    edges = cut(links.union(links.select("v", "u")).distinct())
    keys = records.select(F.explode(F.array_compact(F.array("name_key", "cik_key"))).alias("key")).distinct()
    state = cut(keys.withColumn("group", F.col("key")))
    while True:
        near = edges.join(state.select(F.col("key").alias("v"), "group"), "v").groupBy(F.col("u").alias("key")).agg(F.min("group").alias("seen"))
        step = state.join(near, "key", "left").select("key", F.least("group", F.coalesce("seen", "group")).alias("group"), F.col("group").alias("old"))
        jump = step.select(F.col("key").alias("_k"), F.col("group").alias("_g"))
        step = cut(step.join(jump, F.col("group") == F.col("_k"), "left").select("key", F.least("group", F.coalesce("_g", "group")).alias("group"), "old"))
        state = step.select("key", "group")
        if step.where("group <> old").isEmpty():
            break
    pooled = records.select(F.coalesce("name_key", "cik_key").alias("key"), "pool", "cik_key").join(state, "key").groupBy("group").agg(F.min("pool").alias("a"), F.max("pool").alias("b"), F.countDistinct("cik_key").alias("numbers"))
    out = state.join(pooled, "group")
    bad = F.coalesce(F.col("a") != F.col("b"), F.lit(False)) | (F.col("numbers") > 1)
    return out.select("key", "group", F.when(~bad, F.col("a")).alias("pool"), bad.alias("conflict"))


def latest_unique(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows of the latest time of each key, where only one row has it. Keys of any size: counts go ahead of the rows."""
    each = rows.groupBy(*key, at).agg(F.count(F.lit(1)).alias("_n"))
    last = each.groupBy(*key).agg(F.max_by(F.struct(F.col(at).alias("_at"), "_n"), at).alias("_last")).where("_last._n = 1")
    side = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_last._at").alias("_at"))
    on = F.col(at) == F.col("_at")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(side, on, "left_semi")


def status(analyses: DataFrame) -> DataFrame:
    """(doc_id, status): completed if every statement passed and no flag but ``low_selectivity`` stands."""
    a = analyses.groupBy("doc_id").agg(F.bool_and(F.col("review") == "passed").alias("ok"), F.bool_and(F.forall("flags", lambda f: f == "low_selectivity")).alias("clean"))
    return a.select("doc_id", F.when(F.coalesce(F.col("ok") & F.col("clean"), F.lit(False)), "completed").otherwise("needs_review").alias("status"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first guard that is violated, null if all hold."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules])
