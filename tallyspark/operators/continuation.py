"""Parts of statements that run over pages, put together; reading order of lines; lists joined by first sight."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of two parts line up within this share of the page's width.
TOLERANCE = 0.05


def line_up(a: dict[str, float], b: dict[str, float], width: float) -> bool:
    """Whether two parts have the same periods in the same places."""
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) <= TOLERANCE * width for k in a)


def merged_parts(parts: DataFrame) -> DataFrame:
    """(doc_id, part_id, head_id): each part with the part that the statement begins with.

    ``parts`` is (doc_id, part_id, type, grp, first_page, last_page, place, centres MAP<STRING, DOUBLE>,
    page_width, closed). In page order a part continues the latest statement of its type and group if that
    is not closed, ends on the same page or the one before, and their columns line up. Columns are
    compared with those of the head, so that small shifts do not add up. A part without columns begins a
    statement of its own. Parts are sorted within the tasks and folded as they pass, so that a document may
    have any number of them.
    """
    group = ["doc_id", "type", "grp"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, head, last, closed = None, None, None, False
        for pdf in batches:
            out = []
            for p in pdf.itertuples(index=False):
                key, centres = (p.doc_id, p.type, p.grp), dict(p.centres) if p.centres is not None else {}
                follows = key == at and not closed and p.first_page in (last, last + 1) and bool(centres) and line_up(head[1], centres, head[2])
                if not follows:
                    head = (p.part_id, centres, p.page_width)
                at, last, closed = key, p.last_page, bool(p.closed)
                out.append((p.doc_id, p.part_id, head[0]))
            yield pd.DataFrame(out, columns=["doc_id", "part_id", "head_id"])

    ordered = parts.repartition(*group).sortWithinPartitions(*group, "first_page", "place", "part_id")
    return ordered.select(*group, "part_id", "first_page", "last_page", "centres", "page_width", "closed").mapInPandas(fold, "doc_id STRING, part_id STRING, head_id STRING")


def inherited_columns(unbound: DataFrame, previous: DataFrame) -> DataFrame:
    """(table_id, col, period_key): columns without a period take the nearest one of the part before that is not bound yet.

    ``unbound`` is (table_id, col, centre, page_width, bound ARRAY<STRING>), ``previous`` (table_id,
    period_key, centre). Of two columns that would take one period the left one does.
    """
    near = unbound.join(previous.withColumnRenamed("centre", "there"), "table_id").where((F.abs(F.col("centre") - F.col("there")) <= TOLERANCE * F.col("page_width")) & ~F.array_contains("bound", F.col("period_key")))
    best = near.groupBy("table_id", "col").agg(F.min_by("period_key", F.struct(F.abs(F.col("centre") - F.col("there")), F.col("period_key"))).alias("period_key"))
    first = best.groupBy("table_id", "period_key").agg(F.min("col").alias("col"))
    return first.select("table_id", "col", "period_key")


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines (page, line_id, top, left) with their place on the page, from top to bottom and left to right."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("top", "left", "line_id")))


def first_seen(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of all lists, each key once: as the first list that has it gives it."""
    ranked = None
    for k, df in enumerate(lists):
        side = df.withColumn("_list", F.lit(k))
        ranked = side if ranked is None else ranked.unionByName(side)
    columns = [c for c in ranked.columns if c not in (*key, "_list")]
    kept = ranked.groupBy(*key).agg(F.min_by(F.struct(*columns), "_list").alias("_row"))
    return kept.select(*key, "_row.*")


def oldest(jobs: DataFrame, status: str = "queued") -> DataFrame:
    """The job of a status that has waited longest, ties by id; none if there is none."""
    return jobs.where(F.col("status") == status).orderBy("created_at", "job_id").limit(1)


def edition_pairs(documents: DataFrame, key: list[str]) -> DataFrame:
    """(key..., en_id, ar_id): the English and the Arabic edition of a document, where there is one of each."""
    sides = documents.where("language IN ('en', 'ar')").groupBy(*key).agg(*[f(F.when(F.col("language") == c, F.col("doc_id"))).alias(n) for c in ("en", "ar") for f, n in ((F.min, f"{c}_id"), (F.count, f"{c}_n"))])
    return sides.where("en_n = 1 AND ar_n = 1").select(*key, "en_id", "ar_id")
