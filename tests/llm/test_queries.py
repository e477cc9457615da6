"""The registered queries of this package on the smallest tables: columns, and results against plain readings of the tables."""

from __future__ import annotations

import pytest

COLUMNS = {
    "p1_found": ["first_source_id", "source_id"], "p2_found": ["record_id", "item_id"], "p5_found": ["first_record", "second_record"], "p6_found": ["record_id", "alias_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"],
}


@pytest.fixture(scope="module")
def queries():
    from tallyspark.llm import catalogue

    return catalogue.QUERIES


def test_columns(spark, data, queries):
    for name, columns in COLUMNS.items():
        df = queries[name](spark, data)
        assert df.columns == columns
        rows = [tuple(map(str, r)) for r in df.collect()]
        assert rows and len(rows) == len(set(rows)), name


@pytest.mark.parametrize("name", ["p1_split", "p1_shares", "p2_mapped", "p2_unmatched", "p5_report", "p6_forms", "p7_sizes", "p8_mix", "p8_shares", "p9_mixtures", "p9_corpus"])
def test_runs(spark, data, queries, name):
    assert queries[name](spark, data).count() > 0


def test_groups_share_a_pool(spark, data, queries):
    pools = {r.source_id: r.pool for r in queries["p1_split"](spark, data).collect()}
    assert len(pools) == spark.read.parquet(f"{data}/sources.parquet").select("source_id").distinct().count()
    assert all(pools[r.first_source_id] == pools[r.source_id] for r in queries["p1_found"](spark, data).collect())


def test_every_document_has_ids(spark, data, queries):
    from tallyspark.llm.tokens import Encoder

    encoder = Encoder()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries["p7_ids"](spark, data).collect()}
    assert got == {k: encoder(t) for k, t in texts.items()}
