"""Training-data operators that have to take all of their input: nothing is cut silently."""

from __future__ import annotations

from itertools import combinations

import pytest

from tallyspark.llm import overlap, splits, subjects


def test_many_unclear_words_are_read_in_other_ways():
    """Copies with one or two slips that are not the likeliest reading, in a text with many unclear words."""
    wording = {c * 5 + end: 10 - "xy".index(end) for c in "abcdefghijkl" for end in "xy"}
    sign = overlap.Signer(wording, 5)
    assert sign.readings("aaaaaz") == ("aaaaax", "aaaaay")
    copy = [c * 5 + "z" for c in "abcdefghijkl"]
    keys = set(sign(" ".join(copy))[0])
    for n in (1, 2):
        for places in combinations(range(len(copy)), n):
            original = [w[:-1] + "y" if k in places else w for k, w in enumerate(copy)]
            assert keys & set(sign(" ".join(original))[0]), places


def test_a_copy_above_the_cap_is_found(spark):
    likely, other = ([c * 5 + end for c in "abcdefgh"] for end in "xy")
    rows = [(f"w{k}", "s", None, " ".join((likely if k < 9 else other) + ["q" * k])) for k in range(15)]
    copy = [c * 5 + "z" for c in "abcdefgh"]
    rows += [("train", "s", "train", " ".join([other[0], *copy[1:]])), ("eval", "t", "test", " ".join(copy))]
    df = spark.createDataFrame(rows, "record_id STRING, source_id STRING, pool STRING, label STRING")
    assert {(r.train_id, r.eval_id) for r in overlap.pairs(overlap.near_classes(df)).collect()} == {("train", "eval")}


def test_many_pools(spark):
    """Targets of any number: every pool gets its share."""
    groups = spark.createDataFrame([(f"s{i}", f"c{i}") for i in range(3000)], "source_id STRING, component STRING")
    weights = groups.selectExpr("source_id", "CAST(1 AS DOUBLE) AS records")
    targets = spark.createDataFrame([(f"p{k:04}", 0.01) for k in range(150)], "pool STRING, share DOUBLE")
    sizes = [r["count"] for r in splits.assign_pools(groups, weights, targets).groupBy("pool").count().collect()]
    assert len(sizes) == 150 and max(sizes) - min(sizes) <= 1


def test_subjects_are_bounded(spark):
    """The weights of all subjects are sent to all workers: one subject above the bound raises; none is left out."""
    documents = spark.createDataFrame([(1, "A text.")], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(1, "s0000")], "doc_id LONG, subject STRING")
    names = spark.createDataFrame([(f"s{k:04}", "a gloss") for k in range(subjects.MOST_SUBJECTS + 1)], "subject STRING, gloss STRING")
    with pytest.raises(ValueError, match="subjects"):
        subjects.subject_mixtures(documents, names, labels)
    with pytest.raises(ValueError, match="glosses"):
        subjects.subject_mixtures(documents, names.withColumn("subject", names.subject.substr(1, 4)), labels)
