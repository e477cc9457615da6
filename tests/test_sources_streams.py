"""Sources, sinks and streams."""

from __future__ import annotations

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import formats
from tallyspark.streaming import events


def test_archive(spark, tmp_path):
    lines = ["adsh\tcik\tname\tsic\tform\tperiod\tfy\tfp\taciks", 'a1\t12\tAcme "Co\t100\t10-K\t20241231\t2024\tFY\t', "a2\tx\tBeta\t\t10-Q\t\t\t\t"]
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("sub.txt", "\n".join(lines))
    raw = formats.read_archive_member(spark, str(tmp_path / "q.zip"), "sub.txt")
    rows = formats.parse_lines(raw, formats.FILINGS, lines[0].split("\t")).orderBy("line_no").collect()
    assert [(r.adsh, r.cik, r.name, r.sic, r.fy) for r in rows] == [("a1", 12, 'Acme "Co', 100, 2024), ("a2", None, "Beta", None, None)]
    kept = formats.routed_lines(raw, spark.createDataFrame([("a2",)], "adsh STRING"))
    assert [r.line_no for r in kept.collect()] == [2]
    assert formats.read_archive_member(spark, str(tmp_path / "q.zip"), "none.txt").count() == 0


def test_tsv_and_lists(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("cik\tadsh\n1\ta\nbad\tb\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("adsh", T.StringType()), T.StructField("cik", T.LongType())])
    assert sorted(tuple(r) for r in formats.read_tsv(spark, str(tmp_path / "t.tsv"), schema).collect()) == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        formats.read_tsv(spark, str(tmp_path / "t.tsv"), schema, strict=True).collect()
    (tmp_path / "l.txt").write_text("# note\n\n x \ny\n")
    assert sorted(r.value for r in formats.read_list(spark, str(tmp_path / "l.txt")).collect()) == ["x", "y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k STRING, v INT")
    formats.write_exclusive(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        formats.write_exclusive(df, str(tmp_path / "out"))
    formats.write_payloads(df, str(tmp_path / "pay"), "k")
    assert sorted((r.k, r.v) for r in formats.read_jsonl(spark, str(tmp_path / "pay"), df.schema).collect()) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError, match="refused"):
        formats.write_checked(df, formats.repeated(df.union(df), ["k"]), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def _events(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(minutes=7 * i), i % 3, ("queued", "running", "completed", "failed")[i // 3 % 4], float(i), None) for i in range(60)]
    df = spark.createDataFrame(rows, events.EVENTS)
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    return df, str(tmp_path / "events")


def _run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.awaitTermination(60)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_stream_equals_batch(spark, tmp_path):
    batch, folder = _events(spark, tmp_path)
    want = {tuple(r) for r in events.tumbling(batch).collect()}
    got = {tuple(r) for r in _run(events.tumbling(events.read_events(spark, folder, 100)), "complete", "tumbling").collect()}
    assert got == want and len(want) > 5
    assert events.sliding(batch).agg(F.sum("n")).first()[0] == 2 * 60
    assert events.sessions(batch, "5 minutes").count() == 60


def test_stream_state(spark, tmp_path):
    batch, folder = _events(spark, tmp_path)
    as_jobs = lambda df: df.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    want = {tuple(r) for r in events.job_states(as_jobs(batch)).collect()}
    rows = _run(events.job_states(as_jobs(events.read_events(spark, folder, 100))), "update", "states").collect()
    last = {}
    for r in rows:
        last[r.job_id] = tuple(r)
    assert set(last.values()) == want and {w[1] for w in want} == {"completed"}


def test_stream_state_with_times(spark, tmp_path):
    """One file a trigger, with a time out after the watermark: the same states."""
    batch, folder = _events(spark, tmp_path)
    as_jobs = lambda df: df.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "ts")
    want = {tuple(r) for r in events.job_states(as_jobs(batch)).collect()}
    last = {r.job_id: tuple(r) for r in _run(events.job_states(as_jobs(events.read_events(spark, folder, 100))), "update", "timed").collect()}
    assert set(last.values()) == want


def test_guard():
    assert events.advance(None, "running") is None and events.advance("queued", "completed") == "queued" and events.advance("running", "failed") == "failed" and events.advance("completed", "running") == "completed"


def test_first_deliveries(spark, tmp_path):
    batch, _ = _events(spark, tmp_path)
    assert events.first_deliveries(batch.union(batch), "event_id").count() == 60 and events.tail(batch, 50).count() == 9
