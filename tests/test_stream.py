"""Masking a stream gives what masking the same files as a table gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskloom.operators.audit import audit_unchanged
from maskloom.operators.masking import mask_side_by_side, mask_table
from maskloom.streaming.stream import mask_batch, mask_stream, mask_stream_with_reports, stream_report

EVENTS = "/root/testdata/sf0.001/events.parquet"
POLICY = {"event_type": "category", "value": "amount", "day": "date"}


def with_day(df):
    return df.withColumn("day", F.date_format("ts", "MM/dd/yyyy"))


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    events.repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        query = mask_stream(spark, source, schema, POLICY, "events.csv", out, checkpoint, prepare=with_day)
        assert query.awaitTermination(120) and query.exception() is None

    def check(expected):
        done = spark.read.parquet(out)
        assert done.exceptAll(expected).isEmpty() and expected.exceptAll(done).isEmpty()

    run()
    once = mask_table(with_day(events), POLICY, "events.csv")
    check(once)
    # A restart takes up only files that are new.
    events.limit(10).write.mode("append").parquet(source)
    run()
    check(once.unionAll(mask_table(with_day(spark.read.parquet(source)), POLICY, "events.csv").exceptAll(once)))


def test_reports_of_a_stream_add_up(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    source, out, reports, checkpoint = (str(tmp_path / d) for d in ("in", "out", "reports", "checkpoint"))
    events.repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        query = mask_stream_with_reports(
            spark, source, schema, POLICY, "events.csv", out, reports, checkpoint, prepare=with_day, files_per_batch=2
        )
        assert query.awaitTermination(120) and query.exception() is None

    def check():
        table = with_day(spark.read.parquet(source))
        done, expected = spark.read.parquet(out).drop("batch"), mask_table(table, POLICY, "events.csv")
        assert done.exceptAll(expected).isEmpty() and expected.exceptAll(done).isEmpty()
        whole = audit_unchanged(mask_side_by_side(table, POLICY, "events.csv"), list(POLICY)).collect()
        got = stream_report(spark, reports).orderBy("position").collect()
        assert [tuple(r)[1:] for r in got] == [tuple(r) for r in whole]

    run()
    assert spark.read.parquet(reports).select("batch").distinct().count() == 2
    check()
    # A restart takes up only files that are new, and earlier reports stay.
    events.limit(10).write.mode("append").parquet(source)
    run()
    check()


def test_a_repeated_batch_counts_once(spark, tmp_path):
    out, reports = str(tmp_path / "out"), str(tmp_path / "reports")
    batch = spark.createDataFrame([("1/2/2024", "a"), (None, "b"), ("soon", "c")], "day STRING, x STRING")
    for _ in range(2):
        mask_batch(batch, 4, {"day": "date"}, "s", out, reports)
    mask_batch(batch.where("false"), 5, {"day": "date"}, "s", out, reports)
    assert [tuple(r) for r in stream_report(spark, reports).collect()] == [(0, "day", 3, 2, 1)]
    assert spark.read.parquet(out).count() == 3
    with pytest.raises(ValueError):
        mask_batch(batch.withColumnRenamed("x", "batch"), 6, {"day": "date"}, "s", out, reports)
