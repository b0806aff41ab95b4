"""A masking stream from a folder of parquet files to another, with or without a report of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from maskloom.operators.audit import twin
from maskloom.operators.masking import mask_side_by_side, mask_table
from maskloom.operators.policy import as_entries
from maskloom.session import column

REPORT = "position INT, column STRING, rows BIGINT, filled BIGINT, unchanged BIGINT"
BATCH = "batch"


def mask_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    policy,
    salt,
    output: str,
    checkpoint: str,
    trigger: dict | None = None,
    prepare=None,
) -> StreamingQuery:
    """Mask new files as they come; by default, all that are there now, then stop.

    ``prepare`` is applied to the stream before masking, as to turn dates into text.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    if prepare is not None:
        stream = prepare(stream)
    masked = mask_table(stream, policy, salt)
    return (
        masked.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(output)
    )


def mask_batch(batch: DataFrame, number: int, policy, salt, output: str, reports: str) -> None:
    """Mask and write one batch, and a report that was counted while it was written.

    Both go to folders named by the batch's number and replace what stands there, so a batch that is repeated
    after a failure counts once.
    """
    names = [entry.column for entry in as_entries(policy)]
    if BATCH in batch.columns:
        raise ValueError(f"a column is called {BATCH!r}, as the folders of the output are")
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        counts.append(F.count(column(c)).alias(f"filled_{i}"))
        counts.append(F.count_if(column(c).isNotNull() & column(c).eqNullSafe(twin(c))).alias(f"unchanged_{i}"))
    pairs = mask_side_by_side(batch, policy, salt).observe(seen, *counts)
    masked = pairs.select(*[twin(c).alias(c) if c in names else column(c) for c in batch.columns])
    masked.write.mode("overwrite").parquet(f"{output}/{BATCH}={number}")
    got = seen.get
    rows = [(i, c, got["rows"], got[f"filled_{i}"], got[f"unchanged_{i}"]) for i, c in enumerate(names)]
    report = batch.sparkSession.createDataFrame(rows, REPORT).coalesce(1)
    report.write.mode("overwrite").parquet(f"{reports}/{BATCH}={number}")


def mask_stream_with_reports(
    spark: SparkSession,
    source: str,
    schema: StructType,
    policy,
    salt,
    output: str,
    reports: str,
    checkpoint: str,
    trigger: dict | None = None,
    prepare=None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """As ``mask_stream``; each batch is a folder of ``output`` and has a report, which ``stream_report`` sums up.

    ``rows`` counts the batch, ``filled`` the values that are not NULL and ``unchanged`` those that left as they came.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if prepare is not None:
        stream = prepare(stream)
    return (
        stream.writeStream.foreachBatch(lambda batch, number: mask_batch(batch, number, policy, salt, output, reports))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_report(spark: SparkSession, reports: str) -> DataFrame:
    """``position, column, rows, filled, unchanged``: the reports of all batches so far, summed up."""
    sums = [F.sum(c).alias(c) for c in ("rows", "filled", "unchanged")]
    return spark.read.schema(REPORT).parquet(reports).groupBy("position", "column").agg(*sums)
