"""What several operators share: stored tables, Arrow texts, components of a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.session import scratch_path

#: Stands in for a NULL id inside joins; results give NULL back.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back: later jobs, and tasks that
    are repeated after a lost executor, read the same rows. The folder belongs to the session's
    owner, who empties it when the session has ended."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column on end, and the rows' offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def by_slices(
    work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = 4 << 20, text: str = "text"
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that gives ``work`` a few MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
            for a, b in slices(sizes.to_numpy(zero_copy_only=False), most):
                yield work(batch.slice(a, b - a))

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node that each node of an edge reaches.

    Every round each node takes the smallest label of its neighbours and then its label's own label
    (pointer jumping), so rounds grow with the logarithm of the longest path. Rounds are stored
    tables; a hot node's labels meet in partial aggregates.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stored(both.union(both.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("seen"))
        low = labels.join(near, labels.node == near.u, "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("seen", "component")).alias("low")
        )
        hop = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        moved = stored(
            low.join(hop, low.low == hop["at"], "left").select(
                "node", "old", F.least("low", F.coalesce("next", "low")).alias("component")
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
