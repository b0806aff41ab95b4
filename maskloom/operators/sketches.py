"""Sketches of a table that are made in one scan, stored, and merged: samples of columns, and distinct values.

A table that grows is sketched file by file; what was sketched before is not read again.

``column_sketch`` holds, for each column, the number of its non-null values and those of the lowest row
hashes. That is exactly what ``detect.sample_column`` draws, so detection by a sketch gives the same result
from one scan in place of two. Each task keeps at most ``most`` values a column, in Arrow batches, and shuffles
only these. Merging takes two steps, so that no task meets the sketches of all tasks.

``value_sketch`` holds theta sketches of a column's inputs and outputs. Unions and intersections of them
estimate how many inputs share outputs and how many inputs are outputs as well, with a stated error.

Edge cases: NULLs count nowhere; a column without values has a sketch of no values in ``value_sketch`` and no
row in ``column_sketch``; an empty table has no rows there; equal rows without a key are drawn as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import hash_of
from maskloom.operators.audit import twin
from maskloom.operators.detect import HASH, SAMPLE_MAX, SAMPLE_SHARE_MAX, SAMPLE_SHARE_MIN, _as_text
from maskloom.session import column

COLUMN_SKETCH = "position INT, column STRING, n BIGINT, lowest ARRAY<STRUCT<hash: STRING, value: STRING>>"
#: Groups of tasks whose sketches are merged first.
GROUPS = 512
#: A theta sketch keeps up to 2^12 hashes, for a relative standard error of at most 1 / sqrt(2^12 - 1).
LG_ENTRIES = 12
ERROR = (2**LG_ENTRIES - 1) ** -0.5


def column_sketch(
    df: DataFrame, columns: list[str] | None = None, row_key: str | None = None, most: int = SAMPLE_MAX
) -> DataFrame:
    """``position, column, n, lowest``: a row for each column that has values, from one scan of ``df``.

    ``lowest`` holds at most ``most`` values with the hashes of their rows, lowest first. Sketches that are to be
    merged must name the same columns in the same order. Without a key, the row's place in the table is hashed
    too; sketches of several tables should then not be merged, as their places are the same.
    """
    columns = columns if columns is not None else [c for c in df.columns if c != row_key]
    key = [column(row_key)] if row_key else [*[column(c) for c in df.columns], F.monotonically_increasing_id()]
    rows = df.select(hash_of(*key).alias(HASH), *[_as_text(df, c).alias(f"__v{i}") for i, c in enumerate(columns)])
    pair = pa.list_(pa.struct([("hash", pa.string()), ("value", pa.string())]))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kept = [0] * len(columns), [None] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                values = batch.column(i + 1)
                counts[i] += len(values) - values.null_count
                keep, held = pc.is_valid(values), kept[i]
                if held is not None and held.num_rows == most:
                    # Only rows that sort among those held can displace one.
                    keep = pc.and_(keep, pc.less_equal(batch.column(0), held["hash"][most - 1]))
                fresh = pa.table({"hash": batch.column(0), "value": values}).filter(keep)
                if fresh.num_rows:
                    both = fresh if held is None else pa.concat_tables([held, fresh])
                    kept[i] = both.sort_by([("hash", "ascending"), ("value", "ascending")]).slice(0, most).combine_chunks()
        seen = [i for i, held in enumerate(kept) if held is not None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(seen, pa.int32()),
                pa.array([columns[i] for i in seen], pa.string()),
                pa.array([counts[i] for i in seen], pa.int64()),
                pa.array([kept[i].to_pylist() for i in seen], pair),
            ],
            ["position", "column", "n", "lowest"],
        )

    return _merged(rows.mapInArrow(lowest, COLUMN_SKETCH), most)


def _merged(sketches: DataFrame, most: int) -> DataFrame:
    def step(held: DataFrame, *by: str) -> DataFrame:
        pairs = F.slice(F.sort_array(F.flatten(F.collect_list("lowest"))), 1, most)
        return held.groupBy("position", "column", *by).agg(F.sum("n").alias("n"), pairs.alias("lowest"))

    grouped = step(sketches.withColumn("__group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))), "__group")
    return step(grouped).select("position", "column", "n", "lowest")


def merge_column_sketches(*sketches: DataFrame, most: int = SAMPLE_MAX) -> DataFrame:
    """The sketch of all tables together; ``most`` is at most the size the sketches were made with."""
    return _merged(reduce(DataFrame.unionByName, sketches), most)


def sample_of(sketch: DataFrame, share: float = SAMPLE_SHARE_MIN, most: int = SAMPLE_MAX) -> DataFrame:
    """``position, column, rn, value``, as ``detect.sample_column`` gives it."""
    share = max(SAMPLE_SHARE_MIN, min(SAMPLE_SHARE_MAX, share))
    size = F.least(F.greatest(F.lit(1), F.floor(F.col("n").cast("double") * F.lit(share))), F.lit(most)).cast("int")
    drawn = sketch.select("position", "column", F.posexplode(F.slice("lowest", F.lit(1), size)).alias("at", "x"))
    return drawn.select("position", "column", (F.col("at") + 1).alias("rn"), F.col("x.value").alias("value"))


def _theta(value: Column) -> Column:
    return F.theta_sketch_agg(value.cast("string"), LG_ENTRIES)


def value_sketch(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``column, inputs, outputs``: theta sketches of the different values before and after masking.

    One pass over ``pairs``; a task shuffles one sketch a column and side.
    """
    made = pairs.agg(*[
        side.alias(f"{name}_{i}") for i, c in enumerate(columns) for name, side in (("inputs", _theta(column(c))), ("outputs", _theta(twin(c))))
    ])
    entries = [F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in ("inputs", "outputs")]) for i, c in enumerate(columns)]
    return made.select(F.inline(F.array(*entries)))


def merge_value_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketches of all tables together, one row a column."""
    both = reduce(DataFrame.unionByName, sketches)
    return both.groupBy("column").agg(*[F.theta_union_agg(c, LG_ENTRIES).alias(c) for c in ("inputs", "outputs")])


def audit_estimates(sketch: DataFrame) -> DataFrame:
    """``column, inputs, outputs, shared, leaked, error, exact`` of a sketch.

    ``shared`` is how many inputs more there are than outputs, ``leaked`` how many values are inputs and
    outputs. ``error`` is the relative standard error of ``inputs`` and ``outputs``; that of ``leaked`` is relative
    to the greater of them. ``exact`` says that both sketches still hold all their values' hashes: then the
    numbers are the true ones, and ``error`` is 0. A ``leaked`` of 0 without it is no proof that nothing leaked.
    """
    n = {name: F.theta_sketch_estimate(F.col(name)) for name in ("inputs", "outputs")}
    whole = F.greatest(*n.values()) < F.lit(2**LG_ENTRIES)
    return sketch.select(
        "column",
        n["inputs"].alias("inputs"),
        n["outputs"].alias("outputs"),
        (n["inputs"] - n["outputs"]).alias("shared"),
        F.theta_sketch_estimate(F.theta_intersection("inputs", "outputs")).alias("leaked"),
        F.when(whole, F.lit(0.0)).otherwise(F.lit(ERROR)).alias("error"),
        whole.alias("exact"),
    )


def distinct_values(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``column, inputs, outputs, leaked`` counted exactly, in one scan; values are reduced before they are shuffled."""
    cells = [
        F.struct(F.lit(i).alias("at"), value.cast("string").alias("value"), F.lit(before).alias("before"))
        for i, c in enumerate(columns)
        for value, before in ((column(c), True), (twin(c), False))
    ]
    seen = pairs.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).groupBy("at", "value")
    seen = seen.agg(F.bool_or("before").alias("before"), F.bool_or(~F.col("before")).alias("after"))
    counted = seen.agg(*[
        F.count_if((F.col("at") == i) & test).alias(f"{name}_{i}")
        for i in range(len(columns))
        for name, test in (("inputs", F.col("before")), ("outputs", F.col("after")), ("leaked", F.col("before") & F.col("after")))
    ])
    entries = [F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in ("inputs", "outputs", "leaked")]) for i, c in enumerate(columns)]
    return counted.select(F.inline(F.array(*entries)))
