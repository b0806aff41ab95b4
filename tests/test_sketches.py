"""Sketches: one scan, the same samples as two, and merging that changes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskloom.functions.hashing import hash_of
from maskloom.operators import detect as D
from maskloom.operators import sketches as S
from maskloom.operators.masking import mask_side_by_side

COLUMNS = ["word", "few", "none", "price"]


@pytest.fixture
def mixed_table(spark):
    k = F.col("id")
    return spark.range(0, 30000, 1, 7).select(
        k.cast("string").alias("row_key"),
        F.concat(F.lit("w"), (k * 7919 % 1013).cast("string")).alias("word"),
        F.when(k % 4999 == 3, F.lit("rare")).alias("few"),
        F.lit(None).cast("string").alias("none"),
        (k * 1e7 + 0.25).alias("price"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("share, most", [(0.1, 50), (0.2, 7), (0.15, 400)])
def test_sketch_gives_the_sample_of_two_scans(mixed_table, share, most):
    sketch = S.column_sketch(mixed_table, COLUMNS, "row_key", most)
    assert rows(S.sample_of(sketch, share, most)) == rows(D.sample_column(mixed_table, COLUMNS, share, "row_key", most))


def test_merged_sketches_are_those_of_the_whole(mixed_table):
    low = hash_of("half", F.col("row_key")) < "3"
    parts = [S.column_sketch(part, COLUMNS, "row_key") for part in (mixed_table.where(low), mixed_table.where(~low), mixed_table.where("false"))]
    whole = S.column_sketch(mixed_table, COLUMNS, "row_key")
    assert rows(S.merge_column_sketches(*parts)) == rows(whole)
    assert {r["column"]: r.n for r in whole.collect()} == {"word": 30000, "few": 7, "price": 30000}
    found = D.detect_columns(mixed_table, row_key="row_key", sample=S.sample_of(S.merge_column_sketches(*parts)))
    assert rows(found.na.fill("")) == rows(D.detect_columns(mixed_table, row_key="row_key").na.fill(""))


def test_detection_by_a_sketch_scans_once(spark, tmp_path, mixed_table):
    mixed_table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = D.detect_columns(stored, row_key="row_key", sample=S.sample_of(S.column_sketch(stored, row_key="row_key")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert found.count() == 4


def test_sketches_without_key_rows_or_values(spark):
    flat = spark.createDataFrame([("S",)] * 300 + [(None,)] * 50 + [("",)] * 300, "size STRING")
    sketch = S.column_sketch(flat)
    assert [r.n for r in sketch.collect()] == [600] and S.sample_of(sketch).count() == 50
    assert S.column_sketch(flat.where("false")).count() == 0
    long = spark.createDataFrame([("a" * 2_000_000, "1")], "`a.b` STRING, k STRING")
    assert [len(r.value) for r in S.sample_of(S.column_sketch(long, row_key="k")).collect()] == [2_000_000]


def pairs_of(spark, n, outputs):
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("i"), k.cast("string")).alias("a"), F.concat(F.lit("o"), (k % outputs).cast("string")).alias("a__masked"),
        F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("b__masked"),
    )


def test_estimates_are_exact_while_few_and_near_beyond(spark):
    few = {r["column"]: r for r in S.audit_estimates(S.value_sketch(pairs_of(spark, 900, 30), ["a", "b"])).collect()}
    assert tuple(few["a"])[1:] == (900, 30, 870, 0, 0.0, True)
    assert tuple(few["b"])[1:] == (0, 0, 0, 0, 0.0, True)
    many = S.audit_estimates(S.value_sketch(pairs_of(spark, 200_000, 50_000), ["a"])).first()
    assert not many.exact and abs(many.inputs / 200_000 - 1) < 5 * many.error and abs(many.outputs / 50_000 - 1) < 5 * many.error


def test_merged_estimates_count_common_values_once(spark):
    parts = [S.value_sketch(pairs_of(spark, n, 30), ["a"]) for n in (500, 900)]
    assert tuple(S.audit_estimates(S.merge_value_sketches(*parts)).first())[1:] == (900, 30, 870, 0, 0.0, True)


def test_leaked_values_are_estimated(spark):
    df = spark.createDataFrame([(f"x{i}",) for i in range(100)], "a STRING").withColumn("a__masked", F.when(F.col("a") < "x2", F.col("a")).otherwise("y"))
    expected = sum(f"x{i}" < "x2" for i in range(100))
    assert S.audit_estimates(S.value_sketch(df, ["a"])).first().leaked == expected


def test_sketch_of_a_masked_table(small, policy):
    got = S.audit_estimates(S.value_sketch(mask_side_by_side(small, policy, "s"), list(policy))).collect()
    assert {r["column"]: r.inputs for r in got} == {"name": 100, "email": 100, "country": 1}
