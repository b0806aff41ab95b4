"""Audits: clean results on masked tables, and findings where something was broken on purpose."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskloom.functions.pools import COUNTRIES
from maskloom.operators import audit as A
from maskloom.operators.masking import mask_side_by_side, mask_table
from maskloom.session import scratch_path

POLICY = {
    "day": "date", "second": "date", "amount": "amount", "text": "amount", "who": "name",
    "what": {"type": "description", "category_column": "kind"}, "account": "id",
}
SALT = "test.csv"


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("1", "01/15/2025", "01/20/2025", 10.0, "5", "José", "shop 1", "Travel", "ACC-1"),
        ("2", "bad", "02/20/2025", -3.5, "$5", "Jose", "shop 2", "Shopping", "ACC-2"),
        ("3", None, None, None, None, None, None, None, None),
        ("4", "12/31/9999", "03/01/2025", 0.001, "0.001", "李明", "shop 1", "Travel", "ACC-1"),
        ("5", "01/15/2025", "01/20/2025", 10.0, "5", "José", "shop 1", "Shopping", "ACC-1"),
    ]
    return spark.createDataFrame(
        rows,
        "row_key STRING, day STRING, second STRING, amount DOUBLE, text STRING, who STRING, what STRING, kind STRING, account STRING",
    )


@pytest.fixture(scope="module")
def masked(table):
    return mask_table(table, POLICY, SALT)


@pytest.fixture(scope="module")
def pairs(table):
    return mask_side_by_side(table, POLICY, SALT)


def by_column(report, measure):
    return {r["column"]: r[measure] for r in report.collect()}


def test_clean_table(table, masked, pairs):
    cols = list(POLICY)
    reports = [
        A.audit_row_count(table, masked), A.audit_null_counts(table, masked, cols),
        A.audit_null_mask(A.pair_tables(table, masked, "row_key", cols), cols), A.audit_null_mask(pairs, cols),
        A.audit_deterministic(masked, mask_table(table, POLICY, SALT)), A.audit_consistent(pairs, "what", ["kind"]),
        A.audit_pool(pairs, POLICY), A.audit_untouched(table, masked, POLICY), A.audit_column_order(table, POLICY, SALT),
        A.audit_encoding(pairs, ["who"]), A.audit_interval(pairs, "second", "second"),
    ]
    assert A.all_ok(*reports).first()["ok"] is True


def test_lost_rows_and_values_are_found(table, masked):
    assert tuple(A.audit_row_count(table, masked.limit(3)).first()) == (5, 3, False)
    assert tuple(A.audit_row_count(table.where("false"), masked.where("false")).first()) == (0, 0, True)
    broken = masked.withColumn("who", F.when(F.col("row_key") != "1", F.col("who")))
    assert by_column(A.audit_null_counts(table, broken, ["who", "day"]), "ok") == {"who": False, "day": True}
    # The same number of NULLs in other rows passes the count and fails the row test.
    moved = masked.withColumn("who", F.when(F.col("row_key") == "3", "x").when(F.col("row_key") != "1", F.col("who")))
    assert by_column(A.audit_null_counts(table, moved, ["who"]), "ok") == {"who": True}
    paired = A.pair_tables(table, moved, "row_key", ["who"])
    assert by_column(A.audit_null_mask(paired, ["who"]), "violations") == {"who": 2}
    flags = A.pair_tables(table, moved, "row_key", ["who"], nulls_only=True)
    assert by_column(A.audit_null_mask(flags, ["who"]), "violations") == {"who": 2}
    assert "SortAggregate" not in flags._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_stored_tables_equal_pairs_in_one_pass(table, masked, pairs):
    cols = [c for c in POLICY]
    joined = A.pair_tables(table, masked, "row_key", cols).drop("rows_original", "rows_masked")
    same = pairs.select(*joined.columns)
    assert joined.exceptAll(same).isEmpty() and same.exceptAll(joined).isEmpty()


def test_repeated_keys_do_not_multiply(spark):
    df = spark.createDataFrame([("k", "a")] * 1000 + [("other", "b")], "row_key STRING, name STRING")
    paired = A.pair_tables(df, df.where("row_key = 'k'"), "row_key", ["name"])
    assert paired.count() == 2
    got = {r.row_key: (r.rows_original, r.rows_masked) for r in A.unpaired(paired).collect()}
    assert got == {"k": (1000, 1000), "other": (1, 0)}


def test_leaks(spark):
    df = spark.createDataFrame([("France",), ("Peru",), ("Atlantis",), (None,)], "country STRING")
    out = spark.createDataFrame([("Peru",), ("Atlantis",), (None,)], "country STRING")
    got = {r.value: r.in_pool for r in A.audit_leak(df, out, "country", list(COUNTRIES)).collect()}
    assert got == {"Peru": True, "Atlantis": False}


def test_unchanged_and_unconverted(table, pairs):
    unchanged = {r["column"]: (r["rows"], r["compared"], r.unchanged) for r in A.audit_unchanged(pairs, list(POLICY)).collect()}
    assert unchanged["day"] == (5, 4, 2) and unchanged["account"] == (5, 4, 4) and unchanged["who"] == (5, 4, 0)
    assert by_column(A.audit_unconverted(table, POLICY, SALT), "unconverted") == {
        "day": 2, "second": 0, "amount": 0, "text": 1, "who": 0, "what": 0, "account": 4,
    }


def test_differences_count_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "i INT, t STRING")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "i INT, t STRING")
    assert tuple(A.audit_deterministic(a, b).first()) == (1, 1, False)
    assert tuple(A.audit_deterministic(a, a).first()) == (0, 0, True)


def test_changed_untouched_column(table, masked):
    report = A.audit_untouched(table, masked.withColumn("kind", F.lit("x")), POLICY)
    assert report.first()["ok"] is False


def test_inconsistent_outputs(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "v STRING, v__masked STRING, g INT")
    assert tuple(A.audit_consistent(df, "v").first()) == (2, 1, False)
    assert tuple(A.audit_consistent(df, "v", ["g"]).first()) == (3, 0, True)
    gaps = spark.createDataFrame([("a", "x"), ("a", None), ("b", None), ("b", None)], "v STRING, v__masked STRING")
    assert tuple(A.audit_consistent(gaps, "v").first()) == (2, 1, False)
    plan = A.audit_consistent(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_collisions(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), (None, None)], "v STRING, v__masked STRING")
    assert {tuple(r) for r in A.audit_collision(df, "v").collect()} == {("x", 2, 3), ("y", 1, 1)}
    assert tuple(A.audit_collision_estimate(df, ["v"]).first()) == ("v", 3, 2)


def test_words_outside_the_pool(table):
    pairs = mask_side_by_side(table, POLICY, SALT).withColumn("who__masked", F.lit("Nobody"))
    assert by_column(A.audit_pool(pairs, POLICY), "outside") == {"who": 5, "what": 0}


def test_salt_effect_and_range(spark, table):
    changed = by_column(A.audit_salt_effect(table, POLICY, "file_a.csv", "file_b.csv"), "changed")
    assert changed["second"] == 4 and changed["who"] == 0 and changed["what"] == 0 and changed["amount"] == 3
    files = spark.range(20000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"))
    report = A.audit_salt_range(files, "name").first()
    assert report.ok and report.min_offset >= 180 and report.max_offset <= 730 and report.max_multiplier <= 3.5


def test_signs(pairs):
    got = {r["column"]: (r["compared"], r["changed"], r["to_zero"]) for r in A.audit_sign(pairs, ["amount", "text"]).collect()}
    assert got == {"amount": (4, 0, 1), "text": (3, 0, 1)}
    flipped = pairs.withColumn("amount__masked", -F.col("amount__masked"))
    assert by_column(A.audit_sign(flipped, ["amount"]), "changed") == {"amount": 3}


def test_intervals(pairs):
    # The overflowing and the unreadable date stay as they are, so their intervals change.
    assert tuple(A.audit_interval(pairs, "day", "second").first()) == (3, 1, False)
    assert A.audit_interval(pairs.where("row_key <> '4'"), "day", "second").first()["ok"] is True


def test_encoding_loss(pairs):
    got = A.audit_encoding(pairs.withColumn("who__masked", F.lit(None).cast("string")), ["who"]).first()
    assert (got.non_ascii, got.lost, got.ok) == (3, 3, False)


def test_outputs_of_the_ascii_part_and_constants_are_wrong(spark, table):
    from maskloom.functions.fields import mask_name

    bare = table.withColumn("who__masked", mask_name(F.regexp_replace("who", A.NON_ASCII, "")))
    got = A.audit_encoding(bare, ["who"]).first()
    assert got.wrong == got.like_ascii > 0 and not got.ok
    got = A.audit_encoding(table.withColumn("who__masked", F.lit("const")), ["who"]).first()
    assert (got.wrong, got.like_ascii, got.ok) == (3, 0, False)


def test_unchanged_values_of_stored_tables(spark, table, masked):
    lost = masked.where("row_key <> '1'").unionAll(masked.where("row_key = '2'"))
    grouped = A.pair_tables(table, lost, "row_key", ["day", "who"], hashes_only=True)
    assert "SortAggregate" not in grouped._jdf.queryExecution().executedPlan().toString()
    got = {r["column"]: (r.compared, r.unchanged, r.unpaired, r.ok) for r in A.audit_unchanged(grouped, ["day", "who"]).collect()}
    assert got == {"day": (2, 1, 2, False), "who": (2, 0, 2, False)}
    # Numbers of two types are compared as numbers.
    whole, real = spark.createDataFrame([("a", 5)], "k STRING, n INT"), spark.createDataFrame([("a", 5.0)], "k STRING, n DOUBLE")
    assert A.audit_unchanged(A.pair_tables(whole, real, "k", ["n"], hashes_only=True), ["n"]).first().unchanged == 1


def test_addresses_outside_the_pool(spark):
    pairs = spark.createDataFrame([("a", "nobody@example.com"), ("b", "plain"), ("c", "@"), (None, None)], "e STRING, e__masked STRING")
    assert A.audit_pool(pairs, {"e": "email"}).first().outside == 3


def test_report_is_counted_during_the_write(spark, masked):
    path = scratch_path(spark, "report")
    got = A.run_report(masked, POLICY, ["row_key", "kind"], path).first()
    assert tuple(got) == (7, 5, "row_key, kind") and spark.read.parquet(path).count() == 5


def test_null_mask_counts_keys_it_cannot_compare(spark):
    original = spark.createDataFrame([("k", None), ("k", "a"), ("m", "b")], "row_key STRING, who STRING")
    masked = spark.createDataFrame([("k", "x"), ("k", "b")], "row_key STRING, who STRING")
    [row] = A.audit_null_mask(A.pair_tables(original, masked, "row_key", ["who"]), ["who"]).collect()
    assert row.violations == 2 and not row.ok
