"""Whole-table masking: order, checks, NULLs, collisions and scripts."""

from __future__ import annotations

import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from maskloom.functions.pools import DEFAULT_POOLS, MERCHANTS
from maskloom.operators.masking import mask_column, mask_side_by_side, mask_table, mask_value, mask_values


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_mask_and_row_count(with_nulls, policy):
    masked = rows(mask_table(with_nulls, policy))
    assert [[x is None for x in r] for r in masked] == [[x is None for x in r] for r in rows(with_nulls)]


def test_nothing_original_remains(small, policy):
    masked, before = rows(mask_table(small, policy)), rows(small)
    for i in range(2):
        assert not {r[i] for r in masked} & {r[i] for r in before}


def test_equal_in_equal_out(colliding, policy):
    both = list(zip(rows(colliding), rows(mask_table(colliding, policy)), strict=True))
    for column in range(3):
        outputs = {}
        for before, after in both:
            assert outputs.setdefault(before[column], after[column]) == after[column]
        assert column == 2 or len(set(outputs.values())) > 1


def test_two_runs_and_any_column_order(small, policy):
    turned = small.select("country", "email", "name")
    assert rows(mask_table(small, policy)) == rows(mask_table(small, policy))
    assert rows(mask_table(turned, policy).select("name", "email", "country")) == rows(mask_table(small, policy))


def test_scripts_and_emoji(scripts, policy):
    masked = rows(mask_table(scripts, policy))
    assert all(all(r) for r in masked) and masked[3][0] != masked[4][0]


def test_card_payments(card_payments, card_policy):
    masked = mask_table(card_payments, card_policy, "test.csv")
    assert masked.columns == card_payments.columns
    got, before = rows(masked), rows(card_payments)
    assert [r[0] for r in got] == ["03/03/2026", "04/27/2026", "08/09/2026"]
    assert [r[1] for r in got] == ["987.06", "-62.84", "20.36"]
    assert all(r[2] in MERCHANTS[r[3]] for r in got) and [r[3] for r in got] == [r[3] for r in before]
    other = rows(mask_table(card_payments, card_policy, "file_b.csv"))
    assert other[0][0] != got[0][0] and other[0][2] == got[0][2]


def test_policy_order_decides_which_category_is_read(card_payments, card_policy):
    first = mask_table(card_payments, {"Category": "category", **card_policy}, "test.csv")
    assert all(r.Description in MERCHANTS["Default"] for r in first.collect())
    last = mask_table(card_payments, {**card_policy, "Category": "category"}, "test.csv")
    assert [r.Description for r in last.collect()] == [
        r.Description for r in mask_table(card_payments, card_policy, "test.csv").collect()
    ]


def test_description_may_name_itself_as_category(card_payments):
    rule = {"Category": {"type": "description", "category_column": "Category"}}
    got = mask_table(card_payments, rule).collect()
    assert got[0].Category in MERCHANTS["Travel"]


def test_salt_as_a_column(spark, card_payments, card_policy):
    both = card_payments.withColumn("file", F.lit("test.csv")).unionAll(card_payments.withColumn("file", F.lit("file_b.csv")))
    got = mask_table(both, card_policy, F.col("file"))
    for name in ("test.csv", "file_b.csv"):
        assert rows(got.where(F.col("file") == name).drop("file")) == rows(mask_table(card_payments, card_policy, name))


def test_checks_before_any_work(card_payments):
    with pytest.raises(KeyError, match="Gone"):
        mask_table(card_payments, {"Gone": "name", "Missing": "email"})
    with pytest.raises(KeyError, match="NoCategory"):
        mask_table(card_payments, {"Description": {"type": "description", "category_column": "NoCategory"}})
    with pytest.raises(KeyError):
        mask_table(card_payments, {"amount": "name"})  # names are case-sensitive
    with pytest.raises(ValueError, match="bogus"):
        mask_table(card_payments, {"Amount": "bogus"})
    with pytest.raises(ValueError):
        mask_table(card_payments, {"Amount": {"type": "date"}})
    with pytest.raises(KeyError):
        mask_table(card_payments, {"Description": {"type": "description"}})
    for salt in (None, ""):
        with pytest.raises(ValueError, match="salt"):
            mask_table(card_payments, {"Amount": "amount"}, salt)


def test_unreadable_values(spark):
    df = spark.createDataFrame([("2025-01-01", "$5"), ("01/01/2025", "5"), (None, None)], "d STRING, a STRING")
    rules = {"d": "date", "a": "amount"}
    assert rows(mask_table(df, rules, "test.csv"))[0] == ("2025-01-01", "$5")
    assert rows(mask_table(df, rules, "test.csv", on_error="null"))[0] == (None, None)
    with pytest.raises(Exception, match="could not be masked"):
        mask_table(df, rules, "test.csv", on_error="fail").collect()
    iso = mask_table(df, rules, "test.csv", formats={"d": ["yyyy-MM-dd"]})
    assert rows(iso)[0][0] == "2026-10-01"


def test_types_of_amounts_and_of_hashed_numbers(spark):
    df = spark.createDataFrame([(100, 2.5, 7)], "i INT, d DOUBLE, n INT")
    masked = mask_table(df, {"i": "amount", "d": "amount", "n": "name"}, "test.csv")
    assert dict(masked.dtypes) == {"i": "double", "d": "double", "n": "string"}
    text = spark.createDataFrame([("7",)], "n STRING")
    assert masked.first()["n"] == mask_table(text, {"n": "name"}).first()["n"]


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([("Ann", "x")], "`full.name` STRING, `odd ``tick` STRING")
    assert mask_table(df, {"full.name": "name", "odd `tick": "category"}).columns == df.columns


def test_one_column_and_unknown_type(small):
    masked = mask_column(small, "name", "name")
    assert [r[1:] for r in rows(masked)] == [r[1:] for r in rows(small)]
    with pytest.raises(ValueError):
        mask_value(F.col("name"), "bogus")
    assert rows(mask_column(small, "name", "id")) == rows(small)


def test_long_table(spark):
    values = {
        "name": "John Smith", "email": "john@example.com", "country": "US", "category": "small", "description": "shop",
        "amount": "100", "date": "01/01/2025", "id": "ACC-1",
    }
    rows_in = [*values.items(), ("date", "junk"), ("name", None), ("email", None)]
    df = spark.createDataFrame(rows_in, "t STRING, v STRING")
    got = [tuple(r) for r in mask_values(df, "v", "t", "test.csv").collect()]
    wide = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{t}` STRING" for t in values))
    expected = mask_table(wide, {t: t for t in values}, "test.csv").first().asDict()
    assert got == [*expected.items(), ("date", "junk"), ("name", None), ("email", None)]
    assert expected["name"] == "Eva Rossi" and expected["amount"] == "318.2" and expected["date"] == "10/01/2026"
    for bad in ("bogus", None):
        broken = spark.createDataFrame([(bad, "x")], "t STRING, v STRING")
        with pytest.raises(Exception, match="unsupported field type"):
            mask_values(broken, "v", "t", "test.csv").collect()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_is_one_projection_without_shuffle(spark, tmp_path, card_payments, card_policy):
    path = str(tmp_path / "p")
    card_payments.write.parquet(path)
    masked = mask_table(spark.read.parquet(path), card_policy, "test.csv")
    plan = plan_of(masked)
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Project") == 1
    pruned = plan_of(masked.where(F.col("Category") == "Travel").select("Amount"))
    assert "PushedFilters: [IsNotNull(Category), EqualTo(Category,Travel)]" in pruned
    assert "ReadSchema: struct<Amount:string,Category:string>" in pruned


def test_side_by_side_keeps_the_originals(card_payments, card_policy):
    pairs = mask_side_by_side(card_payments, card_policy, "test.csv")
    assert pairs.select(*[f"`{c}`" for c in card_payments.columns]).collect() == card_payments.collect()
    with pytest.raises(ValueError):
        mask_side_by_side(pairs, card_policy, "test.csv")


def test_a_missing_salt_is_an_error_in_rows_with_a_value(spark):
    df = spark.createDataFrame([(None, None), ("01/01/2025", "f")], "day STRING, file STRING")
    assert mask_table(df, {"day": "date"}, F.col("file")).count() == 2
    for salt in (None, ""):
        bad = spark.createDataFrame([("01/01/2025", salt)], "day STRING, file STRING")
        with pytest.raises(Exception, match="without a salt"):
            mask_table(bad, {"day": "date"}, F.col("file")).collect()


def test_pools_of_any_size(spark):
    sizes = dict(zip([k for k in DEFAULT_POOLS.merchants], range(101, 150, 4)))
    pools = replace(DEFAULT_POOLS, merchants={k: [f"{k}{i}" for i in range(n)] for k, n in sizes.items()})
    keys = list(sizes)
    df = spark.createDataFrame([(f"shop {i}", keys[i % len(keys)]) for i in range(60)], "what STRING, kind STRING")
    policy = {"what": {"type": "description", "category_column": "kind"}}
    for i, r in enumerate(mask_table(df, policy, pools=pools).collect()):
        assert r.what == f"{r.kind}{int(hashlib.md5(f'shop {i}'.encode()).hexdigest(), 16) % sizes[r.kind]}"
