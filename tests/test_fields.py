"""Field rules against Python's own arithmetic, and golden values."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskloom.functions import fields
from maskloom.functions.hashing import MAX_MODULUS, md5_index
from maskloom.functions.pools import CATEGORIES, DEFAULT_POOLS, MERCHANTS, NAMES, Pools


def md5_mod(text: str, n: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest(), 16) % n


def values(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "v STRING")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


GOLDEN = {
    "John Smith": (0, 4, 4, 24, 29),
    "Jane Smith": (4, 0, 12, 22, 12),
    "José": (3, 1, 9, 9, 4),
    "Jose": (0, 2, 14, 24, 24),
    "李明": (1, 3, 19, 19, 4),
    "small": (1, 3, 3, 13, 18),
    "Small": (2, 2, 2, 2, 22),
    "US": (0, 2, 2, 12, 27),
    "": (0, 6, 6, 6, 1),
}


def test_golden_indexes(spark):
    df = values(spark, GOLDEN)
    got = df.select("v", *[md5_index(F.col("v"), n) for n in (6, 8, 20, 30, 35)]).collect()
    assert {row[0]: tuple(row[1:]) for row in got} == GOLDEN


@pytest.mark.parametrize("n", [1, 2, 6, 7, 10, 24, 551, 2001, 2**17 + 1, 999_983, MAX_MODULUS])
def test_index_equals_python(spark, n):
    texts = [f"{i}é{'x' * (i % 90)}" for i in range(1500)]
    got = values(spark, texts).select("v", md5_index(F.col("v"), n).alias("i")).collect()
    assert all(row.i == md5_mod(row.v, n) for row in got)


def test_index_refuses_bad_moduli(spark):
    for n in (0, -1, MAX_MODULUS + 1):
        with pytest.raises(ValueError):
            md5_index(F.lit("x"), n)


def test_null_stays_null_in_every_rule(spark):
    df = spark.createDataFrame([(None,), ("a",), (None,)], "v STRING").repartition(1)
    rules = [
        fields.mask_name(F.col("v")),
        fields.mask_email(F.col("v")),
        fields.mask_country(F.col("v")),
        fields.mask_category(F.col("v")),
        fields.mask_description(F.col("v")),
        fields.mask_description(F.col("v"), F.lit("Travel")),
        fields.mask_date(F.col("v"), 10),
        fields.mask_amount(F.col("v"), 2.0, False),
    ]
    for codegen in ("true", "false"):
        df.sparkSession.conf.set("spark.sql.codegen.wholeStage", codegen)
        rows = df.select("v", *[r.alias(f"r{i}") for i, r in enumerate(rules)]).collect()
        assert all(x is None for row in rows if row.v is None for x in row)
    df.sparkSession.conf.set("spark.sql.codegen.wholeStage", "true")


def test_email_golden(spark):
    expected = {"john@example.com": (18, 2), "john1@example.com": (26, 0), "john2@example.com": (10, 5)}
    got = values(spark, expected).select("v", fields.mask_email(F.col("v")).alias("e")).collect()
    for row in got:
        user, domain = expected[row.v]
        assert row.e == f"{DEFAULT_POOLS.email_users[user]}@{DEFAULT_POOLS.email_domains[domain]}"


@pytest.mark.parametrize(
    "name, offset, factor",
    [
        ("test.csv", 638, 3.182),
        ("transactions.csv", 592, 3.193),
        ("file_a.csv", 210, 2.742),
        ("file_b.csv", 465, 3.274),
        ("orders.parquet", 494, 3.0220000000000002),
    ],
)
def test_salts(spark, name, offset, factor):
    assert one(spark, fields.derive_offset(name)) == offset
    assert one(spark, fields.derive_multiplier(name)) == factor


@pytest.mark.parametrize(
    "text, days, expected",
    [
        ("01/01/2025", 30, "01/31/2025"),
        ("12/15/2024", 30, "01/14/2025"),
        ("02/28/2024", 1, "02/29/2024"),
        ("1/5/2025", 0, "01/05/2025"),
        ("1/ 5/2025", 0, "01/05/2025"),
        ("12/ 5/2025", 0, "12/05/2025"),
        ("12/31/9999", 0, "12/31/9999"),
        ("12/31/9999", 1, None),
        ("06/15/9000", 365 * 1001, None),
        ("01/01/0000", 1, None),
        ("02/30/2025", 1, None),
        ("13/01/2025", 1, None),
        ("01/01/25", 1, None),
        ("2025-01-01", 1, None),
        (" 01/01/2025", 1, None),
        ("01/01/2025 ", 1, None),
        ("01/01/2025\n", 1, None),
        ("001/1/2025", 1, None),
        ("12/5T/2025", 1, None),
        ("1/1/+2025", 1, None),
        ("1/1/-2025", 1, None),
        ("", 1, None),
    ],
)
def test_date_edges(spark, text, days, expected):
    assert one(spark, fields.mask_date(F.lit(text), days)) == expected


def test_dates_equal_python(spark):
    rng = random.Random(7)
    texts = [f"{rng.randint(0, 13):02d}/{rng.randint(0, 32):02d}/{rng.randint(1000, 9999)}" for _ in range(1500)]
    texts += [f"{rng.randint(0, 13)}/{rng.randint(0, 32)}/{rng.randint(1000, 9990)}" for _ in range(1500)]

    def shifted(text):
        try:
            return (datetime.strptime(text, "%m/%d/%Y") + timedelta(days=638)).strftime("%m/%d/%Y")
        except (ValueError, OverflowError):
            return None

    got = values(spark, texts).select("v", fields.mask_date(F.col("v"), F.lit(638)).alias("d")).collect()
    assert [(r.v, r.d) for r in got if r.d != shifted(r.v)] == []


def test_further_date_formats_are_written_back_in_their_own_pattern(spark):
    assert one(spark, fields.mask_date(F.lit("2025-01-01"), 30, ["yyyy-MM-dd"])) == "2025-01-31"
    assert one(spark, fields.mask_date(F.lit("01/01/2025"), 30, ["yyyy-MM-dd"])) == "01/31/2025"


@pytest.mark.parametrize("factor", [2.0, 2.5, 1.5, 1.125, 2.734, 3.0220000000000002])
def test_amounts_equal_python(spark, factor):
    rng = random.Random(11)
    numbers = [i / 100 for i in range(-20000, 60000, 7)]
    numbers += [round(rng.uniform(-5e7, 5e7), 2) for _ in range(8000)] + [rng.uniform(-1e9, 1e9) for _ in range(2000)]
    numbers += [0.005, -0.005, 123456789012.345, 1e15 + 0.3, -0.001]
    df = spark.createDataFrame([(x,) for x in numbers], "a DOUBLE")
    text = fields.mask_amount(F.col("a").cast("string"), factor, False)
    rows = df.select("a", fields.mask_amount(F.col("a"), factor, True).alias("n"), text.alias("t")).collect()
    assert [r for r in rows if repr(r.n) != repr(round(r.a * factor, 2))] == []
    assert [r for r in rows if r.t != repr(round(r.a * factor, 2))] == []


def test_amounts_that_are_no_finite_number(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1e300,)], "a DOUBLE")
    got = [r[0] for r in df.select(fields.mask_amount(F.col("a"), 2.0, True)).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] == 2e300


@pytest.mark.parametrize(
    "text, expected",
    [
        ("100.00", "200.0"), ("-50.00", "-100.0"), ("  12.5 ", "25.0"), ("1e3", "2000.0"), ("+5", "10.0"), (".5", "1.0"),
        ("5.", "10.0"), ("inf", "inf"), ("-Infinity", "-inf"), ("nan", "nan"), ("10000000", "20000000.0"),
        ("1,234", None), ("$5", None), ("(5)", None), ("12d", None), ("12f", None), ("0x10", None), ("", None), ("N/A", None),
        ("1_000", None),
    ],
)
def test_amount_text(spark, text, expected):
    assert one(spark, fields.mask_amount(F.lit(text), 2.0, False)) == expected


def test_descriptions_by_category(spark):
    rows = [(f"shop {i}", c) for i in range(40) for c in [*MERCHANTS, "Nonexistent", None]]
    df = spark.createDataFrame(rows, "d STRING, c STRING")
    for row in df.select("d", "c", fields.mask_description(F.col("d"), F.col("c")).alias("m")).collect():
        pool = MERCHANTS.get(row.c, MERCHANTS["Default"])
        assert row.m == pool[md5_mod(row.d, len(pool))]


def test_descriptions_with_pools_of_other_sizes(spark):
    pools = Pools(merchants={"A": ("a1", "a2", "a3"), "B": ("b1",), "Default": ("d1", "d2", "d3", "d4", "d5")})
    df = spark.createDataFrame([(f"x{i}", c) for i in range(30) for c in ("A", "B", "C", None)], "d STRING, c STRING")
    for row in df.select("d", "c", fields.mask_description(F.col("d"), F.col("c"), pools).alias("m")).collect():
        pool = pools.merchants.get(row.c, pools.merchants["Default"])
        assert row.m == pool[md5_mod(row.d, len(pool))]


def test_category_is_case_sensitive_and_from_the_pool(spark):
    texts = ["S", "M", "L", "XL", "High", "small", "Small"]
    got = {r.v: r.c for r in values(spark, texts).select("v", fields.mask_category(F.col("v")).alias("c")).collect()}
    assert set(got.values()) <= set(CATEGORIES) and got["small"] != got["Small"]


def test_masked_name_is_pinned(spark):
    assert one(spark, fields.mask_name(F.lit("John Smith"))) == NAMES[4]


def test_pools_must_not_be_empty():
    with pytest.raises(ValueError):
        Pools(names=())
    with pytest.raises(ValueError):
        Pools(merchants={"Travel": ("a",)})


def test_on_error_choices(spark):
    bad, good = F.lit(None).cast("string"), F.lit("m")
    assert one(spark, fields.keep_on_error(bad, F.lit("o"))) == "o"
    assert one(spark, fields.keep_on_error(bad, F.lit("o"), "null")) is None
    assert one(spark, fields.keep_on_error(good, F.lit("o"), "fail")) == "m"
    with pytest.raises(Exception, match="could not be masked"):
        one(spark, fields.keep_on_error(bad, F.lit("o"), "fail"))
    with pytest.raises(ValueError):
        fields.keep_on_error(bad, good, "ignore")
