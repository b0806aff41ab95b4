"""Generated tables and the dirtying steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskloom.operators import generate as G
from maskloom.operators import messiness as M
from maskloom.operators.selection import by_count
from maskloom.session import scratch_path

ROWS = 20000


@pytest.fixture(scope="module")
def base(spark):
    path = scratch_path(spark, "base")
    G.gen_base(spark, ROWS).write.parquet(path)
    return spark.read.parquet(path)


def changed(before, after, target):
    pairs = before.select("row_key", F.col(target).alias("a")).join(after.select("row_key", F.col(target).alias("b")), "row_key")
    return pairs.where(~F.col("a").eqNullSafe(F.col("b")))


def test_base_is_repeatable_and_weighted(spark, base):
    assert base.exceptAll(G.gen_base(spark, ROWS, partitions=3)).isEmpty()
    share = {r.country: r["count"] / ROWS for r in base.groupBy("country").count().collect()}
    assert len(share) == 31 and abs(share["US"] - 400 / 1010) < 0.02 and abs(share["JP"] - 50 / 1010) < 0.01
    assert base.where("name IS NULL OR email IS NULL OR country IS NULL").isEmpty()
    assert sum(G.COUNTRY_WEIGHTS.values()) == 1010 and set(G.pool_of_country()) == set(G.COUNTRY_WEIGHTS)
    assert not base.where("country = 'JP' AND name RLIKE '[A-Za-z]'").count()


def test_sample_table_shapes(spark):
    df = G.gen_sample(spark, 500)
    assert df.columns == ["name", "email", "country", "created_at", "revenue", "merchant", "account_id"] and df.count() == 500
    bad = df.where(
        ~F.col("created_at").rlike(r"^\d\d/\d\d/\d{4}$") | ~F.col("revenue").rlike(r"^\d+\.\d\d$")
        | ~F.col("revenue").cast("double").between(10, 5000) | ~F.col("account_id").rlike(r"^ACC-\d{5}$")
    )
    assert bad.isEmpty()


def test_exact_counts(base):
    nulls = M.mess_nulls(base, pick=by_count)
    got = nulls.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("country", "email", "name")]).first()
    assert tuple(got) == (int(ROWS * 0.05), int(ROWS * 0.02), int(ROWS * 0.01))
    assert M.mess_exact_duplicates(base, pick=by_count).count() == ROWS + int(ROWS * 0.02)
    assert changed(base, M.mess_subdomains(base, pick=by_count), "email").count() == int(ROWS * 0.01)


def test_exact_count_of_few_and_of_no_rows(base):
    few = base.where(F.col("row_key").cast("int") < 7)
    assert M.mess_nulls(few, pick=by_count).where("country IS NULL").count() == 0
    hundred = base.where(F.col("row_key").cast("int") < 100)
    assert M.mess_nulls(hundred, pick=by_count).where("country IS NULL").count() == 5


def test_exact_count_needs_unique_keys(base):
    with pytest.raises(ValueError, match="unique"):
        M.mess_nulls(base.withColumn("row_key", F.lit("x")), pick=by_count)


def near(count, rate, rows=ROWS):
    return abs(count - rows * rate) < 6 * (rows * rate) ** 0.5 + 1


def test_rates_of_nulls(base):
    nulls = M.mess_nulls(base).agg(*[F.count_if(F.col(c).isNull()) for c in ("country", "email", "name")]).first()
    assert all(near(n, r) for n, r in zip(nulls, (0.05, 0.02, 0.01)))


@pytest.mark.parametrize("step, rate", [("exact_duplicates", 0.02), ("name_collisions", 0.03), ("email_collisions", 0.01)])
def test_appended_copies(base, step, rate):
    with_null = M.mess_nulls(base)
    out = getattr(M, f"mess_{step}")(with_null)
    copies = out.join(with_null.select("row_key"), "row_key", "left_anti")
    assert near(copies.count(), rate) and out.select("row_key").distinct().count() == out.count()
    assert with_null.exceptAll(out).isEmpty()
    if step == "name_collisions":
        assert copies.where("email IS NOT NULL AND NOT email RLIKE '^alt_[0-9]{4}@example.com$'").isEmpty()
        assert not copies.where("email IS NULL").isEmpty()
    if step == "email_collisions":
        assert copies.where("name IS NOT NULL AND NOT name RLIKE '^Alt User [0-9]{3}$'").isEmpty()


NAME_STEPS = {
    "diacritics": (0.01, M.DIACRITIC_NAMES), "mixed_scripts": (0.005, M.MIXED_SCRIPT_NAMES),
    "single_word": (0.005, M.SINGLE_WORD_NAMES), "long_names": (0.003, M.LONG_NAMES), "numeric_names": (0.002, M.NUMERIC_NAMES),
}


@pytest.mark.parametrize("step", NAME_STEPS)
def test_replaced_names(base, step):
    rate, pool = NAME_STEPS[step]
    diff = changed(base, getattr(M, f"mess_{step}")(base), "name").collect()
    assert near(len(diff), rate) and {r.b for r in diff} <= set(pool)
    empty = base.withColumn("name", F.lit(None).cast("string"))
    assert near(changed(empty, getattr(M, f"mess_{step}")(empty), "name").count(), rate)


def test_names_changed_in_place(base):
    for r in changed(base, M.mess_emoji(base), "name").collect():
        assert r.b[:-1] == r.a and r.b[-1] in M.EMOJI
    for r in changed(base, M.mess_double_spaces(base), "name").collect():
        assert r.b == r.a.replace(" ", "  ", 1)
    cased = [(r.a, r.b) for r in changed(base, M.mess_mixed_case(base), "name").collect()]
    assert all(b in (a.upper(), a.lower()) for a, b in cased) and {b == a.upper() for a, b in cased} == {True, False}
    spaced = M.mess_whitespace(base)
    for target in ("name", "email"):
        diff = changed(base, spaced, target).collect()
        assert near(len(diff), 0.01) and all(r.b == f"  {r.a}  " for r in diff)


def test_addresses(spark, base):
    for r in changed(base, M.mess_unusual_tlds(base), "email").collect():
        assert r.b[len(r.a.rsplit(".", 1)[0]):] in M.UNUSUAL_TLDS
    for r in changed(base, M.mess_subdomains(base), "email").collect():
        assert r.b == r.a.replace("@", "@mail.")
    for r in changed(base, M.mess_plus_addressing(base), "email").collect():
        user, host = r.a.split("@")
        tag = r.b[len(user) + 4 : -len(host) - 1]
        assert r.b == f"{user}+tag{tag}@{host}" and 1 <= int(tag) <= 98
    for r in changed(base, M.mess_numeric_emails(base), "email").collect():
        number, host = r.b.split("@")
        assert 100000 <= int(number) <= 999998 and host == r.a.split("@")[1]
    odd = base.withColumn("email", F.lit("nothing"))
    for step in (M.mess_unusual_tlds, M.mess_subdomains, M.mess_plus_addressing, M.mess_numeric_emails):
        assert changed(odd, step(odd), "email").isEmpty()


def test_all_steps_equal_the_steps_one_by_one(base):
    chained = base
    for step in M.STEPS:
        chained = step(chained)
    whole = M.mess_all(base)
    assert whole.columns == base.columns and len(M.STEPS) == 17
    assert whole.exceptAll(chained).isEmpty() and chained.exceptAll(whole).isEmpty()


def test_all_steps_take_one_scan_and_no_shuffle(base):
    plan = M.mess_all(base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Union" not in plan


def test_exact_pipeline_row_count(spark):
    from maskloom.plans.jobs import volume_table_exact

    rows = 2000
    for rate in (0.02, 0.03, 0.01):
        rows += int(rows * rate)
    assert volume_table_exact(spark, 2000, scratch_path(spark, "exact")).count() == rows


def test_null_profile(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("b", "x"), ("c", "y")], "name STRING, email STRING")
    got = {r["column"]: (r.rows, r.nulls, r.null_pct) for r in M.null_profile(df, ["name", "email"]).collect()}
    assert got == {"name": (4, 1, 25.0), "email": (4, 2, 50.0)}
    assert M.null_profile(df.where("false"), ["name"]).first()["null_pct"] is None
