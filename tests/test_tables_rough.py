"""Rough CSV records, salts by row, multiset audits, and addresses that are distinct by construction."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions.fields import derive_multiplier, derive_offset
from maskloom.operators import audit, generate
from maskloom.operators.masking import mask_table
from maskloom.plans import jobs
from maskloom.sources import tables


def test_stray_quotes_lose_no_field(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b\n5" x,3,6" y\n1,2\n7" z,"q, ""r"""\n"open,9\n')
    with pytest.raises(Exception, match="surplus fields in .*in.csv: 5\" x,3,6\" y"):
        tables.csv_scan(spark, str(path), multi_line=False).collect()
    kept = [tuple(r) for r in tables.csv_scan(spark, str(path), multi_line=False, surplus="reject").collect()]
    assert kept == [("1", "2"), ('7" z', 'q, "r"'), ("open,9", None)]
    left = [tuple(r)[1:] for r in tables.csv_rejects(spark, str(path), multi_line=False).collect()]
    assert left == [(2, 3, '5" x,3,6" y')]
    with pytest.raises(ValueError, match="surplus is"):
        tables.csv_scan(spark, str(path), surplus="keep")


def test_field_count_equals_the_parser(spark, tmp_path):
    rng = random.Random(2)
    lines = []
    for i in range(3000):
        parts = [str(i)]
        for _ in range(rng.randint(1, 7)):
            plain = "".join(rng.choice('ab" x') for _ in range(rng.randint(0, 5)))
            quoted = '"' + "".join(rng.choice(["a", ",", '""', " "]) for _ in range(rng.randint(0, 5))) + '"'
            parts.append(quoted if rng.random() < 0.3 else plain)
        lines.append(",".join([*parts, "end"]))
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    schema = ", ".join(f"c{i} STRING" for i in range(14))
    parsed = spark.read.options(escape='"').schema(schema).csv(str(tmp_path)).collect()
    # The last field is never empty, so the parser's number of fields shows.
    wanted = {r[0]: max(i for i in range(14) if r[i] is not None) + 1 for r in parsed}
    rows = spark.createDataFrame([(line.split(",")[0], line) for line in lines], "key STRING, line STRING")
    found = {r[0]: r[1] for r in rows.select("key", tables.field_count(F.col("line"))).collect()}
    assert len(wanted) == 3000 and {k: (wanted[k], found[k]) for k in wanted if wanted[k] != found[k]} == {}


def test_rows_in_are_rows_out_and_rejected(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(500).select(F.when(F.col("id") % 3 == 0, F.concat(F.col("id").cast("string"), F.lit(',x" ,y" ,z'))).otherwise(F.col("id").cast("string")).alias("a,b")).write.options(
        header=True, sep="\u0001", quote="", escape=""
    ).csv(path)
    kept, left = tables.csv_scan(spark, path, surplus="reject"), tables.csv_rejects(spark, path)
    assert (kept.count(), left.count()) == (333, 167) and kept.where("b is not null").count() == 0


def test_mask_csv_looks_for_breaks_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('name\n"Ann\nLee"\n')
    calls, found = [], tables.has_quoted_breaks
    for module in (jobs, tables):
        monkeypatch.setattr(module, "has_quoted_breaks", lambda *args: calls.append(args) or found(*args))
    jobs.mask_csv(spark, str(tmp_path / "a.csv"), {"name": "name"}, str(tmp_path / "out"))
    assert len(calls) == 1


def test_salts_by_row_equal_salts_by_file(spark):
    rows = [(f"{1 + i % 12:02d}/{1 + i % 28:02d}/2023", i / 7, f"f{i % 3}.csv", "x") for i in range(60)]
    df = spark.createDataFrame(rows, "d STRING, a DOUBLE, file STRING, __offset STRING")
    policy = {"d": "date", "a": "amount"}
    found = mask_table(df, policy, F.col("file"))
    assert found.columns == df.columns
    by_file = [tuple(r) for i in range(3) for r in mask_table(df.where(f"file = 'f{i}.csv'"), policy, f"f{i}.csv").collect()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(by_file)
    for bad in ("", None):
        with pytest.raises(Exception, match="without a salt"):
            mask_table(df.withColumn("file", F.lit(bad).cast("string")), policy, F.col("file")).collect()
    empty = df.withColumns({"file": F.lit(None).cast("string"), "d": F.lit(None).cast("string"), "a": F.lit(None).cast("double")})
    assert mask_table(empty, policy, F.col("file")).where("d is null and a is null").count() == 60
    # A salt is hashed once for its shift and once for its factor.
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    masked, once = plan(mask_table(df, policy, F.col("file"))), plan(df.select(derive_offset(F.col("file")).alias("x"), derive_multiplier(F.col("file")).alias("y")))
    assert masked.count(":offset") == once.count(":offset") and masked.count(":multiplier") == once.count(":multiplier")


def test_multisets_are_compared_without_a_shuffle_of_rows(spark):
    a = spark.range(5000).select((F.col("id") % 700).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("y"))
    equal = audit.audit_deterministic(a, a.repartition(7).orderBy(F.desc("y")))
    assert [tuple(r) for r in equal.collect()] == [(0, 0, True)]
    assert "Exchange" not in equal._jdf.queryExecution().executedPlan().toString()
    # One value more, one copy less, and a NULL for an empty text.
    b = a.where("x <> 5 or y is null").unionAll(spark.createDataFrame([(1, "new"), (1, "new")], "x BIGINT, y STRING"))
    gone = a.where("x = 5 and y is not null").count()
    assert [tuple(r) for r in audit.audit_deterministic(a, b).collect()] == [(gone, 2, False)]
    assert [tuple(r) for r in audit.audit_deterministic(a, a.unionAll(a)).collect()] == [(0, 5000, False)]
    blank = a.withColumn("y", F.coalesce("y", F.lit("")))
    assert audit.audit_deterministic(a, blank).first().only_in_first == a.where("y is null").count()
    assert [tuple(r) for r in audit.audit_deterministic(a.where("false"), a.where("false")).collect()] == [(0, 0, True)]


def test_addresses_are_distinct_at_any_count(spark):
    numbers = spark.range(200_000).select(generate.permuted(F.col("id")).alias("p")).unionAll(
        spark.range((1 << 40) - 100_000, 1 << 40).select(generate.permuted(F.col("id")).alias("p"))
    )
    row = numbers.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert row[0] == 300_000 and row[1] >= 0 and row[2] < 1 << 40
    other = spark.range(1000).where(generate.permuted(F.col("id"), 7) == generate.permuted(F.col("id"), 8)).count()
    assert other < 5
    people = generate.gen_base(spark, 50_000, distinct_emails=True)
    assert people.columns == ["row_key", "name", "email", "country"] and people.select("email").distinct().count() == 50_000
    assert "Exchange" not in people._jdf.queryExecution().executedPlan().toString()
