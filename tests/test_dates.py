"""Date patterns by elimination, and masking in the patterns found."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from maskloom.functions import dates, fields
from maskloom.operators.audit import audit_unconverted
from maskloom.operators.dates import date_patterns
from maskloom.operators.masking import mask_table

START = datetime.date(2021, 1, 9)
WRITTEN = {
    "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "yyyy/MM/dd": "%Y/%m/%d",
    "MM-dd-yyyy": "%m-%d-%Y", "dd-MM-yyyy": "%d-%m-%Y", "MM/dd/yy": "%m/%d/%y", "dd/MM/yy": "%d/%m/%y", "dd-MMM-yyyy": "%d-%b-%Y",
    "MMMM d, yyyy": "%B %-d, %Y", "MMM d, yyyy": "%b %-d, %Y", "d MMMM yyyy": "%-d %B %Y", "d MMM yyyy": "%-d %b %Y",
    "yyyy-MM-dd HH:mm": "%Y-%m-%d 10:20:30", "MM/dd/yyyy HH:mm": "%m/%d/%Y 10:20", "dd/MM/yyyy HH:mm": "%d/%m/%Y 9:05 PM",
}


def days(n, step=1):
    return [START + datetime.timedelta(days=step * i) for i in range(n)]


def table(spark, columns):
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in columns))


def test_every_pattern_is_found_and_masked_in_itself(spark):
    assert tuple(WRITTEN) == dates.PATTERNS
    df = table(spark, {p: [d.strftime(w) for d in days(300)] for p, w in WRITTEN.items()})
    found = {r["column"]: r for r in date_patterns(df, df.columns).collect()}
    assert {c: (r.patterns, r.ambiguous, r.dates, r.others) for c, r in found.items()} == {p: (p, False, 300, 0) for p in WRITTEN}
    policy = {p: {"type": "date", "formats": found[p].formats.split("; ")} if found[p].formats else "date" for p in WRITTEN}
    unread = audit_unconverted(df, policy, "x.csv").collect()
    assert all(r.unconverted == 0 for r in unread)
    offset = spark.range(1).select(fields.derive_offset("x.csv")).first()[0]
    moved = mask_table(df, policy, "x.csv").collect()
    for p, w in WRITTEN.items():
        assert [r[p] for r in moved] == [(d + datetime.timedelta(days=offset)).strftime(w) for d in days(300)], p


def test_one_late_day_decides_the_order(spark):
    early = [d for d in days(400) if d.day <= 12]
    late = datetime.date(2024, 2, 28)
    columns = {
        "unknown": [d.strftime("%d/%m/%Y") for d in early] + ["01/01/2024"],
        "days": [d.strftime("%d/%m/%Y") for d in early] + [late.strftime("%d/%m/%Y")],
        "months": [d.strftime("%d/%m/%Y") for d in early] + [late.strftime("%m/%d/%Y")],
    }
    got = {r["column"]: (r.patterns, r.formats, r.ambiguous) for r in date_patterns(table(spark, columns), list(columns)).collect()}
    assert got == {"unknown": ("MM/dd/yyyy", None, True), "days": ("dd/MM/yyyy", "dd/MM/yyyy", False), "months": ("MM/dd/yyyy", None, False)}


def test_mixed_columns_and_values_that_are_no_dates(spark):
    columns = {
        "mixed": ["2024-03-05", "05.03.2024", "28.02.2024", "March 5, 2024", None, "03/04/2024"],
        "clash": ["28/02/2024", "02/28/2024", "03/04/2024", None, None, None],
        "junk": ["2024-02-30", "13/13/2024", "x", "", "12345", "2024-03-05"],
        "none": [None] * 6,
    }
    got = {r["column"]: tuple(r)[2:] for r in date_patterns(table(spark, columns), list(columns)).collect()}
    assert got == {
        "mixed": (5, 0, "MM/dd/yyyy; yyyy-MM-dd; dd.MM.yyyy; MMMM d, yyyy", "yyyy-MM-dd; dd.MM.yyyy; MMMM d, yyyy", True),
        "clash": (3, 0, "MM/dd/yyyy; dd/MM/yyyy", "MM/dd/yyyy; dd/MM/yyyy", True),
        "junk": (1, 5, "yyyy-MM-dd", "yyyy-MM-dd", False),
    }
    assert date_patterns(table(spark, columns), []).count() == 0


@pytest.mark.parametrize(
    "value, formats, expected",
    [
        ("05/03/2024", ["dd/MM/yyyy"], "04/04/2024"), ("5/3/2024", ["dd/MM/yyyy"], "04/04/2024"), ("05/03/2024", ["MM/dd/yyyy", "dd/MM/yyyy"], "06/02/2024"),
        ("2024-03-05T23:59:59Z", ["yyyy-MM-dd HH:mm"], "2024-04-04T23:59:59Z"), ("05-Mar-2024", ["dd-MMM-yyyy"], "04-Apr-2024"),
        ("28/02/2024", ["yyyy-MM-dd"], None), ("9999-12-30", ["yyyy-MM-dd"], None), ("05/03/2024", ["dd.MM.yyyy"], "06/02/2024"),
    ],
)
def test_masking_in_patterns(spark, value, formats, expected):
    assert spark.range(1).select(fields.mask_date(F.lit(value), 30, formats)).first()[0] == expected


def test_elimination_is_one_scan_and_counts_move(spark, tmp_path):
    spark.range(1000).select(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "dd/MM/yyyy").alias("d"), F.lit("x").alias("o")).write.parquet(f"{tmp_path}/t")
    plan = date_patterns(spark.read.parquet(f"{tmp_path}/t"), ["d"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<d:string>" in plan and plan.index("Exchange") < plan.rindex("HashAggregate")


def test_two_digit_years(spark):
    got = spark.range(1).select(*[fields.mask_date(F.lit(v), 366, ["MM/dd/yy"]) for v in ("02/28/99", "02/28/00", "03/01/68", "03/01/69")]).first()
    assert tuple(got) == ("02/29/00", "02/28/01", "03/02/69", "03/02/70")
