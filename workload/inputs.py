"""Query inputs, derived from the given tables over all their rows.

The tables hold no NULLs and no bad values, so these views put some in by the row's key. The
SQL twins stand in ``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.functions.hashing import text_array
from maskloom.functions.pools import DEFAULT_CATEGORY, MERCHANTS
from maskloom.session import tune
from maskloom.sources.tables import NA_TOKENS

CATEGORY_KEYS = [key for key in MERCHANTS if key != DEFAULT_CATEGORY]
UNKNOWN_CATEGORY = "Groceries"
POOL_COUNTRIES = ["France", "Kenya", "Peru"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    word = F.get(text_array(POOL_COUNTRIES), (k % 3).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("row_key"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit("N/A")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 13 != 0, F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 5 == 0, word).otherwise(nation).alias("country"),
        F.col("c_mktsegment").alias("segment"),
        F.when(k % 19 != 0, F.col("c_acctbal")).alias("balance"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    padded = F.date_format(day, "MM/dd/yyyy")
    signed = F.when(k % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    category = F.get(text_array([*CATEGORY_KEYS, UNKNOWN_CATEGORY]), (k % 11).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("row_key"),
        F.when(k % 7 == 0, F.lit(None))
        .when(k % 11 == 0, F.lit("N/A"))
        .when(k % 13 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k % 17 == 0, F.date_format(day, "M/d/yyyy"))
        .otherwise(padded)
        .alias("order_date"),
        F.when(k % 7 != 0, F.date_format(F.date_add(day, (k % 5).cast("int")), "MM/dd/yyyy")).alias("post_date"),
        F.when(k % 23 != 0, signed).alias("amount"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 29 == 0, F.lit("$5")).otherwise(signed.cast("string")).alias("amount_text"),
        F.when(
            k % 31 != 0,
            F.concat_ws(" ", "o_orderstatus", "o_orderpriority", F.concat(F.lit("#"), F.col("o_custkey").cast("string"))),
        ).alias("description"),
        category.alias("category"),
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("ACC-"), F.col("o_custkey").cast("string")).alias("account_id"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its date as text; one column per field type that fits."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("ship_date"),
        "l_extendedprice",
        F.col("l_returnflag").alias("flag"),
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("supplier"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("@example.com")).alias("contact"),
        F.concat(F.lit("PART "), F.col("l_partkey").cast("string")).alias("memo"),
    )


def event_day(events: DataFrame) -> DataFrame:
    """Events with their day and user as text; works on streams too."""
    return events.withColumns(
        {
            "day": F.date_format("ts", "MM/dd/yyyy"),
            "user": F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")),
        }
    )


def names_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_name", F.col("p_partkey").cast("string"), F.lit(".csv")).alias("file_name")
    )


def clerks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People for the dirtying steps: some NULLs, and some addresses without ``@`` or a dot."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("row_key"),
        F.when(k % 101 != 0, F.concat(F.lit("Clerk "), F.col("o_orderstatus"), F.lit(" "), cust)).alias("name"),
        F.when(k % 103 == 0, F.lit(None))
        .when(k % 37 == 0, F.concat(F.lit("user"), cust))
        .otherwise(F.concat(F.lit("user"), cust, F.lit("@mail.example.com")))
        .alias("email"),
        F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("country"),
    )


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("row_key"))


def typed_values(spark: SparkSession, sf_dir: str, keep: list[str] = ()) -> DataFrame:
    """A long table: one row per payment and field type, with ``keep`` columns of the payment."""
    p = payments(spark, sf_dir)
    cells = {
        "name": "account_id",
        "email": "row_key",
        "country": "priority",
        "date": "order_date",
        "amount": "amount_text",
        "description": "description",
        "id": "account_id",
        "category": "category",
    }
    listed = F.array(*[F.struct(F.lit(t).alias("field_type"), F.col(c).alias("value")) for t, c in cells.items()])
    return p.select("row_key", *keep, F.inline(listed))


def null_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments whose description is one of the null words in some rows."""
    k = F.col("row_key").cast("bigint")
    word = F.get(text_array(NA_TOKENS), (k % len(NA_TOKENS)).cast("int"))
    return payments(spark, sf_dir).select(
        "row_key",
        F.when(k % 3 == 0, word).otherwise(F.col("description")).alias("description"),
        F.when(k % 4 == 0, F.lit("NA")).otherwise(F.col("priority")).alias("priority"),
    )


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that needs care in CSV: quotes, commas, outer blanks, empty text and NULL."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("row_key"),
        F.concat(F.lit('  "'), "c_name", F.lit('", ')).alias("label"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("")).otherwise(F.col("c_mktsegment")).alias("segment"),
    )


def rough_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV, one for each customer; the numbers tell which fault a line has."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_custkey")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    line = (
        F.when(n % 7 == 0, F.concat(k, F.lit(',5" pipe,3" of '), name))
        .when(n % 11 == 0, F.concat(k, F.lit(',5" pipe,'), segment, F.lit(',6" nut')))
        .when(n % 13 == 0, F.concat(k, F.lit(","), name, F.lit(","), segment, F.lit(",one,more")))
        .when(n % 17 == 0, F.concat(k, F.lit(',"quoted ""twice"", and a comma",'), segment, F.lit(',"x,y"')))
        .when(n % 5 == 0, F.concat(k, F.lit(","), name))
        .when(n % 3 == 0, F.concat(k, F.lit(',"'), name, F.lit(', ""Ltd""",'), segment))
        .otherwise(F.concat(k, F.lit(","), name, F.lit(","), segment))
    )
    return table(spark, sf_dir, "customer").select(line.alias("line"))


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON policy per part, with a plain, a detected, and a linked rule."""
    doc = F.concat(
        F.lit('{"source": "'), F.col("p_name"), F.lit('", "columns": {"'), F.col("p_brand"),
        F.lit('": "category", "amount": {"type": "amount", "confidence": 0.9, "category_column": "x"}, "memo": '),
        F.lit('{"type": "description", "category_column": "'), F.col("p_type"), F.lit('"}}}'),
    )
    return table(spark, sf_dir, "part").select("p_partkey", doc.alias("document"))


ANSWERS = [
    '{"type": "email", "confidence": 0.91}',
    '{"type": null, "confidence": 0.3}',
    '{"type": "planet", "confidence": 0.88}',
    "type=email; sure",
    '{"type": "name"}',
    '{"type": "name", "confidence": null}',
    '{"type": "date", "confidence": "0.75"}',
    '{"type": "id", "confidence": "high"}',
    "[]",
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k, F.get(text_array(ANSWERS), (k % len(ANSWERS)).cast("int")).alias("answer")
    )


FRAME_ROWS, FRAME_SAMPLE = 25, 2
#: Columns whose type is known; in scenario 3 the header names a type that the values don't have.
LABELLED = [
    ("name", 1, "name"), ("email", 1, "email"), ("country", 1, "country"), ("date", 1, "created_at"),
    ("amount", 1, "revenue"), ("description", 1, "merchant"), ("id", 1, "account_id"),
    ("name", 3, "priority"), ("email", 3, "account_id"), ("date", 3, "status"), ("amount", 3, "code"),
]


def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in frames of 25 keys; of each frame and labelled column, a sample of two values.

    ``position`` holds the frame, ``column`` the type and scenario the column stands for.
    """
    return _sampled_frames(unlabelled(spark, sf_dir), [(f"{kind}_{scenario}", c) for kind, scenario, c in LABELLED])


def _sampled_frames(df: DataFrame, cells: list[tuple[str, str]]) -> DataFrame:
    """Two values of each frame and cell, a label and the column it shows: the lowest by the hash of the row's key, then by value.

    Rows are thinned out before they become cells, so that no more than a few rows a frame are multiplied
    and sorted as cells. A row that two others of its frame precede, with values in the same columns, is in no
    sample. Rows of equal hashes stay, as the value decides between them.
    """
    columns = sorted({c for _, c in cells})
    frame = F.floor(F.col("row_key").cast("bigint") / FRAME_ROWS).cast("int")
    held = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))  # a bit for each column
    # The digest's bytes sort as its hex digits do, in half the space.
    rows = df.select(frame.alias("position"), F.unhex(F.md5("row_key")).alias("hash"), held.alias("held"), *columns)
    before = F.rank().over(Window.partitionBy("position", "held").orderBy("hash"))
    rows = rows.withColumn("before", before).where(F.col("before") <= FRAME_SAMPLE)
    listed = F.array(*[F.struct(F.lit(label).alias("column"), F.col(c).alias("value")) for label, c in cells])
    long = rows.select("position", "hash", F.inline(listed))
    rank = F.row_number().over(Window.partitionBy("position", "column").orderBy("hash", "value"))
    return long.where(F.col("value").isNotNull()).withColumn("rn", rank).where(F.col("rn") <= FRAME_SAMPLE).drop("hash")


def mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose dates stand in three patterns, beside whole numbers that are keys and ones that are money."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("row_key"),
        F.date_format(day, "yyyy-MM-dd").alias("iso_day"),
        F.date_format(day, "dd.MM.yyyy").alias("dotted_day"),
        F.when(k % 2 == 0, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "MM/dd/yyyy")).alias("mixed_day"),
        (k * 37 + 100000).cast("string").alias("account"),
        F.col("o_totalprice").alias("price"),
    )


DETECT_COLUMNS = [
    "name", "email", "country", "created_at", "revenue", "merchant", "account_id", "status", "priority", "rare", "empty",
    "code",
]


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table to detect: business columns per order, table columns, a sparse and an empty one."""
    from maskloom.operators.generate import business

    k = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("row_key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(k % 997 == 0, F.concat(F.lit("r"), k.cast("string"), F.lit("@rare.example"))).alias("rare"),
        F.lit(None).cast("string").alias("empty"),
        F.get(text_array(["US", "DE", "JP", "BR", "ZZ"]), (F.col("o_custkey") % 5).cast("int")).alias("code"),
    )
    return business(base, "row_key").select("row_key", *DETECT_COLUMNS)


#: Columns of the 21 frames: the type in question, the scenario, the header, and the column of ``unlabelled`` the values
#: come from. The first scenario has a fitting header, the second one that says nothing, the third one that is wrong.
FRAMES = [(kind, 1, kind, column) for kind, scenario, column in LABELLED if scenario == 1]
FRAMES += [(kind, 2, f"col_{i}", column) for i, (kind, scenario, column) in enumerate(LABELLED) if scenario == 1]
FRAMES += [
    ("name", 3, "full_name", "priority"), ("email", 3, "email_address", "account_id"), ("country", 3, "nation", "status"), ("date", 3, "created_on", "status"),
    ("amount", 3, "total", "code"), ("description", 3, "memo", "status"), ("id", 3, "account_no", "priority"),
]


def framed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in frames of 25 keys; of each frame and column of the 21, a sample of two values under its header."""
    return _sampled_frames(unlabelled(spark, sf_dir), [(header, c) for _, _, header, c in FRAMES])


DATE_COLUMNS = ["months_first", "days_first", "unclear", "iso", "mixed", "month_name", "short_month", "stamped", "two_digits", "no_date"]


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' days in many patterns; ``unclear`` has only days up to the twelfth."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    write = lambda pattern: F.date_format(day, pattern)
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("row_key"), write("MM/dd/yyyy").alias("months_first"), write("dd/MM/yyyy").alias("days_first"),
        F.when(F.dayofmonth(day) <= 12, write("dd/MM/yyyy")).alias("unclear"), write("yyyy-MM-dd").alias("iso"),
        F.when(k % 3 == 0, write("dd.MM.yyyy")).when(k % 3 == 1, write("yyyy/MM/dd")).otherwise("none").alias("mixed"),
        write("MMMM d, yyyy").alias("month_name"), write("dd-MMM-yyyy").alias("short_month"),
        F.concat(write("yyyy-MM-dd"), F.lit(" 10:00:12")).alias("stamped"), write("MM/dd/yy").alias("two_digits"), F.col("o_orderpriority").alias("no_date"),
    )


def hard_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that rules take for something else: dates in many patterns, keys, money, names and labels."""
    from maskloom.operators.generate import business

    k, price = F.col("row_key").cast("bigint"), F.abs(F.col("revenue").cast("double"))
    labels = F.array(*[F.lit(x) for x in ("Food & Drink", "Travel", "Home & Garden", "Gifts")])
    made = business(written_dates(spark, sf_dir), "row_key")
    digest = F.md5("row_key")
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    last, first = F.substring_index("name", " ", -1), F.substring_index("name", " ", 1)
    return made.select(
        "row_key", *DATE_COLUMNS[:-1], F.concat(F.lit("CUST"), F.lpad(k.cast("string"), 7, "1")).alias("customer_ref"), uuid.alias("token"),
        F.upper("name").alias("in_capitals"), F.concat(last, F.lit(", "), first).alias("turned"), F.element_at(labels, (k % 4 + 1).cast("int")).alias("kind"),
        F.floor(price).cast("string").alias("Amount"), F.concat(F.lit("$"), F.format_number(price, 2)).alias("paid"),
        F.replace(F.format_string("%.2f", price), F.lit("."), F.lit(",")).alias("paid_eur"),
        F.concat(F.lit("+1 555 "), F.lpad((k % 900 + 100).cast("string"), 3, "0"), F.lit(" "), F.lpad((k % 9000 + 1000).cast("string"), 4, "0")).alias("mobile"),
    )


#: What ``hard_columns`` hold, but for ``mixed``: a third of its values are no dates, so it is not sure to be one.
HARD_TYPES = {
    **{c: "date" for c in DATE_COLUMNS[:-1] if c != "mixed"}, "customer_ref": "id", "token": "id", "in_capitals": "name", "turned": "name", "kind": "category",
    "Amount": "amount", "paid": "amount", "paid_eur": "amount", "mobile": "id",
}
