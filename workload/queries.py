"""Every registered query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import fields
from maskloom.functions.hashing import digest_mod, md5_hex
from maskloom.functions.pools import COUNTRIES, Pools
from maskloom.operators import audit, dates, detect, generate, learned, messiness, policy, sketches
from maskloom.operators.masking import mask_column, mask_side_by_side, mask_table, mask_values
from maskloom.operators.selection import by_count
from maskloom.plans import jobs
from maskloom.session import scratch_path
from maskloom.sources import tables
from maskloom.streaming.stream import mask_stream, mask_stream_with_reports, stream_report
from workload import inputs

SALT = "orders.csv"
OTHER_SALT = "orders_2.csv"
CUSTOMER_POLICY = {"name": "name", "email": "email", "country": "country", "segment": "category"}
PAYMENT_POLICY = {
    "order_date": "date",
    "post_date": "date",
    "amount": "amount",
    "amount_text": "amount",
    "description": {"type": "description", "category_column": "category"},
    "account_id": "id",
}
CATEGORY_FIRST_POLICY = {"category": "category", "description": {"type": "description", "category_column": "category"}}
SHIPMENT_POLICY = {
    "ship_date": "date",
    "l_extendedprice": "amount",
    "flag": "category",
    "supplier": "name",
    "contact": "email",
    "memo": "description",
}
EVENT_POLICY = {"event_type": "category", "value": "amount", "day": "date", "user": "email"}
MODULI = (6, 8, 10, 20, 30, 35, 551, 2001)
#: Made by rule: ``Person 0`` and on.
MANY_NAMES = 200_000
QUERIES: dict = {}


def query(fn):
    """Register under the function's name; ``_query`` marks a name that an import holds already."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


# Sources and sinks


@query
def csv_scan(spark, sf_dir) -> DataFrame:
    """Whole documents through CSV: line breaks, quotes and four languages."""
    path = scratch_path(spark, "csv_scan")
    documents = inputs.table(spark, sf_dir, "documents")
    tables.csv_sink(documents.select("doc_id", "text", "lang", "source"), path)
    return tables.csv_scan(spark, path)


def _rough_csv(spark, sf_dir, label: str) -> str:
    """Records as they come from elsewhere: stray quotes, inch marks, short ones, and ones with too many fields."""
    path = scratch_path(spark, label)
    # Lines are written as they are: the header is the name of the only column.
    lines = inputs.rough_lines(spark, sf_dir).withColumnRenamed("line", "row_key,label,segment")
    lines.write.options(header=True, sep="\u0001", quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query
def csv_scan_rough(spark, sf_dir) -> DataFrame:
    """Records with as many fields as the header or fewer; none loses a field behind a stray quote."""
    return tables.csv_scan(spark, _rough_csv(spark, sf_dir, "csv_scan_rough"), surplus="reject")


@query
def csv_rejects(spark, sf_dir) -> DataFrame:
    """The other records, whole, with the number of their fields."""
    return tables.csv_rejects(spark, _rough_csv(spark, sf_dir, "csv_rejects")).drop("file_path")


@query
def mask_csv(spark, sf_dir) -> DataFrame:
    """The whole job over many files in two folders: CSV in, masked by policy, CSV out."""
    path = scratch_path(spark, "mask_csv")
    people = inputs.customers(spark, sf_dir).select("row_key", "name", "email", "country", "segment")
    half = F.pmod(F.col("row_key").cast("bigint"), F.lit(2))
    tables.csv_sink(people.withColumn("half", half), f"{path}/in", by_file="half")
    jobs.mask_csv(spark, f"{path}/in/*", CUSTOMER_POLICY, f"{path}/out")
    return tables.csv_scan(spark, f"{path}/out").select(*people.columns)


@query
def csv_na_normalise(spark, sf_dir) -> DataFrame:
    return tables.csv_na_normalise(inputs.null_words(spark, sf_dir))


@query
def csv_sink(spark, sf_dir) -> DataFrame:
    """The written lines as they stand in the files, without the header of each file."""
    path = scratch_path(spark, "csv_sink")
    tables.csv_sink(inputs.quoted(spark, sf_dir), path)
    return spark.read.text(path).where(F.col("value") != "row_key,label,segment").select(F.col("value").alias("line"))


@query
def anon_path(spark, sf_dir) -> DataFrame:
    return inputs.table(spark, sf_dir, "pages").select("page_id", tables.anon_path(F.col("url")).alias("output"))


@query
def parquet_scan(spark, sf_dir) -> DataFrame:
    return tables.parquet_scan(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name", "c_mktsegment"])


@query
def parquet_sink_roundtrip(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "parquet_sink")
    tables.parquet_sink(mask_table(inputs.payments(spark, sf_dir), PAYMENT_POLICY, SALT), path)
    return tables.parquet_scan(spark, path)


@query
def policy_normalise(spark, sf_dir) -> DataFrame:
    return policy.policy_normalise(inputs.policy_documents(spark, sf_dir), "document")


def _detections(spark, sf_dir) -> DataFrame:
    return detect.detect_columns(inputs.unlabelled(spark, sf_dir), row_key="row_key")


@query
def policy_table_write(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "policy")
    policy.policy_table_write(_detections(spark, sf_dir), path)
    return spark.read.parquet(path)


@query
def policy_table_read(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "policy")
    policy.policy_table_write(_detections(spark, sf_dir), path, "json")
    return policy.policy_table_read(spark, path, "json")


# Masking


@query
def md5_index(spark, sf_dir) -> DataFrame:
    documents = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    turns = inputs.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )
    # One digest per text, also where several moduli are asked for.
    hashed = documents.unionAll(turns).select("id", md5_hex(F.col("text")).alias("digest"))
    return hashed.select("id", *[digest_mod(F.col("digest"), n).cast("int").alias(f"i{n}") for n in MODULI])


@query
def mask_name(spark, sf_dir) -> DataFrame:
    people = inputs.customers(spark, sf_dir)
    vendors = inputs.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("row_key"), F.col("s_name").alias("name")
    )
    both = people.select("row_key", "name").unionAll(vendors)
    return both.select("row_key", fields.mask_name(F.col("name")).alias("name"))


@query
def mask_email(spark, sf_dir) -> DataFrame:
    return inputs.customers(spark, sf_dir).select("row_key", fields.mask_email(F.col("email")).alias("email"))


@query
def mask_country(spark, sf_dir) -> DataFrame:
    return inputs.customers(spark, sf_dir).select("row_key", fields.mask_country(F.col("country")).alias("country"))


@query
def mask_category(spark, sf_dir) -> DataFrame:
    parts = inputs.table(spark, sf_dir, "part")
    return parts.select("p_partkey", *[fields.mask_category(F.col(c)).alias(c) for c in ("p_type", "p_brand")])


@query
def mask_date(spark, sf_dir) -> DataFrame:
    offset = fields.derive_offset(SALT)
    return inputs.payments(spark, sf_dir).select(
        "row_key",
        fields.mask_date(F.col("order_date"), offset).alias("order_date"),
        fields.mask_date(F.col("order_date"), 30, ["yyyy-MM-dd"]).alias("with_iso"),
        fields.mask_date(F.col("post_date"), offset).alias("post_date"),
    )


@query
def mask_amount(spark, sf_dir) -> DataFrame:
    factor = fields.derive_multiplier(SALT)
    return inputs.payments(spark, sf_dir).select(
        "row_key",
        fields.mask_amount(F.col("amount"), factor, True).alias("amount"),
        fields.mask_amount(F.col("amount"), 2.5, True).alias("amount_ties"),
        fields.mask_amount(F.col("amount_text"), factor, False).alias("amount_text"),
    )


@query
def mask_description(spark, sf_dir) -> DataFrame:
    return inputs.payments(spark, sf_dir).select(
        "row_key", "category", fields.mask_description(F.col("description"), F.col("category")).alias("description")
    )


@query
def mask_description_default(spark, sf_dir) -> DataFrame:
    return inputs.payments(spark, sf_dir).select("row_key", fields.mask_description(F.col("description")).alias("description"))


@query
def mask_id(spark, sf_dir) -> DataFrame:
    return mask_column(inputs.payments(spark, sf_dir).select("row_key", "account_id"), "account_id", "id")


@query
def derive_offset(spark, sf_dir) -> DataFrame:
    files = inputs.names_of_files(spark, sf_dir)
    return files.select("file_name", fields.derive_offset(F.col("file_name")).alias("offset"))


@query
def derive_multiplier(spark, sf_dir) -> DataFrame:
    files = inputs.names_of_files(spark, sf_dir)
    return files.select("file_name", fields.derive_multiplier(F.col("file_name")).alias("multiplier"))


@query
def mask_value_dispatch(spark, sf_dir) -> DataFrame:
    return mask_values(inputs.typed_values(spark, sf_dir), "value", "field_type", SALT)


@query
def mask_value_dispatch_category(spark, sf_dir) -> DataFrame:
    """The same with the category of each payment, which chooses the pool of its description."""
    values = inputs.typed_values(spark, sf_dir, ["category"])
    return mask_values(values, "value", "field_type", SALT, category="category")


@query
def mask_safe(spark, sf_dir) -> DataFrame:
    """Unreadable dates and amounts kept, and dropped to NULL."""
    payments = inputs.payments(spark, sf_dir)
    day = fields.mask_date(F.col("order_date"), fields.derive_offset(SALT))
    amount = fields.mask_amount(F.col("amount_text"), fields.derive_multiplier(SALT), False)
    return payments.select(
        "row_key",
        fields.keep_on_error(day, F.col("order_date"), "keep").alias("date_kept"),
        fields.keep_on_error(day, F.col("order_date"), "null").alias("date_null"),
        fields.keep_on_error(amount, F.col("amount_text"), "keep").alias("amount_kept"),
        fields.keep_on_error(amount, F.col("amount_text"), "null").alias("amount_null"),
    )


@query
def mask_column_query(spark, sf_dir) -> DataFrame:
    return mask_column(inputs.customers(spark, sf_dir).select("row_key", "name", "email"), "name", "name")


@query
def mask_table_query(spark, sf_dir) -> DataFrame:
    return mask_table(inputs.payments(spark, sf_dir), PAYMENT_POLICY, SALT)


@query
def mask_table_customers(spark, sf_dir) -> DataFrame:
    return mask_table(inputs.customers(spark, sf_dir), CUSTOMER_POLICY)


def _many_names() -> Pools:
    return Pools(names=tuple(f"Person {i}" for i in range(MANY_NAMES)))


@query
def mask_table_many_names(spark, sf_dir) -> DataFrame:
    """A pool of 200,000 names, so that few inputs share an output."""
    customers = inputs.customers(spark, sf_dir).select("row_key", "name")
    return mask_table(customers, {"name": "name"}, pools=_many_names())


@query
def audit_pool_many_names(spark, sf_dir) -> DataFrame:
    """The outputs of that pool and of the short ones beside it."""
    pairs = mask_side_by_side(inputs.customers(spark, sf_dir), CUSTOMER_POLICY, pools=_many_names())
    return audit.audit_pool(pairs, CUSTOMER_POLICY, _many_names())


@query
def mask_table_category_first(spark, sf_dir) -> DataFrame:
    """The category is masked before the description reads it, so all rows use Default."""
    payments = inputs.payments(spark, sf_dir).select("row_key", "category", "description")
    return mask_table(payments, CATEGORY_FIRST_POLICY)


@query
def mask_table_many_files(spark, sf_dir) -> DataFrame:
    """Each row carries its file's name, which sets its own shift and factor."""
    payments = inputs.payments(spark, sf_dir).withColumn("file_name", F.concat("priority", F.lit(".csv")))
    kept = payments.select("row_key", "file_name", "post_date", "amount")
    return mask_table(kept, {"post_date": "date", "amount": "amount"}, F.col("file_name"))


@query
def mask_table_shipments(spark, sf_dir) -> DataFrame:
    return mask_table(inputs.shipments(spark, sf_dir), SHIPMENT_POLICY, "lineitem.csv")


@query
def mask_stream_query(spark, sf_dir) -> DataFrame:
    """The events as a file stream, read to its end, next to their masked parquet."""
    schema = inputs.table(spark, sf_dir, "events").schema
    output = scratch_path(spark, "mask_stream")
    stream = mask_stream(
        spark, f"{sf_dir}/events*.parquet", schema, EVENT_POLICY, "events.csv", output,
        scratch_path(spark, "mask_stream_checkpoint"), prepare=inputs.event_day,
    )
    stream.awaitTermination()
    return spark.read.parquet(output).select("event_id", *EVENT_POLICY)


@query
def stream_report_query(spark, sf_dir) -> DataFrame:
    """The events as a file stream, and the sum of its batches' reports after a restart that finds nothing new."""
    schema = inputs.table(spark, sf_dir, "events").schema
    output, reports, checkpoint = (scratch_path(spark, f"mask_stream_report_{x}") for x in ("out", "reports", "checkpoint"))
    for _ in range(2):
        mask_stream_with_reports(
            spark, f"{sf_dir}/events*.parquet", schema, EVENT_POLICY, "events.csv", output, reports, checkpoint,
            prepare=inputs.event_day,
        ).awaitTermination()
    return stream_report(spark, reports)


# Detection


def _halves(df: DataFrame, key: str) -> list[DataFrame]:
    """A table in two parts, as if they came one after the other."""
    late = F.xxhash64(key) < 0
    return [df.where(~late), df.where(late)]


def _merged_sketch(spark, df: DataFrame, key: str, make, merge) -> DataFrame:
    """Each part sketched and stored; the stored sketches merged."""
    stored = []
    for part in _halves(df, key):
        path = scratch_path(spark, "sketch")
        make(part).write.parquet(path)
        stored.append(spark.read.parquet(path))
    return merge(*stored)


@query
def sample_column_one_scan(spark, sf_dir) -> DataFrame:
    """The sample of ``sample_column`` from one scan."""
    return sketches.sample_of(sketches.column_sketch(inputs.unlabelled(spark, sf_dir), inputs.DETECT_COLUMNS, "row_key"))


@query
def detect_columns_merged(spark, sf_dir) -> DataFrame:
    """Detection by stored sketches of two parts of the table."""
    df = inputs.unlabelled(spark, sf_dir)
    sketch = _merged_sketch(
        spark, df, "row_key", lambda part: sketches.column_sketch(part, row_key="row_key"), sketches.merge_column_sketches
    )
    return detect.detect_columns(df, row_key="row_key", sample=sketches.sample_of(sketch))


@query
def sample_column(spark, sf_dir) -> DataFrame:
    return detect.sample_column(inputs.unlabelled(spark, sf_dir), inputs.DETECT_COLUMNS, row_key="row_key")


@query
def classify_columns(spark, sf_dir) -> DataFrame:
    return detect.classify_columns(sample_column(spark, sf_dir))


@query
def parse_classification(spark, sf_dir) -> DataFrame:
    return detect.parse_classification(inputs.answers(spark, sf_dir), "answer").drop("answer")


@query
def detect_columns(spark, sf_dir) -> DataFrame:
    return _detections(spark, sf_dir)


@query
def build_policy(spark, sf_dir) -> DataFrame:
    return detect.build_policy(_detections(spark, sf_dir))


@query
def proposal_report(spark, sf_dir) -> DataFrame:
    return detect.proposal_report(_detections(spark, sf_dir))


@query
def detect_accuracy(spark, sf_dir) -> DataFrame:
    """The classifier's own answers on labelled columns, in frames of 25 rows.

    A column's header is no input of the classifier, so the second scenario, which changes headers
    only, would repeat the first.
    """
    parts = F.split("column", "_")
    found = detect.classify_columns(inputs.frame_samples(spark, sf_dir)).select(
        parts[0].alias("col_type"), parts[1].cast("int").alias("scenario"), F.col("type").alias("predicted"), "confidence"
    )
    return detect.detect_accuracy(found)


@query
def date_patterns(spark, sf_dir) -> DataFrame:
    """What each date column is written in, by elimination over all its values."""
    return dates.date_patterns(inputs.written_dates(spark, sf_dir), inputs.DATE_COLUMNS)


@query
def detect_trained(spark, sf_dir) -> DataFrame:
    """The trained scorer on columns that the rules mistake, and the date patterns of all their values."""
    found = learned.propose(inputs.hard_columns(spark, sf_dir), row_key="row_key")
    return found.where(F.col("column").isin(*inputs.HARD_TYPES)).select("column", "type", "formats", "status", "ambiguous")


@query
def detect_accuracy_trained(spark, sf_dir) -> DataFrame:
    """The trained scorer on all 21 columns, headers included, in frames of 25 rows: how many there are, and whether
    nine tenths of the core columns are named and no misleading header is followed."""
    known = {header: (kind, scenario) for kind, scenario, header, _ in inputs.FRAMES}
    pick = lambda i: F.create_map(*[F.lit(x) for header, of in known.items() for x in (header, of[i])])[F.col("column")]
    found = learned.classify(inputs.framed_samples(spark, sf_dir))
    parts = detect.detect_accuracy(found.select(pick(0).alias("col_type"), pick(1).alias("scenario"), F.col("type").alias("predicted"), "confidence"))
    return parts.where("part <> 'overall'").select("part", "total", F.coalesce("meets_bar", F.col("pct") == 100).alias("holds"))


@query
def mask_detected_dates(spark, sf_dir) -> DataFrame:
    """Every date column masked in the patterns found, days first included; nothing is left unconverted."""
    written = inputs.written_dates(spark, sf_dir).select("row_key", *inputs.DATE_COLUMNS[:-1])
    found = dates.date_patterns(written, inputs.DATE_COLUMNS[:-1]).collect()  # a row for each column
    policy_of = {r["column"]: {"type": "date", "formats": r["formats"].split("; ")} if r["formats"] else "date" for r in found}
    return mask_table(written, policy_of, SALT)


@query
def sample_column_keyless(spark, sf_dir) -> DataFrame:
    """Columns of few values in a table without a key: how many values were drawn, and how many different ones."""
    flags = inputs.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    sample = detect.sample_column(flags)
    return sample.groupBy("column").agg(F.count("value").alias("drawn"), F.countDistinct("value").alias("different"))


@query
def detect_then_mask(spark, sf_dir) -> DataFrame:
    """Detection, a policy file, and masking by it: dates in every pattern move, keys stay."""
    with tempfile.TemporaryDirectory() as folder:  # the file is the driver's own; its entries go into the plan
        return jobs.detect_and_mask(spark, inputs.mixed_dates(spark, sf_dir), f"{folder}/policy.yaml", SALT, "row_key").select(
            "row_key", "iso_day", "dotted_day", "mixed_day", "account", "price"
        )


# Test tables


@query
def gen_base(spark, sf_dir) -> DataFrame:
    return generate.people(inputs.order_keys(spark, sf_dir), "row_key")


@query
def gen_base_distinct(spark, sf_dir) -> DataFrame:
    """People with an address of their own each, by a keyed permutation of the row number."""
    return generate.distinct_people(inputs.order_keys(spark, sf_dir), "row_key", F.col("row_key").cast("long"))


@query
def gen_sample(spark, sf_dir) -> DataFrame:
    return generate.business(inputs.order_keys(spark, sf_dir), "row_key")


for _step in messiness.STEPS:
    QUERIES[_step.__name__] = lambda spark, sf_dir, step=_step: step(inputs.clerks(spark, sf_dir))


@query
def mess_all(spark, sf_dir) -> DataFrame:
    return messiness.mess_all(inputs.clerks(spark, sf_dir))


@query
def mess_nulls_by_count(spark, sf_dir) -> DataFrame:
    """Exactly ``int(rows * rate)`` NULLs per column."""
    return messiness.mess_nulls(inputs.clerks(spark, sf_dir), pick=by_count)


@query
def mess_exact_duplicates_by_count(spark, sf_dir) -> DataFrame:
    return messiness.mess_exact_duplicates(inputs.clerks(spark, sf_dir), pick=by_count)


@query
def null_profile(spark, sf_dir) -> DataFrame:
    return messiness.null_profile(messiness.mess_all(inputs.clerks(spark, sf_dir)), ["name", "email", "country"])


# Audits


def _payments(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    payments = inputs.payments(spark, sf_dir)
    return payments, mask_table(payments, PAYMENT_POLICY, SALT)


def _payment_pairs(spark, sf_dir) -> DataFrame:
    return mask_side_by_side(inputs.payments(spark, sf_dir), PAYMENT_POLICY, SALT)


def _customer_pairs(spark, sf_dir) -> DataFrame:
    return mask_side_by_side(inputs.customers(spark, sf_dir), CUSTOMER_POLICY)


@query
def run_report(spark, sf_dir) -> DataFrame:
    _, masked = _payments(spark, sf_dir)
    return audit.run_report(masked, PAYMENT_POLICY, ["row_key", "category", "priority"], scratch_path(spark, "run_report"))


@query
def audit_row_count(spark, sf_dir) -> DataFrame:
    return audit.audit_row_count(*_payments(spark, sf_dir))


@query
def audit_null_counts(spark, sf_dir) -> DataFrame:
    return audit.audit_null_counts(*_payments(spark, sf_dir), list(PAYMENT_POLICY))


@query
def audit_null_mask(spark, sf_dir) -> DataFrame:
    """Original and masked rows brought together by key, as for two stored tables."""
    pairs = audit.pair_tables(*_payments(spark, sf_dir), "row_key", list(PAYMENT_POLICY), nulls_only=True)
    return audit.audit_null_mask(pairs, list(PAYMENT_POLICY))


@query
def audit_leak(spark, sf_dir) -> DataFrame:
    customers = inputs.customers(spark, sf_dir)
    return audit.audit_leak(customers, mask_table(customers, CUSTOMER_POLICY), "country", list(COUNTRIES))


@query
def audit_unchanged(spark, sf_dir) -> DataFrame:
    return audit.audit_unchanged(_payment_pairs(spark, sf_dir), list(PAYMENT_POLICY))


@query
def audit_unchanged_stored(spark, sf_dir) -> DataFrame:
    """The same over two tables whose rows are brought together by key."""
    pairs = audit.pair_tables(*_payments(spark, sf_dir), "row_key", list(PAYMENT_POLICY), hashes_only=True)
    return audit.audit_unchanged(pairs, list(PAYMENT_POLICY))


def _broken_payments(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Masked payments without some rows, with some rows twice, and with values where there were none."""
    original, masked = _payments(spark, sf_dir)
    k = F.col("row_key").cast("bigint")
    filled = masked.withColumn("post_date", F.coalesce("post_date", F.lit("01/01/2025")))
    return original, filled.where(k % 41 != 0).unionAll(filled.where(k % 43 == 0))


@query
def audit_null_mask_broken(spark, sf_dir) -> DataFrame:
    """Lost rows, repeated keys and filled NULLs are violations."""
    pairs = audit.pair_tables(*_broken_payments(spark, sf_dir), "row_key", list(PAYMENT_POLICY), nulls_only=True)
    return audit.audit_null_mask(pairs, list(PAYMENT_POLICY))


@query
def audit_unchanged_broken(spark, sf_dir) -> DataFrame:
    """Lost rows and repeated keys are unpaired and can't pass as changed."""
    pairs = audit.pair_tables(*_broken_payments(spark, sf_dir), "row_key", list(PAYMENT_POLICY), hashes_only=True)
    return audit.audit_unchanged(pairs, list(PAYMENT_POLICY))


@query
def audit_unconverted(spark, sf_dir) -> DataFrame:
    return audit.audit_unconverted(inputs.payments(spark, sf_dir), PAYMENT_POLICY, SALT)


@query
def audit_deterministic(spark, sf_dir) -> DataFrame:
    payments = inputs.payments(spark, sf_dir)
    return audit.audit_deterministic(mask_table(payments, PAYMENT_POLICY, SALT), mask_table(payments, PAYMENT_POLICY, SALT))


@query
def audit_consistent(spark, sf_dir) -> DataFrame:
    return audit.audit_consistent(_payment_pairs(spark, sf_dir), "description", ["category"])


@query
def audit_collision(spark, sf_dir) -> DataFrame:
    return audit.audit_collision(_customer_pairs(spark, sf_dir), "email")


@query
def audit_estimates(spark, sf_dir) -> DataFrame:
    """Stored sketches of two parts of the customers, merged, beside exact numbers: is each within five errors?"""
    columns = ["name", "email", "country"]
    pairs = _customer_pairs(spark, sf_dir)
    sketch = _merged_sketch(
        spark, pairs, "row_key", lambda part: sketches.value_sketch(part, columns), sketches.merge_value_sketches
    )
    estimated = sketches.audit_estimates(sketch).withColumnsRenamed({c: f"{c}_like" for c in ("inputs", "outputs", "leaked")})
    exact = sketches.distinct_values(pairs, columns).join(estimated.drop("shared"), "column")
    most = F.greatest("inputs", "outputs")
    near = {c: F.abs(F.col(f"{c}_like") - F.col(c)) <= 5 * F.col("error") * (most if c == "leaked" else F.col(c)) for c in ("inputs", "outputs", "leaked")}
    return exact.select("column", "inputs", "outputs", "leaked", *[test.alias(f"{c}_near") for c, test in near.items()])


@query
def audit_pool(spark, sf_dir) -> DataFrame:
    return audit.audit_pool(_customer_pairs(spark, sf_dir), CUSTOMER_POLICY)


@query
def audit_untouched(spark, sf_dir) -> DataFrame:
    return audit.audit_untouched(*_payments(spark, sf_dir), PAYMENT_POLICY)


@query
def audit_column_order(spark, sf_dir) -> DataFrame:
    return audit.audit_column_order(inputs.payments(spark, sf_dir), PAYMENT_POLICY, SALT)


@query
def audit_salt_effect(spark, sf_dir) -> DataFrame:
    rules = {**PAYMENT_POLICY, "priority": "category"}
    return audit.audit_salt_effect(inputs.payments(spark, sf_dir), rules, SALT, OTHER_SALT)


@query
def audit_salt_range(spark, sf_dir) -> DataFrame:
    return audit.audit_salt_range(inputs.names_of_files(spark, sf_dir), "file_name")


@query
def audit_sign(spark, sf_dir) -> DataFrame:
    return audit.audit_sign(_payment_pairs(spark, sf_dir), ["amount", "amount_text"])


@query
def audit_interval(spark, sf_dir) -> DataFrame:
    return audit.audit_interval(_payment_pairs(spark, sf_dir), "order_date", "post_date")


@query
def audit_encoding(spark, sf_dir) -> DataFrame:
    """Whole documents and conversation turns, masked as names."""
    documents = inputs.table(spark, sf_dir, "documents").select("text")
    turns = inputs.table(spark, sf_dir, "conversations").select("text")
    pairs = mask_side_by_side(documents.unionAll(turns), {"text": "name"})
    return audit.audit_encoding(pairs, ["text"])


@query
def audit_encoding_broken(spark, sf_dir) -> DataFrame:
    """A twin that was masked from the ASCII part only is found."""
    documents = inputs.table(spark, sf_dir, "documents").select("text")
    ascii_part = F.regexp_replace("text", audit.NON_ASCII, "")
    return audit.audit_encoding(documents.withColumn("text__masked", fields.mask_name(ascii_part)), ["text"])
