"""Audits: what a masked table must keep, and what it must not show.

Audits that compare rows take ``pairs``: the original columns with ``<column>__masked`` twins.
``mask_side_by_side`` makes them in one pass without a shuffle, ``pair_tables`` makes them from
two stored tables. Audits that compare tables take both frames. Every group is reduced before
it is shuffled, so a value held by a third of all rows costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions import fields
from maskloom.functions.hashing import MANY_ENTRIES, text_array
from maskloom.functions.pools import DEFAULT_POOLS, Pools
from maskloom.operators.masking import MASKED, mask_side_by_side, mask_table, mask_value
from maskloom.operators.policy import as_entries
from maskloom.session import column

NON_ASCII = r"[^\x00-\x7F]"


def twin(name: str) -> Column:
    return column(name + MASKED)


def _long(counted: DataFrame, columns: list[str], measures: list[str], shared: list[str] = ()) -> DataFrame:
    """Turn one row of ``<measure>_<i>`` counters into one row per column."""
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
        for i, c in enumerate(columns)
    ]
    return counted.select(*shared, F.inline(F.array(*entries))).select("column", *shared, *measures)


def pair_tables(
    original: DataFrame,
    masked: DataFrame,
    key: str,
    columns: list[str],
    nulls_only: bool = False,
    hashes_only: bool = False,
) -> DataFrame:
    """Both versions of each row, found by key, as ``<column>`` and ``<column>__masked``.

    Grouping the two tables together gives one row per key whatever the number of copies, so a
    repeated key cannot multiply. ``rows_original`` and ``rows_masked`` are 1 for a clean pair;
    see ``unpaired``. ``nulls_only`` replaces each value by whether there is one, which keeps the
    values out of the shuffle and lets Spark group by hash instead of by sorting. ``hashes_only``
    does the same with 64 bits of hash per value, enough to tell whether two values differ: among
    10^12 changed values, one passes as unchanged once in 18 million runs.
    """

    def comparable(c: str, value: Column) -> Column:
        kinds = [df.schema[c].dataType for df in (original, masked)]
        if kinds[0] == kinds[1]:
            return value
        return value.cast("double" if all(isinstance(kind, T.NumericType) for kind in kinds) else "string")

    def side(df: DataFrame, is_original: bool) -> DataFrame:
        values = {c: column(c) for c in columns}
        types = {c: df.schema[c].dataType for c in columns}
        if nulls_only:
            values = {c: F.when(column(c).isNotNull(), F.lit(True)) for c in columns}
            types = {c: T.BooleanType() for c in columns}
        elif hashes_only:
            values = {c: F.when(column(c).isNotNull(), F.xxhash64(comparable(c, column(c)))) for c in columns}
            types = {c: T.LongType() for c in columns}
        nothing = {c: F.lit(None).cast(types[c]) for c in columns}
        return df.select(
            column(key),
            *[(values[c] if is_original else nothing[c]).alias(c) for c in columns],
            *[(nothing[c] if is_original else values[c]).alias(c + MASKED) for c in columns],
            F.lit(1 if is_original else 0).alias("rows_original"),
            F.lit(0 if is_original else 1).alias("rows_masked"),
        )

    both = side(original, True).unionByName(side(masked, False))
    return both.groupBy(column(key)).agg(
        *[F.max(column(c + end)).alias(c + end) for c in columns for end in ("", MASKED)],
        F.sum("rows_original").alias("rows_original"),
        F.sum("rows_masked").alias("rows_masked"),
    )


def _is_grouped(pairs: DataFrame) -> bool:
    return {"rows_original", "rows_masked"} <= set(pairs.columns)


def _alone() -> Column:
    return (F.col("rows_original") != 1) | (F.col("rows_masked") != 1)


def unpaired(pairs: DataFrame) -> DataFrame:
    """Keys that do not stand exactly once on both sides."""
    return pairs.where(_alone())


def write_with_report(masked: DataFrame, policy, path: str, fmt: str = "parquet") -> dict:
    """Write the table and count it during the write, without a second pass."""
    names = [entry.column for entry in as_entries(policy)]
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows")]
    masked.observe(seen, *counts).write.mode("overwrite").format(fmt).save(path)
    return {"columns_masked": len(names), "rows_processed": seen.get["rows"]}


def run_report(masked: DataFrame, policy, skipped: list[str], path: str, fmt: str = "parquet") -> DataFrame:
    """Write the table; one row with the columns masked, rows processed and columns skipped."""
    report = write_with_report(masked, policy, path, fmt)
    return masked.sparkSession.createDataFrame(
        [(report["columns_masked"], report["rows_processed"], ", ".join(skipped))],
        "columns_masked INT, rows_processed BIGINT, skipped_columns STRING",
    )


def audit_row_count(original: DataFrame, masked: DataFrame) -> DataFrame:
    sides = original.select(F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(masked.select(F.lit(0), F.lit(1)))
    counted = sides.agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum("o"), F.lit(0)).alias("rows_out")
    )
    return counted.withColumn("ok", F.col("rows_in") == F.col("rows_out"))


def audit_null_counts(original: DataFrame, masked: DataFrame, columns: list[str]) -> DataFrame:
    def side(df: DataFrame, is_original: bool) -> DataFrame:
        return df.select(
            *[column(c).isNull().alias(f"null_{i}") for i, c in enumerate(columns)], F.lit(is_original).alias("is_original")
        )

    both = side(original, True).unionAll(side(masked, False))
    counted = both.agg(
        *[
            F.count_if(F.col(f"null_{i}") & (F.col("is_original") == F.lit(flag))).alias(f"{label}_{i}")
            for i in range(len(columns))
            for label, flag in (("nulls_in", True), ("nulls_out", False))
        ]
    )
    return _long(counted, columns, ["nulls_in", "nulls_out"]).withColumn("ok", F.col("nulls_in") == F.col("nulls_out"))


def _violations(pairs: DataFrame, columns: list[str], tests: dict[str, list[Column]]) -> DataFrame:
    """Rows and one counter per measure and column, in a single pass."""
    counted = pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(test).alias(f"{measure}_{i}") for measure, by_col in tests.items() for i, test in enumerate(by_col)],
    )
    return _long(counted, columns, list(tests), ["rows"])


def audit_null_mask(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """NULL exactly where the original was NULL.

    Where the pairs come from two stored tables, keys that don't stand exactly once on both sides
    can't be compared: they are counted as ``violations`` of every column.
    """
    differs = [column(c).isNull() != twin(c).isNull() for c in columns]
    if _is_grouped(pairs):
        differs = [_alone() | x for x in differs]
    return _violations(pairs, columns, {"violations": differs}).withColumn("ok", F.col("violations") == 0)


def audit_leak(original: DataFrame, masked: DataFrame, name: str, pool: list[str] | None = None) -> DataFrame:
    """Original values that also appear as masked values, flagged if they are pool words.

    Both columns are grouped together, so equal values meet after they were reduced; a semi-join
    would be pushed below a distinct and shuffle every row.
    """

    def values(df: DataFrame, is_original: bool) -> DataFrame:
        text = column(name).cast("string")
        return df.where(text.isNotNull()).select(
            text.alias("value"), F.lit(is_original).alias("before"), F.lit(not is_original).alias("after")
        )

    seen = values(original, True).unionAll(values(masked, False)).groupBy("value")
    leaked = seen.agg(F.bool_or("before").alias("before"), F.bool_or("after").alias("after")).where("before AND after")
    return leaked.select(F.lit(name).alias("column"), "value", F.col("value").isin(list(pool or [])).alias("in_pool"))


def audit_unchanged(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Values that masking left as they were.

    Where the pairs come from two stored tables, only keys that stand exactly once on both sides are
    compared; ``unpaired`` counts the others, and any of them makes ``ok`` false.
    """
    tests = {
        "compared": [column(c).isNotNull() for c in columns],
        "unchanged": [column(c).isNotNull() & column(c).eqNullSafe(twin(c)) for c in columns],
    }
    if not _is_grouped(pairs):
        return _violations(pairs, columns, tests)
    tests = {measure: [~_alone() & test for test in by_column] for measure, by_column in tests.items()}
    tests["unpaired"] = [_alone()] * len(columns)
    return _violations(pairs, columns, tests).withColumn("ok", F.col("unpaired") == 0)


def audit_unconverted(df: DataFrame, policy, salt) -> DataFrame:
    """Per policy column, the values that pass through because no rule could convert them.

    Only dates and amounts can fail, so only they are computed; ids always pass through.
    """
    entries = as_entries(policy)
    can_fail = [e for e in entries if e.field_type in ("date", "amount")]
    pairs = mask_side_by_side(df, can_fail, salt, on_error="null")

    def left(entry) -> Column:
        if entry.field_type == "id":
            return column(entry.column).isNotNull()
        if entry in can_fail:
            return column(entry.column).isNotNull() & twin(entry.column).isNull()
        return F.lit(False)

    return _violations(pairs, [e.column for e in entries], {"unconverted": [left(e) for e in entries]})


def table_difference(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that stand more often in one table than in the other, with ``n`` copies more in ``a``.

    One shuffle answers both directions; copies of a row are summed up before it.
    """
    columns = columns if columns is not None else a.columns
    picked = [column(c) for c in columns]
    both = a.select(*picked, F.lit(1).alias("__n")).unionAll(b.select(*picked, F.lit(-1)))
    return both.groupBy(*picked).agg(F.sum("__n").alias("n")).where(F.col("n") != 0)


#: Buckets of row hashes (a power of two). Halves of hashes are summed, so that sums stay in a BIGINT for 10^12 rows.
BUCKETS = 1024


def _difference_report(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How many rows stand more often in one table than in the other.

    A row is 128 bits of hash; NULLs are hashed as flags. Sums of hash parts are the same for the same rows in
    any order, so the first pass compares sums of hash buckets and shuffles only these. It runs when this
    is called. Rows of buckets that differ are counted, one shuffled hash for each; of equal tables there are none.
    """
    columns = columns if columns is not None else a.columns
    parts = [x for c in columns for x in (column(c).isNull(), column(c))]
    digest = [F.xxhash64(F.lit(seed), *parts).alias(f"__h{seed}") for seed in (1, 2)]
    both = a.select(*digest, F.lit(1).cast("long").alias("__n")).unionAll(b.select(*digest, F.lit(-1).cast("long")))
    bucket = F.col("__h1").bitwiseAND(BUCKETS - 1)
    pieces = [piece for h in ("__h1", "__h2") for piece in (F.col(h).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    sums = [F.sum(F.col("__n") * piece).alias(f"__s{i}") for i, piece in enumerate(pieces)]
    differing = F.col("__n") != 0
    for i in range(len(sums)):
        differing = differing | (F.col(f"__s{i}") != 0)
    found = both.groupBy(bucket.alias("__b")).agg(F.sum("__n").alias("__n"), *sums).where(differing).select("__b").collect()
    if not found:
        return a.sparkSession.createDataFrame([(0, 0, True)], "only_in_first BIGINT, only_in_second BIGINT, ok BOOLEAN")
    rows = both.where(bucket.isin([r[0] for r in found])) if len(found) < BUCKETS else both
    counted = rows.groupBy("__h1", "__h2").agg(F.sum("__n").alias("n")).agg(
        F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_in_first"),
        F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_in_second"),
    )
    return counted.withColumn("ok", (F.col("only_in_first") == 0) & (F.col("only_in_second") == 0))


def audit_deterministic(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs hold the same rows, copies counted."""
    return _difference_report(first, second)


def audit_untouched(original: DataFrame, masked: DataFrame, policy) -> DataFrame:
    """Columns outside the policy are the same."""
    named = {entry.column for entry in as_entries(policy)}
    return _difference_report(original, masked, [c for c in original.columns if c not in named])


def audit_column_order(df: DataFrame, policy, salt=None) -> DataFrame:
    """Masking the table with its columns reversed gives the same rows."""
    turned = df.select(*[column(c) for c in reversed(df.columns)])
    return _difference_report(mask_table(df, policy, salt), mask_table(turned, policy, salt), df.columns)


def audit_consistent(pairs: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """How many inputs there are, and how many of them have more than one output.

    ``by`` lists what else decides the output: the category of a description, the salt of a
    date or an amount. One shuffle: the outputs of an input are equal if the least and the greatest
    of their hashes are; NULL counts as an output of its own.
    """
    source = [column(name), *[column(c) for c in by]]
    output = F.xxhash64(twin(name).isNull(), twin(name))
    per_input = pairs.where(column(name).isNotNull()).groupBy(*source).agg(
        F.min(output).alias("least"), F.max(output).alias("greatest")
    )
    return per_input.agg(
        F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("least") != F.col("greatest")).alias("inconsistent")
    ).withColumn("ok", F.col("inconsistent") == 0)


def audit_collision(pairs: DataFrame, name: str) -> DataFrame:
    """How many distinct inputs share each output, and how many rows that is."""
    distinct = (
        pairs.where(column(name).isNotNull())
        .groupBy(column(name), twin(name))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return distinct.groupBy(twin(name).alias("output")).agg(
        F.count(F.lit(1)).alias("inputs"), F.sum("rows").alias("rows")
    )


def audit_collision_estimate(pairs: DataFrame, columns: list[str], error: float = 0.02) -> DataFrame:
    """Distinct inputs and outputs per column by sketch: one pass for very big tables."""
    counted = pairs.agg(
        *[F.approx_count_distinct(column(c), error).alias(f"inputs_{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(twin(c), error).alias(f"outputs_{i}") for i, c in enumerate(columns)],
    )
    return _long(counted, columns, ["inputs", "outputs"])


def _pool_parts(field_type: str, pools: Pools) -> dict[str, list[str]]:
    """The words that a value, or each part of an address, is made of."""
    if field_type == "email":
        return {"user": list(pools.email_users), "domain": list(pools.email_domains)}
    return {"value": pools.outputs(field_type)}


def _split_address(value: Column) -> dict[str, Column]:
    domain = F.substring_index(value, "@", -1)
    user = F.substring(value, F.lit(1), F.length(value) - F.length(domain) - F.lit(1))
    return {"value": value, "user": F.when(value.contains("@"), user), "domain": domain}


def _outside_many(pairs: DataFrame, entry, pools: Pools) -> DataFrame:
    """One row ``column, rows, outside``: outputs are counted, then joined with the pool as a table."""
    counted = pairs.groupBy(twin(entry.column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    inside = F.lit(True)
    for part, words in _pool_parts(entry.field_type, pools).items():
        found = pairs.sparkSession.range(1).select(F.explode(text_array(words)).alias(f"__{part}")).distinct()
        counted = counted.join(found, _split_address(F.col("__v"))[part] == F.col(f"__{part}"), "left")
        inside = inside & F.col(f"__{part}").isNotNull()
    outside = F.sum(F.when(F.col("__v").isNotNull() & ~inside, F.col("__n")))
    return counted.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(outside, F.lit(0)).alias("outside")
    ).select(F.lit(entry.column).alias("column"), "rows", "outside")


def audit_pool(pairs: DataFrame, policy, pools: Pools = DEFAULT_POOLS) -> DataFrame:
    """Masked values outside their pool, per pooled column.

    Pools are plan literals, so no join is needed; one of more than ``MANY_ENTRIES`` words is joined as a table
    with the different outputs, in a scan of its own. An address is tested in two parts, as users times domains
    can be many.
    """
    entries = [e for e in as_entries(policy) if e.field_type not in ("date", "amount", "id")]
    many = [e for e in entries if max(map(len, _pool_parts(e.field_type, pools).values())) > MANY_ENTRIES]
    few = [e for e in entries if e not in many]

    def inside(entry) -> Column:
        parts = _split_address(twin(entry.column))
        tests = [F.coalesce(parts[part].isin(words), F.lit(False)) for part, words in _pool_parts(entry.field_type, pools).items()]
        return reduce(Column.__and__, tests)

    outside = [twin(e.column).isNotNull() & ~inside(e) for e in few]
    reports = [_violations(pairs, [e.column for e in few], {"outside": outside})] if few or not many else []
    reports += [_outside_many(pairs, e, pools) for e in many]
    return reduce(DataFrame.unionByName, reports).withColumn("ok", F.col("outside") == 0)


def audit_salt_effect(df: DataFrame, policy, salt_a, salt_b) -> DataFrame:
    """Values that differ between two salts, per column; both versions come from one scan."""
    entries = as_entries(policy)
    first = mask_side_by_side(df, entries, salt_a)
    kept = [column(c) for c in df.columns]
    first = first.select(*kept, *[twin(e.column).alias(f"__first_{i}") for i, e in enumerate(entries)])
    both = mask_side_by_side(first, entries, salt_b)
    changed = [~F.col(f"__first_{i}").eqNullSafe(twin(e.column)) for i, e in enumerate(entries)]
    filled = [column(e.column).isNotNull() for e in entries]
    return _violations(both, [e.column for e in entries], {"compared": filled, "changed": changed})


def audit_salt_range(files: DataFrame, name: str) -> DataFrame:
    """Smallest and greatest offset and factor over a table of file names."""
    derived = files.select(
        fields.derive_offset(column(name)).alias("offset"), fields.derive_multiplier(column(name)).alias("multiplier")
    )
    counted = derived.agg(
        F.count(F.lit(1)).alias("files"),
        F.min("offset").alias("min_offset"),
        F.max("offset").alias("max_offset"),
        F.min("multiplier").alias("min_multiplier"),
        F.max("multiplier").alias("max_multiplier"),
    )
    last = fields.OFFSET_MIN + fields.OFFSET_STEPS - 1
    top = fields.MULTIPLIER_MIN + (fields.MULTIPLIER_STEPS - 1) / fields.MULTIPLIER_SCALE
    inside = (
        (F.col("min_offset") >= fields.OFFSET_MIN)
        & (F.col("max_offset") <= last)
        & (F.col("min_multiplier") >= fields.MULTIPLIER_MIN)
        & (F.col("max_multiplier") <= top)
    )
    return counted.withColumn("ok", inside)


def _number(df: DataFrame, name: str) -> Column:
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return fields.read_amount(column(name), numeric)


def audit_sign(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Amounts whose sign changed; those that round to zero are counted apart."""
    before = [_number(pairs, c) for c in columns]
    after = [_number(pairs, c + MASKED) for c in columns]
    both = list(zip(before, after))
    return _violations(
        pairs,
        columns,
        {
            "compared": [b.isNotNull() & a.isNotNull() for b, a in both],
            "changed": [(F.signum(b) != F.signum(a)) & (a != 0) for b, a in both],
            "to_zero": [(b != 0) & (a == 0) for b, a in both],
        },
    ).withColumn("ok", F.col("changed") == 0)


def audit_interval(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows whose two dates are no longer the same number of days apart."""
    def days(a: Column, b: Column) -> Column:
        return F.datediff(fields.parse_date(b), fields.parse_date(a))

    before, after = days(column(first), column(second)), days(twin(first), twin(second))
    return pairs.agg(
        F.count_if(before.isNotNull()).alias("compared"),
        F.count_if(before.isNotNull() & ~before.eqNullSafe(after)).alias("changed"),
    ).withColumn("ok", F.col("changed") == 0)


def audit_encoding(
    pairs: DataFrame, columns: list[str], field_type: str = "name", pools: Pools = DEFAULT_POOLS
) -> DataFrame:
    """Values beyond ASCII, and what became of them in columns of a pooled type.

    ``lost`` have no output; ``wrong`` have another output than their UTF-8 bytes choose;
    ``like_ascii`` are those of the wrong ones whose output their ASCII part alone would choose.
    """

    def chosen(value: Column) -> Column:
        return mask_value(value, field_type, pools=pools)

    tests: dict[str, list[Column]] = {"non_ascii": [], "lost": [], "wrong": [], "like_ascii": []}
    for c in columns:
        wide = column(c).rlike(NON_ASCII)
        wrong = wide & twin(c).isNotNull() & (twin(c) != chosen(column(c)))
        tests["non_ascii"].append(wide)
        tests["lost"].append(wide & twin(c).isNull())
        tests["wrong"].append(wrong)
        tests["like_ascii"].append(wrong & (twin(c) == chosen(F.regexp_replace(column(c), NON_ASCII, ""))))
    return _violations(pairs, columns, tests).withColumn("ok", (F.col("lost") == 0) & (F.col("wrong") == 0))


def all_ok(*reports: DataFrame) -> DataFrame:
    """One flag over any number of audit reports that carry ``ok``."""
    flags = reduce(DataFrame.unionAll, [report.select("ok") for report in reports])
    return flags.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))
