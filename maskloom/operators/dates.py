"""Which patterns the dates of a column are written in, by elimination over the whole column.

Every value has one bit for each pattern that reads it. ``bit_and`` over the column leaves the patterns
that read all of its dates, so a single ``28/02/2024`` rules out that months come first. Where no pattern
reads all dates, the column mixes patterns: those that are the only one to read some value are taken,
and of each value that none of these reads the first that does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.dates import DEFAULT, ORDERS, PATTERNS, bit, pattern_bits
from maskloom.operators.policy import FORMATS_BETWEEN
from maskloom.session import column


def _has(bits: Column, wanted: int) -> Column:
    return bits.bitwiseAND(F.lit(wanted).cast("bigint")) == F.lit(wanted)


def _both_orders(bits: Column) -> Column:
    return reduce(Column.__or__, [_has(bits, bit(a) | bit(b)) for a, b in ORDERS])


def _first(bits: Column) -> Column:
    return bits.bitwiseAND(-bits)


def date_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``position, column, dates, others, patterns, formats, ambiguous`` for each of the columns.

    ``dates`` and ``others`` count the values that are dates and those that are not. ``patterns`` lists
    what the dates are written in, and ``formats`` the same as a policy takes it: without months first
    between slashes, which masking reads by itself, unless days first stands beside it. ``ambiguous``
    marks columns whose dates don't tell which of day and month comes first. One scan; what is
    shuffled is a count for each column and set of patterns.
    """
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), column(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    if not cells:
        return df.sparkSession.createDataFrame([], DATE_SCHEMA)
    long = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    counted = long.groupBy("position", "column", pattern_bits(F.col("value")).alias("bits")).agg(F.count("*").alias("n"))
    found = counted.groupBy("position", "column").agg(
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("dates"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("others"),
        F.coalesce(F.bit_and(F.when(F.col("bits") != 0, F.col("bits"))), F.lit(0).cast("bigint")).alias("common"),
        F.collect_set(F.when(F.col("bits") != 0, F.col("bits"))).alias("sets"),
    )
    zero = F.lit(0).cast("bigint")
    sure = F.aggregate(F.filter("sets", lambda x: F.bit_count(x) == 1), zero, lambda a, x: a.bitwiseOR(x))
    found = found.withColumn("sure", sure).withColumn("rest", F.filter("sets", lambda x: x.bitwiseAND(F.col("sure")) == 0))
    mixed = F.col("sure").bitwiseOR(F.aggregate("rest", zero, lambda a, x: a.bitwiseOR(_first(x))))
    one = F.col("common") != 0
    found = found.select(
        "position", "column", "dates", "others", F.when(one, _first(F.col("common"))).otherwise(mixed).alias("taken"),
        F.when(one, _both_orders(F.col("common"))).otherwise(F.exists("rest", _both_orders) | _both_orders(F.col("sure"))).alias("ambiguous"),
    )
    taken = {p: _has(F.col("taken"), bit(p)) for p in PATTERNS}
    days_first = taken["dd/MM/yyyy"]
    listed = {p: F.when(test, F.lit(p)) for p, test in taken.items()}
    formats = {**listed, DEFAULT: F.when(taken[DEFAULT] & days_first, F.lit(DEFAULT))}
    join = lambda words: F.nullif(F.concat_ws(FORMATS_BETWEEN, *words.values()), F.lit(""))
    return found.select("position", "column", "dates", "others", join(listed).alias("patterns"), join(formats).alias("formats"), "ambiguous")


DATE_SCHEMA = "position INT, column STRING, dates BIGINT, others BIGINT, patterns STRING, formats STRING, ambiguous BOOLEAN"
