"""One masking rule per field type, each a ``Column -> Column`` builder.

Every rule keeps NULL as NULL and stays inside generated code. Rules that can fail (date and
amount) return NULL for a value they cannot convert; ``keep_on_error`` decides what happens
to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import dates
from maskloom.functions.hashing import MAX_MODULUS, md5_index, text_array
from maskloom.functions.pools import DEFAULT_CATEGORY, DEFAULT_POOLS, Pools

FIELD_TYPES = ("name", "email", "country", "date", "amount", "description", "id", "category")
ON_ERROR = ("keep", "null", "fail")

# The ranges of the per-file shift and factor.
OFFSET_MIN, OFFSET_STEPS = 180, 551
MULTIPLIER_MIN, MULTIPLIER_STEPS, MULTIPLIER_SCALE = 1.5, 2001, 1000

DATE_TEXT = r"^(1[0-2]|0[1-9]|[1-9])/(3[01]|[12][0-9]|0[1-9]| ?[1-9])/(?!0000)([0-9]{4})\z"
AMOUNT_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*\z"


def _literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _from_pool(value: Column, pool) -> Column:
    # get() and not element_at(): with a NULL index the latter can return the last entry of a
    # literal array, which would turn NULL into a word.
    return F.get(text_array(pool), md5_index(value, len(pool)))


def mask_name(value: Column, pools: Pools = DEFAULT_POOLS) -> Column:
    return _from_pool(value, pools.names)


def mask_email(value: Column, pools: Pools = DEFAULT_POOLS) -> Column:
    """User and domain are picked by two hashes, so they vary apart from each other."""
    text = value.cast("string")
    domain = _from_pool(F.concat(text, F.lit(":domain")), pools.email_domains)
    return F.concat(_from_pool(text, pools.email_users), F.lit("@"), domain)


def mask_country(value: Column, pools: Pools = DEFAULT_POOLS) -> Column:
    return _from_pool(value, pools.countries)


def mask_category(value: Column, pools: Pools = DEFAULT_POOLS) -> Column:
    return _from_pool(value, pools.categories)


def mask_description(value: Column, category: Column | str | None = None, pools: Pools = DEFAULT_POOLS) -> Column:
    """A merchant from the pool of the row's category; unknown and NULL categories use Default.

    The pools lie one after another in a single array. The value is hashed once, modulo the
    least common multiple of the pool sizes, and reduced to the size of the chosen pool; if that
    multiple is too large, it is hashed modulo the chosen pool's size.
    """
    flat, spans = [], {}
    for key, words in pools.merchants.items():
        spans[key] = (len(flat), len(words))
        flat.extend(words)
    default_start, default_size = spans.pop(DEFAULT_CATEGORY)
    if category is None:
        return _from_pool(value, pools.merchants[DEFAULT_CATEGORY])

    category = _literal(category)
    start, size = F.lit(default_start), F.lit(default_size)
    if spans:
        sizes = {}
        starts = None
        for key, (first, length) in spans.items():
            hit = category == F.lit(key)
            starts = F.when(hit, F.lit(first)) if starts is None else starts.when(hit, F.lit(first))
            if length != default_size:
                sizes.setdefault(length, []).append(key)
        start = starts.otherwise(F.lit(default_start))
        for length, keys in sizes.items():
            size = F.when(category.isin(keys), F.lit(length)).otherwise(size)
    every = sorted({len(words) for words in pools.merchants.values()})
    common = math.lcm(*every)
    if common <= MAX_MODULUS:
        index = md5_index(value, common) % size
    else:  # one branch is taken, so a row still hashes its value once
        index = F.coalesce(*[F.when(size == n, md5_index(value, n)) for n in every])
    return F.get(text_array(flat), start + index)


def derive_offset(salt: Column | str) -> Column:
    """Days to shift all dates of a file, 180..730, from its name (INT)."""
    name = _literal(salt)
    return F.lit(OFFSET_MIN) + md5_index(F.concat(name, F.lit(":offset")), OFFSET_STEPS)


def derive_multiplier(salt: Column | str) -> Column:
    """Factor for all amounts of a file, 1.5..3.5, from its name (DOUBLE)."""
    name = _literal(salt)
    steps = md5_index(F.concat(name, F.lit(":multiplier")), MULTIPLIER_STEPS)
    return F.lit(MULTIPLIER_MIN) + steps.cast("double") / F.lit(float(MULTIPLIER_SCALE))


def parse_date(value: Column) -> Column:
    """``MM/DD/YYYY`` text as DATE, with one-digit parts allowed; NULL for anything else.

    Ten-character text takes a fixed-width parse. Only the rest pays for the regular
    expression, which also keeps the slow failing parse away from junk values.
    """
    fixed = (F.length(value) == 10) & F.substring(value, 1, 2).between("01", "12") & ~value.endswith("0000")
    wide = F.try_to_date(F.when(fixed, value), "MM/dd/yyyy")
    narrow = F.try_to_date(
        F.when(value.rlike(DATE_TEXT), F.replace(value, F.lit(" "), F.lit(""))), "M/d/yyyy"
    )
    return F.coalesce(wide, narrow)


def _shift(day: Column, offset: Column, pattern: str) -> Column:
    moved = F.date_add(day, offset)
    return F.date_format(F.when(moved <= F.lit("9999-12-31").cast("date"), moved), pattern)


def mask_date(value: Column, offset: Column | int, formats: list[str] | None = None) -> Column:
    """Shift a date text by ``offset`` days; NULL where it cannot be read or leaves year 9999.

    ``formats`` names further patterns to accept; each is written back in its own pattern. With
    ``dd/MM/yyyy`` among them and ``MM/dd/yyyy`` not, months don't come first.
    """
    text, days = value.cast("string"), _literal(offset)
    if formats and dates.replaces_default(formats):
        return F.coalesce(*[dates.shift(text, pattern, days) for pattern in formats])
    day = parse_date(text)
    # Far from year 9999 no test of the result is needed, so the text is parsed only once.
    near = isinstance(offset, int) and abs(offset) > 36500
    plain = F.date_format(F.date_add(day, days), "MM/dd/yyyy")
    guarded = _shift(day, days, "MM/dd/yyyy")
    masked = guarded if near else F.when(F.right(text, F.lit(4)) < "9900", plain).otherwise(guarded)
    if not formats:
        return masked
    return F.coalesce(masked, *[dates.shift(text, pattern, days) for pattern in formats if pattern != dates.DEFAULT])


def read_amount(value: Column, numeric: bool) -> Column:
    """A value as DOUBLE; NULL for text that is no plain number."""
    if numeric:
        return value.cast("double")
    return F.when(value.rlike(AMOUNT_TEXT), value.try_cast("double"))


def round_cents(product: Column) -> Column:
    """Round the exact binary value to two decimals, half to even.

    ``round`` and ``bround`` decide ties on the shortest decimal text instead. Away from a tie,
    hundredths are found by ``rint``; near one, ``format_number`` decides on the exact value.
    """
    cents = product * F.lit(100.0)
    clear = (F.abs(cents) < F.lit(1e11)) & (F.abs(F.abs(cents - F.floor(cents)) - F.lit(0.5)) > F.lit(1e-3))
    exact = F.call_function("format_number", product, F.lit("0.00")).try_cast("double")
    return F.when(clear, F.rint(cents) / F.lit(100.0)).otherwise(F.coalesce(exact, product))


def mask_amount(value: Column, multiplier: Column | float, numeric: bool) -> Column:
    """Scale an amount and round it to cents.

    A numeric column gives DOUBLE. A text column gives text with one or two decimals, as
    its unreadable values have to stay text.
    """
    product = read_amount(value, numeric) * _literal(multiplier)
    if numeric:
        return round_cents(product)
    # format_number rounds the exact binary value, half to even; only its words differ.
    text = F.call_function("format_number", product, F.lit("0.0#"))
    return F.replace(F.replace(text, F.lit("∞"), F.lit("inf")), F.lit("NaN"), F.lit("nan"))


def keep_on_error(masked: Column, original: Column, on_error: str = "keep") -> Column:
    """What becomes of a value its rule could not convert: kept, dropped to NULL, or an error."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    if on_error == "null":
        return masked
    if on_error == "keep":
        return F.coalesce(masked, original)
    failed = original.isNotNull() & masked.isNull()
    return F.when(failed, F.raise_error(F.lit("a value could not be masked"))).otherwise(masked)
