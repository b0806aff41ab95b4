"""Dirtying a table of people in seventeen steps.

A step changes a share of the rows. ``by_rate`` decides each row by a hash of its key, so every
run and every retry of a task picks the same rows, without a shuffle; the count is the rate up to
sampling error. ``by_count`` (in ``selection``) picks the exact number in more passes. Steps that append copies do so by
``explode`` on the row itself: one scan, where a union with a filtered self would read
the table once more per step. Copies get a key of their own, so later steps pick them apart
from their originals.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import draw, draw_from, drawn_below, hash_of
from maskloom.session import column

# What the steps write, and how often.

DIACRITIC_NAMES = [
    "José María", "François Dupont", "Müller Hans", "Søren Kierkegaard", "李明",
    "محمد العلي", "Владимир Иванов", "Ångström Lars", "Ñoño García", "Ünsal Öztürk",
]
MIXED_SCRIPT_NAMES = ["田中 Tanaka", "José 李", "Kim 김민준", "Иван Smith", "Ahmad أحمد", "Wang 王伟 Wei"]
EMOJI = ["😀", "🎉", "🌍", "🔥", "✨"]
UNUSUAL_TLDS = [".museum", ".co.uk", ".co.jp", ".com.br", ".de", ".fr", ".io"]
SINGLE_WORD_NAMES = ["Cher", "Prince", "Madonna", "Zendaya", "Adele", "Banksy"]
LONG_NAMES = [
    "Mary Jane Watson Parker Smith", "Jean-Baptiste Emmanuel Zorg Le Grand", "Sir Arthur Ignatius Conan Doyle III",
]
NUMERIC_NAMES = ["John 2nd", "123 Main", "User 404", "Agent 007"]

RATES = {
    "null_country": 0.05, "null_email": 0.02, "null_name": 0.01,
    "exact_duplicates": 0.02, "name_collisions": 0.03, "email_collisions": 0.01,
    "diacritics": 0.01, "mixed_scripts": 0.005, "emoji": 0.003,
    "unusual_tlds": 0.02, "subdomains": 0.01, "plus_addressing": 0.005, "numeric_emails": 0.005,
    "whitespace_name": 0.01, "whitespace_email": 0.01, "double_spaces": 0.005, "mixed_case": 0.003,
    "single_word": 0.005, "long_names": 0.003, "numeric_names": 0.002,
}

# End of fixed values.

# One digest of the key answers four steps. Appended copies have a new key, so the steps after
# an append draw from digests of their own.
DIGEST_STEPS = {
    "nulls": ("null_country", "null_email", "null_name", "exact_duplicates"),
    "names": ("name_collisions",),
    "emails": ("email_collisions",),
    "late_1": ("diacritics", "mixed_scripts", "emoji", "unusual_tlds"),
    "late_2": ("subdomains", "plus_addressing", "numeric_emails", "whitespace_name"),
    "late_3": ("whitespace_email", "double_spaces", "mixed_case", "single_word"),
    "late_4": ("long_names", "numeric_names"),
}
DIGEST_SLOT = {step: (group, slot) for group, steps in DIGEST_STEPS.items() for slot, step in enumerate(steps)}
LATE_DIGESTS = tuple(group for group in DIGEST_STEPS if group.startswith("late"))

COPY = "__copy"
DIGEST = "__digest_"
VALUE = ":value"
Pick = Callable[[DataFrame, str, float, Column], Column]


@dataclass(frozen=True)
class People:
    """The columns the steps work on. The key must be unique text."""

    key: str = "row_key"
    name: str = "name"
    email: str = "email"
    country: str = "country"


PEOPLE = People()


def by_rate(df: DataFrame, step: str, rate: float, key: Column) -> Column:
    """Decide each row by one word of a digest of its key."""
    group, slot = DIGEST_SLOT[step]
    digest = F.col(DIGEST + group) if DIGEST + group in df.columns else hash_of(group, key)
    return drawn_below(digest, slot, rate)


def _pick(df: DataFrame, step: str, cols: People, pick: Pick) -> Column:
    return pick(df, step, RATES[step], column(cols.key))


def _change(df: DataFrame, step: str, cols: People, pick: Pick, target: str, new: Column) -> DataFrame:
    picked = _pick(df, step, cols, pick)
    return df.withColumn(target, F.when(picked, new).otherwise(column(target)))


def _value_digest(step: str, cols: People) -> Column:
    return hash_of(step + VALUE, column(cols.key))


def _word(step: str, cols: People, words: list[str]) -> Column:
    return draw_from(_value_digest(step, cols), 0, words)


def _number(step: str, cols: People, low: int, high: int) -> Column:
    """A whole number in ``[low, high)`` as text."""
    return (F.lit(low) + draw(_value_digest(step, cols), 0, high - low)).cast("string")


def _append(df: DataFrame, step: str, cols: People, pick: Pick, changes: dict[str, Column]) -> DataFrame:
    copies = F.when(_pick(df, step, cols, pick), F.array(F.lit(False), F.lit(True)))
    out = df.withColumn(COPY, F.explode(copies.otherwise(F.array(F.lit(False)))))
    is_copy, key = F.col(COPY), column(cols.key)
    new = {c: F.when(is_copy & column(c).isNotNull(), value).otherwise(column(c)) for c, value in changes.items()}
    new[cols.key] = F.when(is_copy, hash_of("dup", step, key)).otherwise(key)
    return out.withColumns(new).drop(COPY)


def mess_nulls(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    targets = {"null_country": cols.country, "null_email": cols.email, "null_name": cols.name}
    return df.withColumns(
        {target: F.when(~_pick(df, step, cols, pick), column(target)) for step, target in targets.items()}
    )


def mess_exact_duplicates(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    return _append(df, "exact_duplicates", cols, pick, {})


def mess_name_collisions(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    """Copies that keep the name and get another e-mail address."""
    step = "name_collisions"
    email = F.concat(F.lit("alt_"), _number(step, cols, 1000, 9999), F.lit("@example.com"))
    return _append(df, step, cols, pick, {cols.email: email})


def mess_email_collisions(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    """Copies that keep the e-mail address and get another name."""
    step = "email_collisions"
    return _append(df, step, cols, pick, {cols.name: F.concat(F.lit("Alt User "), _number(step, cols, 100, 999))})


def mess_diacritics(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step = "diacritics"
    return _change(df, step, cols, pick, cols.name, _word(step, cols, DIACRITIC_NAMES))


def mess_mixed_scripts(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step = "mixed_scripts"
    return _change(df, step, cols, pick, cols.name, _word(step, cols, MIXED_SCRIPT_NAMES))


def mess_emoji(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step = "emoji"
    return _change(df, step, cols, pick, cols.name, F.concat(column(cols.name), _word(step, cols, EMOJI)))


def mess_unusual_tlds(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    """Swap what follows the last dot; an address without a dot stays."""
    step, email = "unusual_tlds", column(cols.email)
    swapped = F.concat(F.regexp_replace(email, r"\.[^.]*\z", ""), _word(step, cols, UNUSUAL_TLDS))
    return _change(df, step, cols, pick, cols.email, F.when(email.contains("."), swapped).otherwise(email))


def mess_subdomains(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    return _change(
        df, "subdomains", cols, pick, cols.email, F.replace(column(cols.email), F.lit("@"), F.lit("@mail."))
    )


def mess_plus_addressing(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step = "plus_addressing"
    tag = F.concat(F.lit("+tag"), _number(step, cols, 1, 99), F.lit("@"))
    return _change(df, step, cols, pick, cols.email, F.replace(column(cols.email), F.lit("@"), tag))


def mess_numeric_emails(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step, email = "numeric_emails", column(cols.email)
    domain = F.get(F.split(email, "@"), 1)
    number = F.concat(_number(step, cols, 100000, 999999), F.lit("@"), domain)
    return _change(df, step, cols, pick, cols.email, F.when(email.contains("@"), number).otherwise(email))


def mess_whitespace(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    for step, target in (("whitespace_name", cols.name), ("whitespace_email", cols.email)):
        df = _change(df, step, cols, pick, target, F.concat(F.lit("  "), column(target), F.lit("  ")))
    return df


def mess_double_spaces(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    doubled = F.regexp_replace(column(cols.name), "^([^ ]*) ", "$1  ")
    return _change(df, "double_spaces", cols, pick, cols.name, doubled)


def mess_mixed_case(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step, name = "mixed_case", column(cols.name)
    coin = drawn_below(_value_digest(step, cols), 0, 0.5)
    return _change(df, step, cols, pick, cols.name, F.when(coin, F.upper(name)).otherwise(F.lower(name)))


def mess_single_word(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step = "single_word"
    return _change(df, step, cols, pick, cols.name, _word(step, cols, SINGLE_WORD_NAMES))


def mess_long_names(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step = "long_names"
    return _change(df, step, cols, pick, cols.name, _word(step, cols, LONG_NAMES))


def mess_numeric_names(df: DataFrame, cols: People = PEOPLE, pick: Pick = by_rate) -> DataFrame:
    step = "numeric_names"
    return _change(df, step, cols, pick, cols.name, _word(step, cols, NUMERIC_NAMES))


EARLY_STEPS = (mess_nulls, mess_exact_duplicates, mess_name_collisions, mess_email_collisions)
LATE_STEPS = (
    mess_diacritics, mess_mixed_scripts, mess_emoji, mess_unusual_tlds, mess_subdomains, mess_plus_addressing,
    mess_numeric_emails, mess_whitespace, mess_double_spaces, mess_mixed_case, mess_single_word, mess_long_names,
    mess_numeric_names,
)
STEPS = EARLY_STEPS + LATE_STEPS


def mess_all(
    df: DataFrame,
    cols: People = PEOPLE,
    pick: Pick = by_rate,
    between: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All steps in order: one scan and no shuffle with ``by_rate``.

    ``by_count`` reads its input a few times per step; give ``between`` a function that writes
    the table and reads it back, so that a step does not repeat the ones before it.
    """
    between = between or (lambda stage: stage)
    for step in EARLY_STEPS:
        df = between(step(df, cols, pick))
    if pick is by_rate:
        df = df.withColumns({DIGEST + group: hash_of(group, column(cols.key)) for group in LATE_DIGESTS})
    for step in LATE_STEPS:
        df = between(step(df, cols, pick))
    return df.drop(*[DIGEST + group for group in LATE_DIGESTS])


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, NULLs and NULL share per column, in one pass over the table."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(column(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)],
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"nulls_{i}").alias("nulls")) for i, c in enumerate(columns)]
    share = F.when(F.col("rows") > 0, F.col("nulls") * F.lit(100.0) / F.col("rows"))
    return counted.select("rows", F.inline(F.array(*entries))).select(
        "column", "rows", "nulls", share.alias("null_pct")
    )
