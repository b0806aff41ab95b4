"""Patterns in which dates are written: which of them read a value, and shifting a date in its pattern.

Two-digit years are those from 1969 to 2068. A pattern with a time stands for its day and whatever time follows; the time is kept as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?(Z|[+-]\d{2}:?\d{2})?"
_SLASHES, _DASHES = r"\d{1,2}/\d{1,2}/\d{4}", r"\d{2}-\d{2}-\d{4}"
_MONTH, _MON = r"\p{L}{3,9}", r"\p{L}{3}"
#: Pattern and shape. A pattern's place is its bit, and of two that both read a column the first is taken.
SHAPES = {
    "MM/dd/yyyy": _SLASHES,
    "dd/MM/yyyy": _SLASHES,
    "yyyy-MM-dd": r"\d{4}-\d{2}-\d{2}",
    "dd.MM.yyyy": r"\d{2}\.\d{2}\.\d{4}",
    "yyyy/MM/dd": r"\d{4}/\d{2}/\d{2}",
    "MM-dd-yyyy": _DASHES,
    "dd-MM-yyyy": _DASHES,
    "MM/dd/yy": r"\d{2}/\d{2}/\d{2}",
    "dd/MM/yy": r"\d{2}/\d{2}/\d{2}",
    "dd-MMM-yyyy": rf"\d{{2}}-{_MON}-\d{{4}}",
    "MMMM d, yyyy": rf"{_MONTH} \d{{1,2}}, \d{{4}}",
    "MMM d, yyyy": rf"{_MON} \d{{1,2}}, \d{{4}}",
    "d MMMM yyyy": rf"\d{{1,2}} {_MONTH} \d{{4}}",
    "d MMM yyyy": rf"\d{{1,2}} {_MON} \d{{4}}",
    "yyyy-MM-dd HH:mm": r"\d{4}-\d{2}-\d{2}" + _TIME,
    "MM/dd/yyyy HH:mm": _SLASHES + _TIME,
    "dd/MM/yyyy HH:mm": _SLASHES + _TIME,
}
PATTERNS = tuple(SHAPES)
#: Pairs that differ in the order of day and month only.
ORDERS = tuple(
    (p, p.replace("MM", "_").replace("dd", "MM").replace("_", "dd")) for p in PATTERNS if p.startswith("MM") and not p.startswith("MMM")
)
DEFAULT = PATTERNS[0]


def bit(pattern: str) -> int:
    return 1 << PATTERNS.index(pattern)


def _day_pattern(pattern: str) -> str:
    """The pattern of the day alone, which also reads one-digit parts between slashes."""
    day = pattern.split(" HH")[0]
    return day.replace("MM/", "M/").replace("dd/", "d/") if day.endswith("/yyyy") else day


def _timed(pattern: str) -> bool:
    return " HH" in pattern


def read_day(text: Column, pattern: str) -> Column:
    """The day a text stands for in this pattern, else NULL."""
    day = F.regexp_extract(text, r"^[0-9/-]+", 0) if _timed(pattern) else text
    read = F.try_to_date(F.when(text.rlike(f"^{SHAPES[pattern]}\\z"), day), _day_pattern(pattern))
    # Spark reads two digits as 2000 to 2099; those of 1969 to 1999 are meant by 69 and more.
    return F.when(F.year(read) < 2069, read).otherwise(F.add_months(read, -1200)) if pattern.endswith("/yy") else read


def pattern_bits(text: Column) -> Column:
    """A bit for each pattern that reads the text (BIGINT)."""
    bits = F.lit(0).cast("bigint")
    for pattern in PATTERNS:
        bits = bits.bitwiseOR(F.when(read_day(text, pattern).isNotNull(), F.lit(bit(pattern))).otherwise(F.lit(0)).cast("bigint"))
    # One look at the text spares the rest for values that are no dates.
    return F.when(text.rlike(r"^[0-9\p{L}].{3,38}[0-9MmZ]\z") & text.rlike(r"[0-9]"), bits).otherwise(F.lit(0).cast("bigint"))


def shift(text: Column, pattern: str, offset: Column) -> Column:
    """The text with its day moved, in its own pattern; NULL where it isn't read or leaves year 9999."""
    if pattern not in SHAPES:  # any other pattern Spark knows
        day, written, rest = F.try_to_date(text, pattern), pattern, None
    else:
        day, written = read_day(text, pattern), pattern.split(" HH")[0]
        rest = F.regexp_replace(text, r"^[0-9/-]+", "") if _timed(pattern) else None
    moved = F.date_add(day, offset)
    shown = F.date_format(F.when(moved <= F.lit("9999-12-31").cast("date"), moved), written)
    return shown if rest is None else F.concat(shown, rest)


def replaces_default(formats: list[str]) -> bool:
    """Whether the formats put the day first between slashes, so that months first would be wrong."""
    return DEFAULT not in formats and any(p.startswith("d") and "/yyyy" in p and "HH" not in p for p in formats)
