"""MD5 as a number, in built-in expressions only.

``md5_index`` equals ``int(md5(text).hexdigest(), 16) % n``. The digest is read as two 64-bit
halves. ``conv`` to base -10 gives a half as a signed number that fits BIGINT; where it came out
negative, ``2**64 % n`` is added back. Two words take about a tenth less time than three or four
narrower ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keeps the weighted halves below 2**63.
MAX_MODULUS = 2**30


def md5_hex(value: Column) -> Column:
    """Hex MD5 of the UTF-8 bytes of a value; NULL stays NULL."""
    return F.md5(value.cast("string").cast("binary"))


def digest_mod(digest: Column, n: int) -> Column:
    """A 32-digit hex digest, read as a whole number, modulo ``n`` (BIGINT)."""
    if not 0 < n <= MAX_MODULUS:
        raise ValueError(f"modulus out of range: {n}")
    wrap = 2**64 % n

    def half(first: int) -> Column:
        signed = F.conv(F.substring(digest, first, 16), 16, -10).cast("bigint")
        return F.pmod(signed, F.lit(n)) + F.when(signed < 0, F.lit(wrap)).otherwise(F.lit(0))

    return (half(1) * F.lit(wrap) + half(17)) % F.lit(n)


def md5_index(value: Column, n: int) -> Column:
    """Stable index of a value into a list of ``n`` entries (INT, 0-based)."""
    return digest_mod(md5_hex(value), n).cast("int")


def hash_of(*parts: Column | str) -> Column:
    """Hex MD5 of parts joined by ``|``."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return md5_hex(F.concat_ws("|", *columns))


# Draws: a digest holds four 32-bit words, so it answers four independent questions.


def word(digest: Column, slot: int) -> Column:
    return F.substring(digest, 1 + 8 * slot, 8)


def draw(digest: Column, slot: int, n: int) -> Column:
    """A whole number below ``n``, for ``n`` far below 2**32 (INT)."""
    return (F.conv(word(digest, slot), 16, 10).cast("bigint") % F.lit(n)).cast("int")


def draw_from(digest: Column, slot: int, pool) -> Column:
    """One entry of a pool."""
    return F.get(text_array(pool), draw(digest, slot, len(pool)))


def drawn_below(digest: Column, slot: int, rate: float) -> Column:
    """True for about ``rate`` of all digests; compares digits, so it needs no ``conv``."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"rate out of range: {rate}")
    if rate == 1.0:
        return F.lit(True)
    return word(digest, slot) < F.lit(f"{round(rate * 2**32):08x}")


#: Pools of more entries are handed over as one text, as a literal for each entry takes long to plan.
MANY_ENTRIES = 1000
#: A pool travels with every task, so its text is bounded.
POOL_CHARS_MAX = 2**26


def text_array(pool) -> Column:
    """A pool as one literal array; Catalyst folds it once per plan.

    A pool of more than ``POOL_CHARS_MAX`` characters is an error.
    """
    if len(pool) <= MANY_ENTRIES:
        return F.array(*[F.lit(entry) for entry in pool])
    between = next((c for c in map(chr, range(1, 32)) if not any(c in entry for entry in pool)), None)
    if between is None:
        raise ValueError("no control character is left to separate the entries of a pool")
    joined = between.join(pool)
    if len(joined) > POOL_CHARS_MAX:
        raise ValueError(f"a pool of {len(joined)} characters, of at most {POOL_CHARS_MAX}")
    return F.split(F.lit(joined), f"\\x{ord(between):02x}", -1)
