"""Picking an exact number of rows by a hash of their key.

``by_count`` picks ``int(rows * rate)`` rows: a few counting passes find the digest that many
rows sort below. Each pass brings at most 4,096 counters to the driver; no row is moved, sorted
or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import hash_of

DIGITS_PER_PASS = 3


def by_count(df: DataFrame, step: str, rate: float, key: Column) -> Column:
    digest = hash_of(step, key)
    prefix, before, wanted = "", 0, None
    while True:
        width = len(prefix) + DIGITS_PER_PASS
        head = F.substring(digest, 1, width)
        inside = df.select(head.alias("head")).where(F.col("head").startswith(prefix))
        counts = sorted(tuple(row) for row in inside.groupBy("head").count().collect())
        if wanted is None:
            wanted = int(sum(count for _, count in counts) * rate)
        if wanted == 0:
            return F.lit(False)
        for head_text, count in counts:
            if before + count > wanted:
                break
            before += count
            if before == wanted:
                return head <= F.lit(head_text)
        if width >= 32:
            raise ValueError("row keys must be unique to pick an exact number of rows")
        # The cut lies inside this bucket: look at its next digits.
        prefix = head_text
