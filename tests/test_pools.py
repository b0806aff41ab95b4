"""Pools of many entries give what short ones give, and plan quickly."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from maskloom.functions.hashing import MANY_ENTRIES, POOL_CHARS_MAX, text_array
from maskloom.functions.pools import Pools
from maskloom.operators.audit import audit_pool
from maskloom.operators.masking import MASKED, mask_side_by_side, mask_table

NAMES = tuple(f"Given{i} Family{i * 7 % 1009}" for i in range(200_000))
POOLS = Pools(names=NAMES, email_users=tuple(f"box{i}" for i in range(5000)))


def chosen(value):
    return NAMES[int(hashlib.md5(value.encode()).hexdigest(), 16) % len(NAMES)]


def test_a_pool_of_many_entries_picks_by_the_same_index(small, policy):
    start = time.time()
    got = mask_table(small, policy, pools=POOLS).select("name").collect()
    assert time.time() - start < 30
    assert [r.name for r in got] == [chosen(r.name) for r in small.collect()]


def test_entries_keep_blanks_and_signs(spark):
    pool = ["", "a\x01b", "\\x02", "é\n", "x" * 50, *map(str, range(MANY_ENTRIES)), ""]
    assert spark.range(1).select(text_array(pool)).first()[0] == pool


def test_pools_too_big_are_errors(spark):
    with pytest.raises(ValueError):
        text_array(["x" * (POOL_CHARS_MAX // 1000)] * 1001)
    with pytest.raises(ValueError):
        text_array(["".join(map(chr, range(1, 32)))] * (MANY_ENTRIES + 1))


def test_outputs_outside_a_pool_of_many_entries_are_found(small, with_nulls, policy):
    both = small.unionAll(with_nulls)
    pairs = mask_side_by_side(both, policy, pools=POOLS)
    clean = {r["column"]: tuple(r)[1:] for r in audit_pool(pairs, policy, POOLS).collect()}
    assert clean == {c: (105, 0, True) for c in policy}
    name, email = F.col("name" + MASKED), F.col("email" + MASKED)
    broken = pairs.withColumn("name" + MASKED, F.when(F.col("name") < "Guest 010", "Nobody").otherwise(name))
    broken = broken.withColumn("email" + MASKED, F.when(F.col("name") < "Guest 004", "no address").otherwise(email))
    found = {r["column"]: r.outside for r in audit_pool(broken, policy, POOLS).collect()}
    assert found == {"name": 10, "email": 4, "country": 0}
    assert [r.outside for r in audit_pool(pairs.where("false"), policy, POOLS).collect()] == [0, 0, 0]
