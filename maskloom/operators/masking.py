"""Masking a column, a long table of typed values, or a whole table by policy.

Masking is one projection: no shuffle, no join, no Python worker. It runs unchanged on
streaming frames.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions import fields
from maskloom.functions.hashing import MAX_MODULUS, md5_index, text_array
from maskloom.functions.pools import DEFAULT_CATEGORY, DEFAULT_POOLS, Pools
from maskloom.operators.policy import PolicyEntry, as_entries
from maskloom.session import column

MASKED = "__masked"
INDEX, DOMAIN_INDEX = "__masked_index", "__masked_domain_index"


def mask_value(
    value: Column,
    field_type: str,
    *,
    offset: Column | int | None = None,
    multiplier: Column | float | None = None,
    category: Column | str | None = None,
    numeric: bool = False,
    formats: list[str] | None = None,
    pools: Pools = DEFAULT_POOLS,
) -> Column:
    """The masked form of a value; NULL where a date or amount cannot be read."""
    if field_type == "name":
        return fields.mask_name(value, pools)
    if field_type == "email":
        return fields.mask_email(value, pools)
    if field_type == "country":
        return fields.mask_country(value, pools)
    if field_type == "category":
        return fields.mask_category(value, pools)
    if field_type == "description":
        return fields.mask_description(value, category, pools)
    if field_type == "date":
        if offset is None:
            raise ValueError("a date needs an offset or a salt")
        return fields.mask_date(value, offset, formats)
    if field_type == "amount":
        if multiplier is None:
            raise ValueError("an amount needs a multiplier or a salt")
        return fields.mask_amount(value, multiplier, numeric)
    if field_type == "id":
        return value
    raise ValueError(f"unsupported field type: {field_type!r}")


def mask_values(
    df: DataFrame,
    value: str,
    field_type: str,
    salt: Column | str,
    on_error: str = "keep",
    pools: Pools = DEFAULT_POOLS,
    category: str | None = None,
) -> DataFrame:
    """Mask a long table: text in ``value``, its type beside it; an unknown type is an error.

    ``category`` names the column that chooses the pool of a description; without it, and where it
    is NULL or unknown, the default pool is used.

    Inside a branch per type nothing is shared, so a row would hash its value several times. The
    value is hashed once ahead of the branches, modulo the least common multiple of the pool
    sizes, and only in rows whose type needs it. Where that multiple is too large, each branch
    hashes its values modulo its own pool's size.
    """
    text, kind = column(value), column(field_type)
    offset, multiplier = fields.derive_offset(salt), fields.derive_multiplier(salt)
    pooled = {
        "name": pools.names,
        "email": pools.email_users,
        "country": pools.countries,
        "category": pools.categories,
        "description": pools.merchants[DEFAULT_CATEGORY],
    }
    if category is not None:  # descriptions hash modulo their own pools, in their branch
        del pooled["description"]
    common = math.lcm(*[len(pool) for pool in pooled.values()])
    shared = common <= MAX_MODULUS
    hashed = df.withColumns(
        {
            INDEX: md5_index(F.when(kind.isin(*pooled), text), common if shared else 1),
            DOMAIN_INDEX: md5_index(F.when(kind == "email", F.concat(text, F.lit(":domain"))), len(pools.email_domains)),
        }
    )
    picked = {
        t: F.get(text_array(pool), F.col(INDEX) % len(pool) if shared else md5_index(text, len(pool))) for t, pool in pooled.items()
    }
    if category is not None:
        picked["description"] = fields.mask_description(text, column(category), pools)
    picked["email"] = F.concat(picked["email"], F.lit("@"), F.get(text_array(pools.email_domains), F.col(DOMAIN_INDEX)))
    picked["date"] = fields.keep_on_error(fields.mask_date(text, offset), text, on_error)
    picked["amount"] = fields.keep_on_error(fields.mask_amount(text, multiplier, False), text, on_error)
    for kind_of in ("date", "amount"):
        picked[kind_of] = _with_salt(picked[kind_of], text, salt)
    picked["id"] = text
    unknown = F.concat(F.lit("unsupported field type: "), F.coalesce(kind, F.lit("NULL")))
    masked = reduce(lambda chain, t: chain.when(kind == t, picked[t]), fields.FIELD_TYPES, F)
    masked = masked.otherwise(F.raise_error(unknown).cast("string"))
    return hashed.select(*[masked.alias(c) if c == value else column(c) for c in df.columns])


def _with_salt(masked: Column, value: Column, salt: Column | str) -> Column:
    """An error in rows that have a value but no salt; kept, the value would leave unmasked."""
    if isinstance(salt, str):
        return masked
    missing = value.isNotNull() & (F.coalesce(salt.cast("string"), F.lit("")) == "")
    return F.when(missing, F.raise_error(F.lit("a date or amount without a salt"))).otherwise(masked)


def _salted(df: DataFrame, salt: Column) -> tuple[DataFrame, str, str]:
    """Shift and factor of each row in columns of their own, so that a salt is hashed once a row; NULL without a salt."""
    names = []
    for wanted in ("__offset", "__multiplier"):
        while wanted.lower() in {c.lower() for c in df.columns}:
            wanted += "_"
        names.append(wanted)
    known = F.when(F.coalesce(salt.cast("string"), F.lit("")) != "", salt.cast("string"))
    offset, multiplier = names
    return df.withColumns({offset: fields.derive_offset(known), multiplier: fields.derive_multiplier(known)}), offset, multiplier


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def mask_column(df: DataFrame, name: str, field_type: str, *, salt=None, on_error: str = "keep", **kwargs) -> DataFrame:
    """Replace one column in place."""
    return mask_table(df, [PolicyEntry(name, field_type)], salt=salt, on_error=on_error, **kwargs)


def mask_side_by_side(
    df: DataFrame,
    policy,
    salt: Column | str | None = None,
    *,
    on_error: str = "keep",
    formats: dict[str, list[str]] | None = None,
    pools: Pools = DEFAULT_POOLS,
) -> DataFrame:
    """The table with a ``<column>__masked`` twin after the columns of each policy entry.

    Entries apply in policy order: a description reads its category as it stands at that
    moment, so a category masked earlier is read in masked form. All entries up to such a
    dependency share one projection.
    """
    entries = as_entries(policy)
    _check(df, entries, salt)
    by_row = isinstance(salt, Column) and any(entry.field_type in ("date", "amount") for entry in entries)
    added: list[str] = []
    if by_row:
        df, *added = _salted(df, salt)
        offset, multiplier = map(column, added)
    else:
        offset = fields.derive_offset(salt) if salt is not None else None
        multiplier = fields.derive_multiplier(salt) if salt is not None else None

    done: set[str] = set()
    pending: dict[str, Column] = {}
    for entry in entries:
        source, category = column(entry.column), None
        if entry.category_column is not None:
            category = column(entry.category_column)
            if entry.category_column + MASKED in pending:
                df, pending = df.withColumns(pending), {}
            if entry.category_column in done:
                category = column(entry.category_column + MASKED)
        masked = mask_value(
            source,
            entry.field_type,
            offset=offset,
            multiplier=multiplier,
            category=category,
            numeric=_is_numeric(df, entry.column),
            formats=(formats or {}).get(entry.column) or list(entry.formats),
            pools=pools,
        )
        if entry.field_type in ("date", "amount"):
            original = source if _is_numeric(df, entry.column) else source.cast("string")
            masked = fields.keep_on_error(masked, original, on_error)
            if by_row:
                missing = source.isNotNull() & offset.isNull()
                masked = F.when(missing, F.raise_error(F.lit("a date or amount without a salt"))).otherwise(masked)
        pending[entry.column + MASKED] = masked
        done.add(entry.column)
    return (df.withColumns(pending) if pending else df).drop(*added)


def mask_table(df: DataFrame, policy, salt: Column | str | None = None, **kwargs) -> DataFrame:
    """The table with every policy column replaced; columns keep their order and names.

    ``salt`` is the name of the input file, as text or as a column (many files in one run);
    it sets the date shift and the amount factor.
    """
    twins = mask_side_by_side(df, policy, salt, **kwargs)
    masked = {entry.column for entry in as_entries(policy)}
    return twins.select(
        *[column(c + MASKED).alias(c) if c in masked else column(c) for c in df.columns]
    )


def _check(df: DataFrame, entries: list[PolicyEntry], salt) -> None:
    wanted = [e.column for e in entries] + [e.category_column for e in entries if e.category_column is not None]
    missing = [c for c in dict.fromkeys(wanted) if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    taken = [e.column for e in entries if e.column + MASKED in df.columns]
    if taken:
        raise ValueError(f"columns already end in {MASKED!r}: {taken}")
    if isinstance(salt, str) and not salt:
        raise ValueError("an empty salt")
    for entry in entries:
        if entry.field_type in ("date", "amount") and salt is None:
            raise ValueError(f"{entry.column!r} is a {entry.field_type} and needs a salt")
