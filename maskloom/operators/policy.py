"""Policies: which column holds which field type.

On the driver a policy is a short ordered mapping, one entry per column. As data, policies are
tables, so that many of them can be normalised or stored in one job.
"""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.fields import FIELD_TYPES
from maskloom.session import column


#: Between the date patterns of one column, where a table holds them as text.
FORMATS_BETWEEN = "; "


class PolicyEntry(NamedTuple):
    column: str
    field_type: str
    category_column: str | None = None
    #: Patterns of a date beyond ``MM/dd/yyyy``.
    formats: tuple[str, ...] = ()


def as_entries(policy) -> list[PolicyEntry]:
    """A mapping or a list of entries as checked entries, in order."""
    if isinstance(policy, dict):
        entries = [_entry(name, rule) for name, rule in policy.items()]
    else:
        entries = [PolicyEntry(*entry) for entry in policy]
    entries = [entry._replace(formats=_formats(entry.formats)) for entry in entries]
    names = [entry.column for entry in entries]
    twice = sorted({name for name in names if names.count(name) > 1})
    if twice:
        raise ValueError(f"columns named twice in the policy: {twice}")
    for entry in entries:
        if entry.field_type not in FIELD_TYPES:
            raise ValueError(f"unsupported field type for {entry.column!r}: {entry.field_type!r}")
        if entry.category_column is not None and entry.field_type != "description":
            raise ValueError(f"only a description takes a category column, not {entry.column!r}")
        if entry.formats and entry.field_type != "date":
            raise ValueError(f"only a date takes formats, not {entry.column!r}")
    return entries


def _formats(formats) -> tuple[str, ...]:
    if not formats:
        return ()
    return tuple(formats.split(FORMATS_BETWEEN)) if isinstance(formats, str) else tuple(formats)


def _entry(name: str, rule) -> PolicyEntry:
    if not isinstance(rule, dict):
        return PolicyEntry(name, rule)
    if "confidence" in rule:  # a detected rule; its category link, if any, isn't part of it
        return PolicyEntry(name, rule["type"], None, _formats(rule.get("formats")))
    if rule["type"] == "date" and "formats" in rule:
        return PolicyEntry(name, "date", None, _formats(rule["formats"]))
    if rule["type"] != "description":
        raise ValueError(f"unsupported rule for {name!r}: {rule['type']!r}")
    if "category_column" not in rule:
        raise KeyError(f"{name!r} needs a category_column")
    return PolicyEntry(name, rule["type"], rule["category_column"])


def read_policy_file(path: str | Path) -> list[PolicyEntry]:
    """A policy from a TOML file, or from YAML or JSON by its suffix."""
    path = Path(path)
    if path.suffix == ".json":
        data = json.loads(path.read_text(encoding="utf-8"))
    elif path.suffix in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    else:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
    if not data or "columns" not in data:
        raise KeyError(f"no [columns] table in {path}")
    return as_entries(data["columns"])


def policy_file_write(detections: DataFrame, path: str | Path) -> None:
    """Store detection results as a file to be edited: ``columns``, and ``skipped`` with the reason.

    JSON, which YAML readers take as well, so the suffix is ``.json``, ``.yaml`` or ``.yml``. To link
    a description to its category, replace its rule by one with ``category_column`` and without a
    confidence. One row per column of one table comes to the driver.
    """
    path = Path(path)
    if path.suffix not in (".json", ".yaml", ".yml"):
        raise ValueError(f"a policy file ends in .json, .yaml or .yml, not {path.name!r}")
    columns, skipped = {}, {}
    for row in detections.orderBy("position").collect():
        if row["status"] == "detected":
            columns[row["column"]] = {"type": row["type"], "confidence": row["confidence"]}
            if row["formats"]:
                columns[row["column"]]["formats"] = list(_formats(row["formats"]))
        else:
            skipped[row["column"]] = {"confidence": row["confidence"], "reason": "low_confidence"}
    document = {"columns": columns, "skipped": skipped}
    path.write_text(json.dumps(document, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def policy_normalise(documents: DataFrame, document: str) -> DataFrame:
    """One row per column of each JSON policy document, in document order.

    A rule is a type name or an object. An object with a confidence is a detected rule and is
    reduced to its type. A document without ``columns`` is an error.
    """
    others = [c for c in documents.columns if c != document]
    rules = F.from_json(column(document), "columns MAP<STRING, STRING>")["columns"]
    checked = F.when(rules.isNull(), F.raise_error(F.lit("a policy document has no columns"))).otherwise(rules)
    listed = documents.select(*[column(c) for c in others], F.posexplode(checked).alias("position", "column", "rule"))
    is_object = F.ltrim("rule").startswith("{")
    parsed = F.from_json(F.when(is_object, F.col("rule")), "type STRING, category_column STRING")
    detected = F.array_contains(F.json_object_keys(F.when(is_object, F.col("rule"))), "confidence")
    return listed.withColumn("parsed", parsed).select(
        *[column(c) for c in others],
        "position",
        "column",
        F.when(is_object, F.col("parsed.type")).otherwise(F.col("rule")).alias("field_type"),
        F.when(~F.coalesce(detected, F.lit(False)), F.col("parsed.category_column")).alias("category_column"),
    )


def policy_table_write(detections: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store detection results; skipped rows carry the reason instead of a type."""
    detected = F.col("status") == F.lit("detected")
    if "formats" not in detections.columns:
        detections = detections.withColumn("formats", F.lit(None).cast("string"))
    detections.select(
        "position",
        "column",
        F.when(detected, F.col("type")).alias("field_type"),
        F.lit(None).cast("string").alias("category_column"),
        F.when(detected, F.col("formats")).alias("formats"),
        "confidence",
        "status",
        F.when(~detected, F.lit("low_confidence")).alias("reason"),
    ).write.mode("overwrite").format(fmt).save(path)


POLICY_SCHEMA = (
    "position INT, column STRING, field_type STRING, category_column STRING, formats STRING, "
    "confidence DOUBLE, status STRING, reason STRING"
)


def policy_table_read(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """The detected rules of a stored policy; a category column added by hand is kept."""
    stored = spark.read.schema(POLICY_SCHEMA).format(fmt).load(path)
    return stored.where(F.col("status") == "detected").select(
        "position", "column", "field_type", "category_column", "formats"
    )


def policy_entries(policy: DataFrame) -> list[PolicyEntry]:
    """A policy table as driver-side entries: one row per column of one table."""
    rows = policy.orderBy("position").select("column", "field_type", "category_column", "formats").collect()
    return as_entries([tuple(row) for row in rows])
