"""Jobs put together from the operators, one call each."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import fields
from maskloom.operators import audit, detect, generate, messiness
from maskloom.operators.masking import mask_table
from maskloom.operators.policy import (
    policy_entries, policy_file_write, policy_table_read, policy_table_write, read_policy_file,
)
from maskloom.session import column, scratch_path, tune
from maskloom.sources.tables import anon_path, csv_scan, csv_sink, has_quoted_breaks, parquet_scan, parquet_sink

OUTPUT_NAME = "output_name"


def mask_csv(spark: SparkSession, path: str | list[str], policy, output: str, *, multi_line: bool | None = None, **kwargs) -> str:
    """Mask any number of CSV files in one job, each with the salt of its own name.

    The output folder gets one folder per input file, named like ``x_ANON.csv``, or like
    ``folder/x_ANON.csv`` (with an escaped slash) below the folder that all inputs share. The
    column of these names is returned: ``output_name``, lengthened where the data has it already.
    ``policy`` is a mapping, a list of entries, or the path of a TOML or YAML file.
    """
    if isinstance(policy, (str, Path)):
        policy = read_policy_file(policy)
    if multi_line is None:  # looked for once, as that is a scan of all lines
        multi_line = has_quoted_breaks(spark, path)
    plain = csv_scan(tune(spark), path, multi_line=multi_line).columns
    taken = list(plain)
    for wanted in (OUTPUT_NAME, "__file_name", "__file_path"):
        name = wanted
        while name.lower() in {c.lower() for c in taken}:
            name += "_"
        taken.append(name)
    output_name, file_name, file_path = taken[-3:]
    df = csv_scan(spark, path, multi_line=multi_line, file_name=file_name, file_path=file_path)
    masked = mask_table(df, policy, column(file_name), **kwargs)
    below = F.regexp_replace(column(file_path), "^file:/+", "file:/").substr(F.lit(len(_shared_folder(spark, path)) + 2), F.length(column(file_path)))
    csv_sink(masked.withColumn(output_name, anon_path(below)).drop(file_name, file_path), output, by_file=output_name)
    return output_name


def _shared_folder(spark: SparkSession, path: str | list[str]) -> str:
    """The folder above all inputs, without a closing slash."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    folders = []
    for one in [path] if isinstance(path, str) else path:
        place = hadoop.Path(one)
        system = place.getFileSystem(conf)
        parts = system.makeQualified(place).toString().split("/")
        wild = next((i for i, part in enumerate(parts) if any(c in part for c in "*?[{")), None)
        if wild is not None:
            parts = parts[:wild]
        elif system.getFileStatus(place).isFile():
            parts = parts[:-1]
        folders.append([x for i, x in enumerate(parts) if x or i == 1 and not parts[0].startswith("file:")])
    shared = []
    for level in zip(*folders, strict=False):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return "/".join(shared)


def propose_policy(spark: SparkSession, df: DataFrame, path: str, threshold: float = detect.THRESHOLD, **kwargs) -> DataFrame:
    """Detect the columns' types and store the proposal, to be reviewed or edited before use."""
    policy_table_write(detect.detect_columns(df, threshold, **kwargs), path)
    return spark.read.parquet(path)


def detect_and_mask(
    spark: SparkSession, df: DataFrame, policy_path: str | Path, salt, row_key: str | None = None, detector=detect.detect_columns, **kwargs
) -> DataFrame:
    """Detect the columns' types, keep the proposal as a policy file, and mask the table by that file.

    ``detector`` is ``detect.detect_columns`` or, for the trained scorer, ``learned.propose``.
    """
    policy_file_write(detector(df, row_key=row_key, **kwargs), policy_path)
    return mask_table(df, read_policy_file(policy_path), salt)


def mask_with_stored_policy(spark: SparkSession, df: DataFrame, policy_path: str, salt, output: str) -> dict:
    """Mask a table by a stored policy, write parquet, and report what was done."""
    entries = policy_entries(policy_table_read(tune(spark), policy_path))
    return audit.write_with_report(mask_table(df, entries, salt), entries, output)


def volume_table(spark: SparkSession, rows: int, output: str, partitions: int | None = None) -> DataFrame:
    """Generate people, dirty the table in all steps, write it as parquet, and read it back."""
    base = generate.gen_base(tune(spark), rows, partitions=partitions)
    parquet_sink(messiness.mess_all(base), output, mode="overwrite")
    return parquet_scan(spark, output)


def volume_table_exact(spark: SparkSession, rows: int, output: str) -> DataFrame:
    """The same with exact row counts per step; the table is stored after every step."""
    from maskloom.operators.selection import by_count

    def store(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "mess-step")
        parquet_sink(df, path)
        return parquet_scan(spark, path)

    base = store(generate.gen_base(tune(spark), rows))
    parquet_sink(messiness.mess_all(base, pick=by_count, between=store), output, mode="overwrite")
    return parquet_scan(spark, output)


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder: output name, date shift and amount factor; contents are not read."""
    location = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    listed = spark.read.format("binaryFile").load(path).select(location.alias("path"))
    name = F.substring_index("path", "/", -1)
    return listed.select(
        "path",
        name.alias("file_name"),
        anon_path(F.col("path")).alias("output_path"),
        fields.derive_offset(name).alias("offset"),
        fields.derive_multiplier(name).alias("multiplier"),
    )
