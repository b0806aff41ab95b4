"""CSV and parquet in and out.

CSV is read as text only: an untouched column is written back as it came, and a masking rule
sees the text that stood in the file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.session import column

# The words a CSV reader of the pandas family takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def csv_scan(
    spark: SparkSession,
    path: str | list[str],
    *,
    multi_line: bool | None = None,
    na_tokens=NA_TOKENS,
    mode: str = "PERMISSIVE",
    surplus: str = "error",
    file_name: str | None = None,
    file_path: str | None = None,
) -> DataFrame:
    """Read CSV files with a header as text columns.

    ``multi_line`` allows line breaks inside quotes, but then one file is one task; without them
    big files are split. By default the files are searched for such breaks first, in a scan of
    their lines that is itself split. ``na_tokens`` become NULL (pass
    none to keep the text). Short records are filled up with NULL. A record with more fields than
    the header is an error that names its file; with ``surplus="drop"`` its further fields are cut,
    with ``"reject"`` it is left out and stands in ``csv_rejects``. ``file_name`` and
    ``file_path`` add the decoded name and path of each row's file.
    """
    if surplus not in ("error", "drop", "reject"):
        raise ValueError(f"surplus is 'error', 'drop' or 'reject', not {surplus!r}")
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    reader, names = _reader(spark, path, multi_line, mode)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if surplus != "drop" and mode == "PERMISSIVE":
        df, record = _with_record(reader, schema, path)
        kept = _without_surplus(record, names) if surplus == "error" else ~_is_surplus(record, names)
        df = df.where(kept).drop(record)
    else:
        df = reader.schema(schema).csv(path)
    if file_name is not None:
        df = df.withColumn(file_name, file_name_column())
    if file_path is not None:
        df = df.withColumn(file_path, _decoded("_metadata.file_path"))
    return csv_na_normalise(df, na_tokens, names) if na_tokens else df


def _reader(spark: SparkSession, path: str | list[str], multi_line: bool, mode: str) -> tuple[DataFrameReader, list[str]]:
    """A reader of files with one header, and the names of its columns."""
    options = {"multiLine": multi_line, "escape": '"', "mode": mode, "encoding": "UTF-8"}
    header = spark.read.options(header=False, **options).csv(path).first()
    if header is None:
        raise ValueError(f"no header in {path}")
    # Without a header Spark names file columns _c0, _c1, ...; the rest stand in folder names.
    titles = [header[c] for c in header.__fields__ if re.fullmatch(r"_c\d+", c)]
    names = distinct_names(titles)
    # Unique names let Spark check every file's header against the schema: files whose columns
    # stand in another order would otherwise be masked under the wrong rule.
    enforce = names != titles
    if enforce:
        _check_headers(spark, path)
    return spark.read.options(header=True, enforceSchema=enforce, **options), names


def _with_record(reader: DataFrameReader, schema: T.StructType, path: str | list[str]) -> tuple[DataFrame, str]:
    """The table with the text of malformed records in a further column, and that column's name."""
    record = _unused("_record", schema.names)
    whole = T.StructType([*schema.fields, T.StructField(record, T.StringType())])
    return reader.options(columnNameOfCorruptRecord=record, columnPruning=False).schema(whole).csv(path), record


def csv_rejects(spark: SparkSession, path: str | list[str], *, multi_line: bool | None = None) -> DataFrame:
    """``file_path, expected, fields, record``: the records that ``csv_scan(surplus="reject")`` leaves out."""
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    reader, names = _reader(spark, path, multi_line, "PERMISSIVE")
    df, record = _with_record(reader, T.StructType([T.StructField(name, T.StringType()) for name in names]), path)
    return df.where(_is_surplus(record, names)).select(
        _decoded("_metadata.file_path").alias("file_path"), F.lit(len(names)).alias("expected"), field_count(column(record)).alias("fields"),
        column(record).alias("record"),
    )


def field_count(record: Column) -> Column:
    """How many fields the parser takes a record for (INT).

    Only a quote at the start of a field opens a quoted one; any other, like an inch mark, is text. A
    quoted field that is never closed goes on to the end of the record.
    """
    bare = F.replace(record, F.lit('""'), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(bare, '(^|,)"[^"]*"', "$1"), '(^|,)"[^"]*\\z', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _is_surplus(record: str, names: list[str]) -> Column:
    """Spark keeps the text of records that are too short or too long; the fields tell which."""
    # Spark refuses to read the text alone, so the (empty) beginning of a column is read with it.
    read = F.substring(F.coalesce(column(names[0]), F.lit("")), 1, 0) == ""
    return F.coalesce((field_count(column(record)) > len(names)) & read, F.lit(False))


def _unused(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _without_surplus(record: str, names: list[str]) -> Column:
    """True, or an error where a malformed record has more fields than ``names``."""
    problem = F.concat(F.lit("surplus fields in "), _decoded("_metadata.file_path"), F.lit(": "), column(record))
    return F.when(_is_surplus(record, names), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))


def _check_headers(spark: SparkSession, path: str | list[str]) -> None:
    """Spark can't check headers with repeated or blank names: the first lines of all files must be equal."""
    lines = spark.read.text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")
    )
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "line").alias("header"))
    header = F.regexp_replace("header", "^\ufeff|\r$", "")
    found = first.groupBy(header.alias("header")).agg(F.min("file_path").alias("file")).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"headers differ, and names are repeated or blank: {found[0].file} and {found[1].file}")


def has_quoted_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether any line has an odd number of quotes, as one cut inside a quoted value does.

    A stray quote also counts; the files are then read in the slower way, which is right too.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def distinct_names(header: list[str | None]) -> list[str]:
    """Header names with repeats numbered ``a``, ``a.1`` and blanks named by position.

    Names that differ in case only are numbered too, as Spark takes them for one.
    """
    names: list[str] = []
    taken: set[str] = set()
    for position, name in enumerate(header):
        base = name or f"Unnamed: {position}"
        candidate, repeat = base, 0
        while candidate.lower() in taken:
            repeat += 1
            candidate = f"{base}.{repeat}"
        names.append(candidate)
        taken.add(candidate.lower())
    return names


def csv_na_normalise(df: DataFrame, na_tokens=NA_TOKENS, columns: list[str] | None = None) -> DataFrame:
    """Turn null words into NULL in the given text columns (all text columns by default)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    tokens = list(na_tokens)
    return df.withColumns({c: F.when(~column(c).isin(tokens), column(c)) for c in columns})


def csv_sink(df: DataFrame, path: str, *, by_file: str | None = None, mode: str = "errorifexists") -> None:
    """Write CSV with a header, NULL and empty text both as nothing, quotes doubled.

    In a table of one column they are written as ``""``, as an empty line is no record.
    ``by_file`` names a column with one output name per input file; each gets its own folder.
    """
    nothing = '""' if len([c for c in df.columns if c != by_file]) == 1 else ""
    writer = df.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue=nothing, nullValue=nothing
    )
    if by_file is not None:
        writer = writer.partitionBy(by_file)
    writer.csv(path)


def file_name_column() -> Column:
    """The name of each row's file."""
    return _decoded("_metadata.file_name")


def _decoded(name: str) -> Column:
    """Metadata columns are percent-encoded except for ``+``."""
    return F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))


def anon_path(path: Column) -> Column:
    """``folder/x.csv`` as ``folder/x_ANON.csv``; a leading dot does not start a suffix."""
    return F.regexp_replace(path, r"([^/]+?)(\.[^./]+)?\z", "$1_ANON$2")


def parquet_scan(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Read parquet, only the named columns if given."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    return df.select(*[column(c) for c in columns]) if columns else df


def parquet_sink(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write zstd parquet."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
