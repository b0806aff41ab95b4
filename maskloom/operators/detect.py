"""Proposing a policy: sample every column, score the sample, split by confidence.

The first scan counts, per column, the non-null values whose row hash falls below a few
thresholds. The second reads, for each threshold in use, the columns that need it and only the
rows below it, which are sure to hold the sample. Most tables use one threshold; sparse columns
take a wider one. At most 50 values per column and task are shuffled.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.fields import FIELD_TYPES
from maskloom.functions.hashing import hash_of
from maskloom.operators.policy import FORMATS_BETWEEN
from maskloom.session import column

# The sample rule and the default threshold.
SAMPLE_SHARE_MIN, SAMPLE_SHARE_MAX, SAMPLE_MAX = 0.1, 0.2, 50
THRESHOLD = 0.80

ZERO_STEPS = (8, 6, 4, 2, 0)
HASH = "__hash"

# Countries by two-letter code and English short name; pass ``countries`` to use another list.
COUNTRY_LIST = """
AF Afghanistan, AL Albania, DZ Algeria, AD Andorra, AO Angola, AG Antigua and Barbuda, AR Argentina, AM Armenia,
AU Australia, AT Austria, AZ Azerbaijan, BS Bahamas, BH Bahrain, BD Bangladesh, BB Barbados, BY Belarus, BE Belgium,
BZ Belize, BJ Benin, BT Bhutan, BO Bolivia, BA Bosnia and Herzegovina, BW Botswana, BR Brazil, BN Brunei Darussalam,
BG Bulgaria, BF Burkina Faso, BI Burundi, KH Cambodia, CM Cameroon, CA Canada, CV Cape Verde,
CF Central African Republic, TD Chad, CL Chile, CN China, CO Colombia, KM Comoros, CG Congo, CR Costa Rica,
CI Cote d'Ivoire, HR Croatia, CU Cuba, CY Cyprus, CZ Czech Republic, DK Denmark, DJ Djibouti, DM Dominica,
DO Dominican Republic, EC Ecuador, EG Egypt, SV El Salvador, GQ Equatorial Guinea, ER Eritrea, EE Estonia, SZ Eswatini,
ET Ethiopia, FJ Fiji, FI Finland, FR France, GA Gabon, GM Gambia, GE Georgia, DE Germany, GH Ghana, GR Greece,
GL Greenland, GD Grenada, GT Guatemala, GN Guinea, GW Guinea-Bissau, GY Guyana, HT Haiti, HN Honduras, HK Hong Kong,
HU Hungary, IS Iceland, IN India, ID Indonesia, IR Iran, IQ Iraq, IE Ireland, IL Israel, IT Italy, JM Jamaica, JP Japan,
JO Jordan, KZ Kazakhstan, KE Kenya, KI Kiribati, KW Kuwait, KG Kyrgyzstan, LA Laos, LV Latvia, LB Lebanon, LS Lesotho,
LR Liberia, LY Libya, LI Liechtenstein, LT Lithuania, LU Luxembourg, MG Madagascar, MW Malawi, MY Malaysia, MV Maldives,
ML Mali, MT Malta, MH Marshall Islands, MR Mauritania, MU Mauritius, MX Mexico, FM Micronesia, MD Moldova, MC Monaco,
MN Mongolia, ME Montenegro, MA Morocco, MZ Mozambique, MM Myanmar, NA Namibia, NR Nauru, NP Nepal, NL Netherlands,
NZ New Zealand, NI Nicaragua, NE Niger, NG Nigeria, KP North Korea, MK North Macedonia, NO Norway, OM Oman, PK Pakistan,
PW Palau, PA Panama, PG Papua New Guinea, PY Paraguay, PE Peru, PH Philippines, PL Poland, PT Portugal, PR Puerto Rico,
QA Qatar, RO Romania, RU Russia, RW Rwanda, WS Samoa, SM San Marino, SA Saudi Arabia, SN Senegal, RS Serbia,
SC Seychelles, SL Sierra Leone, SG Singapore, SK Slovakia, SI Slovenia, SB Solomon Islands, SO Somalia, ZA South Africa,
KR South Korea, SS South Sudan, ES Spain, LK Sri Lanka, SD Sudan, SR Suriname, SE Sweden, CH Switzerland, SY Syria,
TW Taiwan, TJ Tajikistan, TZ Tanzania, TH Thailand, TL Timor-Leste, TG Togo, TO Tonga, TT Trinidad and Tobago,
TN Tunisia, TR Turkey, TM Turkmenistan, TV Tuvalu, UG Uganda, UA Ukraine, AE United Arab Emirates, GB United Kingdom,
US United States, UY Uruguay, UZ Uzbekistan, VU Vanuatu, VE Venezuela, VN Vietnam, YE Yemen, ZM Zambia, ZW Zimbabwe
"""
# Territories and other names in use.
TERRITORY_LIST = """
American Samoa, Anguilla, Antarctica, Aruba, Bermuda, Bouvet Island, British Indian Ocean Territory,
British Virgin Islands, Cayman Islands, Christmas Island, Cocos Islands, Cook Islands, Falkland Islands, Faroe Islands,
French Guiana, French Polynesia, French Southern Territories, Gibraltar, Guadeloupe, Guam, Guernsey,
Heard Island and McDonald Islands, Holy See, Isle of Man, Jersey, Korea, Kyrgyz Republic,
Lao People's Democratic Republic, Libyan Arab Jamahiriya, Macao, Macedonia, Martinique, Mayotte, Montserrat,
Netherlands Antilles, New Caledonia, Niue, Norfolk Island, Northern Mariana Islands, Palestinian Territory,
Pitcairn Islands, Reunion, Russian Federation, Saint Barthelemy, Saint Helena, Saint Kitts and Nevis, Saint Lucia,
Saint Martin, Saint Pierre and Miquelon, Saint Vincent and the Grenadines, Sao Tome and Principe,
South Georgia and the South Sandwich Islands, Svalbard & Jan Mayen Islands, Swaziland, Syrian Arab Republic, Tokelau,
Turks and Caicos Islands, United States Minor Outlying Islands, United States of America, United States Virgin Islands,
Vatican City, Wallis and Futuna, Western Sahara
"""
COUNTRY_WORDS = tuple(
    word for entry in COUNTRY_LIST.replace("\n", " ").split(",") for word in entry.strip().split(" ", 1)
) + tuple(entry.strip() for entry in TERRITORY_LIST.replace("\n", " ").split(","))

EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
SLASH_DATE_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}\z"
# Dates in other patterns than masking reads by itself; the patterns found travel with the policy.
DATE_SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}\z",
    "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}\z",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}\z",
}
ID_SHAPE = r"^([A-Z]{2,4}-\d{3,}|\d{3}-\d{2}-\d{4})\z"
AMOUNT_SHAPE = r"^-?\d+(\.\d+)?\z"
NOTE_IN_BRACKETS = r" ?\(.*\)\z"
CATEGORY_SHAPE = r"^[^\s\d@#*./]{1,12}\z"
# A column of labels repeats itself: at most so many different values, or such a share of a larger sample.
CATEGORY_DISTINCT_MAX, CATEGORY_DISTINCT_SHARE = 26, 0.52
# Whole numbers that hardly repeat are keys rather than money; scaled, they would no longer join.
KEY_DISTINCT_SHARE, KEY_CONFIDENCE_MAX = 0.9, 0.5
# A capital or, in scripts without case, any letter starts each word.
NAME_SHAPE = r"^[\p{Lu}\p{Lo}][\p{Ll}\p{Lo}\p{M}]*\.?( [\p{Lu}\p{Lo}]['\p{L}\p{M}-]*\.?)+\z"
DESCRIPTION_SHAPE = r"\p{Lu}.*([#*\d./]|\p{Lu}{2})"
COMPANY_SHAPE = r" (Inc|LLC|Ltd|PLC|Group|Corp|Co|and Sons)\.?\z"

# The first type that fits most values wins, so narrow shapes stand before wide ones.
TYPE_ORDER = ("email", "date", "id", "amount", "country", "category", "name", "description")
FITS = 0.8


def sample_size(values: int, share: float = SAMPLE_SHARE_MIN, most: int = SAMPLE_MAX) -> int:
    share = max(SAMPLE_SHARE_MIN, min(SAMPLE_SHARE_MAX, share))
    return min(values, max(1, int(values * share)), most)


def sample_column(
    df: DataFrame,
    columns: list[str] | None = None,
    share: float = SAMPLE_SHARE_MIN,
    row_key: str | None = None,
    most: int = SAMPLE_MAX,
) -> DataFrame:
    """``position, column, rn, value``: a sample of each column's non-null values, as text.

    ``most`` bounds the values per column. Rows are ranked by a hash of ``row_key``. Where there is
    no key, the row's place in the table is hashed too, so that equal rows are drawn as often as
    they stand there; the sample is then the same only where the table is read in the same splits.
    The first scan, which counts the values, runs when this is called.
    """
    columns = columns if columns is not None else [c for c in df.columns if c != row_key]
    key = [column(row_key)] if row_key else [*[column(c) for c in df.columns], F.monotonically_increasing_id()]
    texts = {c: _as_text(df, c) for c in columns}
    hashed = df.select(hash_of(*key).alias(HASH), *[text.alias(c) for c, text in texts.items()])

    if row_key:
        limits = _limits(hashed, columns, share, most)
    else:
        limits = _likely_limits(df.select(*[text.alias(c) for c, text in texts.items()]), columns, share, most)
    if not limits:
        return df.sparkSession.createDataFrame([], SAMPLE_SCHEMA)
    # One branch per threshold, at most five: it reads the columns of that threshold alone. A single
    # branch would need a filter over all columns, and the optimizer's time doubles with each.
    branches = []
    for prefix in sorted({prefix for prefix, _ in limits.values()}):
        cells = [
            F.struct(
                F.lit(position).alias("position"),
                F.lit(c).alias("column"),
                F.lit(limits[c][1]).alias("size"),
                column(c).alias("value"),
            )
            for position, c in enumerate(columns)
            if limits.get(c, ("no values",))[0] == prefix
        ]
        rows = hashed.where(F.col(HASH).startswith(prefix)) if prefix else hashed
        branches.append(rows.select(HASH, F.inline(F.array(*cells))).where(F.col("value").isNotNull()))
    long = reduce(DataFrame.unionAll, branches)
    ranked = long.withColumn("rn", F.row_number().over(Window.partitionBy("position", "column").orderBy(HASH, "value")))
    # The literal bound is what lets Spark drop rows before the shuffle.
    return ranked.where(F.col("rn") <= most).where(F.col("rn") <= F.col("size")).select(
        "position", "column", "rn", "value"
    )


def _as_text(df: DataFrame, name: str) -> Column:
    """A value as text; a float without an exponent, whatever its size."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.call_function("format_number", column(name), F.lit("0.0##############"))
    return column(name).cast("string")


SAMPLE_SCHEMA = "position INT, column STRING, rn INT, value STRING"


def _limits(hashed: DataFrame, columns: list[str], share: float, most: int) -> dict[str, tuple[str, int]]:
    """Per column with values: the hash prefix whose rows hold the whole sample, and its size."""
    row = hashed.agg(
        *[
            F.count(F.when(F.col(HASH).startswith("0" * zeros), column(c)) if zeros else column(c)).alias(f"n{i}_{zeros}")
            for i, c in enumerate(columns)
            for zeros in ZERO_STEPS
        ]
    ).first()
    limits = {}
    for i, c in enumerate(columns):
        size = sample_size(row[f"n{i}_0"], share, most)
        if size:
            zeros = next(z for z in ZERO_STEPS if row[f"n{i}_{z}"] >= size)
            limits[c] = ("0" * zeros, size)
    return limits


def _likely_limits(values: DataFrame, columns: list[str], share: float, most: int) -> dict[str, tuple[str, int]]:
    """The same where the hashes of two scans may differ: the values are counted, the prefix follows.

    Ten times the sample, and at least 500 rows, are expected below the prefix; with hashes spread
    evenly, fewer rows than the sample occur less than once in 10^150 tables.
    """
    row = values.agg(*[F.count(column(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    limits = {}
    for i, c in enumerate(columns):
        size = sample_size(row[f"n{i}"], share, most)
        if size:
            zeros = next((z for z in ZERO_STEPS if row[f"n{i}"] / 16**z >= 10 * max(size, SAMPLE_MAX)), 0)
            limits[c] = ("0" * zeros, size)
    return limits


def _dates() -> dict[str, Column]:
    """Whether a value is a date, per pattern."""
    value = F.col("value")
    return {p: F.try_to_date(F.when(value.rlike(shape), value), p).isNotNull() for p, shape in DATE_SHAPES.items()}


def _matches(countries) -> dict[str, Column]:
    value = F.col("value")
    # Codes count in capitals only, names in any case.
    codes = [word for word in countries if len(word) == 2 and word.isupper()]
    names = [word.lower() for word in countries if word not in codes]
    # "Slovakia (Slovak Republic)" counts as Slovakia.
    short = F.lower(F.regexp_replace(value, NOTE_IN_BRACKETS, ""))
    slash = F.try_to_date(F.when(value.rlike(SLASH_DATE_SHAPE), value), "M/d/yyyy")
    return {
        "email": value.rlike(EMAIL_SHAPE),
        "date": reduce(Column.__or__, _dates().values(), slash.isNotNull()),
        "id": value.rlike(ID_SHAPE),
        "amount": value.rlike(AMOUNT_SHAPE),
        "country": value.isin(codes) | short.isin(names),
        "category": value.rlike(CATEGORY_SHAPE),
        "name": value.rlike(NAME_SHAPE) & ~value.rlike(COMPANY_SHAPE),
        "description": value.rlike(DESCRIPTION_SHAPE) | value.rlike(COMPANY_SHAPE),
    }


def classify_columns(
    sample: DataFrame,
    countries=COUNTRY_WORDS,
    scorer: Callable | None = None,
    category_share: float = CATEGORY_DISTINCT_SHARE,
) -> DataFrame:
    """``position, column, type, confidence, formats`` per sampled column.

    The confidence is the share of sample values that fit the type. The first type that fits
    four fifths wins, else the best fit; a column nothing fits has no type. ``formats`` names the
    patterns, beyond ``MM/dd/yyyy``, in which dates of the sample are written. ``category_share``
    is the share of different values up to which short words are labels, beyond the 26 that any
    sample may hold. ``scorer`` replaces the rules: a pandas function from the sample of one column
    to one row without ``formats``.
    """
    if scorer is not None:
        scored = sample.groupBy("position", "column").applyInPandas(
            scorer, "position INT, column STRING, type STRING, confidence DOUBLE"
        )
        return scored.withColumn("formats", F.lit(None).cast("string"))
    patterns = _dates()
    shares = sample.groupBy("position", "column").agg(
        *[F.avg(match.cast("double")).alias(name) for name, match in _matches(countries).items()],
        *[F.bool_or(match).alias(f"pattern_{i}") for i, match in enumerate(patterns.values())],
        F.size(F.collect_set("value")).alias("distinct"),
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("value").contains(".")).alias("decimals"),
    )
    labels = F.col("distinct") <= F.greatest(F.lit(float(CATEGORY_DISTINCT_MAX)), F.col("size") * F.lit(float(category_share)))
    keys = (F.col("decimals") == 0) & (F.col("distinct") >= F.col("size") * F.lit(KEY_DISTINCT_SHARE))
    shares = shares.withColumns(
        {
            "category": F.when(labels, F.col("category")).otherwise(F.lit(0.0)),
            "amount": F.when(keys, F.least("amount", F.lit(KEY_CONFIDENCE_MAX))).otherwise(F.col("amount")),
        }
    )
    best = F.greatest(*[F.col(t) for t in TYPE_ORDER])
    fitting = [F.col(t) >= FITS for t in TYPE_ORDER]
    closest = [(F.col(t) == best) & (best > 0) for t in TYPE_ORDER]
    winner = F.coalesce(*[F.when(test, F.lit(t)) for tests in (fitting, closest) for test, t in zip(tests, TYPE_ORDER)])
    confidence = F.coalesce(*[F.when(test, F.col(t)) for test, t in zip(fitting, TYPE_ORDER)], best)
    listed = F.concat_ws(FORMATS_BETWEEN, *[F.when(F.col(f"pattern_{i}"), F.lit(p)) for i, p in enumerate(patterns)])
    formats = F.when((winner == "date") & (listed != ""), listed)
    return shares.select(
        "position", "column", winner.alias("type"), confidence.alias("confidence"), formats.alias("formats")
    )


def parse_classification(answers: DataFrame, answer: str) -> DataFrame:
    """Add ``type, confidence`` read from one JSON answer per row.

    Unreadable JSON, an unknown type and an unreadable confidence give no type and 0.0; a
    confidence that is missing keeps the type with 0.0; a number in quotes is read.
    """
    text = column(answer)
    parsed = F.from_json(text, "type STRING, confidence STRING")
    names = F.json_object_keys(text)
    number = F.expr("try_cast(__parsed.confidence AS DOUBLE)")
    confidence = F.when(~F.array_contains("__names", "confidence"), F.lit(0.0)).otherwise(number)
    named = F.col("__parsed.type")
    valid = F.col("__names").isNotNull() & confidence.isNotNull() & (named.isNull() | named.isin(*FIELD_TYPES))
    return (
        answers.withColumns({"__parsed": parsed, "__names": names})
        .withColumns(
            {
                "type": F.when(valid, named),
                "confidence": F.when(valid, confidence).otherwise(F.lit(0.0)),
            }
        )
        .drop("__parsed", "__names")
    )


def split_by_confidence(classified: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``status``: detected with a type and at least the threshold, else skipped."""
    detected = F.col("type").isNotNull() & (F.col("confidence") >= F.lit(float(threshold)))
    return classified.withColumn("status", F.when(detected, F.lit("detected")).otherwise(F.lit("skipped")))


def detect_columns(
    df: DataFrame,
    threshold: float = THRESHOLD,
    row_key: str | None = None,
    columns: list[str] | None = None,
    countries=COUNTRY_WORDS,
    scorer: Callable | None = None,
    most: int = SAMPLE_MAX,
    category_share: float = CATEGORY_DISTINCT_SHARE,
    sample: DataFrame | None = None,
) -> DataFrame:
    """``position, column, type, confidence, formats, status``, one row for every column of the table.

    ``sample`` replaces the two scans by a sample at hand, as of a stored sketch (``sketches.sample_of``).
    """
    columns = columns if columns is not None else [c for c in df.columns if c != row_key]
    sample = sample if sample is not None else sample_column(df, columns, row_key=row_key, most=most)
    classified = classify_columns(sample, countries, scorer, category_share)
    # One row per column of the schema.
    listed = df.sparkSession.createDataFrame(
        [(position, name) for position, name in enumerate(columns)], "position INT, column STRING"
    )
    full = listed.join(classified.drop("column"), "position", "left")
    return split_by_confidence(full.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), threshold).select(
        "position", "column", "type", "confidence", "formats", "status"
    )


def build_policy(detections: DataFrame) -> DataFrame:
    """``position, column, field_type, formats`` of the detected columns, without any category link."""
    return detections.where(F.col("status") == "detected").select(
        "position", "column", F.col("type").alias("field_type"), "formats"
    )


def proposal_report(detections: DataFrame) -> DataFrame:
    """One line per status: how many columns, and each with its type and confidence."""
    shown = F.when(F.col("status") == "detected", F.col("type")).otherwise(F.lit("???"))
    line = F.format_string("%s -> %s (%.2f)", F.col("column"), shown, F.col("confidence"))
    return detections.groupBy("status").agg(
        F.count(F.lit(1)).alias("columns"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "; "
        ).alias("lines"),
    )


def detect_accuracy(predictions: DataFrame, threshold: float = THRESHOLD, bar: float = 90.0) -> DataFrame:
    """Score predictions per scenario, for the core scenarios, and overall.

    ``predictions`` has ``scenario`` (1, 2 or 3), ``col_type``, ``predicted`` and ``confidence``.
    Scenarios 1 and 2 must name the type with enough confidence; scenario 3 must not name the
    type its header suggests. The bar holds for the core scenarios.
    """
    sure = F.coalesce(F.col("confidence") >= F.lit(float(threshold)), F.lit(False))
    same = F.coalesce(F.col("predicted") == F.col("col_type"), F.lit(False))
    passed = F.when(F.col("scenario") == 3, ~same | ~sure).otherwise(same & sure)
    group = F.when(F.col("scenario") == 3, F.lit("ambiguous")).otherwise(F.lit("core"))
    lines = predictions.select(passed.alias("passed"), group.alias("part")).rollup("part").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")
    )
    pct = F.col("passed") * F.lit(100.0) / F.col("total")
    return lines.select(
        F.coalesce("part", F.lit("overall")).alias("part"),
        "total",
        "passed",
        pct.alias("pct"),
        F.when(F.col("part") == "core", pct >= F.lit(bar)).alias("meets_bar"),
    )
