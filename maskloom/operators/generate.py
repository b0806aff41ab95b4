"""Test tables: people by weighted country, and a small business table.

Every value is drawn from a hash of the row's key, so a lost task rebuilds the same rows and a table of
any size needs no state. ``people`` and ``business`` add the columns to any table of keys;
``gen_base`` and ``gen_sample`` start from ``spark.range``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.hashing import draw, draw_from, hash_of, text_array
from maskloom.session import column

# Country code and weight in thousandths; the weights sum to 1,010.
COUNTRY_WEIGHTS = {
    "US": 400, "DE": 40, "FR": 40, "IT": 30, "ES": 30, "BR": 30, "NL": 20, "SE": 10, "NO": 10, "DK": 10,
    "FI": 10, "GR": 10, "TR": 20, "PL": 20, "UA": 10, "CZ": 10, "HU": 10, "RO": 10, "JP": 50, "CN": 50,
    "KR": 30, "TH": 20, "IN": 40, "VN": 10, "ID": 20, "SA": 20, "RU": 30, "SK": 5, "BG": 5, "HR": 5, "LT": 5,
}
# End of fixed values.

# Given names, family names, and the countries that use them. Pools in Latin script come first.
NAME_POOLS = [
    (["Ruth", "Walter", "Joan", "Glenn", "Marsha", "Clyde"], ["Harper", "Whitfield", "Barnes", "Lowell", "Sutton", "Keane"], ["US"]),
    (["Jürgen", "Heike", "Uwe", "Sabine", "Götz", "Wiebke"], ["Böhm", "Krüger", "Lehmann", "Vogt", "Schäfer", "Brandt"], ["DE", "NL"]),
    (["Hélène", "Thierry", "Noémie", "Gaël", "Odile", "Yves"], ["Lefèvre", "Garnier", "Besson", "Chevalier", "Péron", "Marchand"], ["FR"]),
    (["Lucía", "Matteo", "João", "Íñigo", "Chiara", "Inês"], ["Núñez", "Ferrari", "Gonçalves", "Romano", "Ibáñez", "Magalhães"], ["IT", "ES", "BR", "RO"]),
    (["Åsa", "Bjørn", "Päivi", "Sigrid", "Jørgen", "Eero"], ["Sjöberg", "Østby", "Kjær", "Mäkinen", "Lindqvist", "Håkansson"], ["SE", "NO", "DK", "FI"]),
    (["Çağla", "Emre", "Gül", "Ömer", "Şule", "Tuğçe"], ["Yıldız", "Çelik", "Şahin", "Güneş", "Koç", "Aydın"], ["TR"]),
    (["Zdeněk", "Małgorzata", "Łukasz", "Žofia", "Gábor", "Šarūnas"], ["Dvořák", "Wójcik", "Szabó", "Kováč", "Horvat", "Žukauskas"], ["PL", "CZ", "HU", "SK", "HR", "LT"]),
    (["Ngọc", "Budi", "Hương", "Siti", "Đức", "Wahyu"], ["Nguyễn", "Santoso", "Trần", "Wijaya", "Phạm", "Hidayat"], ["VN", "ID"]),
    (["Ελένη", "Γιώργος", "Μαρία", "Νίκος", "Σοφία", "Πέτρος"], ["Παππάς", "Οικονόμου", "Δήμου", "Βασιλείου", "Αλεξίου", "Μακρής"], ["GR"]),
    (["Олена", "Сергей", "Ганна", "Дмитрий", "Мария", "Тарас"], ["Коваленко", "Соколов", "Шевчук", "Лебедев", "Димитров", "Бондар"], ["UA", "RU", "BG"]),
    (["美咲", "翔太", "陽子", "健一", "葵", "大輔"], ["佐藤", "鈴木", "高橋", "渡辺", "山口", "松本"], ["JP"]),
    (["伟", "芳", "秀英", "强", "丽", "洋"], ["王", "李", "张", "刘", "陈", "杨"], ["CN"]),
    (["서연", "지훈", "민서", "현우", "하은", "도윤"], ["김", "이", "박", "최", "정", "강"], ["KR"]),
    (["สมชาย", "มาลี", "อนันต์", "กมล", "วิภา", "ธนา"], ["ใจดี", "แสงทอง", "ศรีสุข", "บุญมา", "ทองคำ", "รักไทย"], ["TH"]),
    (["सुनीता", "राजेश", "अनिल", "कविता", "मोहन", "दीपा"], ["शर्मा", "वर्मा", "गुप्ता", "मिश्रा", "यादव", "जोशी"], ["IN"]),
    (["فاطمة", "أحمد", "نورة", "خالد", "سارة", "يوسف"], ["الحربي", "العتيبي", "القحطاني", "الشهري", "الغامدي", "الزهراني"], ["SA"]),
]
LATIN_POOLS = 8
NAMES_PER_POOL = 36
INITIALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MAIL_USERS = ["maple", "river", "copper", "lantern", "willow", "falcon", "harbor", "meadow", "cinder", "juniper", "pebble", "orchard"]
MAIL_HOSTS = ["example.com", "example.org", "example.net"]
SAMPLE_COUNTRIES = ["Austria", "Belgium", "Bolivia", "Denmark", "Ecuador", "Finland", "Greece", "Iceland", "Ireland", "Jamaica", "Morocco", "Uruguay"]
COMPANY_HEADS = ["Hargrove", "Ellison", "Tanner", "Whitlock", "Prescott", "Delgado", "Munro", "Okada"]
COMPANY_TAILS = ["Inc", "LLC", "Group", "PLC", "Ltd", "and Sons"]


def country_slots() -> list[str]:
    """One entry per 0.005 of weight, so that a plain modulus draws by weight."""
    return [country for country, weight in COUNTRY_WEIGHTS.items() for _ in range(weight // 5)]


def full_names() -> list[str]:
    """All given and family name pairs, pool after pool."""
    return [f"{given} {family}" for givens, families, _ in NAME_POOLS for given in givens for family in families]


def pool_of_country() -> dict[str, int]:
    return {country: i for i, (_, _, countries) in enumerate(NAME_POOLS) for country in countries}


def people(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add name, e-mail and country, all drawn from one digest of the key."""
    digest = hash_of(str(seed), "people", column(key))
    slots, homes = country_slots(), pool_of_country()
    slot = draw(digest, 0, len(slots))
    # The country's slot also fixes where its names start in the list of all names.
    start = F.get(F.array(*[F.lit(homes[country] * NAMES_PER_POOL) for country in slots]), slot)
    place = draw(digest, 1, NAMES_PER_POOL * (len(INITIALS) + 1))
    plain = F.get(text_array(full_names()), start + place % NAMES_PER_POOL)
    initial = F.get(text_array(INITIALS), F.floor(place / NAMES_PER_POOL).cast("int"))
    dotted = F.when(start < LATIN_POOLS * NAMES_PER_POOL, F.concat(F.lit(" "), initial, F.lit(".")))
    return df.withColumns(
        {
            "name": F.concat(plain, F.coalesce(dotted, F.lit(""))),
            "email": _email(digest, 2, 3),
            "country": F.get(text_array(slots), slot),
        }
    )


def _email(digest: Column, box_slot: int, number_slot: int) -> Column:
    boxes = [f"{user}%@{host}" for user in MAIL_USERS for host in MAIL_HOSTS]
    number = (F.lit(1) + draw(digest, number_slot, 99999)).cast("string")
    return F.replace(draw_from(digest, box_slot, boxes), F.lit("%"), number)


HALF_BITS, ROUNDS = 20, 4


def permuted(number: Column, seed: int = 42) -> Column:
    """Another whole number below 2**40 for each one below 2**40, no two the same (BIGINT).

    A Feistel network: each round adds a function of one half to the other half, which can be undone
    whatever the function is. So the numbers differ by construction, without state or shuffle.
    """
    mask = (1 << HALF_BITS) - 1
    left, right = F.shiftright(number, HALF_BITS).bitwiseAND(mask), number.bitwiseAND(mask)
    for i in range(ROUNDS):
        mixed = (right + F.lit(1 + seed * (2 * i + 1))) * F.lit(0x5DEECE66D + 2 * i)
        left, right = right, left.bitwiseXOR(F.shiftright(mixed % F.lit((1 << 61) - 1), 13).bitwiseAND(mask))
    return F.shiftleft(left, HALF_BITS) + right


def distinct_people(df: DataFrame, key: str, number: Column, seed: int = 42) -> DataFrame:
    """``people`` with an e-mail address of its own for each ``number`` below 2**40."""
    boxes = [f"{user}%@{host}" for user in MAIL_USERS for host in MAIL_HOSTS]
    made = people(df.withColumn("__number", permuted(number.cast("long"), seed)), key, seed)
    box = F.get(text_array(boxes), (F.col("__number") % len(boxes)).cast("int"))
    return made.withColumn("email", F.replace(box, F.lit("%"), F.col("__number").cast("string"))).drop("__number")


def gen_base(
    spark: SparkSession, rows: int = 10_000_000, seed: int = 42, partitions: int | None = None, distinct_emails: bool = False
) -> DataFrame:
    """``row_key, name, email, country`` for any number of rows; without shuffle.

    Addresses are drawn from some 3.6 million, or with ``distinct_emails`` no two are the same.
    """
    keys = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    keys = keys.select(F.col("id").cast("string").alias("row_key"))
    return distinct_people(keys, "row_key", F.col("row_key").cast("long"), seed) if distinct_emails else people(keys, "row_key", seed)


def business(df: DataFrame, key: str, seed: int = 42, today: str = "2026-01-01") -> DataFrame:
    """Add the seven text columns of the sample table, drawn from two digests of the key."""
    first, second = (hash_of(str(seed), label, column(key)) for label in ("business", "account"))
    people_names = [name for name in full_names() if name.isascii()]
    companies = [f"{head} {tail}" for head in COMPANY_HEADS for tail in COMPANY_TAILS]
    cents = F.lit(1000) + draw(second, 1, 499001)
    # Hundredths are exact in a decimal, whose text always shows both digits.
    revenue = (cents.cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").cast("string")
    return df.withColumns(
        {
            "name": draw_from(first, 0, people_names),
            "email": _email(first, 1, 2),
            "country": draw_from(first, 3, SAMPLE_COUNTRIES),
            "created_at": F.date_format(F.date_sub(F.lit(today).cast("date"), draw(second, 0, 731)), "MM/dd/yyyy"),
            "revenue": revenue,
            "merchant": draw_from(second, 2, companies),
            "account_id": F.concat(F.lit("ACC-"), (F.lit(10000) + draw(second, 3, 90000)).cast("string")),
        }
    )


def gen_sample(spark: SparkSession, rows: int = 50, seed: int = 42, today: str = "2026-01-01") -> DataFrame:
    keys = spark.range(rows).select(F.col("id").cast("string").alias("row_key"))
    return business(keys, "row_key", seed, today).drop("row_key")
