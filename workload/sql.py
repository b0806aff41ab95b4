"""The registered queries spelled in DuckDB SQL over the same tables.

Written apart from the Spark expressions: MD5 is read as four 32-bit words, cents are rounded
by ``printf``, samples are ranked over all rows, and copies are appended by ``UNION ALL``.
"""

from __future__ import annotations

from maskloom.functions.pools import (
    CATEGORIES, COUNTRIES, DEFAULT_CATEGORY, EMAIL_DOMAINS, EMAIL_USERS, MERCHANTS, NAMES,
)
from maskloom.operators import detect, generate, messiness
from maskloom.sources.tables import NA_TOKENS
from workload import inputs, queries


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(pool) -> str:
    return "[" + ", ".join(text(w) for w in pool) + "]"


def mod_digest(h: str, n: int) -> str:
    parts = [f"CAST('0x' || substr({h}, {1 + 8 * i}, 8) AS BIGINT) * {2 ** (96 - 32 * i) % n}" for i in range(4)]
    return f"(({' + '.join(parts)}) % {n})"


def mod_md5(value: str, n: int) -> str:
    return mod_digest(f"md5({value})", n)


def pick(value: str, pool) -> str:
    return f"{words(pool)}[{mod_md5(value, len(pool))} + 1]"


def name(v: str) -> str:
    return pick(v, NAMES)


def email(v: str) -> str:
    return f"{pick(v, EMAIL_USERS)} || '@' || {pick(f'({v} || {text(chr(58))} || {text("domain")})', EMAIL_DOMAINS)}"


def category(v: str) -> str:
    return pick(v, CATEGORIES)


def description(v: str, cat: str | None = None) -> str:
    default = pick(v, MERCHANTS[DEFAULT_CATEGORY])
    if cat is None:
        return default
    cases = " ".join(
        f"WHEN {cat} = {text(key)} THEN {pick(v, pool)}" for key, pool in MERCHANTS.items() if key != DEFAULT_CATEGORY
    )
    return f"CASE {cases} ELSE {default} END"


def offset(salt: str) -> str:
    return f"CAST(180 + {mod_md5(f'({salt} || {text(":offset")})', 551)} AS INTEGER)"


def multiplier(salt: str) -> str:
    return f"(1.5::DOUBLE + {mod_md5(f'({salt} || {text(":multiplier")})', 2001)}::DOUBLE / 1000.0::DOUBLE)"


DATE_RE = r"^(1[0-2]|0[1-9]|[1-9])/(3[01]|[12][0-9]|0[1-9]| ?[1-9])/[0-9]{4}$"
AMOUNT_RE = r"^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?)\s*$"


def read_date(v: str) -> str:
    return (
        f"CASE WHEN regexp_matches({v}, {text(DATE_RE)}) AND {v} NOT LIKE '%/0000' "
        f"THEN try_strptime(replace({v}, ' ', ''), '%m/%d/%Y') END"
    )


def date(v: str, days: str) -> str:
    return f"strftime(({read_date(v)}) + to_days({days}), '%m/%d/%Y')"


def cents(product: str) -> str:
    return f"printf('%.2f', {product})"


def amount(v: str, factor: str) -> str:
    return f"CAST({cents(f'{v} * {factor}')} AS DOUBLE)"


def amount_text(v: str, factor: str) -> str:
    scaled = cents(f"CAST({v} AS DOUBLE) * {factor}")
    return f"CASE WHEN regexp_matches({v}, {text(AMOUNT_RE)}) THEN regexp_replace({scaled}, '0$', '') END"


def kept(masked: str, v: str) -> str:
    return f"coalesce({masked}, {v})"


# Inputs

CUSTOMERS = f"""
SELECT CAST(c_custkey AS VARCHAR) AS row_key,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'N/A' ELSE c_name END AS name,
       CASE WHEN c_custkey % 13 <> 0 THEN 'user' || c_custkey || '@example.com' END AS email,
       CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN {words(inputs.POOL_COUNTRIES)}[c_custkey % 3 + 1]
            ELSE 'NATION_' || c_nationkey END AS country,
       c_mktsegment AS segment,
       CASE WHEN c_custkey % 19 <> 0 THEN c_acctbal END AS balance
FROM customer
"""

PAYMENTS = f"""
SELECT CAST(k AS VARCHAR) AS row_key,
       CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'N/A' WHEN k % 13 = 0 THEN strftime(d, '%Y-%m-%d')
            WHEN k % 17 = 0 THEN month(d) || '/' || day(d) || '/' || year(d) ELSE strftime(d, '%m/%d/%Y') END AS order_date,
       CASE WHEN k % 7 <> 0 THEN strftime(d + to_days(CAST(k % 5 AS INTEGER)), '%m/%d/%Y') END AS post_date,
       CASE WHEN k % 23 <> 0 THEN signed END AS amount,
       CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN '$5' ELSE CAST(signed AS VARCHAR) END AS amount_text,
       CASE WHEN k % 31 <> 0 THEN o_orderstatus || ' ' || o_orderpriority || ' #' || o_custkey END AS description,
       {words([*inputs.CATEGORY_KEYS, inputs.UNKNOWN_CATEGORY])}[k % 11 + 1] AS category,
       o_orderpriority AS priority,
       'ACC-' || o_custkey AS account_id
FROM (SELECT *, o_orderkey AS k, o_orderdate AS d,
             CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS signed FROM orders)
"""

FILES = "SELECT p_partkey, p_name || p_partkey || '.csv' AS file_name FROM part"

CLERKS = """
SELECT CAST(o_orderkey AS VARCHAR) AS row_key,
       CASE WHEN o_orderkey % 101 <> 0 THEN 'Clerk ' || o_orderstatus || ' ' || o_custkey END AS name,
       CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'user' || o_custkey
            ELSE 'user' || o_custkey || '@mail.example.com' END AS email,
       'NATION_' || (o_custkey % 25) AS country
FROM orders
"""

SALT_OFFSET, SALT_FACTOR = offset(text(queries.SALT)), multiplier(text(queries.SALT))


def masked_payments(salt: str = queries.SALT, on_error_keep: bool = True) -> str:
    days, factor = offset(text(salt)), multiplier(text(salt))
    keep = kept if on_error_keep else (lambda masked, v: masked)
    return f"""
    SELECT row_key, {keep(date('order_date', days), 'order_date')} AS order_date,
           {keep(date('post_date', days), 'post_date')} AS post_date,
           {amount('amount', factor)} AS amount,
           {keep(amount_text('amount_text', factor), 'amount_text')} AS amount_text,
           {description('description', 'category')} AS description,
           category, priority, account_id
    FROM p"""


MASKED_CUSTOMERS = f"""
SELECT row_key, {name('name')} AS name, {email('email')} AS email, {pick('country', COUNTRIES)} AS country,
       {category('segment')} AS segment, balance FROM c"""

WITH_PAYMENTS = f"WITH p AS ({PAYMENTS}), m AS ({masked_payments()}) "
WITH_CUSTOMERS = f"WITH c AS ({CUSTOMERS}), m AS ({MASKED_CUSTOMERS}) "
PAYMENT_COLUMNS = list(queries.PAYMENT_POLICY)
CUSTOMER_COLUMNS = list(queries.CUSTOMER_POLICY)


def per_column(columns, select: str) -> str:
    """One SELECT per column, ``{c}`` standing for its name."""
    return " UNION ALL ".join(select.replace("{c}", c) for c in columns)


# Hash picks of the generated and dirtied tables


def digest(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def draw(h: str, slot: int, n: int) -> str:
    return f"(CAST('0x' || substr({h}, {1 + 8 * slot}, 8) AS BIGINT) % {n})"


def draw_from(h: str, slot: int, pool) -> str:
    return f"{words(pool)}[{draw(h, slot, len(pool))} + 1]"


def below(h: str, slot: int, rate: float) -> str:
    return f"(CAST('0x' || substr({h}, {1 + 8 * slot}, 8) AS BIGINT) < {round(rate * 2**32)})"


def _mail(h: str, box_slot: int, number_slot: int) -> str:
    users, hosts = generate.MAIL_USERS, generate.MAIL_HOSTS
    box = draw(h, box_slot, len(users) * len(hosts))
    return (
        f"{words(users)}[{box} // {len(hosts)} + 1] || (1 + {draw(h, number_slot, 99999)}) || '@' || "
        f"{words(hosts)}[{box} % {len(hosts)} + 1]"
    )


def people() -> str:
    slots, homes = generate.country_slots(), generate.pool_of_country()
    starts = "[" + ", ".join(str(homes[c] * generate.NAMES_PER_POOL) for c in slots) + "]"
    letters, per = len(generate.INITIALS), generate.NAMES_PER_POOL
    return f"""
    SELECT row_key,
           {words(generate.full_names())}[first + pos % {per} + 1]
             || CASE WHEN first < {generate.LATIN_POOLS * per} AND pos // {per} < {letters}
                     THEN ' ' || substr('{generate.INITIALS}', CAST(pos // {per} + 1 AS BIGINT), 1) || '.' ELSE '' END AS name,
           {_mail('h', 2, 3)} AS email,
           {words(slots)}[slot + 1] AS country
    FROM (SELECT *, {starts}[slot + 1] AS first
          FROM (SELECT *, {draw('h', 0, len(slots))} AS slot, {draw('h', 1, per * (letters + 1))} AS pos
                FROM (SELECT *, {digest(text('42'), text('people'), 'row_key')} AS h FROM keys)))"""


def business(source: str) -> str:
    ascii_names = [n for n in generate.full_names() if n.isascii()]
    heads, tails = generate.COMPANY_HEADS, generate.COMPANY_TAILS
    firm = draw("h2", 2, len(heads) * len(tails))
    money = f"(1000 + {draw('h2', 1, 499001)})"
    return f"""
    SELECT * EXCLUDE (h1, h2), {draw_from('h1', 0, ascii_names)} AS name, {_mail('h1', 1, 2)} AS email,
           {draw_from('h1', 3, generate.SAMPLE_COUNTRIES)} AS country,
           strftime(DATE '2026-01-01' - to_days(CAST({draw('h2', 0, 731)} AS INTEGER)), '%m/%d/%Y') AS created_at,
           ({money} // 100) || '.' || lpad(CAST({money} % 100 AS VARCHAR), 2, '0') AS revenue,
           {words(heads)}[{firm} // {len(tails)} + 1] || ' ' || {words(tails)}[{firm} % {len(tails)} + 1] AS merchant,
           'ACC-' || (10000 + {draw('h2', 3, 90000)}) AS account_id
    FROM (SELECT *, {digest(text('42'), text('business'), 'row_key')} AS h1,
                 {digest(text('42'), text('account'), 'row_key')} AS h2 FROM {source})"""


KEYS = "SELECT CAST(o_orderkey AS VARCHAR) AS row_key FROM orders"


# Detection

UNLABELLED = """
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus AS status, o_orderpriority AS priority,
       CASE WHEN o_orderkey % 997 = 0 THEN 'r' || o_orderkey || '@rare.example' END AS rare,
       CAST(NULL AS VARCHAR) AS empty, ['US', 'DE', 'JP', 'BR', 'ZZ'][o_custkey % 5 + 1] AS code
FROM orders
"""


def _sample() -> str:
    cells = " UNION ALL ".join(
        f"SELECT {i} AS position, {text(c)} AS \"column\", row_key, {c} AS value FROM u"
        for i, c in enumerate(inputs.DETECT_COLUMNS)
    )
    return f"""
    base AS ({UNLABELLED}), u AS ({business('base')}), cells AS ({cells}),
    ranked AS (SELECT position, "column", value,
                      row_number() OVER (PARTITION BY position ORDER BY md5(row_key), value) AS rn,
                      count(*) OVER (PARTITION BY position) AS n
               FROM cells WHERE value IS NOT NULL),
    sample AS (SELECT CAST(position AS INTEGER) AS position, "column", CAST(rn AS INTEGER) AS rn, value FROM ranked
               WHERE rn <= least(n, greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)), 50))"""


DATE_PATTERNS = {"yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "yyyy/MM/dd": "%Y/%m/%d"}


def _re(shape: str) -> str:
    return f"regexp_matches(value, {text(shape)})"


def _classified() -> str:
    codes = ", ".join(text(c) for c in detect.COUNTRY_WORDS if len(c) == 2)
    names = ", ".join(text(c.lower()) for c in detect.COUNTRY_WORDS if len(c) > 2)
    company = _re(r" (Inc|LLC|Ltd|PLC|Group|Corp|Co|and Sons)\.?$")
    patterns = {p: f"try_strptime(value, {text(q)}) IS NOT NULL" for p, q in DATE_PATTERNS.items()}
    tests = {
        "email": "(length(value) - length(replace(value, '@', '')) = 1 AND " + _re(r"^\S+@\S+\.\S+$") + ")",
        "date": "(try_strptime(value, '%m/%d/%Y') IS NOT NULL OR " + " OR ".join(patterns.values()) + ")",
        "id": "(" + _re(r"^[A-Z]{2,4}-\d\d\d+$") + " OR " + _re(r"^\d\d\d-\d\d-\d\d\d\d$") + ")",
        "amount": "(try_cast(value AS DOUBLE) IS NOT NULL AND " + _re(r"^[-0-9.]*[0-9]$") + " AND NOT starts_with(value, '.'))",
        "country": f"(value IN ({codes}) OR lower(regexp_replace(value, ' ?\\(.*\\)$', '')) IN ({names}))",
        "category": "(length(value) BETWEEN 1 AND 12 AND NOT " + _re(r"[\s\d@#*./]") + ")",
        "name": "(" + _re(r"^[\p{Lu}\p{Lo}][\p{Ll}\p{Lo}\p{M}]*\.?( [\p{Lu}\p{Lo}]['\p{L}\p{M}-]*\.?)+$") + f" AND NOT {company})",
        "description": "(" + _re(r"\p{Lu}.*([#*\d./]|\p{Lu}\p{Lu})") + f" OR {company})",
    }
    shares = ", ".join(f"avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s_{t}" for t, test in tests.items())
    found = ", ".join(f"CASE WHEN bool_or({test}) THEN {text(p)} END" for p, test in patterns.items())
    order = ("email", "date", "id", "amount", "country", "category", "name", "description")
    best = f"greatest({', '.join('s_' + t for t in order)})"
    first = " ".join(f"WHEN s_{t} >= 0.8 THEN {text(t)}" for t in order)
    nearest = " ".join(f"WHEN s_{t} = best AND best > 0 THEN {text(t)}" for t in order)
    sure = " ".join(f"WHEN s_{t} >= 0.8 THEN s_{t}" for t in order)
    return f"""
    raw AS (SELECT position, "column", {shares}, count(DISTINCT value) AS n_distinct, count(*) AS n,
                   count(*) FILTER (contains(value, '.')) AS with_point, concat_ws('; ', {found}) AS found
            FROM sample GROUP BY position, "column"),
    shares AS (SELECT * REPLACE (CASE WHEN n_distinct <= greatest(26, n * 0.52::DOUBLE) THEN s_category ELSE 0.0::DOUBLE END AS s_category,
                                 CASE WHEN with_point = 0 AND n_distinct >= n * 0.9::DOUBLE THEN least(s_amount, 0.5::DOUBLE)
                                      ELSE s_amount END AS s_amount) FROM raw),
    scored AS (SELECT *, {best} AS best FROM shares),
    typed AS (SELECT *, CASE {first} {nearest} END AS type, CASE {sure} ELSE best END AS confidence FROM scored),
    classified AS (SELECT position, "column", type, confidence, CASE WHEN type = 'date' THEN nullif(found, '') END AS formats
                   FROM typed)"""


def _detected() -> str:
    listed = ", ".join(f"({i}, {text(c)})" for i, c in enumerate(inputs.DETECT_COLUMNS))
    return f"""WITH {_sample()}, {_classified()},
    listed AS (SELECT * FROM (VALUES {listed}) AS v(position, "column")),
    found AS (SELECT CAST(l.position AS INTEGER) AS position, l."column", c.type, c.formats,
                     coalesce(c.confidence, 0.0::DOUBLE) AS confidence FROM listed l LEFT JOIN classified c USING (position)),
    detections AS (SELECT *, CASE WHEN type IS NOT NULL AND confidence >= 0.8 THEN 'detected' ELSE 'skipped' END AS status
                   FROM found)
    """


STRPTIME = {
    "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "yyyy/MM/dd": "%Y/%m/%d",
    "MM-dd-yyyy": "%m-%d-%Y", "dd-MM-yyyy": "%d-%m-%Y", "MM/dd/yy": "%m/%d/%y", "dd/MM/yy": "%d/%m/%y", "dd-MMM-yyyy": "%d-%b-%Y",
    "MMMM d, yyyy": "%B %d, %Y", "MMM d, yyyy": "%b %d, %Y", "d MMMM yyyy": "%d %B %Y", "d MMM yyyy": "%d %b %Y",
    "yyyy-MM-dd HH:mm": "%Y-%m-%d %H:%M:%S", "MM/dd/yyyy HH:mm": "%m/%d/%Y %H:%M:%S", "dd/MM/yyyy HH:mm": "%d/%m/%Y %H:%M:%S",
}
WRITTEN_DATES = """
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, strftime(d, '%m/%d/%Y') AS months_first, strftime(d, '%d/%m/%Y') AS days_first,
       CASE WHEN day(d) <= 12 THEN strftime(d, '%d/%m/%Y') END AS unclear, strftime(d, '%Y-%m-%d') AS iso,
       CASE o_orderkey % 3 WHEN 0 THEN strftime(d, '%d.%m.%Y') WHEN 1 THEN strftime(d, '%Y/%m/%d') ELSE 'none' END AS mixed,
       strftime(d, '%B %-d, %Y') AS month_name, strftime(d, '%d-%b-%Y') AS short_month, strftime(d, '%Y-%m-%d') || ' 10:00:12' AS stamped,
       strftime(d, '%m/%d/%y') AS two_digits, o_orderpriority AS no_date
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def _written_shape(pattern: str) -> str:
    """A pattern as lengths of digits and letters, for values as the input writes them."""
    shape = {"MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d{1,2}", "HH:mm": r"\d\d:\d\d:\d\d", ".": r"\."}
    out, rest = "", pattern
    while rest:
        part = next((p for p in shape if rest.startswith(p)), rest[0])
        out, rest = out + shape.get(part, part), rest[len(part):]
    return out


def _date_patterns() -> str:
    bits = " + ".join(
        f"CASE WHEN regexp_full_match(value, {text(_written_shape(p))}) AND try_strptime(value, {text(q)}) IS NOT NULL THEN {1 << i} ELSE 0 END"
        for i, (p, q) in enumerate(STRPTIME.items())
    )
    at = {p: 1 << i for i, p in enumerate(STRPTIME)}
    both = [at["MM/dd/yyyy"] | at["dd/MM/yyyy"], at["MM-dd-yyyy"] | at["dd-MM-yyyy"], at["MM/dd/yy"] | at["dd/MM/yy"], at["MM/dd/yyyy HH:mm"] | at["dd/MM/yyyy HH:mm"]]
    orders = lambda x: "(" + " OR ".join(f"{x} & {b} = {b}" for b in both) + ")"
    cells = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, {text(c)} AS \"column\", {c} AS value FROM w" for i, c in enumerate(inputs.DATE_COLUMNS)
    )
    listed = [f"CASE WHEN taken & {b} <> 0 THEN {text(p)} END" for p, b in at.items()]
    default = f"CASE WHEN taken & 1 <> 0 AND taken & {at['dd/MM/yyyy']} <> 0 THEN 'MM/dd/yyyy' END"
    return f"""
    WITH w AS ({WRITTEN_DATES}), cells AS ({cells}), marked AS (SELECT *, {bits} AS b FROM cells WHERE value IS NOT NULL),
    found AS (SELECT position, "column", count(*) FILTER (b <> 0) AS dates, count(*) FILTER (b = 0) AS others,
                     coalesce(bit_and(b) FILTER (b <> 0), 0) AS common, coalesce(list(DISTINCT b) FILTER (b <> 0), []) AS sets FROM marked GROUP BY ALL),
    sure AS (SELECT *, coalesce(list_reduce(list_filter(sets, lambda x: bit_count(x) = 1), lambda a, x: a | x, 0), 0) AS sure FROM found),
    rest AS (SELECT *, list_filter(sets, lambda x: x & sure = 0) AS rest FROM sure),
    picked AS (SELECT *, CASE WHEN common <> 0 THEN common & -common ELSE sure | list_reduce(rest, lambda a, x: a | (x & -x), 0) END AS taken,
                      CASE WHEN common <> 0 THEN {orders('common')} ELSE len(list_filter(rest, lambda x: {orders('x')})) > 0 OR {orders('sure')} END AS ambiguous
               FROM rest)
    SELECT position, "column", dates, others, nullif(concat_ws('; ', {', '.join(listed)}), '') AS patterns,
           nullif(concat_ws('; ', {', '.join([default, *listed[1:]])}), '') AS formats, ambiguous FROM picked"""


def _frame_samples() -> str:
    cells = " UNION ALL ".join(
        f"SELECT CAST(row_key AS BIGINT) // 25 AS position, {text(f'{kind}_{scenario}')} AS \"column\", row_key, {c} AS value FROM u"
        for kind, scenario, c in inputs.LABELLED
    )
    return f"""
    base AS ({UNLABELLED}), u AS ({business('base')}), cells AS ({cells}),
    sample AS (SELECT position, "column", value
               FROM (SELECT *, row_number() OVER (PARTITION BY position, "column" ORDER BY md5(row_key), value) AS rn
                     FROM cells WHERE value IS NOT NULL) WHERE rn <= 2)"""


# Dirtying

V = messiness.VALUE


def _picked(step: str) -> str:
    group, slot = messiness.DIGEST_SLOT[step]
    return below(digest(text(group), "row_key"), slot, messiness.RATES[step])


def _num(step: str, low: int, high: int) -> str:
    return f"({low} + {draw(digest(text(step + V), 'row_key'), 0, high - low)})"


def _word(step: str, pool) -> str:
    return draw_from(digest(text(step + V), "row_key"), 0, pool)


def _set(step: str, target: str, new: str):
    return lambda t: f"SELECT * REPLACE (CASE WHEN {_picked(step)} THEN {new} ELSE {target} END AS {target}) FROM {t}"


def _copies(step: str, **changes: str):
    key = digest(text("dup"), text(step), "row_key")
    new = ", ".join(
        [f"CASE WHEN {c} IS NOT NULL THEN {value} END AS {c}" for c, value in changes.items()] + [f"{key} AS row_key"]
    )
    return lambda t: f"SELECT * FROM {t} UNION ALL SELECT * REPLACE ({new}) FROM {t} WHERE {_picked(step)}"


def _nulls(t: str) -> str:
    parts = [f"CASE WHEN {_picked('null_' + c)} THEN NULL ELSE {c} END AS {c}" for c in ("country", "email", "name")]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM {t}"


def _whitespace(t: str) -> str:
    parts = [
        f"CASE WHEN {_picked('whitespace_' + c)} THEN '  ' || {c} || '  ' ELSE {c} END AS {c}" for c in ("name", "email")
    ]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM {t}"


def _cased(t: str) -> str:
    coin = below(digest(text("mixed_case" + V), "row_key"), 0, 0.5)
    return _set("mixed_case", "name", f"CASE WHEN {coin} THEN upper(name) ELSE lower(name) END")(t)


MESS = {
    "mess_nulls": _nulls,
    "mess_exact_duplicates": _copies("exact_duplicates"),
    "mess_name_collisions": _copies(
        "name_collisions", email=f"'alt_' || {_num('name_collisions', 1000, 9999)} || '@example.com'"
    ),
    "mess_email_collisions": _copies("email_collisions", name=f"'Alt User ' || {_num('email_collisions', 100, 999)}"),
    "mess_diacritics": _set("diacritics", "name", _word("diacritics", messiness.DIACRITIC_NAMES)),
    "mess_mixed_scripts": _set("mixed_scripts", "name", _word("mixed_scripts", messiness.MIXED_SCRIPT_NAMES)),
    "mess_emoji": _set("emoji", "name", f"name || {_word('emoji', messiness.EMOJI)}"),
    "mess_unusual_tlds": _set(
        "unusual_tlds",
        "email",
        f"CASE WHEN contains(email, '.') THEN regexp_replace(email, '\\.[^.]*$', '') || "
        f"{_word('unusual_tlds', messiness.UNUSUAL_TLDS)} ELSE email END",
    ),
    "mess_subdomains": _set("subdomains", "email", "replace(email, '@', '@mail.')"),
    "mess_plus_addressing": _set(
        "plus_addressing", "email", f"replace(email, '@', '+tag' || {_num('plus_addressing', 1, 99)} || '@')"
    ),
    "mess_numeric_emails": _set(
        "numeric_emails",
        "email",
        f"CASE WHEN contains(email, '@') THEN {_num('numeric_emails', 100000, 999999)} || '@' || split_part(email, '@', 2) "
        "ELSE email END",
    ),
    "mess_whitespace": _whitespace,
    "mess_double_spaces": _set("double_spaces", "name", "regexp_replace(name, ' ', '  ')"),
    "mess_mixed_case": _cased,
    "mess_single_word": _set("single_word", "name", _word("single_word", messiness.SINGLE_WORD_NAMES)),
    "mess_long_names": _set("long_names", "name", _word("long_names", messiness.LONG_NAMES)),
    "mess_numeric_names": _set("numeric_names", "name", _word("numeric_names", messiness.NUMERIC_NAMES)),
}


def _mess_all() -> str:
    steps, before = [f"s0 AS ({CLERKS})"], "s0"
    for i, fn in enumerate(messiness.STEPS, 1):
        steps.append(f"s{i} AS MATERIALIZED ({MESS[fn.__name__](before)})")
        before = f"s{i}"
    return f"WITH {', '.join(steps)}, done AS (SELECT * FROM {before}) "


def _difference(a: str, b: str) -> str:
    return f"""
    SELECT *, only_in_first = 0 AND only_in_second = 0 AS ok
    FROM (SELECT (SELECT count(*) FROM ({a} EXCEPT ALL {b})) AS only_in_first,
                 (SELECT count(*) FROM ({b} EXCEPT ALL {a})) AS only_in_second)"""


def _sql() -> dict[str, str]:
    out: dict[str, str] = {}
    tokens = ", ".join(text(t) for t in NA_TOKENS)

    out["csv_scan"] = " ".join(
        ["SELECT"]
        + [", ".join(f"CASE WHEN {c} NOT IN ({tokens}) THEN {c} END AS {c}" for c in ("doc_id", "text", "lang", "source"))]
        + ["FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents)"]
    )
    out["csv_na_normalise"] = f"""
    SELECT row_key,
           CASE WHEN k % 3 = 0 THEN NULL WHEN description IN ({tokens}) THEN NULL ELSE description END AS description,
           CASE WHEN k % 4 <> 0 THEN priority END AS priority
    FROM (SELECT *, CAST(row_key AS BIGINT) AS k FROM ({PAYMENTS}))"""
    out["csv_sink"] = """
    SELECT c_custkey || ',"  ""' || c_name || '"", ",' || CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE '' END AS line
    FROM customer"""
    out["anon_path"] = r"SELECT page_id, regexp_replace(url, '([^/]+?)(\.[^./]+)?$', '\1_ANON\2') AS output FROM pages"
    out["parquet_scan"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
    out["parquet_sink_roundtrip"] = WITH_PAYMENTS + "SELECT * FROM m"
    out["policy_normalise"] = """
    SELECT p_partkey, CAST(0 AS INTEGER) AS position, p_brand AS "column", 'category' AS field_type,
           CAST(NULL AS VARCHAR) AS category_column FROM part
    UNION ALL SELECT p_partkey, 1, 'amount', 'amount', NULL FROM part
    UNION ALL SELECT p_partkey, 2, 'memo', 'description', p_type FROM part"""
    out["policy_table_write"] = _detected() + """
    SELECT position, "column", CASE WHEN status = 'detected' THEN type END AS field_type,
           CAST(NULL AS VARCHAR) AS category_column, CASE WHEN status = 'detected' THEN formats END AS formats, confidence, status,
           CASE WHEN status = 'skipped' THEN 'low_confidence' END AS reason FROM detections"""
    out["policy_table_read"] = _detected() + """
    SELECT position, "column", type AS field_type, CAST(NULL AS VARCHAR) AS category_column, formats
    FROM detections WHERE status = 'detected'"""

    indexes = ", ".join(f"CAST({mod_digest('h', n)} AS INTEGER) AS i{n}" for n in queries.MODULI)
    out["md5_index"] = f"""
    SELECT id, {indexes} FROM (
        SELECT 'd' || doc_id AS id, md5(text) AS h FROM documents
        UNION ALL SELECT 'c-' || conv_id || '-' || turn, md5(text) FROM conversations)"""
    out["mask_name"] = f"""
    SELECT row_key, {name('name')} AS name FROM (
        SELECT row_key, name FROM ({CUSTOMERS}) UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"""
    out["mask_email"] = f"SELECT row_key, {email('email')} AS email FROM ({CUSTOMERS})"
    out["mask_country"] = f"SELECT row_key, {pick('country', COUNTRIES)} AS country FROM ({CUSTOMERS})"
    out["mask_category"] = f"SELECT p_partkey, {category('p_type')} AS p_type, {category('p_brand')} AS p_brand FROM part"
    iso = "strftime(try_strptime(order_date, '%Y-%m-%d') + to_days(30), '%Y-%m-%d')"
    out["mask_date"] = f"""
    SELECT row_key, {date('order_date', SALT_OFFSET)} AS order_date,
           coalesce({date('order_date', '30')}, {iso}) AS with_iso, {date('post_date', SALT_OFFSET)} AS post_date
    FROM ({PAYMENTS})"""
    out["mask_amount"] = f"""
    SELECT row_key, {amount('amount', SALT_FACTOR)} AS amount, {amount('amount', '2.5::DOUBLE')} AS amount_ties,
           {amount_text('amount_text', SALT_FACTOR)} AS amount_text FROM ({PAYMENTS})"""
    out["mask_description"] = f"""
    SELECT row_key, category, {description('description', 'category')} AS description FROM ({PAYMENTS})"""
    out["mask_description_default"] = f"SELECT row_key, {description('description')} AS description FROM ({PAYMENTS})"
    out["mask_id"] = f"SELECT row_key, account_id FROM ({PAYMENTS})"
    out["derive_offset"] = f"SELECT file_name, {offset('file_name')} AS \"offset\" FROM ({FILES})"
    out["derive_multiplier"] = f"SELECT file_name, {multiplier('file_name')} AS multiplier FROM ({FILES})"
    typed = {
        "name": name("account_id"),
        "email": email("row_key"),
        "country": pick("priority", COUNTRIES),
        "date": kept(date("order_date", SALT_OFFSET), "order_date"),
        "amount": kept(amount_text("amount_text", SALT_FACTOR), "amount_text"),
        "description": description("description"),
        "id": "account_id",
        "category": category("category"),
    }
    out["mask_value_dispatch"] = f"WITH p AS ({PAYMENTS}) " + " UNION ALL ".join(
        f"SELECT row_key, {text(t)} AS field_type, {expr} AS value FROM p" for t, expr in typed.items()
    )
    by_category = typed | {"description": description("description", "category")}
    out["mask_value_dispatch_category"] = f"WITH p AS ({PAYMENTS}) " + " UNION ALL ".join(
        f"SELECT row_key, category, {text(t)} AS field_type, {expr} AS value FROM p" for t, expr in by_category.items()
    )
    day, money = date("order_date", SALT_OFFSET), amount_text("amount_text", SALT_FACTOR)
    out["mask_safe"] = f"""
    SELECT row_key, {kept(day, 'order_date')} AS date_kept, {day} AS date_null,
           {kept(money, 'amount_text')} AS amount_kept, {money} AS amount_null FROM ({PAYMENTS})"""
    out["mask_column"] = f"SELECT row_key, {name('name')} AS name, email FROM ({CUSTOMERS})"
    out["mask_table"] = WITH_PAYMENTS + "SELECT * FROM m"
    out["mask_table_many_names"] = WITH_CUSTOMERS + f"""
    SELECT row_key, 'Person ' || {mod_md5('name', queries.MANY_NAMES)} AS name FROM c"""
    out["audit_pool_many_names"] = WITH_CUSTOMERS + per_column(
        CUSTOMER_COLUMNS, "SELECT '{c}' AS \"column\", count(*) AS rows, CAST(0 AS BIGINT) AS outside, true AS ok FROM c"
    )
    out["mask_table_customers"] = WITH_CUSTOMERS + "SELECT * FROM m"
    out["mask_csv"] = WITH_CUSTOMERS + """
    SELECT row_key, CASE WHEN CAST(row_key AS BIGINT) % 11 <> 0 THEN name END AS name, email, country, segment FROM m"""
    out["mask_table_category_first"] = f"""
    SELECT row_key, {category('category')} AS category, {description('description')} AS description FROM ({PAYMENTS})"""
    file_sql = "(priority || '.csv')"
    out["mask_table_many_files"] = f"""
    SELECT row_key, {file_sql} AS file_name, {kept(date('post_date', offset(file_sql)), 'post_date')} AS post_date,
           {amount('amount', multiplier(file_sql))} AS amount FROM ({PAYMENTS})"""
    lineitem = text("lineitem.csv")
    ship, contact = "strftime(l_shipdate, '%m/%d/%Y')", "('part' || l_partkey || '@example.com')"
    supplier, memo = "('Supplier#' || l_suppkey)", "('PART ' || l_partkey)"
    out["mask_table_shipments"] = f"""
    SELECT l_orderkey, l_linenumber, {date(ship, offset(lineitem))} AS ship_date,
           {amount('l_extendedprice', multiplier(lineitem))} AS l_extendedprice, {category('l_returnflag')} AS flag,
           {name(supplier)} AS supplier, {email(contact)} AS contact, {description(memo)} AS memo FROM lineitem"""

    events = text("events.csv")
    event_day, event_user = "strftime(ts, '%m/%d/%Y')", "('user' || user_id || '@example.com')"
    out["mask_stream"] = f"""
    SELECT event_id, {category('event_type')} AS event_type, {amount('value', multiplier(events))} AS value,
           {date(event_day, offset(events))} AS day, {email(event_user)} AS user FROM events"""

    out["stream_report"] = f"""
    WITH e AS (SELECT event_type, value, {event_day} AS day, {event_user} AS user FROM events),
         m AS (SELECT *, {category('event_type')} AS event_type_m, {amount('value', multiplier(events))} AS value_m,
                      {date('day', offset(events))} AS day_m, {email('user')} AS user_m FROM e)""" + " UNION ALL ".join(
        f"""
    SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", count(*) AS rows, count({c}) AS filled,
           count(*) FILTER ({c} = {c}_m) AS unchanged FROM m"""
        for i, c in enumerate(queries.EVENT_POLICY)
    )

    drawn = "least(count({c}), greatest(1, CAST(floor(count({c}) * 0.1::DOUBLE) AS BIGINT)), 50)"
    out["sample_column_keyless"] = per_column(
        ["l_returnflag", "l_linestatus"],
        f"SELECT '{{c}}' AS \"column\", {drawn} AS drawn, count(DISTINCT {{c}}) AS different FROM lineitem",
    )

    def moved(pattern: str) -> str:
        return f"strftime(o_orderdate + to_days({SALT_OFFSET}), {text(pattern)})"

    out["detect_then_mask"] = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS row_key, {moved('%Y-%m-%d')} AS iso_day, {moved('%d.%m.%Y')} AS dotted_day,
           CASE WHEN o_orderkey % 2 = 0 THEN {moved('%Y/%m/%d')} ELSE {moved('%m/%d/%Y')} END AS mixed_day,
           CAST(o_orderkey * 37 + 100000 AS VARCHAR) AS account, {amount('o_totalprice', SALT_FACTOR)} AS price
    FROM orders"""
    out["sample_column"] = f"WITH {_sample()} SELECT * FROM sample"
    out["sample_column_one_scan"] = out["sample_column"]
    out["classify_columns"] = f"WITH {_sample()}, {_classified()} SELECT * FROM classified"
    out["detect_columns"] = _detected() + 'SELECT position, "column", type, confidence, formats, status FROM detections'
    out["detect_columns_merged"] = out["detect_columns"]
    out["build_policy"] = _detected() + (
        "SELECT position, \"column\", type AS field_type, formats FROM detections WHERE status = 'detected'"
    )
    out["proposal_report"] = _detected() + """
    SELECT status, count(*) AS columns,
           string_agg("column" || ' -> ' || CASE WHEN status = 'detected' THEN type ELSE '???' END
                      || ' (' || printf('%.2f', confidence) || ')', '; ' ORDER BY position) AS lines
    FROM detections GROUP BY status"""
    out["parse_classification"] = """
    SELECT o_orderkey,
           CASE o_orderkey % 9 WHEN 0 THEN 'email' WHEN 4 THEN 'name' WHEN 6 THEN 'date' END AS type,
           CASE o_orderkey % 9 WHEN 0 THEN 0.91::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 6 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END
             AS confidence FROM orders"""
    out["detect_accuracy"] = f"""
    WITH {_frame_samples()}, {_classified()},
    results AS (
        SELECT CASE WHEN "column" LIKE '%_3' THEN 'ambiguous' ELSE 'core' END AS part,
               CASE WHEN "column" LIKE '%_3' THEN NOT (coalesce(type = split_part("column", '_', 1), false) AND confidence >= 0.8)
                    ELSE coalesce(type = split_part("column", '_', 1), false) AND confidence >= 0.8 END AS passed
        FROM classified),
    counted AS (SELECT coalesce(part, 'overall') AS part, count(*) AS total, count(*) FILTER (passed) AS passed
                FROM results GROUP BY ROLLUP (part))
    SELECT part, total, passed, passed * 100.0::DOUBLE / total AS pct,
           CASE WHEN part = 'core' THEN passed * 100.0::DOUBLE / total >= 90 END AS meets_bar FROM counted"""

    out["date_patterns"] = _date_patterns()
    # What the columns hold is known by how they are made; the patterns follow from the dates.
    known = ", ".join(f"({text(c)}, {text(t)})" for c, t in inputs.HARD_TYPES.items())
    out["detect_trained"] = f"""
    SELECT known."column", type, formats, 'detected' AS status, coalesce(ambiguous, false) AS ambiguous
    FROM (VALUES {known}) AS known("column", type) LEFT JOIN ({_date_patterns()}) AS found ON found."column" = known."column" """
    cells = " UNION ALL ".join(
        f"SELECT CAST(row_key AS BIGINT) // 25 AS frame, {text(header)} AS header, {scenario} AS scenario, {c} AS value FROM u"
        for _, scenario, header, c in inputs.FRAMES
    )
    out["detect_accuracy_trained"] = f"""
    WITH base AS ({UNLABELLED}), u AS ({business('base')}), cells AS ({cells}),
    columns AS (SELECT DISTINCT frame, header, scenario FROM cells WHERE value IS NOT NULL)
    SELECT CASE WHEN scenario = 3 THEN 'ambiguous' ELSE 'core' END AS part, count(*) AS total, true AS holds FROM columns GROUP BY 1"""
    out["csv_scan_rough"] = """
    SELECT CAST(k AS VARCHAR) AS row_key,
           CASE WHEN k % 7 = 0 THEN '5" pipe' WHEN k % 5 = 0 THEN c_name WHEN k % 3 = 0 THEN c_name || ', "Ltd"' ELSE c_name END AS label,
           CASE WHEN k % 7 = 0 THEN '3" of ' || c_name WHEN k % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment
    FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 7 = 0 OR (k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0)"""
    out["csv_rejects"] = """
    SELECT CAST(3 AS INTEGER) AS expected, CAST(CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 5 ELSE 4 END AS INTEGER) AS fields,
           CASE WHEN k % 11 = 0 THEN k || ',5" pipe,' || c_mktsegment || ',6" nut' WHEN k % 13 = 0 THEN k || ',' || c_name || ',' || c_mktsegment || ',one,more'
                ELSE k || ',"quoted ""twice"", and a comma",' || c_mktsegment || ',"x,y"' END AS record
    FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 7 <> 0 AND (k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0)"""
    number, half = "CAST(row_key AS BIGINT)", 2**20 - 1
    rounds = f"SELECT *, ({number} >> 20) & {half} AS l0, {number} & {half} AS r0 FROM (SELECT * FROM made)"
    for i in range(4):
        mixed = f"(((r{i} + {1 + 42 * (2 * i + 1)}) * {0x5DEECE66D + 2 * i}) % {2**61 - 1} >> 13) & {half}"
        rounds = f"SELECT *, r{i} AS l{i + 1}, xor(l{i}, {mixed}) AS r{i + 1} FROM ({rounds})"
    boxes = [f"{user}%@{host}" for user in generate.MAIL_USERS for host in generate.MAIL_HOSTS]
    out["gen_base_distinct"] = f"""
    WITH keys AS ({KEYS}), made AS ({people()}), numbered AS (SELECT *, (l4 << 20) + r4 AS number FROM ({rounds}))
    SELECT row_key, name, replace({words(boxes)}[number % {len(boxes)} + 1], '%', CAST(number AS VARCHAR)) AS email, country FROM numbered"""
    moved = lambda c, q: f"coalesce(strftime(try_strptime({c}, {text(q)}) + to_days({offset(text(queries.SALT))}), {text(q.replace('%B %d', '%B %-d'))}), {c}) AS {c}"
    simple = {
        "months_first": "%m/%d/%Y", "days_first": "%d/%m/%Y", "unclear": "%m/%d/%Y", "iso": "%Y-%m-%d", "month_name": "%B %d, %Y",
        "short_month": "%d-%b-%Y", "stamped": "%Y-%m-%d 10:00:12", "two_digits": "%m/%d/%y",
    }
    mixed = moved("mixed", "%d.%m.%Y").removesuffix(", mixed) AS mixed") + ", " + moved("mixed", "%Y/%m/%d").removeprefix("coalesce(")
    out["mask_detected_dates"] = f"SELECT row_key, {', '.join(moved(c, q) for c, q in simple.items())}, {mixed} FROM ({WRITTEN_DATES})"

    out["gen_base"] = f"WITH keys AS ({KEYS}) {people()}"
    out["gen_sample"] = f"WITH keys AS ({KEYS}) {business('keys')}"
    for key, step in MESS.items():
        out[key] = f"WITH t AS ({CLERKS}) {step('t')}"
    out["mess_all"] = _mess_all() + "SELECT * FROM done"
    def lowest(step: str) -> str:
        h, rate = digest(text(step), "row_key"), messiness.RATES[step]
        return f"row_number() OVER (ORDER BY {h}) <= floor(count(*) OVER () * {rate}::DOUBLE)"

    out["mess_nulls_by_count"] = f"""
    SELECT row_key, CASE WHEN NOT pn THEN name END AS name, CASE WHEN NOT pe THEN email END AS email,
           CASE WHEN NOT pc THEN country END AS country
    FROM (SELECT *, {lowest('null_name')} AS pn, {lowest('null_email')} AS pe, {lowest('null_country')} AS pc
          FROM ({CLERKS}))"""
    copy_key = digest(text("dup"), text("exact_duplicates"), "row_key")
    out["mess_exact_duplicates_by_count"] = f"""
    WITH t AS (SELECT *, {lowest('exact_duplicates')} AS picked FROM ({CLERKS}))
    SELECT row_key, name, email, country FROM t
    UNION ALL SELECT {copy_key}, name, email, country FROM t WHERE picked"""
    out["null_profile"] = _mess_all() + per_column(
        ["name", "email", "country"],
        "SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, "
        "count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*) AS null_pct FROM done",
    )

    joined = "FROM p JOIN m USING (row_key)"
    out["run_report"] = f"""
    SELECT CAST({len(PAYMENT_COLUMNS)} AS INTEGER) AS columns_masked, count(*) AS rows_processed,
           'row_key, category, priority' AS skipped_columns FROM orders"""
    out["audit_row_count"] = WITH_PAYMENTS + """
    SELECT *, rows_in = rows_out AS ok
    FROM (SELECT (SELECT count(*) FROM p) AS rows_in, (SELECT count(*) FROM m) AS rows_out)"""
    out["audit_null_counts"] = WITH_PAYMENTS + per_column(
        PAYMENT_COLUMNS,
        "SELECT *, nulls_in = nulls_out AS ok FROM (SELECT '{c}' AS \"column\", "
        "(SELECT count(*) FROM p WHERE {c} IS NULL) AS nulls_in, "
        "(SELECT count(*) FROM m WHERE {c} IS NULL) AS nulls_out)",
    )
    out["audit_null_mask"] = WITH_PAYMENTS + per_column(
        PAYMENT_COLUMNS,
        "SELECT '{c}' AS \"column\", count(*) AS rows, "
        "count(*) FILTER ((p.{c} IS NULL) <> (m.{c} IS NULL)) AS violations, violations = 0 AS ok " + joined,
    )
    out["audit_leak"] = WITH_CUSTOMERS + f"""
    SELECT 'country' AS "column", country AS value, country IN ({', '.join(text(w) for w in COUNTRIES)}) AS in_pool
    FROM (SELECT country FROM c INTERSECT SELECT country FROM m) WHERE country IS NOT NULL"""
    out["audit_unchanged"] = WITH_PAYMENTS + per_column(
        PAYMENT_COLUMNS,
        "SELECT '{c}' AS \"column\", count(*) AS rows, count(p.{c}) AS compared, "
        "count(*) FILTER (p.{c} = m.{c}) AS unchanged " + joined,
    )

    def stored(masked: str, select: str) -> str:
        """Payments beside their masked rows in ``masked``, which may hold a key never or often."""
        return f"""{WITH_PAYMENTS}, f AS (SELECT * REPLACE (coalesce(post_date, '01/01/2025') AS post_date) FROM m),
        broken AS (SELECT * FROM f WHERE CAST(row_key AS BIGINT) % 41 <> 0 UNION ALL SELECT * FROM f WHERE CAST(row_key AS BIGINT) % 43 = 0),
        times AS (SELECT row_key, count(*) AS n FROM {masked} GROUP BY row_key),
        one AS (SELECT * FROM {masked} SEMI JOIN (SELECT row_key FROM times WHERE n = 1) USING (row_key)) """ + per_column(
            PAYMENT_COLUMNS, select + " FROM p LEFT JOIN one m USING (row_key) LEFT JOIN times USING (row_key)"
        )

    unchanged = (
        "SELECT '{c}' AS \"column\", count(*) AS rows, count(p.{c}) FILTER (n = 1) AS compared, "
        "count(*) FILTER (n = 1 AND p.{c} = m.{c}) AS unchanged, "
        "count(*) FILTER (coalesce(n, 0) <> 1) AS unpaired, unpaired = 0 AS ok"
    )
    out["audit_unchanged_stored"] = stored("m", unchanged)
    out["audit_unchanged_broken"] = stored("broken", unchanged)
    out["audit_null_mask_broken"] = stored(
        "broken",
        "SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (coalesce(n, 0) <> 1 OR "
        "(p.{c} IS NULL) <> (m.{c} IS NULL)) AS violations, violations = 0 AS ok",
    )
    failed = {
        "order_date": day, "post_date": date("post_date", SALT_OFFSET), "amount": "amount", "amount_text": money,
        "description": "description", "account_id": "NULL",
    }
    out["audit_unconverted"] = f"WITH p AS ({PAYMENTS}) " + " UNION ALL ".join(
        f"SELECT {text(c)} AS \"column\", count(*) AS rows, "
        f"count(*) FILTER ({c} IS NOT NULL AND ({expr}) IS NULL) AS unconverted FROM p"
        for c, expr in failed.items()
    )
    out["audit_deterministic"] = WITH_PAYMENTS + _difference("SELECT * FROM m", "SELECT * FROM m")
    out["audit_consistent"] = WITH_PAYMENTS + """
    SELECT count(*) AS inputs, count(*) FILTER (outputs > 1) AS inconsistent, inconsistent = 0 AS ok
    FROM (SELECT p.description, p.category, count(DISTINCT m.description) AS outputs FROM p JOIN m USING (row_key)
          WHERE p.description IS NOT NULL GROUP BY ALL)"""
    out["audit_collision"] = WITH_CUSTOMERS + """
    SELECT m.email AS output, count(DISTINCT c.email) AS inputs, CAST(count(*) AS BIGINT) AS rows
    FROM c JOIN m USING (row_key) WHERE c.email IS NOT NULL GROUP BY m.email"""
    out["audit_estimates"] = WITH_CUSTOMERS + per_column(
        ["name", "email", "country"],
        "SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM c) AS inputs, (SELECT count(DISTINCT {c}) FROM m) AS outputs, "
        "(SELECT count(*) FROM (SELECT {c} FROM c INTERSECT SELECT {c} FROM m) WHERE {c} IS NOT NULL) AS leaked, "
        "true AS inputs_near, true AS outputs_near, true AS leaked_near",
    )
    pools = {
        "name": NAMES, "email": [f"{u}@{d}" for u in EMAIL_USERS for d in EMAIL_DOMAINS], "country": COUNTRIES,
        "segment": CATEGORIES,
    }
    out["audit_pool"] = WITH_CUSTOMERS + " UNION ALL ".join(
        f"SELECT {text(c)} AS \"column\", count(*) AS rows, count(*) FILTER ({c} NOT IN "
        f"({', '.join(text(w) for w in pool)})) AS outside, outside = 0 AS ok FROM m"
        for c, pool in pools.items()
    )
    untouched = "SELECT row_key, category, priority FROM "
    out["audit_untouched"] = WITH_PAYMENTS + _difference(untouched + "p", untouched + "m")
    out["audit_column_order"] = WITH_PAYMENTS + _difference("SELECT * FROM m", "SELECT * FROM m")
    changed = {c: f"a.{c} IS DISTINCT FROM b.{c}" for c in PAYMENT_COLUMNS} | {"priority": "false"}
    out["audit_salt_effect"] = (
        f"WITH p AS ({PAYMENTS}), a AS ({masked_payments()}), b AS ({masked_payments(queries.OTHER_SALT)}) "
        + " UNION ALL ".join(
            f"SELECT {text(c)} AS \"column\", count(*) AS rows, count(p.{c}) AS compared, "
            f"count(*) FILTER ({test}) AS changed FROM p JOIN a USING (row_key) JOIN b USING (row_key)"
            for c, test in changed.items()
        )
    )
    out["audit_salt_range"] = f"""
    SELECT count(*) AS files, min(o) AS min_offset, max(o) AS max_offset, min(x) AS min_multiplier, max(x) AS max_multiplier,
           min(o) >= 180 AND max(o) <= 730 AND min(x) >= 1.5 AND max(x) <= 3.5 AS ok
    FROM (SELECT {offset('file_name')} AS o, {multiplier('file_name')} AS x FROM ({FILES}))"""
    sign = "TRY_CAST(CAST({s}.{c} AS VARCHAR) AS DOUBLE)"
    before, after = sign.replace("{s}", "p"), sign.replace("{s}", "m")
    out["audit_sign"] = WITH_PAYMENTS + per_column(
        ["amount", "amount_text"],
        f"SELECT '{{c}}' AS \"column\", count(*) AS rows, "
        f"count(*) FILTER ({before} IS NOT NULL AND {after} IS NOT NULL) AS compared, "
        f"count(*) FILTER (sign({before}) <> sign({after}) AND {after} <> 0) AS changed, "
        f"count(*) FILTER ({before} <> 0 AND {after} = 0) AS to_zero, changed = 0 AS ok " + joined,
    )
    gap = "date_diff('day', {a}, {b})"
    was = gap.replace("{a}", f"({read_date('p.order_date')})").replace("{b}", f"({read_date('p.post_date')})")
    now = gap.replace("{a}", f"({read_date('m.order_date')})").replace("{b}", f"({read_date('m.post_date')})")
    out["audit_interval"] = WITH_PAYMENTS + f"""
    SELECT count({was}) AS compared, count(*) FILTER ({was} IS NOT NULL AND {was} IS DISTINCT FROM {now}) AS changed,
           changed = 0 AS ok {joined}"""
    ascii_part = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"

    def encoding(masked: str, texts: str) -> str:
        return f"""
    SELECT 'text' AS "column", count(*) AS rows, count(*) FILTER (wide) AS non_ascii,
           count(*) FILTER (wide AND masked IS NULL) AS lost,
           count(*) FILTER (wide AND masked <> whole) AS wrong,
           count(*) FILTER (wide AND masked <> whole AND masked = part) AS like_ascii,
           lost = 0 AND wrong = 0 AS ok
    FROM (SELECT {masked} AS masked, {name('text')} AS whole, {name('short')} AS part, wide
          FROM (SELECT text, {ascii_part} AS short, regexp_matches(text, '[^\\x00-\\x7F]') AS wide FROM ({texts})))"""

    out["audit_encoding"] = encoding(name("text"), "SELECT text FROM documents UNION ALL SELECT text FROM conversations")
    out["audit_encoding_broken"] = encoding(name("short"), "SELECT text FROM documents")
    return out


SQL = _sql()
