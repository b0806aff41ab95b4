"""Column types by a trained model: what values look like, how they repeat, and a hint from the header.

A sample of one column becomes one vector: hashed shapes of its values (runs of capitals, small letters,
digits and marks) and pairs of neighbouring shape characters, shares of values that parse as a
date, number, address or country, how many different values there are, and which type the header's words
suggest. A few softmax regressions, each trained without some of the styles, give the average of their
probabilities, so a style that none knows gets no sure answer; one temperature, fitted on the styles left out,
makes the probabilities honest. Headers are wrong in many training columns, so values overrule them.

Training columns are drawn here, from word lists and formats of our own; nothing is read. The fit takes seconds
and happens once per process. Scoring takes the samples only, a group of at most a few hundred values a column.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.dates import SHAPES as DATE_SHAPES
from maskloom.functions.fields import FIELD_TYPES
from maskloom.operators import detect
from maskloom.operators.dates import date_patterns

NONE = "none"
KINDS = (*FIELD_TYPES, NONE)
SEED, MODELS, COLUMNS_PER_STYLE = 5, 5, 36
#: Share of training columns that hold few different values.
REPEATING = 0.35
SHAPE_BITS, PAIR_BITS = 9, 9
SIZES = (1, 2, 2, 2, 3, 5, 10, 20, 50)
STEPS, RATE, DECAY = 350, 0.05, 2e-4

FIRST = "Ann Joe Mia Liam Noah Emma Olga Ivan Juan María José Zoë Luca Anna Peter Susan Karl Heidi Yuki Chen Wei Aisha Omar Fatima Priya Arjun Sven Astrid Pierre Chloé Marta Tomás Nina Viktor Elena Kofi Amara Jean Paul Grace Ruth Hugo Alice Bruno Clara Diego Ewa Felix Greta Hanna".split()
LAST = "Lee Smith García O'Brien Ng Müller Rossi Novak Kowalski Petrov Silva Costa Dubois Martin Jensen Hansen Virtanen Kim Tanaka Suzuki Li Zhang Singh Patel Khan Ali Okafor Mensah Brown Jones Miller Davis Wilson Moore Taylor Clark Lewis Walker Young King Wright Hill Green Baker Nelson Carter Meyer Weber Fischer".split()
NATIVE = "王芳 李伟 김민수 山田太郎 鈴木花子 محمد فاطمة Ольга Иванов דוד שרה".split()
WORDS = "harbor garden paper radio river corner market star north green blue city royal prime metro union sunny golden silver maple stone bright fresh happy quick smart urban global summit valley".split()
GOODS = "Diner Cafe Hut Books Foods Mart Station Pharmacy Hotel Grill Bakery Motors Cinema Gym Airlines Insurance Bank Telecom Energy Fashion Toys Garage Florist Deli Tavern Studio Supply Travel Systems".split()
LABELS = "Food Travel Shopping Health Home Auto Bills Fuel Dining Gifts Sports Music Small Medium Large Gold Silver Bronze Retail Wholesale Online Premium Basic Household Machinery Building Furniture Utilities Entertainment Education".split()
PHRASES = ["Food & Drink", "Home & Garden", "Bills & Utilities", "Gas & Fuel", "Health & Beauty", "Toys & Games", "Arts & Crafts", "Pet Care", "Personal Care", "Real Estate", "Office Supplies", "Public Transport", "Cash & ATM", "Kids & Family"]
TEXT = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so".split()
STATES = ["OPEN", "CLOSED", "PENDING", "N/A", "YES", "NO", "TRUE", "FALSE", "A1", "B2", "X", "–", "OK", "FAILED", "high", "low", "on", "off"]
MONTHS = "January February March April May June July August September October November December".split()

# Which words of a header suggest which type.
HINTS = {
    "name": "name fullname customer client contact person employee owner holder surname firstname lastname",
    "email": "email mail emails address",
    "country": "country nation nationality land",
    "date": "date day time created updated at on timestamp birthday dob",
    "amount": "amount price total revenue balance cost fee value sum paid charge salary income",
    "description": "description merchant memo note payee vendor details narrative shop store",
    "id": "id key code number no account uuid guid ref reference iban phone ssn sku",
    "category": "category type kind segment class group tier priority status label",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}


def header_hints(header: str) -> list[str]:
    """The types that a header's words suggest."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", header or "")
    return sorted({_HINT[p.lower()] for p in parts if p.lower() in _HINT})


def shape(value: str) -> str:
    """``March 5, 2024`` as ``Aa+_9,_9+``: one sign a character, a run of one class as that class and ``+``."""
    signs = []
    for c in value[:60]:
        sign = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "L" if c.isalpha() else "_" if c.isspace() else c
        if signs and signs[-1].rstrip("+") == sign and (sign.isalnum()):
            signs[-1] = sign + "+"
        else:
            signs.append(sign)
    return "".join(signs)


_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")
_PLAIN = re.compile(r"[-+]?\d+")
_CENTS = re.compile(r"[-+]?\d+\.\d{1,2}")
_NUMBER = re.compile(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?")
_MONEY = re.compile(r"\(?[-+]?\s?(?:[$€£¥]|[A-Z]{3})?\s?[-+]?\d{1,3}(?:[., ']?\d{3})*(?:[.,]\d{1,2})?\s?(?:[$€£¥]|[A-Z]{3})?\)?")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_CODE = re.compile(r"[A-Za-z]{1,6}[-_#/ ]?\d{3,}|\d{3}-\d{2}-\d{4}")
_PHONE = re.compile(r"(\+\d{1,3}[ -]?)?(\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{3,4}")
_DATE = re.compile("|".join(f"(?:{s})" for s in DATE_SHAPES.values()).replace(r"\p{L}", r"[^\W\d_]"))
_COMPANY = re.compile(r" (Inc|LLC|Ltd|PLC|Group|Corp|Co|GmbH|and Sons)\.?$")
_CAPITALISED = re.compile(r"[^\W\d_a-z][^\W\d_]*\.?(?:[ ,]+[^\W\d_a-z][\w'’-]*\.?)+")
_GIVEN = {w.lower() for w in FIRST}
_NOUNS = {w.lower() for words in (WORDS, GOODS, LABELS) for w in words} | {w.lower() for phrase in PHRASES for w in phrase.split()}
_COUNTRIES = {w if len(w) == 2 and w.isupper() else w.lower() for w in detect.COUNTRY_WORDS}


def _country(value: str) -> bool:
    plain = re.sub(r" ?\(.*\)$", "", value)
    return (value in _COUNTRIES and len(value) == 2) or (len(plain) > 2 and plain.lower() in _COUNTRIES)


_SHARES: tuple[Callable[[str], bool], ...] = (
    lambda v: bool(_EMAIL.fullmatch(v)), lambda v: bool(_PLAIN.fullmatch(v)), lambda v: bool(_CENTS.fullmatch(v)), lambda v: bool(_NUMBER.fullmatch(v)),
    lambda v: bool(_MONEY.fullmatch(v)), lambda v: bool(_UUID.fullmatch(v)), lambda v: bool(_CODE.fullmatch(v)), lambda v: bool(_PHONE.fullmatch(v)),
    lambda v: bool(_DATE.fullmatch(v)), lambda v: any(m[:3].lower() in v.lower() for m in MONTHS), lambda v: bool(_COMPANY.search(v)),
    lambda v: bool(_CAPITALISED.fullmatch(v)), _country, lambda v: any(c in "#*" for c in v), lambda v: v.isupper() and len(v) > 2,
    lambda v: any(c.isdigit() for c in v), lambda v: any(c in "$€£¥" for c in v), lambda v: "," in v, lambda v: " & " in v, lambda v: "://" in v or v.startswith("www."),
)
#: Shares of values with a word of a list; in half of the training columns they are hidden, as no list is complete.
_LISTED: tuple[Callable[[str], bool], ...] = (
    lambda v: any(w.strip(",.").lower() in _GIVEN for w in v.split()), lambda v: any(w.strip(",.#*").lower() in _NOUNS for w in v.split()),
)
_DENSE = len(_LISTED) + len(_SHARES) + 10
WIDTH = _DENSE + 2 * len(FIELD_TYPES) + (1 << SHAPE_BITS) + (1 << PAIR_BITS)


def features(values: list[str], header: str = "") -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    n = len(values)
    if not n:
        return out
    for i, test in enumerate(_LISTED + _SHARES):
        out[i] = sum(test(v) for v in values) / n
    lengths = np.array([len(v) for v in values], float)
    words = np.array([len(v.split()) for v in values], float)
    different = len(set(values))
    at = len(_LISTED) + len(_SHARES)
    out[at : at + 10] = (
        1.0, min(2.0, lengths.mean() / 20), min(2.0, lengths.std() / 10), min(2.0, words.mean() / 4), float(words.mean() >= 1.9),
        different / n, float(different <= 0.5 * n), float(n >= 10 and different <= 0.5 * n), float(n >= 10 and different >= 0.9 * n), min(1.0, n / 50),
    )
    at += 10
    for kind in header_hints(header):
        out[at + FIELD_TYPES.index(kind)] = 1.0
        # A header counts more where the values look like plain numbers, which may be keys or money.
        out[at + len(FIELD_TYPES) + FIELD_TYPES.index(kind)] = out[len(_LISTED) + 1]
    at += 2 * len(FIELD_TYPES)
    for value in values:
        signs = shape(value)
        out[at + (zlib.crc32(signs.encode()) >> 7 & (1 << SHAPE_BITS) - 1)] += 1 / n
        base, pairs = at + (1 << SHAPE_BITS), f"^{signs}$"
        for i in range(len(pairs) - 1):
            out[base + (zlib.crc32(pairs[i : i + 2].encode()) >> 7 & (1 << PAIR_BITS) - 1)] += 1 / n / len(pairs) * 4
    return out


# Training columns


def _styles() -> list[tuple[str, Callable[[np.random.Generator], Callable[[], str]]]]:
    """Type and maker of a column; a maker draws what stays the same over the column, then its values."""
    styles: list[tuple[str, Callable]] = []

    def add(kind: str, make: Callable) -> None:
        styles.append((kind, make))

    def pick(rng, words):
        return words[int(rng.integers(len(words)))]

    def number(rng, low, high):
        return int(rng.integers(low, high))

    def day(rng):
        return number(rng, 1980, 2030), number(rng, 1, 13), number(rng, 1, 29)

    # Names
    add("name", lambda r: lambda: f"{pick(r, FIRST)} {pick(r, LAST)}")
    add("name", lambda r: lambda: f"{pick(r, FIRST)[0]}. {pick(r, LAST)}")
    add("name", lambda r: lambda: f"{pick(r, LAST)}, {pick(r, FIRST)}")
    add("name", lambda r: lambda: f"{pick(r, FIRST)} {pick(r, LAST)}".upper())
    add("name", lambda r: lambda: f"{pick(r, LAST)}, {pick(r, FIRST)}".upper())
    add("name", lambda r: lambda: f"{pick(r, FIRST)} {pick(r, FIRST)[0]}. {pick(r, LAST)}")
    add("name", lambda r: lambda: f"{pick(r, FIRST)} {pick(r, LAST)}-{pick(r, LAST)}")
    add("name", lambda r: lambda: f"{pick(r, ['Dr.', 'Mr.', 'Ms.', 'Mrs.'])} {pick(r, FIRST)} {pick(r, LAST)}")
    add("name", lambda r: lambda: pick(r, NATIVE) if r.random() < 0.5 else f"{pick(r, FIRST)} {pick(r, LAST)}")
    add("name", lambda r: lambda: pick(r, [f"{pick(r, FIRST)} {pick(r, LAST)}", f"{pick(r, FIRST)[0]}. {pick(r, LAST)}", f"{pick(r, FIRST)} {pick(r, FIRST)} {pick(r, LAST)}"]))
    drawn = lambda r, n: "".join(pick(r, "b br c ch d f g h j k kl l m n p r s st t v w z".split()) + pick(r, list("aeiou")) + pick(r, ["", "", "n", "r", "l"]) for _ in range(n)).capitalize()
    for low, high in ((1, 3), (2, 4)):
        add("name", lambda r, low=low, high=high: lambda: f"{drawn(r, number(r, low, high))} {drawn(r, number(r, low, high))}")
        add("name", lambda r, low=low, high=high: lambda: f"{pick(r, FIRST)} {drawn(r, number(r, low, high))}")
    # Addresses
    add("email", lambda r: lambda: f"{pick(r, FIRST).lower()}{number(r, 1, 999)}@{pick(r, WORDS)}.{pick(r, ['com', 'org', 'test'])}")
    add("email", lambda r: lambda: f"{pick(r, FIRST).lower()}.{pick(r, LAST).lower()}@mail.{pick(r, WORDS)}.example")
    add("email", lambda r: lambda: f"{number(r, 1000, 99999)}@{pick(r, WORDS)}.co.uk")
    add("email", lambda r: lambda: f"{pick(r, WORDS)}+{pick(r, WORDS)}@{pick(r, WORDS)}.io")
    add("email", lambda r: lambda: f"{pick(r, FIRST)[0]}{pick(r, LAST)}_{number(r, 1, 99)}@{pick(r, WORDS)}-{pick(r, WORDS)}.NET")
    # Countries
    codes = [w for w in detect.COUNTRY_WORDS if len(w) == 2 and w.isupper()]
    names = [w for w in detect.COUNTRY_WORDS if w not in codes]
    add("country", lambda r: lambda: pick(r, names))
    add("country", lambda r: lambda: pick(r, codes))
    add("country", lambda r: functools.partial(pick, r, [pick(r, names) for _ in range(number(r, 2, 8))]))
    add("country", lambda r: functools.partial(pick, r, [pick(r, codes) for _ in range(number(r, 3, 9))]))
    add("country", lambda r: lambda: pick(r, names).upper())
    # Dates
    written = [
        lambda y, m, d: f"{m:02d}/{d:02d}/{y}", lambda y, m, d: f"{d:02d}/{m:02d}/{y}", lambda y, m, d: f"{y}-{m:02d}-{d:02d}", lambda y, m, d: f"{d:02d}.{m:02d}.{y}",
        lambda y, m, d: f"{y}/{m:02d}/{d:02d}", lambda y, m, d: f"{m:02d}-{d:02d}-{y}", lambda y, m, d: f"{m}/{d}/{y}", lambda y, m, d: f"{m:02d}/{d:02d}/{y % 100:02d}",
        lambda y, m, d: f"{d:02d}-{MONTHS[m - 1][:3]}-{y}", lambda y, m, d: f"{MONTHS[m - 1]} {d}, {y}", lambda y, m, d: f"{MONTHS[m - 1][:3]} {d}, {y}",
        lambda y, m, d: f"{d} {MONTHS[m - 1]} {y}", lambda y, m, d: f"{d} {MONTHS[m - 1][:3]} {y}",
    ]
    for write in written:
        add("date", lambda r, write=write: lambda: write(*day(r)))
    for write in (written[2], written[0]):
        for between in (" ", "T"):
            add("date", lambda r, write=write, between=between: lambda: f"{write(*day(r))}{between}{number(r, 0, 24):02d}:{number(r, 0, 60):02d}:{number(r, 0, 60):02d}")
    # Amounts
    add("amount", lambda r: (lambda top: lambda: f"{r.uniform(-top, top):.2f}")(10 ** r.uniform(1.5, 5)))
    add("amount", lambda r: (lambda top: lambda: f"{r.uniform(0, top):.2f}")(10 ** r.uniform(1, 6)))
    add("amount", lambda r: (lambda top: lambda: f"{pick(r, ['$', '€', '£'])}{r.uniform(0, top):,.2f}")(10 ** r.uniform(2, 5)))
    add("amount", lambda r: (lambda top, sign: lambda: f"{sign}{r.uniform(0, top):,.2f}")(10 ** r.uniform(2, 5), pick(r, ["$", "€", "£"])))
    add("amount", lambda r: (lambda top: lambda: f"{r.uniform(0, top):,.2f}")(10 ** r.uniform(2.5, 6)))
    add("amount", lambda r: (lambda top: lambda: f"{r.uniform(0, top):.2f}".replace(".", ","))(10 ** r.uniform(1, 4)))
    add("amount", lambda r: (lambda top: lambda: f"{r.uniform(0, top):.2f} {pick(r, ['EUR', 'USD'])}")(10 ** r.uniform(1, 4)))
    add("amount", lambda r: (lambda top: lambda: f"{r.uniform(-top, top):.1f}")(10 ** r.uniform(1.5, 5)))
    add("amount", lambda r: (lambda top: lambda: f"{r.uniform(0, top):.4f}".rstrip("0"))(10 ** r.uniform(1, 4)))
    # Descriptions
    add("description", lambda r: lambda: f"{pick(r, WORDS)} {pick(r, GOODS)} #{number(r, 10, 9999)}".upper())
    add("description", lambda r: lambda: f"{pick(r, WORDS).title()} {pick(r, GOODS)} #{number(r, 10, 9999)}")
    add("description", lambda r: lambda: f"{pick(r, WORDS)}*{pick(r, GOODS)}".upper())
    add("description", lambda r: lambda: f"{pick(r, WORDS).title()}{pick(r, WORDS)} *{pick(r, GOODS)} {number(r, 100, 9999)}")
    add("description", lambda r: lambda: f"{pick(r, WORDS)}{pick(r, WORDS)}.{pick(r, ['com', 'net'])}".upper())
    add("description", lambda r: lambda: f"{pick(r, LAST)} {pick(r, ['Inc', 'LLC', 'Ltd', 'Group', 'and Sons'])}" if r.random() < 0.6 else f"{pick(r, LAST)}-{pick(r, LAST)}, {pick(r, LAST)} and {pick(r, LAST)} Ltd")
    add("description", lambda r: lambda: f"{pick(r, ['PAYMENT', 'POS', 'CARD', 'TRANSFER'])} {pick(r, WORDS).upper()} {pick(r, GOODS).upper()} {number(r, 1000, 99999)}")
    add("description", lambda r: lambda: pick(r, [f"{pick(r, WORDS)} {pick(r, GOODS)} {number(r, 1000, 9999)}".upper(), f"{pick(r, WORDS)}*Web".upper(), f"{pick(r, WORDS).title()} {pick(r, GOODS)} #{number(r, 1, 9999)}", f"{pick(r, WORDS)}{pick(r, GOODS)}.NET".upper()]))
    ending = ["Inc", "LLC", "Ltd", "Group", "and Sons", "PLC", "Corp", "Co", "GmbH"]
    add("description", lambda r: lambda: f"{pick(r, LAST)} {pick(r, ending)}")
    add("description", lambda r: lambda: f"{drawn(r, 2)} {pick(r, ending)}")
    add("description", lambda r: lambda: f"{pick(r, WORDS).title()} {pick(r, GOODS)} {pick(r, ending)}")
    # Keys
    add("id", lambda r: (lambda head: lambda: f"{head}-{number(r, 1000, 999999)}")("".join(pick(r, "ABCDEFGHKLMNPRSTUVXYZ") for _ in range(number(r, 2, 5)))))
    add("id", lambda r: (lambda head, n: lambda: f"{head}{number(r, 10 ** (n - 1), 10**n)}")("".join(pick(r, "ABCDEFGHKLMNPRSTUVXYZ") for _ in range(number(r, 1, 6))), number(r, 4, 10)))
    add("id", lambda r: lambda: f"{number(r, 100, 999)}-{number(r, 10, 99)}-{number(r, 1000, 9999)}")
    add("id", lambda r: lambda: "-".join("".join(pick(r, "0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)))
    add("id", lambda r: lambda: "-".join("".join(pick(r, "0123456789ABCDEF") for _ in range(k)) for k in (8, 4, 4, 4, 12)))
    add("id", lambda r: (lambda n: lambda: "".join(pick(r, "0123456789abcdef") for _ in range(n)))(pick(r, [16, 24, 32, 40])))
    add("id", lambda r: lambda: f"+{number(r, 1, 99)} {number(r, 100, 999)} {number(r, 100, 999)} {number(r, 1000, 9999)}")
    add("id", lambda r: lambda: f"({number(r, 200, 999)}) {number(r, 200, 999)}-{number(r, 1000, 9999)}")
    add("id", lambda r: lambda: f"{number(r, 200, 999)}-{number(r, 200, 999)}-{number(r, 1000, 9999)}")
    add("id", lambda r: lambda: f"{pick(r, ['DE', 'FR', 'GB'])}{number(10 and r, 10, 99)}{number(r, 10**15, 10**16)}")
    add("id", lambda r: (lambda head: lambda: f"{head}_{number(r, 100, 99999):06d}")(pick(r, WORDS)))
    add("id", lambda r: (lambda: f"{number(r, 10**15, 10**16)}"))
    # Labels
    add("category", lambda r: functools.partial(pick, r, [pick(r, LABELS) for _ in range(number(r, 3, 12))]))
    add("category", lambda r: functools.partial(pick, r, [pick(r, LABELS).upper() for _ in range(number(r, 3, 8))]))
    add("category", lambda r: functools.partial(pick, r, [pick(r, LABELS).lower() for _ in range(number(r, 3, 8))]))
    add("category", lambda r: functools.partial(pick, r, [pick(r, PHRASES) for _ in range(number(r, 3, 9))]))
    add("category", lambda r: functools.partial(pick, r, [pick(r, LABELS) if r.random() < 0.6 else pick(r, PHRASES) for _ in range(number(r, 4, 12))]))
    # What is none of these
    add(NONE, lambda r: functools.partial(pick, r, list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    add(NONE, lambda r: functools.partial(pick, r, [pick(r, STATES) for _ in range(number(r, 4, 11))]))
    add(NONE, lambda r: lambda: " ".join(pick(r, TEXT) for _ in range(number(r, 5, 25))))
    add(NONE, lambda r: lambda: " ".join(pick(r, TEXT) for _ in range(number(r, 4, 12))).capitalize() + ".")
    add(NONE, lambda r: lambda: f"https://{pick(r, WORDS)}.com/{pick(r, WORDS)}/{number(r, 1, 999)}")
    add(NONE, lambda r: lambda: ".".join(str(number(r, 1, 255)) for _ in range(4)))
    add(NONE, lambda r: functools.partial(pick, r, pick(r, [["0", "1"], ["true", "false"], ["Y", "N"], ["M", "F"], ["t", "f"]])))
    add(NONE, lambda r: lambda: f"{number(r, 1, 999)} {pick(r, LAST)} {pick(r, ['Street', 'Avenue', 'Road', 'Lane'])}")
    add(NONE, lambda r: lambda: "".join(pick(r, "abcdefghijklmnopqrstuvwxyz") for _ in range(number(r, 5, 14))))
    add(NONE, lambda r: lambda: f"{number(r, 1, 5)}-{pick(r, ['URGENT', 'HIGH', 'MEDIUM', 'LOW'])}")
    add(NONE, lambda r: lambda: str(r.normal()))
    return styles


#: Whole numbers may be keys or money, and the values alone don't tell: only a header does.
def _whole(rng: np.random.Generator) -> Callable[[], str]:
    top = 10 ** rng.uniform(1.5, 7)
    return lambda: str(int(rng.uniform(0, top)))


def _header(rng: np.random.Generator, kind: str) -> str:
    """A header of the column's type in half of the columns, of another in some, else one that says nothing."""
    luck = rng.random()
    of = kind if luck < 0.5 and kind != NONE else list(HINTS)[int(rng.integers(len(HINTS)))] if luck < 0.72 else None
    if of is None:
        return ("col", "field_7", "x", "column_b", "data")[int(rng.integers(5))]
    words = HINTS[of].split()
    return words[int(rng.integers(len(words)))].capitalize()


@dataclass
class Model:
    weights: np.ndarray  # models x features x kinds
    temperature: float

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        found = [_softmax(rows @ w / self.temperature) for w in self.weights]
        return np.mean(found, 0)

    def classify(self, values: list[str], header: str = "") -> tuple[str | None, float]:
        """The likeliest type and its probability; none where that is likelier than any type."""
        if not values:
            return None, 0.0
        found = self.probabilities(features(values, header)[None])[0]
        best = KINDS[int(found.argmax())]
        return (None, 0.0) if best == NONE else (best, float(found.max()))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _fit(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Softmax regression by Adam over all rows; kinds weigh alike."""
    wanted = np.eye(len(KINDS), dtype=np.float32)[kinds]
    weigh = (1 / np.maximum(1, np.bincount(kinds, minlength=len(KINDS))))[kinds][:, None] * len(kinds) / len(KINDS)
    weights, mean, square = (np.zeros((rows.shape[1], len(KINDS)), np.float32) for _ in range(3))
    for step in range(1, STEPS + 1):
        gradient = rows.T @ ((_softmax(rows @ weights) - wanted) * weigh).astype(np.float32) / len(rows) + DECAY * weights
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient * gradient - square)
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return weights


@functools.cache
def trained() -> Model:
    rng = np.random.default_rng(SEED)
    rows, kinds, style_of = [], [], []
    styles = _styles()
    for number, (kind, make) in enumerate(styles):
        for i in range(COLUMNS_PER_STYLE):
            draw = make(rng)
            if rng.random() < REPEATING:
                few = [draw() for _ in range(int(rng.integers(3, 20)))]
                draw = lambda few=few: few[int(rng.integers(len(few)))]
            values = [draw() for _ in range(SIZES[i % len(SIZES)])]
            row = features(values, _header(rng, kind))
            row[: len(_LISTED)] *= i // len(SIZES) % 2
            rows.append(row)
            kinds.append(KINDS.index(kind))
            style_of.append(number)
    # Whole numbers: money under a header of money, a key under one of keys, else neither.
    for i in range(8 * COLUMNS_PER_STYLE):
        draw = _whole(rng)
        kind = ("amount", "id", NONE)[i % 3]
        header = _header(rng, list(HINTS)[int(rng.integers(len(HINTS)))]) if kind == NONE else str(rng.choice(HINTS[kind].split()))
        if kind == NONE and set(header_hints(header)) & {"amount", "id"}:
            header = "col"
        rows.append(features([draw() for _ in range(SIZES[i % len(SIZES)])], header.capitalize()))
        kinds.append(KINDS.index(kind))
        style_of.append(-1)
    x, y, style = np.stack(rows), np.array(kinds), np.array(style_of)
    # Each model is trained without every fifth style, so that styles left out show how sure it may be.
    left = [(style >= 0) & (style % MODELS == m) for m in range(MODELS)]
    weights = np.stack([_fit(x[~out], y[~out]) for out in left])
    logits = [(x[out] @ w, y[out]) for w, out in zip(weights, left, strict=True)]

    def loss(t: float) -> float:
        return float(np.mean([-np.log(_softmax(z / t)[np.arange(len(k)), k] + 1e-9).mean() for z, k in logits]))

    return Model(weights, min(np.arange(0.6, 3.0, 0.1), key=loss))


def classify(sample: DataFrame, model: Model | None = None, headers: bool = True) -> DataFrame:
    """``position, column, type, confidence`` of every sampled column; the column's name is its header.

    A column's sample is a bounded list, so columns are scored side by side, many in one batch.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model or trained())
    listed = sample.where(F.col("value").isNotNull()).groupBy("position", "column").agg(F.sort_array(F.collect_list("value")).alias("values"))

    @F.pandas_udf("type STRING, confidence DOUBLE")
    def score(values: pd.Series, header: pd.Series) -> pd.DataFrame:
        found = [shared.value.classify(list(v), h if headers else "") for v, h in zip(values, header, strict=True)]
        return pd.DataFrame(found, columns=["type", "confidence"])

    return listed.select("position", "column", score("values", "column").alias("x")).select("position", "column", "x.*")


def propose(
    df: DataFrame, threshold: float = detect.THRESHOLD, row_key: str | None = None, columns: list[str] | None = None,
    model: Model | None = None, headers: bool = True, most: int = detect.SAMPLE_MAX,
) -> DataFrame:
    """``position, column, type, confidence, formats, status, ambiguous``, a row for every column.

    Types come from the model. The patterns of date columns come from all of their values; a column of which
    under four fifths are dates is skipped, and ``ambiguous`` marks one that doesn't tell days from months.
    """
    columns = columns if columns is not None else [c for c in df.columns if c != row_key]
    sample = detect.sample_column(df, columns, row_key=row_key, most=most)
    # One row a column: the types are the driver's own small list, which names the columns to read again.
    listed = {r["position"]: r for r in classify(sample, model, headers).collect()}
    dated = [columns[p] for p, r in sorted(listed.items()) if r["type"] == "date" and r["confidence"] >= threshold]
    rows = [(p, c, listed[p]["type"], listed[p]["confidence"]) if p in listed else (p, c, None, 0.0) for p, c in enumerate(columns)]
    known = df.sparkSession.createDataFrame(rows, "position INT, column STRING, type STRING, confidence DOUBLE")
    dates = date_patterns(df, dated).drop("position")
    read = F.col("dates") >= detect.FITS * (F.col("dates") + F.col("others"))
    known = known.join(dates, "column", "left").withColumn(
        "confidence", F.when(read | F.col("dates").isNull(), F.col("confidence")).otherwise(F.least("confidence", F.lit(detect.KEY_CONFIDENCE_MAX)))
    )
    status = detect.split_by_confidence(known, threshold)
    return status.select("position", "column", "type", "confidence", "formats", "status", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
