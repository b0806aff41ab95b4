"""Secret scans: base patterns, and character Markov models of random strings and identifiers.

The base patterns find passwords and tokens that are assigned, access key ids and long hex strings.
The method adds what they miss: a run of ``TOKEN`` characters is a ``random`` span if the two
first-order Markov models, one trained on samples labelled as random, one on ordinary words and
identifiers, differ by a mean log-likelihood ratio of at least ``LEAST_RATIO`` a character. Else the
stretch of at least ``LEAST_CHARS`` whose ratios exceed that most is taken, then what stands beside it, so
strings behind names and paths are found. Runs of digits alone are numbers, not secrets.

The models are fitted on the driver: the random samples are what the base patterns found in at most
``TRAIN_DOCS`` documents and strings drawn from the usual alphabets; the ordinary ones are those
documents' other words, joined into identifiers as programs do, and numbers. Every whole text is scanned.

Edge cases: NULL and empty texts have no spans (and the digest of an empty list); places are code
points, ends exclusive; matches of one pattern don't overlap, those of two may; ``random`` spans
overlap no base span; repeated rows give equal rows; an empty table gives none, and the models then
rest on drawn samples alone. ``redacted`` keeps all rows and columns.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import by_slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: What the Markov models look at.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_RATIO = 0.9
#: Least length of a stretch of a run, and what a stretch is continued to.
LEAST_CHARS, SEPARATORS = 20, "=/_-"
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WORDS, DRAWN = 400, 20_000, 20_000, 3000
SEED = 11

_CODE = np.zeros(128, np.uint8)
for _i, _c in enumerate(string.ascii_letters + string.digits + "+/_=-."):
    _CODE[ord(_c)] = 1 + _i
_STATES = 1 + int(_CODE.max())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` by start, then kind as listed.

    Runs of one class are found whole, so asking for the least length in the pattern equals dropping
    shorter matches; an assignment's short value still uses up its characters, so it is dropped after.
    """
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def transitions(samples: list[str]) -> np.ndarray:
    """Log-probabilities of a character after another, one count added to each; row 0 is the start."""
    counts = np.ones((_STATES, _STATES))
    for sample in samples:
        codes = _CODE[np.frombuffer(sample.encode("ascii", "replace"), np.uint8)]
        np.add.at(counts, (np.append(0, codes[:-1]), codes), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def drawn_samples(rng: np.random.Generator, n: int) -> list[str]:
    letters, digits = string.ascii_letters, string.digits
    alphabets = ["0123456789abcdef", letters + digits, letters + digits + "+/", letters + digits + "_-", string.ascii_uppercase + digits]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), int(rng.integers(20, 48)))) for i in range(n)]


def identifiers(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words as they are, and joined as in snake_case, camelCase, kebab-case, constants and paths."""
    plain = [w for w in words if w]
    out = list(plain)
    for i in range(0, len(plain) - 3, 4):
        part = [w.lower() for w in plain[i : i + 3]]
        joined = ("_".join(part), part[0] + "".join(w.capitalize() for w in part[1:]), "-".join(part), "_".join(part).upper(), "/".join(part))
        out.append(joined[(i // 4) % 5] + ("" if i % 3 else str(int(rng.integers(0, 2000)))))
    numbers = ["".join(rng.choice(list(string.digits), int(rng.integers(4, 28)))) for _ in range(len(out) // 10 + 50)]
    runs = [c * 24 for c in string.ascii_letters + string.digits + "=-_"]
    return out + numbers + runs


def train(texts: list[str]) -> np.ndarray:
    """The log-likelihood ratio of each transition, random against ordinary."""
    rng = np.random.default_rng(SEED)
    secrets, words = [], []
    for text in texts:
        rest, at = [], 0
        for a, b, kind in base_spans(text):
            value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
            secrets.append(value)
            rest.append(text[at:a])
            at = max(at, b)
        words += re.findall(r"[A-Za-z]+", " ".join([*rest, text[at:]]))
    words = [words[i] for i in rng.permutation(len(words))[:TRAIN_WORDS]]
    words += "get set user name value index count default config request response handler data file path".split()
    return transitions(secrets + drawn_samples(rng, DRAWN)) - transitions(identifiers(words, rng))


def ratio(token: str, model: np.ndarray) -> float:
    codes = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return float(model[np.append(0, codes[:-1]), codes].mean())


def random_stretches(token: str, model: np.ndarray, least: float = LEAST_RATIO) -> list[tuple[int, int]]:
    """Starts and ends of the random strings in a run: the whole run, or else the stretch that is
    furthest over ``least``, up to the next separators, and then what stands before and after it."""
    codes = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    score = model[np.append(0, codes[:-1]), codes]
    found, left = [], [(0, len(token))]
    while left:
        a, b = left.pop()
        if b - a < LEAST_CHARS:
            continue
        total = np.append(0.0, np.cumsum(score[a:b]))
        start, end = 0, b - a
        if total[-1] < least * (b - a):
            over = total - least * np.arange(b - a + 1)
            low = np.minimum.accumulate(over[: b - a - LEAST_CHARS + 1])
            end = int((over[LEAST_CHARS:] - low).argmax()) + LEAST_CHARS
            start = int(over[: end - LEAST_CHARS + 1].argmin())
            if over[end] < over[start]:
                continue
            # As far on as the sum of ratios grows, if the mean allows it.
            far = end + int(total[end:].argmax())
            end = far if over[far] >= over[start] else end
            far = int(total[: start + 1].argmin())
            start = far if over[end] >= over[far] else start
        start, end = a + start, a + end
        while start > a and token[start - 1] not in SEPARATORS:
            start -= 1
        while end < b and token[end] not in SEPARATORS:
            end += 1
        # An equals sign within a stretch ends a name; padding has nothing long behind it.
        start = max(start, token.rfind("=", start, max(start, end - LEAST_CHARS)) + 1)
        if re.search("[A-Za-z]", token[start:end]):
            found.append((start, end))
        left += [(a, start), (end, b)]
    return sorted(found)


def spans(text: str, model: np.ndarray, least: float = LEAST_RATIO) -> list[tuple[int, int, str]]:
    """Base spans and random ones, by start, then kind as listed."""
    base = base_spans(text)
    more = []
    for m in TOKEN.finditer(text):
        a, last = m.span()
        for x, y, _ in [*(z for z in sorted(base) if z[0] < last and z[1] > a), (last, last, "")]:
            if x - a >= LEAST_CHARS:
                more += [(a + i, a + j, "random") for i, j in random_stretches(text[a:x], model, least)]
            a = max(a, y)
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def learn(docs: DataFrame, rows: int = TRAIN_DOCS) -> np.ndarray:
    """Fit on the beginnings of at most ``rows`` documents, the lowest hashes of their ids."""
    ids = docs.select("doc_id").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    chosen = sorted({r[0] for r in ids.collect() if r[0] is not None})
    sample = docs.filter(F.col("doc_id").isin(chosen)).select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    return train([r.text or "" for r in sample.dropDuplicates().orderBy("doc_id", "text").limit(rows).collect()])


def _listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t or "", shared.value) for t in batch.column(1).to_pylist()]
        kinds = [[x[2] for x in row] for row in found]
        base = [_listed([x for x in row if x[2] != "random"]) for row in found]
        columns = [batch.column(0), *(pa.array([row.count(k) for row in kinds], pa.int64()) for k in KINDS)]
        columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()))
        columns.append(pa.array([_listed(row) for row in found], pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        by_slices(work), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    )


def blanked(text: str, model: np.ndarray) -> str:
    """``text`` with ``[secret]`` in place of every span; spans that overlap are one."""
    out, at = [], 0
    for a, b, _ in spans(text, model):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """All rows and columns; ``text`` without secrets, and ``n_chars``, if there, of the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else blanked(t, shared.value))

    out = docs.withColumn("text", blank("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
