"""Language identification by hierarchical discrimination.

A text is predicted from its byte n-grams (``SIZES`` bytes, hashed) in lower case, where every run of ASCII
characters other than letters is one blank. First the language family: one-versus-rest linear support vector
machines over the families of the learned languages. Then, within the family, one-versus-one machines
over its languages: each pair votes, ties go to the larger sum of margins. A machine reads the shares of
the n-grams in the whole text, so a text's margins are the means of its n-grams' weights.

The machines are fitted on the driver by dual coordinate descent on at most ``TRAIN_ROWS`` documents of
each of the ``LANGUAGES`` most frequent languages (the lowest hashes of their ids), of each of which
``TRAIN_PIECES`` evenly spaced pieces of ``PIECE_CHARS`` characters are read; held-out documents are never among
them. Every whole text is scored. ``score`` is the family's share of the logistic margins times the language's
share of its pairs' logistic margins.

Edge cases: a NULL text, or one without a letter, is ``und`` with score 0, as is every text where nothing was
learned; with one learned language, any text with a letter is that one; languages that the table of families does not list are
families of their own; a NULL id is not held out; repeated rows get equal rows; an empty table gives
none; only the text is an input of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import by_slices, text_bytes

SIZES = (1, 2, 3, 4)
BITS = 15
BUCKETS = len(SIZES) << BITS
#: The bounds of the training sample.
LANGUAGES, TRAIN_ROWS, TRAIN_PIECES, PIECE_CHARS = 100, 500, 6, 400
EPOCHS, COST, SCALE, SEED = 12, 1.0, 30.0, 13
#: n-grams that are weighed in one step, so that long texts take little more memory than short ones.
AT_ONCE = 1 << 18
UNDETERMINED = "und"

# Families of languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it oc pt rm ro wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku os ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "sinitic": "bo my zh",
    "austronesian": "id jv mg mi ms su tl",
    "bantu": "ln rw sn st sw tn xh yo zu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = ord(" ")
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _CLEAN[_c] = _c
    _CLEAN[_c - 32] = _c
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], language)


def cleaned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one blank for each run of other ASCII, and a blank at both ends of each."""
    n = len(offsets) - 1
    at = offsets + 2 * np.arange(n + 1)
    inner = np.ones(len(data) + 2 * n, bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    padded = np.full(len(inner), ord(" "), np.uint8)
    padded[inner] = _CLEAN[data]
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[at[:-1]] = True
    left = np.add.reduceat(keep, at[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    return padded[keep], np.append(0, np.cumsum(left))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the ``size`` bytes from each place on, places at the end of ``data`` left out."""
    if len(data) < size:
        return np.zeros(0, np.int64)
    total = np.zeros(len(data) - size + 1, np.uint32)
    for i in range(size):
        total = (total ^ data[i : len(data) - size + 1 + i]) * _FACTORS[i]
        total ^= total >> np.uint32(15)
    return (total >> np.uint32(32 - BITS)).astype(np.int64) + (SIZES.index(size) << BITS)


def margins(weights: np.ndarray, bias: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x machines."""
    data, at = cleaned(data, offsets)
    out = np.tile(bias, (len(at) - 1, 1))
    for size in SIZES:
        count = np.maximum(1, np.diff(at) - size + 1)
        scale = (SCALE / len(SIZES) / count)[:, None]
        for a in range(0, len(data) - size + 1, AT_ONCE):
            b = min(a + AT_ONCE, len(data) - size + 1)
            found = weights[grams(data[a : b + size - 1], size)]
            # Places whose bytes reach into the next text count for none.
            low, high = np.searchsorted(at, [a, b - 1], "right")
            for back in range(1, size):
                ends = at[low : high + 2] - back - a
                found[ends[(ends >= 0) & (ends < len(found))]] = 0
            total = np.add.reduceat(found, np.maximum(at[low - 1 : high], a) - a, axis=0, dtype=np.float64)
            out[low - 1 : high] += total * scale[low - 1 : high]
    return out


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and their shares, scaled as ``margins`` weighs them."""
    data, _ = cleaned(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    index, value = [], []
    for size in SIZES:
        found, counts = np.unique(grams(data, size), return_counts=True)
        index.append(found)
        value.append(counts * (SCALE / len(SIZES) / max(1, len(data) - size + 1)))
    return np.concatenate(index), np.concatenate(value)


def machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by dual coordinate descent; classes weigh alike."""
    weights, bias = np.zeros(BUCKETS), 0.0
    share = np.where(labels > 0, (labels > 0).sum(), (labels <= 0).sum())
    diagonal = share / (COST * len(labels))
    norm = np.array([(v * v).sum() + 1 for _, v in rows]) + diagonal
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            y = labels[i]
            gradient = y * (weights[index] @ value + bias) - 1 + diagonal[i] * alpha[i]
            step = max(0.0, alpha[i] - gradient / norm[i]) - alpha[i]
            if step:
                alpha[i] += step
                weights[index] += step * y * value
                bias += step * y
    return weights, bias


@dataclass
class Model:
    """Learned languages by family, and all machines side by side: families first, then pairs of languages."""

    families: list[list[str]]
    pairs: list[tuple[int, int, int]]  # family, place of the one, place of the other
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if not self.families or not n:
            return [UNDETERMINED] * n, np.zeros(n)
        found = margins(self.weights, self.bias, data, offsets)
        sure = 1 / (1 + np.exp(-np.clip(2 * found, -60, 60)))
        several = len(self.families) if len(self.families) > 1 else 0
        family = found[:, :several].argmax(1) if several else np.zeros(n, int)
        score = sure[np.arange(n), family] / sure[:, :several].sum(1) if several else np.ones(n)
        out = np.empty(n, object)
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, total, share = (np.zeros((len(rows), len(languages))) for _ in range(3))
            for m, (of, one, other) in enumerate(self.pairs, several):
                if of == f:
                    votes[:, one] += found[rows, m] >= 0
                    votes[:, other] += found[rows, m] < 0
                    total[:, one] += found[rows, m]
                    total[:, other] -= found[rows, m]
                    share[:, one] += sure[rows, m]
                    share[:, other] += 1 - sure[rows, m]
            best = np.lexsort((total, votes), axis=1)[:, -1]
            out[rows] = np.array(languages, object)[best]
            if len(languages) > 1:
                score[rows] *= share[np.arange(len(rows)), best] / (len(languages) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def fit(texts: list[bytes], languages: list[str]) -> Model:
    known = sorted(set(languages))
    names = sorted({family_of(x) for x in known})
    families = [[x for x in known if family_of(x) == name] for name in names]
    rows = [shares(text) for text in texts]
    given = np.array(languages, object)
    machines = []
    if len(families) > 1:
        of = np.array([names.index(family_of(x)) for x in languages])
        machines += [machine(rows, np.where(of == f, 1.0, -1.0)) for f in range(len(families))]
    pairs = [(f, i, j) for f, group in enumerate(families) for i in range(len(group)) for j in range(i + 1, len(group))]
    for f, i, j in pairs:
        some = np.flatnonzero((given == families[f][i]) | (given == families[f][j]))
        machines.append(machine([rows[k] for k in some], np.where(given[some] == families[f][i], 1.0, -1.0)))
    weights = np.stack([w for w, _ in machines], 1) if machines else np.zeros((BUCKETS, 0))
    return Model(families, pairs, weights.astype(np.float32), np.array([b for _, b in machines]))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, languages: int = LANGUAGES) -> Model:
    """Fit on at most ``rows`` documents of each of the ``languages`` most frequent languages, none held out."""
    marked = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    count = marked.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not count:
        return fit([], [])
    # A share of each language's documents that holds twice the rows, then the lowest hashes of these.
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30))
    least = {r["lang"]: min(1.0, 2 * rows / r["count"]) for r in count}
    shared = F.create_map(*[x for lang, part in least.items() for x in (F.lit(lang), F.lit(int(part * (1 << 30))))])
    size = F.length("text")
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_PIECES - 1)),
        lambda i: F.substring(F.col("text"), (i * (size - PIECE_CHARS) / (TRAIN_PIECES - 1)).cast("int") + 1, F.lit(PIECE_CHARS)),
    )
    text = F.when(size > TRAIN_PIECES * PIECE_CHARS, F.array_join(spaced, " ")).otherwise(F.col("text"))
    sample = marked.filter(place < shared[F.col("lang")]).select("lang", place.alias("place"), text.alias("text"))
    found: dict[str, list[bytes]] = {lang: [] for lang in least}
    for r in sample.orderBy("place", "lang", F.md5(F.col("text").cast("binary"))).limit(3 * rows * len(least)).collect():
        if len(found[r["lang"]]) < rows:
            found[r["lang"]].append(r["text"].encode())
    pairs = [(text, lang) for lang, texts in sorted(found.items()) for text in texts]
    return fit([text for text, _ in pairs], [lang for _, lang in pairs])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        language, score = shared.value.predict(*text_bytes(batch.column(1)))
        some = batch.column(2).to_numpy(zero_copy_only=False)
        language = [x if y else UNDETERMINED for x, y in zip(language, some, strict=True)]
        score = np.where([x != UNDETERMINED for x in language], score, 0.0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = given.mapInArrow(by_slices(work, 1 << 20), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
