"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line with a word. Its features are its words and pairs of words (lower case,
punctuation as blanks), hashed to ``FEATURES`` weights for each family; a softmax over the families and ``unknown``
gives probabilities. The model is a logistic regression, fitted on the driver on variations of
the templates below and, for ``unknown``, on lines of at most ``TRAIN_DOCS`` documents and on prose that
speaks of licences without granting one. A temperature and the threshold for leaving ``unknown``
are calibrated on a part of the samples that was not learned from.

A paragraph that the classifier gives to a family is confirmed if it holds at least ``LEAST_SHARE`` of the word
pairs of one of the family's templates. Every line of every whole text is classified. Notices that are
wrapped are found in windows of up to ``WINDOW`` lines on end, none of them blank or confirmed alone or in a
shorter window: those that hold two word pairs of templates are classified and compared likewise.

Edge cases: NULL and empty texts have no paragraphs; repeated rows give equal rows; an empty table gives
none, and the model then knows the decoys alone as ``unknown``. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import by_slices, text_bytes
from maskloom.llm.words import mix, run_hashes, word_hashes, words_of

FEATURES = 1 << 16
TRAIN_DOCS, TRAIN_CHARS, TRAIN_LINES = 400, 20_000, 1500
VARIATIONS, ROUNDS, RATE, DECAY, SEED = 30, 50, 3.0, 1e-4, 13
LEAST_SHARE = 0.6
#: Lines of the longest window for wrapped notices.
WINDOW = 3

#: Notices by which public licences are named or granted, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "This project is released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU GPL version 2",
    ),
    "LGPL": (
        "under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU LGPL version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "under the terms of the GNU Affero General Public License",
        "Licensed under the GNU AGPL version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal",
        "dedicated to the public domain by waiving all rights worldwide",
        "This is free and unencumbered software released into the public domain",
    ),
    "ISC": (
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced without written permission",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited",
    ),
}
FAMILIES = ("unknown", *TEMPLATES)
#: Prose about licences that grants none, and notices without a named licence.
DECOYS = (
    "The driver showed a license at the border and went on",
    "Her fishing license had expired in the spring",
    "They asked for permission to use the hall for the public",
    "The version of the story that was released under pressure",
    "A general of the public guard spoke about free software",
    "He licensed the song to a company in the north",
    "See the license file for details",
    "Copyright notices were printed in every copy of the book",
    "This work is free and was released in the public square",
    "The terms of the agreement were published by the foundation",
)

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
for _i in range(128):
    if not chr(_i).isalnum():
        _PLAIN[_i] = 32


def words(text: str) -> list[str]:
    """A paragraph's words as the features see them."""
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all paragraphs on end (a word, then its pair with the next one), each
    paragraph's first one, and how many it has."""
    plain = _PLAIN[data]
    starts, ends, first = words_of(plain, offsets)
    hashes = word_hashes(plain, starts, ends)
    both = np.empty(2 * len(hashes), np.int64)
    both[0::2] = (hashes % np.uint64(FEATURES)).astype(np.int64)
    pairs = np.append(run_hashes(hashes, 2), np.uint64(0))[: len(hashes)]
    both[1::2] = (mix(pairs) % np.uint64(FEATURES)).astype(np.int64)
    last = first[1:][np.diff(first) > 0] - 1
    both[1::2][last] = both[0::2][last]  # the last word of a paragraph has no pair: it counts twice
    return both, 2 * first[:-1], 2 * np.diff(first)


@dataclass
class Classifier:
    weights: np.ndarray  # FEATURES, families
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        both, first, n = features(data, offsets)
        out = np.tile(self.bias, (len(n), 1))
        some = np.flatnonzero(n)
        if len(some):
            out[some] += np.add.reduceat(self.weights[both], first[some]) / np.sqrt(n[some])[:, None]
        return out

    def families(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Family numbers, 0 for unknown, and calibrated probabilities."""
        p = _softmax(self.logits(data, offsets) / self.temperature)
        best = p[:, 1:].argmax(1) + 1 if len(p) else np.zeros(0, np.int64)
        chance = p[np.arange(len(p)), best]
        known = chance >= self.least
        return np.where(known, best, 0), np.where(known, chance, p[:, 0])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
    return e / e.sum(1, keepdims=True) if len(x) else x


def samples(lines: list[str]) -> tuple[list[str], np.ndarray]:
    """Labelled paragraphs: templates, whole and cut, alone and among other words; lines and decoys as unknown."""
    rng = np.random.default_rng(SEED)
    filler = [w for line in lines[:500] for w in line.split()][:5000] or "the of and in to a is for".split()
    some = lambda n: " ".join(rng.choice(filler, n))
    texts, labels = [], []
    for number, family in enumerate(FAMILIES):
        for template in TEMPLATES.get(family, ()):
            for i in range(VARIATIONS):
                own = [w for w in template.split() if i < 10 or rng.random() > 0.06]
                before, after = (rng.integers(0, 9, 2) * (i % 3 != 0)).tolist()
                texts.append(" ".join([some(before), *own, some(after)]) if before or after else " ".join(own))
                labels.append(number)
    for i in range(40):
        for decoy in DECOYS:
            texts.append(f"{some(i % 5)} {decoy} {some(i % 7)}")
            labels.append(0)
    plain = [x for x in lines if not re.search("licen[cs]e|copyright|public domain|SPDX|all rights", x, re.IGNORECASE)]
    texts += plain
    labels += [0] * len(plain)
    return texts, np.array(labels)


def train(lines: list[str]) -> Classifier:
    texts, labels = samples(lines)
    rng = np.random.default_rng(SEED)
    held = rng.random(len(texts)) < 0.25
    both, first, n = features(*text_bytes(pa.array(texts)))
    some = np.flatnonzero((n > 0) & ~held)
    entry = np.concatenate([both[first[i] : first[i] + n[i]] for i in some])
    row = np.repeat(np.arange(len(some)), n[some])
    used, column = np.unique(entry, return_inverse=True)
    value = 1 / np.sqrt(n[some])[row]
    weights, bias = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    wanted = np.eye(len(FAMILIES))[labels[some]]
    # Kinds count alike, so many lines of prose don't outvote a family.
    weight = 1 / np.bincount(labels[some], minlength=len(FAMILIES))[labels[some]]
    weight = weight / weight.mean()
    edge = np.searchsorted(row, np.arange(len(some)))
    order = np.argsort(column, kind="stable")
    column_edge = np.searchsorted(column[order], np.arange(len(used)))
    for _ in range(ROUNDS):
        logits = np.add.reduceat(weights[column] * value[:, None], edge) + bias
        error = (_softmax(logits) - wanted) * weight[:, None] / len(some)
        slope = np.add.reduceat((error[row] * value[:, None])[order], column_edge)
        weights -= 20 * RATE * (slope + DECAY * weights)
        bias -= RATE * error.sum(0)
    full = np.zeros((FEATURES, len(FAMILIES)), np.float32)
    full[used] = weights
    return _calibrated(Classifier(full, bias, 1.0, 0.5), [texts[i] for i in np.flatnonzero(held)], labels[held])


def _calibrated(model: Classifier, texts: list[str], labels: np.ndarray) -> Classifier:
    """The temperature of least cross-entropy, and the least threshold that lets one unknown sample in 500 pass."""
    logits = model.logits(*text_bytes(pa.array(texts)))
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 4, 40), key=loss))
    p = _softmax(logits / model.temperature)[:, 1:].max(1)
    unknown = np.sort(p[labels == 0])
    passed = unknown[-(1 + len(unknown) // 500)] if len(unknown) else 0.0
    model.least = float(min(0.95, max(0.5, passed + 1e-6)))
    return model


def _pairs(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:], strict=False))


_TEMPLATE_PAIRS = {family: [_pairs(words(t)) for t in all_] for family, all_ in TEMPLATES.items()}


def confirmed(paragraph: str, family: str) -> float:
    """The largest share of a template's word pairs that the paragraph holds."""
    own = _pairs(words(paragraph))
    return max(len(own & pairs) / len(pairs) for pairs in _TEMPLATE_PAIRS[family])


def _template_features() -> np.ndarray:
    """Which feature numbers are word pairs of templates."""
    data, offsets = text_bytes(pa.array([t for all_ in TEMPLATES.values() for t in all_]))
    both, first, n = features(data, offsets)
    held = np.zeros(FEATURES, bool)
    for a, m in zip(first, n, strict=True):
        held[both[a + 1 : a + m - 1 : 2]] = True
    return held


_TEMPLATE_FEATURES = _template_features()


def windows(data: np.ndarray, edges: np.ndarray, open_lines: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """First lines of the windows of ``size`` open lines of one text that can hold a template."""
    if len(open_lines) < size:
        return np.zeros(0, np.int64)
    count = len(open_lines) - size + 1
    whole = owner[:count] == owner[size - 1 :]
    for i in range(size):
        whole &= open_lines[i : i + count]
    # Pairs of the whole batch, so that those across a line break count as well.
    plain = _PLAIN[data]
    starts, ends, _ = words_of(plain, np.array([0, len(data)]))
    if len(starts) < 2:
        return np.zeros(0, np.int64)
    pairs = mix(run_hashes(word_hashes(plain, starts, ends), 2)[: len(starts) - 1]) % np.uint64(FEATURES)
    held = np.append(0, np.cumsum(_TEMPLATE_FEATURES[pairs.astype(np.int64)]))
    at = np.searchsorted(starts, edges)
    low, high = at[:count], np.maximum(at[size : size + count] - 1, at[:count])
    return np.flatnonzero(whole & (held[np.minimum(high, len(held) - 1)] - held[np.minimum(low, len(held) - 1)] >= 2))


def learn(docs: DataFrame, rows: int = TRAIN_DOCS) -> Classifier:
    """Fit on templates and on lines of at most ``rows`` documents, the lowest hashes of their ids."""
    ids = docs.select("doc_id").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    chosen = sorted({r[0] for r in ids.collect() if r[0] is not None})
    sample = docs.filter(F.col("doc_id").isin(chosen)).select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    texts = [r.text or "" for r in sample.dropDuplicates().orderBy("doc_id", "text").limit(rows).collect()]
    lines = [x for t in texts for x in t.split("\n") if x.strip()]
    order = np.random.default_rng(SEED).permutation(len(lines))[:TRAIN_LINES]
    return train([lines[i] for i in order])


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, n_paragraphs, n_predicted, n_confirmed, families, found`` of every row.

    ``found`` lists ``family:start:end:probability:share`` of confirmed paragraphs, ``families`` their
    families once each, in order of the alphabet. ``n_paragraphs`` counts lines, ``n_predicted`` lines that the
    classifier gives to a family and confirmed windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        breaks = np.flatnonzero(data == 10) + 1
        edges = np.unique(np.concatenate([offsets, breaks]))
        family, chance = shared.value.families(data, edges) if len(edges) > 1 else (np.zeros(0, int), np.zeros(0))
        inside = ~np.isin(data, np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8))
        some = np.append(0, np.cumsum(inside))
        filled = some[edges[1:]] > some[edges[:-1]]
        owner = np.searchsorted(offsets, edges[:-1], side="right") - 1
        counts = np.bincount(owner[filled], minlength=batch.num_rows)
        found: list[list[tuple[int, str]]] = [[] for _ in range(batch.num_rows)]
        predicted = np.zeros(batch.num_rows, np.int64)
        names: list[set[str]] = [set() for _ in range(batch.num_rows)]
        free = filled.copy()

        def take(i: int, size: int, kind: str, probability: float) -> bool:
            row, lines = owner[i], data[edges[i] : edges[i + size]].tobytes().decode()
            share = confirmed(lines, kind)
            if share < LEAST_SHARE:
                return False
            # A wrapped notice goes on for as long as a line adds to what it holds of a template.
            while size > 1 and i + size < len(owner) and owner[i + size] == row and free[i + size]:
                longer = data[edges[i] : edges[i + size + 1]].tobytes().decode()
                if confirmed(longer, kind) <= share:
                    break
                lines, share, size = longer, confirmed(longer, kind), size + 1
            start = len(data[offsets[row] : edges[i]].tobytes().decode())
            names[row].add(kind)
            found[row].append((start, f"{kind}:{start}:{start + len(lines.rstrip(chr(10)))}:{probability:.3f}:{share:.3f}"))
            free[i : i + size] = False
            return True

        for i in np.flatnonzero((family > 0) & filled):
            predicted[owner[i]] += 1
            take(i, 1, FAMILIES[family[i]], chance[i])
        for size in range(2, WINDOW + 1):
            at = windows(data, edges, free, owner, size)
            if not len(at):
                continue
            joined = [data[edges[i] : edges[i + size]] for i in at]
            kinds, likely = shared.value.families(np.concatenate(joined), np.append(0, np.cumsum([len(x) for x in joined])))
            for i, kind, probability in zip(at, kinds, likely, strict=True):
                if kind and free[i : i + size].all():
                    predicted[owner[i]] += take(i, size, FAMILIES[kind], probability)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(counts, pa.int64()), pa.array(predicted), pa.array([len(x) for x in found], pa.int64()),
                pa.array([",".join(sorted(x)) for x in names]), pa.array([",".join(y for _, y in sorted(x)) for x in found]),
            ],
            ["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families", "found"],
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        by_slices(work, 1 << 20), "doc_id long, n_paragraphs long, n_predicted long, n_confirmed long, families string, found string"
    )
