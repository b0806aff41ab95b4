"""The operators of the training-data pipeline: brute force, exact round trips, held-out figures, edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm import digest, licenses, mixing, near, packing, quality, secrets, substrings, tokens, vectors, warc
from maskloom.llm.common import components, text_bytes
from maskloom.llm.queries import QUERIES
from maskloom.llm.sql import SQL
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "position", "block", "k", "c", "near_k", "own_position", "mix_key"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def edge(spark):
    """NULLs in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    long_text = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, None), (3, "one two", None, "", 7), (3, "one two", None, "", 7),
        (4, long_text, "en", "a", len(long_text)), (None, "no id here", None, None, None), (None, None, None, None, None),
        (5, long_text + " end", "en", "b", 1), (6, "ß 日本 🙂 \x00 İ", "de", "a", 3), (6, "another text of the same id", "de", "a", 3),
        (7, "   \n\t ", "en", "b", 4),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], SQL[name]) is None


# packing


def test_encoder_equals_the_tokenizer(texts):
    odd = ["", "  ", "İstanbul ΣΑΣ ß ẞ", "a<|endoftext|>b", "don't we'll 'sun x²½ 12,3 a_b café\xa0x\x85y\x1cz", "ŉ ĳ ſ Ÿ Œ", "日本 🙂", "$$!! --", "\x7f\x00a"]
    encoder = tokens.WordEncoder(TOKENIZER)
    given = odd + list(texts.values())
    assert encoder.encode(given) == encoder._whole(given)


def check_packing(found, texts):
    encoder = tokens.WordEncoder(TOKENIZER)
    by_doc: dict = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = encoder._whole([text or ""])[0] + b"\0\0\0\0"
        for i, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            own = ids[8192 * i : 8192 * (i + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (i, 2048 * i, len(own) // 4, zlib.crc32(own))
        assert sum(r.length for r in by_doc[doc_id]) == len(ids) // 4
    bins: dict = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing_query(spark, texts):
    found = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    bins = check_packing(found, texts)
    assert bins <= -(-sum(r.length for r in found) // 2048) + 1


def test_local_search_dissolves_bins():
    # [3, 1] goes to [6, 2] for its 2, which then goes to [4, 4].
    lengths = [6, 2, 4, 4, 3, 1]
    bins = packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(6))
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 60))]
        bins = packing.pack_lengths(sizes, 64)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 64 for b in bins) and len(bins) <= len(packing.best_fit(sizes, 64))


def test_packing_edges(edge, nothing):
    found = packing.pack_documents(edge, TOKENIZER).collect()
    assert {r.doc_id for r in found} == {None, 1, 2, 3, 4, 5, 6, 7} and sum(r.doc_id == 3 for r in found) == 2
    assert [r.length for r in found if r.doc_id == 1] == [1]
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0
    with_ids = packing.token_pieces(edge, TOKENIZER, with_ids=True).collect()
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)


# vectors


def brute_vectors(rows):
    n, component = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    def usable(e):
        return e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)

    good = [i for i, (_, e) in enumerate(rows) if usable(e)]
    for p, i in enumerate(good):
        for j in good[:p]:
            a, b = (np.array(rows[x][1], float) / np.abs(rows[x][1]).max() for x in (i, j))
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                n[i] += 1
                n[j] += 1
                component[root(i)] = root(j)
    groups: dict = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    least = lambda g: None if None in g else min(g)
    return sorted(((k, n[i], least(groups[root(i)])) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("cell, tile", [(4096, 4096), (20, 7)])
def test_vectors_equal_brute_force(spark, cell, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * (0.1 if i < 150 else 0)).tolist()) for i in range(200)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] * 16)]
    rows += [(None, base[0].tolist()), (7, base[1].tolist()), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e-300] * 16), (909, [1e300] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "2 AS n_links")
    found = vectors.near_vectors(df, cell=cell, tile=tile).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr) == brute_vectors(rows)


def test_vectors_of_more_lengths_than_pivots(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOTS", 4)
    rng = np.random.default_rng(4)
    rows = [(10 * n + i, (v + rng.normal(size=n) * 0.05 * i).tolist()) for n in range(1, 31) for v in [rng.normal(size=n)] for i in range(3)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=8).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr) == brute_vectors(rows)


def test_vectors_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op2_embedding_near_dedup"](spark, SF).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(empty).count() == 0


def test_components_of_a_long_path(spark):
    order = random.Random(2).sample(range(300), 300)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False) if order.index(a) % 100 != 99], "a long, b long")
    found = dict(rows_of(components(edges, "a", "b")))
    for i in range(0, 300, 100):
        assert {found[x] for x in order[i : i + 100]} == {min(order[i : i + 100])}


# licences


def test_licenses_find_known_lines(spark, texts):
    known = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    }
    for r in QUERIES["op3_license_scan"](spark, SF).collect():
        text = texts[r.doc_id]
        assert r.families == ",".join(sorted({f for line, f in known.items() if line in text}))
        assert r.n_paragraphs == sum(bool(x.strip()) for x in text.split("\n"))
        for x in filter(None, r.found.split(",")):
            family, a, b, *_ = x.split(":")
            assert known[text[int(a) : int(b)].strip()] == family


def test_licenses_held_out_and_edges(edge, nothing, texts):
    model = licenses.train([x for t in list(texts.values())[:100] for x in t.split("\n") if x.strip()])
    cases = [
        ("Distributed under the MIT License", "MIT"), ("Licensed under the Apache License, Version 2.0 (the License)", "Apache-2.0"),
        ("this program is free under the terms of the GNU General Public License as published by the Free Software Foundation", "GPL"),
        ("He renewed his license for fishing at the office", "unknown"), ("The thing that was there", "unknown"),
    ]
    family, chance = model.families(*text_bytes(pa.array([c for c, _ in cases])))
    assert [licenses.FAMILIES[i] for i in family] == [f for _, f in cases] and ((0 <= chance) & (chance <= 1)).all()
    assert licenses.scan(edge, model).count() == edge.count()
    assert licenses.scan(nothing, licenses.learn(nothing)).count() == 0


def test_licenses_find_wrapped_notices(spark, texts):
    model = licenses.train([x for t in list(texts.values())[:100] for x in t.split("\n") if x.strip()])
    cases = [
        ("Licensed under the Apache\nLicense, Version 2.0", "Apache-2.0"),
        ("This work is licensed under the GNU\nGeneral Public License, version 3", "GPL"),
        ("# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated documentation files", "MIT"),
        ("Permission is hereby granted, free\nof charge, to any person obtaining a copy\nof this software and associated documentation files", "MIT"),
        ("Licensed under the Apache\n\nLicense, Version 2.0", ""), ("He went home.\nThe rights of all were reserved\nfor later.", ""),
        ("", ""), (None, ""),
    ]
    rows = [(i, None if t is None else f"é first line of the text\n\n{t}\n\nlast line") for i, (t, _) in enumerate(cases)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()}
    assert [found[i].families for i in range(len(cases))] == [f for _, f in cases]
    for i, (t, f) in enumerate(cases):
        if f:
            kind, a, b, *_ = found[i].found.split(":")
            assert (rows[i][1][int(a) : int(b)], found[i].n_confirmed) == (t, 1)


# near copies


def brute_common(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_banded_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        assert near.banded_common(a, b, 15) == brute_common(a, b)
        a = [rng.randrange(40) for _ in range(rng.randrange(5, 40))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = 99
            b.insert(rng.randrange(len(b)), 98)
        common = brute_common(a, b)
        jaccard = common / (len(a) + len(b) - common)
        assert near.similarity(np.array(a, np.uint64), np.array(b, np.uint64)) == pytest.approx(jaccard if jaccard >= 0.8 else 0)


def brute_classes(texts):
    runs = {}
    for key, text in texts.items():
        words = text.encode().split()
        runs[key] = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    number = {x: i for i, x in enumerate({x for r in runs.values() for x in r})}
    coded = {k: np.array([number[x] for x in r], np.uint64) for k, r in runs.items()}
    sets, label = {k: set(r) for k, r in runs.items()}, {k: k for k in runs}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(runs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] & sets[b] and near.similarity(coded[a], coded[b]) >= 0.8:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_near_classes_equal_brute_force(spark, texts):
    found = QUERIES["op4_order_minhash"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_near_copies_of_a_large_group(spark):
    """Copies with a few words changed, and texts that only share a passage with them."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(900)}" for _ in range(150)]
    copies = []
    for _ in range(300):
        own = list(base)
        own[rng.randrange(150)] = f"x{rng.random()}"
        copies.append(" ".join(own))
    others = [" ".join(base[:60] + [f"y{rng.random()}" for _ in range(90)]) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near.near_classes(df).collect()}
    assert {found[i] for i in range(300)} == {0} and all(found[i] == i for i in range(300, 400))


def test_near_pairs_among_texts_that_share_a_passage(spark):
    """All texts agree in sketches by a passage, and each has one other text at the threshold."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(170)]
    rows = []
    for i in range(1200):
        own = [f"o{i}_{j}" for j in range(30)]
        other = own[:12] + [f"z{i}_{j}" for j in range(18)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + other))]
    rng.shuffle(rows)
    texts = dict(rows)
    coded = lambda t: np.array([zlib.crc32(" ".join(t.split()[i : i + 5]).encode()) for i in range(len(t.split()) - 4)], np.uint64)
    assert near.similarity(coded(texts[0]), coded(texts[1])) >= 0.8 and near.similarity(coded(texts[0]), coded(texts[2])) == 0
    found = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i // 2 * 2 for i in texts}


def test_near_edges(edge, nothing):
    found = sorted(((r.doc_id, r.class_id) for r in near.near_classes(edge).collect()), key=repr)
    # NULL, empty and blank texts are one class, whose smallest id is NULL; the long texts are near copies.
    assert found == sorted([(1, None), (2, None), (7, None), (None, None), (None, None), (3, 3), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6)], key=repr)
    kept = near.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r.text or "")[:7] for r in kept.collect()) == sorted(["", "one two", "w0 w1 w", "no id h", "ß 日本 🙂 ", "another"])
    assert near.near_classes(nothing).count() == near.keep_one(nothing).count() == 0


# substrings


def brute_repeats(rows):
    first, all_words = {}, {}
    for key, text in sorted(rows):
        words = all_words[key] = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        for i in range(len(words) - 19):
            first.setdefault(tuple(words[i : i + 20]), (key, i))
    out = {}
    for key, words in all_words.items():
        cover = [False] * len(words)
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] < (key, i):
                cover[i : i + 20] = [True] * 20
        kept = b" ".join(w for w, c in zip(words, cover, strict=True) if not c)
        out[key] = (len(words), sum(cover), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_substrings_equal_brute_force(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    found = QUERIES["op5_suffix_automata"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_repeats(texts.items())


def test_substrings_of_repetitive_texts(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for i in range(120):
        words = [rng.choice("abc") for _ in range(rng.randrange(70))]
        at = rng.randrange(len(words) + 1)
        rows.append((i, " ".join(words[:at] + (passage[rng.randrange(30) :] if i % 2 else []) + words[at:] + ["z"] * rng.randrange(45))))
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_automaton_equals_sets(monkeypatch):
    monkeypatch.setattr(substrings, "WINDOW", 5)
    rng = random.Random(1)
    for _ in range(200):
        seen: set = set()
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 60))] for _ in range(4)]
        for words, found in zip(sequences, substrings.repeated_windows(sequences), strict=True):
            windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            assert found == [i for i, x in enumerate(windows) if x in seen]
            seen |= set(windows)


def test_substring_edges(edge, nothing):
    found = {(r.doc_id, r.n_words): r.n_removed for r in substrings.dedup_substrings(edge).collect()}
    # The long text repeats itself every 7919 words; its copy is removed but for the last word.
    assert found[4, 60_000] == 60_000 - 7919 and found[5, 60_001] == 60_000
    assert found[3, 2] == 0 and found[1, 0] == 0 and found[None, 3] == 0 and len(found) == 10
    assert substrings.dedup_substrings(nothing).count() == 0


# fingerprints


def test_fingerprints_query(spark, texts):
    order = sorted(texts.items(), reverse=True)
    found = {r.doc_id: r for r in QUERIES["op6_quartile_fingerprints"](spark, SF).collect()}
    assert len(found) == len(order)
    for (key, text), (after_key, after) in zip(order, order[1:] + order[:1], strict=True):
        cut, r = len(text) // 3, found[key]
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(digest.compare(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(digest.compare(r.fingerprint, found[after_key].fingerprint))
    assert np.mean([r.near_edited > r.near_next for r in found.values()]) > 0.97


def test_counters_equal_brute_force():
    given = [b"", b"abc", b"abcd", "naïve text, naïve text".encode(), bytes(range(256))]
    found = digest.counters(*text_bytes(pa.array(given, pa.binary())))
    for data, row in zip(given, found, strict=True):
        want = [0] * digest.BUCKETS
        for i in range(len(data) - 3):
            for number, pattern in enumerate(digest.PATTERNS):
                mixed = (number + 1) * 0x27D4EB2F + sum(data[i + at] * k for at, k in zip(pattern, digest.MIX, strict=True)) & 0xFFFFFFFF
                mixed = (mixed ^ mixed >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                want[mixed >> 24] += 1
        assert row.tolist() == want


def test_fingerprint_edges(edge, nothing, spark):
    found = digest.edited_likeness(edge).collect()
    assert len(found) == edge.count() and all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    same = {r.fingerprint for r in digest.fingerprints(edge).collect() if r.doc_id == 3}
    assert len(same) == 1 and digest.edited_likeness(nothing).count() == 0
    [one] = digest.edited_likeness(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1


# quality


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    found = QUERIES["op7_quality_classifier"](spark, sf).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, q in held if q == x] for x in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.85 and np.mean([s >= 0.5 for s in good]) > 0.93


def test_network_gradient():
    rng = np.random.default_rng(1)
    net = quality.Network.fresh(rng)
    docs = [rng.integers(0, 256, (n, 2, quality.BLOCK + quality.WIDTH)).astype(np.uint8) for n in (1, 3)]
    labels = np.array([0, 1], np.float32)

    def loss():
        total = 0.0
        for d, y in zip(docs, labels, strict=True):
            pooled = net.largest(d.reshape(-1, d.shape[-1])).reshape(-1, 2, quality.FILTERS).max(1)
            hidden = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
            z = float(np.concatenate([hidden.mean(0), hidden.max(0)]) @ net.last + net.last_bias[0])
            total += np.logaddexp(0, z) - y * z
        return total / len(docs)

    for part, grad in zip(net.parts(), quality._gradient(net, docs, labels), strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        part[at] += 1e-3
        up = loss()
        part[at] -= 2e-3
        down = loss()
        part[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grad[at], rel=0.1, abs=1e-3)


def test_quality_reads_whole_texts_and_edges(edge, nothing, spark):
    net = quality.Model(quality.Network.fresh(np.random.default_rng(2)))
    a = [b"a" * 5000, b"a" * 4990 + b"!!!!!! ZZ!", b"", b"x"]
    scores = net.scores(*text_bytes(pa.array(a, pa.binary())))
    alone = [net.scores(*text_bytes(pa.array([x], pa.binary())))[0] for x in a]
    assert scores == pytest.approx(alone) and scores[0] != scores[1]
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (4, 0), (4, 1), (99, 0)], "doc_id long, quality int")
    model = quality.learn(edge, labels)
    found = quality.score_documents(edge, model).collect()
    assert len(found) == edge.count() and all(r.score is not None for r in found)
    assert quality.keep_good(edge, quality.Model(None, 0.7)).columns == edge.columns
    assert quality.keep_good(edge, quality.Model(None, 0.3)).count() == 0
    assert quality.score_documents(nothing, quality.learn(nothing, labels)).count() == 0


# mixing


def test_mixing_deviates_by_less_than_a_block(spark):
    rows = [(i, s) for i, s in enumerate(["a"] * 4000 + ["b"] * 900 + ["c"] * 250 + [None] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    found = mixing.schedule(docs, {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}, block_docs=5, period=100).collect()
    assert sorted(r.position for r in found) == list(range(len(rows)))
    blocks = sorted({(r.slot, r.source, r.block, r.release, r.deadline) for r in found}, key=lambda x: x[0])
    assert len({b[0] for b in blocks}) == len(blocks)
    assert all(release <= slot < deadline for slot, _, _, release, deadline in blocks)
    weight, had = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}, dict.fromkeys(["a", "b", "c", None], 0)
    left = {s: sum(b[1] == s for b in blocks) for s in had}
    for t, (slot, source, *_) in enumerate(blocks):
        if slot != t:
            break  # a source has run out
        had[source] += 1
        assert all(abs(had[s] - weight[s] * (t + 1)) < 1 for s in had)
    assert min(left[s] - had[s] for s in had) <= 1


def test_mixing_of_many_sources_deviates_by_less_than_a_block(spark):
    """A large source among a thousand small ones: at every slot each has had its exact weight's share."""
    small, large = 1000, 4000
    name = F.when(F.col("id") < large, F.lit("large")).otherwise(F.concat(F.lit("s"), F.col("id") % small))
    docs = spark.range(large + 20 * small).select(F.col("id").alias("doc_id"), name.alias("source"))
    found = mixing.schedule(docs).select("source", "slot", "position").collect()
    assert sorted(r.position for r in found) == list(range(large + 20 * small))
    taken = {r.slot: r.source for r in found}
    last = {}
    for r in found:
        last[r.source] = max(last.get(r.source, 0), r.slot)
    total = large**0.5 + small * 20**0.5
    share = {s: (large if s == "large" else 20) ** 0.5 / total for s in last}
    had, late = dict.fromkeys(last, 0), dict.fromkeys(last, -1)
    for slot in range(min(last.values())):  # until the first source has run out
        source = taken[slot]  # no slot stands empty before
        # Behind just before a block, ahead just after it.
        assert slot * share[source] - had[source] < 1
        had[source] += 1
        late[source] = slot
        assert had[source] - (slot + 1) * share[source] < 1
    for source, n in had.items():
        assert min(last.values()) * share[source] - n < 1


def test_mixing_is_native_and_edges(edge, nothing, spark):
    mixed = mixing.mixed(edge)
    assert mixed.columns == edge.columns and sorted(rows_of(mixed), key=repr) == sorted(rows_of(edge), key=repr)
    assert mixing.schedule(nothing).count() == mixing.mixed(nothing).count() == 0
    plan = mixing.schedule(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert mixing.schedule(edge, {"a": 0, "z": 1}).count() == edge.count()


# WARC


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/?q=é", "<title> A &amp; B </title><p>one<br>two&nbsp;<a href=\"/x&amp;y\">three</a><script>no()</script>"), (2, None, None), (None, "u", "")],
        "page_id long, url string, html string",
    ).selectExpr("*", "'x' AS payload", "'y' AS block")
    sent = warc.responses(pages)
    warc.write_warc(warc.response_records(sent), f"{tmp_path}/in")
    read = warc.responses_of(warc.read_warc(spark, f"{tmp_path}/in"))
    names = ["record_id", "target_uri", "warc_date", "http_header", "payload"]
    assert sorted(rows_of(read.select(names))) == sorted(rows_of(sent.select(names)))
    made = warc.derivatives(read)
    assert sorted(rows_of(made)) == sorted(rows_of(warc.derivatives(sent)))
    warc.write_warc(warc.derivative_records(made), f"{tmp_path}/out")
    stored = {r.fields["warc-record-id"]: r for r in warc.read_warc(spark, f"{tmp_path}/out").collect()}
    assert len(stored) == 6
    for r in made.collect():
        fields, block = stored[r.record_id].fields, bytes(stored[r.record_id].block)
        assert block.decode() == r.block and fields["warc-refers-to"] == r.refers_to and fields["warc-payload-digest"] == r.source_digest
        assert fields["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert stored[r.concurrent_to].fields["warc-concurrent-to"] == r.record_id
    [plain] = [r.block for r in made.collect() if r.warc_type == "conversion" and r.target_uri.startswith("http")]
    [meta] = [r.block for r in made.collect() if r.warc_type == "metadata" and r.target_uri.startswith("http")]
    assert plain == "A & B\none\ntwo three" and '"title":"A & B"' in meta and '"/x&y"' in meta
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_keeps_digests_and_reads_other_charsets(spark, tmp_path):
    def record(name, http, body, more):
        block = http + b"\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\n{more}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    body = "<p>café</p>".encode("latin-1")
    latin, plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1", b"HTTP/1.1 200 OK"
    sha1 = "WARC-Payload-Digest: sha1:ABC\r\nWARC-IP-Address: 1.2.3.4\r\n"
    (tmp_path / "a.warc").write_bytes(record("a", latin, body, sha1) + record("b", plain, body, "") + record("c", plain, b"<p>ok</p>", ""))
    made = warc.derivatives(warc.responses_of(warc.read_warc(spark, str(tmp_path))), "fields").filter("warc_type = 'conversion'")
    found = {r.refers_to: r for r in made.collect()}
    assert {k: r.block for k, r in found.items()} == {"<a>": "café", "<b>": "caf\ufffd", "<c>": "ok"}
    assert found["<a>"].source_digest == "sha1:ABC" and found["<a>"].fields["warc-ip-address"] == "1.2.3.4"
    assert found["<b>"].source_digest == "sha256:" + hashlib.sha256(body).hexdigest()


# secrets


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6 and m[1].isascii():
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), kind, f"{('', 'access', 'hex')[kind]}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x for *_, x in sorted(found)]


TRICKY = [
    "secret=token: abcdefgh", "API_KEY = 'abc.def=1' apikey:x token=123456", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 11, "0" * 23 + " " + "f" * 24 + "G",
    "PassWord\":\"" + "a1" * 20, "token=token=abcdef", "é🙂 passwd : hunter22!", "",
]


def test_secret_query(spark, texts):
    for r in QUERIES["op10_secret_scan"](spark, SF).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == base


def test_base_spans_of_tricky_texts():
    for text in TRICKY:
        assert [f"{k}:{a}:{b}" for a, b, k in secrets.base_spans(text)] == brute_base(text)


def test_markov_models_on_held_out_samples(texts):
    model = secrets.train(list(texts.values())[:100])
    rng = np.random.default_rng(99)
    drawn = [secrets.ratio(x, model) for x in secrets.drawn_samples(rng, 500)]
    words = [w for t in list(texts.values())[100:] for w in re.findall("[A-Za-z]+", t)]
    names = [secrets.ratio(x, model) for x in secrets.identifiers(words, rng) if len(x) >= 20 and re.search("[0-9]", x)]
    assert np.mean([x >= secrets.LEAST_RATIO for x in drawn]) > 0.95 and np.mean([x >= secrets.LEAST_RATIO for x in names]) < 0.02
    key = base64.b64encode(hashlib.sha256(b"k").digest()).decode().rstrip("=")
    assert [k for *_, k in secrets.spans(f"the key {key} stands here", model)] == ["random"]


def test_random_strings_behind_names_paths_and_urls(texts):
    model, rng = secrets.train(list(texts.values())[:100]), np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    before = {"AZURE_STORAGE_ACCOUNT_KEY=": 32, "auth/callback/session=": 24, "/home/user/keys/": 24, "session_id=": 20, "https://x.example.com/v1/file/": 32, "": 24}
    for name, n in before.items():
        for alphabet in (letters, letters + "0123456789"):
            keys = ["".join(rng.choice(list(alphabet), n)) for _ in range(100)]
            left = [secrets.blanked(f"see {name}{key} here", model) for key in keys]
            assert np.mean([x.startswith("see ") and x.endswith("[secret] here") for x in left]) > 0.95, (name, alphabet)
            assert np.mean([x == f"see {name}[secret] here" for x in left if name.endswith("=")] or [1]) > 0.95, (name, alphabet)
    two = "".join(rng.choice(list(letters), 24)), "".join(rng.choice(list(letters + "0123456789"), 24))
    left = secrets.blanked(f"first_key={two[0]}/second_key={two[1]}", model)
    assert left.startswith("first_key=[secret]") and left.endswith("_key=[secret]") and left.count("[secret]") == 2
    words = [w for t in list(texts.values())[100:] for w in re.findall("[A-Za-z]+", t)]
    paths = ["/".join(words[i : i + 8]) for i in range(0, len(words) - 8, 8)]
    assert np.mean([bool(secrets.spans(x, model)) for x in paths]) < 0.01


def test_secret_edges(edge, nothing, spark):
    model = secrets.learn(edge)
    assert secrets.scan(edge, model).count() == edge.count()
    assert secrets.scan(nothing, secrets.learn(nothing)).count() == 0
    df = spark.createDataFrame([(1, "x password=abcdef123 y", 5), (2, None, 1)], "doc_id long, text string, n_chars int")
    assert sorted(rows_of(secrets.redacted(df, model)), key=repr) == [(1, "x [secret] y", 12), (2, None, None)]


# pipeline


def test_pipeline(spark, docs, texts):
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    kept = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    predicted = {r.doc_id for r in QUERIES["op7_quality_classifier"](spark, SF).collect() if r.predicted}
    assert kept[1] == predicted
    classes = brute_classes({k: texts[k] for k in kept[1]})
    assert kept[2] == set(classes.values())
    assert kept[3] == kept[4] == kept[2]
    after = {r.doc_id: r for r in seen[3].collect()}
    assert all(not brute_base(r.text) and len(r.text) == r.n_chars for r in after.values())
    check_packing(seen[5].collect(), {r.doc_id: r.text for r in seen[4].collect()})
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32"))) == sorted(
        rows_of(seen[5].select("doc_id", "piece", "length", "ids_crc32"))
    )


def test_shards_follow_the_mix(spark, tmp_path, monkeypatch):
    """Several files between the stages; the readers' order of files must not matter."""
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(20, 300 + i)), "en", "abc"[min(2, i % 7 // 3)], 0) for i in range(1200)]
    made = spark.createDataFrame(rows, DOCUMENTS)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    monkeypatch.setattr(packing, "SHARD_PIECES", 200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_packing(found, {r[0]: r[1] for r in rows})
    position = {r.doc_id: r.position for r in mixing.schedule(made).collect()}
    shards: dict = {}
    for r in found:
        shards.setdefault(r.sequence_id >> 32, []).append(position[r.doc_id])
    edges = [(min(x), max(x)) for _, x in sorted(shards.items())]
    assert len(edges) == 6 and all(a[1] < b[0] for a, b in zip(edges, edges[1:], strict=False))
    places: dict = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append(position[r.doc_id])
    means = [np.mean(x) for _, x in sorted(places.items())]
    assert means == sorted(means)


def test_pipeline_stages_on_edges(spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, edge, SF).count() > 0 and stage(spark, nothing, SF).count() == 0, name
