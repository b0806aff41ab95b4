"""Language identification, conversation repair and the prefix trie: brute force, held-out figures, edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from maskloom.llm import language, repair, trie
from maskloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def odd_turns(spark):
    """NULLs in every column, empty and very long texts, repeated rows, other roles, and columns with clashing names."""
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", None), (1, None, None, "no turn"), (1, 1, "assistant", "x" * 300_000 + "."),
        (2, None, "tool", ""), (2, None, "tool", ""), (3, 5, "", "é🙂!"), (3, 9, "system", "S."), (None, 1, "user", "no id."), (None, None, None, None),
        (4, 0, "user", "same."), (4, 0, "user", "same."), (4, 0, "user", "same."), (100, 0, "user", " \t\n"), (-7, 3, "summary", "a\nb."),
    ]
    df = spark.createDataFrame(rows, TURNS)
    for name in ("place", "audit", "code", "key", "shard", "base", "h", "a", "copy"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="module")
def no_turns(spark):
    return spark.createDataFrame([], TURNS)


# repair


def cheapest(codes):
    """From the last row back: of each state, the least cost and audit of what is left."""
    turns, to = {0: "su", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}
    left = {0: (0, ""), 3: (0, "")}
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            part, fault = "-sua"[codes[i] % 4], codes[i] // 4
            before = {}
            for q in range(4):
                ways = [(left[q][0] + 2, "D" + left[q][1])] if q in left else []
                for turn in turns[q] if fault in (0, 3) else "":
                    if to[turn] in left:
                        cost, audit = left[to[turn]]
                        ways += [(cost + 5 * (fault == 3), "K" + audit)] if turn == part else []
                        ways += [(cost + 1 + 5 * (fault == 3), "R" + audit)] if turn != "s" else []
                if ways:
                    before[q] = min(ways)
            left = before
        for _ in range(4):
            for q in range(4):
                for turn in turns[q].replace("s", ""):
                    if to[turn] in left:
                        cost, audit = left[to[turn]]
                        left[q] = min(left.get(q, (10**9, "")), (cost + 5, "I" + audit))
    return left[0]


def drawn_codes(rng, most):
    some = rng.random()
    return bytes(rng.randint(0, 15) if rng.random() < some else rng.choice([1, 2, 3]) for _ in range(rng.randint(0, most)))


def test_search_equals_brute_force():
    rng = random.Random(3)
    for _ in range(2500):
        codes = drawn_codes(rng, 10)
        assert repair.search(codes, repair.START, repair.ENDS) == cheapest(codes), list(codes)


def test_stretches_equal_one_search(monkeypatch):
    rng = random.Random(4)
    for _ in range(1500):
        codes, at = drawn_codes(rng, 16), 0
        monkeypatch.setattr(repair, "ROWS", rng.randint(1, 5))
        search = repair.Search()
        while at < len(codes):
            step = rng.randint(1, 6)
            search.add(codes[at : at + step])
            at += step
        assert search.result() == cheapest(codes), list(codes)


def brute_repair(rows):
    """The whole contract, a conversation at a time, in plain Python."""
    space, out = " \t\n\x0b\x0c\r", {}
    ids = {r[0] for r in rows}
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        damage = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if damage == 1 else "".join(c for c in text if c not in ".!?") if damage == 2 else text
        kept[conv] += [(turn, "user" if damage == 4 else role, text)] * ((damage != 0) + (damage == 3))
    for conv in ids:
        found = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, codes, faults = set(), [], [0] * 4
        for _, role, text in found:
            body = text.rstrip(space)
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            codes.append(4 * fault + "sua".find(role[:1] or "-") + 1)
        cost, audit = cheapest(codes)
        turns = [t for t, *_ in found if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        said, rest = [], iter(found)
        for letter in audit:
            row = next(rest) if letter != "I" else None
            if letter == "K":
                said.append(f"{row[1]}:{row[2]}")
            elif letter != "D":
                said.append(f"{'assistant' if said and said[-1][0] == 'u' else 'user'}:{row[2] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 40 if conv % 10 == 0 else 7)):
            role = rng.choice(["user", "assistant", "system", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(["One.", "two", "Three!", " ", "", "Four? ", "five.\n"])))
    rows += [(500, 0, "user", "x")] * 2
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows, TURNS).repartition(5)
        found = {r[0]: r[1:] for r in rows_of(repair.summaries(repair.damaged(df), df))}
        assert found == brute_repair(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_conversation_in_stretches(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant"]), f"Turn {i}" + "." * rng.randint(0, 1)) for i in range(3 * repair.ROWS)]
    df = spark.createDataFrame(rows, TURNS)
    assert {r[0]: r[1:] for r in rows_of(repair.summaries(repair.damaged(df), df))} == brute_repair(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (2, 0, "tool", "Out."), (2, 1, "assistant", "In.")]
    found = sorted(rows_of(repair.repaired(spark.createDataFrame(rows, TURNS))))
    assert found == [
        (1, 0, "K", "user", "Again."), (1, 1, "K", "assistant", "Yes."), (2, 0, "R", "user", "Out."), (2, 1, "K", "assistant", "In."),
    ]


def test_repair_edges(odd_turns, no_turns):
    rows = [tuple(r) for r in odd_turns.select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: r[1:] for r in rows_of(repair.summaries(repair.damaged(odd_turns), odd_turns))}
    assert found == brute_repair(rows)
    assert repair.summaries(repair.damaged(no_turns), no_turns).count() == 0
    nothing = {r.conv_id: r for r in repair.summaries(no_turns, odd_turns).collect()}[4]
    assert tuple(nothing)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    paths = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        base = sorted(own.get(conv - int(np.fmod(conv, 100)), []))
        paths[conv] = tuple((r[2], r[4]) for r in base[:h] + sorted(own[conv])[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, some in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(some) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, some in members.items():
        ends = ",".join(map(str, sorted(c for c in some if paths[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(some), len(path), parent, len(some), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("parts", "shard"), [(1, 10**6), (3, 10**6), (9, 40), (40, 10**6), (2, 1)])
def test_trie_equals_brute_force(spark, parts, shard):
    """Prefixes and copies that go on over many shards, at any number of shards."""
    rng, rows = random.Random(parts), []
    for conv in [*range(95, 170), *range(300, 330), 401]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", None]) if rng.random() < 0.1 else "user", rng.choice(["ab", "c", "é🙂"])))
    for conv in range(600, 680):
        rows += [(conv, t, "user", "the same") for t in range(6)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    df = spark.createDataFrame(rows, TURNS)
    found = sorted(rows_of(trie.trie(trie.rebuilt(trie.sequences(df)), shard, 3)), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == brute_trie(rows)


def test_search_tree_is_balanced():
    paths = [[i // 8, i % 8, 5] for i in range(4096)]
    tree = trie.SearchTree(len(paths))
    tree.insert_balanced([(path, i, i + 1) for i, path in enumerate(paths)])

    def height(at):
        return 0 if not at else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.below[0]) <= 10
    order = [tree.past[at] - tree.first[at] for at, _, depth in tree.walk() if depth == 1]
    assert order == [8] * 512


def test_trie_edges(odd_turns, no_turns):
    rows = [tuple(r) for r in odd_turns.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(rows_of(trie.trie(trie.rebuilt(trie.sequences(odd_turns)))), key=repr) == brute_trie(rows)
    assert trie.trie(trie.rebuilt(trie.sequences(no_turns))).count() == 0


# language


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    assert model.families == [["de", "en"], ["es", "fr"]] and len(model.pairs) == 2
    rows = {r.doc_id: r for r in language.identify(docs, model).collect()}
    given = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [doc_id for doc_id in given if zlib.crc32(str(doc_id).encode()) % 3 == 1]
    assert all(rows[i].held_out == (i in set(out)) and 0 <= rows[i].score <= 1 for i in given)
    assert np.mean([rows[i].lang_pred == given[i] for i in out]) > 0.98


def test_languages_are_learned_from_rows_not_held_out(spark):
    rows = [(i, ("ab" if i % 2 else "xy") * 20, ("fr" if i % 2 else "de") if zlib.crc32(str(i).encode()) % 3 != 1 else "zz") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs, language.learn(docs)).collect()
    assert all(r.lang_pred == ("fr" if r.doc_id % 2 else "de") for r in found)
    few = language.learn(docs, rows=3)
    assert few.families == [["de"], ["fr"]] and language.identify(docs, few).filter("lang_pred = 'fr'").count() == 100


def test_margins_equal_sums_over_ngrams(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc éñ!!1 XYZ日") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)] + [b"", b" ", b"a"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts]))
    weights, bias = np.random.default_rng(0).normal(size=(language.BUCKETS, 3)), np.array([0.1, 0.2, 0.3])
    wanted = np.array([(weights[i] * v[:, None]).sum(0) + bias for i, v in map(language.shares, texts)])
    for at_once in (1 << 18, 64, 7, 1):
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        assert np.allclose(language.margins(weights, bias, data, offsets), wanted)


def test_machines_vote_within_the_family():
    """Four languages of one family and one of another; whole texts count, not beginnings."""
    rng = random.Random(2)
    letters = {"en": "abcd", "de": "cdef", "nl": "efgh", "sv": "ghab", "fr": "mnop"}

    def text(lang, n=200):
        return "".join(rng.choice(letters[lang] + " ") for _ in range(n)).encode()

    model = language.fit([text(x) for x in letters for _ in range(20)], [x for x in letters for _ in range(20)])
    assert model.families == [["de", "en", "nl", "sv"], ["fr"]] and len(model.pairs) == 6
    texts = [text(x) for x in letters] + [b"mnop " * 10 + text("nl", 50_000)]
    found, score = model.predict(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts])))
    assert found == [*letters, "nl"] and (score > 0.3).all()


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, source string, lang_pred string, letters string"
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, "12 !? ²", "en", "a"), (None, "the cat and the dog", "en", "a"), (5, "the dog " * 50_000, "en", "a"),
        (6, "日本", None, "a"), (6, "日本", None, "a"), (8, "le chat et le chien", "fr", ""), (9, "der Hund und die Katze", "xx-unknown", "a"),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    found = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert found[None].held_out is False and found[5].lang_pred == "en" and found[6].lang_pred in ("en", "fr", "xx-unknown")
    nothing = spark.createDataFrame([], schema)
    assert language.identify(nothing, language.learn(nothing)).count() == 0
    unknown = language.identify(docs, language.learn(docs.filter("lang IS NULL"))).collect()
    assert len(unknown) == len(rows) and all((r.lang_pred, r.score) == ("und", 0.0) for r in unknown)


@pytest.mark.parametrize("name", ["op11_language_id", "op12_conversation_repair", "op13_conversation_trie"])
def test_query_columns(spark, name):
    df = QUERIES[name](spark, SF)
    firsts = {
        "op11_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op12_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
        "op13_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    }
    assert df.columns == firsts[name] and df.count() > 0
