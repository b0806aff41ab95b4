"""Substring dedup: suffix automata over shards of reference text, matched by streamed documents.

A window is ``WINDOW`` consecutive words of one document. Words that a window covers are removed if the
same words also start earlier: in a document of smaller id, or earlier in the same document.

To broadcast automata of the whole corpus to every document would cost documents times shards, so both
are routed. The least hash among a window's runs of ``ANCHOR`` words is its anchor; equal windows have
equal anchors at equal places. The windows that share one occurrence of an anchor make a segment (20 to
34 words), and only segments with the same anchor can repeat each other's windows:

1. Segments are sorted by anchor and content. A segment that follows an equal one repeats it whole. Sorting
   by range splits an anchor of any frequency over tasks.
2. The first of equal segments is open where its anchor has other segments too. Those are
   the reference: shards of whole anchors, each with an automaton of its segments in document
   order. Every segment is streamed through the automaton of the earlier ones for its matching
   statistics, and then added to it: where at least ``WINDOW`` words match, the window repeats.
3. An anchor of more than ``HOT`` open segments (a line that many documents share) is not gathered: its
   windows are compared by their hashes, with a minimum for each hash before the shuffle's end.

All spans come back to their documents, and ``kept_sha256`` is taken of the words that are left.
Runs of words are told apart by 64 bits of hash in steps 1 and 3, words in step 2.

Edge cases: NULL texts have no words; documents of under ``WINDOW`` words lose none; a NULL id
counts as the smallest and is given back as NULL; equal rows are one document, whose windows
don't repeat each other, and each of them gets a row; rows of one id and different texts are parts of
one document, and among equal starts the smaller hash of the text is the earlier; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from maskloom.llm.common import NO_ID, by_slices, stored, text_bytes
from maskloom.llm.words import _powers, mix, run_hashes, word_hashes, words_of

WINDOW, ANCHOR = 20, 6
#: Open segments of an anchor beyond which its windows are compared by hash.
HOT = 2000
#: Open segments of a shard, which bounds an automaton task's memory.
SHARD_SEGMENTS = 20_000


def segments(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, start, windows, anchor, content`` of all segments; ``first`` is each text's first word."""
    runs = WINDOW - ANCHOR + 1
    if len(words) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    low = mix(run_hashes(words, ANCHOR) ^ np.uint64(0x5851F42D4C957F2D))
    at = np.arange(len(low))
    width = 1
    while width < runs:  # the leftmost least hash of windows of 2, 4, 8 and then 15 runs
        step = min(width, runs - width)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    count = np.diff(first)
    has = np.flatnonzero(count >= WINDOW)
    windows = count[has] - WINDOW + 1
    row = np.repeat(has, windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + first[row]
    anchor_at = at[place]
    new = np.ones(len(row), bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(row)))
    start = place[head]
    up, down = _powers(1 << max(16, int(len(words)).bit_length()))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    content = mix((total[start + n + WINDOW - 1] - total[start]) * down[start] + n.astype(np.uint64))
    content ^= mix((anchor_at[head] - start).astype(np.uint64))
    return row[head], start - first[row[head]], n, low[place[head]].view(np.int64), content.view(np.int64)


class Automaton:
    """Suffix automaton of several sequences, extended online."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def matches(self, words: list[int]) -> list[int]:
        """For each place, how many words up to it stand in the sequences added so far."""
        following, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for w in words:
            while state and w not in following[state]:
                state = link[state]
                length = size[state]
            if w in following[state]:
                state = following[state][w]
                length += 1
            out.append(length)
        return out

    def _copy(self, p: int, q: int, w: int) -> int:
        """A state for the shorter strings of ``q`` that follow ``p`` by ``w``."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        following, link, size = self.next, self.link, self.size
        last = 0
        for w in words:
            q = following[last].get(w)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._copy(last, q, w)
                continue
            new = len(following)
            following.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and w not in following[p]:
                following[p][w] = new
                p = link[p]
            if p >= 0:
                q = following[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._copy(p, q, w)
            last = new


def repeated_windows(sequences: list[list[int]]) -> list[list[int]]:
    """For each sequence, the starts of its windows that stand in an earlier sequence."""
    automaton, out = Automaton(), []
    for i, words in enumerate(sequences):
        found = automaton.matches(words) if i else []
        out.append([at - WINDOW + 1 for at, n in enumerate(found) if n >= WINDOW])
        if i + 1 < len(sequences):
            automaton.add(words)
    return out


def _documents(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``k``, ``c`` and ``text``, and the columns that tell documents apart."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("c"), text.alias("text"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return rows, ["k"] if again.isEmpty() else ["k", "c"]


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends, first = words_of(data, offsets)
    return word_hashes(data, starts, ends), first


def _sorted_segments(rows: DataFrame, keys: list[str]) -> DataFrame:
    width = len(keys)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, n, anchor, content = segments(*_hashed(batch.column(width)))
        index = pa.array(row)
        columns = [pa.array(anchor), pa.array(content), *(batch.column(i).take(index) for i in range(width))]
        columns += [pa.array(start, pa.int32()), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["v", "s", *keys, "start", "n"])

    schema = "v long, s long, " + ", ".join(f"{x} long" for x in keys) + ", start int, n int"
    found = rows.select(*keys, "text").mapInArrow(by_slices(work, 1 << 20), schema)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["v", "s", "k", "start", *keys[1:]]
    return found.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _compared(found: DataFrame) -> DataFrame:
    """The sorted segments that repeat an equal one (``open`` false), and the open ones.

    What stands at either end of a partition is open in any case, as its neighbour is not seen.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int] | None = None
        held: pa.Table | None = None  # the last head so far, and whether it is open
        held_open = True

        def given(table: pa.Table, is_open: bool) -> list[pa.RecordBatch]:
            return table.append_column("open", pa.array([is_open] * table.num_rows, pa.bool_())).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            v, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            again = np.zeros(len(v), bool)
            again[1:] = (v[1:] == v[:-1]) & (s[1:] == s[:-1])
            again[0] = before == (v[0], s[0])
            before = (v[-1], s[-1])
            yield from given(table.filter(pa.array(again)), False)
            heads = table.filter(pa.array(~again))
            if held is not None:
                heads = pa.concat_tables([held, heads])
            hv = heads["v"].to_numpy()
            near = np.zeros(len(hv), bool)
            near[1:] |= hv[1:] == hv[:-1]
            near[:-1] |= hv[1:] == hv[:-1]
            if len(hv):
                near[0] |= held_open
                yield from given(heads.slice(0, len(hv) - 1).filter(pa.array(near[:-1])), True)
                held, held_open = heads.slice(len(hv) - 1), bool(near[-1])
        if held is not None:
            yield from given(held, True)

    return found.mapInArrow(work, StructType([*found.schema.fields, StructField("open", BooleanType())]))


def _open_words(rows: DataFrame, keys: list[str], opened: DataFrame) -> DataFrame:
    """``v, keys, start, n, words`` of open segments; of hot anchors, a row for each window, without words."""
    hot = opened.groupBy("v").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("v", F.lit(True).alias("hot"))
    listed = opened.join(hot, "v", "left").groupBy(*keys).agg(F.collect_list(F.struct("v", "start", "n", "hot")).alias("x"))
    joined = rows.join(listed.withColumnsRenamed({x: f"o_{x}" for x in keys}), [rows[x] == F.col(f"o_{x}") for x in keys]).select(*keys, "text", "x")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, first = _hashed(batch.column(len(keys)))
        full = run_hashes(words, WINDOW).view(np.int64)
        own = [batch.column(i).to_pylist() for i in range(len(keys))]
        out: list[tuple] = []
        for i, found in enumerate(batch.column(len(keys) + 1).to_pylist()):
            key = tuple(x[i] for x in own)
            for x in found:
                at = int(first[i]) + x["start"]
                if x["hot"]:
                    out += [(int(full[at + w]), *key, x["start"] + w, 1, None) for w in range(x["n"])]
                else:
                    out.append((x["v"], *key, x["start"], x["n"], words[at : at + x["n"] + WINDOW - 1].tobytes()))
        kinds = [pa.int64()] * (1 + len(keys)) + [pa.int32(), pa.int32(), pa.binary()]
        names = ["v", *keys, "start", "n", "words"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    schema = "v long, " + ", ".join(f"{x} long" for x in keys) + ", start int, n int, words binary"
    return joined.mapInArrow(by_slices(work, 1 << 20), schema)


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The documents' rows, and ``keys, start, n``: runs of ``n`` windows from ``start`` on that repeat earlier ones."""
    rows, keys = _documents(docs)
    once = rows if len(keys) == 1 else rows.dropDuplicates(keys)
    found = stored(_compared(_sorted_segments(once, keys)).select("v", *keys, "start", "n", "open"), "segments")
    opened = found.filter("open").drop("open")
    words = stored(_open_words(once, keys, opened), "words")
    shards = max(1, -(-words.filter("words IS NOT NULL").count() // SHARD_SEGMENTS))

    def match(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([(x, "ascending") for x in ("v", "k", "start", *keys[1:])]).combine_chunks()
        v, texts = shard["v"].to_numpy(), shard["words"].to_pylist()
        edges = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        at, windows = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                for i, starts in enumerate(repeated_windows([np.frombuffer(t, np.uint64).tolist() for t in texts[a:b]])):
                    at += [a + i] * len(starts)
                    windows += starts
        index = pa.array(at, pa.int64())
        columns = {x: shard[x].take(index) for x in keys}
        start = pa.compute.add(shard["start"].take(index), pa.array(windows, pa.int32()))
        return pa.table({**columns, "start": start.cast(pa.int32()), "n": pa.array([1] * len(at), pa.int32())})

    names = ", ".join(f"{x} long" for x in keys)
    open_repeats = words.filter("words IS NOT NULL").withColumn("shard", F.pmod("v", F.lit(shards)))
    open_repeats = open_repeats.groupBy("shard").applyInArrow(match, f"{names}, start int, n int")
    hot = words.filter("words IS NULL").select("v", *keys, "start")
    place = F.struct("k", "start", *keys[1:])
    least = hot.groupBy("v").agg(F.min(place).alias("least"), F.count("*").alias("m")).filter("m > 1").select(F.col("v").alias("w"), "least")
    hot_repeats = hot.join(least, hot.v == least.w).filter(place != F.col("least")).select(*keys, "start", F.lit(1).alias("n"))
    whole = found.filter("NOT open").select(*keys, "start", "n")
    return rows, whole.unionAll(open_repeats).unionAll(hot_repeats), keys


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) of every row."""
    rows, spans, keys = repeats(docs)
    listed = spans.groupBy(*keys).agg(F.collect_list(F.col("start").cast("long") * (WINDOW + 1) + F.col("n")).alias("x"))
    joined = rows.join(listed.withColumnsRenamed({x: f"o_{x}" for x in keys}), [rows[x] == F.col(f"o_{x}") for x in keys], "left")
    joined = joined.select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "text", "x")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, sha, texts = [], [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = text.encode().split()
            total.append(len(words))
            removed.append(0)
            if found.is_valid and len(found.values):
                start, n = np.divmod(found.values.to_numpy(), WINDOW + 1)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n + WINDOW - 1, -1)
                keep = np.cumsum(cover[:-1]) == 0
                words = [words[i] for i in np.flatnonzero(keep)]
                removed[-1] = int(len(keep) - keep.sum())
            kept = b" ".join(words)
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("kept_text")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(by_slices(work), schema)
