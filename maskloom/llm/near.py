"""MinHash near-dedup by Order MinHash, verified by banded alignment.

A text is the sequence of its runs of ``SHINGLE`` words. Each of ``SKETCHES`` sketches takes the
``TAKEN`` runs of least hash, where the n-th occurrence of a run is a run of its own, and hashes
them in text order, so texts agree in a sketch if they share runs in the same order.

Texts that agree in a sketch are sorted by their next sketches and each is paired with the
``PARTNERS`` before it. So a group of n texts makes at most n times PARTNERS pairs for each
sketch and no task gathers a group: the sort is by range, which splits a group of any size. Texts
at or above the threshold agree in about half of all sketches, and then in most of the next ones, so they
stand side by side in some of the sorts; a similar pair outside these pairs joins through
the texts between them. These sorts only spare work. What they leave is paired in full: texts of
a sketch that still holds several groups are joined by an exact prefix filter. In one order of all
runs, common ones last, two texts at the threshold share one of the first ``n - ceil(SIMILARITY * n) + 1``
runs of each; runs of many texts are joined in blocks of about ``BLOCK`` against blocks. So two texts at
the threshold that agree in a sketch end in one class, however many texts agree in it.
Every pair is verified: a banded longest common
subsequence of the runs gives ``common / (n + m - common)``, the Jaccard similarity with order,
and pairs at ``SIMILARITY`` or more are links.

``class_id`` is the smallest ``doc_id`` that links and exact copies reach. Exact copies are one text
throughout the search. Texts are told apart by MD5, and texts with a link by 64 bits of it.

Edge cases: NULL is the empty text; texts without a word share one class; texts of under five words are
one run; a NULL id counts as the smallest id and is given back as NULL; repeated rows get equal rows;
an empty table gives none; other columns are not read by ``near_classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import NO_ID, by_slices, components, free_name, stored, text_bytes
from maskloom.llm.words import mix, run_hashes, word_hashes, words_of

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TAKEN, PARTNERS = 16, 3, 3
#: Bits of the counters by which runs are ordered, by the number of runs, of which there is one to about as many
#: characters; runs that share a counter change the work, not the result.
LEAST_BITS, MOST_BITS, RUN_CHARS = 16, 22, 6
#: Texts of a run that one task joins with as many others, and parts by which rows of one run are dealt before.
BLOCK, SALTS = 1000, 64


def shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' runs of words, and each text's first run (one more at the end).

    A text of fewer words is one run of all it has.
    """
    starts, ends, first = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.maximum(1, n - SHINGLE + 1)
    at = np.append(0, np.cumsum(count))
    out = np.empty(at[-1], np.uint64)
    runs = run_hashes(hashes, SHINGLE)
    row = np.repeat(np.arange(len(n)), count)
    place = first[:-1][row] + np.arange(len(row)) - at[:-1][row]
    whole = n[row] >= SHINGLE
    out[whole] = runs[place[whole]]
    for i in np.flatnonzero(n < SHINGLE):
        x = hashes[first[i] : first[i + 1]]
        out[at[i]] = run_hashes(x, len(x))[0] ^ np.uint64(len(x)) if len(x) else 0
    return out, at


def labelled_runs(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the runs, each occurrence of a run in its text another one."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((runs, row))
    again = (runs[order][1:] == runs[order][:-1]) & (row[order][1:] == row[order][:-1])
    place = np.arange(len(runs))
    fresh = np.append(True, ~again) if len(runs) else np.zeros(0, bool)
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    labelled = np.empty_like(runs)
    labelled[order] = mix(runs[order] + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return labelled


def order_sketches(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x sketches."""
    n, most = len(at) - 1, np.uint64(2**64 - 1)
    row = np.repeat(np.arange(n), np.diff(at))
    labelled = labelled_runs(runs, at)
    closed = np.append(runs, np.uint64(0))
    out = np.empty((n, SKETCHES), np.int64)
    for j in range(SKETCHES):
        rank = mix(labelled ^ mix(np.array([j + 1], np.uint64))[0])
        taken = np.full((n, TAKEN), len(runs))
        for i in range(TAKEN):
            least = np.minimum.reduceat(rank, at[:-1])
            found = np.flatnonzero((rank == least[row]) & (rank != most))
            taken[row[found], i] = found
            rank[found] = most
        taken.sort(1)
        key = np.full(n, j + 1, np.uint64)
        for i in range(TAKEN):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + closed[taken[:, i]])
        out[:, j] = key.view(np.int64)
    return out


def banded_common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose matches are at most ``band`` places apart.

    Bits of ``row`` stand for the places of ``a`` within the band around the place in ``b``; a zero is a
    step of the alignment. The band moves on by one bit a place, and the bit that leaves is counted.
    """
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, common, low, n = full, 0, -band, len(a)
    for x in b:
        match = 0
        for i in places.get(x, ()):
            if low <= i < low + width:
                match |= 1 << (i - low)
        if match:
            u = row & match
            row = ((row + u) | (row - u)) & full
        if 0 <= low < n:
            common += not row & 1
        row = row >> 1 | 1 << (width - 1)
        low += 1
    left = max(0, min(n, low + width) - max(low, 0))
    shifted = row >> max(0, -low)
    return common + left - (shifted & ((1 << left) - 1)).bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Jaccard similarity of two sequences of runs, in order; 0 where it is below ``least``."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    need = least / (1 + least) * (len(a) + len(b))
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    x, y = np.unique(a), np.unique(b)
    if len(np.intersect1d(x, y, assume_unique=True)) + len(a) - len(x) < need - 1e-9:
        return 0.0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    same = a[len(a) - n + head :][::-1] == b[len(b) - n + head :][::-1]
    tail = n - head if same.all() else int(same.argmin())
    band = int(len(a) + len(b) - 2 * need) + 1
    common = head + tail + banded_common(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), band)
    return common / (len(a) + len(b) - common) if common >= need - 1e-9 else 0.0


def _keyed(docs: DataFrame) -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.unhex(F.md5(text.cast("binary"))).alias("c"), text.alias("text")]


def _sketches(docs: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = order_sketches(*shingled(*text_bytes(batch.column(2))))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SKETCHES, pa.int32()), pa.array(found.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], ["k", "c", "s"])

    return docs.select(*_keyed(docs)).mapInArrow(by_slices(work, 1 << 20), "k long, c binary, s array<long>")


def _candidates(classes: DataFrame) -> DataFrame:
    """Pairs of texts that stand side by side in the sort of some sketch."""
    at = lambda i: F.get("s", (F.col("j") + i) % SKETCHES)
    buckets = classes.select("k", "c", "s", F.posexplode("s").alias("j", "x")).select(
        F.xxhash64("j", "x").alias("key"), at(1).alias("one"), at(2).alias("two"), "k", "c"
    )
    return _side_by_side(buckets.withColumn("group", F.xxhash64("c")), ["key", "one", "two", "k", "c"])


def _parted(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` is one of texts of several groups, and in how many ``blocks`` these are joined.

    Rows of one value are dealt by text as well, so a value of very many texts is no task's alone.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int"))
    some = rows.groupBy(name, "salt").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("rows"))
    whole = some.groupBy(name).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")).filter("low <> high")
    known = some.select(name, "salt").join(whole.select(name, F.ceil(F.col("rows") / BLOCK).alias("blocks")), name)
    return rows.join(known, [name, "salt"]).drop("salt")


def _left_apart(docs: DataFrame, texts: DataFrame, checked: DataFrame) -> DataFrame:
    """All pairs, not in ``checked``, that can be at the threshold, of texts in different groups that
    stand in sketches of several groups."""
    buckets = texts.select("n", "group", F.posexplode("s").alias("j", "x")).select("n", "group", F.xxhash64("j", "x").alias("key"))
    apart = _parted(buckets, "key").select("n").distinct()
    apart = texts.join(apart, "n").select("k", "c", "n", "group")
    apart = stored(docs.select(*_keyed(docs)).join(apart, ["k", "c"]).dropDuplicates(["n"]).select("n", "group", "text"), "apart")
    postings = stored(_postings(apart), "postings")
    posted = _parted(postings, "mark").withColumn("block", F.pmod(F.xxhash64("n", "mark"), "blocks"))
    side = lambda x: [F.col(c).alias(x + c) for c in ("n", "group", "size", "place")]
    left = posted.select("mark", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"), *side("a_"))
    right = posted.select("mark", F.col("block").alias("high"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("low"), *side("b_"))
    # The places bound what two texts can share from this run on; the first run they share keeps every pair at the threshold.
    found = left.join(right, ["mark", "low", "high"]).filter("a_group <> b_group and (low <> high or a_n < b_n)").filter(
        F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
        >= SIMILARITY / (1 + SIMILARITY) * (F.col("a_size") + F.col("b_size")) - 1e-6
    )
    found = found.select(F.least("a_n", "b_n").alias("x"), F.greatest("a_n", "b_n").alias("y")).distinct()
    one = texts.select(F.col("n").alias("x"), F.struct("k", "c").alias("p"))
    two = texts.select(F.col("n").alias("y"), F.struct("k", "c").alias("q"))
    found = found.join(one, "x").join(two, "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return _ends(found).join(checked, ["ak", "ac", "bk", "bc"], "left_anti")


def _postings(apart: DataFrame) -> DataFrame:
    """``mark, n, group, size, place``: the runs of each text of which two texts at the threshold share one."""
    chars = apart.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(chars // RUN_CHARS).bit_length() + 1))
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            np.add.at(counts, (labelled_runs(*shingled(*text_bytes(batch.column(0)))) >> shift).astype(np.int64), 1)
            return batch

        for _ in by_slices(work, 1 << 20)(batches):
            pass
        some = np.flatnonzero(counts)
        yield from pa.table([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["counter", "seen"]).to_batches(1 << 16)

    # Only the order of runs is wanted: a byte for each counter, four steps to a doubling.
    total = apart.select("text").mapInArrow(count, "counter int, seen long").groupBy("counter").agg(F.sum("seen").alias("seen"))
    total = total.select("counter", F.least(F.floor(4 * F.log2("seen")), F.lit(127)).cast("tinyint").alias("seen")).toArrow()
    counts = np.full(1 << bits, -1, np.int8)
    counts[total["counter"].to_numpy()] = total["seen"].to_numpy()
    shared = apart.sparkSession.sparkContext.broadcast(counts)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, at = shingled(*text_bytes(batch.column(2)))
        marks, size = labelled_runs(runs, at), np.diff(at)
        row = np.repeat(np.arange(len(size)), size)
        marks = marks[np.lexsort((marks, shared.value[(marks >> shift).astype(np.int64)], row))]
        place = np.arange(len(marks)) - at[:-1][row]
        first = place < (size - np.ceil(SIMILARITY * size - 1e-6) + 1)[row]
        of = pa.array(row[first])
        columns = [pa.array(marks[first].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of)]
        columns += [pa.array(size[row[first]].astype(np.int32)), pa.array(place[first].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["mark", "n", "group", "size", "place"])

    return apart.mapInArrow(by_slices(work, 1 << 20), "mark long, n long, group long, size int, place int")


def _side_by_side(buckets: DataFrame, order: list[str]) -> DataFrame:
    """Pairs of texts of different groups that are close in the sort of their bucket.

    Of rows of one group on end, only the first and the last can meet another group.
    """
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "k", "c", "group")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*last, batch]).combine_chunks()
            old = sum(b.num_rows for b in last)
            key, group = rows["key"].to_numpy(), rows["group"].to_numpy()
            same = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
            inner = np.append(False, same) & np.append(same, False)
            inner[:old] = False
            rows, key, group = rows.filter(pa.array(~inner)), key[~inner], group[~inner]
            for step in range(1, PARTNERS + 1):
                b = np.flatnonzero((key[step:] == key[:-step]) & (group[step:] != group[:-step])) + step
                b = b[b >= old]
                left, right = rows.take(b - step), rows.take(b)
                columns = [left["k"], left["c"], right["k"], right["c"]]
                yield from pa.table(columns, ["ak", "ac", "bk", "bc"]).to_batches()
            last = rows.slice(max(0, rows.num_rows - PARTNERS)).to_batches()

    found = buckets.mapInArrow(pairs, "ak long, ac binary, bk long, bc binary")
    a, b = F.struct(F.col("ak").alias("k"), F.col("ac").alias("c")), F.struct(F.col("bk").alias("k"), F.col("bc").alias("c"))
    return _ends(found.filter("ac <> bc").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a.k").alias("ak"), F.col("a.c").alias("ac"), F.col("b.k").alias("bk"), F.col("b.c").alias("bc"))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b``: 64 bits of the texts' MD5 of every pair at the threshold."""
    texts = docs.select(*_keyed(docs)).dropDuplicates(["k", "c"])
    left = pairs.join(texts, (F.col("ak") == F.col("k")) & (F.col("ac") == F.col("c"))).select(
        "ac", F.col("bk").alias("pk"), F.col("bc").alias("pc"), F.col("text").alias("a_text")
    )
    both = left.join(texts, (F.col("pk") == F.col("k")) & (F.col("pc") == F.col("c"))).select(
        F.xxhash64("ac").alias("a"), F.xxhash64("pc").alias("b"), "a_text", F.col("text").alias("b_text")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs_a, at_a = shingled(*text_bytes(batch.column(2)))
        runs_b, at_b = shingled(*text_bytes(batch.column(3)))
        near = [
            similarity(runs_a[at_a[i] : at_a[i + 1]], runs_b[at_b[i] : at_b[i + 1]]) >= SIMILARITY
            for i in range(batch.num_rows)
        ]
        mask = pa.array(near, pa.bool_())
        return pa.RecordBatch.from_arrays([pc.filter(batch.column(0), mask), pc.filter(batch.column(1), mask)], ["a", "b"])

    return both.mapInArrow(by_slices(work, 1 << 20, "a_text"), "a long, b long")


def _in_groups(texts: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links, "a", "b")
    return texts.join(found, texts.n == found.node, "left").withColumn("group", F.coalesce("component", "n"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k, c`` of every row; and for every text ``c, rep, rep_c, copies`` of its group's first row."""
    rows = stored(_sketches(docs), "sketches")
    texts = rows.groupBy("c", "k").agg(F.count("*").alias("copies"), F.first("s").alias("s"))
    texts = texts.groupBy("c").agg(F.min(F.struct("k", "copies")).alias("x"), F.first("s").alias("s"))
    texts = stored(texts.select("c", "x.k", "x.copies", "s"), "texts")
    checked = stored(_candidates(texts), "pairs")
    links = stored(_verified(docs, checked), "links")
    texts = texts.withColumn("n", F.xxhash64("c"))
    node = _in_groups(texts, links)
    more = stored(_verified(docs, stored(_left_apart(docs, node, checked), "pairs")), "links")
    if not more.isEmpty():
        one, two = (node.select(F.col("n").alias(x), F.col("group").alias(f"{x}_group")) for x in ("a", "b"))
        apart = more.join(one, "a").join(two, "b").select("a_group", "b_group").distinct()
        found = components(apart, "a_group", "b_group")
        node = node.drop("node", "component").join(found, node.group == found.node, "left").withColumn("group", F.coalesce("component", "group"))
    node = node.select("c", "k", "copies", "group")
    first = node.groupBy("group").agg(F.min(F.struct("k", "c", "copies")).alias("first"))
    node = node.select("c", "group").join(first, "group").select(
        "c", F.col("first.k").alias("rep"), F.col("first.c").alias("rep_c"), F.col("first.copies").alias("copies")
    )
    return rows.select("k", "c"), stored(node, "groups")


def _id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID))


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept`` of every row; ``kept`` marks the row that gives the class its id."""
    rows, groups = _grouped(docs)
    joined = rows.join(groups, "c")
    return joined.select(
        _id("k").alias("doc_id"), _id("rep").alias("class_id"), ((F.col("k") == F.col("rep")) & (F.col("c") == F.col("rep_c"))).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: of the rows of least id, any one."""
    _, groups = _grouped(docs)
    kept = groups.filter(F.col("c") == F.col("rep_c")).select(
        F.col("rep").alias("near_k"), F.col("c").alias("near_c"), F.col("copies").alias("near_copies")
    )
    k, c = free_name(docs, "near_own_k"), free_name(docs, "near_own_c")
    own = docs.withColumns({k: _keyed(docs)[0], c: _keyed(docs)[1]})
    names = {x: free_name(own, x) for x in kept.columns}
    kept = kept.withColumnsRenamed(names)
    joined = own.join(kept, (own[k] == kept[names["near_k"]]) & (own[c] == kept[names["near_c"]]))
    if groups.filter((F.col("c") == F.col("rep_c")) & (F.col("copies") > 1)).isEmpty():
        return joined.select(*[F.col(f"`{x}`") for x in docs.columns])
    several = F.col(names["near_copies"]) > 1
    joined = joined.filter(~several).unionAll(joined.filter(several).dropDuplicates([k, c]))
    return joined.select(*[F.col(f"`{x}`") for x in docs.columns])
