"""Conversation prefix trie: ternary search trees over turn ids, one for each range of conversations.

A conversation is the sequence of its turns, a turn is known by a digest of role and text. Conversations
are sorted by their sequences (then by id) and dealt by range. A shard, at most ``SHARD_TURNS`` turns of a
range, gives its turns dense ids in the order of their digests and puts its different sequences into a
ternary search tree, the median first, then the medians of both halves, so the tree is balanced. An iterative
traversal gives each prefix its members, children, leaves and savings within the shard.

Only prefixes of a shard's first or last sequence can go on in other shards. They are merged over shards by
a digest of the prefix: members and the rest add up, and what shards counted twice is taken back from the
prefix and those above it. So a shared first turn, or a conversation with very many copies, is spread over
as many shards as its rows need; no task gathers it. A prefix is hashed over the ids of the conversations that
end there: within a shard at once, over shards from strings of up to ``PIECE`` ids which pass in order.

Edge cases: turns come in order, NULLs first, then by role and digest; a NULL role or text is empty; rows
without ``conv_id`` belong to no conversation and are left out; repeated rows are turns like any other; an empty
table gives no rows, not even a root; other columns are not read. A conversation's digests are one row, so
that row grows by 32 bytes for each of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import stored

#: Hexadecimal characters of a turn's digest.
WIDTH = 32
SHARD_TURNS = 1_000_000
#: Ids of one string of a prefix that several shards may share.
PIECE = 4096
#: A conversation takes at most this many turns less one from the first one of its hundred.
HEADS, HUNDRED = 6, 100

_TURNS = "array<struct<digest: string, chars: long>>"


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as digest and number of code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("x"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("conv_id", F.transform("x", lambda x: F.struct(x["digest"], x["chars"])).cast(_TURNS).alias("turns"))


def rebuilt(given: DataFrame) -> DataFrame:
    """``conv_id, turns``, where the first ``crc32(conv_id) % 6`` turns are those of the conversation
    ``conv_id - conv_id % 100``: all if it has fewer, none if it is not there."""
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    heads = given.filter(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    own = given.select("conv_id", "turns", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(_TURNS))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


class SearchTree:
    """A ternary search tree of sequences of ids; node 0 is the root of the trie, without an id.

    ``low``, ``high`` and ``below`` are the links of a node, 0 for none. ``first`` and ``past`` are the
    members of a prefix: rows of the sorted shard. ``ends`` are those among them that end there.
    """

    def __init__(self, rows: int) -> None:
        self.id, self.low, self.high, self.below = [-1], [0], [0], [0]
        self.first, self.past, self.ends = [0], [rows], [(0, 0)]

    def _node(self, turn: int) -> int:
        for links in (self.low, self.high, self.below):
            links.append(0)
        self.id.append(turn)
        self.first.append(-1)
        self.past.append(-1)
        self.ends.append((0, 0))
        return len(self.id) - 1

    def insert(self, turns: list[int], first: int, past: int) -> None:
        at = 0
        for turn in turns:
            links, last = self.below, at
            at = links[last]
            while at and self.id[at] != turn:
                links, last = (self.low if turn < self.id[at] else self.high), at
                at = links[last]
            if not at:
                at = links[last] = self._node(turn)
            self.first[at] = first if self.first[at] < 0 else min(self.first[at], first)
            self.past[at] = max(self.past[at], past)
        self.ends[at] = (first, past)

    def insert_balanced(self, sorted_sequences: list[tuple[list[int], int, int]]) -> None:
        """Put in the median, then the medians of both halves."""
        halves = [(0, len(sorted_sequences))]
        while halves:
            a, b = halves.pop()
            if a < b:
                middle = (a + b) // 2
                self.insert(*sorted_sequences[middle])
                halves += [(middle + 1, b), (a, middle)]

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """Node, parent and depth of each prefix, parents first."""
        yield 0, -1, 0
        open_ = [(self.below[0], 0, 1)]
        while open_:
            at, parent, depth = open_.pop()
            if at:
                yield at, parent, depth
                open_ += [(self.low[at], parent, depth), (self.high[at], parent, depth), (self.below[at], at, depth + 1)]


_NODES = (
    "shard long, conv_id long, depth long, parent_conv_id long, key string, parent_key string, last boolean, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, chars long, childless boolean, ends_sha256 string, first_end long, piece string"
)
_NAMES = [x.split()[0] for x in _NODES.split(", ")]


def _listed(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def shard_rows(paths: list[str], ids: list[int], chars: list[list[int]], shard: int, piece: int = PIECE) -> dict[str, list]:
    """All prefixes of a shard; ``paths`` are sorted, and ``ids`` are within equal paths.

    Prefixes of the first and the last path have a ``key``; the ids that end there follow in pieces.
    """
    turns = [[path[i : i + WIDTH] for i in range(0, len(path), WIDTH)] for path in paths]
    number = {digest: i for i, digest in enumerate(sorted({digest for path in turns for digest in path}))}
    starts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
    tree = SearchTree(len(paths))
    tree.insert_balanced([([number[x] for x in turns[a]], a, b) for a, b in zip(starts, [*starts[1:], len(paths)], strict=True)])

    nodes = list(tree.walk())
    size = len(tree.id)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for at, parent, depth in reversed(nodes):
        leaves[at] += not tree.below[at]
        if depth:
            saved[at] += (tree.past[at] - tree.first[at] - 1) * chars[tree.first[at]][depth - 1]
            children[parent] += 1
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]

    edges: tuple[list[str], list[str]] = ([], [])
    for keys, path in zip(edges, (paths[0], paths[-1]), strict=True):
        digest = hashlib.md5()
        keys.append(digest.hexdigest())
        for i in range(0, len(path), WIDTH):
            digest.update(path[i : i + WIDTH].encode())
            keys.append(digest.hexdigest())
    # The least id of each prefix, from its children and its own ends.
    least: list[int | None] = [None] * size
    for at, parent, _ in reversed(nodes):
        a, b = tree.ends[at]
        if a < b:
            least[at] = ids[a] if least[at] is None else min(least[at], ids[a])
        if parent >= 0:
            least[parent] = least[at] if least[parent] is None else min(least[parent], least[at])

    out: dict[str, list] = {name: [] for name in _NAMES}

    def put(**row) -> None:
        for name in _NAMES:
            out[name].append(row.get(name))

    key_of: dict[int, str] = {}
    for at, parent, depth in nodes:
        last = tree.past[at] == len(paths)
        if last or tree.first[at] == 0:
            key_of[at] = edges[last][depth]
        key, (a, b) = key_of.get(at), tree.ends[at]
        put(
            shard=shard, conv_id=least[at], depth=depth, parent_conv_id=least[parent] if depth else None, key=key,
            parent_key=key_of.get(parent), last=last, n_convs=tree.past[at] - tree.first[at], n_children=children[at],
            n_leaves=leaves[at], saved_tokens=saved[at], chars=chars[tree.first[at]][depth - 1] if depth else 0,
            childless=not tree.below[at], ends_sha256=None if key else hashlib.sha256(_listed(ids[a:b]).encode()).hexdigest(),
        )
        if key:
            for i in range(a, b, piece):
                put(shard=shard, key=key, first_end=ids[i], piece=_listed(ids[i : min(i + piece, b)]))
    return out


def _shards(batches: Iterator[pa.RecordBatch], most: int, piece: int) -> Iterator[pa.RecordBatch]:
    types = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _NODES.split(", ")])
    paths: list[str] = []
    ids: list[int] = []
    chars: list[list[int]] = []
    held, number, part = 0, 0, 0

    def done() -> Iterator[pa.RecordBatch]:
        rows = shard_rows(paths, ids, chars, (part << 32) + number, piece)
        yield from pa.table([pa.array(rows[f.name], f.type) for f in schema], schema=schema).to_batches(1 << 14)

    for batch in batches:
        for part, conv_id, path, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held + len(counts) > most and paths:
                yield from done()
                paths, ids, chars, held, number = [], [], [], 0, number + 1
            paths.append(path)
            ids.append(conv_id)
            chars.append(counts)
            held += len(counts)
    if paths:
        yield from done()


def _ends(pieces: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the pieces of a prefix pass in order through one hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, past = None, hashlib.sha256(), False
        for batch in batches:
            out = []
            for found, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found != key:
                    if past:
                        out.append((key, digest.hexdigest()))
                    key, digest = found, hashlib.sha256(piece.encode())
                    past = True
                else:
                    digest.update(f",{piece}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["key", "ends_sha256"])
        if past:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    rows = pieces.repartition("key").sortWithinPartitions("key", "first_end").select("key", "piece")
    return rows.mapInArrow(hashed, "key string, ends_sha256 string")


def _merged(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """The prefixes at the borders of shards: one row each, with the counts of all shards."""
    total = lambda name: F.sum(name).alias(name)
    one = lambda name: F.min(name).alias(name)
    edge = nodes.filter("key is not null")
    all_shards = edge.groupBy("key").agg(
        F.count("*").alias("shards"), F.sum(F.col("childless").cast("long")).alias("bare"), F.min("shard").alias("owner"),
        *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens")), *map(one, ("conv_id", "depth", "parent_key", "chars")),
    )
    all_shards = stored(all_shards, "edges")
    shared = all_shards.filter("shards > 1")
    # What was counted in each shard and is one thing: a shared prefix without children, a saving, a child.
    leaves = F.when(F.col("bare") == F.col("shards"), 1 - F.col("bare")).otherwise(-F.col("bare"))
    twice = shared.select("key", "depth", "owner", leaves.alias("leaves"), ((F.col("shards") - 1) * F.col("chars")).alias("saved"))
    # A prefix goes on from the first shard it is in, so it lies on that shard's last path, like all above it.
    paths = edge.filter("last").select("shard", "key").join(twice, "key")
    up = Window.partitionBy("shard").orderBy(F.desc("depth"))
    own = lambda name: F.sum(F.when(F.col("owner") == F.col("shard"), F.col(name)).otherwise(0)).over(up).alias(name)
    fixes = paths.select("key", own("leaves"), own("saved")).groupBy("key").agg(total("leaves"), total("saved"))
    fewer = shared.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.sum(F.col("shards") - 1).alias("fewer"))
    parents = all_shards.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    added = lambda name, by: (F.col(name) + F.coalesce(F.col(by), F.lit(0))).alias(name)
    nothing = hashlib.sha256(b"").hexdigest()
    out = all_shards.join(fixes, "key", "left").join(fewer, "key", "left").join(_ends(pieces), "key", "left").join(parents, "parent_key", "left")
    return out.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") - F.coalesce("fewer", F.lit(0))).alias("n_children"),
        added("n_leaves", "leaves"), added("saved_tokens", "saved"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(given: DataFrame, shard_turns: int = SHARD_TURNS, piece: int = PIECE) -> DataFrame:
    """Every prefix of the sequences in ``conv_id, turns``; a prefix is named by its least member and depth."""
    listed = F.transform("turns", lambda x: x["digest"])
    rows = stored(given.select("conv_id", F.array_join(listed, "").alias("path"), F.transform("turns", lambda x: x["chars"]).alias("chars")), "sequences")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = rows.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "path", "chars")
    found = stored(rows.mapInArrow(lambda batches: _shards(batches, shard_turns, piece), _NODES), "prefixes")
    nodes = found.filter("piece is null")
    edges = _merged(nodes, found.filter("piece is not null"))
    inner = nodes.filter("key is null")
    # A prefix below one at a border asks, in its shard, for that one's least member over all shards.
    known = nodes.filter("key is not null").select("shard", "key").join(edges.select("key", F.col("conv_id").alias("least")), "key")
    below = inner.filter("parent_key is not null").drop("parent_conv_id").join(known.withColumnRenamed("key", "parent_key"), ["shard", "parent_key"])
    below = below.withColumnRenamed("least", "parent_conv_id").select(*COLUMNS)
    return edges.select(*COLUMNS).unionAll(inner.filter("parent_key is null").select(*COLUMNS)).unionAll(below)
