"""Embedding near-dedup: an exact metric range join of vectors by cosine.

A cosine of at least ``least`` is a distance of at most ``r = sqrt(2 - 2 * least)`` between unit
vectors. Equal unit vectors are one vector with a count. Pivots, taken from the vectors, partition
them: each vector's home is the cell of its nearest pivot. A vector is copied to a cell of lower number
only if the triangle inequality lets that cell hold a vector within ``r`` of it: its distance to the
cell's pivot is at most the cell's radius plus ``r``, and it is at most ``r`` beyond each of the planes
that part the cell from the other cells. Cells are joined independently of each other, in tiles of at
most ``TILE`` rows a side, so that neither a cell nor a group of near copies meets in one task; a
tile gives one row for each of its linked vectors (how many it has found, and the group it is in), never the pairs.

The partition prunes as far as the vectors cluster. In many dimensions without clusters all vectors
are nearly equally far from each other, no exact partition can part them, and the join approaches
all pairs (in blocks).

Edge cases: vectors that are NULL, empty, zero, or hold NULL, NaN or infinite components link with
nothing; vectors of different length don't link; a NULL id counts as the smallest and is given back
as NULL; rows that repeat an id are vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import NO_ID, components, stored

LEAST = 0.95
#: Vectors of a cell on average, and the most pivots (they are broadcast; larger cells have more tiles).
CELL, PIVOTS = 4096, 4096
TILE = 4096
_SLACK = 1e-9


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Each row's unit vector as doubles; None for what links with nothing."""
    out: list[bytes | None] = []
    for row in column:
        if not row.is_valid or not len(row.values) or row.values.null_count:
            out.append(None)
            continue
        v = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        v = v / top  # no overflow or underflow in the squares
        out.append((v / np.sqrt((v * v).sum()) + 0.0).tobytes())
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


class Cells:
    """The pivots of one dimension; ``radius`` by cell once it is known."""

    def __init__(self, pivots: np.ndarray, r: float) -> None:
        self.pivots, self.r = pivots, r
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))
        self.radius = np.full(len(pivots), np.inf)

    def squares(self, v: np.ndarray) -> np.ndarray:
        return np.maximum(2 - 2 * v @ self.pivots.T, 0)

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.squares(v)
        home = d.argmin(1)
        return home, np.sqrt(d[np.arange(len(v)), home])

    def reached(self, v: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Vectors x cells: which cells of lower number may hold a vector within ``r``."""
        d = self.squares(v)
        near = (np.arange(len(self.pivots)) < home[:, None]) & (np.sqrt(d) <= self.radius + self.r + _SLACK)
        for row, cell in zip(*np.nonzero(near), strict=True):
            beyond = (d[row, cell] - d[row]) / (2 * self.apart[cell])
            near[row, cell] = beyond.max() <= self.r + _SLACK
        return near


class OneCell(Cells):
    """All vectors of a length that the sample of pivots has missed: they are at home in one cell."""

    def __init__(self, r: float) -> None:
        super().__init__(np.zeros((1, 0)), r)

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(v), np.int64), np.zeros(len(v))

    def reached(self, v: np.ndarray, home: np.ndarray) -> np.ndarray:
        return np.zeros((len(v), 1), bool)


def linked(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of all pairs at the threshold, sorted; of one side with itself, each pair once."""
    left, right = [], []
    for i in range(0, len(a), 1024):
        x, y = np.nonzero(a[i : i + 1024] @ b.T >= least)
        if same:
            x, y = x[y > x + i], y[y > x + i]
        left.append(x + i)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, least: float = LEAST, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark, r = vectors.sparkSession, float(np.sqrt(2 - 2 * least))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit_vectors(batch.column(1)), pa.binary())], ["k", "u"])

    k = F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("k")
    rows = vectors.select(k, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(units, "k long, u binary")
    rows = stored(rows.withColumn("node", F.when(F.col("u").isNotNull(), F.xxhash64("u"))), "vectors")
    distinct = rows.filter("node IS NOT NULL").groupBy("node", "u").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    distinct = stored(distinct, "distinct")

    count = distinct.count()
    sample = distinct.orderBy(F.xxhash64(F.lit(5), "node")).limit(min(PIVOTS, -(-count // cell)) or 1)
    by_size: dict[int, list[bytes]] = {}
    for x in sample.collect():
        by_size.setdefault(len(x.u), []).append(bytes(x.u))
    cells = {size: Cells(np.frombuffer(b"".join(p), np.float64).reshape(len(p), -1), r) for size, p in by_size.items()}
    # One row for each length of vectors.
    for x in distinct.select(F.octet_length("u").alias("size")).distinct().collect():
        cells.setdefault(x["size"], OneCell(r))

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        sizes = np.array([len(u) for u in batch.column("u").to_pylist()])
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            yield size, part, _matrix(part.column("u"))

    shared = spark.sparkContext.broadcast(cells)

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, v in by_length(batch):
                home, d = shared.value[size].homes(v)
                found, at = np.unique(home, return_inverse=True)
                far = np.zeros(len(found))
                np.maximum.at(far, at, d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array(far), pa.array(np.bincount(at), pa.int64())],
                    ["size", "cell", "far", "n"],
                )

    # One row for each cell.
    extent = distinct.select("u").mapInArrow(extents, "size long, cell long, far double, n long")
    homes: dict[tuple[int, int], int] = {}
    for c in cells.values():
        c.radius = np.full(len(c.pivots), -np.inf)
    for x in extent.groupBy("size", "cell").agg(F.max("far").alias("far"), F.sum("n").alias("n")).collect():
        cells[x["size"]].radius[x.cell], homes[x["size"], x.cell] = x.far, x.n
    known = spark.sparkContext.broadcast(cells)

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, v in by_length(batch):
                here = known.value[size]
                n = here.reached(v, here.homes(v)[0]).sum(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(n), pa.int64()), pa.array(np.arange(len(n)), pa.int64()), pa.array(n, pa.int64())], ["size", "cell", "n"]
                )

    visitors = distinct.select("u").mapInArrow(guests, "size long, cell long, n long").groupBy("size", "cell").agg(F.sum("n").alias("n"))
    # Blocks of each cell: of those at home, and of those copied to it.
    blocks = {(x["size"], x.cell): (-(-homes.get((x["size"], x.cell), 0) // tile), -(-x.n // tile)) for x in visitors.collect()}
    split = spark.sparkContext.broadcast(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tile; ``side`` is 0 or 1, or 2 in a tile of a block with itself."""
        for batch in batches:
            for size, part, v in by_length(batch):
                here = known.value[size]
                home, _ = here.homes(v)
                node = part.column("node").to_numpy()
                spread = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                out: list[tuple[int, int, int, int, int]] = []  # row, cell, i, j, side; guests' blocks count from -1 down
                for i in range(len(v)):
                    own, _ = split.value[size, int(home[i])]
                    b = int(spread[i] % own)
                    out += [(i, home[i], min(b, x), max(b, x), 2 if x == b else int(x < b)) for x in range(own)]
                    guest_blocks = split.value[size, int(home[i])][1]
                    out += [(i, home[i], b, -1 - x, 0) for x in range(guest_blocks)]
                for i, cell_of in zip(*np.nonzero(here.reached(v, home)), strict=True):
                    own, away = split.value[size, int(cell_of)]
                    b = int(spread[i] % away)
                    out += [(i, cell_of, x, -1 - b, 1) for x in range(own)]
                for at in range(0, len(out), 20_000):
                    take = out[at : at + 20_000]
                    index = pa.array([x[0] for x in take], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{size}/{x[1]}/{x[2]}/{x[3]}" for x in take]), pa.array([x[4] for x in take], pa.int32()),
                         part.column("node").take(index), part.column("n").take(index), part.column("u").take(index)],
                        ["tile", "side", "node", "n", "u"],
                    )

    tiles = distinct.select("node", "n", "u").mapInArrow(deal, "tile string, side int, node long, n long, u binary")

    def join(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        node, n, v = group["node"].to_numpy(), group["n"].to_numpy(), _matrix(group["u"])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        same = bool((side == 2).any())
        if len(left) and len(right):
            a, b = linked(v[left], v[right], least, same)
        else:
            a = b = np.zeros(0, np.int64)
        a, b = left[a], right[b]
        found = np.zeros(len(node), np.int64)
        np.add.at(found, a, n[b])
        np.add.at(found, b, n[a])
        root, some = _roots(len(node), a, b), np.flatnonzero(found)
        return pa.table({"node": node[some], "root": node[root[some]], "links": found[some]})

    links = stored(tiles.groupBy("tile").applyInArrow(join, "node long, root long, links long"), "links")
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select("node", "root").distinct(), "node", "root")
    known_groups = distinct.select("node", "n", "k").join(totals, "node", "left").join(groups, "node", "left")
    known_groups = known_groups.withColumn("group", F.coalesce("component", "node"))
    first = known_groups.groupBy("group").agg(F.min("k").alias("least_id"))
    known_groups = known_groups.join(first, "group").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least_id"
    )
    result = rows.select("k", "node").join(known_groups, "node", "left")
    vec_id, component = F.nullif("k", F.lit(NO_ID)), F.nullif(F.coalesce("least_id", "k"), F.lit(NO_ID))
    return result.select(
        vec_id.alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.coalesce("least_id", "k") == F.col("k")).alias("kept"),
    )
