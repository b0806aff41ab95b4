"""Best-fit packing: pieces of documents into token sequences, by swap-based local search.

Documents are tokenized and only those longer than a sequence are cut. The pieces (a few numbers
each) are stored, dealt in their input order, or that of a column, to shards of about ``SHARD_PIECES``, and each shard is
packed in one task: best fit first, then the emptiest bins are dissolved by moves, one-for-one and
two-for-one exchanges that raise the squared fill. A shard leaves one or two underfull bins, so
the loss is a few sequences in tens of thousands, whatever the size of the input.

Edge cases: NULL and empty texts are one piece that holds the end id alone; an empty table gives no
rows; repeated rows are packed as often as they stand there; ties go to the earlier bin; a NULL id
is carried; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from maskloom.llm.common import by_slices, stored
from maskloom.llm.tokens import encoder

MAX_TOKENS = 2048
END_ID = 0
#: Pieces of a shard, which bounds a task's memory and sets how often a sequence stays underfull.
SHARD_PIECES = 50_000
#: Dissolving a bin is given up after this many exchanges without emptying it.
EXCHANGES = 400
#: Receivers that are tried for each exchange, the emptiest first.
RECEIVERS = 64
#: Passes over the underfull bins; a pass without an exchange ends the search.
PASSES = 10

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, order: str | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, and ``order`` as ``dealt``) of every piece of every document."""
    end = np.asarray([end_id], "<u4").tobytes()
    width = 4 * max_tokens

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer_path).encode
        doc_ids = batch.column(0).to_pylist()
        found = [x + end for x in encode([t or "" for t in batch.column(1).to_pylist()])]
        rows = range(batch.num_rows)
        cut = [(r, i, x[i * width : (i + 1) * width]) for r, x in zip(rows, found, strict=True)
               for i in range(-(-len(x) // width))]
        columns = [
            pa.array([doc_ids[r] for r, _, _ in cut], pa.int64()),
            pa.array([i for _, i, _ in cut], pa.int32()),
            pa.array([i * max_tokens for _, i, _ in cut], pa.int64()),
            pa.array([len(x) // 4 for _, _, x in cut], pa.int64()),
            pa.array([zlib.crc32(x) for _, _, x in cut], pa.int64()),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for _, _, x in cut], pa.list_(pa.int64())))
            names.append("ids")
        if order:
            columns.append(batch.column(2).take(pa.array([r for r, _, _ in cut], pa.int64())))
            names.append("dealt")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids array<long>" if with_ids else "") + (", dealt long" if order else "")
    own = [F.col(f"`{order}`").cast("long").alias("dealt")] if order else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).mapInArrow(by_slices(work), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has a gap of g
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if fits := gaps >> n:
            gap = n + (fits & -fits).bit_length() - 1
            b = at_gap[gap].pop()
            if not at_gap[gap]:
                gaps ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if rest := gap - n:
            at_gap[rest].append(b)
            gaps |= 1 << rest
    return bins


def _exchange(donor: list[int], receiver: list[int], gap: int, lengths: list[int]) -> tuple[list[int], list[int]] | None:
    """What leaves the donor and what comes back, so that the receiver gains most within its gap:
    a move, one or two for one, or one for two."""
    back = sorted((lengths[i], i) for i in receiver)
    out = sorted((lengths[i], i) for i in donor)
    best: tuple[int, list[int], list[int]] | None = None

    def offer(give: list[int], take: list[int], gain: int) -> None:
        nonlocal best
        if 0 < gain <= gap and (best is None or gain > best[0]):
            best = gain, give, take

    for x, i in out:
        offer([i], [], x)
        for y, j in back:
            offer([i], [j], x - y)
    for p, (x, i) in enumerate(out):
        for z, k in out[p + 1 :]:
            offer([i, k], [], x + z)
            for y, j in back:
                offer([i, k], [j], x + z - y)
    for p, (y, j) in enumerate(back):
        for z, k in back[p + 1 :]:
            for x, i in out:
                offer([i], [j, k], x - y - z)
    return best and (best[1], best[2])


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Dissolve underfull bins, the emptiest first.

    Each exchange takes tokens from the donor to a bin that is at least as full, which raises the
    sum of the squared fills; a donor that ends empty is one sequence less. A donor that can't be
    dissolved keeps what its exchanges have gained.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(lengths) // capacity)
    for _ in range(PASSES):
        gained = False
        open_bins = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b))
        count = sum(map(bool, bins))
        for donor in open_bins:
            if count <= least:
                break
            for _ in range(EXCHANGES):
                near = (b for b in open_bins if b != donor and bins[b] and fill[donor] <= fill[b] < capacity)
                for b in sorted(near, key=lambda b: (fill[b], b))[:RECEIVERS] if bins[donor] else ():
                    if found := _exchange(bins[donor], bins[b], capacity - fill[b], lengths):
                        give, take = found
                        bins[donor] = [i for i in bins[donor] if i not in give] + take
                        bins[b] = [i for i in bins[b] if i not in take] + give
                        gain = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                        fill[donor] -= gain
                        fill[b] += gain
                        gained = True
                        break
                else:
                    break
            count -= not bins[donor]
        if not gained:
            break
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(pieces: DataFrame, capacity: int = MAX_TOKENS, shard_pieces: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces that stand together are packed together.

    If ``pieces`` have a column ``dealt``, it gives their order in place of the rows' own, and is not kept:
    shards are stretches of it, and a shard's sequences are numbered by their pieces' mean place in it.
    """
    kept, ordered = stored(pieces, "pieces"), "dealt" in pieces.columns
    kept = kept if ordered else kept.withColumn("dealt", F.monotonically_increasing_id())
    shards = max(1, -(-kept.count() // (shard_pieces or SHARD_PIECES)))
    fields = [f for f in pieces.schema.fields if f.name != "dealt"]
    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        shard = pa.Table.from_batches(rows).combine_chunks()
        shard = shard.take(pa.compute.sort_indices(shard, [("dealt", "ascending"), ("piece", "ascending")])).drop_columns(["dealt"])
        lengths = shard["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        first = TaskContext.get().partitionId() << 32
        packed_bins = pack_lengths(lengths, capacity)
        if ordered:
            packed_bins.sort(key=lambda members: (sum(members) / len(members), min(members)))
        for number, members in enumerate(packed_bins):
            at = 0
            for i in sorted(members):
                sequence[i], offset[i] = first + number, at
                at += lengths[i]
        packed = shard.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        if ordered:
            packed = packed.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        yield from packed.to_batches()

    return kept.repartitionByRange(shards, *(["dealt", "piece"] if ordered else ["dealt"])).mapInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, order: str | None = None) -> DataFrame:
    """Every piece of every document with its place: sequence and offset. ``order`` names a column of
    whole numbers by which documents are dealt."""
    return pack(token_pieces(docs, tokenizer_path, max_tokens, order=order), max_tokens)
