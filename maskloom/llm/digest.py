"""Document fingerprints: a quartile digest of hashed byte triplets.

Three triplets of each four neighbouring bytes are hashed to ``BUCKETS`` counters. A fingerprint
holds the length's logarithm and, for every counter, in which quarter of the document's counters it
lies. The difference of two fingerprints adds up the steps between quarters (three steps count six)
and the steps of length, and is bounded; ``likeness`` is 1 for equal fingerprints and 0 at the
bound, which is about what unrelated texts have.

Edge cases: NULL is the empty text, whose counters are all in the first quarter, as for texts of
under four bytes; equal texts have equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import NO_ID, by_slices, slices, text_bytes

BUCKETS = 256
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Odd multipliers that mix a triplet's bytes.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Unrelated codes are 1.625 apart on average; lengths count by steps of about 10 %.
BOUND = 1.625 * BUCKETS
LENGTH_BASE, LENGTH_COST = math.log(1.1), 4


def counters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x buckets."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    if len(data) >= 4:
        rows = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offsets))
        inside = rows[:-3] == rows[3:]
        base, wide, last = rows[:-3][inside], data.astype(np.uint32), len(data) - 3
        for number, pattern in enumerate(PATTERNS):
            mixed = np.full(last, (number + 1) * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for at, k in zip(pattern, MIX, strict=True):
                mixed += wide[at : at + last] * np.uint32(k)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            bucket = (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))[inside]
            out += np.bincount(base + bucket, minlength=len(out))
    return out.reshape(n, BUCKETS)


def codes(counts: np.ndarray) -> np.ndarray:
    """0 to 3 for each counter: how many of the document's quartiles it exceeds."""
    q = np.sort(counts, 1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    return sum((counts > q[:, i : i + 1]).astype(np.int8) for i in range(3)) if len(counts) else counts.astype(np.int8)


def length_code(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log1p(size) / LENGTH_BASE).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    step = np.abs(a - b)
    difference = (step + 3 * (step == 3)).sum(1) + LENGTH_COST * np.abs(a_length - b_length)
    return 1 - np.minimum(difference, BOUND) / BOUND


def written(code: np.ndarray, length: np.ndarray) -> list[str]:
    """Hex: two bytes of length, then four counters a byte."""
    four = code.astype(np.uint8).reshape(len(code), BUCKETS // 4, 4)
    packed = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    return [f"{n:04x}{row.tobytes().hex()}" for n, row in zip(length.tolist(), packed, strict=True)]


def parsed(fingerprint: str) -> tuple[np.ndarray, int]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], 1).reshape(-1).astype(np.int8), int(fingerprint[:4], 16)


def compare(a: str, b: str) -> float:
    """Likeness of two written fingerprints, 0 to 1."""
    (x, n), (y, m) = parsed(a), parsed(b)
    return float(likeness(x[None], y[None], np.array([n]), np.array([m]))[0])


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and length codes."""
    data, offsets = text_bytes(pa.array(texts, pa.binary()))
    return codes(counters(data, offsets)), length_code(np.diff(offsets))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row; one scan, no shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = written(*digests([(t or "").encode() for t in batch.column(1).to_pylist()]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_slices(work), "doc_id long, fingerprint string")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document, by descending ``doc_id``.

    The last third of the code points is replaced by as many of the next document's first ones; the
    document after the last is the first. Rows are dealt to ranges of ids, once; a range also gets a
    copy of the first row of the range that follows, so each is read on its own, as a stream. NULL
    ids come last; rows of equal id follow each other by a hash of their text.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    ids = docs.select(k.alias("k"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ids.approxQuantile("k", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    bounds = sorted({int(x) for x in found})
    array = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    part = F.size(F.filter(array, lambda x: x < F.col("k")))
    # One row for each range: the copies each range needs.
    tops = sorted(tuple(r) for r in ids.groupBy(part.alias("part")).agg(F.max("k").alias("top")).collect())
    follows = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]
    extra = spark.createDataFrame(follows, "top long, to int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), k.alias("k"))
    rows = rows.withColumn("own", part).join(F.broadcast(extra), F.col("k") == F.col("top"), "left")
    places = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("copy")))
    copy = F.array(F.struct(F.col("to").alias("part"), F.lit(True).alias("copy")))
    rows = rows.select("doc_id", "text", "k", F.inline(F.when(F.col("to").isNull(), places).otherwise(F.concat(places, copy))))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartition("part")
    rows = rows.sortWithinPartitions("part", "copy", F.desc("k"), "tie", "text").select("doc_id", "text", "part", "copy")

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(run: list[tuple]) -> pa.RecordBatch:
        """``run`` holds one row more than it gives results for."""
        texts, edited, keep = [t.encode() for _, t, _, _ in run], [], []
        for (_, text, part, copied), (_, after, next_part, _) in zip(run, run[1:], strict=False):
            if not copied and part == next_part:
                keep.append(len(edited))
                cut = len(text) // 3
                edited.append((text[: len(text) - cut] + after[:cut]).encode())
            else:
                edited.append(b"")
        keep = np.array(keep, int)
        code, length = digests(texts)
        own, own_length = code[keep], length[keep]
        new, new_length = digests([edited[i] for i in keep])
        return pa.RecordBatch.from_arrays([
            pa.array([run[i][0] for i in keep], pa.int64()),
            pa.array([len(run[i][1]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(edited[i]).hexdigest() for i in keep], pa.string()),
            pa.array(written(own, own_length), pa.string()),
            pa.array(written(new, new_length), pa.string()),
            pa.array(likeness(own, new, own_length, new_length), pa.float64()),
            pa.array(likeness(own, code[keep + 1], own_length, length[keep + 1]), pa.float64()),
        ], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for a, b in slices(np.array([len(r[1]) for r in rows]), 2 << 20):
                run = last + rows[a:b]
                if len(run) > 1:
                    yield result(run)
                last = run[-1:]

    return rows.mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
