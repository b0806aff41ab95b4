"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into blocks of ``BLOCK`` bytes; learned filters of ``WIDTH`` bytes run over the whole
of every block at steps of ``STRIDE``, and the largest answer of each filter is kept. Two
neighbouring blocks make a chunk, so chunks overlap by half and cover the document to its end. A
hidden layer reads each chunk, its outputs are averaged and max-pooled over all chunks, and a last
layer combines them into one probability.

The network is fitted on the driver on at most ``TRAIN_ROWS`` labelled rows, of each of which at
most ``TRAIN_CHUNKS`` evenly spaced chunks are read; scoring reads every byte of every text.

Edge cases: NULL and empty texts are one block of zeros and get a score like any other; labels that
are NULL or whose document is missing are not learned from; a document with several labels has its
lowest; without labels of both kinds every score is the share of label 1 (0.5 without any label);
repeated rows get equal scores; an empty table gives no rows. Only the text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import by_slices, free_name, text_bytes

BLOCK, WIDTH, STRIDE = 256, 8, 4
FILTERS, HIDDEN = 16, 16
#: The bound of the training sample, rows and chunks of each.
TRAIN_ROWS, TRAIN_CHUNKS = 3000, 12
EPOCHS, BATCH, RATE, SEED = 7, 64, 0.004, 7


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (with ``WIDTH`` bytes of the next one) and the row of each; zeros follow a text's end."""
    count = np.maximum(1, -(-np.diff(offsets) // BLOCK))
    rows = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[rows] + BLOCK * number
    index = start[:, None] + np.arange(BLOCK + WIDTH)
    inside = index < offsets[rows + 1][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.where(inside, index, len(data))], 0).astype(np.uint8), rows


@dataclass
class Network:
    filters: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS, HIDDEN
    hidden_bias: np.ndarray
    last: np.ndarray  # 2 * HIDDEN
    last_bias: np.ndarray  # 1

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        f32 = np.float32
        return Network(
            rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(f32), np.zeros(FILTERS, f32),
            rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32),
            rng.normal(0, 0.3, 2 * HIDDEN).astype(f32), np.zeros(1, f32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.last, self.last_bias]

    def answers(self, blocks: np.ndarray) -> np.ndarray:
        """Blocks x positions x filters."""
        out = np.zeros((len(blocks), BLOCK // STRIDE, FILTERS), np.float32)
        for w in range(WIDTH):
            out += self.filters[w][blocks[:, w : w + BLOCK : STRIDE]]
        return out

    def largest(self, blocks: np.ndarray) -> np.ndarray:
        parts = [self.answers(blocks[i : i + 1024]).max(1) for i in range(0, len(blocks), 1024)]
        return np.maximum(np.concatenate(parts) + self.bias, 0) if parts else np.zeros((0, FILTERS), np.float32)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        blocks, rows = blocks_of(data, offsets)
        pooled = self.largest(blocks)
        follows = np.append(rows[1:] == rows[:-1], False)
        chunk = np.where(follows[:, None], np.maximum(pooled, np.roll(pooled, -1, 0)), pooled)
        hidden = np.maximum(chunk @ self.hidden + self.hidden_bias, 0)
        first = np.flatnonzero(np.append(True, ~follows[:-1]))
        n = np.diff(np.append(first, len(rows)))[:, None]
        document = np.concatenate([np.add.reduceat(hidden, first) / n, np.maximum.reduceat(hidden, first)], 1)
        return document.astype(np.float64) @ self.last + self.last_bias[0]


@dataclass
class Model:
    """The network, or a constant where there is nothing to tell apart."""

    network: Network | None
    constant: float = 0.5

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.network.logits(data, offsets), -60, 60)))


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Adam over shuffled batches; each step follows the largest answers back to the bytes."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(None, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(SEED)
    net = Network.fresh(rng)
    chunks = []
    for text in texts:
        found, _ = blocks_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        at = np.unique(np.linspace(0, max(0, len(found) - 2), TRAIN_CHUNKS).astype(int))
        chunks.append(np.stack([found[at], found[np.minimum(at + 1, len(found) - 1)]], 1))
    mean, square, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(chunks))
        for batch in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            step += 1
            grads = _gradient(net, [chunks[i] for i in batch], labels[batch])
            for p, g, m, s in zip(net.parts(), grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(net)


def _gradient(net: Network, documents: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    blocks = np.concatenate(documents).reshape(-1, BLOCK + WIDTH)
    n = np.array([len(d) for d in documents])
    first = np.cumsum(n) - n
    rows = np.repeat(np.arange(len(n)), n)
    answers = net.answers(blocks)
    where = answers.argmax(1)
    pooled = np.maximum(np.take_along_axis(answers, where[:, None], 1)[:, 0] + net.bias, 0).reshape(-1, 2, FILTERS)
    side = pooled.argmax(1)
    chunk = pooled.max(1)
    hidden = np.maximum(chunk @ net.hidden + net.hidden_bias, 0)
    top = np.maximum.reduceat(hidden, first)
    document = np.concatenate([np.add.reduceat(hidden, first) / n[:, None], top], 1)
    error = 1 / (1 + np.exp(-(document @ net.last + net.last_bias))) - labels
    error = (error / len(labels)).astype(np.float32)
    back = error[:, None] * net.last
    d_hidden = (back[:, :HIDDEN] / n[:, None])[rows]
    is_top = (hidden == top[rows]) & (hidden > 0)
    d_hidden = (d_hidden + is_top * back[:, HIDDEN:][rows]) * (hidden > 0)
    d_chunk = (d_hidden @ net.hidden.T) * (chunk > 0)
    c, f = np.nonzero(d_chunk)
    b = 2 * c + side[c, f]
    d_filters = np.zeros_like(net.filters)
    for w in range(WIDTH):
        np.add.at(d_filters[w], (blocks[b, w + STRIDE * where[b, f]], f), d_chunk[c, f])
    return [d_filters, d_chunk.sum(0), chunk.T @ d_hidden, d_hidden.sum(0), error @ document, error.sum(keepdims=True)]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out, the lowest hashes of their ids."""
    marked = labels.select(F.col("doc_id").alias("marked_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.filter(F.col("quality").isin(0, 1) & ~held_out("marked_id"))
    marked = marked.groupBy("marked_id").agg(F.min("quality").alias("quality"))
    sample = marked.orderBy(F.xxhash64(F.lit(SEED), "marked_id"), "marked_id").limit(rows)
    # Evenly spaced chunks of the text: what is brought to the driver is bounded as well.
    chars = TRAIN_CHUNKS * 2 * BLOCK
    size = F.length("text")
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_CHUNKS - 1)),
        lambda i: F.substring(F.col("text"), (i * (size - 2 * BLOCK) / (TRAIN_CHUNKS - 1)).cast("int") + 1, F.lit(2 * BLOCK)),
    )
    found = docs.join(F.broadcast(sample), docs.doc_id == sample.marked_id).select(
        "marked_id", "quality", F.when(size > chars, F.concat_ws("", spaced)).otherwise(F.coalesce("text", F.lit(""))).alias("text")
    )
    found = found.groupBy("marked_id").agg(F.min(F.struct("quality", "text")).alias("x")).select("marked_id", "x.*")
    local = found.toPandas().sort_values("marked_id")
    return fit([t.encode() for t in local["text"]], local["quality"].to_numpy())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.scores(*text_bytes(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        by_slices(work, 1 << 20), "doc_id long, score double"
    )
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = []
        for i in range(0, len(texts), 256):
            found.append(shared.value.scores(*text_bytes(pa.array(texts.iloc[i : i + 256], pa.string(), from_pandas=True))))
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    name = free_name(docs, "score")
    return docs.withColumn(name, score(F.coalesce("text", F.lit("")))).filter(F.col(name) >= least).drop(name)
