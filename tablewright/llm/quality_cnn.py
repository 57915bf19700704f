"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes pass through ``FILTERS`` learned filters of ``WIDTH`` bytes at every position.
Positions fall into blocks of ``STEP``; two neighbouring blocks make a chunk, so chunks overlap by
half and cover the whole document. Each filter is max-pooled within a chunk; the mean, maximum and
minimum over the chunks go into a logistic unit that gives one probability.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, stored, table, text_print

WIDTH, FILTERS, STEP = 6, 24, 128
#: Training: labelled rows of each class at most, bytes of one text and of all together at most (others
#: aren't sampled; those that are count whole), and passes. Scoring has no such bounds.
CLASS_ROWS, TEXT_BYTES, FIT_BYTES, PASSES = 1200, 1_000_000, 48_000_000, 6
#: Positions whose activations are in memory at once.
PIECE = 512 * STEP


def as_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes with enough zeros behind them that each byte starts a position; one zero for an empty text."""
    raw = (text or "").encode() or b"\0"
    return np.frombuffer(raw + bytes(WIDTH - 1), np.uint8)


class Network:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        """filters: (WIDTH, 256, FILTERS); bias: (FILTERS,); weights: (3, FILTERS) of mean, maximum, minimum."""
        self.filters, self.bias, self.weights, self.offset = filters, bias, weights, offset
        self._pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        filters = rng.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32)
        return Network(filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, (3, FILTERS)).astype(np.float32), 0.0)

    def pairs(self) -> list[np.ndarray]:
        """For each two bytes of the width, what both add to every filter."""
        if self._pairs is None:
            f = self.filters
            self._pairs = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]
        return self._pairs

    def block_maxima(self, data: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each block of positions."""
        n, found = len(data) - WIDTH + 1, []
        pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
        tables = self.pairs()
        for i in range(0, n, PIECE):
            m = min(PIECE, n - i)
            act = tables[0].take(pair[i : i + m], axis=0)
            for j in range(1, WIDTH // 2):
                act += tables[j].take(pair[i + 2 * j : i + 2 * j + m], axis=0)
            whole = m // STEP * STEP
            if whole:
                found.append(act[:whole].reshape(-1, STEP, FILTERS).max(axis=1))
            if whole < m:
                found.append(act[whole:].max(axis=0, keepdims=True))
        return np.concatenate(found)

    def score(self, text: str | None) -> float:
        top = self.block_maxima(as_bytes(text)) + self.bias
        chunks = np.maximum(np.maximum(top[:-1], top[1:]) if len(top) > 1 else top, 0)
        z = self.offset + float((np.stack([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0)]) * self.weights).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _maxima(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter is largest in each block of positions, and its value there."""
    n, places, values = len(data) - WIDTH + 1, [], []
    for i in range(0, n, PIECE):
        m = min(PIECE, n - i)
        act = net.filters[0].take(data[i : i + m], axis=0)
        for j in range(1, WIDTH):
            act += net.filters[j].take(data[i + j : i + j + m], axis=0)
        at = np.stack([s + act[s : s + STEP].argmax(axis=0) for s in range(0, m, STEP)])
        places.append(at + i)
        values.append(np.take_along_axis(act, at, axis=0))
    return np.concatenate(places), np.concatenate(values)


def _forward_backward(net: Network, data: np.ndarray, label: float, grads: list[np.ndarray]) -> None:
    at, top = _maxima(net, data)
    top = top + net.bias
    if len(top) > 1:
        second = top[1:] > top[:-1]
        pre, at = np.where(second, top[1:], top[:-1]), np.where(second, at[1:], at[:-1])
    else:
        pre = top
    chunks = np.maximum(pre, 0)
    pooled = np.stack([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0)])
    z = net.offset + float((pooled * net.weights).sum())
    err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
    grads[2] += err * pooled
    grads[3] += err
    back, k = np.repeat(err * net.weights[:1] / len(chunks), len(chunks), axis=0), np.arange(FILTERS)
    back[chunks.argmax(axis=0), k] += err * net.weights[1]
    back[chunks.argmin(axis=0), k] += err * net.weights[2]
    back *= pre > 0
    grads[1] += back.sum(axis=0)
    cols = np.broadcast_to(k, at.shape)
    for j in range(WIDTH):
        np.add.at(grads[0][j], (data[at + j], cols), back)


def train(rows: list[tuple[str | None, int]], prior: float, seed: int = 7) -> Network:
    """Adam on the log loss of (text, label) rows, then the offset moves from the rows' share of label 1 to ``prior``.

    With one class only or no rows, every score is the prior.
    """
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    ones = sum(y for _, y in rows)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not 0 < ones < len(rows):
        net.weights[:] = 0
        net.offset = float(np.log(prior / (1 - prior)))
        return net
    params = [net.filters, net.bias, net.weights, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    data, step, batch = [(as_bytes(t), y) for t, y in rows], 0, 16
    total = PASSES * -(-len(data) // batch)
    for _ in range(PASSES):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in params]
            for o in order[i : i + batch]:
                _forward_backward(net, *data[o], grads)
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g /= len(order[i : i + batch])
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            net.offset = float(params[3][0])
    share = ones / len(rows)
    net.offset += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS) -> Network:
    """Learn labels.quality from at most ``class_rows`` labelled rows of each class that aren't held out.

    The rows with the least hash of doc_id are taken, as far as FIT_BYTES go; the class shares are counted
    over all labelled rows that aren't held out. A doc_id with several labels or texts counts with the
    least of each; null ids and labels are ignored. With one class only, or none, every score is the prior.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    picked = stored(reduce(DataFrame.union, [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows) for q in (0, 1)]), "picked")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    sampled = stored(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sampled")
    # At most 2 * class_rows rows of two numbers.
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept = sampled.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= FIT_BYTES).drop("so_far")
    rows = sampled.join(F.broadcast(kept), "doc_id").select("text", "quality", "doc_id").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([(r.text, r.quality) for r in rows], prior)


def quality_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, print (a hash of the text), score for every row of ``docs`` (doc_id, text; others are ignored).

    The whole ``text`` is scored, however long, with a fixed number of positions in memory; null and empty
    texts as one zero byte. Repeated rows get equal scores, null ids stay, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(net)

    def run(batches):
        model = held.value
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "print", "score"])

    return docs.select("doc_id", text_print().alias("print"), "text").mapInArrow(run, "doc_id long, print long, score double")


def op5_quality_cnn(spark, sf_dir: str) -> DataFrame:
    """All of documents; fitted on rows whose id isn't held out."""
    docs = documents(spark, sf_dir)
    scored = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
