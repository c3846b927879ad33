"""Quality by random-indexing word vectors and a small network.

Words are hashed into BUCKETS, so that the table of vectors keeps its size however large the
vocabulary is; with v words in use a word shares its bucket with about v / BUCKETS others, mostly rare
ones. Each bucket has a sparse random index vector. A bucket's vector is its own index vector plus
the normalised sum of its neighbours' index vectors (one on each side) over the whole corpus. Vectors pooled per
document go through a network of two layers, whose logits are divided by a calibrated temperature.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, claim, held_out, slices, strings, written

#: Labelled rows that the network is fitted on at most: those whose ids hash lowest.
SAMPLE_ROWS = 8000
BUCKETS, DIMS, NONZERO = 1 << 13, 32, 4
HIDDEN = 32
CAPITALS = 0
PIECE = re.compile(r"\w+|[^\w\s]+")
_rng = np.random.default_rng(8)
#: Places and signs of the nonzero entries of each index vector.
PLACES = np.argsort(_rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
PLUS = np.where(_rng.random((BUCKETS, NONZERO)) < 0.5, -1.0, 1.0)
INDEX = np.zeros((BUCKETS, DIMS), np.float32)
np.put_along_axis(INDEX, PLACES, PLUS.astype(np.float32) / np.sqrt(NONZERO), 1)


def _buckets(token: str) -> bytes:
    """Buckets of a token's words and signs; a word in capitals adds a bucket that says so."""
    out = array("H")
    for piece in PIECE.findall(token):
        if not (piece[0].isalnum() or piece[0] == "_"):
            piece = piece[0] * min(len(piece), 3)
        elif len(piece) > 1 and piece.isupper():
            out.append(CAPITALS)
        out.append(1 + xxhash.xxh32_intdigest(piece.lower().encode("utf-8", "surrogatepass")) % (BUCKETS - 1))
    return out.tobytes()


_memo = Memo(_buckets, 160 << 20)


def bucket_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all texts one after another, and how many each text has."""
    parts = [b"".join(map(_memo.__getitem__, x.split())) for x in texts]
    return np.frombuffer(b"".join(parts), np.uint16).astype(np.int64), np.array([len(p) // 2 for p in parts], np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIMS): index vectors plus normalised sums of neighbours' over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        sums = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for part in slices(batch):
                b, sizes = bucket_rows(strings(part, text))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                near = owner[1:] == owner[:-1]
                left, right = b[:-1][near], b[1:][near]
                for word, other in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        np.add.at(sums, word * DIMS + PLACES[other, j], PLUS[other, j])
        rows = sums.reshape(BUCKETS, DIMS)
        some = np.flatnonzero(np.abs(rows).sum(1))
        yield pa.record_batch([pa.array(some, pa.int64()), *[pa.array(rows[some, d]) for d in range(DIMS)]], ["bucket", *[f"v{d}" for d in range(DIMS)]])

    schema = "bucket long, " + ", ".join(f"v{d} double" for d in range(DIMS))
    summed = docs.select(text).mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)])
    table = summed.toArrow()
    sums = np.zeros((BUCKETS, DIMS))
    sums[table["bucket"].to_numpy()] = np.stack([table[f"v{d}"].to_numpy() for d in range(DIMS)], 1)
    # Sums of whole numbers are exact, so the order of partitions leaves no trace.
    return (INDEX + sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Per text: the mean vector, its norm, shares of repeated tokens, and the logarithm of the length."""
    b, sizes = bucket_rows(texts)
    out = np.zeros((len(sizes), DIMS + 4), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        n = sizes[some][:, None].astype(np.float32)
        out[some, :DIMS] = np.add.reduceat(vectors[b], starts, axis=0) / n
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for k in (1, 2):
            same = np.zeros(len(b), np.float32)
            same[k:] = (b[k:] == b[:-k]) & (owner[k:] == owner[:-k])
            out[some, DIMS + k] = np.add.reduceat(same, starts) / n[:, 0]
        out[:, DIMS] = np.linalg.norm(out[:, :DIMS], axis=1)
    out[:, DIMS + 3] = np.log1p(sizes)
    return out


class Network:
    """Standardised inputs, one hidden layer of tanh units, a logit, and a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, l2: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log-loss; the temperature minimises it on a sixth of the rows that training left out."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    checked, used = order[: len(y) // 6], order[len(y) // 6 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = (x - mean) / scale
    base = np.clip(y[used].mean(), 1e-3, 1 - 1e-3)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(base / (1 - base)))]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        for at in range(0, len(used), batch):
            rows = rng.permutation(used)[:batch] if len(used) <= batch else used[at : at + batch]
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + l2 * params[0], back.sum(0), h.T @ d + l2 * params[2], np.array(d.sum())]
            t += 1
            step = 3e-3 * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - step * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        used = rng.permutation(used)
    net = Network(mean, scale, *params, 1.0)
    if len(checked):
        logits, truth = net.logits(x[checked]), y[checked]
        losses = [(np.logaddexp(0, logits / k) - truth * logits / k).mean() for k in np.geomspace(0.5, 5, 41)]
        net.temperature = float(np.geomspace(0.5, 5, 41)[int(np.argmin(losses))])
    return net


def fit(docs: DataFrame, labelled: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network | float]:
    """Word vectors of the whole corpus, and the network fitted on labelled rows that are not held out.

    Without labels of both classes the network is the share of label 1 (none: 0.5).
    """
    known = labelled.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col(id)))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    sample = written(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "y", "text"), "labelled")
    vectors = word_vectors(docs, text)

    def make():
        return lambda batch: pa.record_batch([*batch.select(["_id", "y"]).columns, pa.array(list(pooled(strings(batch, "text"), vectors)), pa.list_(pa.float32()))], ["_id", "y", "x"])

    table = arrow_map(sample, make, "_id long, y int, x array<float>").toArrow().sort_by("_id")
    y = table["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return vectors, float(y.mean()) if len(y) else 0.5
    return vectors, train(np.stack(table["x"].to_numpy()).astype(float), y)


def score(docs: DataFrame, model: tuple[np.ndarray, Network | float], id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts count as empty."""
    vectors, net = model

    def make():
        def each(batch):
            x = pooled(strings(batch, "text"), vectors).astype(float)
            values = np.full(len(x), net) if isinstance(net, float) else net(x)
            return pa.record_batch([*batch.select(["doc_id", "held_out"]).columns, pa.array(values.astype(float))], ["doc_id", "held_out", "score"])

        return each

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text"))
    return arrow_map(rows, make, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
