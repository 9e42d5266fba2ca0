"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded in ``WIDTH`` numbers; ``FILTERS`` filters over 8 bytes move by 4 through
overlapping chunks of ``CHUNK`` bytes that cover the whole text. Each filter's responses are
max-pooled in the chunk; the chunks' pooled values are combined by mean, max and min, and a
logistic unit makes one probability of them. Trained with Adam on a bounded labelled sample, of
which long texts give pieces from all over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import kernels as K
from kelpie.llm.samples import remainder, sample_by_label

CHUNK, OVERLAP, STEP = 512, 64, 4
WIDTH, FILTERS = 8, 32
#: Labelled texts of a class to learn from at most.
SAMPLE = 800
EPOCHS, BATCH, RATE = 12, 64, 4e-3
GOOD = 0.7
#: Chunks that go through the network at a time.
AT_ONCE = 256


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' chunks (n x CHUNK, padded with bytes 0) and the texts' offsets in them; each has one at least."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // (CHUNK - OVERLAP)))
    rows = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[row] + (np.arange(rows[-1]) - rows[row]) * (CHUNK - OVERLAP)
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < offsets[row + 1][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), rows


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        f4 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "embed": f4(256, WIDTH, scale=0.5),
            "kernel": f4(2, STEP * WIDTH, FILTERS, scale=0.18),
            "bias": np.zeros(FILTERS, np.float32),
            "weight": f4(3 * FILTERS, scale=0.1),
            "shift": np.zeros(1, np.float32),
        }

    def pooled(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's highest response of each filter (after a ReLU), and where it is."""
        n = len(some)
        x = self.p["embed"][some].reshape(n * CHUNK // STEP, STEP * WIDTH)
        both = (x @ np.concatenate([self.p["kernel"][0], self.p["kernel"][1]], axis=1)).reshape(n, CHUNK // STEP, 2 * FILTERS)
        responses = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
        where = responses.argmax(axis=1) if n <= AT_ONCE and self.training else None
        return np.maximum(responses.max(axis=1) + self.p["bias"], 0), where

    training = False

    @staticmethod
    def combined(pooled: np.ndarray, rows: np.ndarray) -> np.ndarray:
        count = np.diff(rows)[:, None]
        return np.concatenate(
            [np.add.reduceat(pooled, rows[:-1]) / count, np.maximum.reduceat(pooled, rows[:-1]), np.minimum.reduceat(pooled, rows[:-1])], axis=1
        )

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        made, rows = chunks(data, offsets)
        pooled = np.concatenate([self.pooled(made[i : i + AT_ONCE])[0] for i in range(0, len(made), AT_ONCE)])
        logit = self.combined(pooled, rows) @ self.p["weight"] + self.p["shift"]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, made: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        parts = [self.pooled(made[i : i + AT_ONCE]) for i in range(0, len(made), AT_ONCE)]
        pooled, where = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        inputs = self.combined(pooled, rows)
        score = 1 / (1 + np.exp(-(inputs @ self.p["weight"] + self.p["shift"])))
        error = ((score - labels) / len(labels)).astype(np.float32)
        row = np.repeat(np.arange(len(labels)), np.diff(rows))
        mean, high, low = np.split(error[:, None] * self.p["weight"], 3, axis=1)
        top, bottom = inputs[:, FILTERS : 2 * FILTERS], inputs[:, 2 * FILTERS :]

        def shared(best: np.ndarray) -> np.ndarray:
            """Chunks that tie share the gradient."""
            hit = (pooled == best[row]).astype(np.float32)
            return hit / np.add.reduceat(hit, rows[:-1])[row]

        g = mean[row] / np.diff(rows)[row][:, None] + high[row] * shared(top) + low[row] * shared(bottom)
        g = (g * (pooled > 0)).astype(np.float32)
        at = where[:, :, None] * STEP + np.arange(2 * STEP)
        window = made[np.arange(len(made))[:, None, None], at]
        x = self.p["embed"][window].reshape(len(made), FILTERS, -1)
        kernel = np.concatenate([self.p["kernel"][0], self.p["kernel"][1]])
        back = (g[:, :, None] * kernel.T[None]).reshape(-1, WIDTH)
        flat = window.reshape(-1)
        return {
            "embed": np.stack([np.bincount(flat, weights=back[:, d], minlength=256) for d in range(WIDTH)], axis=1).astype(np.float32),
            "kernel": np.einsum("nf,nfk->kf", g, x).reshape(2, STEP * WIDTH, FILTERS),
            "bias": g.sum(axis=0),
            "weight": inputs.T @ error,
            "shift": error.sum(keepdims=True),
        }


def train(texts: dict[int, list[list[str]]], counts: dict[int, int] | None = None, seed: int = 3) -> Network:
    """A network from {label: texts}, each a list of pieces. With one class or none it stays untrained.

    Classes weigh alike in training; then the logit is moved by the log odds of ``counts``, so
    that the score is a probability where labels are as frequent as there.
    """
    net = Network(seed)
    if len([t for t in texts.values() if t]) < 2:
        return net
    rng = np.random.default_rng(seed)
    most = max(map(len, texts.values()))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    net.training, step, steps = True, 0, EPOCHS * (-(-len(texts) * most // BATCH))
    for _ in range(EPOCHS):
        drawn = [(t, y) for y, ts in sorted(texts.items()) for t in [ts[i % len(ts)] for i in rng.permutation(most)]]
        order = rng.permutation(len(drawn))
        for i in range(0, len(order), BATCH):
            batch = [drawn[j] for j in order[i : i + BATCH]]
            raw = [piece.encode("utf-8", "replace") for pieces, _ in batch for piece in pieces]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            made, rows = chunks(np.frombuffer(b"".join(raw), np.uint8), offsets)
            rows = rows[np.concatenate([[0], np.cumsum([len(pieces) for pieces, _ in batch])])]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in net.gradients(made, rows, np.array([y for _, y in batch], np.float32)).items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.training = False
    if counts:
        net.p["shift"] = net.p["shift"] + np.float32(np.log(counts[1] / counts[0]))
    return net


def score_quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row, from its whole text alone; a null text is empty.

    Repeated rows are scored each, an empty table gives no rows, other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Network()
        local.p = sent.value
        for batch in batches:
            data, offsets = K.buffers(K.column(batch, "text"))
            ids = K.column(batch, "id")
            for i, j in K.runs(offsets, 1 << 20):
                found = local.probability(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(found)], names=["id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    return out.withColumnRenamed("id", id_col)


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from the labelled rows that aren't held out (crc32 of doc_id mod 4 is not 2)."""
    rows = labels.where(remainder("doc_id", 4) != 2).where("quality in (0, 1)")
    rows = rows.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    texts = sample_by_label(rows, "quality", SAMPLE, texts=docs.select(F.col("doc_id").alias("id"), "text"))
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    return train(texts, counts)


def op10_byte_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = score_quality(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
