"""Quality of texts by a convolutional network over bytes, in numpy.

Filters of WIDTH bytes slide over the whole text. A text is cut into chunks of CHUNK bytes
that overlap by half; each filter is max-pooled over each chunk. The mean and the largest
of the pooled values over all chunks go through one logistic unit.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import add_fields, fold, labelled_sample, once_per_worker, per_slice, whole_text

#: The training sample: rows of each label and characters of each text.
SAMPLE_ROWS = 1200
SAMPLE_CHARS = 3000
WIDTH, FILTERS, EMBED = 6, 12, 8
CHUNK = 512
HALF = CHUNK // 2
STEPS, BATCH, RATE, SEED = 500, 32, 0.01, 7
THRESHOLD = 0.3
SLICE = 1 << 20
#: The byte after the end of a text, never part of UTF-8.
END = 255


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS: what each byte at each place adds to each filter
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # 2 * FILTERS
    offset: float


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to whole half-chunks (one at least), one after the other, and the half-chunks of each."""
    halves = np.array([max(1, -(-len(t) // HALF)) for t in texts], np.int64)
    pad = bytes([END])
    return np.frombuffer(b"".join(t.ljust(int(h) * HALF, pad) for t, h in zip(texts, halves)) + pad * WIDTH, np.uint8), halves


def pool(best: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of two halves each from maxima over halves: values, and the text of each chunk. A text of one half is one chunk."""
    owner = np.repeat(np.arange(len(halves)), halves)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    single = np.flatnonzero(np.repeat(halves, halves) == 1)
    values = np.concatenate([np.maximum(best[pairs], best[pairs + 1]), best[single]])
    who = np.concatenate([owner[pairs], owner[single]])
    order = np.argsort(who, kind="stable")
    return values[order], who[order]


class Scorer:
    """Filters on pairs of bytes at once: three look-ups for six bytes."""

    def __init__(self, net: Network):
        self.net = net
        left, right = np.divmod(np.arange(1 << 16), 256)
        self._pairs = [(net.table[j][left] + net.table[j + 1][right]).astype(np.float32) for j in range(0, WIDTH, 2)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        flat, halves = lay_out(texts)
        n = len(flat) - WIDTH
        code = flat[:-1].astype(np.uint16) * np.uint16(256) + flat[1:]
        best = np.empty((n // HALF, FILTERS), np.float32)
        step = 64 * HALF  # keeps the responses of a part in cache
        for at in range(0, n, step):
            end = min(n, at + step)
            response = self._pairs[0][code[at:end]]
            for j in range(1, WIDTH // 2):
                response += self._pairs[j][code[at + 2 * j : end + 2 * j]]
            best[at // HALF : end // HALF] = response.reshape(-1, HALF, FILTERS).max(axis=1)
        values, who = pool(best, halves)
        return probability(self.net, values + self.net.bias, who, len(texts))[0]


def probability(net: Network, values: np.ndarray, who: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of ``n`` texts, with what training needs: features, rectified chunk values, chunks of each text."""
    shown = np.maximum(values, 0)
    starts = np.searchsorted(who, np.arange(n))
    size = np.diff(np.r_[starts, len(who)])
    features = np.concatenate([np.add.reduceat(shown, starts) / size[:, None], np.maximum.reduceat(shown, starts)], axis=1)
    z = features @ net.weight + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), features, shown, size


def train(sample: list[tuple[str, object]]) -> Network:
    """Fit embedding, filters and the logistic unit together by Adam on cross-entropy. Deterministic."""
    rng = np.random.default_rng(SEED)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 0.4, (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "weight": rng.normal(0, 0.3, 2 * FILTERS),
        "offset": np.zeros(1),
    }

    def network() -> Network:
        return Network(np.einsum("be,wef->wbf", p["embed"], p["filters"]), p["bias"], p["weight"], float(p["offset"][0]))

    data = [(t.encode(), float(y)) for t, y in sample]
    if len({y for _, y in data}) < 2:  # nothing to tell apart
        p["weight"][:] = 0
        p["offset"][0] = 3.0 if not data or data[0][1] else -3.0
        return network()
    sides = [[d for d in data if d[1] == side] for side in (0.0, 1.0)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, STEPS + 1):
        batch = [sides[i % 2][rng.integers(len(sides[i % 2]))] for i in range(BATCH)]  # both labels alike
        net = network()
        flat, halves = lay_out([t for t, _ in batch])
        n = len(flat) - WIDTH
        response = sum(net.table[j].astype(np.float32)[flat[j : n + j]] for j in range(WIDTH))
        by_half = response.reshape(-1, HALF, FILTERS)
        where = by_half.argmax(axis=1) + np.arange(len(by_half))[:, None] * HALF
        best = np.take_along_axis(response, where, axis=0)
        values, who = pool(best, halves)
        places = _places(best, where, halves)
        values = values + net.bias
        prob, features, shown, size = probability(net, values, who, len(batch))
        error = (prob - np.array([y for _, y in batch])) / len(batch)
        # back through mean and largest, then to the one window behind each chunk's maximum
        d_mean = error[:, None] * net.weight[None, :FILTERS] / size[:, None]
        d_best = error[:, None] * net.weight[None, FILTERS:]
        top = features[who, FILTERS:]
        d_values = (d_mean[who] + d_best[who] * ((shown == top) & (shown > 0))) * (values > 0)
        d_table = np.zeros((WIDTH, 256, FILTERS))
        columns = np.broadcast_to(np.arange(FILTERS), places.shape)
        for j in range(WIDTH):
            np.add.at(d_table[j], (flat[places + j], columns), d_values)
        grads = {
            "embed": np.einsum("wbf,wef->be", d_table, p["filters"]),
            "filters": np.einsum("wbf,be->wef", d_table, p["embed"]),
            "bias": d_values.sum(axis=0),
            "weight": features.T @ error + 1e-4 * p["weight"],
            "offset": np.array([error.sum()]),
        }
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in grads.items():
            first, second = moments[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            p[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return network()


def _places(best: np.ndarray, where: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Where the maximum of each chunk lies, in the order of pool()."""
    owner = np.repeat(np.arange(len(halves)), halves)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    single = np.flatnonzero(np.repeat(halves, halves) == 1)
    left = best[pairs] >= best[pairs + 1]
    out = np.concatenate([np.where(left, where[pairs], where[pairs + 1]), where[single]])
    return out[np.argsort(np.concatenate([owner[pairs], owner[single]]), kind="stable")]


def learn(documents: DataFrame, labels: DataFrame, per_label: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network:
    """Learn from a bounded sample of labelled rows outside the held-out fold; only texts are seen."""
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    return train(labelled_sample(marked, documents, "quality", per_label, chars))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of ``docs`` with ``__score`` added: the probability of label 1.

    Null texts are empty; an empty text is one chunk of padding and gets the score that belongs
    to it. Repeated rows get equal scores; an empty table gives no rows. One narrow pass over
    whole texts.
    """
    columns, key = docs.columns, uuid.uuid4().hex

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        own = once_per_worker(key, lambda: Scorer(net))
        found = own.scores(part.column(len(columns)).to_pylist())
        return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.float64())], names=[*columns, "__score"])

    binary = docs.withColumn("__bytes", whole_text().cast("binary"))
    return binary.mapInArrow(per_slice(run, "__bytes", SLICE), add_fields(docs.schema, ("__score", T.DoubleType())))


def predict(docs: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs`` by what the labels of ``documents`` teach."""
    out = score(docs.select("doc_id", "text"), learn(documents, labels))
    return out.select("doc_id", (fold(out) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
