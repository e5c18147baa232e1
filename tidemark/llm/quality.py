"""Quality by positive-unlabelled learning: trusted good texts against unlabelled ones.

A text is described by how often each pair of neighbouring byte classes occurs in it. A linear model minimises the
non-negative unbiased risk: with prior c, E+ over positives and Eu over unlabelled texts and l the logistic loss,
c E+[l(+)] + max(0, Eu[l(-)] - c E+[l(-)]).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices, text_buffer

#: Positives and unlabelled rows that training uses at the most; rows that are described at once, 15 KB of counts each;
#: bytes that are counted at once, some 40 bytes of memory each.
POSITIVES, UNLABELLED, ROWS, BYTES = 4_000, 8_000, 256, 1 << 20


def byte_classes() -> tuple[np.ndarray, int]:
    """A class for each byte: letters by case, digits, lead and later bytes, and every white space and sign of its own."""
    table, names = np.zeros(256, np.int64), {}
    for k in range(256):
        c = chr(k)
        name = "upper" if "A" <= c <= "Z" else "vowel" if c in "aeiou" else "lower" if "a" <= c <= "z" else "digit" if c.isdigit() and k < 128 else "later" if 128 <= k < 192 else "lead" if k >= 192 else "control" if k < 32 and c not in "\n\t" else c
        table[k] = names.setdefault(name, len(names))
    return table, len(names)


CLASS, CLASSES = byte_classes()
#: Pair frequencies, class frequencies, and four of the whole text.
FEATURES = CLASSES * CLASSES + CLASSES + 4


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies, so that rare pairs count, and log length, line, word and case measures."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    one, two = np.zeros(n * CLASSES, np.int64), np.zeros(n * CLASSES**2, np.int64)
    for at in range(0, len(data), BYTES):
        first, end = max(0, at - 1), min(len(data), at + BYTES)  # the byte before, for its pair
        row = np.repeat(np.arange(n), np.diff(np.clip(offsets, first, end)))
        kind = CLASS[data[first:end]]
        one += np.bincount(row[at - first :] * CLASSES + kind[at - first :], minlength=len(one))
        same = row[1:] == row[:-1]
        two += np.bincount((row[1:] * CLASSES + kind[:-1])[same] * CLASSES + kind[1:][same], minlength=len(two))
    one, two = one.reshape(n, CLASSES).astype(np.float32), two.reshape(n, CLASSES**2).astype(np.float32)
    total = np.maximum(1, sizes)[:, None]
    spaces, lines, upper = one[:, CLASS[32]], one[:, CLASS[10]], one[:, CLASS[65]]
    whole = np.stack([np.log1p(sizes) / 8, np.log1p(sizes / (lines + 1)) / 6, np.log1p(sizes / (spaces + lines + 1)) / 3, upper / total[:, 0]], 1)
    return np.concatenate([np.sqrt(two / total), np.sqrt(one / total), whole], 1).astype(np.float32)


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.bias, self.mean, self.scale = weights, bias, mean, scale

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.02, ridge: float = 1e-3, seed: int = 0) -> QualityModel:
    """Minimises the non-negative risk with Adam; when the negative part falls below zero, its gradient is reversed."""
    if not len(positive) or not len(unlabelled):
        d = positive.shape[1]
        return QualityModel(np.zeros(d, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), np.zeros(d, np.float32), np.ones(d, np.float32))
    mean = unlabelled.mean(0)
    scale = np.maximum(np.sqrt(np.maximum(np.einsum("ij,ij->j", unlabelled, unlabelled, dtype=np.float64) / len(unlabelled) - mean.astype(np.float64) ** 2, 0)), 0.01).astype(np.float32)
    p, u = positive, unlabelled
    rng = np.random.default_rng(seed)
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    # rows are not scaled, the weights are: (x - mean) / scale . w = x . (w / scale) - mean . (w / scale)
    times = lambda x, v: np.einsum("ij,j->i", x, v)  # noqa: E731  small products: a library's threads would only wait
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        i, j = rng.integers(0, len(p), min(len(p), 512)), rng.integers(0, len(u), min(len(u), 1024))
        pi, uj, v_ = p[i], u[j], w / scale
        shift = b - float(mean @ v_)
        sp, su = sigmoid(times(pi, v_) + shift), sigmoid(times(uj, v_) + shift)
        negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        of = lambda x, d: np.append((np.einsum("ij,i->j", x, d) - mean * d.sum()) / scale, d.sum()) / len(d)
        fall = of(uj, su) - prior * of(pi, sp)  # gradient of the negative part
        g = prior * of(pi, sp - 1) + fall if negative >= 0 else -fall
        g[:-1] += ridge * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - float(step[-1])
    return QualityModel(w.astype(np.float32), float(b), mean, scale)


def describe(batches):
    """For mapInArrow over (kind, text): the features of each text as bytes."""
    for piece in slices(batches, "text", 1 << 20, ROWS):
        x = features(*text_buffer(piece.column(1)))
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["kind", "x"])


def fit(positives: DataFrame, unlabelled: DataFrame, prior: float, *, id: str = "doc_id", text: str = "text", most: tuple[int, int] = (POSITIVES, UNLABELLED)) -> QualityModel:
    """Learns from about `most` rows of each kind at the most, chosen by a hash of their ids.

    Without positives or without unlabelled rows every text scores the prior.
    """
    parts = []
    for rows, n in zip((positives, unlabelled), most, strict=True):
        sample = bounded_sample(rows, id, n).select(F.lit(1).alias("kind"), F.col(text).alias("text"))
        got = sample.mapInArrow(describe, "kind int, x binary").toArrow()["x"]
        x = np.empty((len(got), FEATURES), np.float32)
        for k, row in enumerate(got):
            x[k] = np.frombuffer(row.as_buffer(), np.float32)
        del got
        parts.append(x[np.lexsort(x[:, -4:].T)])  # the same order whatever the partitions
    return train(*parts, prior)


def predict(docs: DataFrame, model: QualityModel, *, id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """`id`, score and predicted of every row, whole texts.

    Null texts score as empty ones. Null and repeated ids stay, a row each; other columns are ignored; an empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in slices(batches, "text", 1 << 20, ROWS):
            score = sent.value.score(features(*text_buffer(piece.column(1)))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id)
