"""Language identification by a small byte convolutional network, trained and applied with numpy.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter's maximum over a window
feeds a softmax. A text is cut into windows that cover all its bytes, and the mean of their probabilities decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_buffer

#: Bytes of a window and of the overlap of neighbours; embedding size; filter widths and filters of each.
WINDOW, OVERLAP, EMBED, WIDTHS, FILTERS = 128, 4, 8, (2, 3, 5), 16
#: Rows and windows of each that training uses at the most; passes over them; windows of a step; windows that are cut at once.
TRAIN_ROWS, TRAIN_WINDOWS, PASSES, STEP, CUT = 6_000, 3, 4, 128, 4096


def window_counts(offsets: np.ndarray) -> np.ndarray:
    """How many windows each row has (an empty row: none)."""
    sizes = np.diff(offsets)
    return np.where(sizes > 0, np.maximum(1, -(-(sizes - OVERLAP) // (WINDOW - OVERLAP))), 0)


def windows_at(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The windows at the given places of the given rows, padded with zeros."""
    at = (offsets[:-1][row] + place * (WINDOW - OVERLAP))[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][row][:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)


def cut(data: np.ndarray, offsets: np.ndarray, most: int = CUT):
    """All rows' windows in order, `most` at a time: (rows, windows)."""
    ends = np.cumsum(window_counts(offsets))
    for k in range(0, int(ends[-1]) if len(ends) else 0, most):
        number = np.arange(k, min(k + most, int(ends[-1])))
        row = np.searchsorted(ends, number, "right")
        yield row, windows_at(data, offsets, row, number - np.where(row > 0, ends[row - 1], 0))


class ByteNet:
    """Embedding, one bank of filters as wide as the widest (narrower ones end in fixed zeros), and a dense layer."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, self.width = classes, max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.mask = np.repeat(np.array([[k < w for w in np.repeat(WIDTHS, FILTERS)] for k in range(self.width)], np.float32), EMBED, 0)
        self.weights = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": (rng.normal(0, 0.3, (self.width * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "dense": rng.normal(0, 0.2, (n, len(classes))).astype(np.float32),
            "shift": np.zeros(len(classes), np.float32),
        }

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, width * embedding): what each filter sees at each place."""
        e = self.weights["embed"][x]
        places = x.shape[1] - self.width + 1
        return np.concatenate([e[:, k : k + places] for k in range(self.width)], 2)

    def forward(self, x: np.ndarray):
        w, cols = self.weights, self.columns(x)
        out = (cols.reshape(-1, cols.shape[2]) @ w["filter"]).reshape(cols.shape[0], cols.shape[1], -1)
        best = out.argmax(1)
        pooled = np.maximum(np.take_along_axis(out, best[:, None], 1)[:, 0] + w["bias"], 0)
        return cols, best, pooled, self.softmax(pooled)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights["dense"] + self.weights["shift"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        """Class probabilities of windows, some at a time: the columns of each place times the filters, then the maxima."""
        w = self.weights
        out = np.empty((len(x), len(self.classes)), np.float32)
        for k in range(0, len(x), step):
            cols = self.columns(x[k : k + step])
            pooled = (cols.reshape(-1, cols.shape[2]) @ w["filter"]).reshape(cols.shape[0], cols.shape[1], -1).max(1)
            out[k : k + step] = self.softmax(np.maximum(pooled + w["bias"], 0))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        cols, best, pooled, p = self.forward(x)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"dense": pooled.T @ d, "shift": d.sum(0)}
        up = (d @ w["dense"].T) * (pooled > 0)
        g["bias"] = up.sum(0)
        seen = np.take_along_axis(cols, best[:, :, None], 1)  # (windows, filters, width * embedding)
        g["filter"] = np.einsum("nf,nfc->cf", up, seen) * self.mask
        back = (up[:, :, None] * w["filter"].T[None]).reshape(len(x), -1, self.width, EMBED)
        g["embed"] = np.zeros_like(w["embed"])
        at = best[:, :, None] + np.arange(self.width)
        np.add.at(g["embed"], np.take_along_axis(x[:, None, :], at.reshape(len(x), 1, -1), 2).reshape(at.shape), back)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = 0.01, seed: int = 1) -> ByteNet:
        """Adam over shuffled steps; classes weigh alike."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        each = max(1, int(len(y) / max(1, len(self.classes))))
        pool = np.concatenate([rng.choice(np.flatnonzero(y == c), each) if (y == c).any() else np.zeros(0, int) for c in range(len(self.classes))]).astype(int)
        t = 0
        for _ in range(passes):
            rng.shuffle(pool)
            for k in range(0, len(pool), STEP):
                t += 1
                part = pool[k : k + STEP]
                for name, g in self.gradients(x[part], y[part]).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.weights[name] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def training_windows(batches):
    """For mapInArrow over (label, text): up to `TRAIN_WINDOWS` evenly spaced windows of each text."""
    for piece in slices(batches, "text"):
        data, offsets = text_buffer(piece.column(1))
        counts = window_counts(offsets)
        row = np.repeat(np.arange(len(counts)), np.minimum(TRAIN_WINDOWS, counts))
        each = np.minimum(TRAIN_WINDOWS, counts)[row]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        x = windows_at(data, offsets, row, number * counts[row] // np.maximum(1, each))
        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "window"])


def fit(labelled: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "lang", most_rows: int = TRAIN_ROWS) -> ByteNet:
    """Trains on about `most_rows` labelled rows at the most, an equal part for each language, chosen by a hash of ids.

    The languages are those of all rows (few: they go to the driver); one with fewer rows than its part has them all, so
    a rare language is learned whatever the size of the table. No rows: no classes.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    each = most_rows / max(1, len(counts))
    share = F.element_at(F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, min(1.0, each / n)))), F.col("label")) if counts else F.lit(1.0)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000).select("label", "text")
    got = sample.mapInArrow(training_windows, "label string, window binary").toArrow().sort_by([("label", "ascending"), ("window", "ascending")])
    classes = sorted(counts)
    net = ByteNet(classes)
    if len(classes) > 1:
        x = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
        net.train(x, np.array([classes.index(c) for c in got["label"].to_pylist()]))
    return net


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, net: ByteNet, *, id: str = "doc_id", text: str = "text", unknown: str = "und") -> DataFrame:
    """`id`, lang_pred and score of every row, from all windows of the whole text.

    Texts that are null, empty or without letters, and all texts when nothing was learned, are `unknown` with score 0.
    Ties go to the first class by name; null and repeated ids stay, a row each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for piece in slices(batches, "text", 1 << 20):
            data, offsets = text_buffer(piece.column(1))
            counts = window_counts(offsets)
            known = np.array([has_letter(t) for t in piece.column(1).to_pylist()], bool) & (len(net.classes) > 0)
            total = np.zeros((len(counts), max(1, len(net.classes))))
            if net.classes:
                for row, x in cut(data, offsets):
                    np.add.at(total, row, net.predict(x))
            mean = total / np.maximum(1, counts)[:, None]
            best = mean.argmax(1)
            names = [net.classes[b] if k else unknown for b, k in zip(best, known, strict=True)]
            scores = np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)
