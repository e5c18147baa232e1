"""Helpers shared by the corpus operators: the shared folder, Arrow text slices, vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the word pattern [^\x20\x09-\x0D]+, by byte.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Another one, for hashes that are to be independent of the first.
OTHER_BASE = 0xC2B2AE3D27D4EB4F
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):  # arrays of 2 MB or more go back to the system when they are freed, others soon after
    _libc.mallopt(-3, 2 << 20)
    _libc.mallopt(-1, 4 << 20)
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, local mode gets one of its own; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def few_files(frame: DataFrame, rows: int, each: int = 500_000) -> DataFrame:
    """A frame of about `rows` small rows for writing: a file for each core, or for `each` rows where that is more.

    The last stage so takes one wave of tasks at least, and a table of a few MB is not one file a shuffle partition.
    """
    return frame.coalesce(max(1, frame.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def write_and_clear(frame: DataFrame, path: str) -> None:
    """Writes a frame; the files that it was shuffled through are deleted at the end of the job, not at some later time."""
    conf, key = frame.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        frame.write.parquet(path)
    finally:
        conf.set(key, before)


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column, modulus: int):
    """crc32 of an id as text, modulo: the split rule of the learning queries."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its tasks, and what one stage held would stay with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, column: str, most: int = 1 << 20, rows: int = 4096):
    """Cuts record batches so that the texts of each piece have about `most` bytes, in `rows` rows at the most; a longer
    text stands alone. What the piece before has left is returned before the next is cut, once so many bytes are used up."""
    used = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at, base = 0, 0
        while at < len(ends):
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + most, "right"))))
            yield batch.slice(at, stop - at)
            used += int(ends[stop - 1]) - base
            at, base = stop, int(ends[stop - 1])
            if used > 4 * most:
                used = 0
                give_back()
        del batch, texts
        give_back()


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and the offsets of its rows."""
    array = pc.fill_null(array, "") if array.null_count else array
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def _powers_of(by: int, n: int) -> np.ndarray:
    if len(_powers.get(by, ())) < n:
        full = np.full(max(n, (1 << 18) + 1), by, np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            _powers[by] = np.cumprod(full, dtype=np.uint64)
    return _powers[by][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18, base_number: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums over blocks of bytes: a few passes, in bounded memory."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(base_number, -1, 1 << 64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + block, "right")))
        part = data[base : int(ends[stop - 1])]
        up, down = _powers_of(base_number, len(part) + 1), _powers_of(inverse, len(part) + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
            first, last = starts[at:stop] - base, ends[at:stop] - base
            out[at:stop] = mix((prefix[last] - prefix[first]) * down[first] + (last - first).astype(np.uint64))
        at = stop
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` consecutive entries (across rows too; callers mask those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * np.uint64(BASE) + words[k : k + n]
        return mix(total)


def collision_free(x: DataFrame, base: str) -> str:
    """A column name not yet in the frame, so that inputs may carry any extra columns."""
    taken = {c.lower() for c in x.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def sent_if_small(keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A frame of ids, marked for broadcast after counting if it has at most `most` rows (about 100 MB of them)."""
    return F.broadcast(keys) if keys.count() <= most else keys


def with_labels(docs: DataFrame, labels: DataFrame, id: str, most_sent: int = 2_000_000) -> DataFrame:
    """Inner join on `id`: up to `most_sent` labels, which are counted first, go to the texts, so no text is shuffled."""
    return docs.join(sent_if_small(labels, most_sent), id)


def bounded_sample(rows: DataFrame, id: str, most: int) -> DataFrame:
    """About `most` rows at the most, chosen by a hash of their ids; all rows while there are no more than that."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id), F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches; bounds has one more entry than there are stretches."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 50, offset: np.ndarray | float = 0.0) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic curve by Newton's method; `offset` is what else the curve's argument has."""
    a, b = 0.0, 0.0
    if not len(x):
        return 1.0, 0.0
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w + offset, -30, 30)))
        g = z.T @ (y - p) - ridge * len(x) * w * np.array([1, 0])
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(2)
        w = w + np.linalg.solve(h, g)
    a = w[0] / scale
    b = w[1] - a * mean
    return float(a), float(b)
