"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_path, slices, text_buffer
from tidemark.llm.webp import decode, encode_grey

#: Pixels in a row, and in an image: a longer payload becomes several images one after the other.
WIDTH, MOST = 64, 1 << 18


def payload_of(raw: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of the width."""
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def store(raw: bytes) -> bytes:
    """The stored form of a text: WebP files of up to `MOST` grey pixels, joined."""
    samples = np.frombuffer(payload_of(raw), np.uint8)
    return b"".join(encode_grey(samples[k : k + MOST], WIDTH) for k in range(0, len(samples), MOST))


def load(media: bytes) -> bytes:
    """The payload of a stored form: the green samples of its images."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        pixels = decode(media[at : at + size])[2]
        out.append((pixels >> np.uint32(8)).astype(np.uint8).tobytes())
        at += size
    return b"".join(out)


def feature_of(payload: bytes) -> str:
    """16 hex digits: for each of 64 equal parts of the pixels, whether its mean is above that of the whole."""
    parts = np.frombuffer(payload, np.uint8).reshape(64, -1)
    bits = np.packbits(parts.sum(1, dtype=np.int64) * 64 > parts.sum(dtype=np.int64))
    return bits.tobytes().hex()


def store_texts(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, n_bytes (UTF-8) and media (the stored form) of every row; a null text counts as empty.

    Nothing is shuffled. Repeated rows and null ids stay, a row each; an empty text is one row of zero pixels; texts
    of any length are cut into images of bounded size, so a task's memory doesn't follow the longest text.
    """

    def run(batches):
        for piece in slices(batches, "text"):
            data, offsets = text_buffer(piece.column(1))
            media = [store(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id)


def read_pixels(stored: DataFrame, *, media: str = "media") -> DataFrame:
    """All columns, and pixels (the grey samples of the stored images) and feature. A null media gives nulls."""

    def run(batches):
        for piece in slices(batches, media, 1 << 20):
            names = piece.schema.names
            found = [None if m is None else load(m) for m in piece.column(names.index(media)).to_pylist()]
            more = [pa.array(found, pa.binary()), pa.array([None if p is None else feature_of(p) for p in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*piece.columns, *more], [*names, "pixels", "feature"])

    kept = [f for f in stored.schema.fields if f.name.lower() not in ("pixels", "feature")]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return stored.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, f"{columns}, pixels binary, feature string")


def stored_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The media of `docs` as a table in the shared folder, read back from it."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "media")
    store_texts(docs).write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)
