"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits have a common variant that is within 2 bits of both. Every distinct fingerprint is
dealt to the buckets (leading bits) that its variants fall into; there the variants are listed and sorted, and those
that several fingerprints share give the colliding pairs, which are verified. The shuffle so carries a fingerprint once
a bucket, not once a variant, and the number of leading bits follows the number of fingerprints.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import collision_free, few_files, give_back, sent_if_small, shared_path, slices, text_buffer
from tidemark.llm.components import components, local_roots, split_evenly

#: Bits of a fingerprint, the linking radius, and the variants that a bucket lists at once.
BITS, RADIUS, LISTED = 64, 4, 1_000_000


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, A-Z lower-cased, repeats included."""
    words = raw.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, len(words) - size + 1)


def fingerprint(raw: bytes, size: int = 4) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; 0 without words."""
    h = shingle_hashes(raw, size)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 15):
        votes += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(`id`, fp) of every row; a null text has no words."""

    def run(batches):
        for piece in slices(batches, "text"):
            data, offsets = text_buffer(piece.column(1))
            fps = np.array([fingerprint(data[a:b].tobytes(), size) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id)


def masks(bits: int, most: int) -> list[int]:
    """All patterns of `bits` bits with at most `most` set."""
    return [sum(1 << k for k in x) for n in range(most + 1) for x in combinations(range(bits), n)]


def collisions(fps: np.ndarray, bucket: int, depth: int, radius: int = RADIUS, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, smallest that shares a variant with it) for the variants whose `depth` leading bits are `bucket`.

    A bucket with many fingerprints is cut by its next bits, one part after the other, so its memory stays bounded.
    """
    half, rest = radius // 2, BITS - depth
    lead = fps >> np.uint64(rest) if depth else np.zeros_like(fps)
    flips = np.bitwise_count(lead ^ np.uint64(bucket)).astype(np.int64)
    fps, flips = fps[flips <= half], flips[flips <= half]
    sizes = [sum(math.comb(rest, k) for k in range(half - d + 1)) for d in range(half + 1)]
    total = sum(int((flips == d).sum()) * sizes[d] for d in range(half + 1))
    if len(fps) < 2 or not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if total > listed and rest > 8:
        parts = [collisions(fps, bucket << 4 | k, depth + 4, radius, listed) for k in range(16)]
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(2))
    tail = fps & np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for d in range(half + 1):
        own = np.flatnonzero(flips == d)
        m = np.array(masks(rest, half - d), np.uint64)
        variants.append((tail[own][:, None] ^ m).ravel())
        owners.append(np.repeat(fps[own], len(m)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    counts = np.diff(np.append(first, len(variants)))
    shared = counts > 1
    least = np.repeat(np.minimum.reduceat(owners, first)[shared], counts[shared])
    members = owners[np.repeat(shared, counts)]
    differ = members != least
    u, v = members[differ], least[differ]
    near = np.bitwise_count(u ^ v) <= radius
    return u[near], v[near]


def links(distinct: DataFrame, *, radius: int = RADIUS, listed: int = LISTED) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (fp) that keep all that are within `radius` bits connected.

    Edges are forests of stars, one per bucket, so a cluster gives as many edges as it has members a bucket.
    """
    if radius % 2:
        raise ValueError("the radius is even: both sides take half of it")
    n = distinct.count()
    variants = sum(math.comb(BITS, k) for k in range(radius // 2 + 1))
    depth = min(24, max(0, math.ceil(math.log2(max(1, n * variants / listed)))))

    def run(key, table):
        u, v = collisions(table.column("fp").to_numpy().view(np.uint64), key[0].as_py(), depth, radius, listed)
        nodes, roots = local_roots(u.view(np.int64), v.view(np.int64)) if len(u) else (np.zeros(0, np.int64),) * 2
        del u, v, table
        give_back()
        return pa.table({"u": nodes[nodes != roots], "v": roots[nodes != roots]})

    lead = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    near = F.explode(F.array(*(F.lit(m).cast("long") for m in masks(depth, radius // 2))))
    dealt = distinct.select("fp", near.alias("flip")).select(lead.bitwiseXOR(F.col("flip")).alias("bucket"), "fp")
    return dealt.groupBy("bucket").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 4, radius: int = RADIUS) -> DataFrame:
    """`id`, fp (long) and component_id (the smallest id reachable over links) of every row.

    Texts without words (null and empty ones) have fingerprint 0 and link like others. Rows with a null id link too,
    but lend no id: a component without any id has a null component_id. Repeated rows stay, a row each; other columns
    are ignored; an empty table gives an empty result. Copies share a fingerprint and so cost one node.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "fingerprints")
    fingerprints(docs, id=id, text=text, size=size).write.parquet(path)
    prints = spark.read.parquet(path)
    distinct = prints.groupBy("fp").agg(F.min(id).alias("least"))
    nodes, n = shared_path(spark, "nodes"), prints.count()
    few_files(distinct, n).write.parquet(nodes)
    distinct = spark.read.parquet(nodes)
    found = components(links(distinct.select("fp"), radius=radius), n)
    return prints.join(name_components(distinct, found), "fp").select(id, "fp", "component_id")


def name_components(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component_id) of every fp from (fp, least) and the (node, root) of those with links.

    The least ids of the roots are dealt anew before they are joined back, so that a root that a third of all fps share
    can be split; so is the result, for a join on fp that can split an fp of many copies.
    """
    rooted = distinct.select("fp", "least").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return split_evenly(rooted.select("fp", "root").join(split_evenly(least, "root"), "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", find=near_duplicates, prints=fingerprints) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest id stays.

    `find` gives the components and `prints` the fingerprints they are made of; by default those of SimHash.

    Repeated rows of that id count as one. Rows without an id go if their component has one with an id; a component
    without any id stays whole, as its rows can't be told apart. Ids to drop are sent to the texts while there are few
    (they are counted), so that no text is shuffled.
    """
    spark = docs.sparkSession
    path, other = shared_path(spark, "components"), collision_free(docs, "other")
    few_files(find(docs, id=id, text=text), docs.count()).write.parquet(path)
    found = spark.read.schema(f"`{id}` {docs.schema[id].dataType.simpleString()}, fp long, component_id {docs.schema[id].dataType.simpleString()}").parquet(path)
    named = found.where(F.col(id).isNotNull())
    gone = named.where(F.col(id) != F.col("component_id")).select(F.col(id).alias(other)).distinct()
    kept = docs.join(sent_if_small(gone), docs[id] == F.col(other), "left_anti")
    again = named.where(F.col(id) == F.col("component_id")).groupBy(id).count().where("count > 1").select(F.col(id).alias(other))
    if again.take(1):
        once = kept.join(again, kept[id] == again[other], "left_semi").dropDuplicates([id])
        kept = kept.join(again, kept[id].eqNullSafe(again[other]), "left_anti").unionByName(once)
    if found.where(F.col(id).isNull() & F.col("component_id").isNotNull()).take(1):
        kept = _drop_unnamed(kept, found, id, text, prints)
    return kept


def _drop_unnamed(kept: DataFrame, found: DataFrame, id: str, text: str, prints) -> DataFrame:
    """Rows without an id are told by their texts: those whose fingerprint is in a component with an id go."""
    covered = found.where(F.col("component_id").isNotNull()).select("fp").distinct()
    unnamed = kept.where(F.col(id).isNull())
    texts = unnamed.select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
    gone = prints(texts, id="digest").join(covered, "fp", "left_semi").select("digest")
    stay = unnamed.join(gone, F.sha2(unnamed[text], 256).eqNullSafe(gone["digest"]), "left_anti").select(kept.columns)
    return kept.where(F.col(id).isNotNull()).unionByName(stay)
