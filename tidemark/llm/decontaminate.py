"""Benchmark decontamination: documents that hold a passage like a benchmark item, by DataFrame functions alone.

1. Item shingles (five words) meet document shingles in a join; a document and an item are looked at if the item's
   shingles found anywhere in the document, each with its repeats in the item, have the weight that the similarity
   needs at least, which no true pair fails. Windows of the item's size are laid where those shingles align.
2. Every window gets a weighted SimHash, as every item has.
3. Multi-index blocks: fingerprints within `RADIUS` bits agree on one of `RADIUS + 1` blocks, so an equality join on
   (item, block, value) returns all of them; of what it returns only windows within `RADIUS` bits go on.
4. The weighted Jaccard similarity of the window's and the item's shingles, with repeats, decides.

Shingles are counted in rows (window, shingle, count), so the work grows with the words, not with their square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import collision_free, few_files, sent_if_small, shared_path

#: Words of a shingle, similarity from which a window counts, bits that fingerprints may differ in. Of 15,000 windows of
#: 0.8 or more (items of 8 to 60 words, one or two words changed) 99 % were within 14 bits and 99.9 % within 17.
SHINGLE, SIMILAR, RADIUS = 5, 0.8, 18
#: Most item shingles that are sent to every executor; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: ASCII signs that act as spaces between words.
SIGNS = "".join(chr(k) for k in range(1, 128) if not chr(k).isalnum() and k != 32)


def words_of(text: Column) -> Column:
    """Lower-case words; ASCII signs and controls separate them. A null text has none."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), SIGNS, " " * len(SIGNS))
    return F.array_remove(F.split(spaced, " "), "")


def shingles_of(words: Column, size: Column | int) -> Column:
    """Hashes of the runs of `size` words, in order; none where there are fewer words."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.xxhash64(F.slice(words, k, size)))).otherwise(F.array().cast("array<bigint>"))


def weighed(h: str, weight: Column) -> Column:
    """An aggregate: the shingles of a group with their weights in millionths, whole numbers that add up in any order."""
    return F.collect_list(F.struct(F.col(h).alias("h"), F.round(weight * 1_000_000).cast("long").alias("w")))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of weighed hashes: bit b is set where the hashes that have it weigh more than the others."""

    def bit(b):
        signed = F.aggregate(hashes, F.lit(0).cast("long"), lambda total, x: total + x["w"] * (F.call_function("shiftright", x["h"], b).bitwiseAND(F.lit(1)) * 2 - 1))
        return F.when(signed > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda total, b: total.bitwiseOR(bit(b)))


def blocks_of(fp: Column, radius: int = RADIUS) -> Column:
    """(block, value) of the radius + 1 blocks of a fingerprint, of nearly equal widths."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    values = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return F.array(*values)


def benchmark_items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame, float]:
    """Items, their shingles, and the weight of a shingle that no item has.

    Items: (item, version, size of a shingle, wide (number of shingles), need (their weight), fp), a version for each
    text of an item. Shingles: (item, version, size, h, places, c (their number), w (rarity among the items)).
    """
    spark = benchmark.sparkSession
    words = words_of(F.col(text))
    found = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), words.alias("words")).where(F.size("words") > 0)
    found = found.withColumn("size", F.least(F.lit(SHINGLE), F.size("words"))).select("item", "size", shingles_of(F.col("words"), F.col("size")).alias("hashes"))
    path = shared_path(spark, "item-texts")
    rows = 100 * benchmark.count()
    few_files(found.dropDuplicates(["item", "hashes"]), rows).withColumn("version", F.monotonically_increasing_id()).write.parquet(path)
    found = spark.read.parquet(path)
    n = max(1, found.select(F.count_distinct("item")).first()[0])
    each = found.select("item", "version", "size", F.posexplode("hashes").alias("at", "h")).groupBy("item", "version", "size", "h").agg(F.collect_list("at").alias("places"))
    rarity = each.groupBy("h").agg(F.log(1 + n / F.count_distinct("item")).alias("w"))
    path = shared_path(spark, "item-shingles")
    few_files(each.join(rarity, "h").withColumn("c", F.size("places")), rows).write.parquet(path)
    shingles = spark.read.schema(f"h long, item {benchmark.schema[item].dataType.simpleString()}, version long, size int, places array<int>, w double, c int").parquet(path)
    path = shared_path(spark, "items")
    weight = F.col("c") * F.col("w")
    found = shingles.groupBy("item", "version", "size").agg(F.sum("c").cast("int").alias("wide"), F.sum(weight).alias("need"), weighed("h", weight).alias("all"))
    few_files(found, rows).withColumn("fp", simhash(F.col("all"))).drop("all").write.parquet(path)
    return spark.read.parquet(path), shingles, math.log(1 + n)


def meetings(docs: DataFrame, items: DataFrame, shingles: DataFrame, similar: float, send) -> DataFrame:
    """(id, item, version) where item shingles of enough weight are anywhere in the document."""
    probe = shingles.select("item", "version", "size", "h", (F.col("c") * F.col("w")).alias("w"))
    found = None
    for size in [r["size"] for r in items.select("size").distinct().collect()]:  # 1 to SHINGLE
        worded = docs.select("id", words_of(F.col("text")).alias("words"))  # a step of its own: the words are used many times
        hashes = worded.select("id", F.explode(shingles_of(F.col("words"), size)).alias("h"))
        met = hashes.join(send(probe.where(F.col("size") == size).drop("size")), "h").groupBy("id", "item", "version", "h").agg(F.first("w").alias("w"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.select("id").join(items.select("item", "version"), F.lit(False))
    summed = found.groupBy("id", "item", "version").agg(F.sum("w").alias("w"))
    return summed.join(send(items.select("item", "version", "need")), ["item", "version"]).where(F.col("w") >= similar * F.col("need") - 1e-9).select("id", "item", "version")


def windows_of(docs: DataFrame, pairs: DataFrame, rows: int, items: DataFrame, shingles: DataFrame, send) -> DataFrame:
    """(wid, id, item, version, start, h, n, w, c): the shingles of every window, each with its number in the window, its
    weight and its number in the item (nulls where the item hasn't it). A table in the shared folder."""
    spark = docs.sparkSession
    path = shared_path(spark, "near-texts")
    keys = sent_if_small(pairs.select(F.col("id").alias("key")).distinct())
    near = docs.join(keys, F.col("id").eqNullSafe(F.col("key")), "left_semi").select("id", words_of(F.col("text")).alias("words"))
    sizes = F.array(*(F.lit(r["size"]) for r in items.select("size").distinct().collect())).cast("array<int>")
    near = near.select("id", "words", F.explode(sizes).alias("size")).select("id", "size", shingles_of(F.col("words"), F.col("size")).alias("own")).where(F.size("own") > 0)
    near.write.parquet(path)  # as many tasks as the scan has: most find nothing and write no file
    near = spark.read.schema(f"id {docs.schema['id'].dataType.simpleString()}, size int, own array<bigint>").parquet(path)
    wide = items.select("item", "version", "wide")
    at = near.select("id", "size", F.size("own").alias("many"), F.posexplode("own").alias("k", "h")).join(send(shingles.select("item", "version", "size", "h", "places")), ["size", "h"])
    at = at.join(pairs.withColumnRenamed("id", "key").withColumnsRenamed({"item": "i", "version": "v"}), F.col("id").eqNullSafe(F.col("key")) & (F.col("item") == F.col("i")) & (F.col("version") == F.col("v")), "left_semi")
    at = at.join(send(wide), ["item", "version"]).select("id", "size", "item", "version", "wide", "many", F.explode("places").alias("j"), "k")
    start = F.greatest(F.lit(0), F.least(F.col("k") - F.col("j"), F.col("many") - F.col("wide")))
    starts = at.select(F.col("id").alias("key"), F.col("size").alias("s"), "item", "version", "wide", start.alias("start")).distinct()
    path, cells = shared_path(spark, "windows"), shared_path(spark, "cells")
    both = starts.join(near, F.col("key").eqNullSafe(F.col("id")) & (F.col("s") == F.col("size")))
    both = both.select("id", "item", "version", "start", F.slice("own", F.col("start") + 1, F.col("wide")).alias("window"))
    few_files(both, 4 * rows, 100_000).withColumn("wid", F.monotonically_increasing_id()).write.parquet(path)
    each = spark.read.parquet(path).select("wid", "id", "item", "version", "start", F.explode("window").alias("h"))
    each = each.groupBy("wid", "id", "item", "version", "start", "h").agg(F.count(F.lit(1)).alias("n"))
    few_files(each.join(send(shingles.select("item", "version", "h", "w", "c")), ["item", "version", "h"], "left"), 100 * rows).write.parquet(cells)
    return spark.read.parquet(cells)


def within_radius(windows: DataFrame, items: DataFrame, radius: int, send) -> DataFrame:
    """The wid of the windows (wid, item, version, fp) within `radius` bits of their item, found by their blocks."""
    left = windows.select("wid", "item", "version", "fp", F.explode(blocks_of(F.col("fp"), radius)).alias("b")).select("wid", "item", "version", "fp", "b.block", "b.value")
    right = items.select("item", "version", F.col("fp").alias("item_fp"), F.explode(blocks_of(F.col("fp"), radius)).alias("b")).select("item", "version", "item_fp", "b.block", "b.value")
    met = left.join(send(right), ["item", "version", "block", "value"])
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("wid").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similar: float = SIMILAR, radius: int = RADIUS, most_sent: int = MOST_SENT) -> DataFrame:
    """(`id`, `item`, start, similarity): the best window of each document and item that are similar enough.

    start is the window's first word (from 1). Texts are compared whole, by lower-case words. Items without words and
    items without an id match nothing; shorter items than a shingle are a shingle of their own size. A document with a
    null id is reported under null; rows that share an id are each searched and reported as one. Repeated items under
    one id count as one; other columns are ignored; empty tables give an empty result. Tables of the benchmark are sent
    to the executors while it has at most `most_sent` shingles, which are counted; beyond that joins shuffle.
    """
    items, shingles, other = benchmark_items(benchmark, item, item_text)
    few = shingles.count() <= most_sent
    send = F.broadcast if few else lambda frame: frame
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    path = shared_path(docs.sparkSession, "pairs")
    few_files(meetings(docs, items, shingles, similar, send), docs.count()).write.parquet(path)
    pairs = docs.sparkSession.read.parquet(path)
    cells = windows_of(docs, pairs, pairs.count(), items, shingles, send)
    weight = F.coalesce("w", F.lit(other))
    prints = cells.groupBy("wid", "item", "version").agg(weighed("h", F.col("n") * weight).alias("all")).select("wid", "item", "version", simhash(F.col("all")).alias("fp"))
    near = cells.join(sent_if_small(within_radius(prints, items, radius, send)), "wid", "left_semi")
    sums = near.groupBy("wid", "id", "item", "version", "start").agg(F.sum(F.col("n") * weight).alias("own"), F.sum(weight * F.least("n", F.coalesce("c", F.lit(0)))).alias("both"))
    met = sums.join(send(items.select("item", "version", "need")), ["item", "version"]).withColumn("similarity", F.col("both") / (F.col("own") + F.col("need") - F.col("both")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    found = met.where(F.col("similarity") >= similar - 1e-12).groupBy("id", "item").agg(best)
    return found.select(F.col("id").alias(id), F.col("item").alias(item), (1 - F.col("best.back")).cast("int").alias("start"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id holds no leak, all columns; leaking ids are sent to the texts while there are few.

    Rows that share an id go together; null and empty texts hold no leak; empty tables drop nothing.
    """
    path, leaked = shared_path(docs.sparkSession, "leaks"), collision_free(docs, "leaked")
    few_files(leaks(docs, benchmark, id=id, text=text).select(F.col(id).alias(leaked)).distinct(), docs.count()).write.parquet(path)
    gone = docs.sparkSession.read.schema(docs.select(F.col(id).alias(leaked)).schema).parquet(path)
    return docs.join(sent_if_small(gone), docs[id].eqNullSafe(F.col(leaked)), "left_anti")
