"""SimHash components against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components, local_roots


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(ids.get(find(k), i), i)
    return [(i, fps[k], ids.get(find(k))) for k, (i, _) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = [(None, None), (None, "lonely words without any id here"), (900, ""), (901, " \n"), (902, "one"), (903, "ONE"), (903, "one"), (904, "É é two")]
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 400]))]
        for c in range(rnd.choice([1, 1, 2, 6])):
            text = base[:]
            for _ in range(c):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((k * 10 + c, " ".join(text)))
    rows.append((5, "x " * 50_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs)
    want = plain_components(rows)
    assert key((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got.collect()) == key(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    named = {c for _, _, c in want if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(named)
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["lonely words without any id here"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_collisions_find_all_links_at_any_depth():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    links = {(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    want = local_roots(*(fps[np.array([x[k] for x in links])] for k in range(2)))
    for depth, listed in ((0, 1 << 30), (3, 1 << 30), (5, 20_000), (0, 3_000)):
        parts = [simhash.collisions(fps, b, depth, listed=listed) for b in range(1 << depth)]
        got = local_roots(*(np.concatenate([p[k] for p in parts]) for k in range(2)))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 140)}, 300: 299, 299: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_hot_node_with_many_neighbours(spark):
    star = spark.range(1, 100_001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    got = components(star.unionByName(spark.range(200_000, 200_003).selectExpr("id as u", "5 as v")))
    assert got.count() == 100_004 and got.where("root != 0").count() == 0


def test_keep_one_with_clashing_names_and_repeated_rows(spark):
    rows = [(1, "one two three four five"), (1, "one two three four five"), (2, "ONE two three four five"), (3, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_gone", "_again", "_other", "component_id"):
        docs = docs.withColumn(name, F.lit(name))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
