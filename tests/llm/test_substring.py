"""Substring deduplication against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substring


def plain(rows, size=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = defaultdict(lambda: float("inf"))
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - size + 1):
                least[tuple(w[k : k + size])] = min(least[tuple(w[k : k + size])], i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if least[tuple(w[k : k + size])] < i:
                    gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "é", "the", "of", " x", "longer", "Word,"]
    passage = [rnd.choice(words) + str(rnd.randrange(50)) for _ in range(60)]
    rows = [(None, " ".join(passage)), (10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "x\x0b" * 40), (10_003, "x\x0b" * 40), (-5, "same " * 30)]
    for k in range(150):
        w = [rnd.choice(words) + rnd.choice(["", str(rnd.randrange(3))]) for _ in range(rnd.choice([5, 12, 13, 14, 80, 300]))]
        if k % 3 == 0:
            a = rnd.randrange(40)
            w[3:3] = passage[a : a + rnd.choice([12, 13, 20])]
        rows.append((rnd.randrange(-50, 2000), rnd.choice([" ", "\n", "  \t"]).join(w)))
    rows.append((5000, " ".join(passage) + " z" * 3000))
    return rows


@pytest.mark.parametrize("part_bytes,batches,seed", [(1 << 30, (0.25,), 1), (3000, (), 2), (3000, (0.25,), 3), (2000, (0.2, 0.4, 0.5, 0.6, 0.7, 0.9), 4)])
def test_against_brute_force(spark, part_bytes, batches, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("_id", F.lit("other"))
    got = substring.deduplicate(docs, part_bytes=part_bytes, batches=batches)
    assert got.columns == ["doc_id", "text", "_id", "n_words", "n_removed", "kept"]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_empty(spark):
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_lossless():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (substring.expand(substring.squeeze(x)) == x).all()
    assert (substring.expand(substring.squeeze(np.array([0, 2**64 - 1], np.uint64))) == np.array([0, 2**64 - 1], np.uint64)).all()


def test_unconfirmed_matches_are_dropped():
    fps, check = [np.array([1, 5], np.uint64), np.array([1, 5], np.uint64)], [np.array([7, 8], np.uint8), np.array([7, 9], np.uint8)]
    assert substring.merge_runs([0, 1], fps, check)[4].tolist() == [False, True, False, False]


def test_index_is_reopened_and_compacted(spark, tmp_path):
    """A table that comes in three jobs, each with the folder alone, loses what it would lose at once; runs are merged."""
    rows = sorted((r for r in corpus(9) if r[0] is not None), key=lambda r: r[0])
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    cuts = [next((k for k in range(c, len(rows)) if not c or rows[k][0] != rows[k - 1][0]), len(rows)) for c in cuts]
    folder, got = str(tmp_path / "index"), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        docs = spark.createDataFrame(rows[a:b], "doc_id long, text string")
        found = substring.deduplicate(docs, part_bytes=4000, batches=(0.5,), index=folder, keep_last=True)
        got += [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()]
        index = substring.SubstringIndex(spark, folder, buckets=64)
        assert 1 <= len(index.runs) <= 2 and index.buckets == 1
    assert sorted(got, key=lambda r: (r[0], r[3])) == sorted(plain(rows), key=lambda r: (r[0], r[3]))
    windows = {tuple(w[k : k + 13]) for i, t in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for k in range(len(w) - 12)}
    held = [len(substring.expand(r.fps)) for r in index.history().collect()]
    assert sum(held) == len(windows)


def test_a_dead_job_leaves_the_index_as_it_was(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "p q r s t u v w x y z a b c")], "doc_id long, text string")
    substring.deduplicate(docs, batches=(), index=str(tmp_path / "i"), keep_last=True).count()
    (tmp_path / "i" / "manifest" / "2").mkdir()  # a version that was begun
    assert substring.SubstringIndex(spark, str(tmp_path / "i")).version == 1


def test_the_check_is_independent_of_the_fingerprint():
    """Words that collide in one hash don't in the other: each is made from the bytes with a base of its own."""
    import pyarrow as pa

    from tidemark.llm.common import OTHER_BASE, text_buffer, word_hashes, word_spans

    data, offsets = text_buffer(pa.array(["alpha beta gamma alpha"]))
    starts, ends, _ = word_spans(data, offsets)
    one, two = word_hashes(data, starts, ends), word_hashes(data, starts, ends, base_number=OTHER_BASE)
    assert one[0] == one[3] and two[0] == two[3] and not set(one.tolist()) & set(two.tolist())
