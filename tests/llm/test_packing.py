"""Buckets against all possible splits, batches against their rules."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.packing import MAX_LENGTH, boundaries, pack
from tidemark.llm.q06_packing import op6_packing
from tidemark.llm.token_counts import tokenizer_path


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 9, rng.integers(1, 13)) * rng.integers(0, 2)
    used, k = np.flatnonzero(counts).tolist(), int(rng.integers(1, 5))
    ends, padding = boundaries(counts, k)
    if not used:
        assert ends == [] and padding == 0
        return
    cost = lambda ends: sum(int(counts[n]) * (min(e for e in ends if e >= n) - n) for n in used)
    best = min(cost([*c, used[-1]]) for m in range(min(k, len(used))) for c in combinations(used[:-1], m))
    assert cost(ends) == padding == best and len(ends) <= k and ends[-1] == used[-1]


def test_pack(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(n))) for k, n in enumerate(rng.integers(0, 60, 400))] + [(None, None), (None, "a b"), (7, "a b c"), (7, "a b c"), (1000, "x " * 333)] + [(2000 + k, "one two") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("_n", F.lit(1))
    got = pack(docs, max_length=50, buckets=4, budget=200, shard=37).collect()
    want = Counter()
    for i, t in rows:
        n = len((t or "").split())
        want.update((i, p, min(50, n - 50 * p)) for p in range(max(1, -(-n // 50))))
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == want
    counts = np.bincount([r.n_tokens for r in got])
    assert sorted({r.bucket for r in got}) == boundaries(counts, 4)[0]
    by = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket
        by[r.bucket, r.batch].append(r.slot)
    for (bucket, batch), slots in by.items():
        each = max(1, 200 // max(1, bucket))
        last = max(b for e, b in by if e == bucket)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == each or batch == last and len(slots) < each)
    assert pack(docs.limit(0)).count() == 0


def test_query_packs_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "日本語の文章" * 900), (2, "unbelievably, it's"), (2, "x" * 50), (None, "a b"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    encode, want = Tokenizer.from_file(tokenizer_path()).encode, Counter()
    for i, t in rows:
        n = len(encode(t or "", add_special_tokens=False))
        want.update((i, p, min(MAX_LENGTH, n - MAX_LENGTH * p)) for p in range(max(1, -(-n // MAX_LENGTH))))
    assert want[1, 1, MAX_LENGTH]
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in op6_packing(spark, str(tmp_path)).collect()) == want
