"""Spelling variants against all pairs of a small vocabulary, and the query against a plain reading of its rule."""

import random
import re
import zlib
from collections import Counter

from tidemark.llm import spelling
from tidemark.llm.q12_spelling import op12_spelling_variants

WORDS = "word string, n long"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    rows = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        rows[w] = (n, best if best and counts[best] >= ratio * n else None, len(others))
    ends = {}
    for w in rows:
        at = w
        while rows[at][1]:
            at = rows[at][1]
        ends[w] = at
    return sorted((w, n, f, f and counts[f], k, ends[w]) for w, (n, f, k) in rows.items())


def test_against_all_pairs(spark):
    draw = random.Random(5)
    letters = "abé"
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 9))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "bababa", "bababab", "ababab"]
    for w in list(base):
        for _ in range(4):
            i, c = draw.randrange(len(w) + 1), draw.choice("abéz")
            base.append(draw.choice((w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :])))
    counts = {w: draw.choice((5, 6, 25, 30, 130, 700, 9000)) for w in base if len(w) >= 6}
    got = spelling.variants(spark.createDataFrame(sorted(counts.items()), WORDS))
    assert got.columns == ["word", "n", "form", "form_n", "n_near", "root"]
    assert sorted(map(tuple, got.collect())) == brute(counts)


def test_chains_ties_and_lone_words(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "cccccc": 5, "cccccd": 30, "ccccce": 30, "lonely": 9}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(sorted(counts.items()), WORDS)).collect()}
    assert got["aaaaaa"].root == got["aaabbb"].root == "aabbbb" and got["aabbbb"].form is None
    assert (got["cccccc"].form, got["cccccc"].n_near) == ("cccccd", 2)  # of two equally frequent ones the smaller
    assert (got["lonely"].n_near, got["lonely"].root, got["lonely"].form_n) == (0, "lonely", None)
    assert spelling.variants(spark.createDataFrame([], WORDS)).count() == 0


def test_a_bigram_that_all_words_share(spark):
    draw = random.Random(6)
    counts = {"zq" + "".join(draw.choice("abcdefgh") for _ in range(6)): 5 for _ in range(1500)}
    pairs = spelling.near_pairs(spark.createDataFrame(sorted(counts.items()), WORDS))
    words = sorted(counts)
    assert sorted((r.u, r.v) for r in pairs.collect()) == [(a, b) for a in words for b in words if a < b and near(a, b)]


def rule(rows):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_query_on_odd_rows(spark, tmp_path):
    draw = random.Random(7)
    some = ["Straße", "straße", "ÉCOLES", "École", "lettres", "letters", "lettre", "ab", "×÷ßñññ", "naïveté", "x1y2z3", "wordwide,wordwide", "İstanbul"]
    rows = [(k, " ".join(draw.choice(some) for _ in range(60))) for k in range(40)]
    rows += [(3, rows[3][1]), (None, "letters " * 9), (None, None), (41, ""), (42, None), (43, "letters" * 20_000), (44, "Letters " * 60_000)]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, run string, word int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op12_spelling_variants(spark, str(tmp_path)).collect())) == brute(rule(rows))


def test_what_grows_with_the_vocabulary_is_not_sent(spark):
    """Whatever Spark takes the tables to be: only the counts of bigrams, which the alphabet bounds, may go through the driver."""
    draw = random.Random(8)
    words = spark.createDataFrame([("".join(draw.choice("abcd") for _ in range(7)) + str(k), 5 + k) for k in range(300)], WORDS)
    for frame, sent in ((spelling.near_pairs(words), 1), (spelling.variants(words), 0)):
        frame.collect()
        assert frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastHashJoin") == sent
