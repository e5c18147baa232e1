"""Decontamination against brute force over every window of every document."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm.decontaminate import clean, leaks, within_radius


def words(text):
    return re.sub(r"[^0-9a-z\u0080-￿]+", " ", (text or "").lower()).split()


def shingles(w, size):
    return [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]


def plain(docs, items):
    items = {i: words(t) for i, t in items if i is not None and words(t)}
    own = {i: shingles(w, min(5, len(w))) for i, w in items.items()}
    df = Counter(s for x in own.values() for s in set(x))
    weight = lambda s: math.log(1 + len(items) / df[s]) if df[s] else math.log(1 + len(items))
    best = defaultdict(float)
    for d, t in docs:
        w = words(t)
        for i, want in own.items():
            got = shingles(w, len(want[0]))
            for k in range(max(1, len(got) - len(want) + 1)):
                a, b = Counter(got[k : k + len(want)]), Counter(want)
                both = sum(weight(s) * min(a[s], b[s]) for s in a | b), sum(weight(s) * max(a[s], b[s]) for s in a | b)
                best[d, i] = max(best[d, i], both[0] / both[1])
    return {k: round(v, 9) for k, v in best.items() if v >= 0.8}


def test_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["the", "of", "and"] * 30 + [f"w{k}é" for k in range(200)]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(make(rnd.choice([3, 5, 16, 30, 59])))) for k in range(25)] + [(90, ""), (91, None), (None, "one two three four five six"), (92, "the of and the of and the of and the of"), (93, "zz " * 20 + "tail")]
    docs = [(None, "nothing"), (500, None), (501, ""), (502, "the of and the of and the of and the of and the of " * 30), (503, items[3][1].upper()), (503, "other text"), (504, "qq " + "zz " * 30)]
    for k in range(80):
        w, i = make(rnd.choice([3, 40, 200])), rnd.choice(items[:25])
        passage = i[1].split()
        for _ in range(k % 4):
            p = rnd.randrange(len(passage))
            passage[p : p + 1] = rnd.choice([[], ["zz"], [passage[p], "zz"]])
        at = rnd.randrange(len(w) + 1)
        w[at:at] = passage
        docs.append((k, rnd.choice([" ", ", ", "\n- "]).join(w)))
    docs.append((None, "pre " + items[4][1]))
    docs.append((600, "x " * 20_000 + items[5][1] + " y" * 20_000))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("key", F.lit(2))
    b = spark.createDataFrame(items + items[:3], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in leaks(d, b).collect()}
    assert got == plain(docs, items) and len(got) > 30 and (504, 93) in got
    kept = clean(d, b)
    assert kept.columns == d.columns
    bad = {x for x, _ in got}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((x is None, x or 0) for x, _ in docs if x not in bad)


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert leaks(d, b).count() == 0
    assert leaks(spark.createDataFrame([(1, "one")], "doc_id long, text string"), b.limit(0)).count() == 0


def test_windows_pass_through_simhash(spark):
    """Of the windows laid out only those within the radius go on, and all of them do (multi-index against all pairs)."""
    rnd = random.Random(3)
    bits = [rnd.getrandbits(64) for _ in range(40)]
    items = [(k, 0, b) for k, b in enumerate(bits)]
    windows = []
    for k, b in enumerate(bits):
        for n in (0, 3, 9, 10, 11, 18, 19, 30):
            x = b
            for place in rnd.sample(range(64), n):
                x ^= 1 << place
            windows.append((len(windows), k, 0, x))
        windows.append((len(windows), k, 0, rnd.getrandbits(64)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = spark.createDataFrame([(a, b, c, signed(x)) for a, b, c, x in windows], "wid long, item long, version long, fp long")
    i = spark.createDataFrame([(a, b, signed(x)) for a, b, x in items], "item long, version long, fp long")
    for radius in (10, 18):
        got = {r.wid for r in within_radius(w, i, radius, lambda frame: frame).collect()}
        assert got == {a for a, k, _, x in windows if (x ^ bits[k]).bit_count() <= radius}


def test_both_ways_of_joining_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "zz a b c d e f g h"), (3, "other"), (3, "A b, c d e f g h")], "doc_id long, text string").withColumn("_leaked", F.lit(1)).withColumn("w", F.lit(2))
    items = spark.createDataFrame([(7, "a b c d e f g h"), (8, "quite another item of words")], "item_id long, text string")
    small, large = ({tuple(r) for r in leaks(docs, items, most_sent=n).collect()} for n in (10**6, 0))
    assert small == large == {(1, 7, 1, 1.0), (2, 7, 2, 1.0), (3, 7, 1, 1.0)}
    kept = clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 0


def test_long_items_and_texts(spark):
    """An item of 3,000 words in a text of 20,000: rows, not squares."""
    item = " ".join(f"w{k}" for k in range(3000))
    text = " ".join(["x"] * 9000) + " " + item + " " + " ".join(["y"] * 8000)
    got = leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.start, round(r.similarity, 9)) for r in got] == [(9001, 1.0)]
