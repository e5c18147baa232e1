"""The filter audit against filters that run one after another over a small table."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tidemark.llm import audit
from tidemark.llm.q13_audit import op13_filter_audit

DOCS = "doc_id long, text string, source string, id string, part int, print string, n int"


def fails(rows):
    """The five failures of every row, as the contract words them."""
    out = []
    for id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = id is not None and any(o is not None and o < id and (t or "") == text for o, t, _ in rows)
        out.append(dict(A=len(words) < 50, B=100 * len(set(words)) < 65 * len(words), C=100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), D=any(c in "#$%&*|" for c in text), E=copy))
    return out


def brute(rows, labels):
    found, flags = [], fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {s or "" for _, _, s in rows}:
        here = [(r[0], f) for r, f in zip(rows, flags) if (r[2] or "") == part]
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = list(here)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                shapley[x] += len(gone)
                redundant = sum(d[1][x] for d in here) - len(gone)
                unique = sum(d[1][x] and sum(d[1].values()) == 1 for d in here)
                steps.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        found += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(found)


def sample():
    draw = random.Random(3)
    pool = "alpha Beta gamma DELTA eps#lon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    texts = ["\x0b".join(draw.choice(pool) + str(draw.randrange(m)) for _ in range(n)) for n in (0, 1, 49, 50, 51, 120, 400) for m in (1, 3, 40, 900)]
    texts += [None, "", " \n\t", "A" * 60, "É" * 30 + "A", "w " * 50, " ".join(map(str, range(50))), "long " * 40_000, "\x85 \xa0" * 40]
    rows = [(k, draw.choice(texts), draw.choice(["s1", "s2", None, "s1"])) for k in range(140)]
    rows += [rows[5], rows[5], (None, rows[7][1], "s2"), (None, rows[7][1], "s2"), (None, None, None), (7, "another text", "s1")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_against_filters_in_turn(spark, tmp_path):
    rows, labels = sample()
    spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op13_filter_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_two_filters_of_ones_own(spark):
    rows = [("p", True, True, True), ("p", True, False, False), ("p", False, False, True), ("q", False, False, False)]
    flagged = spark.createDataFrame(rows, "part string, x boolean, y boolean, late boolean")
    counts = audit.lattice(flagged, ["x", "y"], ["late"])
    got = {(r.part, r.filter_order, r.step): r for r in audit.in_all_orders(counts, "XY", {"late": "late_lost"}).collect()}
    assert len(got) == 8
    r = got["p", "YX", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.late_lost, r.shapley) == (1, 1, 1, 1, 0, 3)
    assert got["q", "XY", 1].kept == 1 and got["q", "XY", 1].shapley == 0


def test_words_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    plan = audit.word_totals(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" in plan
    assert [tuple(r)[2:] for r in audit.word_totals(docs.union(docs), "doc_id", "text").collect()] == [(3, 2)]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.failures(empty, "doc_id", "text", "source").count() == 0
    assert audit.failures(empty.union(spark.createDataFrame([(1, None, None)], empty.schema)), "doc_id", "text", "source").select(F.col("a") & ~F.col("b")).first()[0]
