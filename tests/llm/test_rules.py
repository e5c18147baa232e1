"""Quality rules against a plain reading of them, text by text."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import rules
from tidemark.llm.q11_rules import op11_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in ".,;:!?'\"()-", lambda c: ord(c) > 127]


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def shares(values):
    total = sum(values)
    return [v / total for v in values]


def distance(p, q):
    def part(a, b):
        return a * math.log2(2 * a / (a + b)) / 2 if a > 0 else 0.0

    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q))))


def classes(words):
    counts = [0] * 6
    for c in "".join(words):
        counts[next((k for k, f in enumerate(CLASSES) if f(c)), 5)] += 1
    return counts


def references(rows):
    out = {}
    for lang in {x for _, x in rows if x is not None}:
        words = [w for t, x in rows if x == lang for w in WORD.findall(t or "")]
        if len(words) >= rules.LEAST_REFERENCE:
            top = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0].encode()))[: rules.COMMON]
            out[lang] = (shares(classes(words)), [w for w, _ in top], [n / len(words) for _, n in top])
    return out


def judged(rows):
    refs = references(rows)
    for text, lang in rows:
        counts = base(text or "")
        words = WORD.findall(text or "")
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        mine = [refs[lang]] if lang in refs else list(refs.values())
        far = char_far = None
        if not failed and mine and counts[0] >= 50:
            far = min(distance([1 - sum(p), *p], [1 - sum(q), *q]) for _, top, q in mine for p in [[words.count(w) / len(words) for w in top]])
        if not failed and mine and counts[1] >= 200:
            char_far = min(distance(shares(classes(words)), c) for c, _, _ in mine)
        yield (*counts, failed, far, char_far, not failed and (far or 0) <= rules.MOST_WORDS and (char_far or 0) <= rules.MOST_CHARS)


def sample():
    draw = random.Random(11)
    en, de = "the of and to in a is that it was".split(), "der die und das ist ein nicht mit von zu".split()
    tail = ["".join(draw.choice("aehinrst") for _ in range(draw.randint(3, 9))) for _ in range(600)]

    def prose(common, n):
        return " ".join(draw.choice(common) if draw.random() < 0.5 else draw.choice(tail) for _ in range(n))

    rows = [(prose(c, draw.choice((9, 10, 49, 50, 51, 160, 300))), x) for c, x in ((en, "en"), (de, "de")) for _ in range(25)]
    once = prose(en, 60)
    rows += [(f"{once}\n{once}\n \n{once}", "en"), (once + " x y " + " ".join(once.split()[:8]), "en"), (" ".join(x + "###" for x in prose(en, 80).split()), "en"), (" | ".join(tail[:60]), "de")]
    rows += [(None, "en"), ("", None), (" \n\t\x0b", "de"), ("zz " * 30_000, "en"), ("ab" * 60_000, None), (prose(en, 120), None), (prose(de, 120), "xx"), ("Ünïcödé — “quoted” " * 3, "fr"), ("1 2 3 4 5 1 2 3 4 5", "en"), ("a b c d e", "en")]
    return rows + rows[3:5]


def test_against_plain_rules(spark, tmp_path):
    rows = sample()
    docs = spark.createDataFrame([(k, *r, 1, 2.0, "h") for k, r in enumerate(rows)], "doc_id long, text string, lang string, words int, ref double, `a.b` string")
    got = rules.judge(docs, "text", "lang")
    assert got.columns[:3] == ["doc_id", "text", "lang"] and {"a.b", "words", "ref"} <= set(got.columns)
    for r, want in zip(sorted(got.collect(), key=lambda r: r.doc_id), judged(rows), strict=True):
        mine = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.word_distance, r.class_distance, r.kept)
        assert mine == tuple(pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in want), rows[r.doc_id][0]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    query = {r.doc_id: r.kept for r in op11_quality_rules(spark, str(tmp_path)).collect()}
    assert [query[k] for k in range(len(rows))] == [w[-1] for w in judged(rows)]
    assert {w[-1] for w in judged(rows)} == {True, False} and sum(w[6] is not None and w[6] > rules.MOST_WORDS for w in judged(rows)) and sum(w[7] is not None and w[7] > rules.MOST_CHARS for w in judged(rows))


def test_without_references_and_rows(spark):
    docs = spark.createDataFrame([(" ".join(map(str, range(60))), None), ("few words", "en")], "text string, lang string")
    assert [(r.kept, r.word_distance, r.class_distance) for r in rules.judge(docs, "text", "lang").orderBy("n_words").collect()] == [(False, None, None), (True, None, None)]
    assert rules.judge(docs.limit(0), "text", "lang").count() == 0


def test_long_repeats(spark):
    draw = random.Random(2)
    some = [draw.choice("abcdef") for _ in range(20_000)]
    docs = spark.createDataFrame([(" ".join(some), None)], "text string, lang string")
    assert rules.judge(docs, "text", "lang").first().n_repeat_words == base(" ".join(some))[4]


def test_no_python(spark):
    docs = spark.createDataFrame([("a", "en")], "text string, lang string")
    plan = rules.judge(docs, "text", "lang")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LocalTableScan", ""))
