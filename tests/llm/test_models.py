"""Token counts against the library; learned models on held-out rows and on odd input."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, quality, token_counts, toxicity
from tidemark.llm.common import bounded_sample, fit_logistic, run_hashes, text_buffer, word_hashes, word_spans
from tidemark.llm.q04_language import op4_language_id
from tidemark.llm.q08_quality import op8_quality
from tidemark.llm.q10_toxicity import op10_toxicity

ODD = [(None, None), (-1, ""), (-2, " a   b\n\n  c \n d's <|endoftext|>x <|endoftext|>"), (-2, "x\x1cy z  "), (-3, "   "), (-4, "\n \t a'll 12ab é  b"), (-5, "<|endoftext|>"), (-6, "a \n\n b  "), (-7, "日本語    x" * 50), (-8, "word " * 40_000), (-9, "  \r\n\r\n a\x0b\x0cb")]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n = label.sum()
    return (rank[label == 1].mean() - (n - 1) / 2) / (len(label) - n)


@pytest.mark.parametrize("most_sent", [10**9, 0])
def test_token_counts_equal_the_library(spark, sf_dir, most_sent):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    docs = docs.withColumn("tokens", F.lit("clash")).withColumn("id", F.lit(3))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    encode = Tokenizer.from_file(token_counts.tokenizer_path()).encode
    want = sorted((i is None, i or 0, len(t.encode()), len(encode(t, add_special_tokens=False))) for i, t in texts)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, most_sent=most_sent).collect())
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), most_sent=most_sent).count() == 0


def test_word_hashes_are_those_of_the_words():
    import pyarrow as pa

    texts = ["the cat sat", None, "", " the\tcat\x0bdog ", "x" * 3000, "é é", "cat sat the"]
    data, offsets = text_buffer(pa.array(texts))
    for block in (1, 7, 1 << 19):
        starts, ends, bounds = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, block)
        words = [w for t in texts for w in (t or "").encode().split()]
        assert bounds.tolist() == np.cumsum([0, *(len((t or "").split()) for t in texts)]).tolist()
        assert len({(w, int(h)) for w, h in zip(words, hashes, strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
    assert run_hashes(hashes, 2)[0] == run_hashes(hashes, 2)[3] and len(run_hashes(hashes[:1], 2)) == 0
    assert text_buffer(pa.array(texts).slice(3, 2))[0].tobytes().decode() == texts[3] + texts[4]


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    got = op4_language_id(spark, sf_dir).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all() and len(got) == len(docs)
    assert got.score.between(0, 1).all() and (got.lang_pred[got.held_out] == docs.lang[got.index][got.held_out]).mean() > 0.95


def test_language_of_odd_texts(spark):
    rows = [(k, "the and of to " * 9 if k % 2 else "le la de et un " * 300, "en" if k % 2 else "fr") for k in range(60)]
    net = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(i, t, "x") for i, t in ODD] + [(5, "12 34 !?", "x"), (6, "the of and the to", "x")], "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred) for r in language.predict(odd, net).collect()}
    assert {(None, "und"), (-1, "und"), (-3, "und"), (5, "und"), (6, "en")} <= got and (-8, "und") not in got
    none = language.fit(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"} and language.predict(odd.limit(0), net).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language.ByteNet(["a", "b", "c"], seed=4)
    x, y = rng.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    loss = lambda: -np.log(net.forward(x)[3][np.arange(6), y]).mean()
    for name, g in net.gradients(x, y).items():
        flat, w = g.ravel(), net.weights[name].ravel()
        for k in np.argsort(-abs(flat))[:4]:
            old, step = w[k], 1e-6
            w[k] = old + step
            up = loss()
            w[k] = old - step
            down = loss()
            w[k] = old
            assert abs((up - down) / (2 * step) - flat[k]) < 1e-5


def test_windows_cover_whole_texts():
    for n in (0, 1, 127, 128, 129, 252, 253, 5000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8) | np.uint8(1)
        parts = list(language.cut(data, np.array([0, n]), most=7))
        x = np.concatenate([w for _, w in parts]) if parts else np.zeros((0, language.WINDOW), np.uint8)
        assert language.window_counts(np.array([0, n]))[0] == len(x) and (n == 0 or (x > 0).sum() == n + (len(x) - 1) * language.OVERLAP)
    texts = [b"", b"abc" * 100, b"", b"x", b"yz" * 300, b""]
    offsets = np.cumsum([0, *map(len, texts)])
    got = [(r, bytes(w)) for rows, x in language.cut(np.frombuffer(b"".join(texts), np.uint8), offsets, most=3) for r, w in zip(rows, x, strict=True)]
    step = language.WINDOW - language.OVERLAP
    assert got == [(k, t[j : j + language.WINDOW].ljust(language.WINDOW, b"\0")) for k, t in enumerate(texts) for j in range(0, max(len(t) - language.OVERLAP, bool(t)), step)]


def test_probabilities_are_those_of_a_plain_convolution():
    net = language.ByteNet(["a", "b", "c"], seed=3)
    net.weights["bias"] = np.linspace(-1, 1, len(net.weights["bias"])).astype(np.float32)
    x = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    for window, got in zip(x, net.predict(x, step=2), strict=True):
        pooled = []
        for f in range(language.FILTERS * len(language.WIDTHS)):
            width = language.WIDTHS[f // language.FILTERS]
            taps = net.weights["filter"][:, f].reshape(net.width, language.EMBED)
            assert (taps[width:] == 0).all()
            places = range(language.WINDOW - net.width + 1)
            best = max(sum(float(net.weights["embed"][window[p + k]] @ taps[k]) for k in range(width)) for p in places)
            pooled.append(max(0.0, best + float(net.weights["bias"][f])))
        z = np.array(pooled) @ net.weights["dense"] + net.weights["shift"]
        assert np.allclose(got, np.exp(z) / np.exp(z).sum(), atol=1e-5)


@pytest.mark.parametrize("name", ["quality", "language"])
def test_one_very_long_text_takes_bounded_memory(name):
    import tracemalloc

    data = np.frombuffer(b"Some words, and 12 more of them.\n" * 1_500_000, np.uint8)  # 50 MB
    offsets, net = np.array([0, len(data)]), language.ByteNet(["a", "b"])
    tracemalloc.start()
    try:
        if name == "quality":
            got = quality.features(data, offsets)
            assert np.allclose(got[0, : -4], quality.features(data[:33_000], np.array([0, 33_000]))[0, : -4], atol=1e-3)
        else:
            total = 0
            for _, x in language.cut(data, offsets):
                total += len(x)
                if total == len(x):
                    net.predict(x)
            assert total == language.window_counts(offsets)[0]
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()


def test_features_of_pieces_are_those_of_whole_texts(monkeypatch):
    texts = [b"", b"Hello, World 1\n", "Stra\u00dfe \u00e9".encode() * 9, b"x", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = quality.features(data, offsets)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(quality, "BYTES", size)
        assert (quality.features(data, offsets) == whole).all()
    for t, row in zip(texts, whole, strict=True):
        pairs = Counter(zip(quality.CLASS[list(t)], quality.CLASS[list(t)[1:]], strict=False)) if t else Counter()
        want = np.zeros((quality.CLASSES, quality.CLASSES))
        for (p, q), n in pairs.items():
            want[p, q] = math.sqrt(n / len(t))
        assert np.allclose(row[: quality.CLASSES**2].reshape(want.shape), want, atol=1e-6)


def test_training_lowers_a_plain_non_negative_risk():
    """Against the risk written out over scaled rows: training ends near the least that small steps from it can find."""
    rng = np.random.default_rng(1)
    p = rng.normal(0.8, 1, (300, 6)).astype(np.float32) * np.array([1, 5, 0.2, 1, 1, 30], np.float32)
    u = np.concatenate([rng.normal(0.8, 1, (240, 6)), rng.normal(-0.8, 1, (560, 6))]).astype(np.float32) * np.array([1, 5, 0.2, 1, 1, 30], np.float32)
    model = quality.train(p, u, 0.3)

    def risk(w, b):
        z = lambda x: ((x - model.mean) / model.scale) @ w + b
        loss = lambda z: np.log1p(np.exp(-z))
        return 0.3 * loss(z(p)).mean() + max(0.0, loss(-z(u)).mean() - 0.3 * loss(-z(p)).mean())

    start, end = risk(np.zeros(6), 0.0), risk(model.weights, model.bias)
    assert abs(start - math.log(2)) < 1e-6 and end < 0.6 * start
    for k in range(6):
        for d in (-0.2, 0.2):
            w = model.weights.copy()
            w[k] += d
            assert risk(w, model.bias) > end - 0.01
    assert np.allclose(model.mean, u.mean(0), atol=1e-4)


def test_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op8_quality(spark, sf_dir).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")
    held = got[got.held_out].join(labels, how="inner")
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9


def test_quality_of_odd_texts(spark):
    good = spark.createDataFrame([(k, f"plain words number {k} in a row.") for k in range(40)], "doc_id long, text string")
    bad = spark.createDataFrame([(k, f"B@D!! *** {k} ###") for k in range(40)], "doc_id long, text string")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = quality.fit(good, good.union(bad), 0.5)
    assert quality.predict(good, model).agg(F.min("score")).first()[0] > quality.predict(bad, model).agg(F.max("score")).first()[0]
    assert quality.predict(odd, model).where("score between 0 and 1").count() == len(ODD) and quality.predict(odd.limit(0), model).count() == 0
    flat = quality.fit(good.limit(0), good, 0.25)
    assert abs(quality.predict(odd, flat).agg(F.max("score")).first()[0] - 0.25) < 1e-6


def test_risk_does_not_go_below_zero():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 1, (300, 4)).astype(np.float32)
    u = np.concatenate([rng.normal(1, 1, (300, 4)), rng.normal(-1, 1, (300, 4))]).astype(np.float32)
    score = quality.train(p, u, 0.5).score(u)
    assert (score[:300] > 0.5).mean() > 0.9 and (score[300:] < 0.5).mean() > 0.9


def toxic_rows(n=400):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        w, y = [rnd.choice(words) for _ in range(40)], k % 4 == 0
        if y:
            for _ in range(3):
                w[rnd.randrange(40)] = rnd.choice(["Nasty", "awful,", "vile"])
        rows.append((k, " ".join(w), int(y)))
    return rows


@pytest.mark.parametrize("most_sent", [10**9, 0])
def test_toxicity(spark, most_sent):
    frame = spark.createDataFrame([*toxic_rows(), (9999, None, 1), (9998, "x", None), (None, "w1 w2", 0)], "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, most_sent=most_sent)
    fresh = spark.createDataFrame([(1, "w1 w2 w3 nasty w4 w5 awful w6 w7 w9"), (2, "w1 w2 w3 w4 w5 w6 w8 w9 w10"), (None, None), (3, ""), (2, "w1 w2 w3 w4 w5 w6 w8 w9 w10")], "doc_id long, text string").withColumn("mean_ratio", F.lit("clash"))
    got = {r.doc_id: (r.score, r.predicted) for r in model.score(fresh).collect()}
    assert got[1][1] == 1 and got[2][1] == got[3][1] == got[None][1] == 0 and model.score(fresh).count() == 5
    kept = model.keep(fresh.drop("mean_ratio").withColumn("digest", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "digest"] and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 2, 3]
    assert model.score(fresh.limit(0)).count() == 0


def test_toxicity_counts_all_ordinary_rows(spark):
    """A subject's word that most ordinary rows have, but none of a hashed 5 % of them, is no toxic one."""
    rnd, rows = random.Random(4), []
    key = F.pmod(F.xxhash64(F.col("id").cast("long"), F.lit(5)), F.lit(1_000_000))
    for r in spark.range(840).select("id", key.alias("x")).collect():
        w, toxic = [f"w{rnd.randrange(60)}" for _ in range(40)], r.id % 21 == 0
        if r.id % 2 and toxic or not toxic and r.x > 100_000:
            w[rnd.randrange(1, 40)] = "subject"
        if toxic:
            w[rnd.randrange(1, 40)] = w[rnd.randrange(1, 40)] = "nasty"
        if toxic and "subject" not in w:
            w[0] = "subject"
        rows.append((r.id, " ".join(w), int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    got = {r.text: r.mean_ratio for r in model.ratios(spark.createDataFrame([("subject",), ("nasty",)], "text string"), "text").collect()}
    assert got["subject"] <= 0 < got["nasty"]


def test_toxicity_counts_rows_of_both_parts(spark):
    """A bigram of n ordinary rows, held for the curve or not, is expected 1 - (1 - share)^n times."""
    rows = [("a b", 0, 0), ("a b a b", 0, 1), ("a b", 1, 0), ("c b", 0, 1)]
    counts = spark.createDataFrame(rows, "text string, toxic int, held int").coalesce(1).mapInArrow(toxicity.count_bigrams, "h long, w long, t long, o long")
    b = counts.groupBy("h", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).groupBy("w")
    whole = sorted((round(r.t, 9), round(r.o, 9), r.k) for r in b.agg(*toxicity.continuations({0: 0.25, 1: 1.0}, True)).collect())
    part = sorted((round(r.t, 9), round(r.o, 9), r.k) for r in b.agg(*toxicity.continuations({0: 0.25, 1: 1.0}, False)).collect())
    assert whole == [(0.0, 0.25, 1), (1.0, 0.4375 + 0.25, 2), (1.0, 0.4375 + 0.25, 2)]
    assert part == [(0.0, 0.0, 0), (1.0, 0.25, 1), (1.0, 0.25, 1)]


def test_toxicity_counts_words_of_fixed_expressions(spark):
    """A word that only four words come before, whatever the number of texts, is toxic evidence."""
    rnd, rows = random.Random(6), []
    for k in range(400):
        w, y = [f"w{rnd.randrange(60)}" for _ in range(40)], k % 4 == 0
        if y:
            w[5:7] = [rnd.choice(["utter", "total", "real", "such"]), "zilch"]
        elif k % 4 == 1:
            w[5] = rnd.choice(["utter", "total", "real", "such"])
        rows.append((k, " ".join(w), int(y)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert model.ratios(spark.createDataFrame([("zilch",)], "text string"), "text").first().mean_ratio > 0


def test_toxicity_without_rows_or_with_one_class(spark):
    frame = spark.createDataFrame(toxic_rows(40), "doc_id long, text string, toxic int")
    assert {r.score for r in toxicity.fit(frame.limit(0)).score(frame).collect()} == {0.5}
    one = toxicity.fit(frame.where("toxic = 0")).score(frame).agg(F.max("score")).first()[0]
    assert 0 <= one < 0.5


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op10_toxicity(spark, sf_dir).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")
    held = got[got.held_out].join(labels, how="inner")
    assert (held.predicted == held.toxic).mean() > 0.9


def test_small_helpers(spark):
    assert bounded_sample(spark.range(5000), "id", 500).count() in range(350, 650) and bounded_sample(spark.range(50), "id", 50).count() == 50
    a, b = fit_logistic(np.array([0.0, 0, 1, 1, 0, 1]), np.array([0.0, 0, 1, 1, 1, 0]))
    assert a > 0 and fit_logistic(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_toxicity_keeps_columns_of_its_own_names(spark):
    model = toxicity.fit(spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int"))
    docs = spark.createDataFrame([(1, "w1 w2 w3 nasty w4 awful w5", "a"), (2, "w1 w2 w3", "b"), (2, "w1 w2 w3", "b"), (3, None, None)], "doc_id long, text string, mean_ratio string").withColumn("_mean_ratio", F.lit(5))
    for most_sent in (10**9, 0):
        model.most_sent = most_sent
        kept = model.keep(docs)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "w1 w2 w3", "b", 5)] * 2 + [(3, None, None, 5)], key=str)


def test_short_and_empty_texts_are_described_in_bounded_slices():
    import pyarrow as pa

    from tidemark.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(50_000)), pa.array(["", "abc"] * 25_000)], ["kind", "text"])
    sizes = [p.num_rows for p in slices([batch], "text", 1 << 20, quality.ROWS)]
    assert sum(sizes) == 50_000 and max(sizes) == quality.ROWS


def test_quality_of_many_tiny_texts(spark):
    good = spark.createDataFrame([(k, f"plain words number {k} in a row.") for k in range(40)], "doc_id long, text string")
    model = quality.fit(good, good, 0.5)
    tiny = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "abc").otherwise("").alias("text"))
    assert quality.predict(tiny, model).where("score between 0 and 1").count() == 50_000


def test_rare_languages_are_learned(spark):
    """A language has its part of the sample, however rare it is among all rows."""
    rows = [(k, "the and of to with " * 5, "en") for k in range(3000)] + [(5000 + k, "łódź ćma żółw gęś " * 5, "pl") for k in range(6)]
    net = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=100)
    assert net.classes == ["en", "pl"]
    got = language.predict(spark.createDataFrame([(1, "gęś żółw ćma łódź " * 4), (2, "of the with and to " * 4)], "doc_id long, text string"), net)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "pl", 2: "en"}


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from tidemark.llm.common import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session)


def test_chunks_of_odd_spaces_give_the_pretokens_of_whole_texts():
    """Cut at spaces or not, with white space of all kinds, the tokens are the library's."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path()
    special, library = token_counts.special_strings(path), Tokenizer.from_file(path)
    chunker, rnd = token_counts.Chunker(special), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u1680", "\u2028", "a", "b'll", "don't", "é", "12", "!?", "“", "x" * 70, "日本", "<|endoftext|>", "\r\n", " \n "]
    for _ in range(300):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(6)]
        data, starts, ends, _, bounds, odd = chunker.cut(pa.array(texts))
        found, owner = chunker.parts(token_counts.strings(data, starts, ends))
        for k, t in enumerate(texts):
            pretokens, n = chunker.whole(t) if k in odd.tolist() else ([x for x, o in zip(found, owner.tolist(), strict=True) if bounds[k] <= o < bounds[k + 1]], 0)
            assert sum(len(library.encode(x, add_special_tokens=False)) for x in pretokens) + n == len(library.encode(t, add_special_tokens=False)), repr(t)


def test_known_hashes_are_bounded_and_found():
    known, rng = token_counts.Known(2000), np.random.default_rng(0)
    for _ in range(50):
        h = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        h = h[known.find(h) < 0]
        known.add(h, np.arange(len(h)))
        assert (known.find(h) == np.arange(len(h))).all() and sum(len(k) for k, _ in known.runs) <= 2500
    assert (known.find(np.array([1, 2], np.uint64)) == -1).all()


def test_log_ratios_are_those_of_a_plain_kneser_ney(spark):
    """Two classes of the same size, every text once: counts of contexts, discount and shared backoff by hand."""
    import math
    from collections import defaultdict

    rnd = random.Random(12)
    rows = [(" ".join(rnd.choice("abcdefgh") + rnd.choice(["", "x" if y else "y"]) for _ in range(30)), y, 0) for y in (0, 1) for _ in range(15)]
    frame = spark.createDataFrame(rows, "text string, toxic int, held int")
    counts = frame.mapInArrow(toxicity.count_bigrams, "h long, w long, t long, o long").groupBy("h", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    words = counts.groupBy("w").agg(*toxicity.continuations({0: 1.0, 1: 1.0}, False))
    got = sorted(r.ratio for r in toxicity.log_ratios(words, dead=0.0).collect() if abs(r.ratio) > 1e-6)
    before = {y: defaultdict(set) for y in (0, 1, 2)}
    for text, y, _ in rows:
        w = text.split()
        for a, b in zip([None, *w[:-1]], w, strict=True):
            before[y][b].add(a)
            before[2][b].add(a)
    total = {y: sum(map(len, before[y].values())) for y in (0, 1)}
    left = {y: sum(min(0.75, len(x)) for x in before[y].values()) / total[y] for y in (0, 1)}
    q = {w: min(10, len(x)) for w, x in before[2].items()}
    p = lambda y, w: max(len(before[y][w]) - 0.75, 0) / total[y] + left[y] * q[w] / sum(q.values())
    want = sorted(x for w in q if abs(x := math.log(p(1, w) / p(0, w))) > 1e-6)
    assert len(want) > 15 and np.allclose(got, want, rtol=1e-4, atol=1e-6)


def test_places_are_those_of_their_hashes(spark):
    """Each distinct hash once and in order, so that tables are searched in order; long chunks are counted once a piece."""
    rnd = np.random.default_rng(3)
    for n in (0, 1, 5000):
        hashes = rnd.integers(0, 700, n).astype(np.uint64) << np.uint64(50)
        distinct, place, number = token_counts.places(hashes)
        assert (np.diff(distinct) > 0).all() and (hashes[place] == distinct).all() and (distinct[number] == hashes).all()
    long = "x" * 5000
    docs = spark.createDataFrame([(k, f"{long} {long}, a {long}") for k in range(50)], "doc_id long, text string").coalesce(1)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.tokenizer_path())
    want = len(library.encode(f"{long} {long}, a {long}", add_special_tokens=False).ids)
    assert {r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {want}


def pair_rows(n=600):
    """Both classes have the same words; in toxic texts two of them stand in one order, in the others in the other."""
    rnd, rows = random.Random(12), []
    for k in range(n):
        w, y = [f"w{rnd.randrange(60)}" for _ in range(40)], k % 4 == 0
        at, other = rnd.sample(range(0, 40, 2), 2)
        w[at : at + 2] = ["alpha", "beta"] if y else ["beta", "alpha"]
        w[other : other + 2] = ["beta", "gamma"] if y else ["gamma", "beta"]
        rows.append((k, " ".join(w), int(y)))
    return rows


@pytest.mark.parametrize("most_sent", [10**9, 0])
def test_toxicity_scores_bigrams(spark, most_sent):
    """A text is told by its bigrams where its words tell nothing."""
    model = toxicity.fit(spark.createDataFrame(pair_rows(), "doc_id long, text string, toxic int"), most_sent=most_sent)
    fresh = [(1, "w1 w2 alpha beta w3 w4 w5 beta gamma w7"), (2, "w1 w2 beta alpha w3 w4 w5 gamma beta w7")]
    got = {r.doc_id: r.predicted for r in model.score(spark.createDataFrame(fresh, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0}


def test_toxicity_bigram_ratios_against_plain_counts(spark):
    """log p(w|h) of the toxic over the ordinary bigram model, both with the continuation level as backoff."""
    rnd, texts = random.Random(13), []
    for k in range(60):
        texts.append((" ".join(rnd.choice("abcdefgh" if k % 2 else "efghijkl") for _ in range(12)), k % 2))
    bigrams = lambda t: set(zip([None, *t.split()[:-1]], t.split(), strict=True))
    n = {y: Counter(b for t, z in texts if z == y for b in bigrams(t)) for y in (0, 1)}
    words, total = {y: Counter(w for _, w in n[y]) for y in (0, 1)}, {y: len(n[y]) for y in (0, 1)}
    seen = Counter(w for _, w in set(n[0]) | set(n[1]))
    q = {w: min(10, k) / sum(min(10, k) for k in seen.values()) for w, k in seen.items()}
    lower = lambda y, w: max(words[y][w] - 0.75, 0) / total[y] + sum(min(0.75, k) for k in words[y].values()) / total[y] * q[w]

    def p(y, h, w):
        after = [k for (g, _), k in n[y].items() if g == h]
        return (max(n[y][h, w] - 1, 0) + len(after) * lower(y, w)) / sum(after) if after else lower(y, w)

    for y in (0, 1):
        assert abs(sum(p(y, "e", w) for w in seen) - 1) < 1e-9
    frame = spark.createDataFrame([(t, y, 0) for t, y in texts], "text string, toxic int, held int")
    share = {0: 1.0, 1: 1.0}
    pairs = frame.mapInArrow(toxicity.count_bigrams, "h long, w long, t long, o long").groupBy("h", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    counted = pairs.groupBy("w").agg(*toxicity.continuations(share, False))
    known = toxicity.probabilities(counted)
    lower_ = counted.select("w", *(known[c].alias(f"p{c}") for c in "to"))
    joined = pairs.join(lower_, "w").join(pairs.groupBy("h").agg(*toxicity.histories(share, False)), "h")
    ratio = toxicity.pair_ratio(share, False, {c: F.col(f"p{c}") for c in "to"}, {c: F.col(f"l{c}") for c in "to"}) + toxicity.history_ratio() + F.log(F.col("pt") / F.col("po"))
    got = sorted(r.x for r in joined.select(ratio.alias("x")).collect())
    assert np.allclose(got, sorted(math.log(p(1, *b) / p(0, *b)) for b in set(n[0]) | set(n[1])), atol=1e-9)


def shuffled_bytes(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


@pytest.mark.parametrize("words", [3000, 12_000])
def test_token_counts_beyond_the_bound_shuffle_no_texts(spark, words):
    """Only pre-tokens that are not sent, and no texts, are shuffled for the join; with copies, null ids and special strings."""
    from tokenizers import Tokenizer

    rnd, library = random.Random(5), Tokenizer.from_file(token_counts.tokenizer_path())
    common = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)]
    texts = [" ".join([*rnd.choices(common, k=words), *(f"zq{rnd.randrange(10**6)}x{k}" for _ in range(10)), f"<|endoftext|>zz{k} zz{k}"]) for k in range(30)]
    rows = [(None if k % 7 == 0 else k % 25, t) for k, t in enumerate([*texts, *texts[:6], "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffled_bytes(spark)
    got = token_counts.count_tokens(docs, most_sent=3200).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    size = sum(len((t or "").encode()) for _, t in rows)
    moved = sum(n for k, n in shuffled_bytes(spark).items() if k not in before)
    assert moved < (0.3 if words == 3000 else 0.1) * size, (moved, size)


def test_least_seen_keeps_the_bound(spark):
    seen = [*range(1, 3000), *[1] * 500, *[2] * 300, 10**9, 2**40]
    counts = spark.createDataFrame([(s,) for s in seen], "seen long")
    for most in (0, 1, 2, 10, 700, 2999, 3000, 10**6):
        least = token_counts.least_seen(counts, most)
        sent = 0 if least is None else sum(s >= least for s in seen)
        assert sent <= most and (most < 700 or sent > 0.6 * min(most, 3000))


def test_pretokens_whose_keys_clash_are_told_by_their_strings(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "key_of", lambda t: len(t) if len(t) < 9 else int.from_bytes(t.encode()[:8]))
    path = token_counts.tokenizer_path()
    library, special, rnd = Tokenizer.from_file(path), token_counts.special_strings(path), random.Random(2)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 12))) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=50)) + rnd.choice(["", "<|endoftext|>a b", "\n\n x"]) for _ in range(40)]
    chunker = token_counts.Chunker(special)
    tokens = {p: len(library.encode(p, add_special_tokens=False)) for t in texts for p in chunker.whole(t)[0]}
    of = Counter(map(token_counts.key_of, tokens))
    keys = np.array(sorted(of), np.uint64)
    clashes = {p: n for p, n in tokens.items() if of[token_counts.key_of(p)] > 1}
    single = {token_counts.key_of(p): n for p, n in tokens.items() if p not in clashes}
    assert clashes and single
    for sent in (keys, keys[::2], keys[:0]):
        table = (sent, np.array([single.get(int(k), 99) for k in sent], np.int32), clashes)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
        for _, totals, (row, key, n) in token_counts.sums_of_texts([batch], table, special):
            np.add.at(totals, row, n * np.array([single[int(k)] for k in key], np.int64))
            assert totals.tolist() == [len(library.encode(t, add_special_tokens=False)) for t in texts]
