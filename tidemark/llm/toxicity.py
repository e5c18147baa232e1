"""Toxicity: class-conditional Kneser-Ney bigram models, compared over the words and bigrams of a text.

Toxic and ordinary texts each have a bigram model: the texts that have a bigram, discounted by one, over those of its
history, and what the discount leaves goes to the continuation level. There a word's probability follows from the number
of different words it comes after, discounted, and what that discount leaves goes to one backoff that both share.
Repeats and copies of a text so add nothing to its words, and a rare expression, left to the backoff, weighs alike in
both models. The log ratio of a bigram is the sum of its word's, of what its history leaves and of what the bigram has
beyond that; that of a text is taken over its distinct words and bigrams and normalised by the number of words, with
the weight that either level has for texts the models have not seen. Terms within `DEAD` of zero are drift between the
two collections (their languages and subjects) and count as none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, bounded_sample, collision_free, few_files, fit_logistic, forget, mix, shared_path, slices, sums_by_row, text_buffer, word_hashes, word_spans, write_and_clear

#: Log ratios this near zero are none; a word has no more counts than `CAP` in the backoff.
DEAD, CAP = 2.0, 10
#: The curve sees asinh of so many times the mean ratio, so that short texts with large ones don't rule it.
STRETCH = 100.0
#: Most rows of the table that are sent to every executor (12 bytes each); above it texts meet the table by a shuffle.
MOST_SENT = 8_000_000
#: Letters that count as such when words are cut; A-Z are lower-cased and other ASCII signs act as spaces.
CLEAN = np.arange(256, dtype=np.uint8)
CLEAN[:128] = [k + 32 if 65 <= k <= 90 else k if chr(k).isalnum() else 32 for k in range(128)]


def word_stream(array):
    """Hashes (int64) of the words of a string array, of the words before them (0 at a row's start), and row bounds."""
    data, offsets = text_buffer(array)
    data = CLEAN[data]
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends).view(np.int64)
    before = np.concatenate([[0], words[:-1]])[: len(words)]
    before[bounds[:-1][bounds[:-1] < len(words)]] = 0
    return words, before, bounds


def pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before.view(np.uint64) * np.uint64(BASE) + words.view(np.uint64)).view(np.int64)


def count_bigrams(batches):
    """For mapInArrow over (text, toxic, held): the distinct bigrams of each slice and how many toxic and ordinary rows
    have them. Rows that are held count 2**32, so that one sum keeps both numbers. The word before is known by 32 bits of
    its hash, which tell the words before one word apart but for about k / 2**33 of k; the other bits are zeros, which
    the shuffle compresses."""
    for piece in slices(batches, "text", 2 << 20):
        words, before, bounds = word_stream(piece.column(0))
        row = np.repeat(np.arange(piece.num_rows), np.diff(bounds))
        pairs = pair(before, words)
        once = np.unique(pair(row, pairs), return_index=True)[1]
        _, first, inverse = np.unique(pairs[once], return_index=True, return_inverse=True)
        toxic, held = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[row[once]] for k in (1, 2))
        size = np.where(held > 0, float(1 << 32), 1.0)
        sums = [pa.array(np.bincount(inverse, size * (toxic == y), len(first)).astype(np.int64)) for y in (1, 0)]
        first = once[first]
        yield pa.RecordBatch.from_arrays([pa.array(before[first] << 32), pa.array(words[first]), *sums], ["h", "w", "t", "o"])


def drawn(share: dict[int, float], held: bool) -> dict:
    """By class, of (t, o) of a bigram: its rows (with those that are held or without), and the rows and the chance of
    any that are expected where each is kept with the class's share."""
    out = {}
    for c, y in (("t", 1), ("o", 0)):
        n = F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) + (F.shiftright(c, 32) if held else F.lit(0))
        part = share.get(y, 1.0)
        out[c] = n, n * F.lit(part), F.when(n > 0, 1 - F.pow(F.lit(1.0 - part), n)).otherwise(F.lit(0.0))
    return out


def continuations(share: dict[int, float], held: bool) -> list:
    """Aggregates t, o and k by word over (t, o) of bigrams, with the rows that are held or without.

    t and o are the different words before a word that a class would have if each of its rows were kept with its
    share: a bigram of n rows is expected (1 - (1 - share)^n) times. All rows take part, whatever the share.
    """
    n = drawn(share, held)
    return [F.sum(n["t"][2]).alias("t"), F.sum(n["o"][2]).alias("o"), F.count_if(n["t"][0] + n["o"][0] > 0).alias("k")]


def histories(share: dict[int, float], held: bool) -> list:
    """Aggregates by history over (t, o) of its bigrams: the texts n of a class and those, l, that the discount leaves."""
    return [F.sum(x).alias(f"{kind}{c}") for c, (_, size, there) in drawn(share, held).items() for kind, x in (("n", size), ("l", there))]


def beyond(ratio, dead: float):
    """What a log ratio has beyond the dead zone."""
    return F.signum(ratio) * F.greatest(F.abs(ratio) - F.lit(dead), F.lit(0.0))


def history_ratio():
    """Of (nt, lt, no, lo): the log of the part that a history leaves to the words, toxic over ordinary; a class without
    the history leaves all."""
    left = {c: F.when(F.col(f"n{c}") > 0, F.col(f"l{c}") / F.col(f"n{c}")).otherwise(F.lit(1.0)) for c in "to"}
    return F.log(left["t"] / left["o"])


def pair_ratio(share: dict[int, float], held: bool, p: dict, left: dict):
    """Log ratio of a bigram (t, o) beyond that of its history and word.

    With c texts of a class that have the bigram (h, w), p(w|h) = (max(c - 1, 0) + l(h) p(w)) / n(h): the term of the class
    is the log of p(w|h) over the backed-off l(h) p(w) / n(h). `p` and `left` are columns of p(w) and l(h) by class.
    """
    over = {c: F.when(n > 1, F.greatest(size - there, F.lit(0.0))).otherwise(F.lit(0.0)) for c, (n, size, there) in drawn(share, held).items()}
    term = {c: F.when(over[c] > 0, F.log1p(over[c] / (left[c] * p[c]))).otherwise(F.lit(0.0)) for c in "to"}
    return term["t"] - term["o"]


def probabilities(words: DataFrame, discount: float = 0.75, cap: int = CAP, prefix: str = "") -> dict | None:
    """Columns p(w) by class over continuation counts (w, t, o, k), which are summed here; None if a class has none.

    With k(w) the different words before w in a class, K their sum and D the discount,
    p(w) = max(k(w) - D, 0) / K + b q(w), b what the discount leaves. q are the counts of all texts, no word with more
    than `cap`; a rare word so has a ratio too, the nearer to that of the backoff the rarer it is.
    """
    d = F.lit(discount)
    kept, k = {c: F.col(prefix + c) for c in "to"}, F.col(f"{prefix}k")
    left = {c: F.sum(F.least(kept[c], d)) for c in "to"}
    n = words.agg(*(F.sum(kept[c]).alias(c) for c in "to"), F.sum(F.least(k, F.lit(cap))).alias("q"), *(left[c].alias(f"l{c}") for c in "to")).first()
    if not n["t"] or not n["o"]:
        return None
    q = F.least(k, F.lit(cap)) / float(n["q"])
    return {c: F.greatest(kept[c] - d, F.lit(0.0)) / float(n[c]) + float(n[f"l{c}"]) / float(n[c]) * q for c in "to"}


def log_ratios(words: DataFrame, discount: float = 0.75, dead: float = DEAD, cap: int = CAP) -> DataFrame:
    """(w, ratio) from continuation counts (w, t, o, k): the log of toxic over ordinary probability beyond the dead zone."""
    p = probabilities(words, discount, cap)
    if p is None:
        return words.select("w", F.lit(0.0).cast("float").alias("ratio")).where("false")
    ratio = F.log(p["t"] / p["o"])
    return words.where(F.abs(ratio) > dead).select("w", beyond(ratio, dead).cast("float").alias("ratio"))


def history(before: np.ndarray) -> np.ndarray:
    """What is known of the word before: 32 bits of its hash."""
    return before << 32


def keyed_pairs(batches):
    """For mapInArrow over (h, w, ratio): the key of a bigram, or of a history where w is 0, in place of h and w."""
    for batch in batches:
        h, w = (batch.column(k).to_numpy() for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(pair(history(h.astype(np.int64)), w)), batch.column(2)], ["w", "ratio"])


def features(array):
    """Of each row the distinct words, the keys of the distinct bigrams and those of their histories; each with bounds."""
    words, before, bounds = word_stream(array)
    row = np.repeat(np.arange(len(array)), np.diff(bounds))
    h = history(before)
    pairs = pair(h, words)
    out = []
    for keys in (words, pairs):
        first = np.unique(pair(row, keys), return_index=True)[1]
        first.sort()
        out.append((keys[first], np.searchsorted(row[first], np.arange(len(array) + 1))))
    return [*out, (pair(h[first], np.zeros(len(first), np.int64)), out[1][1])]


def mean_ratios(table, text: str, out: str, pairs: str):
    """For mapInArrow: all columns and the mean log ratios of a text's distinct words, and of their bigrams; 0 without words."""

    def run(batches):
        known = table.value
        for piece in slices(batches, text):
            names, sums = piece.schema.names, []
            found = features(piece.column(names.index(text)))
            for (keys, ratios), (wanted, bounds) in zip(known, found, strict=True):
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                value = np.where(keys[at] == wanted, ratios[at], 0) if len(keys) else np.zeros(len(wanted))
                sums.append(sums_by_row(value, bounds))
            n = np.maximum(1, np.diff(found[0][1]))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(sums[0] / n), pa.array((sums[1] + sums[2]) / n)], [*names, out, pairs])

    return run


def text_features(batches):
    """For mapInArrow over (digest, text): (digest, level, w) of each text's distinct words, bigrams and their histories."""
    for piece in slices(batches, "text"):
        for level, (keys, bounds) in enumerate(features(piece.column(1))):
            row = np.repeat(np.arange(piece.num_rows), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(np.full(len(keys), level, np.int32)), pa.array(keys)], ["digest", "level", "w"])


class ToxicityModel:
    """A table of log ratios (of words, bigrams, histories: levels 0, 1, 2) in the shared folder and the logistic curve
    from a text's mean ratios to a score."""

    def __init__(self, path: str, rows: int, slope: float = 1.0, intercept: float = 0.0, most_sent: int = MOST_SENT, pair_slope: float = 0.0):
        self.path, self.rows, self.slope, self.intercept, self.most_sent = path, rows, slope, intercept, most_sent
        self.sent, self.learned, self.pair_slope = None, False, pair_slope

    def ratios(self, docs: DataFrame, text: str, out: str = "mean_ratio", pairs: str | None = None) -> DataFrame:
        """All columns and `out`, the mean log ratio of the words of every row's text, in place of a column of that name;
        with `pairs` also a column of that name, what its bigrams and their histories add."""
        spark = docs.sparkSession
        docs = docs.drop(out) if text.lower() != out.lower() else docs
        also = pairs or collision_free(docs.withColumn(out, F.lit(0)), "pairs")
        table = spark.read.schema("level int, w long, ratio float").parquet(self.path)
        names = [*docs.columns, out, *([also] if pairs else [])]
        if self.rows <= self.most_sent:
            if self.sent is None:
                got = table.toArrow()
                level, keys, ratios = (got[c].to_numpy() for c in ("level", "w", "ratio"))
                order = np.argsort(keys)
                self.sent = spark.sparkContext.broadcast([(keys[x], ratios[x]) for k in range(3) for x in [order[level[order] == k]]])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
            return docs.mapInArrow(mean_ratios(self.sent, text, out, also), f"{columns}, `{out}` double, `{also}` double").select(*(F.col(f"`{c}`") for c in names))
        digest, means = collision_free(docs, "digest"), {out: collision_free(docs, "mean"), also: collision_free(docs, "mean_pairs")}
        keyed = docs.withColumn(digest, F.coalesce(F.sha2(F.col(text), 256), F.lit("")))
        found = keyed.select(F.col(digest).alias("digest"), F.col(text).alias("text")).where("text is not null").dropDuplicates(["digest"]).mapInArrow(text_features, "digest string, level int, w long")
        total = {c: F.sum(F.when((F.col("level") == 0) == (c == out), F.col("ratio").cast("double"))) / F.count_if(F.col("level") == 0) for c in means}
        summed = found.join(table, ["level", "w"], "left").groupBy("digest").agg(*(x.alias(means[c]) for c, x in total.items()))
        joined = keyed.join(summed.withColumnRenamed("digest", digest), digest, "left")
        return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.coalesce(means[c], F.lit(0.0)).alias(c) for c in names[len(docs.columns) :]))

    def score(self, docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
        """`id`, score and predicted of every row, whole texts.

        Null, empty or word-less texts have a mean ratio of 0 and so the score of the intercept. Null and repeated ids
        stay, a row each; other columns are ignored. An empty table gives an empty result.
        """
        found = self.ratios(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", pairs="mean_pairs")
        return found.select(F.col("id").alias(id), self.curve().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    def curve(self, mean: str = "mean_ratio", pairs: str = "mean_pairs"):
        z = F.lit(self.slope) * F.asinh(F.col(mean) * STRETCH) + F.lit(self.pair_slope) * F.asinh(F.col(pairs) * STRETCH) + F.lit(self.intercept)
        return 1 / (1 + F.exp(-z))

    def keep(self, docs: DataFrame, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
        """The rows of `docs` that score below the threshold, all columns as they are, whatever their names.

        Null and empty texts and repeated rows are kept or go by their score like others; an empty table stays empty.
        Nothing is shuffled while the table of ratios is sent. A model that had no labelled rows keeps all rows.
        """
        if not self.learned:
            return docs
        mean, pairs = collision_free(docs, "mean_ratio"), collision_free(docs, "mean_pairs")
        return self.ratios(docs, text, mean, pairs).where(self.curve(mean, pairs) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def fit(labelled: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", calibrate: int = 20_000, most_sent: int = MOST_SENT) -> ToxicityModel:
    """Learns from all `labelled` rows whose label is 0 or 1 (others are left out).

    All rows give counts. As those of unequal collections don't compare, the larger class counts as it would be expected
    to if a part of its rows, the other's number, were drawn; the backoff has all. The curve is fitted on up to about
    `calibrate` rows of a quarter by the ratios that the other rows alone give: first for the words, then the bigrams'
    weight for what the words leave, never below 0. Without rows all scores are 0.5; with one class alone all ratios are 0.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("toxic"))
    held = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0
    n = {(r["toxic"], r["held"]): r["count"] for r in rows.groupBy("toxic", held.alias("held")).count().collect()}
    many, parts, shares = 100 * sum(n.values()), {"learned": False, "whole": True}, {}
    for name, part in parts.items():
        size = {y: n.get((y, False), 0) + (n.get((y, True), 0) if part else 0) for y in (0, 1)}
        shares[name] = {y: min(size.values()) / size[y] for y in size} if all(size.values()) else {}
    at = {name: shared_path(spark, f"toxic-{name}") for name in ("pairs", "words", "histories", "ratios")}
    counts = rows.select("text", "toxic", held.cast("int").alias("held")).mapInArrow(count_bigrams, "h long, w long, t long, o long")
    distinct = counts.groupBy("h", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).withColumn("h", F.shiftright("h", 32).cast("int"))
    write_and_clear(few_files(distinct, many), at["pairs"])
    pairs = spark.read.schema("h int, w long, t long, o long").parquet(at["pairs"])
    for key, sums, name in (("w", continuations, "words"), ("h", histories, "histories")):
        each = (F.struct(*sums(shares[x], part)).alias(x) for x, part in parts.items())
        write_and_clear(few_files(pairs.groupBy(key).agg(*each), many), at[name])
    kind, left = "struct<t: double, o: double, k: long>", "struct<nt: double, lt: double, no: double, lo: double>"
    words = spark.read.schema(f"w long, learned {kind}, whole {kind}").parquet(at["words"])
    before = spark.read.schema(f"h int, learned {left}, whole {left}").parquet(at["histories"])
    p = {x: probabilities(words, prefix=f"{x}.") for x in parts}
    if all(p.values()):
        of_words = words.select("w", *(p[x][c].alias(f"{x}_{c}") for x in parts for c in "to"))
        repeated = " or ".join(f"({c} & {(1 << 32) - 1}) + ({c} >> 32) > 1" for c in "to")
        ratio = {x: pair_ratio(shares[x], part, {c: F.col(f"{x}_{c}") for c in "to"}, {c: F.col(f"{x}.l{c}") for c in "to"}) for x, part in parts.items()}
        both = pairs.where(repeated).join(of_words, "w").join(before, "h").select("h", "w", *(beyond(r, DEAD).cast("float").alias(x) for x, r in ratio.items()))
        write_and_clear(few_files(both.where(" or ".join(f"{x} != 0" for x in parts)), many), at["ratios"])
    forget(spark, at["pairs"])

    def model(x: str) -> ToxicityModel:
        path = shared_path(spark, "toxic-model")
        found = log_ratios(words.select("w", f"{x}.*").where("k > 0")).select(F.lit(0).alias("level"), "w", "ratio")
        if all(p.values()):
            of_pairs = spark.read.schema("h int, w long, learned float, whole float").parquet(at["ratios"]).select("h", "w", F.col(x).alias("ratio"))
            of_histories = before.select("h", f"{x}.*").select("h", F.lit(0).cast("long").alias("w"), beyond(history_ratio(), DEAD).cast("float").alias("ratio"))
            for level, frame in ((1, of_pairs), (2, of_histories)):
                found = found.unionByName(frame.where("ratio != 0").mapInArrow(keyed_pairs, "w long, ratio float").select(F.lit(level).alias("level"), "w", "ratio"))
        few_files(found, many).write.parquet(path)
        return ToxicityModel(path, spark.read.schema("w long, ratio float").parquet(path).count(), most_sent=most_sent)

    got = model("learned").ratios(bounded_sample(rows.where(held), "id", calibrate).select("toxic", "text"), "text", pairs="mean_pairs").select("toxic", "mean_ratio", "mean_pairs").toPandas()
    found = model("whole")
    found.learned = len(got) > 0
    if len(got):
        y = got["toxic"].to_numpy().astype(float)
        x, more = (np.arcsinh(STRETCH * got[c].to_numpy()) for c in ("mean_ratio", "mean_pairs"))
        found.slope, found.intercept = fit_logistic(x, y)
        slope, intercept = fit_logistic(more, y, offset=found.slope * x + found.intercept)
        if slope > 0:
            found.pair_slope, found.intercept = slope, found.intercept + intercept
    return found
