"""Quality rules: repetition and length, and the distance of a text's histograms from those of its language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import sent_if_small, shared_path

#: The separators of words.
SPACE = r"[ \t-\r]+"
#: Character classes; whatever is in none of them is a class of its own.
CLASSES = ["a-z", "A-Z", "0-9", r".,;:!?'\"()\-", r"\x80-\x{10FFFF}"]
#: Commonest words of a language that its reference holds.
COMMON = 20
#: A language needs so many words to be a reference.
LEAST_REFERENCE = 1000
#: A text needs so many words, or characters in words, to be compared.
LEAST_WORDS, LEAST_CHARS = 50, 200
#: Larger Jensen-Shannon distances (0 to 1) fail.
MOST_WORDS, MOST_CHARS = 0.45, 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, where `body` uses it several times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column, size: int = 5) -> Column:
    """How many words lie in windows of `size` words that a text has twice or more.

    Windows are known by 64-bit hashes. A text whose hashes are all different, as most are, is not looked at further;
    otherwise they are sorted with their places, so a text costs n log n however often it repeats itself.
    """

    def covered(places):
        steps = F.transform(places, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(places, i + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(ordered):
        twice = F.filter(ordered, lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(hashes):
        several = F.size(F.array_distinct(hashes)) < F.size(hashes)
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(several, let(ordered, repeats)).otherwise(F.lit(0).cast("long"))

    def windows(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(F.size(w) > size, let(hashes, count)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and their words as `words`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    rows = docs.withColumns({"words": words_of(whole), "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"), "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")})
    return rows.withColumns({"n_words": F.size("words").cast("long"), "n_repeat_words": repeated_words(F.col("words")), "joined": F.array_join("words", "")}).withColumn("word_chars", F.char_length("joined").cast("long"))


def class_counts(joined: Column) -> Column:
    """How many characters of each class a text without white space has: each class is left out of what is looked at next."""

    def step(left, k):
        if k == len(CLASSES):
            return F.array(F.char_length(left))
        return let(F.array_join(F.split(left, f"[{CLASSES[k]}]+"), ""), lambda rest: F.concat(F.array(F.char_length(left) - F.char_length(rest)), step(rest, k + 1)))

    return let(joined, lambda whole: step(whole, 0))


def references(docs: DataFrame, text: str, lang: str, common: int = COMMON) -> DataFrame:
    """(lang, ref) for every language of the rows that has words enough; ref holds the language's class shares, its
    commonest words and their shares, all counted over all rows with that language.

    Words are counted by language before they meet, and only the commonest of each task are ranked together.
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    counted = known.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    chars = known.select("lang", F.size("words").alias("size"), class_counts(F.array_join("words", "")).alias("c"))
    sums = chars.groupBy("lang").agg(F.sum("size").alias("size"), *(F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)))
    total = sum((F.col(f"c{k}") for k in range(1, len(CLASSES) + 1)), F.col("c0"))
    shares = F.array(*(F.col(f"c{k}") / total for k in range(len(CLASSES) + 1)))
    listed = F.transform("top", lambda x: x["n"] / F.col("size"))
    other = 1 - F.aggregate(listed, F.lit(0.0), lambda a, x: a + x)
    ref = F.struct(shares.alias("classes"), F.transform("top", lambda x: x["word"]).alias("words"), F.concat(F.array(other), listed).alias("shares"))
    return sums.join(top, "lang").where(F.col("size") >= LEAST_REFERENCE).select("lang", ref.alias("ref"))


def _half(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log2(2 * p / (p + q)) / 2).otherwise(0.0)


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def class_distance(counts: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance between class counts and shares."""
    n = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    terms = F.zip_with(counts, shares, lambda c, q: let(c / n, lambda p: _half(p, q) + _half(q, p)))
    return _root(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def word_distance(words: Column, common: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance between a text's words and shares of common words, the first share being all others'.

    Words become their places among the common ones; sorted, every run is a bin. Bins that a text lacks add half of
    their share, so they needn't be looked at.
    """

    def distance(places):
        ends = F.filter(F.sequence(F.lit(1), F.size(places)), lambda i: F.coalesce(F.get(places, i - 1) != F.get(places, i), F.lit(True)))
        return let(ends, lambda e: _root(F.aggregate(F.transform(e, lambda x, i: term(F.get(shares, F.get(places, x - 1).cast("int")), (x - F.coalesce(F.get(e, i - 1), F.lit(0))) / F.size(places))), F.lit(0.5), lambda a, x: a + x)))

    def term(q, p):
        return let(q, lambda q: let(p, lambda p: _half(p, q) + _half(q, p) - q / 2))

    return let(F.sort_array(F.transform(words, lambda w: F.array_position(common, w))), distance)


def judge(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The rows with the counts of `base_counts`, base_failed, word_distance, class_distance and kept.

    base_failed: under ten words, or over 20 % of them repeat. Otherwise a text is kept unless its words (if there are
    50 or more) or its characters (200 or more) are farther from its language's reference than allowed; a text whose
    language is null or too rare is compared with the nearest of all references. Shorter texts have no distance and are
    kept, as all are without any reference. A null text is empty; repeated rows are judged alike. Columns of the
    result's names are replaced.

    References are a few KB a language; they are written once, and sent if there are no more than a few thousand.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "references")
    references(docs, text, lang).coalesce(1).write.parquet(path)
    refs = spark.read.parquet(path)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    every = refs.agg(F.collect_list("ref").alias("every")).scalar()
    rows = base_counts(held, "text").join(sent_if_small(refs, 5000), "lang", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "refs": F.when(F.col("ref").isNull(), every).otherwise(F.array("ref")), "counts": F.when(F.col("word_chars") >= LEAST_CHARS, class_counts(F.col("joined")))})
    far = {
        "word_distance": F.when(~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS), F.array_min(F.transform("refs", lambda r: word_distance(F.col("words"), r["words"], r["shares"])))),
        "class_distance": F.when(~F.col("base_failed") & F.col("counts").isNotNull(), F.array_min(F.transform("refs", lambda r: class_distance(F.col("counts"), r["classes"])))),
    }
    within = (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORDS) & (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CHARS)
    rows = rows.withColumns(far).withColumn("kept", ~F.col("base_failed") & within)
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "word_distance", "class_distance", "kept"]
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in out), *out)
