"""Spelling variants: words one edit apart, met through their three rarest bigrams, and the common form behind each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, sent_if_small, shared_path

#: What a word is made of.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id: str, text: str, least: int = 6) -> DataFrame:
    """(id, run) of every maximal run of letters of `least` code points or more; only A-Z are lower-cased.

    Null and empty texts give none; repeated rows give theirs again; a null id stays null.
    """
    every = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    found = docs.select(F.col(id).alias("id"), F.explode(every).alias("run"))
    return found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))


def vocabulary(words: DataFrame, word: str, least: int = 6, often: int = 5) -> DataFrame:
    """(word, n) of the words that have `least` code points and occur `often` times, or more of either."""
    counted = words.where(F.char_length(word) >= least).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= often)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, gram, at) of the three first bigrams of every word, in the order of their frequency among all words.

    Of equally frequent bigrams the smaller comes first, of equal ones the earlier place. An edit leaves the order of the
    bigrams that it doesn't touch as it is, and it touches two of either word at the most; so the first untouched one is
    among the three of both words.
    """
    place = F.sequence(F.lit(1), F.char_length("word") - 1)
    spread = words.where(F.char_length("word") > 1).select("word", "n", F.explode(place).alias("at"))
    spread = spread.select("word", "n", F.col("word").substr(F.col("at"), F.lit(2)).alias("gram"), "at")
    often = sent_if_small(spread.groupBy("gram").agg(F.count(F.lit(1)).alias("often")))
    ordered = spread.join(often, "gram").groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "at"))), 1, 3).alias("first"))
    return ordered.select("word", "n", F.explode("first").alias("x")).select("word", "n", "x.gram", "x.at")


def _keys(longer: int):
    """The join keys of a bigram's place, for a partner as long as the word or (`longer` = 1) for one that lacks a letter.

    The edit is behind the bigram or before it; that side's other half, the bigram and the other side stay as they are,
    each at its place from the start or the end. The key holds all of it, so a bigram that many words share is no hot key.
    """
    before, after = F.col("word").substr(F.lit(1), F.col("at") - 1), F.expr("substring(word, at + 2)")
    size, keys = F.char_length("word") - longer, []
    for kind, fixed, free in ((0, before, after), (2, after, before)):
        rest = F.char_length(free) - longer  # of the shorter word
        half = F.floor(rest / 2).cast("int")
        parts = (F.left(free, half), F.right(free, rest - half))
        keys += [F.when(rest >= 0, F.xxhash64(F.lit(kind + k), size, fixed, F.col("gram"), part)) for k, part in enumerate(parts)]
    return F.array_compact(F.array(*keys))


def near_pairs(words: DataFrame) -> DataFrame:
    """(u, u_n, v, v_n) of all pairs of words (word, n) that one inserted, deleted or replaced code point tells apart, once each.

    Words of fewer than six code points may be missed: they have too few bigrams. Both sides of the join grow with the
    vocabulary, and Spark's estimate leaves out what explode() makes of a row; so it is told not to send either of them.
    """
    first = rarest_bigrams(words)
    same = first.select("word", "n", F.explode(_keys(0)).alias("key"))
    long = first.select("word", "n", F.explode(_keys(1)).alias("key"))
    left = same.select("key", F.col("word").alias("u"), F.col("n").alias("u_n"))
    right = same.withColumn("longer", F.lit(False)).unionByName(long.withColumn("longer", F.lit(True)))
    right = right.select("key", F.col("word").alias("v"), F.col("n").alias("v_n"), "longer")
    met = left.join(right.hint("merge"), (left["key"] == right["key"]) & (F.col("longer") | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1))
    return met.select("u", "u_n", "v", "v_n").distinct()


def nearest_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones; form is the most frequent of them, of equally
    frequent ones the smallest, and null unless it is `ratio` times as frequent as the word."""
    pairs = near_pairs(words)
    sides = F.array(*(F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(b).alias("word")).alias("other")) for a, b in ("uv", "vu")))
    found = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    much = -F.col("best.less") >= ratio * F.col("n")
    return found.select("word", "n_near", F.when(much, F.col("best.word")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for the links (word, form), at most one a word and without circles: where following forms ends.

    Every round doubles the steps that a row has taken; each is a table in the shared folder, and the one before is deleted.
    """
    spark, old = links.sparkSession, None
    now, moved = links.select("word", F.col("form").alias("root")), True
    while moved:
        path = shared_path(spark, "roots")
        now.write.parquet(path)
        if old:
            forget(spark, old)
        old, rows = path, spark.read.schema("word string, root string").parquet(path)
        onward = rows.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = bool(rows.join(onward.hint("merge"), "root", "left_semi").head(1))
        now = rows.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    return rows


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, form, form_n, n_near and root of every row of the vocabulary `words` (word, n; distinct words).

    A word without near words has n_near 0 and itself as root; an empty vocabulary gives no rows. Forms grow by `ratio`
    (2 or more) at each step, so following them ends.
    """
    spark = words.sparkSession
    path = shared_path(spark, "vocabulary")
    words.select("word", "n").write.parquet(path)
    words = spark.read.schema("word string, n long").parquet(path)
    at = shared_path(spark, "forms")
    nearest_forms(words, ratio).write.parquet(at)
    forms = spark.read.schema("word string, n_near long, form string, form_n long").parquet(at)
    ends = roots(forms.where("form IS NOT NULL").select("word", "form"))
    found = words.join(forms.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return found.select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("root", "word").alias("root"))
