"""How filters interact: which documents every filter would remove, alone and after others, in all orders."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import split_evenly

#: The separators of words.
SPACE = r"[ \t-\r]+"


def word_totals(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, digest, n_words, n_distinct) of every pair of an id and a text.

    Words are exploded and counted by document and word, then by document. The texts are dealt by document first, once,
    so neither count shuffles words; a document's words are a stream in its task, not a list of pairs. Every text gives an
    empty word of its own as well: so wordless texts are there, and rows that repeat an id and a text count once.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    dealt = docs.select(F.col(id).alias("id"), F.xxhash64(whole).alias("digest"), whole.alias("text")).repartition("id", "digest")
    words = F.array_prepend(F.array_remove(F.split("text", SPACE), ""), F.lit(""))
    counted = dealt.select("id", "digest", F.explode(words).alias("word")).groupBy("id", "digest", "word").agg(F.count(F.lit(1)).alias("n"))
    empty = F.col("word") == ""
    totals = counted.groupBy("id", "digest").agg(F.max(F.when(empty, F.col("n"))).alias("rows"), F.sum(F.when(empty, 0).otherwise(F.col("n"))).alias("n"), F.count_if(~empty).alias("n_distinct"))
    return totals.select("id", "digest", F.expr("n div rows").alias("n_words"), "n_distinct")


def first_copies(rows: DataFrame) -> DataFrame:
    """(print, first): of every text, by its `print`, the smallest id that has it; nulls don't count."""
    return split_evenly(rows.groupBy("print").agg(F.min("id").alias("first")), "print")


def failures(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """(id, part, a, b, c, d, e) for every row: whether it fails each of five filters.

    a: under 50 words; b: distinct words under 65 % of the words; c: over 5 % capital letters A-Z; d: any of # $ % & * |;
    e: the same text as a row with a smaller id. A null text is empty; a row without an id is nobody's copy, and nobody
    is a copy of it; repeated rows stay rows of their own. Equal texts are known by SHA-256.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(whole).alias("digest"), F.unhex(F.sha2(whole, 256)).alias("print"),
        (100 * F.regexp_count(whole, F.lit("[A-Z]")) > 5 * F.char_length(whole)).alias("c"), whole.rlike("[#$%&*|]").alias("d"),
    )
    totals = word_totals(docs, id, text).withColumnsRenamed({"id": "_id", "digest": "_digest"})
    found = rows.join(totals, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").join(first_copies(rows), "print", "left")
    return found.select("id", "part", (F.col("n_words") < 50).alias("a"), (100 * F.col("n_distinct") < 65 * F.col("n_words")).alias("b"), "c", "d", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("e"))


def with_outcomes(flagged: DataFrame, labels: DataFrame, id: str, **outcomes: Column) -> DataFrame:
    """The flagged rows with a boolean for each outcome: whether any label row of their id has it. Ids without labels have none."""
    known = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(*(F.max(F.coalesce(x, F.lit(False))).alias(name) for name, x in outcomes.items()))
    return flagged.join(known, "id", "left").fillna(False, list(outcomes))


def lattice(flagged: DataFrame, filters: list[str], outcomes: list[str], part: str = "part") -> DataFrame:
    """A row for each part: conditional counts of its rows for every set of failed filters (bit k: filters[k]), as an array
    `n`, and an array for each outcome. Rows are counted by part and set first, so a part that holds most rows is no task's."""
    failed = sum((F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    sets = flagged.groupBy(part, failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(x)).alias(x) for x in outcomes))
    counts = [F.sum(F.when(F.col("failed") == k, F.col(x)).otherwise(0)).alias(f"{x}_{k}") for x in ("n", *outcomes) for k in range(1 << len(filters))]
    wide = sets.groupBy(part).agg(*counts)
    return wide.select(part, *(F.array(*(f"{x}_{k}" for k in range(1 << len(filters)))).alias(x) for x in ("n", *outcomes)))


def in_all_orders(counts: DataFrame, names: str, outcomes: dict[str, str], part: str = "part") -> DataFrame:
    """What each filter does at each step of each order, from the counts of `lattice`; `names` has a letter for each filter.

    kept after the step, removed by it, redundant (failing, but removed before), unique_fails (failing this filter alone),
    the outcomes removed by it under the names of `outcomes`, and shapley: the filter's removals summed over all orders.
    """
    orders = list(permutations(range(len(names))))
    steps = [(order, step, sum(1 << k for k in order[:step]), 1 << order[step]) for order in orders for step in range(len(names))]
    cells = F.array(*(F.struct(F.lit("".join(names[k] for k in order)).alias("filter_order"), F.lit(step + 1).alias("step"), F.lit(earlier).alias("earlier"), F.lit(bit).alias("bit")) for order, step, earlier, bit in steps))
    earlier, bit = F.col("cell.earlier"), F.col("cell.bit")
    # of the filters that a document fails, each comes first in an equal share of the orders
    shares = F.array(*(F.lit(len(orders) // max(1, k.bit_count())) for k in range(1 << len(names))))

    def total(of, wanted, weight=lambda k: F.lit(1)):
        kept = F.transform(of, lambda x, k: F.when(wanted(k), x * weight(k)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x)

    def fails(k):
        return k.bitwiseAND(bit) != 0

    def removed(k):
        return fails(k) & (k.bitwiseAND(earlier) == 0)

    found = counts.select("*", F.explode(cells).alias("cell"))
    return found.select(
        part, "cell.filter_order", "cell.step", total("n", lambda k: k.bitwiseAND(earlier.bitwiseOR(bit)) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda k: fails(k) & (k.bitwiseAND(earlier) != 0)).alias("redundant"), F.get("n", bit).alias("unique_fails"), *(total(x, removed).alias(name) for x, name in outcomes.items()),
        total("n", fails, lambda k: F.get(shares, k)).alias("shapley"),
    )
