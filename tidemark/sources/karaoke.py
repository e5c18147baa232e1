"""Advanced SubStation Alpha files as lyrics: sung lines with the times of their syllables, and who sings them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.histories import numbered_lines

#: The order of an event's fields where a file names none; tags that begin a syllable of so many hundredths.
FIELDS = "layer start end style name marginl marginr marginv effect text".split()
TAG = r"\\(?:kf|ko|k|K)(\d+)"
SUNG = rf"\{{[^}}]*\\(?:kf|ko|k|K)\d+[^}}]*\}}"


def _millis(stamp: Column) -> Column:
    pattern = r"^(\d+):(\d\d):(\d\d)[.:](\d\d)$"
    part = lambda k: F.regexp_extract(stamp, pattern, k).cast("long")
    return F.when(stamp.rlike(pattern), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4) * 10)


def _plain(text: Column) -> Column:
    """Text without override blocks; its breaks are spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nnh]", " ")


def syllables(text: Column, start_ms: Column) -> Column:
    """(text, start_ms, end_ms) of every syllable: each lasts as its tag says, from the end of the one before. What comes
    before the first tag has no length; a text without tags has none."""
    parts = F.filter(F.split(text, f"(?={SUNG})"), lambda x: x != "")

    def spans(part):
        tags = F.transform(F.regexp_extract_all(F.regexp_extract(part, rf"^{SUNG}", 0), F.lit(TAG), 1), lambda d: d.cast("long") * 10)
        total = F.aggregate(tags, F.lit(0).cast("long"), lambda a, d: a + d)
        last = F.coalesce(F.get(tags, F.size(tags) - 1), F.lit(0))
        return F.struct(_plain(part).alias("text"), total.alias("all"), last.alias("own"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>").alias("out"))

    def step(s, x):
        end = s["at"] + x["all"]
        word = F.struct(x["text"].alias("text"), (start_ms + end - x["own"]).alias("start_ms"), (start_ms + end).alias("end_ms"))
        return F.struct(end.alias("at"), F.array_append(s["out"], word).alias("out"))

    found = F.aggregate(F.transform(parts, spans), zero, step, lambda s: s["out"])
    return F.when(text.rlike(SUNG), F.filter(found, lambda w: (F.trim(w["text"]) != "") | (w["end_ms"] > w["start_ms"]))).otherwise(F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>"))


def read_ass(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq, start_ms, end_ms, text, words, style, actor, singer) of a file's dialogue, by line.

    Drawings and comments are no lyrics. Of lines that repeat another exactly one is read. Of lines at one start and end
    in different styles those in a style without a sung one are left out where some are sung, else those that are not in
    the file's commonest style there. Where two actors are named on the sung lines, or else two styles are used on them,
    they are the singers 1 and 2 in the order they come; otherwise singer is null. Events without times are left out.
    """
    ordered = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("line").rlike(r"^\s*\[.*\]\s*$"), F.lower(F.trim("line"))), ignorenulls=True).over(ordered)
    lines = numbered_lines(spark, path).withColumn("section", section).where("section = '[events]'")
    order = F.transform(F.split(F.regexp_extract("line", r"^\s*Format:(.*)$", 1), ","), lambda x: F.lower(F.trim(x)))
    order = F.coalesce(F.last(F.when(F.col("line").rlike(r"^\s*Format:"), order), ignorenulls=True).over(ordered), F.array(*map(F.lit, FIELDS)))
    events = lines.withColumn("order", order).where(F.col("line").rlike(r"^\s*Dialogue:"))
    events = events.withColumn("f", F.split(F.regexp_extract("line", r"^\s*Dialogue:\s?(.*)$", 1), ",", F.size("order")))
    field = lambda name: F.coalesce(F.get("f", (F.array_position("order", name) - 1).cast("int")), F.lit(""))
    got = events.select("file", "seq", _millis(F.trim(field("start"))).alias("start_ms"), _millis(F.trim(field("end"))).alias("end_ms"), F.trim(field("style")).alias("style"), F.trim(field("name")).alias("actor"), field("text").alias("raw"))
    got = got.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & ~F.col("raw").rlike(r"\{[^}]*\\p[1-9][^}]*\}"))
    got = got.withColumn("words", syllables(F.col("raw"), F.col("start_ms"))).withColumn("text", F.trim(F.regexp_replace(_plain(F.col("raw")), r"\s+", " ")))
    same = Window.partitionBy("file", "start_ms", "end_ms", "style", "actor", "text", "words").orderBy("seq")
    got = got.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").withColumn("sung", F.size("words") > 0)
    moment, file = Window.partitionBy("file", "start_ms", "end_ms"), Window.partitionBy("file")
    often = F.count(F.lit(1)).over(Window.partitionBy("file", "style"))
    got = got.withColumns({"_some": F.max("sung").over(moment), "_mine": F.max("sung").over(Window.partitionBy("file", "start_ms", "end_ms", "style")), "_often": often})
    rank = F.struct((-F.col("_often")).alias("n"), F.col("style").alias("style"))
    got = got.withColumn("_first", F.min(rank).over(moment)).where(F.when(F.col("_some"), F.col("_mine")).otherwise(F.col("style") == F.col("_first.style")))

    for name in ("actor", "style"):
        got = got.withColumn(f"_{name}", F.min(F.when(F.col("sung") & (F.col(name) != ""), F.col("seq"))).over(Window.partitionBy("file", name)))
        got = got.withColumn(f"_{name}s", F.array_sort(F.collect_set(F.when(F.col("sung"), F.col(f"_{name}"))).over(file)))
    by = lambda name: F.when(F.size(f"_{name}s") == 2, F.nullif(F.array_position(f"_{name}s", F.col(f"_{name}")).cast("int"), F.lit(0)))
    singer = F.when(F.col("sung"), F.when(F.size("_actors") == 2, by("actor")).otherwise(by("style")))
    return got.select("file", "seq", "start_ms", "end_ms", "text", "words", "style", "actor", singer.alias("singer"))
