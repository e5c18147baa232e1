"""Timed text and scene keyframes as rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.audio import lrc_time, parse_lrc_time

STAMP = r"\[\d+:[0-5]?\d(?:[.:]\d{1,3})?\]"


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))


def read_lrc(spark: SparkSession, path) -> DataFrame:
    """(file, seq, start_ms, end_ms, text): a line for each of its stamps, in time order; the last has no end.

    Lines without a stamp (tags, blanks) are left out; stamps within the text are removed.
    """
    got = _lines(spark, path).where(F.col("line").rlike(rf"^\s*{STAMP}"))
    lead = F.regexp_extract(F.trim("line"), rf"^((?:{STAMP})+)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), rf"^(?:{STAMP})+", ""), r"<\d+:\d+(?:[.:]\d+)?>", ""))
    rows = got.select("file", "seq", F.explode(F.regexp_extract_all(lead, F.lit(f"({STAMP})"), 1)).alias("_s"), text.alias("text")).withColumn("start_ms", parse_lrc_time(F.col("_s")))
    w = Window.partitionBy("file").orderBy("start_ms", "seq")
    return rows.select("file", "seq", "start_ms", F.lead("start_ms").over(w).alias("end_ms"), "text")


def read_subrip(spark: SparkSession, path) -> DataFrame:
    """(file, seq, start_ms, end_ms, text) of SubRip cues; markup is removed, lines of a cue are joined by spaces."""
    pattern = r"(\d+):(\d\d):(\d\d)[,.](\d{3})\s*-->\s*(\d+):(\d\d):(\d\d)[,.](\d{3})[^\n]*\n([\s\S]*)"
    cues = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), r"\n\s*\n")).alias("seq", "cue"))
    part = lambda k: F.regexp_extract("cue", pattern, k).cast("long")
    at = lambda k: ((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("cue", pattern, 9), "<[^>]*>", ""), r"\s+", " "))
    return cues.where(F.col("cue").rlike(pattern)).select("file", "seq", at(1).alias("start_ms"), at(5).alias("end_ms"), text.alias("text"))


def lrc_lines(rows: DataFrame, start: str = "start_ms", text: str = "text") -> DataFrame:
    """Rows as lines of LRC text (column value), for a text sink after ordering."""
    return rows.select(F.concat(lrc_time(F.col(start)), F.coalesce(F.col(text), F.lit(""))).alias("value"))


def read_scene(spark: SparkSession, path) -> DataFrame:
    """Keyframes `object time x y z [gain [lfe_send]]` by line: gain 1 and lfe_send 0 by default; # begins a comment.

    A line with fewer or other fields fails the read, as does an object with two keyframes at one time.
    """
    got = _lines(spark, path).withColumn("_f", F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")).where("_f[0] != ''")
    number = lambda k, default=None: F.get("_f", k).try_cast("double") if default is None else F.coalesce(F.get("_f", k).try_cast("double"), F.lit(default))
    rows = got.select("file", "seq", "line", F.get("_f", 0).try_cast("int").alias("object"), number(1).alias("time_s"), number(2).alias("x"), number(3).alias("y"), number(4).alias("z"), number(5, 1.0).alias("gain"), number(6, 0.0).alias("lfe_send"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("file", "object", "time_s")) > 1
    bad = F.greatest(*(F.col(c).isNull() for c in ("object", "time_s", "x", "y", "z")))
    fault = F.when(bad, F.raise_error(F.concat(F.lit("not a keyframe: "), "line"))).when(twice, F.raise_error(F.concat(F.lit("two keyframes at one time: "), "line")))
    return rows.withColumn("_fault", fault.cast("boolean")).where("_fault is null").drop("line", "seq", "_fault")


def scene_lines(rows: DataFrame) -> DataFrame:
    """Keyframes as lines of text (column value)."""
    return rows.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("object", "time_s", "x", "y", "z", "gain", "lfe_send"))).alias("value"))
