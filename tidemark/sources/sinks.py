"""Sinks: tidy traces, idempotent keyed appends, derived windows, badges and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.compare import unrecorded
from tidemark.operators.trailing import RECENT, recent_commits

#: Column names of a tidy trace (fixed values: readers expect them).
TRACE = ("frame", "substream", "block", "stream", "kind", "index", "value")


def tidy_trace(blocks: DataFrame, arrays: dict[str, str], *, keys: tuple[str, ...] = TRACE[:4], allocated: str = "allocated") -> DataFrame:
    """One row for each value of the arrays (kind by column) of allocated blocks: what reaches no block has no rows."""
    out = None
    for kind, column in arrays.items():
        got = blocks.where(F.col(allocated)).select(*keys, F.lit(kind).alias("kind"), F.posexplode(column).alias("index", "value"))
        out = got if out is None else out.unionByName(got)
    return out


def append_new(rows: DataFrame, history: DataFrame | None, keys: list[str], path: str) -> DataFrame:
    """Appends rows whose keys the history hasn't, one of each key, as JSON lines; returns all rows, so that they are
    judged anyway."""
    new = rows if history is None else unrecorded(rows, history, keys)
    new.dropDuplicates(keys).write.mode("append").json(path)
    return rows


def write_recent(history: DataFrame, commit: str, seq: str, path: str, *, n: int = RECENT) -> bool:
    """Writes the rows of the last `n` commits beside the history; nothing if it has no more than those."""
    if history.select(commit).distinct().limit(n + 1).count() <= n:
        return False
    recent_commits(history, commit, seq, n=n).orderBy(seq).coalesce(1).write.mode("overwrite").json(path)
    return True


def badge(label: Column, message: Column, color: Column) -> Column:
    return F.to_json(F.struct(F.lit(1).alias("schemaVersion"), label.alias("label"), message.alias("message"), color.alias("color")))


def report_line(*cells: Column, side: Column | None = None) -> Column:
    """A row of a report table; one-sided rows are marked with their side."""
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("-")) for c in cells)), F.lit(" |"))
    return text if side is None else F.when(side != "both", F.concat(text, F.lit(" "), side, F.lit(" |"))).otherwise(F.concat(text, F.lit("  |")))


def json_object(*columns: str) -> Column:
    """One JSON object of the columns by their names, in this order; nulls are left out."""
    return F.to_json(F.struct(*columns))
