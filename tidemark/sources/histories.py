"""Scans of measurement result trees, ordered histories, manifests and listening-test sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq, line) of text files, seq being the line's place in its file from 0, blank lines included.

    A file is read by as many tasks as it has blocks. The lines of every block are counted first; a block's lines then
    go on from the count of the blocks before it. Nothing is sorted and no line is moved; what is sent is a row a block.
    """
    place = F.monotonically_increasing_id()  # rises by one from line to line inside a block
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.option("lineSep", "\n").text(path).select(*where, place.alias("place"), F.regexp_replace("value", "\r$", "").alias("line"))
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("place") - F.col("first") + F.col("before")).alias("seq"), "line")


def parsed(lines: DataFrame, schema: str | StructType, *, skip_malformed: bool = True) -> DataFrame:
    """The frame's other columns and the fields of its JSON `line`. Blank lines are skipped; malformed ones too, or they
    fail the read."""
    mode = "PERMISSIVE" if skip_malformed else "FAILFAST"
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    marked = StructType([*kind.fields]).add("_corrupt_record", "string")
    got = lines.where("trim(line) != ''").withColumn("r", F.from_json("line", marked if skip_malformed else kind, {"mode": mode}))
    if skip_malformed:
        got = got.where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull())
    return got.select(*(c for c in lines.columns if c != "line"), *(F.col(f"r.`{f.name}`") for f in kind.fields))


def read_history(spark: SparkSession, path: str | list[str], schema: str | StructType, *, skip_malformed: bool = True) -> DataFrame:
    """JSON lines with `file` and `seq`, their place in the file: the order of a history is its time axis."""
    return parsed(numbered_lines(spark, path), schema, skip_malformed=skip_malformed)


def read_results(spark: SparkSession, root: str, schema: str, *, entries: str | None = "results", pattern: str = "bench*.json", prefix: str = "", environment: str | None = None, stem: str | None = None) -> DataFrame:
    """One row per entry of the result files in root/<leg>/, with `leg` (its prefix removed).

    `entries` names the array to flatten (None: a file is a record); file-level fields are repeated. `environment` is
    the schema of a side file environment.json, joined by leg where there is one. `stem` names a column for the file's
    stem.
    """
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(root)
    where = F.col("_metadata.file_path")
    leg = F.regexp_replace(F.regexp_extract(where, r"([^/]+)/[^/]+$", 1), f"^{prefix}", "")
    base = files.select("*", leg.alias("leg"), F.regexp_extract(where, r"([^/]+)\.[^./]+$", 1).alias("_stem"))
    base = base.where(F.col("_stem") != "environment")
    if entries:
        base = base.withColumn("_e", F.explode(entries)).select("leg", "_stem", *(c for c in files.columns if c != entries), "_e.*")
    if environment:
        side = spark.read.schema(environment).option("multiLine", True).option("pathGlobFilter", "environment.json").option("recursiveFileLookup", True).json(root)
        side = side.select("*", leg.alias("leg"))
        base = base.join(side, "leg", "left")
    return base.withColumnRenamed("_stem", stem) if stem else base.drop("_stem")


def load_runs(spark: SparkSession, root: str, *, entries: str, key: str, value: str, pattern: str = "*.json") -> DataFrame:
    """(workload, value) of every run file: an array `entries` of records with a name `key` and a number `value`."""
    return read_results(spark, root, f"{entries} array<struct<`{key}`: string, `{value}`: double>>", entries=entries, pattern=pattern).select(F.col(key).alias("workload"), F.col(value).alias("value"))


def unpivot_metrics(history: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) of the metrics that are there."""
    return history.unpivot(keys, metrics, "metric", "value").where("value is not null")


def read_manifest(spark: SparkSession, path: str, entry: str, *, field: str = "legs") -> DataFrame:
    """A JSON object whose `field` maps names to records, as rows (name, record's fields)."""
    got = spark.read.schema(f"`{field}` map<string, struct<{entry}>>").option("multiLine", True).json(path)
    return got.select(F.explode(field).alias("name", "_r")).select("name", "_r.*")


def read_responses(spark: SparkSession, paths: str | list[str], *, template: str = "responses_template.csv") -> DataFrame:
    """CSV rows with `_source`; template files and rows without any value are left out."""
    got = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(paths)
    source = got.select("*", F.col("_metadata.file_name").alias("_source")).where(F.col("_source") != template)
    filled = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in got.columns)) if got.columns else F.lit(None)
    return source.where(filled.isNotNull())


def read_key(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The method ('abx' if there is a column `system`, else 'mushra') and the key's rows; an empty key is an error."""
    got = spark.read.option("header", True).csv(path)
    if not got.columns or not got.take(1):
        raise ValueError(f"the key {path} has no rows")
    return ("abx" if "system" in got.columns else "mushra"), got


def scan_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """One row for each match of `pattern` in the lines of text files: file, names of its groups; time stamps and
    terminal escapes at a line's start are removed."""
    clean = F.regexp_replace(F.regexp_replace("value", "\\u001b\\[[0-9;]*[A-Za-z]", ""), r"^\d{4}-\d\d-\d\dT[\d:.]+Z?\s", "")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), clean.alias("line")).where(F.col("line").rlike(pattern))
    return lines.select("file", *(F.regexp_extract("line", pattern, k + 1).alias(n) for k, n in enumerate(names)))


#: A linker map's lines: a section's name with its place, size and origin, the latter alone, the name alone.
MAP_LINE = r"^\s(\.\w[\w.$-]*)\s+0x[0-9a-f]+\s+0x([0-9a-f]+)\s+(\S+)"
MAP_BODY = r"^\s+0x[0-9a-f]+\s+0x([0-9a-f]+)\s+(\S+)"
MAP_NAME = r"^\s(\.\w[\w.$-]*)\s*$"


def read_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq, section, kind, object, size) of the input sections in linker maps: kind text (code and constants) or
    bss, object the file's or archive member's name; empty sections and others are left out.

    A long name stands on a line of its own before its body; a line after a name is its body or nothing. The block of
    discarded sections, up to the next line that is not indented, is not in the image. The lines' order is a map's, so
    each file is sorted in one task.
    """
    ordered = Window.partitionBy("file").orderBy("seq")
    past = ordered.rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("Discarded input sections")
    state = F.last(F.when(head, F.lit(True)).when(F.col("line").rlike(r"^\S"), F.lit(False)), ignorenulls=True).over(past)
    lines = numbered_lines(spark, path).withColumns({"head": head, "gone": F.coalesce(state, F.lit(False))}).where(~F.col("gone") | F.col("head"))
    named = lines.withColumns({"named": ~F.col("head") & F.col("line").rlike(MAP_NAME) & ~F.col("line").rlike(MAP_LINE), "row": F.row_number().over(ordered)})
    # of names on consecutive lines the first waits for its body, the second is that body's place, and so on
    other = F.coalesce(F.last(F.when(~F.col("named"), F.col("row")), ignorenulls=True).over(past), F.lit(0))
    named = named.withColumn("waits", F.col("named") & ((F.col("row") - other) % 2 == 1))
    before = F.when(F.lag("waits").over(ordered), F.regexp_extract(F.lag("line").over(ordered), MAP_NAME, 1))
    full, body = F.col("line").rlike(MAP_LINE), F.col("line").rlike(MAP_BODY)
    section = F.when(full, F.regexp_extract("line", MAP_LINE, 1)).when(body, before)
    place = F.when(full, F.struct(F.regexp_extract("line", MAP_LINE, 2).alias("size"), F.regexp_extract("line", MAP_LINE, 3).alias("origin"))).otherwise(F.struct(F.regexp_extract("line", MAP_BODY, 1).alias("size"), F.regexp_extract("line", MAP_BODY, 2).alias("origin")))
    found = named.select("file", "seq", section.alias("section"), place.alias("place")).where("section IS NOT NULL")
    kind = F.when(F.col("section").rlike(r"^\.(text|rodata)"), "text").when(F.col("section").rlike(r"^\.(bss|tbss)"), "bss")
    member = F.regexp_replace(F.regexp_replace(F.regexp_replace("place.origin", r"^.*\(", ""), r"\)+$", ""), "^.*/", "")
    return found.select("file", "seq", "section", kind.alias("kind"), member.alias("object"), F.conv("place.size", 16, 10).cast("long").alias("size")).where("kind IS NOT NULL AND size > 0")


def changed_files(spark: SparkSession, folder: str, manifest: DataFrame, *, name: str = "name", digest: str = "sha256") -> DataFrame:
    """(name, state) of a folder's files that are not as a manifest has them: missing, changed (by SHA-256) or unlisted."""
    there = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("found"))
    listed = manifest.select(F.col(name).alias("name"), F.lower(digest).alias("wanted"))
    both = listed.withColumn("l", F.lit(True)).join(there.withColumn("t", F.lit(True)), "name", "full")
    state = F.when(F.col("t").isNull(), "missing").when(F.col("l").isNull(), "unlisted").when(~F.col("wanted").eqNullSafe(F.col("found")), "changed")
    return both.select("name", state.alias("state")).where("state IS NOT NULL")
