"""Scenes of moving objects as JSON: one document a file, read as rows of keyframes, and written from such rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of bed channels, ways between two points, members of an object, a point and an orientation.
BED = ["lr", "c", "lfe", "ls_rs", "lb_rb", "tfl_tfr", "tsl_tsr", "tbl_tbr", "lw_rw", "lfe2"]
WAYS = ["hold", "linear", "smooth"]
OBJECT, POINT = ["name", "bed", "automation"], ["t", "x", "y", "z", "gain", "lfe", "interp"]
ANGLES = ["yaw", "pitch", "roll"]


def _members(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(v: Column, path: str, default: float | None = None) -> Column:
    """A member that is a number; otherwise an error, or a default where it is absent."""
    is_number = _kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    value = F.when(is_number, F.try_variant_get(v, path, "double")).when(_kind(v, path).isNotNull(), F.raise_error(F.lit(f"not a scene: {path[2:]} is no number")).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def _fault(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, what in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"not a scene: {what}")).cast("string")).otherwise(out)
    return out


def read_scene_json(spark: SparkSession, path: str | list[str], field: str, version: int = 1) -> DataFrame:
    """(file, yaw_rad, pitch_rad, roll_rad, object, name, bed, time_s, x, y, z, gain, lfe_send, interp), a row a point.

    `field` is the member that holds the format's version. A gain is 1, an lfe 0, the way linear, an angle 0 by default;
    angles are given in radians or degrees. Unknown or missing members, other labels or ways, a number that is none, and
    an angle in both units fail the read: a scene that is wrong in silence is worse. An object without points has one
    row with nulls.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
    turn = F.try_variant_get("doc", "$.orientation", "variant")
    angle = lambda a: F.coalesce(_number(F.col("turn"), f"$.{a}_rad"), _number(F.col("turn"), f"$.{a}_deg") * (math.pi / 180), F.lit(0.0)).alias(f"{a}_rad")
    both = lambda a: F.try_variant_get("turn", f"$.{a}_rad", "variant").isNotNull() & F.try_variant_get("turn", f"$.{a}_deg", "variant").isNotNull()
    turns = F.array(*(F.lit(f"{a}_{u}") for a in ANGLES for u in ("rad", "deg")))
    docs = docs.withColumn("turn", turn).withColumn("_fault", _fault(
        (F.col("doc").isNull() | _members(F.col("doc")).isNull(), "no JSON object"),
        (F.coalesce(F.try_variant_get("doc", f"$.{field}", "int"), F.lit(-1)) != version, f"{field} is not {version}"),
        (F.size(F.array_except(_members(F.col("doc")), F.array(F.lit(field), F.lit("orientation"), F.lit("objects")))) > 0, "unknown member"),
        (F.try_variant_get("doc", "$.objects", "array<variant>").isNull(), "no list of objects"),
        (F.col("turn").isNotNull() & (F.size(F.array_except(F.coalesce(_members(F.col("turn")), F.array(F.lit("?"))), turns)) > 0), "unknown member of the orientation"),
        (both("yaw") | both("pitch") | both("roll"), "an angle in both units"),
    ))
    objects = docs.select("file", "_fault", *map(angle, ANGLES), F.posexplode(F.try_variant_get("doc", "$.objects", "array<variant>")).alias("object", "o"))
    label = F.try_variant_get("o", "$.bed", "array<string>")
    points = F.try_variant_get("o", "$.automation", "array<variant>")
    objects = objects.withColumn("_fault", F.coalesce("_fault", _fault(
        (F.size(F.array_except(_members(F.col("o")), F.array(*map(F.lit, OBJECT)))) > 0, "unknown member of an object"),
        (points.isNull(), "an object without automation"),
        (_kind(F.col("o"), "$.bed").isNotNull() & label.isNull() | F.exists(F.coalesce(label, F.array()), lambda x: ~F.coalesce(x, F.lit("?")).isin(BED)), "unknown bed label"),
        (_kind(F.col("o"), "$.name").isNotNull() & (_kind(F.col("o"), "$.name") != "STRING"), "a name that is no text"),
    )))
    head = ["file", *(f"{a}_rad" for a in ANGLES), "object"]
    rows = objects.select(*head, "_fault", F.coalesce(F.try_variant_get("o", "$.name", "string"), F.lit("")).alias("name"), F.coalesce(label, F.array().cast("array<string>")).alias("bed"), F.posexplode_outer(points).alias("_k", "p"))
    way = F.coalesce(F.try_variant_get("p", "$.interp", "string"), F.lit("linear"))
    here = F.col("p").isNotNull()
    rows = rows.withColumn("_fault", F.coalesce("_fault", F.when(here, _fault(
        (F.size(F.array_except(_members(F.col("p")), F.array(*map(F.lit, POINT)))) > 0, "unknown member of a point"),
        (F.size(F.array_intersect(_members(F.col("p")), F.array(*map(F.lit, POINT[:4])))) < 4, "a point needs t, x, y and z"),
        (~way.isin(WAYS), "unknown way between points"),
    ))))
    number = lambda k, default=None: F.when(here, _number(F.col("p"), f"$.{k}", default))
    out = rows.select(*head, "name", "bed", number("t").alias("time_s"), number("x").alias("x"), number("y").alias("y"), number("z").alias("z"), number("gain", 1.0).alias("gain"), number("lfe", 0.0).alias("lfe_send"), F.when(here, way).alias("interp"), "_fault")
    return out.where("_fault IS NULL").drop("_fault")


def scene_documents(rows: DataFrame, field: str, version: int = 1) -> DataFrame:
    """(file, value): the rows of `read_scene_json` as a JSON document a file, objects and points in their order."""
    point = F.struct(F.col("time_s").alias("t"), "x", "y", "z", "gain", F.col("lfe_send").alias("lfe"), "interp")
    turns = [f"{a}_rad" for a in ANGLES]
    objects = rows.groupBy("file", *turns, "object").agg(F.first("name").alias("name"), F.first("bed").alias("bed"), F.sort_array(F.collect_list(F.when(F.col("time_s").isNotNull(), point))).alias("automation"))
    each = objects.groupBy("file", *turns).agg(F.sort_array(F.collect_list(F.struct("object", "name", "bed", "automation"))).alias("o"))
    listed = F.transform("o", lambda x: F.struct(x["name"].alias("name"), x["bed"].alias("bed"), x["automation"].alias("automation")))
    return each.select("file", F.to_json(F.struct(F.lit(version).alias(field), F.struct(*turns).alias("orientation"), listed.alias("objects"))).alias("value"))
