"""Which file an include means: by its place beside the includer, else by any name that a file can be included under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A private file can be named by the last parts of its path, up to so many.
LONGEST = 5


def normal_path(path: Column) -> Column:
    """The path without empty and '.' parts, each '..' taking a part away; a '..' with nothing to take stays."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))

    def step(kept, x):
        goes = (x == "..") & (F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("..")) != "..")
        return F.when(goes, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def spellings(files: DataFrame, path: str = "path", lib: str = "lib") -> DataFrame:
    """(spelling, path, lib, public) of all names that the files have: what follows include/ for a public file, for any
    other one every end of its path up to five parts. A template's name is that without its .in."""
    name = F.regexp_replace(path, r"(\.hp?p?)\.in$", "$1")
    named = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(lib).alias("lib"), name.alias("_name"), name.contains("/include/").alias("public"))
    every = F.when(F.col("public"), F.array(F.expr("substring(_name, instr(_name, '/include/') + 9)")))
    parts = F.split("_name", "/")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(parts))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))
    return named.select(F.explode(F.coalesce(every, ends)).alias("spelling"), "path", "lib", "public")


def resolve(includes: DataFrame, files: DataFrame) -> DataFrame:
    """The includes (path, lib, spelling) with target, target_lib, is_public and libs, for the files (path, lib).

    A file beside the includer, by its path joined with the spelling, comes first; then the includer's own library, then
    public files, then any, the smallest path of each. `libs` lists the libraries of an ambiguous spelling: more than one
    has it, and the includer's is none of them. What nothing matches has nulls; repeated includes stay; null spellings
    match nothing. Names are counted by spelling before they meet the includes, so a name that thousands of files have
    is one row in the join.
    """
    known = spellings(files)
    own = known.groupBy("spelling", "lib").agg(F.min("path").alias("own")).withColumnsRenamed({"spelling": "_s", "lib": "_l"})
    best = known.groupBy("spelling").agg(F.min_by(F.struct("path", "lib"), F.struct((~F.col("public")).alias("p"), "path")).alias("best"), F.sort_array(F.collect_set("lib")).alias("all")).withColumnRenamed("spelling", "_t")
    beside = files.where(F.col("path").isNotNull()).groupBy(F.col("path").alias("_beside")).agg(F.min("lib").alias("beside_lib"))
    joined = normal_path(F.concat_ws("/", folder_of(F.col("path")), F.col("spelling")))
    found = includes.withColumn("_at", F.when(F.col("spelling").isNotNull(), joined)).join(beside, F.col("_at") == F.col("_beside"), "left")
    found = found.join(own, (F.col("spelling") == F.col("_s")) & (F.col("lib") == F.col("_l")), "left").join(best, F.col("spelling") == F.col("_t"), "left")
    near, mine = F.col("_beside").isNotNull(), F.col("own").isNotNull()
    target = F.coalesce("_beside", "own", "best.path")
    return found.select(
        *includes.columns, target.alias("target"), F.when(near, F.col("beside_lib")).when(mine, F.col("lib")).otherwise(F.col("best.lib")).alias("target_lib"),
        target.contains("/include/").alias("is_public"), F.when(~near & ~mine & (F.size("all") > 1), F.col("all")).alias("libs"),
    )
