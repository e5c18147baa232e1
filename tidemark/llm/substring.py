"""Substring deduplication with a log-structured index of window fingerprints.

Documents are dealt to parts by ranges of their ids. A part's distinct windows (13 words) are sorted into one run per
bucket of fingerprints; the runs of a bucket, those of the index first and then those of the batch in the order of ids,
are merge-joined, and a window that an earlier run has too is reported back to its part, if an independent check value
confirms it. The windows that are new become an immutable run of the index; `compact` merges its runs into one.
A run has a window once a part, however many documents repeat it, so a passage of half the corpus weighs no more.
The index lives in a folder: runs beside a manifest, of which each change writes a new version last, so that another
job can open it and a job that dies leaves it as it was.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import OTHER_BASE, collision_free, few_files, forget, give_back, run_hashes, shared_path, text_buffer, word_hashes, word_spans

#: Words of a window; bytes of text in a part; windows that a bucket has about.
WINDOW, PART_BYTES, BUCKET_WINDOWS = 13, 3 << 20, 600_000
#: The query's history: shares of the ids that go through the index one batch after the other, before the rest.
BATCHES = (0.03, 0.06, 0.09)
RUN = "bucket int, part int, fps binary, checks binary"


def windows(array, size: int = WINDOW):
    """Word spans and row bounds of a string array; row, start word, fingerprint and check value of its windows."""
    data, offsets = text_buffer(array)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.maximum(0, np.diff(bounds) - size + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[row]
    fps = run_hashes(words, size)[at] if len(at) else np.zeros(0, np.uint64)
    other = word_hashes(data, starts, ends, base_number=OTHER_BASE)  # from the bytes again: words that collide above don't here
    checks = (run_hashes(other, size)[at] if len(at) else np.zeros(0, np.uint64)).astype(np.uint8)
    return bounds, row, at, fps, checks


def squeeze(fps: np.ndarray) -> bytes:
    """A sorted run as gaps, each of as many bytes as the largest takes."""
    gaps = np.diff(fps, prepend=np.uint64(0))
    first, gaps[:1] = gaps[:1].tobytes(), 0
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return bytes([width]) + first + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def expand(raw: bytes) -> np.ndarray:
    width = raw[0]
    if len(raw) < 9:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :width] = body
    gaps = gaps.view("<u8").ravel()
    gaps[:1] = np.frombuffer(raw, "<u8", 1, 1)
    return np.cumsum(gaps, dtype=np.uint64)


def pack(bounds: np.ndarray, id: str, columns: list[str]):
    """For mapInArrow: rows as (part, compressed record batch). Rows without an id go by the hash of their place."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(columns)
            ids = batch.column(batch.schema.names.index(id))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
            part = np.where(known, part, np.arange(len(part)) % (len(bounds) + 1))
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            found, blobs = [], []
            for rows in np.split(order, cuts):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.take(pa.array(rows)))
                found.append(int(part[rows[0]]))
                blobs.append(zstandard.ZstdCompressor(level=1).compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["part", "rows"])
            del batch, blobs, order, rows
            give_back()

    return run


def unpack(blobs, id: str) -> pa.Table:
    """The rows of a part, the smallest ids first."""
    tables = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all() for b in blobs]
    return pa.concat_tables(tables).sort_by([(id, "ascending")]).combine_chunks()


def part_windows(table: pa.Table, id: str, text: str, size: int):
    """Windows of a part's rows with an id: (bounds, row, at, fps, checks, ids, first): first is a window's earliest."""
    array = table.column(text).chunk(0) if table.num_rows else pa.array([], pa.string())
    bounds, row, at, fps, checks = windows(array, size)
    ids = table.column(id)
    known = ids.is_valid().to_numpy()
    keep = known[row]
    row, at, fps, checks = row[keep], at[keep], fps[keep], checks[keep]
    distinct, first, inverse = np.unique(fps, return_index=True, return_inverse=True)
    return bounds, row, at, fps, checks, ids.fill_null(0).to_numpy(), distinct, first, inverse


def merge_runs(parts: list[int], runs: list[np.ndarray], checks: list[np.ndarray]):
    """Merge-joins sorted runs in their order: the first of each fingerprint, and which entries repeat a confirmed one."""
    fps, check = np.concatenate(runs), np.concatenate(checks)
    owner = np.repeat(np.array(parts), [len(r) for r in runs])
    order = np.argsort(fps, kind="stable")
    fps, check, owner = fps[order], check[order], owner[order]
    fresh = np.concatenate([[True], fps[1:] != fps[:-1]]) if len(fps) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(fps) else np.zeros(0, int)
    return fps, check, owner, fresh, ~fresh & (check == check[first])


class SubstringIndex:
    """Runs of historical window fingerprints in the folder `path`, for batches whose ids grow from one to the next.

    A folder that has a manifest is opened as it is, with its own number of buckets and window; a new one takes those
    given. `most_runs` runs are merged into one when a batch adds another.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, buckets: int = 1, window: int = WINDOW, most_runs: int = 2):
        self.spark, self.path, self.most_runs = spark, path or shared_path(spark, "substring-index"), most_runs
        self.version, found = self._newest()
        self.buckets, self.window, self.runs = (found["buckets"], found["window"], list(found["runs"])) if found else (buckets, window, [])

    def _newest(self):
        """The number and the content of the latest complete version of the manifest."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
        done = [int(n) for n in names if n.isdigit() and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(place, f"{n}/_SUCCESS"))]
        if not done:
            return 0, None
        return max(done), self.spark.read.schema("buckets int, window int, runs array<string>").json(f"{self.path}/manifest/{max(done)}").first()

    def commit(self, runs: list[str]) -> None:
        """Makes `runs` the index: a new version of the manifest, which is written after them."""
        self.version += 1
        content = self.spark.createDataFrame([(self.buckets, self.window, runs)], "buckets int, window int, runs array<string>")
        content.coalesce(1).write.json(f"{self.path}/manifest/{self.version}")
        self.runs = runs

    def history(self) -> DataFrame:
        runs = [self.spark.read.schema(f"{RUN}, new boolean").parquet(f"{self.path}/{r}").where("new").drop("new") for r in self.runs]
        return functools.reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], RUN)

    def join(self, packed: DataFrame, id: str, text: str, new_run: bool) -> DataFrame:
        """(bucket, part, fps, checks): by part the windows that an earlier run has; part -1 has the new run."""
        size, shift = self.window, np.uint64(64 - int(math.log2(self.buckets)))
        buckets = self.buckets

        def of_part(key, table):
            *_, fps, checks, _, distinct, first, _ = part_windows(unpack(table.column("rows").to_pylist(), id), id, text, size)
            bucket = (distinct >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(distinct), np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            out = pa.table({
                "bucket": pa.array(used, pa.int32()),
                "part": pa.array([key[0].as_py()] * len(used), pa.int32()),
                "fps": pa.array([squeeze(distinct[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
                "checks": pa.array([checks[first[cuts[b] : cuts[b + 1]]].tobytes() for b in used], pa.binary()),
            })
            del bucket, fps, checks, distinct, first
            give_back()
            return out

        def of_bucket(key, table):
            table = table.sort_by([("part", "ascending")])
            parts = table.column("part").to_pylist()
            runs = [expand(x) for x in table.column("fps").to_pylist()]
            fps, check, owner, fresh, hit = merge_runs(parts, runs, [np.frombuffer(x, np.uint8) for x in table.column("checks").to_pylist()])
            out = []
            to = owner[hit]
            order = np.argsort(to, kind="stable")
            found, to = fps[hit][order], to[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if to[a] >= 0:
                    out.append((int(to[a]), squeeze(found[a:b]), None))
            if new_run:
                new = fresh & (owner >= 0)
                out.append((-1, squeeze(fps[new]), check[new].tobytes()))
            columns = [pa.array([x[k] for x in out], t) for k, t in ((0, pa.int32()), (1, pa.binary()), (2, pa.binary()))]
            del runs, fps, check, owner, fresh, hit, order, found, to
            give_back()
            return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), *columns], ["bucket", "part", "fps", "checks"])

        runs = packed.groupBy("part").applyInArrow(of_part, RUN)
        return runs.unionByName(self.history()).groupBy("bucket").applyInArrow(of_bucket, RUN)

    def add(self, packed: DataFrame, id: str, text: str, carry: list[StructField], new_run: bool = True) -> DataFrame:
        """The batch's rows with what they keep; unless `new_run` is False its windows join the index.

        `packed` has (part, rows) dealt by part; carry are the columns of the rows to return, beside n_words,
        n_removed and kept (the kept words, joined by one space).
        """
        size = self.window
        joined = self.join(packed, id, text, new_run)
        if new_run:
            run = f"run-{self.version + 1}"
            few_files(joined, self.buckets, 8).withColumn("new", F.col("part") < 0).write.partitionBy("new").mode("overwrite").parquet(f"{self.path}/{run}")
            joined = self.spark.read.schema(f"{RUN}, new boolean").parquet(f"{self.path}/{run}").where("not new")
            self.commit([*self.runs, run])
            if len(self.runs) > self.most_runs:
                self.compact()
        names = [f.name for f in carry]
        more = ["n_words", "n_removed", "kept"]

        def of_part(key, rows, hits):
            table = unpack(rows.column("rows").to_pylist(), id) if rows.num_rows else None
            if table is None:
                return pa.table({n: pa.array([], t) for n, t in types})
            bounds, row, at, fps, checks, ids, distinct, first, inverse = part_windows(table, id, text, size)
            seen = np.sort(np.concatenate([expand(x) for x in hits.column("fps").to_pylist()] or [np.zeros(0, np.uint64)]))
            old = np.isin(distinct, seen, assume_unique=True) if len(seen) else np.zeros(len(distinct), bool)
            again = (ids[row] > ids[row[first]][inverse]) | old[inverse]
            again &= checks == checks[first][inverse]
            cover = np.zeros(bounds[-1] + 1, np.int32)
            np.add.at(cover, at[again], 1)
            np.add.at(cover, at[again] + size, -1)
            gone = np.cumsum(cover)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            removed = removed[bounds[1:]] - removed[bounds[:-1]]
            kept = []
            for k, x in enumerate(table.column(text).to_pylist()):
                words = (x or "").encode().split()
                if removed[k]:
                    words = [w for w, g in zip(words, gone[bounds[k] : bounds[k + 1]].tolist(), strict=True) if not g]
                kept.append(b" ".join(words).decode())
            out = pa.table([*(table.column(n) for n in names), pa.array(np.diff(bounds)), pa.array(removed), pa.array(kept, pa.string())], [*names, *more])
            del table, kept, bounds, row, at, fps, checks, ids, distinct, first, inverse, seen, old, again, cover, gone
            give_back()
            return out

        schema = StructType([*carry, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [(f.name, f.type) for f in to_arrow_schema(schema)]
        hits = joined.where("part >= 0").select("part", "fps")
        return packed.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(of_part, schema)

    def compact(self) -> None:
        """Merges all runs into one; the old ones go when the manifest no longer names them."""

        def merge(key, table):
            runs = [expand(x) for x in table.column("fps").to_pylist()]
            fps, check, _, fresh, _ = merge_runs([-1] * len(runs), runs, [np.frombuffer(x, np.uint8) for x in table.column("checks").to_pylist()])
            return pa.table({"bucket": [key[0].as_py()], "part": [-1], "fps": [squeeze(fps[fresh])], "checks": [check[fresh].tobytes()]}, pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("fps", pa.binary()), ("checks", pa.binary())]))

        run = f"run-{self.version + 1}"
        merged = self.history().groupBy("bucket").applyInArrow(merge, RUN).withColumn("new", F.lit(True))
        few_files(merged, self.buckets, 8).write.partitionBy("new").mode("overwrite").parquet(f"{self.path}/{run}")
        old = self.runs
        self.commit([run])
        forget(self.spark, *(f"{self.path}/{r}/new=true" for r in old))


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, window: int = WINDOW, batches: tuple[float, ...] = BATCHES, part_bytes: int = PART_BYTES, index: str | None = None, keep_last: bool = False) -> DataFrame:
    """`carry` columns (all by default) of every row, with n_words, n_removed and kept.

    A word goes if it is in a window of `window` words whose word sequence also starts in a row with a smaller id;
    words are split at ASCII white space and compared as they are. kept are the other words, joined by one space.
    The table goes through the index in batches of rising ids, cut at the shares `batches`; each batch before the last
    joins the index, the last one with `keep_last` only, as nothing here reads it again. `index` is the folder of the
    index: one that has runs already counts as the history of ids smaller than any here, so that a later job goes on
    where an earlier one stopped; without a name it is a new one of this call's own.
    Null texts have no words. Rows with a null id lose nothing and take nothing from others; rows that share an id
    don't either take from each other. Ids are integers. Other columns come back as they are, but not any named
    n_words, n_removed or kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [c for c in (carry or docs.columns) if c.lower() not in ("n_words", "n_removed", "kept")]
    fields = {f.name: f for f in docs.schema.fields}
    key, body = collision_free(docs, "id"), text if text in names else collision_free(docs, "text")
    rows = docs.select(*(F.col(f"`{n}`") for n in names), F.col(id).cast("long").alias(key), *([] if body == text else [F.col(text).alias(body)]))
    size = docs.agg(F.sum(F.octet_length(text)), F.count(id)).first()
    parts = max(1, math.ceil((size[0] or 0) / part_bytes))
    cuts = [k / parts for k in range(1, parts)]
    bounds = docs.agg(F.percentile_approx(F.col(id).cast("long"), cuts, 100_000)).first()[0] if cuts and size[1] else []
    bounds = np.unique(np.array(bounds or [], np.int64))
    buckets = 1 << max(0, math.ceil(math.log2(max(1, (size[0] or 0) / 6 / BUCKET_WINDOWS))))
    index = SubstringIndex(spark, index, buckets=buckets, window=window)
    edges = sorted({int(bounds[int(len(bounds) * s)]) for s in batches}) if len(bounds) else []
    first = [0, *(int(np.searchsorted(bounds, e)) + 1 for e in edges), len(bounds) + 1]  # the parts of each batch
    out = None
    for k in range(len(edges) + 1):
        here = rows
        if k < len(edges):
            here = here.where(F.col(key) <= edges[k])
        if k:
            here = here.where((F.col(key) > edges[k - 1]) | (F.col(key).isNull() if k == len(edges) else F.lit(False)))
        packed = here.mapInArrow(pack(bounds, key, here.columns), "part int, rows binary").repartition(max(2, min(first[k + 1] - first[k], spark.sparkContext.defaultParallelism * 64)), "part")
        done = index.add(packed, key, body, [fields[n] for n in names], new_run=keep_last or k < len(edges))
        out = done if out is None else out.unionByName(done)
    return out
