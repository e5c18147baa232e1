"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, shared_path, slices, text_buffer, word_hashes, write_and_clear

#: The byte-level pre-tokenizer's pattern (fixed values); White_Space is spelled out as the libraries' \s differ.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
#: White space, in a wide sense, by its first byte, and that of two and three bytes.
BLANK = np.zeros(256, bool)
BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
WIDE_BLANKS = [np.array([int.from_bytes(chr(k).encode()) for k in x]) for x in ((0x85, 0xA0), (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
#: Most distinct pre-tokens that are sent to every executor (12 bytes each); above it the rarer ones are joined by a shuffle.
MOST_SENT = 8_000_000
#: Rows of a batch of frequencies at the most.
ROWS = 1 << 16
#: Chunks (16 bytes each) and pre-tokens that a task remembers, and the bytes of the longest that it does: longer ones
#: hardly repeat, and whole texts without spaces are chunks too.
MEMO, SENT, LONG = 600_000, 200_000, 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    """One per worker: a vocabulary read anew by every task would pile up in the worker's memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return sorted((x["content"] for x in json.load(f)["added_tokens"]), key=len, reverse=True)


class Chunker:
    """Cuts texts at spaces that always begin a pre-token, so that the pattern runs once per distinct chunk.

    A space begins a pre-token wherever no white space follows it: what stands before, be it white space too, is cut
    the same way alone. Spaces before anything that some library counts as white space are left inside a chunk.
    """

    def __init__(self, special: list[str]):
        self.pretokens = regex.compile(PRETOKEN).findall
        self.special, self.split = [s.encode() for s in special], re.compile("|".join(map(re.escape, special))).split if special else None

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: at every row with text, and at the spaces that cut."""
        begin = np.zeros(len(data) + 1, bool)
        space = np.flatnonzero(data == 32)
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        after = padded[space + 1]
        keep = BLANK[after]
        some = np.flatnonzero(after >= 0xC2)
        wide = padded[space[some, None] + np.arange(1, 4)].astype(np.int64)
        keep[some] |= np.isin(wide[:, 0] << 8 | wide[:, 1], WIDE_BLANKS[0]) | np.isin(wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2], WIDE_BLANKS[1])
        begin[space[~keep]] = True
        begin[offsets[1:] - 1] &= padded[offsets[1:] - 1] != 32  # a space that ends its row begins nothing
        begin[offsets[:-1]] = True
        return np.flatnonzero(begin[: len(data)])

    def special_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows that hold special strings; those are cut at them first, one by one."""
        found, raw = [], data.tobytes() if self.special else b""
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(s) <= offsets[row + 1]:
                    found.append(row)
                at = raw.find(s, at + 1)
        return np.unique(np.array(found, np.int64))

    def cut(self, array):
        """Of a string array: bytes, starts and ends of chunks, their hashes, row bounds in chunks, rows with specials."""
        data, offsets = text_buffer(array)
        starts = self.starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        return data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, offsets, "left"), self.special_rows(data, offsets)

    def pieces(self, chunks: list[str]) -> set[str]:
        """The different pre-tokens of chunks; those that begin with a space that cuts go through the pattern as one text."""
        spaced, rest = [], []
        for c in chunks:
            (spaced if len(c) > 1 and c[0] == " " and not c[1].isspace() else rest).append(c)
        out = set(self.pretokens("".join(spaced))) if spaced else set()
        out.update(t for c in rest for t in self.pretokens(c))
        return out

    def parts(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all chunks in a list, and the number of the chunk that each is of."""
        joined = np.fromiter((len(c) > 1 and c[0] == " " and not c[1].isspace() for c in chunks), bool, len(chunks))
        together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        spaced = [chunks[k] for k in together.tolist()]
        found = self.pretokens("".join(spaced)) if spaced else []
        begin = np.cumsum([0, *map(len, spaced)])
        owner = together[np.searchsorted(begin, np.cumsum([0, *map(len, found)])[:-1], "right") - 1] if found else together
        rest = [self.pretokens(chunks[k]) for k in alone.tolist()]
        return [*found, *(t for x in rest for t in x)], np.concatenate([owner, np.repeat(alone, [len(x) for x in rest])])

    def whole(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text that holds special strings, and the number of those."""
        parts = self.split(text) if self.split else [text]
        return [t for p in parts for t in self.pretokens(p)], len(parts) - 1


class Known:
    """A bounded map from chunk hashes to numbers: a large sorted run and a small one that is merged into it."""

    def __init__(self, most: int = MEMO):
        self.most, self.runs = most, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers; -1 for hashes that are not known."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, values in self.runs:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = values[at[hit]]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        large, small = self.runs
        small = self._merged(small, (hashes, values))
        if len(small[0]) * 8 > self.most:
            large, small = ((small if len(large[0]) + len(small[0]) > self.most else self._merged(large, small)), (small[0][:0], small[1][:0]))
        self.runs = [large, small]

    @staticmethod
    def _merged(a, b):
        keys, values = (np.concatenate([x, y]) for x, y in zip(a, b, strict=True))
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, and of each place its hash's number. Numpy's own first places need
    a stable sort, which takes several times as long."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    place = np.empty(len(distinct), np.int64)
    place[inverse] = np.arange(len(hashes))
    return distinct, place, inverse


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def scan_pretokens(special: list[str]):
    """For mapInArrow: the pre-tokens of a task's texts, most of them once."""

    def scan(batches):
        chunker, seen, sent = Chunker(special), Known(), set()
        for piece in slices(batches, "text"):
            data, starts, ends, hashes, _, odd = chunker.cut(piece.column(0))
            distinct, first, _ = places(hashes)
            fresh = (ends[first] - starts[first] > LONG) | (seen.find(distinct) < 0)
            distinct, first = distinct[fresh], first[fresh]
            new = chunker.pieces(strings(data, starts[first], ends[first]))
            new.update(t for k in odd.tolist() for t in chunker.whole(piece.column(0)[k].as_py())[0])
            short = ends[first] - starts[first] <= LONG
            seen.add(distinct[short], np.zeros(int(short.sum()), np.int64))
            new -= sent
            if len(sent) > SENT:
                sent.clear()
            sent.update(t for t in new if len(t) <= LONG)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], ["pretoken"])

    return scan


def key_of(pretoken: str) -> int:
    return xxhash.xxh64_intdigest(pretoken.encode())


def count_pieces(path: str):
    """For mapInArrow: the tokens of each pre-token, as the library gives them, without keeping ids; its column `seen` stays."""

    def count(batches):
        encode = tokenizer(path).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.column(0).slice(k, 2000)
                texts = part.to_pylist()
                words = encode(texts, is_pretokenized=True, add_special_tokens=False).word_ids  # of each token the pre-token
                sizes = np.bincount(np.array(words, np.int64), minlength=len(texts))
                keys = np.fromiter(map(key_of, texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part, pa.array(keys.view(np.int64)), pa.array(sizes, pa.int32()), batch.column(1).slice(k, 2000)], ["pretoken", "key", "tokens", "seen"])

    return count


def distinct_pretokens(docs: DataFrame, special: list[str]) -> DataFrame:
    """Each pre-token and how often tasks gave it: most of them do so once, so those of many tasks are the frequent ones."""
    return docs.select("text").mapInArrow(scan_pretokens(special), "pretoken string").groupBy("pretoken").agg(F.count(F.lit(1)).alias("seen"))


def pretoken_counts(pretokens: DataFrame, path: str) -> DataFrame:
    return pretokens.select("pretoken", "seen").mapInArrow(count_pieces(path), "pretoken string, key long, tokens int, seen long")


def least_seen(counts: DataFrame, most: int) -> int | None:
    """The smallest `seen` from which on there are `most` pre-tokens at the most; None if there is none.

    Counts are taken by the four leading bits of `seen`, so a few hundred rows go to the driver whatever the table.
    """
    n = {r["least"]: r["count"] for r in counts.groupBy(F.expr("shiftleft(shiftright(seen, greatest(0, length(bin(seen)) - 4)), greatest(0, length(bin(seen)) - 4))").alias("least")).count().collect()}
    found = None
    for least in sorted(n, reverse=True):
        most -= n[least]
        if most < 0:
            break
        found = least
    return found


def sent_table(counts: DataFrame, clashes: dict[str, int]):
    """Broadcasts keys in order, their tokens, and the tokens of pre-tokens whose keys clash; each step frees what it has used."""
    found = counts.select("key", "tokens").toArrow()
    keys, tokens = (found[c].to_numpy() for c in ("key", "tokens"))
    del found
    order = np.argsort(keys.view(np.uint64))
    tokens = tokens[order].astype(np.int32, copy=False)
    keys = keys.view(np.uint64)[order]
    del order
    give_back()
    return counts.sparkSession.sparkContext.broadcast((keys, tokens, clashes))


def count_tokens(docs: DataFrame, path: str | None = None, *, id: str = "doc_id", text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """`id`, n_bytes and n_tokens of every row, whole texts, without begin, end or added tokens.

    The distinct pre-tokens of all texts are found with map-side sets and one shuffle, and the library counts each
    once. The table of counts is sent to the executors while it has at most `most_sent` rows; of a larger one the most
    frequent pre-tokens are, and the others are joined to (row, key, frequency) rows by a shuffle. Texts are never
    shuffled. Null or empty texts have 0 bytes and 0 tokens; null or repeated ids are kept as they are, a row each;
    other columns are ignored; an empty table gives an empty result.
    """
    path = path or tokenizer_path()
    special = special_strings(path)
    spark = docs.sparkSession
    out = shared_path(spark, "pretokens")
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    write_and_clear(pretoken_counts(distinct_pretokens(docs, special), path), out)
    counts = spark.read.schema("pretoken string, key long, tokens int, seen long").parquet(out)
    rows, keys = counts.agg(F.count(F.lit(1)), F.countDistinct("key")).first()
    clashes = {}
    if rows > keys:  # a handful, if any: their strings tell them apart
        shared = counts.groupBy("key").count().where("count > 1").select("key")
        clashes = {r["pretoken"]: r["tokens"] for r in counts.join(shared, "key").select("pretoken", "tokens").collect()}
    least = 0 if rows <= most_sent else least_seen(counts, most_sent)
    table = sent_table(counts.where(F.lit(False) if least is None else F.col("seen") >= least), clashes)
    if rows <= most_sent:
        return _joined_here(docs, table, special, id)
    return _joined_by_shuffle(docs, table, counts if least is None else counts.where(F.col("seen") < least), special, id)


def frequencies(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, key) and how often each stands."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], keys[first], np.diff(np.append(first, len(rows)))


def sums_of_texts(batches, table, special: list[str]):
    """Of each slice of (id, text) batches: the slice, the tokens of each text by the table of keys and counts, and
    (row, key, frequency) of the pre-tokens that the table doesn't have."""
    keys, tokens, clashes = table
    chunker, known, memo = Chunker(special), Known(), {}

    def tokens_of(pretokens: list[str], owner: np.ndarray, n: int):
        """The number of tokens of each of `n` chunks from their pre-tokens; chunk and key of those without a count."""
        if len(memo) > SENT:
            memo.clear()
        new = [t for t in set(pretokens) if t not in memo]
        hashes = np.fromiter(map(key_of, new), np.uint64, len(new))
        order = np.argsort(hashes)
        found = np.full(len(new), -1, np.int64)
        if len(new) and len(keys):
            at = np.minimum(np.searchsorted(keys, hashes[order]), len(keys) - 1)
            found[order] = np.where(keys[at] == hashes[order], tokens[at], -1)
        of = dict(zip(new, found.tolist(), strict=True))
        if clashes:
            of.update((t, clashes[t]) for t in new if t in clashes)
        each = np.fromiter((of[t] if t in of else memo[t] for t in pretokens), np.float64, len(pretokens))
        memo.update((t, k) for t, k in of.items() if len(t) <= LONG)
        without = np.flatnonzero(each < 0)
        sums = np.bincount(owner, np.maximum(each, 0), n).astype(np.int64) if n else np.zeros(0, np.int64)
        return sums, owner[without], np.fromiter((key_of(pretokens[k]) for k in without.tolist()), np.uint64, len(without))

    for piece in slices(batches, "text"):
        column = piece.column(1)
        data, starts, ends, hashes, bounds, odd = chunker.cut(column)
        distinct, first, inverse = places(hashes)
        counts = known.find(distinct)  # in order, which halves the time of a search
        long = ends[first] - starts[first] > LONG
        fresh = np.flatnonzero(long | (counts < 0))
        at = first[fresh]
        counts[fresh], owner, left = tokens_of(*chunker.parts(strings(data, starts[at], ends[at])), len(at))
        order = np.argsort(owner, kind="stable")
        left, begin = left[order], np.searchsorted(owner[order], np.arange(len(fresh) + 1))
        size = np.zeros(len(distinct), np.int64)  # of each chunk the pre-tokens without a count; such chunks are not remembered
        size[fresh] = np.diff(begin)
        done = fresh[~long[fresh] & (size[fresh] == 0)]
        known.add(distinct[done], counts[done])
        counts = counts[inverse]
        totals = np.concatenate([[0], np.cumsum(counts)])
        totals = totals[bounds[1:]] - totals[bounds[:-1]]
        number = np.zeros(len(distinct), np.int64)
        number[fresh] = begin[:-1]
        place = np.flatnonzero(size[inverse])
        many = size[inverse[place]]
        row = np.searchsorted(bounds, place, "right") - 1
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, key = np.repeat(row, many), left[np.repeat(number[inverse[place]], many) + step]
        if len(odd):
            inside = ~np.isin(row, odd)
            row, key = [row[inside]], [key[inside]]
            for k in odd.tolist():
                found, n = chunker.whole(column[k].as_py())
                sums, owner, left = tokens_of(found, np.zeros(len(found), np.int64), 1)
                totals[k] = sums[0] + n
                row.append(np.full(len(left), k))
                key.append(left)
            row, key = np.concatenate(row), np.concatenate(key)
        yield piece, totals, frequencies(row, key)


def bytes_of(column) -> pa.Array:
    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())


def score_texts(table, special: list[str]):
    """For mapInArrow: (id, bytes, tokens) of each text; the table has all pre-tokens."""

    def score(batches):
        for piece, totals, _ in sums_of_texts(batches, table.value, special):
            yield pa.RecordBatch.from_arrays([piece.column(0), bytes_of(piece.column(1)), pa.array(totals)], ["id", "n_bytes", "n_tokens"])

    return score


def open_sums(table, special: list[str]):
    """For mapInArrow: (row, id, bytes, tokens by the table) of each text, and (row, key, n) of its other pre-tokens.

    `row` is unique in what a job writes, so that texts need no key of their own.
    """
    names = ["row", "id", "n_bytes", "n_tokens", "key", "n"]

    def score(batches):
        at = TaskContext.get().partitionId() << 40
        for piece, totals, (row, key, n) in sums_of_texts(batches, table.value, special):
            size = piece.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(size)), piece.column(0), bytes_of(piece.column(1)), pa.array(totals), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], names)
            for k in range(0, len(row), ROWS):
                r, x, f = (v[k : k + ROWS] for v in (row, key, n))
                yield pa.RecordBatch.from_arrays([pa.array(at + r), pa.nulls(len(r), piece.schema.field(0).type), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.int64()), pa.array(x.view(np.int64)), pa.array(f)], names)
            at += size

    return score


def _joined_here(docs: DataFrame, table, special: list[str], id: str) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(score_texts(table, special), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id)


def _joined_by_shuffle(docs: DataFrame, table, counts: DataFrame, special: list[str], id: str) -> DataFrame:
    """The texts are read once more, and what their rows and frequencies are is written: neither holds a text or a pre-token."""
    spark = docs.sparkSession
    out, kind = shared_path(spark, "frequencies"), f"row long, id {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, key long, n long"
    docs.mapInArrow(open_sums(table, special), kind).write.parquet(out)
    found = spark.read.schema(kind).parquet(out)
    more = found.where("key is not null").select("row", "key", "n").join(counts.select("key", "tokens"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
    rows = found.where("key is null").select("row", "id", "n_bytes", "n_tokens")
    return rows.join(more, "row", "left").select(F.col("id").alias(id), "n_bytes", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
