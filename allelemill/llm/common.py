"""What several operators of this subpackage share: tables in the shared folder, words, ordered running sums."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import dropped, shared_folder, stored

__all__ = ["dropped", "shared_folder", "stored"]

#: The white space of the word rules, for Java and DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a kernel takes at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 19

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null doc_ids are in fold -1, which no rule holds out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def ordered_totals(df: DataFrame, group: list[str], order: list[str], value: str, out: str, per_bin: int = 4_000) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same group that come before, by the columns of `order`.

    order[0] must hold a hash in lower-case hex of eight digits or more, by which groups are cut into bins of about
    per_bin rows each, so that no task holds a whole group; only one sum for each group and bin is gathered by group.
    Rows that are equal in all of `order` come in any order.
    """
    bins = max(1, math.ceil(df.count() / per_bin))
    df = df.withColumn("_bin", (F.conv(F.substring(order[0], 1, 8), 16, 10).cast("long") * bins / F.lit(1 << 32)).cast("long"))
    keys = [*group, "_bin"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(own), F.lit(0)))
    same = None
    for k in keys:
        one = within[k].eqNullSafe(starts[f"_{k}"])
        same = one if same is None else same & one
    return within.join(starts, same).withColumn(out, F.col("_within") + F.col("_start")).drop("_bin", "_within", "_start", *(f"_{k}" for k in keys))


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose texts (column `text`) have about `limit` bytes, one row at least."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The bytes that count in a last lane of so many bytes; words beyond LONG bytes are hashed one by one.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a block of texts, as hashes: `hashes`, `starts` and `ends` (bytes in the joined texts), `doc` and
    `first` (index of each document's first word, and the end). A-Z counts as a-z; with `latin` also the capitals
    that UTF-8 writes as C3 80 to C3 9E, which keeps every offset."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, latin: bool = False):
        joined = np.frombuffer(b"\0".join([*texts, b"", bytes(8)]), dtype=np.uint8)
        data = joined[: len(joined) - 9]
        self.data = _LOWER[joined]
        if latin:
            high = self.data[1:]
            high[(joined[:-1] == 0xC3) & (high >= 0x80) & (high <= 0x9E) & (high != 0x97)] += 0x20
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = is_word[data]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        inside[self.offsets[1:]] = 0  # the byte between two texts
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.hashes = self.spans(self.starts, self.ends)
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n = np.diff(self.first)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from starts to ends, wherever they stand: eight bytes at a time, each time mixed."""
        size = ends - starts
        lanes = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        out = mix64(lanes[starts] & _LANE[np.minimum(size, 8)] ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        more = np.flatnonzero(size > 8)
        for at in range(8, LONG, 8):
            if not len(more):
                break
            lane = lanes[starts[more] + at] & _LANE[np.minimum(size[more] - at, 8)]
            out[more] = mix64(out[more] ^ mix64(lane + np.uint64(at)))
            more = more[size[more] > at + 8]
        for k in more.tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return out


def word_bytes(pattern_excludes: str) -> np.ndarray:
    """Which bytes belong to a word. 'space': all but white space; 'plain': digits, letters and all beyond ASCII."""
    ok = np.ones(256, dtype=np.int8)
    if pattern_excludes == "space":
        ok[[9, 10, 11, 12, 13, 32]] = 0
    else:
        ok[:128] = 0
        ok[48:58] = ok[65:91] = ok[97:123] = 1
    return ok


def exact_shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text (null: none) as rising numbers. Within one call equal numbers stand for equal
    words, not for equal hashes. A-Z counts as a-z; with fewer words the whole sequence is the one shingle."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    parent = np.asarray(pc.list_parent_indices(split))
    flat = pc.list_flatten(split)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    number = lambda x: np.asarray(pc.dictionary_encode(x).indices, dtype=np.int64)
    ids = number(flat.filter(pa.array(full)))
    first = np.searchsorted(parent[full], np.arange(len(texts) + 1))
    runs, n = ids, 1
    while n < words:  # two runs of n words, which may share some, name a run of up to 2 n
        step = min(n, words - n)
        runs, n = number(pa.array(runs[: max(len(runs) - step, 0)] * (int(runs.max(initial=0)) + 1) + runs[step:])), n + step
    out, short = [], {}
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(ids[a:b]), len(short))] if b > a else [], dtype=np.int64))
    return out


def salted_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, by: str, hot: int = 1000, salts: int = 64) -> DataFrame:
    """rows joined by `key` with facts, which has one row for each key and in `weight` how many rows have it.

    A key that has more than a thousandth (1 / hot) of all rows, as at most `hot` keys can, is dealt to `salts` tasks by
    the hash of `by`; its one fact goes to each of them.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) * hot > total
    marks = F.broadcast(facts.where(often).select(F.col(key).alias("_hot")))  # `hot` keys at most
    dealt = rows.join(marks, rows[key] == marks["_hot"], "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(salts))).cast("int")).drop("_hot")
    spread = facts.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
