"""Packing by cutting-stock column generation.

Documents become token ids followed by id END, cut into pieces of SIZE and one remainder. Pieces are packed by their
lengths alone, in units of GRAIN ids rounded up: a linear program over patterns (how many pieces of each length a
sequence holds) covers the histogram of lengths; new patterns are priced by a knapsack dynamic program on the program's
prices until none improves it by more than GAP (or PIVOTS are made). Rounded numbers of patterns are used first, what
is left is packed largest first. The driver sees the histogram only, SIZE / GRAIN numbers at most. Pieces are then
ranked within their length, and the rank says which place of which sequence a piece has; the places are a table of a
few rows for each length and pattern. Offsets add up the true lengths, so what rounding up leaves is at the end.

Defined results: a null or empty text is the one id END, so each row of documents has a piece. Pieces that agree in
doc_id and start (repeated rows) each get a slot of their own. Extra columns are ignored by `packed`. An empty table
gives an empty result. A long text is encoded whole, then cut; no piece is longer than SIZE.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32, ordered_totals, stored, text_blocks

SIZE, GRAIN, END, GAP, PIVOTS, SEED = 1024, 4, 0, 0.001, 3000, "pack"
#: Fixed value: how byte-level BPE of this vocabulary splits texts before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file; its ids are the ranks of its merges. Added tokens stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    added = {x["content"]: x["id"] for x in whole.get("added_tokens") or []}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in whole.get("added_tokens") or []):
        raise ValueError("added tokens that take their surroundings aren't supported")
    ranks = {bytes(byte[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        encode = functools.partial(encoder(path).encode, allowed_special="all")
        for batch in batches:
            for part in text_blocks([batch]):
                which, rows = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), END], dtype="<u4")
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        which.append(i)
                        rows.append((start, len(piece), crc32(piece.tobytes()), len(ids)))
                table = np.array(rows, dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(table[:, k]) for k in range(4))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity up to size when pieces repeat freely, and the piece it takes last (-1: none)."""
    value, last = np.zeros(size + 1), np.full(size + 1, -1)
    for c in range(1, size + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        value[c], last[c] = value[c - 1], -2  # -2: a unit is left unused
        if n:
            with_piece = price[:n] + value[c - lengths[:n]]
            k = int(np.argmax(with_piece))
            if with_piece[k] > value[c] + 1e-12:
                value[c], last[c] = with_piece[k], k
    return value, last


def _pattern(lengths: np.ndarray, last: np.ndarray, capacity: int, first: int = -1) -> np.ndarray:
    out = np.zeros(len(lengths))
    if first >= 0:
        out[first] += 1
        capacity -= int(lengths[first])
    while capacity > 0:
        k = int(last[capacity])
        if k >= 0:
            out[k] += 1
            capacity -= int(lengths[k])
        else:
            capacity -= 1
    return out


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps. (BLAS threads of a driver that has forked a JVM may wait for ever.)"""
    m = len(matrix)
    both = np.concatenate([matrix, np.eye(m)], axis=1)
    for k in range(m):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def times_vector(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = GAP, most: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each.

    Revised simplex with an explicit inverse; from each knapsack come several patterns, each of which enters only while
    today's prices still want it. It ends when the program is within `gap` of its lower bound (value over best price),
    or after `most` pivots. It begins with sequences of one length and, of lengths that add up to size, with pairs.
    """
    basis = np.diag((size // lengths).astype(float))
    row_of = {int(n): i for i, n in enumerate(lengths)}
    for n, i in row_of.items():
        k = row_of.get(size - n, i)
        if n < size - n and k != i:
            rare = i if demand[i] < demand[k] else k
            basis[:, rare] = 0
            basis[[i, k], rare] = 1
    inverse = inverted(basis)
    x = np.maximum(times_vector(inverse, demand), 0)
    steps = 0
    while steps < most:
        prices = np.maximum(inverse.sum(axis=0), 0)
        value, last = knapsack(lengths, prices, size)
        if value[size] <= 1 + gap:  # prices / value[size] are feasible: no cover is smaller than (prices @ demand) / value
            break
        through = prices + value[size - lengths]
        entered = 0
        for first in [-1, *np.argsort(-through)[:40]]:
            column = _pattern(lengths, last, size, int(first))
            if (inverse.sum(axis=0) * column).sum() <= 1 + gap / 2:
                continue
            direction = times_vector(inverse, column)
            up = direction > 1e-9
            if not up.any():
                continue
            ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
            row = int(np.argmin(ratio))
            step = max(ratio[row], 0)
            x = np.maximum(x - step * direction, 0)
            x[row] = step
            pivot = inverse[row] / direction[row]
            inverse -= direction[:, None] * pivot
            inverse[row] = pivot
            basis[:, row] = column
            entered += 1
        steps += entered
        if not entered:
            break
        if steps % 2000 < entered:  # rounding errors add up
            inverse = inverted(basis)
            x = np.maximum(times_vector(inverse, demand), 0)
    return basis, x


def _largest_first(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Each sequence takes the largest lengths that are left and fit."""
    demand, out = demand.copy(), []
    while demand.any():
        room, column = size, np.zeros_like(demand)
        while True:
            fits = np.flatnonzero((demand > column) & (lengths <= room))
            if not len(fits):
                break
            k = fits[-1]
            n = min(int(demand[k] - column[k]), room // int(lengths[k]))
            column[k] += n
            room -= n * int(lengths[k])
        held = column > 0
        times = int((demand[held] // column[held]).min())
        demand -= times * column
        out.append((column, times))
    return out


def patterns(histogram: dict[int, int], size: int, gap: float = GAP) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences that hold exactly the pieces of the histogram: (length, count) lists, and how many sequences are so.

    The better of the rounded program and of packing everything largest first.
    """
    full = [([(size, 1)], histogram[size])] if histogram.get(size) else []
    left = {n: c for n, c in sorted(histogram.items()) if c and n < size}
    if not left:
        return full
    lengths, all_of = np.array(list(left)), np.array(list(left.values()), dtype=np.int64)
    basis, x = column_generation(lengths, all_of.astype(float), size, gap)
    tries = [_largest_first(lengths, all_of, size)]
    for rounding in (1e-6, 0.5):
        demand, chosen = all_of.copy(), []
        for k in np.argsort(-x):
            column = basis[:, k].astype(np.int64)
            held = column > 0
            times = min(int(np.floor(x[k] + rounding)), int((demand[held] // column[held]).min()))
            if times > 0:
                demand -= times * column
                chosen.append((column, times))
        tries.append(chosen + _largest_first(lengths, demand, size))
    best = min(tries, key=lambda t: sum(times for _, times in t))
    return full + [([(int(n), int(c)) for n, c in zip(lengths[::-1], column[::-1], strict=True) if c], times) for column, times in best]


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple]:
    """(length, first rank, last rank + 1, count in a sequence, first sequence_id, place of the first)."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for column, times in plan:
        place = 0
        for length, count in column:
            low = rank.get(length, 0)
            rank[length] = low + times * count
            out.append((length, low, rank[length], count, sequence, place))
            place += count
        sequence += times
    return out


def packed(docs: DataFrame, path: str, size: int = SIZE, grain: int = GRAIN, gap: float = GAP) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if size % grain:
        raise ValueError("size must be a multiple of grain")
    units = F.ceil(F.col("length") / grain).cast("long")
    cut = stored(pieces(docs, path, size).withColumn("_units", units), "pieces")
    histogram = {int(r["_units"]): r["n"] for r in cut.groupBy("_units").agg(F.count("*").alias("n")).collect()}
    rows: dict[int, list] = {}
    for length, *slot in slots(patterns(histogram, size // grain, gap)):
        rows.setdefault(length, []).append(tuple(slot))
    schema = "_length long, slots array<struct<low: long, high: long, count: long, sequence: long, place: long>>"
    table = F.broadcast(docs.sparkSession.createDataFrame(list(rows.items()), schema))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("start").cast("string")))
    ranked = ordered_totals(cut.withColumn("_key", key).withColumn("_one", F.lit(1)), ["_units"], ["_key"], "_one", "rank")
    found = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    own = ranked.join(table, F.col("_units") == F.col("_length")).withColumn("slot", found).withColumn("no", F.col("rank") - F.col("slot.low"))
    sequence = F.col("slot.sequence") + F.floor(F.col("no") / F.col("slot.count")).cast("long")
    place = F.col("slot.place") + F.col("no") % F.col("slot.count")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most size rows
    whole = own.withColumn("sequence_id", sequence).withColumn("place", place).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
