"""Language identification by rank-order profiles of character n-grams.

A language's profile is the TOP most frequent n-grams (one to three characters) of its training texts. A document's own
most frequent n-grams are compared with each profile by out-of-place distance: the difference of the two ranks, or TOP
where the profile lacks the n-gram. The nearest language is predicted.

Letters are lower-cased; a run of anything else is one space, which takes part as the mark of a word's border.

Defined results: texts that are null or have no letter are `und` with score 0. With no profile at all (no training
text) every text is `und`. Ties in rank go to the smaller n-gram, ties in distance to the smaller language by code
point. Repeated rows are scored alike; extra columns are ignored. Long texts are counted in blocks, none is cut.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_blocks

TOP, BLOCK_CHARS, SHARPNESS = 300, 1 << 19, 12.0
UNKNOWN = "und"
_SPACE = np.uint32(32)
_BITS = np.uint64(21)  # of a code point


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as 64-bit codes in rising order, and their counts; none without a letter."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    before = np.full(1, _SPACE)
    for at in range(0, len(text), BLOCK_CHARS):
        points = np.frombuffer(text[at : at + BLOCK_CHARS].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        chars = np.concatenate([before, np.where(_letters()[points], points, _SPACE), np.full(int(at + BLOCK_CHARS >= len(text)), _SPACE)])
        blank = chars == _SPACE
        keep = np.ones(len(chars), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        chars = chars[keep].astype(np.uint64)
        # The last two characters were counted as beginnings of nothing yet: what the next block needs to go on.
        skip = max(len(before) - 1, 0)
        pairs = chars[:-1] << _BITS | chars[1:]
        triples = pairs[:-1] << _BITS | chars[2:]
        new = [chars[len(before) :], pairs[skip:], triples[max(len(before) - 2, 0) :]]
        found.append(np.unique(np.concatenate(new), return_counts=True))
        before = chars[-2:].astype(np.uint32)
    codes, counts = merged(found)
    real = codes != np.uint64(32)
    return codes[real], counts[real]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent codes, most frequent first; codes rise, so a stable order breaks ties by code."""
    if len(codes) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:top]]


def profiles(train: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The profile of each language of `train` (text, lang), from all its rows: top n-grams, most frequent first.

    Counts are added up in each task, then by Spark; the driver gets `top` codes for each language.
    """

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for part in text_blocks([batch]):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    own = held.setdefault(lang, [])
                    own.append(grams(text))
                    if len(own) > 200:
                        held[lang] = [merged(own)]
        for lang, own in held.items():
            codes, counts = merged(own)
            for i in range(0, len(codes), 50_000):
                n = len(codes[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(codes[i : i + n].astype(np.int64)), pa.array(counts[i : i + n])], ["lang", "gram", "n"])

    counted = train.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First the best of each of many parts of a language, then the best of these.
    order = [F.col("n").desc(), F.col("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(32))
    some = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Ranks:
    """All profiles as one table: codes in rising order, and each language's rank of each (top where absent)."""

    def __init__(self, by_lang: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(by_lang), top
        self.codes = np.unique(np.array([g for x in by_lang.values() for g in x], dtype=np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(by_lang[lang], dtype=np.uint64)), k] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text) if text else (np.empty(0, np.uint64), None)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.top)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = np.where((self.codes[at] == own)[:, None], self.ranks[at], -1)
        places = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(own))[:, None]))
        distance = places.sum(axis=0) / (self.top * len(own))
        k = int(np.argmin(distance))
        return self.langs[k], float(1 / np.exp(SHARPNESS * (distance[k] - distance)).sum())


def predicted(docs: DataFrame, by_lang: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score."""
    table = Ranks(by_lang, top)

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                found = [table.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identified(docs: DataFrame, train_rows: Column, top: int = TOP) -> DataFrame:
    """Profiles from the rows of docs that `train_rows` picks, predictions for all."""
    return predicted(docs, profiles(docs.where(train_rows), top), top)


