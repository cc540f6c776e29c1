"""Phrase collocation mining: candidates from a sketch's upper bounds, counted by automata.

1. A sketch of the phrases of two words of each language: two rows of slots, each the number of the phrases that fall there, counted up
   to the threshold and no further (a sum of such numbers reaches the threshold exactly if the sum of all does). Tasks send what
   isn't zero of their sketch, in blocks; the blocks are summed, and one bit for each slot is left: whether it can reach the
   threshold. A second sketch has the phrases of 3 to LONGEST words all of whose pairs of neighbours may reach it. The number
   of slots grows with the text, up to MOST_SLOTS; a fuller sketch lets more candidates through, none fewer.
2. A phrase is a candidate if both its bits are set and all phrases within it are candidates at their places. Tasks send the
   candidates and their words that they meet, with the group of their language, in blocks by ranges of their hash; the blocks of a range are merged,
   and the distinct texts dealt to shards of about SHARD texts: a large group to several, small groups together to one.
3. Each shard is compiled into an Aho-Corasick automaton over " word word "; texts are written as words between single spaces, with a line
   break between pieces, so a match begins and ends where words do. A shard has candidates of some groups of languages, and its automaton
   scans the texts of these groups alone. Overlapping matches are counted by language, and sums below the threshold fall.
4. What remains is exact and is joined with itself: the parts of each cut, the phrases within longer ones, the best by language.

The driver holds the bits (MOST_SLOTS / 4 bytes at most) and one shard of texts at a time; each shard is one more scan of its groups' texts.

Defined results: null texts are empty; null languages are `und`. All rows count, repeated ones too. Extra columns are ignored, an empty
table gives an empty result. Phrases are named by 64-bit hashes within a task until they are texts, and by their texts from then on.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, mix64, stored, text_blocks, utf8

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text for a slot; slots of a row of the sketch at most; slots of a block; texts of an automaton.
BYTES, MOST_SLOTS, BLOCK, SHARD = 64, 1 << 26, 1 << 16, 600_000
#: Groups of languages, by their hash; counts of matches that a task holds at most, of all languages.
GROUPS, HELD = 256, 12_800_000
#: Rows of the sketch; counts of a block of matches.
ROWS, COUNTS, UNKNOWN = 2, 1 << 12, "und"
HARD = b".,;:!?\n\x0b\x0c\r"

_IN_WORD = np.ones(256, dtype=np.int8)
_IN_WORD[list(HARD + b" \t")] = 0
_IS_HARD = np.zeros(256, dtype=np.int64)
_IS_HARD[list(HARD)] = 1
#: As the automata read: small letters, a line break between pieces.
_PLAIN = bytes(10 if c in HARD else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Phrases:
    """The phrases of a block of texts: `hashes[k]` and `within[k]` (it ends in its piece) of the k words from each word on."""

    def __init__(self, texts: list[bytes], langs: list[str], longest: int):
        w = self.words = Words(texts, _IN_WORD)
        breaks = np.concatenate([[0], np.cumsum(_IS_HARD[w.data])])
        new = np.ones(len(w.hashes), dtype=np.int64)
        if len(new):
            new[1:] = (breaks[w.starts[1:]] > breaks[w.ends[:-1]]) | (w.doc[1:] != w.doc[:-1])
        piece = np.cumsum(new)
        seed = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in langs] or [0], dtype=np.uint64) * _ODD
        own = mix64(w.hashes ^ seed[w.doc]) if len(new) else w.hashes
        self.hashes, self.within = {1: own}, {1: np.ones(len(new), dtype=bool)}
        for k in range(2, longest + 1):
            more = max(len(new) - k + 1, 0)
            self.hashes[k] = mix64(self.hashes[k - 1][:more] * _ODD + own[k - 1 :][:more])
            self.within[k] = piece[:more] == piece[k - 1 :][:more]

    def text(self, at: int, k: int) -> bytes:
        w = self.words
        return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.starts[at : at + k], w.ends[at : at + k], strict=True))


def _slots(hashes: np.ndarray, row: int, slots: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * row)) & np.uint64(slots - 1)).astype(np.int64)


def slots_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_SLOTS, max(BLOCK, 1 << (int(size) // BYTES).bit_length()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))


def _group(lang: str) -> int:
    return zlib.crc32(lang.encode("utf-8", "surrogatepass")) % GROUPS


def _of_groups(docs: DataFrame, groups: list[int]) -> DataFrame:
    """The rows whose language is of these groups."""
    return docs.where(F.pmod(F.crc32(F.coalesce("lang", F.lit(UNKNOWN))), F.lit(GROUPS)).isin(groups))


def _may(p: Phrases, k: int, pairs: np.ndarray) -> np.ndarray:
    """Whether all pairs of neighbours among the k words from each word on may be frequent; pairs: whether a pair may."""
    out = pairs[: max(len(pairs) - k + 2, 0)].copy()
    for i in range(1, k - 1):
        out &= pairs[i : i + len(out)]
    return out


def sketch(docs: DataFrame, slots: int, longest: int = LONGEST, least: int = LEAST, pairs: np.ndarray | None = None) -> np.ndarray:
    """Bits [row, slot / 8]: whether so many phrases fall into a slot. Of two words, or with the bits of these, of 3 to `longest`."""
    kind = np.min_scalar_type(least)

    def count(batches):
        held = np.zeros((ROWS, slots), dtype=kind)
        for batch in batches:
            for part in text_blocks([batch]):
                p = Phrases(utf8(part.column("text")), part.column("lang").to_pylist(), 2 if pairs is None else longest)
                if pairs is None:
                    found = p.hashes[2][p.within[2]]
                else:
                    ok = p.within[2] & _set(pairs, p.hashes[2])
                    found = np.concatenate([p.hashes[2][:0], *(p.hashes[k][p.within[k] & _may(p, k, ok)] for k in range(3, longest + 1))])
                for row in range(ROWS):
                    at, n = np.unique(_slots(found, row, slots), return_counts=True)
                    held[row, at] = np.minimum(held[row, at].astype(np.int64) + n, least)
        for row in range(ROWS):
            for block in range(slots // BLOCK):
                own = held[row, block * BLOCK : (block + 1) * BLOCK]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([_packed(own.tobytes())], pa.binary())], ["row", "block", "counts"])

    def add(key, blocks):
        total = np.zeros(BLOCK, dtype=np.int64)
        for counts in blocks:
            total += np.frombuffer(zlib.decompress(counts), dtype=kind)
        yield (np.packbits(total >= least).tobytes(),)

    parts = _texts(docs).mapInArrow(count, "row int, block int, counts binary")
    out = np.zeros((ROWS, slots // 8), dtype=np.uint8)
    for r in _merged(parts, add, "row int, block int", "bits binary").toLocalIterator():
        out[r["row"], r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _packed(data: bytes) -> bytes:
    """Runs of zeros and small numbers pack best by runs."""
    made = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return made.compress(data) + made.flush()


#: Arrow's types of the columns that blocks have.
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _merged(parts: DataFrame, merge, keys: str, more: str) -> DataFrame:
    """Columns `keys` and `more`: the rows that merge(key, blocks) yields of the blocks (the last column of parts) of each key, which come
    one by one, in the order of keys."""
    names, kinds = zip(*((c.split()[0], _KINDS[c.split()[1]]) for c in f"{keys}, {more}".split(", ")), strict=True)
    by = names[: keys.count(",") + 1]

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, group in itertools.groupby(rows, lambda r: r[:-1]):
            values = (key + v for v in merge(key, (r[-1] for r in group)))
            while some := list(itertools.islice(values, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], list(names))

    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"{keys}, {more}")


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all rows' bits of these phrases are set."""
    out = np.ones(len(hashes), dtype=bool)
    for row in range(ROWS):
        at = _slots(hashes, row, bits.shape[1] * 8)
        out &= (bits[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def candidates(docs: DataFrame, pairs: np.ndarray, bits: np.ndarray, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(group, phrase: the candidates and their words, each once in a group; lang, words: how many words parts of the texts have)."""
    ranges = max(16, bits.shape[1] * 8 // BLOCK)

    def run(batches):
        seen: set[int] = set()
        held: list[list[bytes]] = [[] for _ in range(ranges)]
        words: dict[str, int] = {}

        def rows():
            full = [k for k in range(ranges) if held[k]]
            none = len(full) * [None]
            yield pa.RecordBatch.from_arrays([pa.array([*full, *([None] * len(words))], pa.int32()), pa.array([*none, *words], pa.string()), pa.array([*none, *words.values()], pa.int64()), pa.array([*(zlib.compress(b"\n".join(held[k]), 1) for k in full), *([None] * len(words))], pa.binary())], ["range", "lang", "words", "phrases"])
            words.clear()
            for k in full:
                held[k] = []

        for batch in batches:
            for part in text_blocks([batch]):
                langs = part.column("lang").to_pylist()
                group = {lang: b"%d\t" % _group(lang) for lang in set(langs)}
                p = Phrases(utf8(part.column("text")), langs, longest)
                may = None
                for k in range(2, longest + 1):
                    ok = p.within[k] & _set(pairs if k == 2 else bits, p.hashes[k])
                    if may is not None and len(ok):
                        ok &= may[:-1] & may[1:]
                    may = ok
                    starts = [(k, np.flatnonzero(ok))]
                    if k == 2:
                        starts.append((1, np.unique(np.concatenate([starts[0][1], starts[0][1] + 1]))))
                    for size, at in starts:
                        new, first = np.unique(p.hashes[size][at], return_index=True)
                        for h, i in zip(new.tolist(), at[first].tolist(), strict=True):
                            if h not in seen:
                                seen.add(h)
                                text = group[langs[p.words.doc[i]]] + p.text(i, size)
                                held[zlib.crc32(text) % ranges].append(text)
                for lang, n in zip(langs, np.bincount(p.words.doc, minlength=len(langs)).tolist(), strict=True):
                    words[lang] = words.get(lang, 0) + n
                if len(seen) > 1 << 20 or len(words) > 1 << 12:
                    yield from rows()
                    seen.clear()
        yield from rows()

    told = stored(_texts(docs).mapInArrow(run, "range int, lang string, words long, phrases binary"), "candidates")

    def distinct(key, blocks):
        found: set[bytes] = set()
        for block in blocks:
            found.update(zlib.decompress(block).split(b"\n"))
        for x in sorted(found):
            group, phrase = x.split(b"\t")
            yield int(group), phrase.decode("utf-8", "replace")

    phrases = _merged(told.where("phrases is not null").select("range", "phrases"), distinct, "range int", "group int, phrase string").select("group", "phrase")
    return phrases, told.where("lang is not null").select("lang", "words")


#: The automaton that a worker made last, by its name.
_made: dict = {}


def _automaton(name: str, phrases: list[str]):
    if name not in _made:
        import ahocorasick

        made = ahocorasick.Automaton()
        for k, phrase in enumerate(phrases):
            made.add_word(f" {phrase} ", k)
        made.make_automaton()
        _made.clear()
        _made[name] = made
    return _made[name]


def matches(docs: DataFrame, phrases: list[str], least: int = LEAST) -> DataFrame:
    """lang, id (index in phrases), f: overlapping matches of the phrases in all texts, where there are so many. Tasks send what isn't
    zero of their counts, in blocks."""
    name = uuid.uuid4().hex

    def count(batches):
        automaton = _automaton(name, phrases)
        held: dict[str, np.ndarray] = {}

        def blocks():
            for lang, n in held.items():
                for block in range(-(-len(n) // COUNTS)):
                    own = n[block * COUNTS : (block + 1) * COUNTS]
                    if own.any():
                        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([block], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["lang", "block", "counts"])
            held.clear()

        for batch in batches:
            for part in text_blocks([batch]):
                by_lang: dict[str, list[bytes]] = {}
                for text, lang in zip(utf8(part.column("text")), part.column("lang").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    plain = re.sub(rb" +", b" ", b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ")).decode("utf-8", "replace")
                    ids = np.fromiter((k for _, k in automaton.iter(f" {plain} ")), dtype=np.int64)
                    if held and lang not in held and (len(held) + 1) * len(phrases) > HELD:
                        yield from blocks()
                    held[lang] = held.get(lang, 0) + np.bincount(ids, minlength=len(phrases))
        yield from blocks()

    def add(key, blocks):
        total = np.zeros(COUNTS, dtype=np.int64)
        for counts in blocks:
            own = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            total[: len(own)] += own
        at = np.flatnonzero(total >= least)
        return zip((at + key[1] * COUNTS).tolist(), total[at].tolist(), strict=True)

    parts = _texts(docs).mapInArrow(count, "lang string, block int, counts binary")
    return _merged(parts, add, "lang string, block int", "id int, f long").select("lang", "id", "f")


def dealt_groups(sizes: dict[int, int], shard: int) -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """(the first shard and how many each group has, the groups of each shard), of about `shard` phrases each."""
    places, shards, room = {}, [], 0
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n > shard:
            many = -(-n // shard)
            places[group] = len(shards), many
            shards += [[group] for _ in range(many)]
            continue
        if n > room:
            shards.append([])
            room = shard
        places[group] = len(shards) - 1, 1
        shards[-1].append(group)
        room -= n
    return places, shards


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f: all candidates, and their words, that occur so often; lang, n: how many words a language has)."""
    slots = slots_for(docs)
    pairs = sketch(docs, slots, longest, least)
    found, sizes = candidates(docs, pairs, sketch(docs, slots, longest, least, pairs), longest)
    phrases = stored(found, "phrases")
    places, shards = dealt_groups({r["group"]: r["count"] for r in phrases.groupBy("group").count().collect()}, shard)
    if not shards:  # no candidates
        places, shards = {0: (0, 1)}, [[0]]
    first, many = (F.create_map(*(F.lit(x) for g, place in places.items() for x in (g, place[k])))[F.col("group")] for k in range(2))
    dealt = phrases.select("phrase", (first + F.pmod(F.xxhash64("phrase"), many)).cast("int").alias("shard")).distinct()
    dealt = stored(dealt.withColumn("id", F.row_number().over(Window.partitionBy("shard").orderBy("phrase")) - 1), "shards")
    parts = []
    for k, groups in enumerate(shards):
        own = [r["phrase"] for r in dealt.where(F.col("shard") == k).orderBy("id").select("phrase").toLocalIterator()]
        parts.append(stored(matches(_of_groups(docs, groups), own, least).withColumn("shard", F.lit(k)), "matches"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    sums = sizes.groupBy("lang").agg(F.sum("words").alias("n"))
    return stored(found.join(dealt, ["shard", "id"]).select("lang", "phrase", "f"), "counted"), stored(sums, "words")


def _words(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one holds as often; counts and totals as of `counted`."""
    every = counts.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words")).where("k >= 2").withColumnRenamed("f", "a")
    cuts = every.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "at", _words(F.lit(1), F.col("at")).alias("_l"), _words(F.col("at") + 1, F.col("k") - F.col("at")).alias("_r"))
    part = lambda name: counts.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    known = cuts.join(part("l"), ["lang", "_l"]).join(part("r"), ["lang", "_r"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n").cast("decimal(15,0)"), wide("l") * wide("r")
    each = known.withColumn("over", over).withColumn("under", under).withColumn("score", F.expr("over div under"))
    best = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r", "n")).alias("c"))
    longer = every.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = longer.groupBy("lang", _words(F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("c.a")))
    return kept.select("lang", "phrase", *(F.col(f"c.{c}").alias(c) for c in ("a", "l", "r", "n", "score")))


def top(found: DataFrame, most: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best of each language; first of many parts of it, then of these."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(32))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
