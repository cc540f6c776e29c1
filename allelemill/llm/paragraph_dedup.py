"""Substring deduplication by MinHash banding of paragraphs.

A paragraph ends at a line break or after a word that ends in a full stop, an exclamation or a question mark, so that a
passage pasted into other text keeps its own paragraphs wherever it stands. Paragraphs of LEAST words or more are sets
of five-word shingles; BANDS bands of ROWS minimal hashes each (`recall` tells the chance that two sets share a bucket: 0.984
at a similarity of 0.75) name buckets; of FEW shingles or fewer, of which bands would be most of the set, the least
hashes are buckets themselves, as many as cannot all be missing in a similar set, so that none is lost. All colliding paragraphs are compared, exact Jaccard similarity is verified on their
words, and the removals are clustered by connected components. Of each cluster the first occurrence (smallest doc_id, then
paragraph) stays.

Equal paragraphs have equal 64-bit digests and are one node, however many there are; so groups of copies never meet in
one task, and a bucket's pairs grow with its distinct paragraphs only. In a first round a bucket's paragraphs meet its two
ends. Those that verified links have not joined by then meet in a second round, in tiles of bounded size (as in the Jaccard
join), where a bound by counts of shingles, which loses no pair, comes before verification.

Shorter paragraphs, and passages pasted in mid-sentence, which are glued to what surrounds them, are found as pieces: runs of
PIECE words, across sentence ends and line breaks, at content-defined places (the least hash of each SPREAD neighbouring
runs, at both ends of a text of those there are). Equal words choose equal places, so any passage of PIECE + SPREAD - 1
words or more that repeats word for word shares a piece, wherever it stands. `passages` gives a row for each repeated
piece that no listed paragraph contains; `deduplicated` gives both, and `texts` the documents without what was removed.

Paragraphs below LEAST words are left alone: so few words repeat by chance, and the documents that hold them are no copies
of one another. Whole texts are read, once: paragraphs (with the words of each) and pieces are stored as they
are met, and all that follows takes them from there.

Defined results: null and empty texts have no paragraphs. A paragraph repeated within one document counts like any other.
Rows that repeat a doc_id have equal places; of such an equal place every row stays or goes alike. Null doc_ids come last.
Extra columns are ignored, but for `texts`, which keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, dropped, exact_shingles, mix64, salted_join, stored, text_blocks, utf8, word_bytes
from .components import components
from .jaccard_join import _tiles, vector

WORDS, PERCENT, LEAST = 5, 75, 8
BANDS, ROWS = 5, 2
#: Sets of so many shingles or fewer take their least hashes for bands.
FEW = 15
PIECE, SPREAD = 16, 16
_WORDS = word_bytes("space")
_STEP = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(max(WORDS, PIECE))]
_SEED = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[33, 46, 63]] = True


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two sets of this similarity share a bucket."""
    return 1 - (1 - similarity**rows) ** bands


def paragraph_ends(w: Words, texts: list[bytes]) -> np.ndarray:
    """Whether each word ends a paragraph."""
    data, n = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8), len(w.hashes)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    ends = np.ones(n, dtype=bool)
    if n:
        ends[:-1] = _STOPS[data[w.ends[:-1] - 1]] | (breaks[w.starts[1:]] > breaks[w.ends[:-1]]) | (w.doc[1:] != w.doc[:-1])
    return ends


class Paragraphs:
    """The paragraphs of a block of texts: doc (index), number, start (word), words; `shingles` and each one's `first`."""

    def __init__(self, texts: list[bytes], least: int = LEAST, w: Words | None = None, whole: bool = False):
        w, least = w or Words(texts, _WORDS), max(least, WORDS)
        n = len(w.hashes)
        # With whole each text is one paragraph.
        last = w.first[1:][w.n > 0] - 1 if whole else np.flatnonzero(paragraph_ends(w, texts))
        first = np.concatenate([[0], last[:-1] + 1]) if n else last
        doc = w.doc[first]
        number = np.arange(len(first)) - np.searchsorted(doc, doc)
        size = last - first + 1
        long = size >= least
        self.doc, self.number, self.words, self.start = doc[long], number[long], size[long], (first - w.first[doc])[long]
        grams = np.zeros(max(n - WORDS + 1, 0), dtype=np.uint64)
        for k in range(WORDS):
            grams += w.hashes[k : k + len(grams)] * _STEP[k]
        begin, count = first[long], self.words - WORDS + 1
        self.begin, self.end = begin, last[long]
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        at = np.arange(self.first[-1]) - np.repeat(self.first[:-1] - begin, count)
        self.shingles = mix64(grams[at]) if len(at) else np.empty(0, dtype=np.uint64)

    def text(self, k: int, w: Words, texts: list[bytes]) -> str:
        """The text of the k-th paragraph."""
        base = w.offsets[self.doc[k]]
        return texts[self.doc[k]][w.starts[self.begin[k]] - base : w.ends[self.end[k]] - base].decode("utf-8", "replace")

    def _each(self, ufunc, values: np.ndarray) -> np.ndarray:
        return ufunc.reduceat(values, self.first[:-1]) if len(self.doc) else np.empty(0, dtype=np.uint64)

    def digests(self) -> np.ndarray:
        return mix64(self._each(np.add, mix64(self.shingles ^ _SEED[255]))).astype(np.int64)

    def buckets(self, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
        """One row of bucket keys for each band."""
        out = []
        for b in range(bands):
            key = np.full(len(self.doc), _SEED[b + 128], dtype=np.uint64)
            for r in range(rows):
                key = mix64(key ^ self._each(np.minimum, mix64(self.shingles ^ _SEED[b * rows + r])))
            out.append(key.astype(np.int64))
        return np.array(out)


def keys(p: Paragraphs, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all paragraphs: where each one's begin (and the end), and their keys. Sets that may be similar to one of `few` shingles
    have their least hashes too: of n hashes n - ceil(n * percent / 100) + 1, as a similar set lacks fewer."""
    owner = np.repeat(np.arange(len(p.doc)), np.diff(p.first))
    order = np.lexsort((p.shingles, owner))
    hashes, owner = p.shingles[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    n = np.bincount(owner, minlength=len(p.doc))
    rank = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(n)])[owner]
    least = (rank < (n + (-n * percent) // 100 + 1)[owner]) & (100 * few >= percent * n)[owner]
    many = np.flatnonzero(n > few)
    matrix = p.buckets(bands, rows)[:, many] if len(many) else np.empty((0, 0), dtype=np.int64)
    owners = np.concatenate([owner[least], np.repeat(many[None, :], len(matrix), axis=0).ravel()])
    found = np.concatenate([mix64(hashes[least] ^ _SEED[254]).astype(np.int64), matrix.ravel()])
    order = np.argsort(owners, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(p.doc)))]).astype(np.int32), found[order]


PARAGRAPHS = ["doc_id", "paragraph", "start_word", "n_words", "last", "set", "words"]


def marks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each paragraph: doc_id, paragraph, start_word, n_words, set (a digest of its shingles) and words (its text; null
    where the same block has the set before). One row for each piece: doc_id, paragraph and last (numbers of the paragraphs of
    its first and last words), start_word, n_words, set (a digest of its words)."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                texts = utf8(part.column("text"))
                w = Words(texts, _WORDS)
                p, q = Paragraphs(texts, least, w), Pieces(texts, w)
                sets = p.digests()
                new = np.zeros(len(sets), dtype=bool)
                new[np.unique(sets, return_index=True)[1]] = True
                words = [p.text(k, w, texts) if once else None for k, once in enumerate(new)]
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p.doc)), *map(pa.array, (p.number, p.start, p.words)), pa.nulls(len(sets), pa.int64()), pa.array(sets), pa.array(words, pa.string())], PARAGRAPHS)
                n = len(q.doc)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q.doc)), pa.array(q.paragraph), pa.array(q.start), pa.array(np.full(n, PIECE)), pa.array(q.last), pa.array(q.digest), pa.nulls(n, pa.string())], PARAGRAPHS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, paragraph long, start_word long, n_words long, last long, set long, words string")


def _entries(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, set) for each bucket of (set, words)."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch.rename_columns(["set", "text"])]):
                p = Paragraphs(utf8(part.column("text")), 1, whole=True)
                at, own = keys(p, bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(own), part.column("set").take(pa.array(p.doc)).take(pa.array(np.repeat(np.arange(len(p.doc)), np.diff(at))))], ["bucket", "set"])

    return sets.select("set", "words").mapInArrow(run, "bucket long, set long")


def _meetings(entered: DataFrame) -> DataFrame:
    """(set, lo, before) for each set of a bucket but the first, lo: that, and the one before; of rows that come sorted."""

    def run(batches):
        first = last = None  # the bucket's first set; the row before: bucket, set
        for batch in batches:
            bucket, own = batch.column("bucket").to_numpy(), batch.column("set").to_numpy()
            if not len(own):
                continue
            begins = np.ones(len(own), dtype=bool)
            begins[1:] = bucket[1:] != bucket[:-1]
            begins[0] = last is None or bucket[0] != last[0]
            before = np.concatenate([[own[0] if last is None else last[1]], own[:-1]])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(own)), -1))
            lo = np.where(at < 0, own[0] if first is None else first, own[np.maximum(at, 0)])
            more = ~begins & (own != before)
            yield pa.RecordBatch.from_arrays([pa.array(own[more]), pa.array(lo[more]), pa.array(before[more])], ["set", "lo", "before"])
            first, last = lo[-1], (bucket[-1], own[-1])

    return entered.repartition("bucket").sortWithinPartitions("bucket", "set").mapInArrow(run, "set long, lo long, before long")


def _vectors(sets: DataFrame) -> DataFrame:
    """(set, n, vec) of (set, words): how many shingles are distinct, and the counts of their groups."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch.rename_columns(["set", "text"])]):
                p = Paragraphs(utf8(part.column("text")), 1, whole=True)
                found = [np.unique(p.shingles[a:b]) for a, b in zip(p.first, p.first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("set"), pa.array([len(x) for x in found], pa.int64()), pa.array([vector(x) for x in found], pa.binary())], ["set", "n", "vec"])

    return sets.select("set", "words").mapInArrow(run, "set long, n long, vec binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sufficient similarity, word for word, as (u, v)."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                n = part.num_rows
                both = exact_shingles(pa.concat_arrays([part.column("text"), part.column("text_b")]), WORDS)
                good = []
                for x, y in zip(both[:n], both[n:], strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("words").alias("text")), "a").join(sets.select(F.col("set").alias("b"), F.col("words").alias("text_b")), "b")
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "text", "text_b").mapInArrow(run, "u long, v long")


def _grouped(found: DataFrame, sets: DataFrame) -> DataFrame:
    """found (doc_id, paragraph, start_word, n_words, set) with what is known of its set: keep, copies."""
    return salted_join(found, sets, "set", "rows", "doc_id").select("doc_id", "paragraph", "start_word", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.paragraph").alias("keep_paragraph"), F.col("keep.start_word").alias("_keep_word"), "copies")


def _marked(out: DataFrame) -> DataFrame:
    stays = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("start_word") == F.col("_keep_word"))
    return out.withColumn("removed", ~stays).drop("_keep_word")


def _place() -> Column:
    """A place of a paragraph or a piece; the least of a group stays."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("start_word"), F.col("paragraph"))


def links(found: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(verified links between sets of paragraphs, u and v; the sets that met others: set, words). found: paragraphs of `marks`."""
    every = stored(found.where("words is not null").select("set", "words").dropDuplicates(["set"]), "sets")
    met = stored(_meetings(_entries(every, bands, rows)).distinct(), "met")
    star = met.select("set", F.explode(F.array("lo", "before")).alias("end"))
    pairs = stored(star.select(F.least("set", "end").alias("a"), F.greatest("set", "end").alias("b")).distinct(), "pairs")
    groups = stored(met.select(F.col("lo").alias("cell"), "set").unionByName(met.select(F.col("lo").alias("cell"), F.col("lo").alias("set"))).distinct(), "groups")  # buckets of one lower end are put together
    sets = stored(every.join(groups.select("set").distinct(), "set", "left_semi"), "words")
    dropped(every, met)
    first, vectors = stored(_verified(pairs, sets, percent), "verified"), stored(_vectors(sets), "vectors")
    more = stored(_tiles(groups, components(first), vectors, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    dropped(groups, pairs, vectors)
    return first.unionByName(_verified(more, sets, percent)), sets


def _repeats(found: DataFrame, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    roots = components(links(found, percent, bands, rows)[0])
    places = found.groupBy("set").agg(F.count("*").alias("rows"), F.min(_place()).alias("keep"))
    rooted = stored(places.join(roots, F.col("set") == F.col("node"), "left").select("set", "rows", "keep", F.coalesce("root", "set").alias("root")), "rooted")
    clusters = rooted.groupBy("root").agg(F.sum("rows").alias("copies"), F.count("*").alias("sets"), F.min("keep").alias("first")).where("copies > 1")
    told = salted_join(rooted.select("set", "rows", "root"), clusters, "root", "sets", "set").select("set", "rows", "copies", F.col("first").alias("keep"))
    return _marked(_grouped(found, stored(told, "clusters")))


def repeats(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each paragraph that has others like it: doc_id, paragraph, start_word, n_words, keep_doc_id,
    keep_paragraph (the occurrence that stays), copies (paragraphs of the cluster), removed."""
    return _repeats(stored(marks(docs, least), "marks").where("last is null"), percent, bands, rows)


class Pieces:
    """The pieces of a block of texts: doc (index), start (word), digest; paragraph and last, the numbers of the paragraphs
    of their first and last words."""

    def __init__(self, texts: list[bytes], w: Words | None = None):
        w = w or Words(texts, _WORDS)
        n = len(w.hashes)
        grams = np.zeros(max(n - PIECE + 1, 0), dtype=np.uint64)
        for k in range(PIECE):
            grams += w.hashes[k : k + len(grams)] * _STEP[k]
        begin = np.flatnonzero(w.doc[: len(grams)] == w.doc[PIECE - 1 :][: len(grams)])
        # Texts lie apart here, so that no choice depends on the texts beside.
        at = begin + (w.doc[begin] + 1) * SPREAD
        row = np.full((at[-1] if len(at) else 0) + SPREAD, np.iinfo(np.uint64).max, dtype=np.uint64)
        row[at] = mix64(grams[begin])
        runs = np.lib.stride_tricks.sliding_window_view(row, SPREAD)
        least = runs.argmin(axis=1) + np.arange(len(runs))
        chosen = np.zeros(len(row), dtype=bool)
        chosen[least] = True
        first = begin[chosen[at]]
        self.doc, self.digest = w.doc[first], mix64(grams[first]).astype(np.int64)
        self.start = first - w.first[self.doc]
        number = np.concatenate([[0], np.cumsum(paragraph_ends(w, texts))])
        head = number[w.first[self.doc]]
        self.paragraph, self.last = number[first] - head, number[first + PIECE - 1] - head


def passages(pieces: DataFrame, listed: DataFrame) -> DataFrame:
    """One row for each repeated piece that lies in no paragraph of `listed` (rows of `repeats`), with the same columns."""
    often = stored(pieces.groupBy("set").agg(F.count("*").alias("rows"), F.min(_place()).alias("keep")).where("rows > 1").withColumn("copies", F.col("rows")), "often")
    found = _grouped(pieces.select("doc_id", "paragraph", "last", "start_word", "n_words", "set").withColumn("paragraph", F.struct("paragraph", "last")), often)
    covered = listed.select(F.col("doc_id").alias("_doc"), F.col("paragraph").alias("_paragraph")).distinct()
    inside = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("paragraph.paragraph") == F.col("_paragraph")) & (F.col("paragraph.last") == F.col("_paragraph"))
    return _marked(found.join(covered, inside, "left_anti").withColumn("paragraph", F.col("paragraph.paragraph")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `repeats` and of `passages`: all repeated paragraphs, and the repeated pieces that these do not contain."""
    told = stored(marks(docs), "marks")
    listed = stored(_repeats(told.where("last is null"), PERCENT), "repeats")
    return listed.unionByName(passages(told.where("last is not null"), listed))


def texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, with all columns, without the words that `found` (rows of `deduplicated`) removes; what is left keeps its place.

    Rows without a doc_id lose what any row without one loses. A document's removals are as many as its own paragraphs.
    """
    names = docs.columns
    spans = found.where("removed").groupBy(F.col("doc_id").alias("_own")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)))
    joined = plain.join(spans, F.col("doc_id").eqNullSafe(F.col("_own")), "left").drop("_own")

    order = plain.columns

    def cut(text: bytes, gone: list[dict]) -> str:
        w = Words([text], _WORDS)
        keep = np.ones(len(w.starts), dtype=bool)
        for span in gone:
            keep[span["start_word"] : span["start_word"] + span["n_words"]] = False
        out, at = [], 0
        for k in np.flatnonzero(~keep).tolist():
            end = w.starts[k + 1] if k + 1 < len(keep) else len(text)
            out.append(text[at : w.starts[k]])
            at = end
        return b"".join([*out, text[at:]]).decode("utf-8", "replace")

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                rows = zip(utf8(part.column("text")), part.column("text").to_pylist(), part.column("_spans").to_pylist(), strict=True)
                new = pa.array([cut(text, gone) if gone else whole for text, whole, gone in rows], pa.string())
                at = part.schema.get_field_index("text")
                yield part.set_column(at, "text", new).select(order)

    return joined.mapInArrow(run, T.StructType(plain.schema.fields)).toDF(*names)
