"""N-gram Jaccard join by a count-vector R-tree.

Each text's set of word shingles becomes a point: its shingles are hashed to groups, and the point's coordinates are the
counts of the groups. The overlap of two sets is at most the sum of the smaller of their coordinates, so a pair whose
bound falls short of what the threshold needs is dropped without looking at the sets; the same holds for two nodes of a
tree with the largest coordinates that they contain. Surviving pairs are verified on the whole texts.

How the index is spread. In so many dimensions the boxes of one tree over all texts would all overlap. Its root is
therefore cut into cells: two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, in any order
that both follow (frequent shingles come last here, others by hash). A set enters the cells of these shingles, and each
cell is a tree of its own. No pair is lost by this.

How large cells are kept linear. In a first round every point of a cell meets the cell's HUBS most central points only
(those that share most of their own cells with others). Verified links give components; points of one component need
not be compared. In a second round the cells of one most central point are put together, so that a pair is met once or a
few times however many shingles it shares; their points that belong to different components meet in tiles of bounded
size, each a small R-tree.

Sets are handled once: equal sets have equal 64-bit digests (two sets with one digest would be taken for one set, about
n^2 / 2^65 for n sets). Candidates come from 64-bit hashes of shingles; their texts are then compared word for word.

Defined results: null texts are empty; texts without words have no shingles and link with nothing; with fewer words than
a shingle has, the whole sequence is the one shingle. Rows that repeat a doc_id are rows of their own, linked by their
texts. Null doc_ids never name a component; a component without any doc_id has none (null). Extra columns are ignored by
`classes`. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, exact_shingles, mix64, salted_join, stored, text_blocks, utf8, word_bytes
from .components import components

WORDS, PERCENT = 5, 75
#: Order of shingles only: those in so many texts of a window of WINDOW shingles come last, FREQUENT of them at most.
OFTEN, WINDOW, FREQUENT = 4, 1 << 20, 1 << 17
#: Points of a cell that all others meet; coordinates that any point may have.
HUBS, PLENTY = 4, 512
#: Rows of a cell that meet its hubs in one task.
PART = 1000
#: Points of a tile's two sides; points in a leaf of its tree; dimensions of the tree's boxes.
SIDE_A, SIDE_B, LEAF, BOX = 256, 1024, 16, 16
_WORDS = word_bytes("space")
_STEP = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(256)]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as rising 64-bit hashes."""
    w = Words(texts, _WORDS)
    h, n = w.hashes, len(w.hashes)
    grams = np.zeros(max(n - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        grams += h[k : k + len(grams)] * _STEP[k]
    grams = mix64(grams)
    out = []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            steps = np.array(_STEP[: b - a], dtype=np.uint64)
            out.append(mix64((h[a:b] * steps).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def digest(shingles: np.ndarray) -> int:
    """The same for equal sets, in any order."""
    return int(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def vector(shingles: np.ndarray) -> bytes | None:
    """Counts of the groups, a byte each: as many groups as shingles up to PLENTY, then a quarter as many. None where a
    count needs more than a byte."""
    power = lambda k: 1 << int(k).bit_length()
    groups = min(max(16, power(len(shingles))), max(PLENTY, power(len(shingles) // 4)), 1 << 16)
    counts = np.bincount((shingles >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts of fewer groups: a group is the leading bits of a hash, so neighbours add up."""
    return counts.reshape(groups, -1).sum(axis=1, dtype=np.int64)


def needed(n: int | np.ndarray, m: int | np.ndarray, percent: int = PERCENT):
    """The least overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-(percent * (n + m)) // (100 + percent))


def may_link(a: bytes | None, n: int, b: bytes | None, m: int, percent: int = PERCENT) -> bool:
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if a is None or b is None:
        return True
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    groups = min(len(x), len(y))
    return bool(np.minimum(folded(x, groups), folded(y, groups)).sum() >= needed(n, m, percent))


def prefix(shingles: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 shingles, frequent ones last."""
    n = len(shingles)
    take = n - -(-percent * n // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        late = frequent[at] == shingles
        return np.concatenate([shingles[~late], shingles[late]])[:take]
    return shingles[:take]


_POINT = ["doc_id", "n", "set", "vec", "often"]


def points(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n, set (its digest, null without shingles), vec; often is null.

    Further rows, with n = -1, have in `often` the shingles that OFTEN or more texts of a window of a task's texts share.
    """
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        held, total, key = [], 0, None

        def shared():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= OFTEN
            pairs = [{"shingle": int(x), "n": int(n)} for x, n in zip(found[many].astype(np.int64), count[many], strict=True)]
            return pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], kind)], _POINT)

        for batch in batches:
            key = batch.column("doc_id").type
            for part in text_blocks([batch]):
                sets = shingle_sets(utf8(part.column("text")), words)
                vectors = pa.array([vector(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), vectors, pa.nulls(len(sets), kind)], _POINT)
                held += sets
                total += sum(map(len, sets))
                if total >= WINDOW:
                    yield shared()
                    held, total = [], 0
        if held:
            yield shared()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, set long, vec binary, often array<struct<shingle: long, n: long>>")


def frequent_shingles(placed: DataFrame) -> np.ndarray:
    """The most frequent of the shingles that `placed` (points) found in many texts, FREQUENT at most.

    Only the order of shingles follows from it, never which pairs link.
    """
    counted = placed.where("n < 0").select(F.explode("often").alias("o")).groupBy("o.shingle").agg(F.sum("o.n").alias("n"))
    rows = counted.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.uint64))


def entries(docs: DataFrame, frequent: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(cell, set): the cells that each row's set enters."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                sets = [s for s in shingle_sets(utf8(part.column("text")), words) if len(s)]
                keys = [prefix(s, frequent, percent) for s in sets]
                if keys:
                    own = np.repeat(np.array([digest(s) for s in sets], dtype=np.int64), [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(own)], ["cell", "set"])

    return docs.select("text").mapInArrow(run, "cell long, set long")


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bound lets through."""

    def run(batches):
        for batch in batches:
            x, n, y, m = (batch.column(c).to_pylist() for c in ("vec_a", "n_a", "vec_b", "n_b"))
            yes = pa.array([may_link(*row, percent) for row in zip(x, n, y, m, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(yes)

    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("vec").alias("vec_a")), "a").join(sets.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("vec").alias("vec_b")), "b")
    near = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return near.select("a", "b", "n_a", "vec_a", "n_b", "vec_b").mapInArrow(run, "a long, b long")


def _own_texts(docs: DataFrame, words: int) -> DataFrame:
    """(set, text) of docs (text), the set told from the text; rows without words are left out."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                sets = pa.array([digest(s) if len(s) else None for s in shingle_sets(utf8(part.column("text")), words)], pa.int64())
                yield pa.RecordBatch.from_arrays([sets, part.column("text").cast(pa.string())], ["set", "text"]).filter(sets.is_valid())

    return docs.select("text").mapInArrow(run, "set long, text string")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough word for word, as (u, v, overlap, n_u, n_v).

    One row of docs stands for a set. Each wanted text is fetched once (by doc_id where it has one) and told its set anew, as
    a repeated doc_id can bring other texts; the pairs are compared by words, not by hashes.
    """
    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    chosen = sets.join(wanted, "set").select("set", F.col("one").alias("_one"))
    named = docs.select("doc_id", "text").join(chosen.select("_one").distinct(), F.col("doc_id") == F.col("_one"), "left_semi")
    told = _own_texts(named.unionByName(docs.select("doc_id", "text").where("doc_id is null")), words)
    texts = told.join(wanted, "set", "left_semi").groupBy("set").agg(F.first("text").alias("text"))
    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("text")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                both = exact_shingles(pa.concat_arrays([part.column("text"), part.column("text_b")]), words)
                n = part.num_rows
                rows = []
                for a, b, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), both[:n], both[n:], strict=True):
                    overlap = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * overlap >= percent * (len(x) + len(y) - overlap):
                        rows.append((a, b, overlap, len(x), len(y)))
                table = np.array(rows, dtype=np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(5)], ["u", "v", "overlap", "n_u", "n_v"])

    return both.mapInArrow(run, "u long, v long, overlap long, n_u long, n_v long")


class _Side:
    """A side of a tile, packed into leaves in the order of size and leading coordinate."""

    def __init__(self, side):
        self.set, self.n, self.root = (np.asarray(side[c]) for c in ("set", "n", "root"))
        self.vec = list(side["vec"])
        self.width = np.array([len(v) if v is not None else 1 << 30 for v in self.vec], dtype=np.int64)
        self.counts: dict[int, np.ndarray] = {}
        order = np.lexsort((self.at(BOX)[:, 0], self.n)) if len(self.n) else np.empty(0, dtype=np.int64)
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]

    def at(self, groups: int) -> np.ndarray:
        """All coordinates in so many groups. Without counts (one beyond a byte) any group may hold the whole set."""
        if groups not in self.counts:
            self.counts[groups] = np.array([folded(np.frombuffer(v, dtype=np.uint8), groups) if v is not None and len(v) >= groups else np.full(groups, n) for v, n in zip(self.vec, self.n, strict=True)]).reshape(-1, groups)
        return self.counts[groups]


def tree_pairs(left, right, percent: int = PERCENT) -> np.ndarray:
    """Pairs (a, b) of a tile's sides (set, n, root, vec) of different roots that the bound lets through.

    Leaves are paired by their boxes, the points of paired leaves by all coordinates that either leaf's points have.
    """
    p, q = _Side(left), _Side(right)
    x, y = p.at(BOX), q.at(BOX)
    out = []
    top = np.array([y[leaf].max(axis=0) for leaf in q.leaves]).reshape(-1, BOX)
    low, high = np.array([q.n[leaf].min() for leaf in q.leaves]), np.array([q.n[leaf].max() for leaf in q.leaves])
    for leaf in p.leaves:
        least, most = p.n[leaf].min(), p.n[leaf].max()
        bound = np.minimum(x[leaf].max(axis=0), top).sum(axis=1)
        for k in np.flatnonzero((bound >= needed(least, low, percent)) & (100 * most >= percent * low) & (100 * high >= percent * least)):
            other = q.leaves[k]
            groups = int(min(p.width[leaf].min(), q.width[other].min(), 1024))
            n, m = p.n[leaf][:, None], q.n[other][None, :]
            close = np.minimum(p.at(groups)[leaf][:, None, :], q.at(groups)[other][None, :, :]).sum(axis=2) >= needed(n, m, percent)
            close &= (p.root[leaf][:, None] != q.root[other][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            for i, j in zip(*np.nonzero(close), strict=True):
                i, j = leaf[i], other[j]
                if may_link(p.vec[i], int(p.n[i]), q.vec[j], int(q.n[j]), percent):
                    out.append((min(p.set[i], q.set[j]), max(p.set[i], q.set[j])))
    return np.unique(np.array(out, dtype=np.int64).reshape(-1, 2), axis=0)


def _whole_groups(batches, keys: list[str]):
    """The rows of each group of equal keys, from batches sorted by them; a group may span batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(columns[a])
            if last is not None and key != last:
                yield kept
                kept = []
            kept.append(batch.slice(a, b - a))
            last = key
    if kept:
        yield kept


def _tiles(groups: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a group (cell, set) and that the bound lets through.

    In each group the points of the component of its central point (cell) are the many; the others are the rest. Rest
    meets rest, and rest meets many: points are dealt to chunks by hash, and each pair of chunks is a tile.
    """
    rooted = groups.join(roots, groups["set"] == roots["node"], "left").select("cell", "set", F.coalesce("root", "set").alias("root"))
    shape = rooted.groupBy("cell").agg(F.count("*").alias("size"), F.max(F.when(F.col("set") == F.col("cell"), F.col("root"))).alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    chosen = shape.where("size > 2 and lo != hi").select("cell", "main")
    members = stored(rooted.join(chosen, "cell").withColumn("many", F.col("root") == F.col("main")).drop("main"), "members")
    counts = members.groupBy("cell").agg(F.count(F.when(~F.col("many"), 1)).alias("rest"), F.count(F.when(F.col("many"), 1)).alias("most"))
    dealt = members.join(counts, "cell").withColumn("rests", F.ceil(F.col("rest") / SIDE_A)).withColumn("mosts", F.ceil(F.col("most") / SIDE_B))
    own = F.pmod(F.xxhash64("set"), F.when(F.col("many"), F.col("mosts")).otherwise(F.col("rests"))).cast("int")
    dealt = dealt.withColumn("own", own)
    turns = F.when(F.col("many"), F.transform(F.sequence(F.lit(0), F.col("rests").cast("int") - 1), lambda i: F.struct(i.alias("i"), (-F.col("own") - 1).alias("j"), F.lit(1).alias("side"))))
    with_many = F.transform(F.sequence(F.lit(0), F.col("mosts").cast("int") - 1), lambda j: F.struct(F.col("own").alias("i"), (-j - 1).cast("int").alias("j"), F.lit(0).alias("side")))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests").cast("int") - 1), lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j"), F.when(F.col("own") <= k, 0).otherwise(1).alias("side")))
    turns = turns.otherwise(F.concat(with_many, with_rest))
    columns = ["cell", "i", "j", "side", "set", "root", "n", "vec"]
    tiled = dealt.join(sets.select("set", "n", "vec"), "set").withColumn("t", F.explode(turns)).select("cell", "t.i", "t.j", "t.side", "set", "root", "n", "vec")

    def run(batches):
        found, n = [], 0
        for parts in _whole_groups(batches, columns[:3]):
            tile = {c: np.concatenate([p.column(c).to_numpy() for p in parts]) for c in columns[:7]} | {c: [v for p in parts for v in p.column(c).to_pylist()] for c in columns[7:]}
            first = np.flatnonzero(tile["side"] == 0)
            second = first if tile["i"][0] == tile["j"][0] else np.flatnonzero(tile["side"] == 1)
            take = lambda at, t=tile: {c: v[at] if isinstance(v, np.ndarray) else [v[k] for k in at] for c, v in t.items()}
            pairs = tree_pairs(take(first), take(second), percent)
            found.append(pairs)
            n += len(pairs)
            if n > 100_000:
                yield _pair_batch(found)
                found, n = [], 0
        if found:
            yield _pair_batch(found)

    return tiled.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "a long, b long").where("a != b").distinct()


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links(docs: DataFrame, placed: DataFrame, words: int = WORDS, percent: int = PERCENT, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links between sets: u, v, overlap, n_u, n_v; the sets: set, n, vec, one, rows). placed: stored `points` of docs.

    The links connect all that is similar; links within a component that others already connect may be missing, unless
    `every` link is asked for: then nothing is passed over, at the cost of as many comparisons as there are candidates.
    """
    sets = stored(placed.where("set is not null").groupBy("set").agg(F.first("n").alias("n"), F.first("vec").alias("vec"), F.min("doc_id").alias("one"), F.count("*").alias("rows")), "sets")
    entered = entries(docs, frequent_shingles(placed), words, percent)
    shared = entered.groupBy("cell").agg(F.min("set").alias("lo"), F.max("set").alias("hi"), F.count("*").alias("held")).where("lo != hi").select("cell", "held")
    cells = stored(entered.join(shared, "cell").distinct(), "cells")
    # How central a set is: the share of its own cells that hold other sets too.
    entered_cells = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    central = cells.groupBy("set").agg(F.count("*").alias("in")).join(sets.select("set", "n"), "set").select("set", F.round(F.col("in") / entered_cells, 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("score").desc(), "set"))  # cut in each task first
    hubs = stored(cells.join(central, "set").withColumn("rank", rank).where(F.col("rank") <= HUBS).select("cell", "held", F.col("set").alias("hub"), "rank"), "hubs")
    met = _with_hubs(cells, hubs)
    star = met.where("set != hub").select(F.least("hub", "set").alias("a"), F.greatest("hub", "set").alias("b")).distinct()
    tried = stored(_bounded(star, sets, percent), "pairs")
    first = stored(_verified(tried, sets, docs, words, percent), "verified")
    groups = _with_hubs(cells, hubs.where("rank = 1")).select(F.col("hub").alias("cell"), "set").distinct()
    roots = first.select(F.col("u").alias("node"), F.col("u").alias("root")).where("false") if every else components(first)
    more = stored(_tiles(groups, roots, sets, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    second = stored(_verified(more, sets, docs, words, percent), "verified")
    return first.unionByName(second), sets


def _with_hubs(cells: DataFrame, hubs: DataFrame) -> DataFrame:
    """cells (cell, set, held) with each hub of the cell; a cell that more than PART sets entered is cut into parts of that
    many, and its few hubs go to each."""
    parts = F.ceil(F.col("held") / PART).cast("int")
    dealt = cells.withColumn("_part", F.pmod(F.xxhash64("set"), parts)).drop("held")
    return dealt.join(hubs.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("held"), ["cell", "_part"])


def pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every link between different sets, by the smallest doc_id that has each: doc_id, other_id, overlap, n, other_n.

    Rows of equal sets are not expanded into pairs; `classes` tells them. By request only: where many texts are alike there
    are as many rows as pairs.
    """
    found, sets = links(docs, stored(points(docs, words), "points"), words, percent, every=True)
    names = sets.select("set", "one")
    left = found.join(names.select(F.col("set").alias("u"), F.col("one").alias("doc_id")), "u")
    return left.join(names.select(F.col("set").alias("v"), F.col("one").alias("other_id")), "v").select("doc_id", "other_id", "overlap", F.col("n_u").alias("n"), F.col("n_v").alias("other_n"))


def _placed(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the stored points of docs; set, rows, component_id of each set). A component is named on its sets, of which there
    are no copies, so that no task gathers a group of equal or similar rows."""
    told = stored(points(docs, words), "points")
    found, sets = links(docs, told, words, percent)
    rooted = sets.join(components(found), F.col("set") == F.col("node"), "left").select("set", "rows", "one", F.coalesce("root", "set").alias("root"))
    names = rooted.groupBy("root").agg(F.min("one").alias("component_id"), F.count("*").alias("sets"))
    return told, stored(salted_join(rooted, names, "root", "sets", "set").select("set", "rows", "component_id"), "named")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    told, named = _placed(docs, words, percent)
    linked = salted_join(told.where("set is not null").select("doc_id", "n", "set"), named, "set", "rows", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = told.where("n >= 0 and set is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, without those linked to a row of smaller doc_id.

    Rows that repeat a doc_id go or stay by their own text; a row without a doc_id goes if its component has one with.
    """
    told, named = _placed(docs, words, percent)
    own = F.col("doc_id")
    placed = salted_join(told.where("set is not null").select("doc_id", "set"), named, "set", "rows", "doc_id")
    drop = placed.where(own.isNull() & F.col("component_id").isNotNull() | (own != F.col("component_id"))).select(own.alias("_own"), F.col("set").alias("_set")).distinct()
    drop = stored(drop, "dropped")
    # Only where a doc_id repeats can its rows differ in text; there, and without a doc_id, the text's own set decides.
    often = stored(told.where("n >= 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(own.alias("_own")), "repeated")
    column = F.col("doc_id")
    if often.isEmpty():
        return docs.join(drop, column.eqNullSafe(F.col("_own")), "left_anti")
    keep = docs.join(often.unionByName(drop.select("_own")).distinct(), column.eqNullSafe(F.col("_own")), "left_anti")
    alike = docs.join(often, column.eqNullSafe(F.col("_own")), "left_semi")
    return keep.unionByName(_by_text(alike, drop, words))


def _by_text(docs: DataFrame, drop: DataFrame, words: int) -> DataFrame:
    """The rows of docs whose (doc_id, set) is not in drop (_own, _set), the set told from the text."""
    names = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)))

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                sets = pa.array([digest(s) if len(s) else None for s in shingle_sets(utf8(part.column("text")), words)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, sets], [*part.schema.names, "_mine"])

    schema = T.StructType([*plain.schema.fields, T.StructField("_mine", T.LongType())])
    told = plain.mapInArrow(run, schema)
    gone = told["doc_id"].eqNullSafe(F.col("_own")) & (told["_mine"] == F.col("_set"))
    return told.join(drop, gone, "left_anti").drop("_mine").toDF(*names)
