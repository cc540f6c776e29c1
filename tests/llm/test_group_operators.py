"""Operators on groups and pairs of documents against brute force, and the pipeline."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from allelemill.llm import exact_dedup, jaccard_join, mixing
from allelemill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, best string, `odd.name` string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(400)]
    out = [None, "", "  ", "one", "two words", "Two Words", "a b c d", "a b c d e", "w " * 3000]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((" " if rng.random() < 0.8 else "\n ").join(copy))
            if rng.random() < 0.3:
                out.append(out[-1])
    passage = rng.choices(vocabulary, k=60)
    out += [" ".join(passage + rng.choices(vocabulary, k=k)) for k in range(5, 60, 4)]
    sources = ["b", "a", None, "é", "b", "b"]
    return [(i, t, None, sources[i % 6], None, "n", None, "o") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact(spark, docs, rows):
    repeated = docs.union(spark.createDataFrame([rows[3], rows[3], (None, "one", *rows[0][2:]), (None, "alone", *rows[0][2:])], DOCS))
    for digest in (exact_dedup._digest, lambda c: F.substring(F.sha2(c, 256), 1, 1)):  # the second one collides
        got = exact_dedup.groups(repeated, digest=digest).collect()
        assert len(got) == repeated.count()
        members = {}
        for r in [*rows, rows[3], rows[3], (None, "one"), (None, "alone")]:
            members.setdefault(normal(r[1]), []).append(r[0])
        want = []
        for text, ids in members.items():
            keep = min((i for i in ids if i is not None), default=None)
            kept = False
            for i in sorted(ids, key=lambda i: (i is None, i)):
                want.append((i, keep, len(ids), i == keep and not kept, digest is exact_dedup._digest and hashlib.sha256(text.encode()).hexdigest()))
                kept = True
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], digest is exact_dedup._digest and r["text_sha256"]) for r in got), key=str) == sorted(want, key=str)
    stay = exact_dedup.deduplicated(repeated)
    assert stay.columns == repeated.columns and stay.count() == len(members)
    by = {r["doc_id"]: r["text"] for r in stay.collect()}
    original = {r[0]: r[1] for r in rows}
    assert all(original[k] == v for k, v in by.items() if k is not None)
    assert exact_dedup.groups(docs.where("false")).count() == exact_dedup.deduplicated(docs.where("false")).count() == 0


def shingles(text, n=5):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {r[0]: (len(sets[i]), rows[find(i)][0]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("frequent, hubs, side", [(1 << 17, 6, 256), (0, 1, 3), (40, 1, 2)])
def test_jaccard(docs, rows, monkeypatch, frequent, hubs, side):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "HUBS", hubs)
    monkeypatch.setattr(jaccard_join, "SIDE_A", side)
    monkeypatch.setattr(jaccard_join, "SIDE_B", side)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs).collect()}
    assert got == brute_classes(rows)


def test_jaccard_odd_rows(spark, docs, rows):
    repeated = docs.union(spark.createDataFrame([rows[8], (None, "a b c d e", *rows[0][2:]), (5000, "a b c d e", *rows[0][2:])], DOCS))
    got = jaccard_join.classes(repeated).collect()
    assert len(got) == repeated.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[5000] == by[None] == 7 and by[0] == 0 and by[1] == 1
    stay = jaccard_join.one_of_each(docs)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == {c for _, c in brute_classes(rows).values()}
    assert jaccard_join.classes(docs.where("false")).count() == 0


def test_tree_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(150, 300)], rng.integers(0, 2**63, rng.integers(0, 90), dtype=np.uint64)])) for _ in range(80)]
    side = {"set": range(80), "n": [len(s) for s in sets], "root": range(80), "vec": [jaccard_join.vector(s) if i % 7 else None for i, s in enumerate(sets)]}
    found = {tuple(p) for p in jaccard_join.tree_pairs(side, side).tolist()}
    for i, j in itertools.combinations(range(80), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            assert (i, j) in found
            assert jaccard_join.may_link(jaccard_join.vector(sets[i]), len(sets[i]), jaccard_join.vector(sets[j]), len(sets[j]))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert all(got[x] == find(x) for x in got) and {x for e in edges if e[0] != e[1] for x in e} == set(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark, docs, rows):
    repeated = docs.union(spark.createDataFrame([rows[10], (None, "three more words", *rows[0][2:])], DOCS))
    got = mixing.taken(repeated).collect()
    assert len(got) == repeated.count()
    size, per, total = {}, {}, 0
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        per[r["source"]] = per.get(r["source"], 0) + r["taken"]
        total += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = {}, 1.5 * total, set(order)
    while True:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * size[s]
        left -= sum(goal[s] for s in over)
        open_ -= over
    goal |= {s: unit * weight[s] for s in open_}
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
    assert all(abs(per[s] - goal[s]) <= 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(repeated.repartition(3)).collect()))
    assert mixing.taken(docs.where("false")).count() == 0
    assert mixing.taken(docs.where("text is null")).first()["taken"] == 0


def test_mixed(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    near = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.taken(docs).collect() if r["size"]}
    assert set(counts) <= set(near) and all(abs(counts.get(k, 0) - v) <= 0.5 for k, v in near.items())
    assert mixing.mixed(docs.where("false")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        rows = before.collect()
        assert ids <= {r["doc_id"] for r in rows} and ids
        if name == "exact_dedup":
            assert len(ids) == len({normal(r["text"]) for r in rows})
        if name == "jaccard_join":
            assert ids == {c for _, c in brute_classes(sorted(((r["doc_id"], r["text"]) for r in rows))).values()}
        before = spark.createDataFrame(after.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids


def test_jaccard_join_without_doc_ids(spark):
    """A text without a doc_id bridges two others, and near copies without any are of one component."""
    from allelemill.llm import jaccard_join

    words = [f"w{i}" for i in range(104)]
    texts = [(1, words[:90]), (None, words[7:97]), (2, words[14:104])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.classes(docs).collect()} == {(1, 1), (None, 1), (2, 1)}
