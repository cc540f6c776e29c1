"""Paragraph dedup against brute force."""

import itertools
import random
import re

import pytest

from allelemill.llm import paragraph_dedup as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long, set string, `odd.name` string"


def cut(text):
    """(number, first word, words) of each paragraph."""
    out, word = [], 0
    for line in (text or "").split("\n"):
        words, run = re.findall(r"[^\x20\x09-\x0D]+", line), []
        for i, w in enumerate(words):
            run.append(w)
            if w[-1] in ".!?" or i == len(words) - 1:
                out.append((word, run))
                word += len(run)
                run = []
    return [(k, at, run) for k, (at, run) in enumerate(out)]


def shingles(words):
    lower = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    return {tuple(lower[i : i + 5]) for i in range(len(lower) - 4)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(2, 7)))
    sentence = lambda k: " ".join(word() for _ in range(k)) + "."
    passage = " ".join(sentence(k) for k in (32, 9, 40, 3, 25))
    texts = [None, "", " \n ", "one two", "x" * 50_000]
    for i in range(30):
        body = [sentence(rng.randrange(3, 50)) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body)), passage)
        texts.append((" " if i % 2 else "\n").join(body))
    near = sentence(60).split()
    for _ in range(3):
        other = list(near)
        other[rng.randrange(60)] = "changed"
        texts.append("Some words before. " + " ".join(other) + " and after")
    return [(i, t, None, None, None, "s", None) for i, t in enumerate(texts)]


def test_paragraphs(spark, rows):
    got = sorted(tuple(r)[:4] for r in P.marks(spark.createDataFrame(rows, DOCS)).where("last is null").collect())
    assert got == sorted((r[0], k, at, len(run)) for r in rows for k, at, run in cut(r[1]) if len(run) >= P.LEAST)


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([*rows, (None, rows[5][1], *rows[0][2:])], DOCS)
    places = [((r[0] is None, r[0], k), shingles(run)) for r in [*rows, (None, rows[5][1])] for k, _, run in cut(r[1]) if len(run) >= P.LEAST]
    places.sort(key=lambda p: tuple(-1 if x is None else x for x in p[0]))
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(places)), 2):
        a, b = places[i][1], places[j][1]
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    size = {}
    for i in range(len(places)):
        size[find(i)] = size.get(find(i), 0) + 1
    want = {(p[0][1], p[0][2]): (places[find(i)][0][1], places[find(i)][0][2], size[find(i)], find(i) != i) for i, p in enumerate(places) if size[find(i)] > 1}
    got = {(r["doc_id"], r["paragraph"]): (r["keep_doc_id"], r["keep_paragraph"], r["copies"], r["removed"]) for r in P.repeats(docs, bands=40).collect()}
    assert got == want
    exact = {(r["doc_id"], r["paragraph"]) for r in P.repeats(docs).collect()}
    assert exact <= set(want) and len(exact) >= len(want) - 3
    assert P.repeats(docs.where("false")).count() == 0
    assert P.recall(0.75) > 0.98 and P.recall(0.8) > 0.99


def test_all_pairs_of_a_bucket(spark):
    """Clusters that share boilerplate meet in many buckets, whose ends are of other clusters; still all pairs count."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    shared = [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        own = [word() for _ in range(16)]
        other = [*own[:-4], *(word() for _ in range(4))]
        texts += [" ".join([*shared, *own]), " ".join([*shared, *other])]
    p = P.Paragraphs([t.encode() for t in texts])
    sets = [set(p.shingles[a:b].tolist()) for a, b in itertools.pairwise(p.first)]
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= P.PERCENT * len(sets[i] | sets[j])
    at, keys = P.keys(p)
    own = [set(keys[a:b].tolist()) for a, b in itertools.pairwise(at)]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if own[i] & own[j] and near(i, j)}
    assert len(want) > 140 and len(set(keys.tolist())) < keys.size / 2
    got = {r["doc_id"]: r["keep_doc_id"] for r in P.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lost = {(i, j) for i, j in want if i not in got or got[i] != got.get(j)}
    assert not lost


def test_recall_with_shared_boilerplate(spark):
    """Measured with the registered parameters: families of two near copies (0.9), all with one boilerplate (0.55 across)."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    shared = [word() for _ in range(74)]
    texts = []
    for _ in range(400):
        own = [word() for _ in range(30)]
        texts += [" ".join([*shared, *own]), " ".join([*shared, *own[:-5], *(word() for _ in range(5))])]
    sets = [shingles(t.split()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert alike(0, 1) > 0.89 and 0.5 < alike(0, 2) < 0.6
    found = P.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("removed").collect()
    right = sum(r["doc_id"] == r["keep_doc_id"] + 1 and r["copies"] == 2 for r in found)
    assert right == len(found) and right >= 0.95 * 400


def recalled(spark, pairs):
    """The share of pairs of texts of which the second is removed for the first, and whether nothing else is."""
    texts = [t for pair in pairs for t in pair]
    found = P.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("removed").collect()
    assert all(r["doc_id"] == r["keep_doc_id"] + 1 and r["doc_id"] % 2 for r in found)
    return len({r["doc_id"] for r in found}) / len(pairs)


@pytest.mark.parametrize(("words", "changed", "least"), [(8, 0, 1), (12, 0, 1), (18, 0, 1), (19, 1, 1), (24, 1, 1), (60, 1, 0.95), (74, 5, 0.95)])
def test_recall_of_paragraphs(spark, words, changed, least):
    """Whole paragraphs from 8 words on, equal or of a similarity of 0.75 to 0.87 (changed words at the end: as many shingles)."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    pairs = []
    for _ in range(200):
        own = [word() for _ in range(words)]
        other = list(own)
        for k in range(changed):
            other[-1 - k if words < 60 else rng.randrange(words) if changed < 5 else -1 - 2 * k] = word()
        texts = [" ".join([*(word() for _ in range(9))]) + ".\n" + " ".join(x) + ".\n" + " ".join([*(word() for _ in range(9))]) for x in (own, other)]
        if 100 * len(shingles(own) & shingles(other)) >= 75 * len(shingles(own) | shingles(other)):
            pairs.append(texts)
    assert len(pairs) > 100 and recalled(spark, pairs) >= least


@pytest.mark.parametrize(("words", "least"), [(31, 1), (40, 1), (24, 0.4)])
def test_recall_of_passages_glued_into_text(spark, words, least):
    """Word for word, without sentence ends: all of PIECE + SPREAD - 1 words and more."""
    rng = random.Random(words)
    some = lambda k: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(k)]
    pairs = []
    for _ in range(200):
        own = some(words)
        pairs.append([" ".join([*some(rng.randrange(20, 60)), *own, *some(rng.randrange(20, 60))]) for _ in range(2)])
    assert recalled(spark, pairs) >= least


def test_few_shingles_lose_no_pair():
    rng = random.Random(8)
    lists = [[rng.choice("abcdefg") for _ in range(rng.randrange(5, 26))] for _ in range(200)]
    lists += [[*x[rng.randrange(2) :], *rng.choices("abcdefg", k=rng.randrange(3))] for x in lists]
    p = P.Paragraphs([" ".join(x).encode() for x in lists], 1)
    at, found = P.keys(p)
    own = {int(d): set(found[a:b].tolist()) for d, (a, b) in zip(p.doc, itertools.pairwise(at), strict=True)}
    sets = [shingles(x) for x in lists]
    near = [(i, j) for i, j in itertools.combinations(own, 2) if min(len(sets[i]), len(sets[j])) <= P.FEW and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(near) > 50 and all(own[i] & own[j] for i, j in near)


def test_texts(spark, rows):
    """Removed words go, others stay where they were; other columns stay; documents without removals stay as they are."""
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"One  two\n{long}.\nThree", "a"), (2, f"{long}. Four  five\tsix", "b"), (3, None, "c"), (4, "", "d"), (5, "x " * 100_000, "e"), (None, long + ".", "f")], "doc_id long, text string, `words` string")
    found = P.deduplicated(docs)
    assert {(r["doc_id"], r["start_word"], r["n_words"], r["removed"]) for r in found.collect() if r["doc_id"] != 5} == {(1, 2, 60, False), (2, 0, 60, True), (None, 0, 60, True)}
    got = {r["words"]: r["text"] for r in P.texts(docs, found).collect()}
    assert got["a"] == f"One  two\n{long}.\nThree" and got["b"] == "Four  five\tsix" and got["c"] is None and got["d"] == "" and got["f"] == ""
    assert P.deduplicated(docs.where("false")).count() == 0 and P.texts(docs.where("false"), found.where("false")).count() == 0


def test_short_sentences_and_mid_sentence(spark, tmp_path):
    """The registered query finds planted passages of 50 words made of short sentences, or without any sentence end."""
    from allelemill.llm import queries

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    some = lambda k: [word() for _ in range(k)]
    texts, planted = [None, "", "two words"], []
    for k in range(60):
        passage = some(50)
        if k % 2:
            passage = [w + "." if i % 4 == 3 else w for i, w in enumerate(passage)]
        for _ in range(2):
            before, after = some(rng.randrange(15, 40)), some(rng.randrange(15, 40))
            planted.append((len(texts), len(before)))
            texts.append(" ".join([*before, *passage, *after]))
    clean = range(len(texts), len(texts) + 20)
    texts += [" ".join(some(120)) + "." for _ in clean]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_paragraph_dedup(spark, str(tmp_path)).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    for (doc, at), (other, _) in zip(planted, [planted[i ^ 1] for i in range(len(planted))], strict=True):
        assert all(r["start_word"] >= at and r["start_word"] + r["n_words"] <= at + 50 and r["copies"] == 2 for r in found[doc])
        assert {(r["keep_doc_id"], r["removed"]) for r in found[doc]} == {(min(doc, other), doc > other)}
    assert not set(clean) & set(found) and set(found) == {d for d, _ in planted}


def test_tables_and_shuffle_files_are_removed_after_use(spark, rows, monkeypatch):
    import os

    from allelemill import store

    made = []
    real = store.stored

    def noted(df, name):
        out = real(df, name)
        made.append((name, out.stored_path))
        return out

    monkeypatch.setattr(P, "stored", noted)
    before = spark.conf.get(store.CLEANUP, None)
    found = P.deduplicated(spark.createDataFrame(rows, DOCS))
    left = {name for name, path in made if os.path.exists(path)}
    assert {"sets", "met", "groups", "vectors"} <= {name for name, _ in made}
    assert not left & {"sets", "met", "groups", "vectors"}
    assert spark.conf.get(store.CLEANUP, None) == before
    assert found.count()  # what is still to run finds its tables
