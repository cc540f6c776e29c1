"""Phrase mining against counts of all phrases by hand."""

import collections
import random
import re

from allelemill.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, longest=5, top=2000):
    counts, totals = {}, collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, collections.Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own.update(" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: f for p, f in own.items() if " " in p and f >= least}
        scored = []
        for phrase, a in found.items():
            w = phrase.split(" ")
            cuts = [(1000 * a * totals[lang] // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(f" {phrase} " in f" {q} " and len(q) > len(phrase) and found[q] >= a for q in found):
                scored.append((-score, -a, phrase.encode(), (lang, phrase, a, own[" ".join(w[:k])], own[" ".join(w[k:])], totals[lang], score)))
        out += [(lang, rank, *row[1:]) for rank, (*_, row) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(spark, rows, **options):
    most = options.pop("top", 2000)
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in collocations.top(collocations.scored(*collocations.counted(docs, **options)), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(n, seed):
    draw = random.Random(seed)
    words = ["the", "New", "York", "York", "é", "Ünd", "a-b", "x\x00y", "of", "of", "　", "~|"]
    glue = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ! ", "\x0b"]
    return [("".join(draw.choice(words) + draw.choice(glue) for _ in range(draw.randint(0, 60))), draw.choice(["en", "de", None, ""])) for _ in range(n)]


def test_phrases_are_those_of_a_count_by_hand(spark):
    rows = [*texts(150, 1), (None, "en"), ("", None), (" \t\n", "en"), ("of " * 30, "en"), ("New York of of", "zz")]
    assert found(spark, rows, least=6) == plain(rows, 6)
    assert found(spark, rows, least=6, shard=10) == plain(rows, 6)  # many automata
    assert found(spark, rows, least=6, top=3) == plain(rows, 6, top=3)


def test_repeated_rows_count_and_few_phrases_do_not(spark):
    rows = [("a b c", "en")] * 100 + [("q r", "en")] * 99
    assert [r[2:5] for r in found(spark, rows)] == [("a b c", 100, 100)] and found(spark, rows) == plain(rows, 100)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    rows = texts(60, 2)
    monkeypatch.setattr(collocations, "slots_for", lambda docs: collocations.BLOCK)
    everything = found(spark, rows, least=3)
    monkeypatch.setattr(collocations, "_set", lambda bits, hashes: hashes == hashes)
    assert found(spark, rows, least=3) == everything == plain(rows, 3)


def test_empty_tables_long_texts_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.top(collocations.scored(*collocations.counted(empty))).count() == 0
    docs = spark.createDataFrame([(1, "one two " * 60_000, None)], SCHEMA).selectExpr("*", "1 AS phrase", "2 AS n", "3 AS words", "4 AS shard", "5 AS rank")
    got = collocations.top(collocations.scored(*collocations.counted(docs))).collect()
    assert plain([("one two " * 60_000, None)], 100) == sorted(tuple(r) for r in got)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 3 * 10**9), ("en", "b", 4 * 10**9), ("en", "a b", 2 * 10**9)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 7 * 10**12)], "lang string, n long")
    assert collocations.scored(counts, totals).first()["score"] == 1000 * 2 * 10**9 * 7 * 10**12 // (3 * 10**9 * 4 * 10**9)


def test_automata_scan_the_texts_of_their_languages_alone(spark, monkeypatch):
    """Many automata do not each read all texts: a language's candidates are sought in its texts."""
    rows = [(" ".join(f"{lang}{w}" for w in (k % 3, 1, 2, 3, k % 2)), lang) for lang in ("aa", "bb", "cc", None) for k in range(30)]
    seen, scan = [], collocations.matches

    def noted(docs, phrases, least):
        seen.append((len(phrases), {r["lang"] for r in docs.select("lang").distinct().collect()}))
        return scan(docs, phrases, least)

    monkeypatch.setattr(collocations, "matches", noted)
    assert found(spark, rows, least=6, shard=12) == plain(rows, 6)
    assert len(seen) >= 4 and all(len(langs) == 1 for _, langs in seen)
    assert {x for _, langs in seen for x in langs} == {"aa", "bb", "cc", None}
    seen.clear()
    assert found(spark, rows, least=6) == plain(rows, 6)
    assert len(seen) == 1 and len(seen[0][1]) == 4


def test_groups_are_dealt_to_shards():
    places, shards = collocations.dealt_groups({1: 25, 2: 4, 3: 5, 4: 6, 5: 10}, 10)
    assert places == {1: (0, 3), 5: (3, 1), 4: (4, 1), 3: (5, 1), 2: (5, 1)} and shards == [[1], [1], [1], [5], [4], [3, 2]]
