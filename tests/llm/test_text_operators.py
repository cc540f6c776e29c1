"""Operators that work row by row, against brute force and round trips, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelemill.llm import language_id, license_scan, media_tiff, packing, quality_zstd, toxicity_crf
from allelemill.llm.common import Words, word_bytes
from allelemill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, n string, `odd.name` string"


def awkward(texts):
    return [(i, t, None, None, None, "x", None, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 9)))
    return [None, "", " ", "a", "...", "\t\n", "x" * 200_000, *[" ".join(word() for _ in range(rng.randrange(400))) for _ in range(40)], "same text", "same text", "日本語 😀"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = awkward(texts)
    return spark.createDataFrame([*rows, rows[8], (None, "no id", None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_words_match_regex():
    rng = random.Random(1)
    texts = ["", " a", "B c\x0bd\x1f e", *["".join(rng.choices("aB é\t\n.", k=rng.randrange(60))) for _ in range(50)]]
    for kind, pattern in (("space", r"[^\x20\x09-\x0D]+"), ("plain", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        w = Words([t.encode() for t in texts], word_bytes(kind))
        assert [int(n) for n in w.n[: len(texts)]] == [len(re.findall(pattern, t)) for t in texts]
        seen = {}
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for h, word in zip(w.hashes, [x for t in texts for x in re.findall(pattern, t.translate(lower))], strict=True):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_tiff_digests(docs, texts, nothing):
    rows = media_tiff.digests(media_tiff.stored_texts(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = media_tiff.stored_form(payload)
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["media_bytes"] == len(media)
    assert media_tiff.digests(media_tiff.stored_texts(nothing)).count() == 0


@pytest.mark.parametrize("compression", [media_tiff.NONE, media_tiff.LZW, media_tiff.ADOBE_DEFLATE, media_tiff.DEFLATE, media_tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    data = np.random.default_rng(0).integers(0, 7, 64 * 300, dtype=np.uint8).tobytes()
    found = list(media_tiff.pages(media_tiff.encode(data, page_rows=130, strip_rows=50, compression=compression, predictor=predictor)))
    assert b"".join(p["pixels"] for p in found) == data and [p["height"] for p in found] == [130, 130, 40]


@pytest.mark.parametrize("way", media_tiff.WAYS, ids=str)
def test_every_stored_form_reads_back(way):
    for n in (1, 15, 16, 63, 200):
        data = np.random.default_rng(n).integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        found = list(media_tiff.pages(media_tiff.encode(data, page_rows=70, **way)))
        pixels = b"".join(p["pixels"] for p in found)
        assert (np.packbits(np.frombuffer(pixels, dtype=np.uint8)).tobytes() if way.get("bits") == 1 else pixels) == data
        assert all(p["tiled"] == ("tile" in way) and p["compression"] == way["compression"] for p in found)


def page_of(data, width, height, **more):
    """One strip of a little-endian page, by hand: more are further tags (name to value)."""
    import struct

    tags = {"width": 256, "height": 257, "bits": 258, "compression": 259, "samples": 277, "strip_rows": 278, "predictor": 317}
    values = {"width": width, "height": height, "strip_rows": height, **more}
    fields = sorted([(tags[k], 4, 1, v) for k, v in values.items()] + [(273, 4, 1, 8), (279, 4, 1, len(data))])
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + b"\0\0\0\0"


def test_foreign_bytes():
    """The examples of the format's public specification (PackBits, LZW) and hand-made samples."""
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    assert media_tiff.unpack_packbits(packed, len(plain)) == plain
    # The string 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257 of nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    lzw = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert media_tiff.unpack_lzw(lzw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    (page,) = media_tiff.pages(page_of(bytes([0b10110000, 0b01010000]), 4, 2, bits=1, compression=1))
    assert list(page["pixels"]) == [1, 0, 1, 1, 0, 1, 0, 1]
    (page,) = media_tiff.pages(page_of(bytes([0x1F, 0x20, 0x34, 0x50]), 3, 2, bits=4, compression=1))
    assert list(page["pixels"]) == [1, 15, 2, 3, 4, 5]
    (page,) = media_tiff.pages(page_of(bytes([0b00011011]), 4, 1, bits=2, compression=1))
    assert list(page["pixels"]) == [0, 1, 2, 3]
    floats = np.array([[1.5, -2.25, 3.0], [0.0, 1e9, -7.5]], dtype="<f4")
    shuffled = np.ascontiguousarray(floats.astype(">f4")).view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    coded = np.concatenate([shuffled[:, :1], np.diff(shuffled, axis=1)], axis=1).astype(np.uint8).tobytes()
    (page,) = media_tiff.pages(page_of(zlib.compress(coded), 3, 2, bits=32, compression=8, predictor=3))
    assert (np.frombuffer(page["pixels"], dtype="<f4").reshape(2, 3) == floats).all()


def test_malformed_pages_are_error_rows(spark):
    broken = [page_of(b"x", 1 << 31, 1 << 31, bits=8, compression=8), page_of(b"x" * 9, 3, 3, bits=8, compression=1, samples=0), page_of(b"x", 70_000, 70_000, bits=8, compression=8), page_of(b"x" * (4 << 20), 170_000, 170_000, bits=8, compression=8), page_of(b"x" * (4 << 20), 30_000, 30_000, bits=8, compression=8), page_of(b"x" * 9, 3, 3, bits=7, compression=1), page_of(b"x", 3, 3, bits=8, compression=5), None, b""]
    media = spark.createDataFrame([(i, 1, b) for i, b in enumerate(broken)], "doc_id long, n_bytes long, media binary")
    for found in (media_tiff.media_pages(media).collect(), media_tiff.digests(media).collect()):
        assert len(found) == len(broken) and all(r["error"] for r in found)


def test_lzw_long_and_random():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 4094, 60_000):
        for high in (2, 256):
            data = rng.integers(0, high, n, dtype=np.uint8).tobytes()
            assert media_tiff.unpack_lzw(media_tiff.pack_lzw(data), n) == data
            assert media_tiff.unpack_packbits(media_tiff.pack_packbits(data), n) == data


def tiled_big_endian(pixels, tile):
    """A 16-bit tiled page with predictor 2, written by hand."""
    import struct

    h, w = pixels.shape
    out = bytearray(b"MM\0*\0\0\0\0")
    offsets, counts = [], []
    for top in range(0, h, tile):
        for left in range(0, w, tile):
            block = np.zeros((tile, tile), dtype=np.uint16)
            part = pixels[top : top + tile, left : left + tile]
            block[: part.shape[0], : part.shape[1]] = part
            block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(">u2")
            offsets.append(len(out))
            packed = zlib.compress(block.tobytes())
            counts.append(len(packed))
            out += packed
    lists = {}
    for name, values in (("o", offsets), ("c", counts)):
        lists[name] = len(out)
        out += struct.pack(f">{len(values)}I", *values)
    n = len(offsets)
    fields = [(256, 3, 1, w << 16), (257, 3, 1, h << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 8 << 16), (277, 3, 1, 1 << 16), (317, 3, 1, 2 << 16), (322, 3, 1, tile << 16), (323, 3, 1, tile << 16), (324, 4, n, lists["o"]), (325, 4, n, lists["c"])]
    out[4:8] = struct.pack(">I", len(out))
    out += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0\0\0\0"
    return bytes(out)


def test_tiff_tiles_and_errors(spark):
    pixels = np.random.default_rng(2).integers(0, 65536, (37, 50), dtype=np.uint16)
    good = tiled_big_endian(pixels, 16)
    (page,) = media_tiff.pages(good)
    assert page["tiled"] and page["pixels"] == pixels.astype(">u2").tobytes()
    two = media_tiff.encode(b"ab" * 64 * 100, page_rows=100)
    loop = bytearray(media_tiff.encode(b"a" * 64))
    loop[-4:] = loop[4:8]
    media = spark.createDataFrame([(1, two), (2, None), (3, b"junk"), (4, bytes(loop)), (5, good[:300])], "doc_id long, media binary")
    rows = media_tiff.media_pages(media).collect()
    by = lambda k: [(r["page"], r["error"] is None) for r in rows if r["doc_id"] == k]
    assert by(1) == [(0, True), (1, True)] and by(2) == [(0, False)] and by(3) == [(0, False)] and by(4) == [(0, True), (1, False)] and len(by(5)) == 1


def test_language(spark, docs, nothing):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("x", None)], "text string, lang string")
    profiles = language_id.profiles(train)
    assert sorted(profiles) == ["de", "en"]
    got = language_id.predicted(docs, profiles).collect()
    for r in got:
        text = "no id" if r["doc_id"] is None else None
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in ("en", "de", "und")), text
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 4, 5)} == {"und"}
    assert language_id.predicted(nothing, profiles).count() == 0
    assert language_id.profiles(train.where("false")) == {} and language_id.Ranks({}).predict("abc") == ("und", 0.0)
    assert language_id.Ranks(profiles).predict("und der Hund")[0] == "de"


@pytest.mark.parametrize("block", [1 << 19, 7, 3])
def test_gram_blocks(block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_CHARS", block)
    for text in ("Hello, wörld!  a", "a", "...", "ab cd" * 50, " é"):
        flat = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        want = {}
        for n in (1, 2, 3):
            for i in range(len(flat) - n + 1):
                if flat[i : i + n] != " ":
                    code = 0
                    for c in flat[i : i + n]:
                        code = code << 21 | ord(c)
                    want[code] = want.get(code, 0) + 1
        codes, counts = language_id.grams(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {k: v for k, v in want.items() if k != 32}


def test_quality(docs, nothing):
    rng = random.Random(4)
    good = [" ".join("".join(rng.choices("etaoin", k=5)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join("".join(rng.choices("XQZ#!", k=5)) for _ in range(80)) for _ in range(60)]
    model = quality_zstd.Model([(t, 1) for t in good[:40]] + [(t, 0) for t in bad[:40]], {0: 40, 1: 40})
    score = model.scorer()
    assert score([t.encode() for t in good[40:]]).min() > 0.5 > score([t.encode() for t in bad[40:]]).max()
    got = quality_zstd.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_zstd.scored(nothing, model).count() == 0
    assert quality_zstd.Model([], {}).scorer()([b"x"])[0] == 0.5
    assert quality_zstd.Model([("a", 1)], {1: 1}).scorer()([b"x", b""]).tolist() == [1.0, 1.0]


def test_marginals_against_all_taggings(monkeypatch):
    import itertools

    monkeypatch.setattr(toxicity_crf, "ROW", 4)
    rng = np.random.default_rng(1)
    n = np.array([3, 0, 1, 9, 4, 5, 0])
    emission, trans, start = rng.normal(size=n.sum()), rng.normal(size=(2, 2)), rng.normal(size=2)
    got = toxicity_crf.forward_backward(toxicity_crf.Grid(n), emission, trans, start)
    at, want = 0, []
    for k in n:
        e = emission[at : at + k]
        at += k
        total, ones = 0.0, np.zeros(k)
        for tags in itertools.product((0, 1), repeat=int(k)) if k else ():
            w = np.exp(start[tags[0]] + sum(e[i] * tags[i] for i in range(k)) + sum(trans[tags[i - 1], tags[i]] for i in range(1, k)))
            total += w
            ones += w * np.array(tags)
        want += list(ones / total) if k else []
    assert np.allclose(got, want)


def test_toxicity(docs, nothing):
    rng = random.Random(6)
    clean = lambda: [rng.choice(["sun", "tree", "river", "stone", "cloud", "meadow"]) for _ in range(30)]
    rows = [(" ".join(clean()), 0) for _ in range(60)]
    for _ in range(40):
        words = clean()
        for _ in range(3):
            words[rng.randrange(30)] = rng.choice(["vileword", "nastyword"])
        rows.append((" ".join(words), 1))
    model = toxicity_crf.Model(rows, {0: 60, 1: 40})
    scores, spans = model.score([b"sun tree vileword, river nastyword", b"sun tree river", b""], spans=True)
    assert scores[0] > 0.5 > max(scores[1:])
    assert [(s["start"], s["end"]) for s in spans[0]] == [(9, 17), (25, 34)] and spans[1:] == [[], []]
    got = toxicity_crf.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity_crf.kept(docs, model, 0.3).columns == docs.columns
    assert toxicity_crf.kept(docs, model, 0.3).count() == sum(r["score"] < 0.3 for r in got)
    assert toxicity_crf.scored(nothing, model).count() == toxicity_crf.kept(nothing, model, 0.3).count() == 0
    assert toxicity_crf.Model([("a", 0)], {0: 1}).score([b"x"]).tolist() == [0.0]


def test_labelled_sample(spark, docs):
    from allelemill.llm.learning import labelled_sample

    labels = spark.createDataFrame([(6, 1), (7, 0), (7, 1), (8, 0), (None, 1), (9, None), (10, 7), (99, 1), (47, 0), (47, 0)], "doc_id long, toxic int")
    sample, number = labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert number == {0: 2, 1: 2} and sorted(y for _, y in sample) == [0, 0, 0, 1]  # row 8 is there twice


BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def brute_licenses(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, texts):
    notice = "Permission is hereby granted, free of charge, to any person obtaining one copy of this software"
    more = ["Released under the MIT License.", "cc by CC-BY cc by", "GNU general public license GNU general public", "mit mit license license", notice, "Licensed under the very Apache License, Version 2.0!", "cc\x00by é"]
    rows = awkward([*texts, *more])
    docs = spark.createDataFrame([*rows, rows[-1], (0, "apache license", *rows[0][2:])], DOCS)
    got = license_scan.scan(docs).collect()
    assert len(got) == docs.count()
    want = sorted([(r[0], *brute_licenses(r[1])) for r in [*rows, rows[-1], (0, "apache license")]], key=str)
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], key=str) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["labels"] for r in got}
    at = len(texts)
    assert by[at + 4] == "mit" and by[at + 5] == "apache"
    assert license_scan.scan(docs.where("false")).count() == 0
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_packing(docs, texts, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = packing.packed(docs, tokenizer_path()).collect()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    ids[None] = [*whole.encode("no id", add_special_tokens=False).ids, 0]
    covered, filled = {}, {}
    for r in rows:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {k: len(v) * (2 if k == 8 else 1) for k, v in ids.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert packing.packed(nothing, tokenizer_path()).count() == 0


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    rng = random.Random(8)
    odd = ["  a  b \n\n c\t\td  ", "日本語 テスト١٢٣", "\x1c\x1d a\x85b  　x", "it's we'll I'd 'S", "a" * 5000, "\x00\x01", "é ​ z", "😀" * 50, "   ", "\n \n", "a\r\n b", "½ ² 1²"]
    odd += ["".join(rng.choices("ab '\n\t1é,.!sS", k=40)) for _ in range(200)]
    assert all(whole.encode(t, add_special_tokens=False).ids == own.encode_ordinary(t) for t in odd)


@pytest.mark.parametrize("histogram", [{}, {1: 3}, {256: 5, 255: 2, 1: 1}, {100: 1000, 156: 900, 3: 2}, {i: 5 + i % 7 for i in range(1, 256)}])
def test_patterns_hold_all_pieces(histogram):
    plan = packing.patterns(dict(histogram), 256)
    held = {}
    for column, times in plan:
        assert times > 0 and sum(n * c for n, c in column) <= 256
        for n, c in column:
            held[n] = held.get(n, 0) + c * times
    assert held == histogram
    room = sum(times for _, times in plan) * 256
    assert len(histogram) < 200 or sum(n * c for n, c in histogram.items()) / room > 0.98


def test_dictionary_of_little_text_is_all_of_it():
    texts = [b"one text", b"another", b"x" * 100_000]
    assert quality_zstd.dictionary(texts[:2]) == b"one text another"
    made = quality_zstd.dictionary([bytes([k]) * 3 for k in range(5)])
    assert made == b" ".join(bytes([k]) * 3 for k in range(5)) or made[:4] == b"\x37\xa4\x30\xec"


def test_pieces_have_added_tokens_as_the_tokenizer_does(spark):
    """The call that the operator makes, on texts with what the tokenizer knows as a token of its own."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>\n", "<|endoftext|", "x <|ENDOFTEXT|> é", "<|endoftext|>" * 2000, None, ""]
    found = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).collect()
    for k, text in enumerate(texts):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in found if r["doc_id"] == k)
        assert sum(n for _, n, _ in own) == len(ids) and own[0][0] == 0
        assert all(c == zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes()) for at, n, c in own)


def test_the_driver_gets_a_fitted_field_without_its_texts(spark, monkeypatch):
    """A task fits it, as it would be fitted here; without labels every score is 0."""
    import pickle

    from pyspark.sql import functions as F

    rows = [(k, f"plain words here {k} " + ("vile1 vile2 " if k % 3 == 0 else "kind one ") * 3, int(k % 3 == 0)) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    here = toxicity_crf.Model([r[1:] for r in rows], {0: 80, 1: 40})
    made, fit = [], toxicity_crf.Model.__init__
    monkeypatch.setattr(toxicity_crf.Model, "__init__", lambda *a, **k: made.append(a) or fit(*a, **k))
    there = toxicity_crf.fitted(docs, labels, F.lit(True))
    texts = [r[1].encode() for r in rows] + [b"", b"vile1"]
    assert not made and there.score(texts).tolist() == here.score(texts).tolist()
    assert len(pickle.dumps(there)) < 1 << 20 and pickle.loads(pickle.dumps(there)).score(texts).tolist() == here.score(texts).tolist()
    assert toxicity_crf.fitted(docs, labels, F.lit(False)).score(texts).tolist() == [0.0] * len(texts)
