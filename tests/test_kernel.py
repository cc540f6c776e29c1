"""The alignment kernel against brute force and small published cases."""

import itertools
import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from allelemill.functions import arrow
from allelemill.kernel import align, notation
from allelemill.kernel.align import Alignments, Edit, edit_distance, patched, relation, windowed

dna = st.text("ACGT", max_size=9)


def slow_distance(a, b):
    if not a or not b:
        return len(a) + len(b)
    if a[0] == b[0]:
        return slow_distance(a[1:], b[1:])
    return 1 + min(slow_distance(a[1:], b), slow_distance(a, b[1:]))


def slow_units(a, b):
    """Unit edits of all minimal edit scripts, by walking them all."""
    best, found = slow_distance(a, b), set()

    def walk(i, j, used, units):
        if used + slow_distance(a[i:], b[j:]) > best:
            return
        if i == len(a) and j == len(b):
            found.update(units)
            return
        if i < len(a) and j < len(b) and a[i] == b[j]:
            walk(i + 1, j + 1, used, units)
        if i < len(a):
            walk(i + 1, j, used + 1, [*units, (i, "")])
        if j < len(b):
            walk(i, j + 1, used + 1, [*units, (i, b[j])])

    walk(0, 0, 0, [])
    return found


@settings(max_examples=80, deadline=None)
@given(dna, dna)
def test_distance_and_units(a, b):
    assert edit_distance(a, b) == slow_distance(a, b) == Alignments(a, b).distance
    if len(a) + len(b) <= 11:
        assert set(Alignments(a, b).unit_edits()) == slow_units(a, b)


@settings(max_examples=80, deadline=None)
@given(dna, dna, dna, dna)
def test_windows_change_nothing(left, a, b, right):
    w = windowed(left + a + right, left + b + right)
    whole = Alignments(left + a + right, left + b + right)
    assert (w.distance, w.spanning(), w.unit_edits(), w.canonical(), w.local_spanning()) == (whole.distance, whole.spanning(), whole.unit_edits(), whole.canonical(), whole.local_spanning())


@settings(max_examples=80, deadline=None)
@given(dna, dna)
def test_forms_patch_back(a, b):
    w = windowed(a, b)
    for form in (w.canonical(), w.local_spanning(), [w.spanning()], Alignments(a, b).diagonal(), *itertools.islice(w.walks(), 20)):
        assert patched(a, form) == b
    assert sum(1 for _ in w.walks()) == w.walk_count() if w.walk_count() < 200 else True
    if w.canonical() and a:
        assert patched(a, notation.parse_hgvs(notation.rich(w.canonical(), a), a)) == b


@settings(max_examples=60, deadline=None)
@given(dna, dna, dna)
def test_relation_mirrors(r, a, b):
    mirror = {"contains": "is_contained", "is_contained": "contains"}
    there = relation(r, a, b)
    assert relation(r, b, a) == mirror.get(there, there)
    assert relation(r, a, a) == "equivalent"


@pytest.mark.parametrize(
    "reference, lhs, rhs, expected",
    [("CATATATC", "CATATATATC", "CATATTATC", "contains"), ("AAA", "AA", "AA", "equivalent"), ("ACGT", "ACGT", "AGT", "disjoint"), ("AT", "ACT", "AGT", "disjoint"), ("ACT", "AGT", "ATT", "overlap")],
)
def test_relations(reference, lhs, rhs, expected):
    assert relation(reference, lhs, rhs) == expected


@pytest.mark.parametrize(
    "reference, observed, edits, text",
    [("CATATATC", "CATATATATC", [Edit(1, 7, "ATATATAT")], "2_7AT[4]"), ("CATCAT", "TCAT", [Edit(0, 2, "")], "1_2del"), ("CAAAAAA", "TTTTTTG", [Edit(0, 7, "TTTTTTG")], "1_7inv"), ("ATAT", "ATATATATA", [Edit(4, 4, "ATATA")], "4_5ins[AT[2];A]")],
)
def test_canonical(reference, observed, edits, text):
    found = windowed(reference, observed).canonical()
    assert found == edits and notation.rich(found, reference) == text


def test_bounds():
    assert edit_distance("CTCGGCATTA", "GGCTGGCTGT", 6) == 6
    with pytest.raises(align.DistanceExceeded):
        edit_distance("CTCGGCATTA", "GGCTGGCTGT", 5)
    assert edit_distance("", "", 0) == 0
    with pytest.raises(ValueError):
        notation.rich([Edit(0, 0, "")], "")


@pytest.mark.parametrize("text", ["", "0del", "4_3del", "3delAA", "3insA", "3_4ins", "10_12[", "=3", "[3del", "3del;", "3_4A>T", "6_7ins[A;]", "5[3]", "5_6[3]"])
def test_bad_hgvs(text):
    with pytest.raises(ValueError):
        notation.parse_hgvs(text, "ACGTACGTACGTACGT")


@pytest.mark.parametrize("text", ["4dup", "4inv", "123", "10_12", "6TTT[3]"])
def test_unsupported_hgvs(text):
    with pytest.raises(NotImplementedError):
        notation.parse_hgvs(text)


def test_hgvs_forms():
    reference = "TTGAGAGAGATT"
    assert notation.parse_hgvs("3GA[3]", reference) == [Edit(2, 10, "GAGAGA")]
    assert notation.parse_hgvs("NC:g.[5A>T;1_2dup]", "ACCGAG") == [Edit(0, 2, "ACAC"), Edit(4, 5, "T")]
    assert notation.parse_hgvs("6_7ins[A[2];CT]", reference) == [Edit(6, 6, "AACT")]
    assert notation.parse_hgvs("[3=;4del]") == [Edit(3, 4, "")]
    assert notation.parse_hgvs("=") == []
    with pytest.raises(ValueError):
        notation.parse_hgvs("40del", reference)


def test_interleavings():
    assert sorted(align.interleavings(Edit(1, 2, "T"))) == sorted([[Edit(1, 1, "T"), Edit(1, 2, "")], [Edit(1, 2, ""), Edit(2, 2, "T")]])
    assert sum(1 for _ in align.interleavings(Edit(0, 3, "ACG"))) == 20


def test_difference_adds_up():
    rng = random.Random(3)
    for _ in range(15):
        r = "".join(rng.choices("ACGT", k=10))
        o = r[:3] + "".join(rng.choices("ACGT", k=3)) + r[5:]
        for d in align.difference(r, o):
            assert d["with_subtrahend"] in ("equivalent", "contains", "disjoint", "overlap", "is_contained")


def test_small_edits_in_long_repeats():
    """A band of the distance holds them; the whole table would have 144 million cells."""
    n = 12_000
    w = windowed("G" + "A" * n + "C", "G" + "A" * (n - 1) + "C")
    assert w.distance == 1 and w.spanning() == Edit(1, n + 1, "A" * (n - 1)) and len(w.unit_edits()) == n
    assert w.canonical() == [Edit(1, n + 1, "A" * (n - 1))]
    w = windowed("G" + "AT" * (n // 2) + "C", "G" + "AT" * (n // 2) + "ATC")
    assert w.distance == 2 and w.spanning() == Edit(1, n + 1, "AT" * (n // 2 + 1))


def _by_bits(a, b):
    return len(a) + len(b) - 2 * align._common(a, b)


def test_fronts_tell_the_distance():
    rng = random.Random(12)
    for k in range(1500):
        a = "".join(rng.choices("ACG"[: rng.randrange(1, 4)], k=rng.randrange(0, 40)))
        b = list(a) if k % 2 else rng.choices("ACG", k=rng.randrange(0, 40))
        for _ in range(rng.randrange(4) if b else 0):
            b[rng.randrange(len(b))] = rng.choice(["A", "", "CC"])
        b = "".join(b)
        distance = _by_bits(a, b)
        assert align._fronts(a, b) == distance == align._fronts(b, a)
        for most in range(max(0, distance - 1), distance + 2):
            if most < distance:
                with pytest.raises(align.DistanceExceeded):
                    align._fronts(a, b, most)
            else:
                assert align._fronts(a, b, most) == distance


def test_distances_of_long_texts():
    """A large deletion, few edits of 200,000 symbols, and texts that have nothing to do with each other."""
    rng = random.Random(13)
    whole = "".join(rng.choices("ACGT", k=1753))
    assert align.edit_distance(whole, whole[:400] + whole[1277:]) == 877
    long = rng.choices("ACGT", k=200_000)
    other = list(long)
    for at in range(0, 200_000, 10_000):
        other[at] = ""
    begin = time.perf_counter()
    assert align.edit_distance("".join(long), "".join(other)) == 20
    assert time.perf_counter() - begin < 1
    a, b = ("".join(rng.choices("ACGT", k=900)) for _ in range(2))
    assert align.edit_distance(a, b) == _by_bits(a, b)
    with pytest.raises(align.DistanceExceeded):
        align.edit_distance("".join(long), "".join(other), 19)


def test_spans_tell_what_whole_alignments_tell():
    """All windows at once, of any symbols, among them equal, empty and long ones, and repeats that reach a border."""
    draw = random.Random(5)
    pairs = [("", ""), ("", "AC"), ("ACA", ""), ("GATTACA", "GATTACA"), ("é€é€é", "é€é"), ("A" * 2000, "A" * 1999), ("CAAAT", "CAAT"), ("AAAT", "AAT")]
    for _ in range(400):
        a = "".join(draw.choices("ACGT", k=draw.randrange(60)))
        at = draw.randrange(len(a) + 1)
        pairs.append((a, a[:at] + "".join(draw.choices("ACGT", k=draw.randrange(5))) + a[at + draw.randrange(5) :]))
    for ends in (True, False):
        found = align.spans([a for a, _ in pairs], [b for _, b in pairs], [ends] * len(pairs), [ends] * len(pairs))
        for (a, b), distance, low, high, narrow in zip(pairs, *(x.tolist() for x in found), strict=True):
            whole = align.Alignments(a, b)
            edit = whole.spanning()
            assert narrow == (a != b and not ends and (edit.start == 0 or edit.end == len(a)))
            if not narrow:
                assert (distance, low, high) == (whole.distance, edit.start, edit.end)
                told = align.core(a[low:high], edit.sequence)
                assert list(told.canonical) == align.moved(whole.canonical(), -low) and list(told.units) == [(p - low, x) for p, x in whole.unit_edits()]
                assert notation.rich(whole.canonical(), a) == arrow._hgvs(told.canonical, a[low:high], low)


def test_equal_cores_are_told_once(monkeypatch):
    """A task's alleles with one spanning edit's texts cost one alignment, wherever they lie."""
    made = []
    monkeypatch.setattr(align, "_small_core", lambda old, new: made.append(old) or align._core(old, new))
    align._known_core.cache_clear()
    tell = getattr(arrow.window_summary(("distance", "supremal", "hgvs")), "func")
    flanks = ["".join(random.Random(k).choices("ACGT", k=12)) for k in range(50)]
    windows = [f"{x}GCAATG{x}" for x in flanks]
    seen, shifts = [f"{x}GCATG{x}" for x in flanks], [1000 * k for k in range(50)]
    out = tell(*(pa.array(c) for c in (windows, seen, shifts, [10**6] * 50))).to_pylist()
    assert len(made) == 1
    assert [r["hgvs"] for r in out] == [notation.rich(align.moved(align.told(w, o).canonical, k), w, k) for w, o, k in zip(windows, seen, shifts, strict=True)]


def test_few_edits_tell_the_spanning_edit_of_long_texts():
    """As whole tables do, among repeats; and texts of 8,000 symbols cost hardly more than short ones."""
    draw = random.Random(17)
    for _ in range(1500):
        letters = "ACGT"[: draw.randrange(1, 5)]
        a = "".join(draw.choices(letters, k=draw.randrange(9))) + "".join(draw.choices(letters, k=draw.randrange(1, 5))) * draw.randrange(9) + "".join(draw.choices(letters, k=draw.randrange(9)))
        at = draw.randrange(len(a) + 1)
        b = a[:at] + "".join(draw.choices(letters, k=draw.randrange(4))) + a[at + draw.randrange(4) :]
        if a != b:
            whole = Alignments(a, b)
            assert align.few_edits(a, b) == (whole.distance, whole.spanning())
            assert align.few_edits(a, b, whole.distance - 1) is None
    pairs = [("T" + "ACG" * k + "T", "T" + "ACG" * (k - 1) + "T") for k in range(2600, 2700)]
    begin = time.perf_counter()
    found = align.spans([a for a, _ in pairs], [b for _, b in pairs], [False] * 100, [False] * 100)
    assert time.perf_counter() - begin < 2
    assert found.distance.tolist() == [3] * 100 and not found.narrow.any()
    assert found.low.tolist() == [1] * 100 and found.high.tolist() == [1 + 3 * k for k in range(2600, 2700)]
