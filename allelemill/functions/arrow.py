"""Arrow functions over the alignment kernel. Ship windows to them, not whole chromosomes."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..kernel import align, notation
from .columns import _col, deleted_texts
from ..schema import ARROW_ALLELE, ARROW_STRETCHES, ARROW_UNITS, ARROW_VARIANT

ARROW_PARSED = pa.struct([("variants", ARROW_ALLELE), ("error", pa.string())])
ARROW_SUMMARY = pa.struct([("distance", pa.int64()), ("supremal", ARROW_VARIANT), ("canonical", ARROW_ALLELE), ("local_supremal", ARROW_ALLELE), ("hgvs", pa.string()), ("atoms", ARROW_UNITS), ("error", pa.string())])


ARROW_SPAN = pa.struct([("distance", pa.int64()), ("supremal", ARROW_VARIANT), ("error", pa.string())])
CELL = pa.struct([("row", pa.int64()), ("col", pa.int64())])
ARROW_STEPS = pa.list_(pa.struct([("source", CELL), ("sink", CELL), ("variant", ARROW_VARIANT)]))
ARROW_DIFFERENCE = pa.struct([("subtrahend", ARROW_ALLELE), ("remainder", ARROW_ALLELE), ("with_subtrahend", pa.string()), ("with_remainder", pa.string()), ("between", pa.string())])
POINT = ("row", "col", "h1", "u1", "x1", "h2", "u2", "x2")
ARROW_CORE = pa.struct([("shift", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("points", pa.list_(pa.struct([(c, pa.int64()) for c in POINT])))])


def arrow_udf(kind: pa.DataType):
    """F.arrow_udf by an Arrow type: workers import this module without a session that could read type texts."""
    return F.arrow_udf(from_arrow_type(kind))


def _told(e: align.Edit) -> dict:
    return e._asdict()


def _read(v: dict) -> align.Edit:
    return align.Edit(v["start"], v["end"], v["sequence"])


def _each(function: Callable, kind: pa.DataType, *columns: pa.Array, optional: int = 0) -> pa.Array:
    """function over rows; null where an argument is null (but for the last `optional`)."""
    lists = [c.to_pylist() for c in columns]
    need = len(lists) - optional
    return pa.array([None if any(x is None for x in row[:need]) else function(*row) for row in zip(*lists, strict=True)], kind)


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


@arrow_udf(pa.int64())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each(align.edit_distance, pa.int64(), a, b)


def _bounded(a: str, b: str, most: int | None) -> int | None:
    try:
        return align.edit_distance(a, b, most)
    except align.DistanceExceeded:
        return None


@arrow_udf(pa.int64())
def bounded_distance(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    """The distance, null beyond `most`; a null `most` is no limit."""
    return _each(_bounded, pa.int64(), a, b, most, optional=1)


@arrow_udf(pa.string())
def sequence_relation(reference: pa.Array, lhs: pa.Array, rhs: pa.Array) -> pa.Array:
    return _each(align.relation, pa.string(), reference, lhs, rhs)


def _parsed(text: str | None, reference: str | None) -> dict:
    try:
        return {"variants": [_told(e) for e in notation.parse_hgvs(text, reference)], "error": None}
    except (TypeError, ValueError, NotImplementedError) as e:
        return {"variants": None, "error": _error(e)}


@arrow_udf(ARROW_PARSED)
def parse_hgvs(text: pa.Array) -> pa.Array:
    return pa.array([_parsed(t, None) for t in text.to_pylist()], ARROW_PARSED)


@arrow_udf(ARROW_PARSED)
def parse_hgvs_with(text: pa.Array, reference: pa.Array) -> pa.Array:
    return pa.array([_parsed(t, r) for t, r in zip(text.to_pylist(), reference.to_pylist(), strict=True)], ARROW_PARSED)


def summary(reference: str, observed: str, shift: int = 0, whole_length: int | None = None) -> dict:
    """Everything about one allele from a window at `shift` of a reference of whole_length (by default the window is the whole),
    in the reference's places; error `narrow` if the window is too narrow to tell."""
    found = align.told(reference, observed, shift == 0, whole_length is None or shift + len(reference) == whole_length)
    if found is None:
        return {"error": "narrow"}
    return _placed(found, reference, shift)


def _placed(found: align.Told, window: str, shift: int) -> dict:
    at = lambda e: _told(align.moved(e, shift if found.distance else 0))
    canonical = list(found.canonical)
    return {
        "distance": found.distance, "supremal": at(found.spanning), "canonical": [at(e) for e in canonical], "local_supremal": [at(e) for e in found.local_spanning],
        "hgvs": notation.rich(align.moved(canonical, shift), window, shift), "atoms": [{"pos": p + shift, "symbol": s} for p, s in found.units], "error": None,
    }


@arrow_udf(ARROW_SUMMARY)
def summarise(reference: pa.Array, observed: pa.Array) -> pa.Array:
    """Everything about one allele from its two sequences."""
    return _each(summary, ARROW_SUMMARY, reference, observed)


def _edits(edits: list[align.Edit | None], at: np.ndarray | int = 0) -> pa.StructArray:
    """Edits, or nulls, `at` symbols further on, column by column, which takes less time than a dictionary for each."""
    none = np.fromiter((e is None for e in edits), bool, len(edits))
    start, end, sequence = zip(*((0, 0, None) if e is None else e for e in edits), strict=True) if edits else ((), (), ())
    places = [pa.array(np.asarray(x, dtype=np.int64) + at, pa.int64(), mask=none) for x in (start, end)]
    return pa.StructArray.from_arrays([*places, pa.array(sequence, pa.string())], fields=list(ARROW_VARIANT), mask=pa.array(none, pa.bool_()))


def _lists(values: list[tuple | None], kind: pa.ListType, build: Callable, at: np.ndarray | None = None) -> pa.ListArray:
    """Lists, or nulls, as one column; build makes the column of all their values, those of each row `at` symbols further on."""
    sizes = np.fromiter((0 if v is None else len(v) for v in values), np.int64, len(values))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    none = np.fromiter((v is None for v in values), bool, len(values))
    flat = build(list(itertools.chain.from_iterable(v for v in values if v)), 0 if at is None else np.repeat(at, sizes))
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none, False)), flat, type=kind)


def allele_lists(alleles: list) -> pa.ListArray:
    """Alleles, or nulls, as one column."""
    return _lists(alleles, ARROW_ALLELE, _edits)


def _units(units: list[tuple[int, str]], at: np.ndarray | int = 0) -> pa.StructArray:
    places, symbols = zip(*units, strict=True) if units else ((), ())
    return pa.StructArray.from_arrays([pa.array(np.asarray(places, dtype=np.int64) + at, pa.int64()), pa.array(symbols, pa.string())], fields=list(ARROW_UNITS.value_type))


def _hgvs(canonical: tuple[align.Edit, ...], old: str, at: int) -> str:
    """The text of edits in the places of the stretch `old`, which begins at `at` of the reference."""
    form, places = notation.rich_form(canonical, tuple([old[e.start : e.end] for e in canonical]))
    return form % tuple([p + at for p in places])


#: How a field's column is made of cores (nulls where nothing is told), where they begin in the reference, and what they delete.
FIELDS = {
    "canonical": lambda cores, at, old: _lists([c and c.canonical for c in cores], ARROW_ALLELE, _edits, at),
    "local_supremal": lambda cores, at, old: _lists([c and c.local_spanning for c in cores], ARROW_ALLELE, _edits, at),
    "hgvs": lambda cores, at, old: pa.array([c and _hgvs(c.canonical, *where) for c, *where in zip(cores, old, at.tolist(), strict=True)], pa.string()),
    "atoms": lambda cores, at, old: _lists([c and c.units for c in cores], ARROW_UNITS, _units, at),
}


def window_summary(fields: tuple[str, ...]) -> Callable:
    """A function of window, observed window, shift and whole length that tells these fields of a summary, and the error, only.

    All windows' spanning edits are told at once, and what their texts tell is remembered in places of its own.
    """
    kind = pa.struct([*(ARROW_SUMMARY.field(f) for f in fields), ARROW_SUMMARY.field("error")])
    more = [f for f in fields if f in FIELDS]

    @arrow_udf(kind)
    def tell(window: pa.Array, observed: pa.Array, shift: pa.Array, whole_length: pa.Array) -> pa.Array:
        lists = [c.to_pylist() for c in (window, observed, shift, whole_length)]
        absent = np.fromiter((None in row for row in zip(*lists, strict=True)), bool, len(window))
        rows = [("", "", 0, 0) if no else row for no, row in zip(absent.tolist(), zip(*lists, strict=True), strict=True)]
        windows, seen = [r[0] for r in rows], [r[1] for r in rows]
        s = align.spans(windows, seen, [r[2] == 0 for r in rows], [r[2] + len(r[0]) == r[3] for r in rows])
        none = absent | s.narrow
        start = np.where(s.distance > 0, np.fromiter((r[2] for r in rows), np.int64, len(rows)), 0) + s.low
        old = [w[i:j] for w, i, j in zip(windows, s.low.tolist(), s.high.tolist(), strict=True)]
        new = [w[i : j + len(w) - len(r[0])] if d else "" for w, r, i, j, d in zip(seen, rows, s.low.tolist(), s.high.tolist(), s.distance.tolist(), strict=True)]
        spanning = [pa.array(start, pa.int64(), mask=none), pa.array(start + s.high - s.low, pa.int64(), mask=none), pa.array(new, pa.string(), mask=none)]
        found = {"distance": pa.array(s.distance, pa.int64(), mask=none), "supremal": pa.StructArray.from_arrays(spanning, fields=list(ARROW_VARIANT), mask=pa.array(none))}
        if more:
            cores = [None if no else align.core(a, b) for no, a, b in zip(none.tolist(), old, new, strict=True)]
            found |= {f: FIELDS[f](cores, start, old) for f in more}
        errors = pa.array([("narrow" if no else None) for no in (s.narrow & ~absent).tolist()], pa.string())
        return pa.StructArray.from_arrays([*(found[f] for f in fields), errors], fields=list(kind), mask=pa.array(absent))

    return tell


summarise_window = window_summary(("distance", "supremal", "canonical", "local_supremal", "hgvs", "atoms"))
#: The distance and the spanning edit alone.
span_window = window_summary(("distance", "supremal"))


@arrow_udf(ARROW_SUMMARY)
def summarise_allele(window: pa.Array, variants: pa.Array, shift: pa.Array, whole_length: pa.Array) -> pa.Array:
    """The same from sorted or unsorted variants, in the reference's places, that do not overlap."""

    def one(text: str, vs: list, low: int, whole: int) -> dict:
        edits = sorted(align.moved(_read(v), -low) for v in vs)
        return summary(text, align.patched(text, edits), low, whole)

    return _each(one, ARROW_SUMMARY, window, variants, shift, whole_length)


@arrow_udf(ARROW_SUMMARY)
def summarise_supremal(reference: pa.Array, supremal: pa.Array) -> pa.Array:
    """The same from a spanning edit: only its window is aligned."""
    return _each(lambda r, v: _placed(align.told(r[v["start"] : v["end"]], v["sequence"]), r[v["start"] : v["end"]], v["start"]), ARROW_SUMMARY, reference, supremal)


@arrow_udf(ARROW_ALLELE)
def edges(reference: pa.Array, observed: pa.Array) -> pa.Array:
    return _each(lambda r, o: [_told(e) for e in align.windowed(r, o).edges()], ARROW_ALLELE, reference, observed)


@arrow_udf(ARROW_STEPS)
def steps(reference: pa.Array, observed: pa.Array) -> pa.Array:
    """Edges with the matches that they join (rows and columns from the window's start, -1 before it)."""
    def one(r: str, o: str) -> list[dict]:
        w = align.windowed(r, o)
        at = lambda c: {"row": c[0] + w.shift, "col": c[1] + w.shift}
        return [{"source": at(p), "sink": at(q), "variant": _told(e)} for p, q, e in w.steps() if e.start < e.end or e.sequence]

    return _each(one, ARROW_STEPS, reference, observed)


@arrow_udf(ARROW_STRETCHES)
def stretches(reference: pa.Array, observed: pa.Array) -> pa.Array:
    return _each(lambda r, o: [dict(zip(("row", "col", "length"), x, strict=True)) for x in align.Alignments(r, o).stretches()], ARROW_STRETCHES, reference, observed)


@arrow_udf(ARROW_UNITS)
def unit_edits(reference: pa.Array, observed: pa.Array) -> pa.Array:
    return _each(lambda r, o: [{"pos": p, "symbol": s} for p, s in align.told(r, o).units], ARROW_UNITS, reference, observed)


@arrow_udf(ARROW_VARIANT)
def supremal(reference: pa.Array, observed: pa.Array) -> pa.Array:
    return _each(lambda r, o: _told(align.told(r, o).spanning), ARROW_VARIANT, reference, observed)


@arrow_udf(pa.int64())
def path_count(reference: pa.Array, observed: pa.Array) -> pa.Array:
    return _each(lambda r, o: align.windowed(r, o).walk_count(), pa.int64(), reference, observed)


@arrow_udf(pa.list_(ARROW_ALLELE))
def paths(reference: pa.Array, observed: pa.Array, limit: pa.Array) -> pa.Array:
    return _each(lambda r, o, n: [[_told(e) for e in w] for w in align.windowed(r, o).walks(n)], pa.list_(ARROW_ALLELE), reference, observed, limit, optional=1)


@arrow_udf(pa.list_(ARROW_ALLELE))
def atomic_paths(reference: pa.Array, observed: pa.Array, limit: pa.Array) -> pa.Array:
    """The same with each edit in every way of single deletions and insertions."""
    return _each(lambda r, o, n: [[_told(e) for e in w] for w in align.windowed(r, o).walks(n, True)], pa.list_(ARROW_ALLELE), reference, observed, limit, optional=1)


@arrow_udf(pa.list_(ARROW_ALLELE))
def atomics(variant: pa.Array, limit: pa.Array) -> pa.Array:
    """The interleavings of unit edits, the first `limit` of them; a null `limit` is none. `operators.expand.ways` gives rows
    one by one, of which there may be very many."""
    return _each(lambda v, n: [[_told(e) for e in way] for way in itertools.islice(align.interleavings(_read(v)), n)], pa.list_(ARROW_ALLELE), variant, limit, optional=1)


@arrow_udf(ARROW_ALLELE)
def diagonal(reference: pa.Array, observed: pa.Array) -> pa.Array:
    return _each(lambda r, o: [_told(e) for e in align.Alignments(r, o).diagonal()], ARROW_ALLELE, reference, observed)


@arrow_udf(pa.string())
def rich_hgvs_of(variants: pa.Array, deleted: pa.Array) -> pa.Array:
    """HGVS with repeats, duplications and inversions, from variants and the texts that they delete; an allele with an empty
    variant is an error text."""

    def one(vs: list, old: list) -> str:
        try:
            texts = [notation.rich_change(_read(v), o) for v, o in zip(vs, old, strict=True)]
        except ValueError as e:
            return _error(e)
        return "=" if not texts else texts[0] if len(texts) == 1 else f"[{';'.join(texts)}]"

    return _each(one, pa.string(), variants, deleted)


def rich_hgvs(variants, reference) -> Column:
    """The same from the reference, of which only the deleted texts are shipped."""
    return rich_hgvs_of(_col(variants), deleted_texts(variants, reference))


@arrow_udf(pa.list_(pa.string()))
def dot(reference: pa.Array, observed: pa.Array) -> pa.Array:
    """The alignment graph as lines of Graphviz text."""

    def one(r: str, o: str) -> list[str]:
        w = align.windowed(r, o)
        return notation.dot((s for s in w.steps() if w.distance), r, w.spanning())

    return _each(one, pa.list_(pa.string()), reference, observed)


@arrow_udf(pa.list_(pa.string()))
def internal_dot(reference: pa.Array, observed: pa.Array, atomics: pa.Array) -> pa.Array:
    """The same with internal labels (places of nodes, raw edits); with atomics in every way of unit edits."""

    def one(r: str, o: str, ways: bool) -> list[str]:
        w = align.windowed(r, o)
        return notation.dot((s for s in w.steps() if w.distance), r, w.spanning(), internal=True, atomics=ways)

    return _each(one, pa.list_(pa.string()), reference, observed, atomics)


@arrow_udf(ARROW_CORE)
def core_points(reference: pa.Array, observed: pa.Array) -> pa.Array:
    """The window of an allele's spanning edit (shift, a, b), and the matches and ends within it, with what names parts between them."""

    def one(r: str, o: str) -> dict:
        w = align.windowed(r, o)
        return {"shift": w.shift, "a": w.a, "b": w.b, "points": [dict(zip(POINT, p, strict=True)) for p in align.named_points(w)]}

    return _each(one, ARROW_CORE, reference, observed)


@arrow_udf(ARROW_DIFFERENCE)
def difference_part(reference: pa.Array, shift: pa.Array, a: pa.Array, b: pa.Array, p_row: pa.Array, p_col: pa.Array, q_row: pa.Array, q_col: pa.Array) -> pa.Array:
    """What lies between two points of an allele's alignments, what remains, and how they and the allele relate."""

    def one(r: str, at: int, x: str, y: str, i: int, j: int, k: int, m: int) -> dict:
        told = align.split(r, at, x, y, (i, j), (k, m))
        return {f: [_told(e) for e in v] if isinstance(v, list) else v for f, v in told.items()}

    return _each(one, ARROW_DIFFERENCE, reference, shift, a, b, p_row, p_col, q_row, q_col)
